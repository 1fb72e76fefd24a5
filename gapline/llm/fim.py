"""Fill-in-middle transformation in native Spark SQL: a text is cut into prefix, middle and suffix and rearranged.

Units are words with the white space before them, and the white space at the end. The cuts, whether a text is rearranged
and in which order are read off the digits of sha256(``seed:doc_id``), so that they depend on nothing but the document.
With the sentinels P, S, M: *psm* is P prefix S suffix M middle, *spm* is S suffix P prefix M middle; a *plain* text
stays as it is. A text that contains a sentinel stays plain, so the first occurrence of each sentinel in a rearranged
text is the one that was put there (a sentinel begins with the only ``<`` and ends with the only ``>`` in it, so it
cannot begin inside another one or half in a text), and ``restored`` gives the text back from output and form alone.

No shuffle, no Python: one projection over the scan. Each row's units are held once, as the array that the built-in
regular expression makes.

Defined cases: a null text is an empty one; an empty text has no units and stays plain; a null id counts as the empty
text in ``seed:doc_id``; rows that repeat an id and a text get the same result each; texts of any length are cut whole;
other columns are kept, those named like the added ones are replaced; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNITS = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
ADDED = ("n", "form", "output", "prefix_chars", "middle_chars")


def digit_group(digest: Column, k: int) -> Column:
    """The k-th group, from 0, of eight hex digits as an unsigned integer."""
    return F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("bigint")


def fill_in_middle(docs: DataFrame, seed: int = 42, share: int = 50, spm_share: int = 80) -> DataFrame:
    """All columns of `docs`, with n (units), form, output, prefix_chars and middle_chars (null if plain).

    `share`: of a hundred texts, so many are rearranged; `spm_share`: of a hundred of these, so many as spm."""
    kept = [c for c in docs.columns if c not in ADDED]
    text = F.coalesce(F.col("text"), F.lit(""))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    rows = docs.select(*kept, text.alias("__text"), digest.alias("__h"), F.regexp_extract_all(text, F.lit(UNITS), F.lit(0)).alias("__units"))
    n = F.size("__units").cast("bigint")
    one, two = digit_group(F.col("__h"), 0) % (n + 1), digit_group(F.col("__h"), 1) % (n + 1)
    marked = F.lit(False)
    for sentinel in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | F.contains("__text", F.lit(sentinel))
    plain = (n == 0) | marked | (digit_group(F.col("__h"), 2) % 100 >= share)
    form = F.when(plain, "plain").when(digit_group(F.col("__h"), 3) % 100 < spm_share, "spm").otherwise("psm")
    rows = rows.select(*kept, "__text", "__units", n.alias("n"), form.alias("form"), F.least(one, two).cast("int").alias("__a"), F.greatest(one, two).cast("int").alias("__b"))
    part = lambda begin, length: F.array_join(F.slice("__units", begin, length), "")
    changed = F.col("form") != "plain"
    rows = rows.select(
        *kept, "__text", "n", "form",
        F.when(changed, part(F.lit(1), F.col("__a"))).alias("__p"),
        F.when(changed, part(F.col("__a") + 1, F.col("__b") - F.col("__a"))).alias("__m"),
        F.when(changed, part(F.col("__b") + 1, F.col("n").cast("int") - F.col("__b"))).alias("__s"),
    )
    output = (
        F.when(F.col("form") == "psm", F.concat(F.lit(PREFIX), "__p", F.lit(SUFFIX), "__s", F.lit(MIDDLE), "__m"))
        .when(F.col("form") == "spm", F.concat(F.lit(SUFFIX), "__s", F.lit(PREFIX), "__p", F.lit(MIDDLE), "__m"))
        .otherwise(F.col("__text"))
    )
    return rows.select(
        *kept, "n", "form", output.alias("output"),
        F.char_length("__p").cast("bigint").alias("prefix_chars"), F.char_length("__m").cast("bigint").alias("middle_chars"),
    )


def restored(output: Column, form: Column) -> Column:
    """The text that `fill_in_middle` made `output` of, by its sentinels."""
    after = lambda text, mark: F.substring(text, F.locate(mark, text) + F.lit(len(mark)), F.char_length(text))
    before = lambda text, mark: F.substring_index(text, mark, 1)
    # what stands first is followed by the second sentinel, what stands second by the middle's
    first, second = F.lit(None), F.lit(None)
    orders = {"psm": (PREFIX, SUFFIX), "spm": (SUFFIX, PREFIX)}
    for name, (a, b) in orders.items():
        one = before(F.substring(output, F.lit(len(a) + 1), F.char_length(output)), b)
        two = before(after(output, b), MIDDLE)
        first = F.when(form == name, one if name == "psm" else two).otherwise(first)
        second = F.when(form == name, two if name == "psm" else one).otherwise(second)
    return F.when(form == "plain", output).otherwise(F.concat(first, after(output, MIDDLE), second))
