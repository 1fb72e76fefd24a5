"""Text functions, column to column: tokens, white space, canonical keys, word tests. Null in, null out.

Java's \\s and \\w are ASCII only, so the classes are spelled out: white space is Unicode's, and a letter or digit is
any of categories L and N.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from gapline import constants as C

#: Inside brackets.
SPACES = r"\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
SPACE, ALNUM, HIDDEN = f"[{SPACES}]", r"[\p{L}\p{N}]", r"[\p{Cf}\p{Cc}]"
TOKEN = C.TOKEN_PATTERN.replace(r"\s", SPACES)


def listed(pattern: str) -> str:
    """The characters up to U+00FF that match, one by one for use inside brackets: Java looks such a class up in one table,
    where it goes through ranges and categories by a call for each, which threads running side by side slow down."""
    return "".join(f"\\x{c:02x}" for c in range(256) if re.match(pattern, chr(c)))


#: Of characters up to U+00FF: letters and digits, visible ones, and visible ones that are not hidden (categories Cf, Cc).
_ALNUMS, _VISIBLE = listed(r"[^\W_]"), listed(r"[^\t-\r\x1c-\x20\x85\xa0]")
PLAIN = listed(r"[!-~\xa1-\xac\xae-\xff]")
_PUNCTUATION = listed(r"[^\w\t-\r\x1c-\x20\x85\xa0]|_")
#: For texts that `narrow` gives. What begins a readable chunk's letters and digits, to its end: one match a run of visible
#: characters with a letter or digit. A chunk that is an ordinary written word: short, with an ASCII letter, of letters,
#: digits and in-word marks between its first and its last letter or digit.
READABLE_CHUNK = f"[{_ALNUMS}][{_VISIBLE}]*"
WORD_CHUNK = (
    rf"(?<![{_VISIBLE}])[{_PUNCTUATION}]*+(?=[{listed(r'[^A-Za-z\t-\r\x1c-\x20\x85\xa0]')}]*+[{listed('[A-Za-z]')}])"
    rf"[{_ALNUMS}](?:[{_ALNUMS}+#.\-'&/]{{0,{C.MOST_WORD_CHARS - 2}}}[{_ALNUMS}])?[{_PUNCTUATION}]*+(?![{_VISIBLE}])"
)
WIDE = r"\x{100}-\x{10ffff}"


def bind(col: Column, use) -> Column:
    """`use(col)` with the column worked out once, however often it occurs in it."""
    return F.get(F.transform(F.array(col), use), 0)


def sql_text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def is_in(col: Column, values) -> Column:
    """Membership in a short fixed list; the list is one parsed literal, as a call for each value is slow to build."""
    return F.array_contains(F.expr(f"array({', '.join(map(sql_text, values))})"), col)


def strip(col: Column) -> Column:
    return F.regexp_replace(col, f"^{SPACE}+|{SPACE}+$", "")


def narrow(col: Column) -> Column:
    """For counting by classes: of characters beyond U+00FF letters and digits become é, white space a blank, others ¬."""
    wide = F.regexp_replace(F.regexp_replace(col, rf"[{WIDE}&&[\p{{L}}\p{{N}}]]", "é"), f"[{WIDE}&&[{SPACES}]]", " ")
    return F.when(col.rlike(f"[{WIDE}]"), F.regexp_replace(wide, f"[{WIDE}]", "¬")).otherwise(col)


def is_blank(col: Column) -> Column:
    return ~col.rlike(f"[^{SPACES}]")


def chunks(col: Column) -> Column:
    """What stands between white space."""
    return F.filter(F.split(col, f"{SPACE}+"), lambda w: w != "")


def tokenize(col: Column) -> Column:
    """Words with their inner + # . - and closing + #; any other visible character is a token of its own."""
    return F.regexp_extract_all(col, F.lit(f"({TOKEN})"), 1)


def word_tokens(col: Column) -> Column:
    """The tokens that hold an ASCII letter or digit."""
    return F.regexp_extract_all(col, F.lit(TOKEN.split("|")[0]), F.lit(0))


def dot_glue(col: Column) -> Column:
    """For each token: is it a dot that stands right before the next token?"""
    return F.transform(F.regexp_extract_all(col, F.lit(rf"(\.(?=[^{SPACES}]))|{TOKEN}"), 1), lambda dot: dot == ".")


def collapse_whitespace(col: Column) -> Column:
    return F.trim(F.regexp_replace(col, f"{SPACE}+", " "))


def remove_stopwords(col: Column, stopwords: list[str]) -> Column:
    """Words without punctuation other than dots, but for the stopwords in any case."""
    words = chunks(F.regexp_replace(col, rf"[^\p{{L}}\p{{N}}_.{SPACES}]", ""))
    return F.array_join(F.filter(words, lambda w: ~is_in(F.lower(w), stopwords)), " ")


def visible_text(col: Column) -> Column:
    """Without invisible characters and surrounding space; only for tests whether anything is there."""
    return strip(F.translate(col, C.INVISIBLE, ""))


def scan_invisible(col: Column) -> Column:
    """struct(trimmed, interior): without hidden characters at the ends, and the first one left inside, or null."""
    inner = lambda t: F.nullif(F.regexp_extract(t, f"({HIDDEN})", 1), F.lit(""))
    return bind(F.regexp_replace(col, f"^{HIDDEN}+|{HIDDEN}+$", ""), lambda t: F.struct(t.alias("trimmed"), inner(t).alias("interior")))


# --- canonical keys -------------------------------------------------------------------------------------------


def collapse_acronym(word: Column) -> Column:
    """Three or more single characters between dots lose the dots."""
    return F.when(word.rlike(r"^[a-z0-9](\.[a-z0-9]){2,}$"), F.replace(word, F.lit("."), F.lit(""))).otherwise(word)


def clean_word(word: Column) -> Column:
    bare = F.nullif(F.regexp_replace(word, r"^\.+|\.+$", ""), F.lit(""))
    return F.when(F.instr(word, ".") == 0, word).otherwise(bind(F.coalesce(bare, word), collapse_acronym))


def normalize(col: Column) -> Column:
    flat = F.trim(F.regexp_replace(F.lower(col), "[^a-z0-9+#.]+", " "))
    return F.array_join(F.transform(F.filter(F.split(flat, " "), lambda w: w != ""), clean_word), " ")


def fold_plural(word: Column) -> Column:
    cut = lambda n: F.substring(word, F.lit(1), F.char_length(word) - n)
    return (
        F.when(is_in(word, C.UNFOLDED) | ~word.rlike("^[a-z]+$") | (F.char_length(word) <= 3), word)
        .when(word.endswith("ies"), F.concat(cut(3), F.lit("y")))
        .when(word.rlike("(sses|shes|ches|xes)$"), cut(2))
        .when(word.endswith("s") & ~word.rlike("(ss|us)$"), cut(1))
        .otherwise(word)
    )


def fold_words(col: Column) -> Column:
    return F.array_join(F.transform(F.split(col, " "), fold_plural), " ")


def _look_up(col: Column, table: dict[str, str]) -> Column:
    literal = F.expr(f"map({', '.join(sql_text(x) for pair in table.items() for x in pair)})")
    return bind(col, lambda c: F.coalesce(F.try_element_at(literal, c), c))


def canonical(col: Column) -> Column:
    """The key on which spans are compared: aliases are looked up before and after plurals are folded. A word without dots
    that is no alias needs neither list nor look-up, and most are such words."""
    whole = _look_up(fold_words(_look_up(normalize(col), C.ALIASES)), C.ALIASES_FOLDED)
    low = F.lower(col)
    plain = low.rlike(r"^[a-z0-9+#]+\z") & ~low.isin(*C.ALIASES)
    return F.when(plain & ~fold_plural(low).isin(*C.ALIASES_FOLDED), fold_plural(low)).otherwise(whole)


def is_generic(canon: Column) -> Column:
    """Boilerplate: nothing to read, or a term of the list. Takes a canonical key."""
    return ~canon.rlike(ALNUM) | is_in(canon, C.GENERIC_TERMS)


# --- words of a text and of a span ----------------------------------------------------------------------------


def trim_edge_punctuation(span: Column) -> Column:
    """Without words at either end that hold no letter or digit."""

    def cut(z: Column) -> Column:
        first = F.array_position(z["marks"], True)
        last = F.size(z["words"]) - F.array_position(F.reverse(z["marks"]), True) + 1
        kept = F.slice(z["words"], F.greatest(first, F.lit(1)), F.greatest(last - first + 1, F.lit(0)))
        return F.when(first == 0, F.lit("")).otherwise(F.array_join(kept, " "))

    readable = lambda words: F.transform(words, lambda w: w.rlike(ALNUM))
    both = bind(chunks(span), lambda words: F.struct(words.alias("words"), readable(words).alias("marks")))
    return bind(both, cut)


def is_word(chunk: Column) -> Column:
    """An ordinary written word: short, with an ASCII letter, of letters, digits and in-word marks."""
    core = F.regexp_replace(chunk, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")
    return bind(core, lambda c: (F.char_length(c) <= C.MOST_WORD_CHARS) & c.rlike("[A-Za-z]") & c.rlike(r"^[\p{L}\p{N}+#.\-'&/]+$"))


def words(col: Column) -> Column:
    return F.filter(chunks(col), is_word)


def quote_spans(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat(F.lit("'"), s, F.lit("'"))), ", ")


def fingerprint(jd: Column, resume: Column) -> Column:
    """SHA-256 of both raw texts, each after its length in characters."""
    part = lambda c: F.concat(F.char_length(c).cast("string"), F.char(F.lit(0)), c)
    return F.sha2(F.concat(part(jd), part(resume)).cast("binary"), 256)


def draft_filename(role: Column, mark: Column) -> Column:
    slug = F.regexp_replace(F.regexp_replace(F.lower(role), r"[^\p{L}\p{N}]+", "-"), "^-|-$", "")
    slug = F.coalesce(F.when(slug != "", slug), F.lit("role"))
    return F.concat(F.lit("feedback_"), slug, F.lit("_"), F.substring(mark, 1, 8), F.lit(".txt"))
