"""Line dedup as a segment-partition edit join, in DataFrame operations only.

Lines of at least ``LEAST_CHARS`` characters are compared across all documents; lines at most THRESHOLD = 1 edit
(inserted, deleted or replaced character) apart are linked, and the classes are the connected components. Of each
class the first line by (doc_id, text hash, line number) stays, the others go. With ``short``, shorter lines that
are not blank are classed too, by equality: of equal ones the first stays.

A line is split into THRESHOLD + 1 = 2 segments. If two lines are one edit apart, one segment of the shorter
line stands unchanged in the other one, at the same distance from its begin or from its end. Each line is listed
under its own segments (role R) and probes as a line one character longer (role S) under the substrings of the
two lengths at those places; the keys carry the length. What is left between is the *open region*, the only place
where the edit can be.

Buckets of at most ``SMALL`` lines give pairs, whose open regions are verified with a banded bit-parallel edit
distance. Larger buckets are never paired: their open region is split again by the same rule, so their lines deal
themselves into buckets of half the region, down to a region of one character, where all lines are one edit apart
and are linked to one of them. Rows thus stay linear in the bucket, however large, and no link is lost.

Texts are not shuffled for the join: what is counted are hashes (two independent 64-bit hashes stand for a line);
lines are fetched for buckets that hold at least two of them.

Defined cases: a null text stays null, an empty one empty; without ``short``, shorter lines are neither compared
nor removed, and shorter blank lines never are; rows that repeat a doc_id and its text get the same result each;
a null doc_id comes after all others; all columns are kept, those named like the added ones are replaced; an empty
table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapline.llm.common import materialize
from gapline.llm.components import connected_components

THRESHOLD, LEAST_CHARS, SMALL = 1, 20, 16
#: Line hashes that are sent to all tasks at most (16 bytes each); beyond that they are joined by shuffle.
MOST_SENT = 1_000_000
#: Lines with so many places are hot if they are a thousandth of all repeated places too.
LEAST_HOT, MOST_HOT = 1000, 1000


def banded_distance(x: str, y: str, threshold: int) -> Column:
    """Edit distance of two columns of text, or threshold + 1 if it is larger: vertical differences of the band
    of 2 * threshold + 1 rows around the diagonal are held as bits, and a character of `y` moves them all at once."""
    k, wide = threshold, (1 << 2 * threshold + 1) - 1
    # bit j stands for row i - k + j of column i (rows count x, columns y)
    match = " | ".join(f"if(coalesce(get(p.x, i - {k} + {j} - 1) = get(p.y, i - 1), false), {1 << j}L, 0L)" for j in range(2 * k + 1))
    step = f"""
      element_at(transform(array({match}), m ->
      element_at(transform(array(((((m & s.vp) + s.vp) ^ s.vp) | m | s.vn) & {wide}L), d0 ->
      element_at(transform(array(struct(d0 & s.vp AS hn, (s.vn | ~(d0 | s.vp)) & {wide}L AS hp)), h ->
        named_struct('vp', shiftright(((shiftleft(h.hn, 1) | ~(d0 | shiftleft(h.hp, 1))) & {wide}L) | {wide + 1}L, 1),
                     'vn', shiftright(d0 & shiftleft(h.hp, 1), 1),
                     'd', s.d + if((d0 & {1 << 2 * k}L) = 0, 1, 0))), 1)), 1)), 1)"""
    # after the last column the bits stand one row lower: the row of x's end is k + n - m - 1 of them
    down = " + ".join(
        f"if({j} > {k} + size(p.x) - size(p.y) - 1 AND {j} < {2 * k}, cast(shiftright(z.vp, {j}) & 1 AS int) - cast(shiftright(z.vn, {j}) & 1 AS int), 0)"
        for j in range(2 * k)
    )
    start = ((1 << k + 1) - 1) << k
    return F.expr(f"""
      element_at(transform(array(named_struct('x', split({x}, ''), 'y', split({y}, ''))), p ->
        CASE WHEN abs(char_length({x}) - char_length({y})) > {k} THEN {k + 1}
             WHEN char_length({y}) = 0 THEN char_length({x})
             WHEN char_length({x}) = 0 THEN char_length({y})
             ELSE aggregate(sequence(1, size(p.y)), named_struct('vp', {start}L, 'vn', 0L, 'd', {k}),
                  (s, i) -> if(s.d > {3 * k}, s, {step}),
                  z -> least({k + 1}, z.d - ({down}))) END), 1)""")


def line_rows(docs: DataFrame, least: int = LEAST_CHARS, short: bool = False) -> DataFrame:
    """(doc_id, th, line_no, line, a, b) for each line that is compared, or with `short` each shorter one that is not
    blank as well. th: hash of the text; a, b: of the line."""
    compared = F.char_length("line") >= least
    lines = docs.select("doc_id", F.xxhash64("text").alias("th"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return lines.filter(compared | F.col("line").rlike(r"[^\s]") if short else compared).select(
        "*", F.xxhash64("line").alias("a"), F.xxhash64(F.lit(1), "line").alias("b")
    )


def split_region(rows: DataFrame) -> DataFrame:
    """Each row's two buckets: its open region's first half unchanged, or its second half.

    rows: (key, m, at, longer, a, b, line). The open region begins at `at` and has m characters, m + 1 if
    `longer` (role S). In: the bucket's key, which stands for all that is known to be equal."""
    m, at, wide = F.col("m"), F.col("at"), F.col("m") + F.col("longer").cast("int")
    half = F.floor(m / 2).cast("int")
    head, tail = F.greatest(half, F.lit(1)), m - half
    sides = F.array(
        F.struct(F.xxhash64("key", F.lit(0), F.substring(F.col("line"), at, head)).alias("key"), (m - head).alias("m"), (at + head).alias("at")),
        F.struct(F.xxhash64("key", F.lit(1), F.substring(F.col("line"), at + wide - tail, tail)).alias("key"), half.alias("m"), at.alias("at")),
    )
    return rows.select(F.explode(sides).alias("s"), "longer", "a", "b").select("s.*", "longer", "a", "b")


def first_buckets(lines: DataFrame) -> DataFrame:
    roles = F.array(
        *(F.struct((F.char_length("line") - i).cast("int").alias("m"), F.lit(bool(i)).alias("longer")) for i in range(THRESHOLD + 1))
    )
    whole = lines.select("a", "b", "line", F.explode(roles).alias("r")).select(
        F.xxhash64("r.m").alias("key"), "r.m", F.lit(1).alias("at"), "r.longer", "a", "b", "line"
    )
    return split_region(whole)


def shared(rows: DataFrame) -> DataFrame:
    """Rows of buckets that hold two lines at least, one of them in role R; one row a line and role. Copies of a line go
    before the buckets are counted and joined, in each task before they are sent."""
    rows = rows.distinct()
    counts = rows.groupBy("key").agg(F.min("a").alias("lo"), F.max("a").alias("hi"), F.min("longer").alias("none_short"))
    counts = counts.filter("lo < hi and not none_short").select("key")
    return rows.join(counts, "key")


def line_id(a: str = "a", b: str = "b") -> Column:
    return F.concat(F.hex(a), F.lit("-"), F.hex(b))


def links(lines: DataFrame, small: int = SMALL) -> DataFrame:
    """(a, b): ids of distinct lines at most THRESHOLD edits apart, enough of them to join all that are linked."""
    rows = materialize(shared(first_buckets(lines)), "line-buckets")
    involved = rows.select("a", "b").distinct()
    if involved.count() <= MOST_SENT:
        involved = F.broadcast(involved)
    texts = materialize(lines.select("a", "b", "line").join(involved, ["a", "b"], "left_semi").dropDuplicates(["a", "b"]), "line-texts")
    found, level = [], 0
    while True:
        sized = rows.join(rows.groupBy("key").agg(F.count("*").alias("n")), "key")
        few = sized.filter(F.col("n") <= small).drop("n").join(texts, ["a", "b"])
        region = F.substring(F.col("line"), F.col("at"), F.col("m") + F.col("longer").cast("int"))
        few = few.select("key", "longer", line_id().alias("id"), region.alias("open"))
        one, two = few.filter("not longer").alias("one"), few.alias("two")
        pairs = one.join(two, F.expr("one.key = two.key and (two.longer or one.id < two.id)"))
        near = pairs.select(F.col("one.id").alias("a"), F.col("two.id").alias("b"), F.col("one.open").alias("x"), F.col("two.open").alias("y"))
        near = near.filter(banded_distance("x", "y", THRESHOLD) <= THRESHOLD)
        found.append(materialize(near.select("a", "b").distinct(), f"line-links-{level}"))
        many = sized.filter(F.col("n") > small).drop("n")
        # one character or none is open: all R lines are one edit apart at most, as are S lines from the one R line
        end = many.filter("m <= 1").select("key", "m", "longer", line_id().alias("id"))
        heads = end.filter("not longer").groupBy("key").agg(F.min("id").alias("head"))
        ended = end.filter("m = 0 or not longer").join(heads, "key").filter("id <> head")
        found.append(materialize(ended.select(F.col("id").alias("a"), F.col("head").alias("b")).distinct(), f"line-ends-{level}"))
        rest = many.filter("m > 0").join(texts, ["a", "b"])
        rows, level = materialize(shared(split_region(rest)), f"line-buckets-{level}"), level + 1
        if rows.isEmpty():
            return reduce(DataFrame.unionByName, found)


def repeated_lines(docs: DataFrame, least: int = LEAST_CHARS, small: int = SMALL, short: bool = False) -> DataFrame:
    """(doc_id, th, line_no) of each line that another one of its class precedes."""
    lines = line_rows(docs.select("doc_id", "text"), least, short)
    joined = links(line_rows(docs.select("doc_id", "text"), least), small)
    parts = connected_components(joined).select(F.col("node").alias("line_id"), "component")
    place = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "th", "line_no")
    seen = lines.select("a", "b", place.alias("place"))
    firsts = seen.groupBy("a", "b").agg(F.min("place").alias("first"), F.count("*").alias("n")).withColumn("line_id", line_id())
    classes = firsts.join(parts, "line_id", "left").filter("n > 1 or component is not null")
    classes = materialize(classes.select("a", "b", "first", "n", F.coalesce("component", "line_id").alias("component")), "line-classes")
    return later_lines(seen, classes)


def later_lines(seen: DataFrame, classes: DataFrame, least_hot: int = LEAST_HOT) -> DataFrame:
    """Places (doc_id, th, line_no) of seen (a, b, place) that are not the first of their line's class.

    Lines that make up a thousandth of all such places or more, at most MOST_HOT of them, meet their places by broadcast;
    the places of the others are joined by shuffle, over which those of hot lines are spread."""
    heads = classes.groupBy("component").agg(F.min("first").alias("head"))
    owned = classes.join(heads, "component").select("a", "b", "n", "head")
    hot_from = max(least_hot, (classes.agg(F.sum("n")).first()[0] or 0) // MOST_HOT)
    hot = owned.filter(F.col("n") >= hot_from).select(F.col("a").alias("__a"), F.col("b").alias("__b"), F.col("head").alias("__hot"))
    cold = owned.filter(F.col("n") < hot_from).select(F.col("a").alias("__x"), F.col("b").alias("__y"), F.col("head").alias("__cold"))
    rows = seen.join(F.broadcast(hot), (F.col("a") == F.col("__a")) & (F.col("b") == F.col("__b")), "left")
    spread = F.when(F.col("__hot").isNull(), F.col("a")).otherwise(F.xxhash64("place"))
    rows = rows.withColumn("__by", spread).join(cold, (F.col("__by") == F.col("__x")) & (F.col("b") == F.col("__y")), "left")
    return rows.filter(F.col("place") > F.coalesce("__hot", "__cold")).select("place.doc_id", "place.th", "place.line_no")


def dedup_lines(docs: DataFrame, least: int = LEAST_CHARS, small: int = SMALL, short: bool = False) -> DataFrame:
    """All columns of `docs`, `text` without repeated lines, with n_lines and n_removed."""
    gone = materialize(repeated_lines(docs, least, small, short), "lines-gone")
    gone = gone.groupBy("doc_id", "th").agg(F.collect_list("line_no").alias("__gone"))  # of one document, once each
    gone = gone.select(F.col("doc_id").alias("__id"), F.col("th").alias("__th"), "__gone")
    kept = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    own = docs.select(*kept)
    # whole rows are joined: a document's lines come back together
    own = own.join(gone, own["doc_id"].eqNullSafe(gone["__id"]) & (F.xxhash64(own["text"]) == gone["__th"]), "left")
    own = own.withColumn("__lines", F.split("text", "\n"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__gone"))
    text = F.when(F.col("__gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(stay, lambda i: F.get("__lines", i)), "\n"))
    return own.select(
        *[text.alias("text") if c == "text" else own[c] for c in kept],
        F.coalesce(F.size("__lines"), F.lit(0)).alias("n_lines"),
        F.coalesce(F.size("__gone"), F.lit(0)).alias("n_removed"),
    )
