import random

from pyspark.sql import functions as F

import corpus_pipeline
from gapline.llm import linededup


def near(x, y):
    """At most one edit apart."""
    if abs(len(x) - len(y)) > 1:
        return False
    i = next((i for i, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
    return x[i + 1 :] == y[i + 1 :] or x[i:] == y[i + 1 :] or x[i + 1 :] == y[i:]


def brute_classes(lines):
    label = {x: x for x in lines}
    for x in lines:
        for y in lines:
            if label[x] != label[y] and near(x, y):
                old, new = label[x], label[y]
                label = {k: new if v == old else v for k, v in label.items()}
    return label


def brute(rows, least):
    lines = {x for _, t in rows if t is not None for x in t.split("\n") if len(x) >= least}
    label, seen, out = brute_classes(lines), {}, {}
    order = sorted({r for r in rows if r[1] is not None}, key=lambda r: (r[0] is None, r[0] or 0))
    for r in order:
        keep = []
        for x in r[1].split("\n"):
            if len(x) < least or label[x] not in seen:
                keep.append(x)
            if len(x) >= least:
                seen.setdefault(label[x], r)
        out[r] = "\n".join(keep)
    return {r: out.get(r) for r in rows}


def variants(rng, base, n):
    out = []
    for _ in range(n):
        x = list(base)
        for _ in range(rng.choice((0, 1, 1, 1, 2))):
            at = rng.randrange(len(x))
            x[at : at + 1] = rng.choice(([], ["q"], ["é"], [x[at], "z"]))
        out.append("".join(x))
    return out


def test_banded_distance(spark):
    rng = random.Random(1)
    words = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 7))) for _ in range(60)]
    pairs = spark.createDataFrame([(x, y) for x in words for y in words], "x string, y string")
    for k in (1, 2, 3):
        got = pairs.filter(linededup.banded_distance("x", "y", k) != F.least(F.levenshtein("x", "y"), F.lit(k + 1)))
        assert got.count() == 0


def test_against_brute_force(spark):
    rng = random.Random(2)
    pool = [x for base in ("abcdefgh", "aaaaaaaa", "hgfedcba", "aßcéefgh") for x in variants(rng, base, 40)]
    rows = [(i, "\n".join(rng.choices(pool + ["", "x", "y"], k=rng.randint(0, 6)))) for i in range(60)]
    rows += [(100, None), (101, ""), (None, pool[0] + "\nalone here"), (3, rows[3][1]), (103, "\n\n"), (104, pool[1] * 400)]
    docs = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, n_lines int")
    want = brute(rows, 6)
    for small in (2, 16):
        got = linededup.dedup_lines(docs, least=6, small=small).collect()
        assert sorted(map(str, ((r["doc_id"], r["text"]) for r in got))) == sorted(str((r[0], want[r])) for r in rows)
    assert {r["doc_id"]: r["n_lines"] for r in got}[103] == 3
    assert linededup.dedup_lines(docs.limit(0)).count() == 0


def test_large_bucket_links_join_all(spark):
    """Classes of many lines one edit from each other, found without pairs."""
    base = "".join(chr(97 + i * 7 % 26) for i in range(120))
    lines = [base] + [base[:i] + "#" + base[i + 1 :] for i in range(120)] + [base[:i] + "+" + base[i:] for i in range(120)]
    far = [base[:i] + "##" + base[i + 2 :] for i in range(0, 118, 2)]
    docs = spark.createDataFrame(list(enumerate(lines + ["other " + x + x for x in far[:40]])), "doc_id long, text string")
    found = linededup.links(linededup.line_rows(docs), small=4).collect()
    label = {}
    find = lambda x: x if label.setdefault(x, x) == x else find(label[x])
    for a, b in found:
        label[find(a)] = find(b)
    assert len({find(x) for x in list(label)}) == 1 and len(label) == len(lines)
    assert len(found) < 40 * len(lines)


def test_equal_short_lines_go(spark):
    """By equality only; blank lines stay, and a copy of short lines leaves no husk in the pipeline."""
    long = "a line that is long enough to be compared"
    rows = [(1, f"Yes.\n\n{long}\nYes."), (2, f"Yes.\n\n{long}s"), (3, "Yes\n  \nYes.\nNo."), (4, "Les."), (None, "Les.\n "), (5, "\n")]
    docs = spark.createDataFrame([(*r, len(r[1])) for r in rows], "doc_id long, text string, n_chars long")
    got = {r["doc_id"]: (r["text"], r["n_removed"]) for r in linededup.dedup_lines(docs, short=True).collect()}
    assert got == {1: (f"Yes.\n\n{long}", 1), 2: ("", 2), 3: ("Yes\n  \nNo.", 1), 4: ("Les.", 0), None: (" ", 1), 5: ("\n", 0)}
    left = corpus_pipeline.drop_repeated_lines(spark, docs, "")
    assert sorted(r["doc_id"] for r in left.collect()) == [1, 3, 4, 5]


def test_a_hot_line_is_one_row_of_a_bucket(spark):
    """A footer of 20,000 documents and a variant of it: copies go before buckets are joined, and all but the first go."""
    from pyspark.sql import functions as F

    docs = spark.range(0, 20_000, 1, 4).select(F.col("id").alias("doc_id"), F.concat(F.lit("the same footer of all documents\nown line number "), F.format_string("%06d", F.col("id") * 37 + 11), F.lit(" with more words "), F.sha2(F.col("id").cast("string").cast("binary"), 256)).alias("text"))
    docs = docs.unionByName(spark.createDataFrame([(20_000, "the same footer of all documentz")], "doc_id long, text string"))
    rows = linededup.shared(linededup.first_buckets(linededup.line_rows(docs)))
    assert rows.groupBy("key").count().agg(F.max("count")).first()[0] <= 4
    got = linededup.dedup_lines(docs)
    assert got.agg(F.sum("n_removed")).first()[0] == 20_000 and got.filter("doc_id = 0").first()["n_removed"] == 0
