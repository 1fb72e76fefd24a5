import hashlib
import random

from pyspark.sql import functions as F

from gapline.llm import exactdedup as E
from gapline.llm.common import LOWER_ASCII


def lowered(text):
    return (text or "").encode().translate(LOWER_ASCII)


def plainly(rows, largest=True):
    """Sorted (doc_id, keep_id, group_size, kept, sha256) by a dictionary of whole texts."""
    groups, out = {}, []
    for i, text in rows:
        groups.setdefault(lowered(text), []).append(i)
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = (max(known) if largest else min(known)) if known else None
        if not largest and known and None in ids:
            keep = min(known)
        free = True
        for i in sorted(ids, key=str):
            kept = free and i == keep
            free = free and not kept
            out.append((i, keep, len(ids), kept, hashlib.sha256(text).hexdigest()))
    return sorted(out, key=str)


def found(docs, **how):
    got = E.exact_dedup(docs, **how).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    return sorted(map(tuple, got), key=str)


def many(n, seed=1):
    draw = random.Random(seed)
    stems = ["".join(draw.choice("abAB é\n") for _ in range(draw.choice([0, 1, 3, 40]))) for _ in range(n // 4)]
    return [(i, draw.choice(stems) + draw.choice(["", "", "x", "X", "tail"])) for i in range(n)]


CASES = [(None, "a"), (7, "A"), (None, "only null"), (None, "only null"), (3, None), (4, ""), (5, "Ä"), (6, "ä"), (8, "same"), (8, "same"), (8, "SAME"), (2, "same"), (9, "z" * 400_000), (10, "Z" * 400_000)]


def test_trie_holds_whole_strings():
    draw = random.Random(3)
    texts = [bytes(draw.choice(b"ab") for _ in range(draw.randrange(9))) for _ in range(3000)]
    trie, counts = E.Patricia(), {}
    for i, t in enumerate(texts):
        trie.add(t, [i, 1, 1])
        counts[t] = (i, counts.get(t, (0, 0))[1] + 1)
    assert trie.texts == len(counts) and trie.total == sum(len(t) + E.NODE_BYTES for t in counts)
    got = {t: (owner[0], owner[2]) for head in list(trie.held) for t, owner in trie.take(head)}
    assert got == counts and trie.texts == 0 and not trie.held and not trie.root[E.KIDS]


def test_against_brute_force(spark):
    rows = many(1200) + CASES
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert found(docs) == plainly(rows)
    assert found(docs, largest=False) == plainly(rows, False)


def test_hashes_that_collide_join_no_texts(spark):
    """With a hash of a few values and tries that spill all the time the result is the same."""
    rows = many(500, 2) + CASES
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    weak = lambda t: bytes([len(t) % 2])
    assert found(docs, content_hash=weak) == plainly(rows)
    assert found(docs, content_hash=weak, held_bytes=20_000) == plainly(rows)


def test_spilled_subtrees_are_settled(spark):
    rows = many(3000, 4)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    rounds = E.owners(docs, held_bytes=8_000)
    assert len(rounds) >= 1 and sum(t.filter("not spilled").agg(F.sum("n")).first()[0] or 0 for t in rounds) == len(rows)
    assert found(docs, held_bytes=8_000) == plainly(rows)


def test_spill_in_a_partition():
    """A partition over its bound spills subtrees, and what collides with what was spilled goes with it."""
    import pyarrow as pa

    texts = [f"{c}{i:04d}".encode() * 20 for i in range(300) for c in "abc"]
    kinds = E.kinds_of(pa.int64())
    rows = [(len(t), b"same", i, 1, 1, t) for i, t in enumerate(texts)]
    batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*rows), kinds)], names=[n for n, _ in kinds])
    out = pa.Table.from_batches(list(E.owner_tries(True, 100_000)(iter([batch])))).to_pylist()
    assert sorted(r["text"] for r in out) == sorted(texts) and all(r["spilled"] for r in out)


def test_a_hot_group_moves_one_row_a_task(spark):
    docs = spark.range(0, 30_000, 1, 6).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "The same FOOTER").otherwise(F.concat(F.lit("t"), F.col("id") % 9000)).alias("text"))
    kind = "n_bytes long, key binary, id long, n_id long, n long, text binary"
    own = docs.select(F.col("doc_id").alias("id"), F.col("text").cast("binary").alias("text")).mapInArrow(E.own_tries(E.sha, True, E.HELD_BYTES), kind)
    hot = own.filter(F.col("n_bytes") == 15).collect()
    assert len(hot) == 6 and sum(r["n"] for r in hot) == 10_000
    got = E.exact_dedup(docs).groupBy("keep_id", "group_size").agg(F.sum(F.col("kept").cast("int")).alias("kept"), F.count("*").alias("n")).collect()
    assert all(r["kept"] == 1 and r["n"] == r["group_size"] for r in got) and max(r["n"] for r in got) == 10_000


def test_columns_and_empty_table(spark):
    docs = spark.createDataFrame([("b", "x", 1, "old"), ("a", "X", 2, "old")], "doc_id string, text string, n int, keep_id string")
    made = E.exact_dedup(docs)
    assert made.columns == ["doc_id", "text", "n", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted((r["doc_id"], r["text"], r["n"], r["keep_id"], r["kept"]) for r in made.collect()) == [("a", "X", 2, "b", False), ("b", "x", 1, "b", True)]
    assert E.exact_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0
