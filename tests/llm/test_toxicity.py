import zlib

import numpy as np

from gapline.llm import toxicity


def corpus(n, seed):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        words = [f"w{rng.integers(0, 400)}" for _ in range(rng.integers(3, 60))]
        bad = int(rng.random() < 0.3)
        if bad:
            words.insert(int(rng.integers(0, len(words))), "vile" + f"x{rng.integers(0, 30)}")
        rows.append((i, " ".join(words), ["en", "de"][i % 2], bad))
    return rows


def test_held_out_accuracy_and_cases(spark):
    rows = corpus(900, 1)
    docs = spark.createDataFrame([(r[0], r[1], r[2], 0.5) for r in rows] + [(None, None, None, None), (5000, "", "en", 1.0)], "doc_id long, text string, lang string, score double")
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows] + [(5, None), (None, 1)], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.toxicity(docs, labels).collect()}
    assert len(got) == 902 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got.values())
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 == 1]
    right = sum(got[r[0]]["predicted"] == r[3] for r in held)
    assert right >= 0.95 * len(held)
    assert not got[5000]["rejected"]


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r["score"] for r in toxicity.toxicity(docs, none).collect()] == [0.0]
    assert toxicity.toxicity(docs.limit(0), none).count() == 0


def test_all_labelled_rows_are_learned_from(spark, monkeypatch):
    """A word of toxic texts whose ids come late by hash, so that a bounded choice of labelled rows does not hold it."""
    monkeypatch.setattr(toxicity, "SHARD_ROWS", 1000, raising=False)  # several shards
    rng = np.random.default_rng(3)
    ids = [r[0] for r in spark.range(7000).selectExpr("id", "xxhash64(cast(id as string)) h").orderBy("h").collect()]
    known = [i for i in ids if zlib.crc32(str(i).encode()) % 3 != 1]
    early = {i for i in known if i % 2 == 0} - set([i for i in known if i % 2 == 0][1500:])
    word = {i: "" if i % 2 else "vile" if i in early else "foul" for i in ids}
    rows = [(i, " ".join([f"w{k}" for k in rng.integers(0, 300, 4)] + [word[i]]), "en") for i in ids]
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in ids], "doc_id long, toxic int")
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    got = {r["doc_id"]: r["predicted"] for r in toxicity.toxicity(docs, labels).collect()}
    held = [i for i in ids if zlib.crc32(str(i).encode()) % 3 == 1]
    assert {word[i] for i in held} == {"", "foul"}
    assert sum(got[i] == 1 - i % 2 for i in held) >= 0.95 * len(held)
