"""Each stage held against brute force on the rows that its predecessor kept."""

import random

import corpus_pipeline
from tests.llm.test_decontaminate import brute as brute_contamination
from tests.llm.test_linededup import brute as brute_lines
from tests.llm.test_simhash import brute_components, brute_print


def write(spark, folder, seed=11):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(("ka", "lo", "mi", "ru", "te", "so", "na")) for _ in range(rng.randint(1, 4)))
    line = lambda n: " ".join(word() for _ in range(n))
    text = lambda k: "\n".join(line(rng.randint(8, 30)) for _ in range(k))
    items = [(i, line(30)) for i in range(5)]
    rows, toxic = [], []
    for i in range(150):
        body, bad = text(rng.randint(1, 5)), int(i % 4 == 0)
        if bad:
            words = body.split(" ")
            words[len(words) // 2 : len(words) // 2] = ["vilex", "hatey"] * 3
            body = " ".join(words)
        rows.append([i, body])
        toxic.append((i, bad))
    shared = line(25)
    for i in (201, 202, 203):
        rows.append([i, text(2) + "\n" + shared + ("x" if i == 203 else "")])
    rows += [[210, rows[1][1]], [211, rows[2][1].replace("\n", " \n ") + " end"], [220, items[0][1] + " " + line(6)], [221, line(12) + " " + items[1][1] + "\n" + line(300)], [230, None], [231, ""], [232, "a\nb"], [240, "long " * 9000], [1, rows[1][1]]]
    docs = [(i, t, rng.choice(("en", "de")), "s", None if t is None else len(t)) for i, t in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(toxic, "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return items, dict(toxic)


def test_stages(spark, tmp_path):
    folder = f"file:{tmp_path}"
    items, toxic = write(spark, folder)
    docs, kept = spark.read.parquet(f"{folder}/documents.parquet"), {}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "best_fit_packing"]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        before = [(r["doc_id"], r["text"]) for r in docs.collect()]
        if name != "best_fit_packing":
            assert out.columns == docs.columns
        out.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        kept[name] = before, [tuple(r)[:2] for r in docs.collect()]

    before, after = kept["toxicity"]
    gone = {r[0] for r in before} - {r[0] for r in after}
    assert len(gone & {k for k, v in toxic.items() if v}) >= 0.9 * sum(toxic.values()) and not gone & {k for k, v in toxic.items() if not v}
    before, after = kept["line_dedup"]
    want = brute_lines(before, 20)
    left = [(r[0], want[r]) for r in before if want[r] == r[1] or (want[r] or "").strip()]
    assert sorted(map(str, after)) == sorted(map(str, left)) and 210 not in dict(after)
    before, after = kept["simhash_near_dedup"]
    parts = brute_components([r[0] for r in before], [brute_print(r[1]) for r in before])
    assert sorted(r[0] for r in after) == sorted(set(parts))
    before, after = kept["benchmark_decontamination"]
    hit = {x[0] for x in brute_contamination(before, items) if x[5]}
    assert sorted(map(str, after)) == sorted(map(str, (r for r in before if r[0] not in hit))) and 220 in hit
    before, _ = kept["best_fit_packing"]
    pieces = docs.collect()
    assert {r["doc_id"] for r in pieces} == {r[0] for r in before}
    fill = {}
    for r in pieces:
        fill[r["sequence_id"]] = fill.get(r["sequence_id"], 0) + r["length"]
    assert max(fill.values()) <= 2048 and len(fill) <= 1.05 * sum(fill.values()) / 2048 + 1
    assert sorted(map(str, (tuple(r)[:5] for r in corpus_pipeline.run(spark, folder).collect()))) == sorted(map(str, (tuple(r)[:5] for r in pieces)))


def test_repeated_ids_nulls_and_extra_columns(spark, tmp_path):
    folder = f"file:{tmp_path}"
    write(spark, folder)
    rng = random.Random(5)
    a, b, c = (" ".join("".join(rng.choice(("ka", "lo", "mi", "ru", "te", "so", "na")) for _ in range(3)) for _ in range(90)) for _ in range(3))
    rows = [(1001, a), (1001, b), (1000, a), (None, c), (None, None), (1002, ""), (1003, c)]  # none of them has a label
    docs = spark.createDataFrame([(i, t, "en", "s", 1, 9, False) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, spans int, n_removed boolean")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "spans", "n_removed"], name
    kept = [(r["doc_id"], r["text"]) for r in docs.collect()]
    # a stays once, under its first id; b stays though its id repeats; c stays under the id it has; one row has no text
    assert sorted(kept, key=str) == sorted([(1000, a), (1001, b), (1003, c), (1002, "")], key=str)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    assert sorted(r["doc_id"] for r in packed) == [1000, 1001, 1002, 1003]


def test_empty_tables(spark, tmp_path):
    folder = f"file:{tmp_path}"
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0
