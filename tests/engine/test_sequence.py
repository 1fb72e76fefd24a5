import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from gapline import constants as C
from gapline.operators import metrics, sequence
from gapline.plans import labellers
from gapline.sources import conll, datagen
from gapline.sources import text as texts


def test_windows_cover_and_fit():
    rng = random.Random(1)
    for _ in range(60):
        lengths = np.array([rng.choice([0, 1, 1, 2, 3, 30, 90]) for _ in range(rng.randint(0, 400))], np.int64)
        plan = sequence._plan(lengths, 60, 64)
        ends = [w["end"] for w in plan]
        assert ends == sorted(set(ends)) and (not len(lengths) or ends[-1] == len(lengths))
        assert all(b["start"] <= a["end"] for a, b in zip(plan, plan[1:])) and all(w["end"] - w["start"] == 1 or lengths[w["start"] : w["end"]].sum() <= 60 for w in plan)


def test_plan_column(spark):
    rows = spark.createDataFrame([(1, [1] * 100), (2, []), (3, None)], "k int, l array<int>").select("k", sequence.plan_windows(F.col("l"), 40, 8).alias("w"))
    got = {r["k"]: r["w"] for r in rows.collect()}
    assert [(w["start"], w["end"]) for w in got[1]] == [(0, 40), (32, 72), (64, 100)] and got[2] == [] and got[3] is None


def test_merge_gives_each_word_one_owner(spark):
    windows = spark.createDataFrame([("a", 0, 0, 40), ("a", 1, 32, 72), ("a", 2, 64, 100)], "doc_key string, win int, start int, end int")
    labels = spark.createDataFrame([("a", 0, p, "B-TOOLS") for p in range(40)] + [("a", 1, p, "I-TOOLS") for p in range(37, 72)], "doc_key string, win int, pos int, label string")
    assert [(r["win"], r["cut"]) for r in sequence.seams(windows, labels).orderBy("win").collect()] == [(0, 36), (1, 68)]
    merged = {r["pos"]: r["label"][0] for r in sequence.merge_labels(windows, labels).collect()}
    assert merged == {p: "B" if p < 36 else "I" for p in [*range(36), *range(37, 68)]}


def test_groups(spark):
    words = [("in", "O"), (".", "B-TECHNICALSKILL"), ("NET", "I-TECHNICALSKILL"), ("Spring", "B-TECHNICALSKILL"), ("Boot", "I-TECHNICALSKILL"), ("Git", "I-TOOLS"), ("/", "I-TOOLS"), ("git", "B-TOOLS"), ("x", "O"), ("y", "I-TOOLS")]
    rows = spark.createDataFrame([("d", i, w, w == ".", t) for i, (w, t) in enumerate(words)], "doc_key string, pos int, word string, glued boolean, label string")
    spans = sequence.group_words(rows)
    assert [(r["category"], r["span"]) for r in spans.orderBy("ord").collect()] == [("technicalskill", ".NET"), ("technicalskill", "Spring Boot"), ("tools", "Git /"), ("tools", "git"), ("tools", "y")]
    assert [r["span"] for r in sequence.clean_spans(spans).orderBy("ord").collect()] == [".NET", "Spring Boot", "Git", "y"]


def test_align_and_argmax(spark):
    row = spark.range(1).select(sequence.align_labels(F.array(F.lit(1), F.lit(2), F.lit(3)), F.array(F.lit(2), F.lit(0), F.lit(1)), 6).alias("a"), sequence.argmax(F.array(F.lit(1.0), F.lit(3.0), F.lit(3.0))).alias("m")).first()
    assert row["a"] == [-100, 1, -100, 3, -100, -100] and row["m"] == 1


def test_conll(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("﻿Python B-TECHNICALSKILL\r\ndev O\r\n\r\n5 B-YEAROFEXPERIENCE\ryears I-YEAROFEXPERIENCE".encode())
    got = conll.load_conll(spark, f"file:{tmp_path}/a.txt").orderBy("sample").collect()
    assert [(r["words"], r["labels"]) for r in got] == [(["Python", "dev"], [1, 0]), (["5", "years"], [9, 10])]
    (tmp_path / "b.txt").write_text("x B-BOGUSTAG\none\na b c\n​\n﻿ok­ B-TOOLS\nz‌w O\n")
    path = f"file:{tmp_path}/b.txt"
    with pytest.raises(Exception, match="unknown_tag"):
        conll.load_conll(spark, path).collect()
    lenient = conll.load_conll(spark, path, strict=False).orderBy("sample").collect()
    assert [(r["words"], r["labels"]) for r in lenient] == [(["x"], [0]), (["ok", "z‌w"], [7, 0])]
    found = conll.diagnostics(conll.read_lines(spark, path))
    assert {(r["line_no"], r["kind"]) for r in found.collect()} == {(1, "unknown_tag"), (2, "malformed"), (3, "malformed"), (4, "edge"), (5, "edge"), (6, "interior")}
    assert {r["kind"]: r["n"] for r in conll.summary(found).collect()} == {"unknown_tag": 1, "malformed": 2, "edge": 2, "interior": 1}
    (tmp_path / "c.txt").write_bytes(b"caf\xe9 O\n")
    with pytest.raises(Exception, match="UTF-8"):
        conll.load_conll(spark, f"file:{tmp_path}/c.txt").collect()
    (tmp_path / "d.txt").write_bytes(b"")
    assert conll.load_conll(spark, f"file:{tmp_path}/d.txt").count() == 0


def test_conll_files_round_trip(spark, tmp_path):
    made = datagen.generate(spark, 40)
    conll.write_conll(made, f"file:{tmp_path}/out")
    back = conll.load_conll(spark, f"file:{tmp_path}/out/*.txt")
    key = lambda df: sorted((tuple(r["words"]), tuple(r["labels"])) for r in df.select("words", "labels").collect())
    assert key(back) == key(made)


def test_conll_in_many_splits(spark, tmp_path):
    """Byte ranges of a few bytes cut lines and samples everywhere, and numbers of lines and samples stay those of the file."""
    draw = random.Random(4)
    ends = ["\n", "\r\n", "\r"]
    parts = [draw.choice(["w\u00e9%d O", "x%d B-TOOLS", "y%d I-TOOLS", "", "  ", "z%d\u00ad O"]) for _ in range(400)]
    lines = [p % i if "%d" in p else p for i, p in enumerate(parts)]
    # a lone line end after a carriage return would join it
    text = "\ufeff" + "".join(x + draw.choice(ends if i + 1 == len(lines) or lines[i + 1] else ends[:2]) for i, x in enumerate(lines))
    (tmp_path / "big.txt").write_bytes(text.encode())
    (tmp_path / "two.txt").write_bytes(b"a O\n\nb B-TOOLS")
    want, sample = {}, 0
    for x in lines:
        if not x.strip():
            sample += 1
        else:
            word, tag = x.replace("\u00ad", "").split()
            want.setdefault(sample, []).append((word, C.LABELS.index(tag)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        path = f"file:{tmp_path}/*.txt"
        assert conll.split_lines(spark, path).rdd.getNumPartitions() > 50
        found, counts = conll.parse(spark, path)
        rows = conll.group_samples(found, "at").collect()
        numbered = conll.read_lines(spark, path).filter("path like '%big.txt'").orderBy("line_no").collect()
        lazy = conll.samples_of(conll.read_lines(spark, path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    big = {r["sample"]: list(zip(r["words"], r["labels"])) for r in rows if r["path"].endswith("big.txt")}
    assert big == want and [r["words"] for r in rows if r["path"].endswith("two.txt")] in ([["a"], ["b"]], [["b"], ["a"]])
    assert [r["line_no"] for r in numbered] == list(range(1, len(lines) + 1))
    key = lambda made: sorted((r["path"], r["sample"], r["words"], r["labels"]) for r in made)
    assert key(lazy) == key(rows)
    assert counts["words"] == sum(map(len, want.values())) + 2 and counts["edge_lines"] >= sum("\u00ad" in x for x in lines)
    assert conll.verdict(counts) is None


def test_conll_counters_and_verdicts(spark, tmp_path):
    def of(data):
        path = tmp_path / f"{abs(hash(data))}.txt"
        path.write_bytes(data.encode())
        return conll.parse(spark, f"file:{path}", strict=False)[1]

    found = of("a O x\nb\u00adc B-HOBBY\n\u200bd O\ne\u200df O\n\ng B-TOOLS\n")
    assert found == {"lines": 6, "edge_lines": 1, "malformed_lines": 1, "interior_fields": 2, "unknown_tags": 1, "words": 4, "entity_words": 1}
    assert conll.verdict(of("a O\nb O\n")) == "all_o" and conll.verdict(of("a\nb c d\n")) == "all_malformed"
    assert conll.verdict(of("\n \n")) == "empty" and conll.verdict(of("")) == "empty"
    (tmp_path / "bad.txt").write_text("a O\n\nb O\nc B-HOBBY\nd\n")
    with pytest.raises(ValueError, match="bad.txt:4: unknown_tag in line c B-HOBBY"):
        conll.load_conll(spark, f"file:{tmp_path}/bad.txt")


def test_text_sources(spark, tmp_path):
    (tmp_path / "a").write_text("hé\n")
    assert texts.read_texts(spark, f"file:{tmp_path}/a").first()["text"] == "hé\n"
    rows = spark.createDataFrame([("x", None, "d"), (None, "f", "d"), (None, None, "d"), (" ", "f", "d"), (None, "", "d")], "i string, f string, d string")
    got = [tuple(r[0]) for r in rows.select(texts.resolve(F.col("i"), F.col("f"), F.col("d"))).collect()]
    assert got == [("x", None), ("f", None), ("d", None), (None, "supplied but empty"), (None, "file is empty")]


def test_samples_hold_their_rules(spark):
    made = datagen.generate(spark, 300).collect()
    assert sorted(r["id"] for r in made) == list(range(300)) and all(len(r["words"]) == len(r["labels"]) for r in made)
    for r in made:
        names = [C.LABELS[i] for i in r["labels"]]
        assert all(b[0] != "I" or a[2:] == b[2:] for a, b in zip(["O", *names], names))


def test_metrics(spark):
    schema = "doc_key int, pos int, label string"
    gold = spark.createDataFrame([(1, 0, "B-TOOLS"), (1, 1, "I-TOOLS"), (1, 2, "O"), (1, 3, "B-SOFTSKILL"), (2, 0, "B-TOOLS")], schema)
    guess = spark.createDataFrame([(1, 0, "B-TOOLS"), (1, 1, "I-TOOLS"), (1, 2, "B-TOOLS"), (1, 3, "O"), (2, 0, "B-TOOLS")], schema)
    row = metrics.entity_scores(gold, guess).first()
    assert (row["precision"], row["recall"]) == (pytest.approx(2 / 3), pytest.approx(2 / 3))
    report = {r["name"]: r for r in metrics.entity_report(gold, guess).collect()}
    assert report["softskill"]["f1"] == 0 and report["tools"]["recall"] == 1 and report["weighted avg"]["support"] == 3
    both = metrics.entity_report(gold, guess)
    plan = both._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Window") <= 8 and plan.count("Expand") >= 1
    assert {r["name"]: r["support"] for r in metrics.entity_report(gold.limit(0), guess.limit(0)).collect()} == {"micro avg": 0, "macro avg": 0, "weighted avg": 0}
    none = metrics.entity_scores(gold.limit(0), guess.limit(0)).first()
    assert none["f1"] == 0
    samples = spark.createDataFrame([([0, 0, 0, 1],)], "labels array<int>")
    weights = {r["label_id"]: r["weight"] for r in metrics.class_weights(samples).collect()}
    assert weights[0] == pytest.approx(4 / 6) and weights[1] == 2 and weights[5] == 1 and len(weights) == 13
    split = metrics.sequential_split(spark.range(25).repartition(5), "id").orderBy("id").collect()
    assert [r["part"] for r in split] == ["train"] * 20 + ["validation"] * 2 + ["test"] * 3
    with pytest.raises(ValueError):
        metrics.sequential_split(spark.range(3), "id", 0.9, 0.2)


def test_classifier_learns(spark, tmp_path):
    made = datagen.generate(spark, 150).withColumnRenamed("id", "doc_key")
    model, history = labellers.train_token_classifier(made, grid=(0.001,), features=1 << 11, stride=4, most_steps=12)
    # the best step is not the last one: three more were tried and gave nothing better
    scores = [f1 for *_, f1 in history]
    best = scores.index(max(scores))
    assert scores[best] > 0.6 and (best == len(scores) - 4 or len(scores) == 12) and best < len(scores) - 1
    assert model.stages[-1].getMaxIter() == history[best][1]
    labellers.save_classifier(model, f"file:{tmp_path}/m")
    label = labellers.classifier_labeller(labellers.load_classifier(f"file:{tmp_path}/m"))
    found = label(made.select("doc_key", F.array_join("words", " ").alias("text")))
    truth = made.select("doc_key", F.posexplode("labels").alias("pos", "l"))
    names = F.array(*map(F.lit, C.LABELS))
    joined = found.join(truth, ["doc_key", "pos"]).select((F.col("label") == F.get(names, F.col("l"))).cast("int").alias("ok"))
    assert joined.agg(F.avg("ok")).first()[0] > 0.9


def test_classifier_learns_from_all_samples(spark):
    """A word that only samples late in the order of the keys' hashes have is known; 20,000 were read at most."""
    late = F.row_number().over(Window.orderBy(F.xxhash64(F.col("id").cast("string")), "id")) > 20_050
    rows = spark.range(21_000).select(F.col("id").alias("doc_key"), late.alias("late"))
    label = F.when(F.col("late"), C.LABELS.index("B-TOOLS")).otherwise(0)
    samples = rows.select("doc_key", F.array(F.lit("uses"), F.when(F.col("late"), "Kafka").otherwise("paper")).alias("words"), F.array(F.lit(0), label).alias("labels"))
    model, _ = labellers.train_token_classifier(samples, grid=(0.001,), features=1 << 8, most_steps=2)
    told = labellers.classifier_labeller(model)(spark.createDataFrame([(1, "uses Kafka"), (2, "uses paper")], "doc_key long, text string"))
    assert sorted((r["doc_key"], r["word"], r["label"]) for r in told.collect()) == [(1, "Kafka", "B-TOOLS"), (1, "uses", "O"), (2, "paper", "O"), (2, "uses", "O")]
