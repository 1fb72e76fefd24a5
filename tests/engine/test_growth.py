"""Plans whose tables grow far beyond what the planner takes them for."""

import random

import numpy as np
from pyspark.sql import functions as F

from gapline.functions import text as T
from gapline.operators import lexicon, sequence
from gapline.plans import analysis
from gapline.plans.labellers import labelled_samples, lexicon_labeller, windowed
from gapline.plans.queries import QUERIES
from gapline.sources import conll


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exploded(spark):
    """Windows and labels of 50 documents, made by explosion: the planner's sizes are those of 50 rows."""
    win = spark.range(50).select(F.col("id").alias("doc_key"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("win"))
    win = win.select("doc_key", "win", (F.col("win") * 40).alias("start"), (F.col("win") * 40 + 55).alias("end"))
    pos = win.withColumn("pos", F.explode(F.sequence("start", F.col("end") - 1))).filter((F.col("pos") * 7 + F.col("win") + F.col("doc_key")) % 3 > 0)
    return win, pos.select("doc_key", "win", "pos", F.lit("B-TOOLS").alias("label"))


def test_labels_never_reach_the_driver(spark):
    win, labels = exploded(spark)
    assert "Broadcast" not in plan_of(sequence.seams(win, labels))
    assert "Broadcast" not in plan_of(sequence.merge_labels(win, labels))
    merged = sequence.merge_labels(win, labels).collect()
    assert len({(r["doc_key"], r["pos"]) for r in merged}) == len(merged) and {r["doc_key"] for r in merged} == set(range(50))


def test_labelled_words_never_reach_the_driver(spark):
    """What is broadcast is the vocabulary and its written forms: no join with words or their labels."""
    docs = spark.createDataFrame([(i, "Senior .NET dev; machine learning, pythons (AWS) and a.w.s; C") for i in range(20)], "doc_key long, text string")
    found = lexicon_labeller(docs)
    wide = [x for x in plan_of(windowed(lexicon_labeller, 8)(docs)).splitlines() if "BroadcastHashJoin" in x and "pos" in x]
    assert not wide and not [x for x in plan_of(found).splitlines() if "BroadcastHashJoin" in x and ("pos" in x or "doc_key" in x)]
    rows = sorted((r["pos"], r["word"], r["label"]) for r in found.filter("doc_key = 7").collect())
    assert [p for p, *_ in rows] == list(range(len(rows)))  # each word once
    labels = {w: label for _, w, label in rows}
    assert (labels["Senior"], labels["."], labels["NET"], labels["dev"]) == ("O", "B-TECHNICALSKILL", "I-TECHNICALSKILL", "O")
    assert all(labels[w] != "O" for w in ("machine", "learning", "pythons", "AWS", "a.w.s"))


def test_plain_words_have_the_same_key(spark):
    """The short way of `canonical` gives what lists and look-ups give: a blank more sends a word the long way."""
    words = ["python", "Pythons", "ML", "k8s", "aws", "c++", "c#", "boxes", "libraries", "js", "gas", "class", "x1s", "a.w.s", "node.js", "", "python\n", "İs"]
    rows = spark.createDataFrame([(w,) for w in words], "w string")
    got = rows.select("w", T.canonical(F.col("w")).alias("a"), T.canonical(F.concat(F.lit(" "), "w")).alias("b")).collect()
    assert [(r["w"], r["a"]) for r in got] == [(r["w"], r["b"]) for r in got]


def test_facts_are_worked_out_once_for_each_distinct_span(spark):
    """Years and ranks of spans stand below the join that brings them to the documents, over distinct spans; null spans and
    categories keep their places."""
    from gapline.operators import matching

    spans = spark.createDataFrame([(i, "yearofexperience", i, "5 years") for i in range(4)] + [(9, None, 2, "Python"), (9, "tools", 1, None)], "doc_key long, category string, ord int, span string")
    found = matching.profiles(spans, matching.recognised_in(spans))
    plan = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    join = next(depth(x) for x in plan if "Join LeftOuter" in x and "<=>" in x)
    assert all(depth(x) > join for x in plan if "bachelor" in x or "months" in x)
    got = {r["doc_key"]: r["items"] for r in found.collect()}
    assert [x["years"] for x in got[3]] == [5.0] and [(x["category"], x["span"], list(x["terms"])) for x in got[9]] == [("tools", None, []), (None, "Python", ["python"])]


def test_aligned_labels_build_no_more_than_shows(spark):
    """A word of more subwords than an array may have places, and many words after it."""
    made = spark.range(1).select(sequence.align_labels(F.sequence(F.lit(1), F.lit(3)), F.array(F.lit(0), F.lit(2), F.lit(2147483640)), 8).alias("a")).first()
    assert made["a"] == [-100, 2, -100, 3, -100, -100, -100, -100]


def test_lines_of_files_are_never_dealt_or_sorted(spark, tmp_path):
    """What is stored and grouped is parts of samples and not lines, however a batch cuts them."""
    lines = "".join(f"w{i} O\n" + "\n" * (i % 40 == 0) for i in range(2000))
    (tmp_path / "a.txt").write_text(lines + "\n \nlast B-TOOLS")
    stored, counts = conll.parse(spark, f"file:{tmp_path}/a.txt")
    want = conll.group_samples(stored, "at").collect()
    assert counts["words"] == 2001 and stored.count() < 100 and len(want) == 52 and max(r["sample"] for r in want) == 52
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = conll.load_conll(spark, f"file:{tmp_path}/a.txt").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    key = lambda rows: sorted((r["sample"], r["words"], r["labels"]) for r in rows)
    assert key(got) == key(want) and [w for r in sorted(want, key=lambda r: r["sample"]) for w in r["words"]] == [*(f"w{i}" for i in range(2000)), "last"]


def test_samples_of_turns_with_the_same_number(spark, tmp_path):
    """Turns 0:100 and 1:0 have one number, and a turn may have none; each is a sample of its own."""
    turns = [(0, 100, "One two."), (1, 0, "Three four five"), (None, 3, "six"), (2, None, "seven"), (3, 1, " "), (3, 2, None)]
    spark.createDataFrame(turns, "conv_id long, turn int, text string").write.parquet(f"file:{tmp_path}/conversations.parquet")
    for name in ("conll_round_trip", "conll_files"):
        found = QUERIES[name](spark, f"file:{tmp_path}").collect()
        assert sorted((r["n_words"], r["n_samples"]) for r in found) == [(1, 1), (1, 1), (3, 1), (3, 1)], name


def test_what_tasks_do_with_one_text_is_what_rows_give(spark):
    """Words, lengths, owners of words in windows, and spans: each helper against its operator on rows."""
    draw = random.Random(5)
    pieces = ["Python", ".NET", "x.y", "C++", ";", "(", ".", "..", " ", "\u2003", "\n", "\u00ad", "\u200b", "é", "漢", "²", "½", "a-b", "K", "İ", "don't", "\U0001f600", "python", "Σ"]
    texts = ["".join(draw.choice(pieces) + draw.choice(["", " "]) for _ in range(draw.randrange(60))) for _ in range(120)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_key long, text string")
    made = {i: sequence.words_of(t) for i, t in enumerate(texts)}
    rows = [(i, p, w, g) for i, (words, glued) in made.items() for p, (w, g) in enumerate(zip(words, glued))]
    assert sorted(map(tuple, sequence.tokens(docs).collect())) == rows and any(g for *_, g in rows)
    lengths = docs.select("doc_key", sequence.subword_lengths(T.tokenize(F.col("text")))).collect()
    assert {k: n for k, n in lengths} == {i: [sequence.subwords(w) for w in words] for i, (words, _) in made.items()}
    kinds = ["O", "O", "B-TOOLS", "I-TOOLS", "I-TOOLS", "B-SOFTSKILL", "I-SOFTSKILL"]
    said = {i: [draw.choice(kinds) for _ in words] for i, (words, _) in made.items()}
    spans = sequence.clean_spans(sequence.group_words(spark.createDataFrame([(*r, said[r[0]][r[1]]) for r in rows], "doc_key long, pos int, word string, glued boolean, label string")))
    want = sorted((i, *s) for i, (words, glued) in made.items() for s in sequence.spans_of(words, glued, said[i]))
    assert sorted((r["doc_key"], r["category"], r["ord"], r["span"]) for r in spans.collect()) == want and len(want) > 300
    plans = {i: sequence._plan(np.array([sequence.subwords(w) for w in words], np.int64), 9, 8) for i, (words, _) in made.items()}
    by_window = {i: [[draw.choice(kinds) for _ in range(w["start"], w["end"])] for w in plan] for i, plan in plans.items()}
    windows = spark.createDataFrame([(i, j, w["start"], w["end"]) for i, plan in plans.items() for j, w in enumerate(plan)], "doc_key long, win int, start int, end int")
    labels = [(i, j, plans[i][j]["start"] + p, x) for i, parts in by_window.items() for j, part in enumerate(parts) for p, x in enumerate(part)]
    merged = sequence.merge_labels(windows, spark.createDataFrame(labels, "doc_key long, win int, pos int, label string")).collect()
    assert sorted(map(tuple, merged)) == sorted((i, p, x) for i, plan in plans.items() for p, x in enumerate(sequence.merged(plan, by_window[i])) if x != "O")
    assert all(len(sequence.merged(plan, by_window[i])) == len(made[i][0]) for i, plan in plans.items())


def test_no_word_becomes_a_row(spark):
    """Spans of texts come from one step a document, window by window or not; and texts of rows give the same."""
    docs = spark.createDataFrame([(i, "Senior dev of Python .NET; machine learning, pythons (AWS), a.w.s. C and Docker " * (i % 3)) for i in range(12)] + [(99, None)], "doc_key long, text string")
    rows_only = lambda labeller: lambda d: labeller(d)
    for labeller in (lexicon_labeller, windowed(lexicon_labeller, 8)):
        found = analysis.extract_spans(docs, labeller)
        assert "Exchange" not in plan_of(found) and "pos" not in plan_of(found)
        got = sorted(map(tuple, found.collect()))
        assert got == sorted(map(tuple, analysis.extract_spans(docs, rows_only(labeller)).collect()))
        assert len(got) > 20 and (labeller is not lexicon_labeller or (1, "technicalskill", 4, ".NET") in got)
    samples = labelled_samples(docs).collect()
    assert sorted(map(str, samples)) == sorted(map(str, labelled_samples(docs, rows_only(lexicon_labeller)).collect()))


def test_only_distinct_spans_are_scanned(spark):
    spans = spark.createDataFrame([(1, "Python"), (2, "Python"), (3, None), (4, "none")], "k int, span string")
    found = lexicon.recognised_in(spans, spans)
    lines = plan_of(found).splitlines()
    assert sum("ArrowEvalPython" in x for x in lines) == 1
    assert next(i for i, x in enumerate(lines) if "ArrowEvalPython" in x) < next(i for i, x in enumerate(lines) if "Aggregate" in x)
    assert [(r["span"], r["terms"]) for r in found.collect()] == [("Python", ["python"])]


def test_texts_of_an_analysis_are_made_once(spark):
    """Labeller and both sides' gates read one table of the texts; the result is that of two sides apart."""
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def text(t):
        made.add(1)
        return t

    rows = [("j", "Senior Software Engineer with 5 years of Python, PyTorch and K8s."), ("r", "Data Scientist, 6 years, Python and Kubernetes, torch."), ("x", "<#/@> x9$ " * 9), ("n", None)]
    plain = spark.createDataFrame(rows, "doc_key string, text string")
    docs = plain.select("doc_key", text("text").alias("text"))
    pairs = spark.createDataFrame([(i * 5 + k, a, b) for i, a in enumerate("jrxng") for k, b in enumerate("jrxng")], "pair_id long, jd_key string, resume_key string")
    got = sorted(map(str, analysis.analyze(pairs, docs).collect()))
    assert made.value == len(rows)
    spans = analysis.extract_spans(plain)
    assert got == sorted(map(str, analysis.analyze_spans(pairs, plain, spans, plain, spans).collect())) and len(got) == 25
