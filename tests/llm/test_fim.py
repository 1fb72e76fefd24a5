import hashlib
import re

from pyspark.sql import functions as F

from gapline.llm import fim


def plainly(doc_id, text):
    """Form, output and cuts by the definition, over code points."""
    text = text or ""
    units = re.findall(r"[ \t-\r]*[^ \t-\r]+|[ \t-\r]+", text)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", text, None, None
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 80:
        return n, "spm", f"<S>{s}<P>{p}<M>{m}", len(p), len(m)
    return n, "psm", f"<P>{p}<S>{s}<M>{m}", len(p), len(m)


TEXTS = [
    "one two  three", "", None, " ", "\t\n a \r", "<P", "P> <S> x", "a<M>b", "<" * 50, "<<P <S <M P> S> M> > <", "x", "😀 𝒳y z é  b",
    "word " * 20_000, "y" * 300_000, "a\x1fb \x0bc\x0c", "<P ><S ><M", "S> M> P>", ">",
]


def test_against_brute_force(spark):
    rows = [(i, TEXTS[i % len(TEXTS)], i) for i in range(20 * len(TEXTS))] + [(None, "a b c d", 1), (3, "same", 2), (3, "same", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int").withColumn("form", F.lit("other"))
    made = fim.fill_in_middle(docs)
    assert made.columns == ["doc_id", "text", "n", "form", "output", "prefix_chars", "middle_chars"]
    got = made.withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    assert len(got) == len(rows) and {r["form"] for r in got} == {"plain", "psm", "spm"}
    for r in got:
        assert (r["n"], r["form"], r["output"], r["prefix_chars"], r["middle_chars"]) == plainly(r["doc_id"], r["text"])
        assert r["back"] == (r["text"] or "")


def test_shares_and_seed(spark):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("a b c d e f").alias("text"))
    forms = lambda **k: [r["form"] for r in fim.fill_in_middle(docs, **k).collect()]
    assert set(forms(share=100, spm_share=100)) == {"spm"} and set(forms(share=100, spm_share=0)) == {"psm"} and set(forms(share=0)) == {"plain"}
    assert forms() != forms(seed=1) and 120 < sum(f != "plain" for f in forms()) < 280


def test_empty_table_and_plan(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    made = fim.fill_in_middle(none)
    assert made.count() == 0
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan
