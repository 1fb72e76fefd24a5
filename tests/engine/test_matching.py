import pytest
from pyspark.sql import functions as F

from gapline.operators import compose, gate, matching
from gapline.plans import analysis

SPANS = "doc_key string, category string, ord int, span string"


def rows(key, **categories):
    return [(key, c, i * 100 + j, s) for i, (c, spans) in enumerate(categories.items()) for j, s in enumerate(spans)]


@pytest.fixture(scope="module")
def compare(spark):
    """Gaps by category and notes of many pairs at once."""

    def run(cases):
        jd = spark.createDataFrame([r for i, (j, _) in enumerate(cases) for r in rows(f"j{i}", **j)], SPANS)
        resume = spark.createDataFrame([r for i, (_, c) in enumerate(cases) for r in rows(f"r{i}", **c)], SPANS)
        pairs = spark.createDataFrame([(i, f"j{i}", f"r{i}") for i in range(len(cases))], "pair_id long, jd_key string, resume_key string")
        gaps, notes = [{} for _ in cases], [""] * len(cases)
        for r in sorted(matching.find_missing(pairs, jd, resume).collect(), key=lambda r: r["ord"]):
            gaps[r["pair_id"]].setdefault(r["category"], []).append(r["span"])
        for r in matching.find_notes(pairs, jd, resume).collect():
            notes[r["pair_id"]] = " / ".join(r["notes"])
        return gaps, notes

    return run


def test_gaps_and_notes(compare):
    t = lambda *s, **k: {"technicalskill": s} | k
    cases = [
        (t("Python", "PyTorch", tools=["Docker"]), t("Python", "PyTorch", tools=["Docker"])),
        (t("Python", "PyTorch", tools=["Kubernetes"]), t("Python", tools=["Docker"])),
        ({"tools": ["PyTorch"]}, t("PyTorch")),
        ({"tools": ["AWS"], "technicalskill": ["Python"]}, t("Amazon Web Services", "Python")),
        (t("Python", yearofexperience=["5 years"]), t("Python", yearofexperience=["3 years"])),
        (t("Python", yearofexperience=["5 years"]), t("Python", yearofexperience=["6 years"])),
        (t("Python", designation=["Senior Engineer"]), t("Python")),
        (t("plus", "related field", "Python"), t("Python")),
        (t("Frobnicator", "Python"), t("Python")),
        ({}, {}),
        (t("Python", yearofexperience=["5 years"]), t("Python", yearofexperience=["October 2018 to Present"])),
        (t("Docker", "docker and Python", "Python", tools=["Docker"]), t("Go")),
        ({"qualification": ["PhD in Physics", "Doctorate", "MSc", "good standing"]}, {"qualification": ["Bachelors"], "other": ["Python"]}),
        ({"qualification": ["MBA"]}, t("Python")),
        (t("R&D", "go to market"), {"other": ["R"]}),
        ({"technicalskill": [None, ""]}, {"technicalskill": [None]}),
        ({"yearofexperience": ["years"]}, {}),
        ({"yearofexperience": ["4 years", "6 years"]}, {"yearofexperience": ["years", "3"]}),
    ]
    gaps, notes = compare(cases)
    assert gaps[0] == {} and notes[0] == ""
    assert gaps[1] == {"technicalskill": ["PyTorch"], "tools": ["Kubernetes"]}
    assert gaps[2] == gaps[3] == gaps[5] == gaps[6] == gaps[7] == gaps[8] == gaps[9] == gaps[10] == gaps[13] == gaps[15] == gaps[16] == {}
    assert gaps[4] == {"yearofexperience": ["5 years"]}
    assert "Frobnicator" in notes[8] and "October 2018 to Present" in notes[10] and "MBA" in notes[13] and "'years'" in notes[16] and not notes[7]
    assert gaps[11] == {"technicalskill": ["Docker", "docker and Python"], "tools": ["Docker"]}
    assert gaps[12] == {"qualification": ["PhD in Physics", "MSc"]} and "good standing" in notes[12]
    assert gaps[14] == {"technicalskill": ["go to market"]}
    assert gaps[17] == {"yearofexperience": ["4 years", "6 years"]}


def test_gate(spark):
    text = "plain English words that anybody can read, " * 10
    spans = spark.createDataFrame(rows("rich", technicalskill=["Python", "Java"], tools=["Docker"]) + rows("title", designation=["Python Developer"]) + rows("some", technicalskill=["Python"], tools=["Git"]), SPANS)
    docs = spark.createDataFrame(
        [("rich", None), ("title", None), ("some", None), ("none", None), ("read", text), ("thin", "Jane Doe, Street 7"), ("blank", "  "), ("cjk", "漢字 " * 60), ("marks", "--- ***")],
        "doc_key string, text string",
    )
    cases = {("none", "none"): True, ("rich", "some"): False, ("title", "some"): True, ("rich", "none"): True, ("rich", "read"): False, ("rich", "thin"): True, ("rich", "blank"): True, ("rich", "cjk"): True, ("rich", "marks"): True}
    pairs = spark.createDataFrame([(i, *k) for i, k in enumerate(cases)], "pair_id int, jd_key string, resume_key string")
    got = {(r["jd_key"], r["resume_key"]): r["problem"] for r in gate.gate(pairs, docs, spans, docs, spans).collect()}
    assert {k: v is not None for k, v in got.items()} == cases
    assert got["rich", "blank"] == "The resume was empty. Please paste the text and try again."
    assert "only 3 words" in got["rich", "thin"] and "0 ordinary words among 60 chunks" in got["rich", "cjk"]
    result = analysis.analyze_spans(pairs, docs, spans, docs, spans).collect()
    assert all((r["missing"] is None) == (r["notes"] is None) == (r["problem"] is not None) for r in result)
    status = {r["pair_id"]: r["status"] for r in analysis.respond(pairs.filter("pair_id < 3"), spans, spans).collect()}
    assert status == {0: 422, 1: 200, 2: 422}
    assert {r["status"] for r in analysis.respond(pairs, spans, spans, ready=False).collect()} == {503}


def test_texts(spark):
    items = spark.createDataFrame([(1, "tools", 5, "Docker"), (1, "technicalskill", 1, "Go"), (1, "tools", 2, "Git")], "pair_id int, category string, ord int, span string")
    row = compose.grouped(items, "pair_id")
    mail, prompt = row.select(compose.feedback_mail(row["items"], role=None), compose.gap_prompt(row["items"])).first()
    assert "  • Technical skills: Go\n  • Tools & platforms: Git, Docker\n\n" in mail and mail.endswith("\nSam\nAcme Corp Recruiting Team")
    assert prompt.startswith("Missing skills / qualifications:\nTechnicalskill:\n- Go\nTools:\n- Git\n- Docker\n\nWrite a concise")
    from pyspark.sql import functions as F

    blank = row.select(compose.feedback_mail(F.lit(None).cast(row.schema["items"].dataType), company=F.lit(""), role=F.lit("Dev"))).first()[0]
    assert "the Dev position at Acme Corp." in blank and "did not identify any specific gaps" in blank
    notes = F.array(F.lit("n1"))
    report = row.select(compose.entities_block("JD", row["items"]), compose.gaps_block(F.lit(None).cast(row.schema["items"].dataType), notes), compose.notes_block(notes)).first()
    assert report[0] == "=== JD ===\n  Technical Skills:\n    - Go\n  Tools:\n    - Git\n    - Docker" and "not every requirement" in report[1] and "\n  - n1\n" in report[2]


def test_whole_texts(spark):
    docs = spark.createDataFrame(
        [
            ("j", "We are hiring a Senior Software Engineer with 5 years of experience in Python, PyTorch and K8s.\nMaster of Science in Computer Science preferred."),
            ("r", "Data Scientist, 6 years, Python and Kubernetes, torch. PhD in Physics."),
            ("long", "nothing here " * 1300 + "Python and PyTorch"),
            ("dot", "Knows .NET. Git too"),
            ("empty", None),
        ],
        "doc_key string, text string",
    )
    spans = analysis.extract_spans(docs)
    assert {r["span"] for r in spans.filter("doc_key = 'long'").collect()} == {"Python", "PyTorch"}
    assert {r["span"] for r in spans.filter("doc_key = 'dot'").collect()} == {".NET", "Git"}
    pairs = spark.createDataFrame([(1, "j", "r"), (2, "r", "j"), (3, "j", "empty")], "pair_id long, jd_key string, resume_key string")
    result = {r["pair_id"]: r for r in analysis.write_feedback(analysis.analyze(pairs, docs)).collect()}
    assert result[1]["missing"] == [] and result[1]["problem"] is None
    assert {x["span"] for x in result[2]["missing"]} == {"PhD in Physics", "6 years"} and "PhD in Physics" in result[2]["feedback"]
    assert result[3]["problem"] and result[3]["feedback"] is None and result[3]["missing"] is None
    assert '"missing":null' in analysis.to_json(analysis.analyze(pairs, docs)).filter("pair_id = 3").first()["json"]


def test_popular_keys_are_split(spark, monkeypatch):
    """A posting for which very many applied is joined under several salts, and nothing is lost or doubled."""
    monkeypatch.setattr(matching, "POPULAR", 50)
    jd = spark.createDataFrame([(1, "tools", 0, "Docker"), (1, "technicalskill", 1, "Python"), (2, "tools", 0, "Git")], "doc_key int, category string, ord int, span string")
    resume = spark.createDataFrame([(k, "tools", 0, "Docker" if k % 2 else "Jira") for k in range(400)], "doc_key int, category string, ord int, span string")
    pairs = spark.range(400).select(F.col("id").alias("pair_id"), F.when(F.col("id") < 390, 1).otherwise(2).alias("jd_key"), F.col("id").cast("int").alias("resume_key"))
    assert [tuple(r) for r in matching.popular_keys(pairs).collect()] == [("jd_key", "1", 8)]
    got = {(r["pair_id"], r["span"]) for r in matching.find_missing(pairs, jd, resume).collect()}
    assert got == {(i, "Python") for i in range(390)} | {(i, "Docker") for i in range(0, 390, 2)} | {(i, "Git") for i in range(390, 400)}
