import pytest
from pyspark.sql import functions as F

from gapline.functions import sql
from gapline.functions import text as T
from gapline.functions import years as Y
from gapline.operators import lexicon

SPANS = [
    None, "", " ", "C++ 11", "a.w.s", "K8s and Docker", "Python, REST APIs", "machine learning engineers", "R", "r&d in R", "go Golang", "CI/CD pipelines", "strong Java script",
    "Master of Science", "B.Sc. or PhD", "5 years", "2 years 6 months", "18 months", "3-5 years", "1,5 years", "1,200 months", "five to ten years", "2nd year, 4 years", "0 years", "99 years",
    "October 2018 to Present", "grade 10", "-3 years", "good standing", "C# it's \"q\"", "x\n\tSQL\x85Python", "données 漢字", "Python " * 300,
]


@pytest.fixture(scope="module")
def rows(spark):
    sql.register(spark)
    frame = spark.createDataFrame([(i, s) for i, s in enumerate(SPANS)], "n int, span string")
    frame.createOrReplaceTempView("sql_spans")
    yield frame
    spark.catalog.dropTempView("sql_spans")


@pytest.mark.parametrize(
    "name, column",
    [
        ("tokens", T.tokenize), ("collapse", T.collapse_whitespace), ("visible", T.visible_text), ("normalize", T.normalize), ("canonical", T.canonical),
        ("is_generic", T.is_generic), ("years", Y.parse_years), ("degree", Y.degree_level),
    ],
)
def test_functions_give_what_the_columns_give(spark, rows, name, column):
    got = spark.sql(f"SELECT n, gapline_{name}(span) AS x FROM sql_spans ORDER BY n").collect()
    assert [r.x for r in got] == [r.x for r in rows.select("n", column(F.col("span")).alias("x")).orderBy("n").collect()]


def test_recognise(spark, rows):
    got = spark.sql("SELECT n, i, k, term FROM sql_spans, LATERAL gapline_recognise(span)").collect()
    expected = lexicon.named_windows(rows.filter("span is not null"), "n", lexicon.readable_words(F.col("span"))).select("n", F.inline("hits")).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, expected)) and len(got) > 300
    terms = {r.n: r.t for r in spark.sql("SELECT n, gapline_terms(span) AS t FROM sql_spans").collect()}
    assert terms == {n: None if span is None else sorted({r.term for r in got if r.n == n}) for n, span in enumerate(SPANS)}


def test_no_python_and_no_join(spark, rows):
    plan = spark.sql("SELECT n, gapline_canonical(span), term FROM sql_spans, LATERAL gapline_recognise(span)")._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and "Join" not in plan
