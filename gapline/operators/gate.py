"""The confidence gate: may a pair be compared at all? A refusal is a reason; null lets the pair through.

Inputs are documents (doc_key, text; the text may be null: not supplied) and their spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapline import constants as C
from gapline.functions import text as T
from gapline.operators.lexicon import recognised_in, span_terms

FINDING = "struct<reason:string,hint:string>"


def finding(reason: Column, hint: str) -> Column:
    return F.struct(reason.alias("reason"), F.lit(hint).alias("hint"))


def counts(text: Column) -> Column:
    """struct(words, chunks): ordinary words, and chunks that hold a letter or digit."""
    count = lambda t: F.struct(F.regexp_count(t, F.lit(T.WORD_CHUNK)).alias("words"), F.regexp_count(t, F.lit(T.READABLE_CHUNK)).alias("chunks"))
    return T.bind(T.narrow(text), count)


def unreadable(text: Column, side: str, counted: Column) -> Column:
    """Why a text cannot be read, or null; null for a text that was not supplied. counted: what `counts` gives."""
    words, chunks = counted["words"], counted["chunks"]
    a, b, c, d = C.UNREADABLE
    garbled = F.concat(F.lit(a + side + b), words.cast("string"), F.lit(c), chunks.cast("string"), F.lit(d))
    return (
        F.when(text.isNull(), F.lit(None).cast(FINDING))
        .when(T.is_blank(text), finding(F.lit(C.EMPTY_TEXT[0] + side + C.EMPTY_TEXT[1]), C.HINT_EMPTY))
        .when((chunks > 0) & (words >= chunks * C.PROSE_RATIO), F.lit(None).cast(FINDING))
        .otherwise(finding(garbled, C.HINT_UNREADABLE))
    )


def recognised_counts(spans: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """(doc_key, n_terms): distinct best terms of the spans that are compared."""
    rows = span_terms(spans.filter(F.col("category").isin(*C.COMPARABLE)), terms)
    return rows.groupBy("doc_key").agg(F.countDistinct("best").alias("n_terms"))


def extraction_ok(n_terms: Column) -> Column:
    return F.coalesce(n_terms, F.lit(0)) >= 1


def jd_problem(text: Column, n_terms: Column, counted: Column) -> Column:
    nothing = F.when(~extraction_ok(n_terms), finding(F.lit(C.NO_REQUIREMENT), C.HINT_NO_REQUIREMENT))
    return F.coalesce(unreadable(text, "job description", counted), nothing)


def resume_problem(text: Column, n_terms: Column, counted: Column) -> Column:
    words = counted["words"]
    thin = F.concat(F.lit(C.THIN_RESUME[0]), words.cast("string"), F.lit(C.THIN_RESUME[1]))
    nothing = (
        F.when(extraction_ok(n_terms), F.lit(None).cast(FINDING))
        .when(text.isNull(), finding(F.lit(C.NO_RESUME_TEXT), C.HINT_NO_TEXT))
        .when(words < C.PROSE_WORDS, finding(thin, C.HINT_THIN))
    )
    return F.coalesce(unreadable(text, "resume", counted), nothing)


def problems(docs: DataFrame, spans: DataFrame, problem, terms: DataFrame | None = None) -> DataFrame:
    """(doc_key, problem): each document's finding, once a document."""
    counted = docs.select("doc_key", "text", counts(F.col("text")).alias("counted"))
    joined = counted.join(recognised_counts(spans, terms), "doc_key", "left")
    return joined.select("doc_key", problem(F.col("text"), F.col("n_terms"), F.col("counted")).alias("problem"))


def with_problems(docs: DataFrame, facts: DataFrame, **problems) -> DataFrame:
    """Documents' rows with `<mark>_problem` for each mark, without n_terms; facts: (doc_key, n_terms, ...), of documents
    that have spans."""
    counted = docs.select("doc_key", "text", counts(F.col("text")).alias("__counted"))
    joined = counted.join(facts, "doc_key", "full")
    # spans of a document that is not there are compared, and there is no text to find fault with
    found = [F.when(F.col("__counted").isNotNull(), p(F.col("text"), F.col("n_terms"), F.col("__counted"))).alias(f"{mark}_problem") for mark, p in problems.items()]
    return joined.select(*[c for c in facts.columns if c != "n_terms"], *found)


def verdict(jd: Column, resume: Column) -> Column:
    """Both findings as one reason with its hints, or null."""
    both = F.array_compact(F.array(jd, resume))
    detail = F.array_join(F.transform(both, lambda f: f["reason"]), "; ")
    hints = F.array_join(F.array_distinct(F.transform(both, lambda f: f["hint"])), " ")
    reason = F.concat(F.upper(F.substring(detail, 1, 1)), F.substring(detail, F.lit(2), F.char_length(detail)), F.lit(". "), hints)
    return F.when(F.size(both) > 0, reason)


def gate(pairs: DataFrame, jd_docs: DataFrame, jd_spans: DataFrame, resume_docs: DataFrame, resume_spans: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """(pair_id, jd_key, resume_key, problem)."""
    terms = recognised_in(jd_spans, resume_spans) if terms is None else terms
    left = problems(jd_docs, jd_spans, jd_problem, terms).select(F.col("doc_key").alias("jd_key"), F.col("problem").alias("p"))
    right = problems(resume_docs, resume_spans, resume_problem, terms).select(F.col("doc_key").alias("resume_key"), F.col("problem").alias("q"))
    joined = pairs.join(left, "jd_key", "left").join(right, "resume_key", "left")
    return joined.select("pair_id", "jd_key", "resume_key", verdict(F.col("p"), F.col("q")).alias("problem"))
