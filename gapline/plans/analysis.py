"""The whole analysis of many pairs as one plan: texts, spans, gate, gaps, notes, mail."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapline import constants as C
from gapline.functions import text as T
from gapline.operators import compose
from gapline.operators.gate import gate, jd_problem, resume_problem, verdict, with_problems
from gapline.operators.lexicon import recognised_in
from gapline.operators.matching import DEGREE, EXPERIENCE, ITEMS, SKILL, asking, gap_items, having, in_order, n_terms, notes_of_pair, popular_keys, profiles, sides, with_side
from gapline.operators.sequence import clean_spans, group_words, spans_of
from gapline.plans.labellers import in_tasks, lexicon_labeller
from gapline.session import materialize
from gapline.sources.http import request_feedback

Labeller = Callable[[DataFrame], DataFrame]


def extract_spans(docs: DataFrame, labeller: Labeller = lexicon_labeller) -> DataFrame:
    """(doc_key, category, ord, span) of documents (doc_key, text)."""
    if hasattr(labeller, "labels"):
        found = in_tasks(F.col("text"), labeller.labels(docs.sparkSession), "category string, ord int, span string", spans_of)
        return docs.select("doc_key", F.inline(found))
    ready = docs.select("doc_key", T.collapse_whitespace(F.col("text")).alias("text"))
    return clean_spans(group_words(labeller(ready)))


def all_terms(*spans: DataFrame) -> DataFrame:
    """What the distinct spans of all sides name: a table, so that gate, gaps and notes scan each span once in all."""
    return materialize(recognised_in(*spans), "terms")


def analyze_spans(pairs: DataFrame, jd_docs: DataFrame, jd_spans: DataFrame, resume_docs: DataFrame, resume_spans: DataFrame) -> DataFrame:
    """(pair_id, problem, missing, notes). Pairs that the gate refuses are not compared: null missing and notes,
    where pairs without gaps have an empty array. Findings, gaps and notes come from one row a document of each side."""
    left, right = sides(jd_spans, resume_spans, all_terms(jd_spans, resume_spans))
    return compare(pairs, with_problems(jd_docs, left, j=jd_problem), with_problems(resume_docs, right, r=resume_problem))


def compare(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """What `analyze_spans` gives, from the rows of each side's documents with their problem."""
    popular = popular_keys(pairs)
    # the candidates first: what pairs carry into the next join is narrower than what postings ask for
    both = with_side(with_side(pairs.select("pair_id", "jd_key", "resume_key"), right, "resume_key", popular), left, "jd_key", popular)
    judged = both.withColumn("problem", verdict(F.col("j_problem"), F.col("r_problem")))
    judged = judged.withColumn("missing", in_order(F.coalesce(gap_items((SKILL, DEGREE, EXPERIENCE)), F.array().cast(ITEMS))))
    open_pair = F.col("problem").isNull()
    return judged.select("pair_id", "jd_key", "resume_key", "problem", F.when(open_pair, F.col("missing")).alias("missing"), F.when(open_pair, notes_of_pair()).alias("notes"))


def analyze(pairs: DataFrame, docs: DataFrame, labeller: Labeller = lexicon_labeller) -> DataFrame:
    """pairs: (pair_id, jd_key, resume_key); docs: (doc_key, text) of both sides."""
    # texts are read once, and labelled once; a document may stand on either side: both sides' rows come from one row of it
    texts = materialize(docs.select("doc_key", "text"), "texts")
    spans = materialize(extract_spans(texts, labeller), "spans")
    items = profiles(spans, all_terms(spans)).withColumn("n_terms", n_terms())
    rows = materialize(with_problems(texts, items, j=jd_problem, r=resume_problem), "documents")
    return compare(pairs, rows.select("doc_key", *asking(), "j_problem"), rows.select("doc_key", *having(), "r_problem"))


def to_json(result: DataFrame) -> DataFrame:
    """(pair_id, json): nulls are written, so that a refusal differs from no gaps."""
    return result.select("pair_id", F.to_json(F.struct("problem", "missing", "notes"), {"ignoreNullFields": "false"}).alias("json"))


def write_feedback(result: DataFrame, generated: Column | None = None, company: Column | None = None, recruiter: Column | None = None, role: Column | None = None) -> DataFrame:
    """Adds feedback and notices: the generated text, or the template where there is none; null on a refusal."""
    template = compose.feedback_mail(F.col("missing"), company, recruiter, role)
    generated = F.lit(None).cast("string") if generated is None else generated
    fallen = F.array(F.struct(F.lit("info").alias("level"), F.lit("Falling back to the template writer.").alias("message")))
    return result.withColumn("feedback", F.when(F.col("problem").isNull(), F.coalesce(generated, template))).withColumn(
        "notices", F.when(F.col("problem").isNull() & generated.isNull(), fallen).otherwise(F.array().cast("array<struct<level:string,message:string>>"))
    )


def served_feedback(result: DataFrame, bodies: Column, url: str, **sender: Any) -> DataFrame:
    """As ``write_feedback``, with the service's texts for the open pairs and `service_error` where it had none: these
    get the template. The answers are stored, so that no request is made twice. sender: see ``request_feedback``."""
    asked = result.filter("problem IS NULL").select("pair_id", bodies.alias("body"))
    answers = materialize(request_feedback(asked, url, **sender), "feedback")
    answers = answers.select("pair_id", F.col("feedback").alias("__generated"), F.col("error").alias("service_error"))
    return write_feedback(result.join(answers, "pair_id", "left"), F.col("__generated")).drop("__generated")


def with_settings_notice(drafts: DataFrame, current: Column) -> DataFrame:
    """Adds settings_changed and settings_notice to drafts with `settings`, a struct (role, company, recruiter, mode):
    whether the current ones are others, and what to say of it then."""
    changed = ~F.col("settings").eqNullSafe(current)
    said = lambda name: F.coalesce(F.col(f"settings.{name}"), F.lit(""))
    role, company, recruiter, mode, end = map(F.lit, C.SETTINGS_CHANGED)
    notice = F.concat(role, said("role"), company, said("company"), recruiter, said("recruiter"), mode, said("mode"), end)
    return drafts.withColumn("settings_changed", changed).withColumn("settings_notice", F.when(changed, notice))


def downloadable(reviewed: Column, stale: Column, problem: Column) -> Column:
    """A draft may leave once it is reviewed, belongs to the texts at hand, and was not refused."""
    return reviewed & ~stale & problem.isNull()


def respond(requests: DataFrame, jd_spans: DataFrame, resume_spans: DataFrame, ready: bool = True) -> DataFrame:
    """A batch of service requests (pair_id, jd_key, resume_key) with entities only: (pair_id, status, detail,
    prompt). 503 without a model, 422 if the gate refuses, else 200 and the prompt for the model."""
    docs = lambda key: requests.select(F.col(key).alias("doc_key")).distinct().withColumn("text", F.lit(None).cast("string"))
    judged = gate(requests, docs("jd_key"), jd_spans, docs("resume_key"), resume_spans)
    left = compose.grouped(jd_spans, "doc_key").select(F.col("doc_key").alias("jd_key"), F.col("items").alias("j"))
    right = compose.grouped(resume_spans, "doc_key").select(F.col("doc_key").alias("resume_key"), F.col("items").alias("r"))
    joined = judged.join(left, "jd_key", "left").join(right, "resume_key", "left")
    status = F.when(F.lit(not ready), 503).when(F.col("problem").isNotNull(), 422).otherwise(200)
    detail = F.when(F.lit(not ready), F.lit("Model not loaded; the service is not ready yet.")).otherwise(F.col("problem"))
    return joined.select("pair_id", status.alias("status"), detail.alias("detail"), F.when(status == 200, compose.comparison_prompt(F.col("j"), F.col("r"))).alias("prompt"))
