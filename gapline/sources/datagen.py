"""Synthetic labelled samples: sentences from templates, filled from the vocabularies, all choices arithmetic on the
sample's number and the seed, so that any number of samples is made in parallel and again alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gapline import constants as C
from gapline.functions import text as T

PIECES = "array<struct<token:string,tag:string>>"


def template_table() -> list[tuple[int, int, str | None, str | None, int, int]]:
    """(template, seg, literal, type, n, size): a row a segment; size is the vocabulary's."""
    return [
        (t, i, s if isinstance(s, str) else None, None if isinstance(s, str) else s[0], 0 if isinstance(s, str) else s[1], 0 if isinstance(s, str) else len(C.VOCABULARY[s[0]]))
        for t, segments in enumerate(C.TEMPLATES)
        for i, s in enumerate(segments)
    ]


def vocabulary_table() -> list[tuple[str, int, str]]:
    return [(k, i, v) for k, values in C.VOCABULARY.items() for i, v in enumerate(values)]


def sentences(ids: DataFrame, seed: int) -> DataFrame:
    """(id, sentence, template) of rows (id): one sentence, or two or three for MULTI_SHARE per cent of the samples."""
    x = F.col("id") + seed
    many = F.when((x * 37) % 100 < C.MULTI_SHARE, 2 + x % 2).otherwise(1)
    rows = ids.withColumn("sentence", F.explode(F.sequence(F.lit(0), (many - 1).cast("int"))))
    return rows.withColumn("template", ((x * 7 + F.col("sentence") * 11) % len(C.TEMPLATES)).cast("int"))


def generate(spark: SparkSession, n: int = C.DATAGEN_SAMPLES, seed: int = C.DATAGEN_SEED) -> DataFrame:
    """(id, words, labels) of the numbers below n."""
    return generate_for(spark.range(n), seed)


def generate_for(ids: DataFrame, seed: int = C.DATAGEN_SEED) -> DataFrame:
    """(id, words, labels): a sample for each number of the rows (id)."""
    spark = ids.sparkSession
    templates = spark.createDataFrame(template_table(), "template int, seg int, literal string, type string, n int, size int")
    values = spark.createDataFrame(vocabulary_table(), "type string, at long, value string")
    segments = sentences(ids, seed).join(F.broadcast(templates), "template")  # both tables are constants
    x = F.col("id") + seed
    step = 1 + x % F.greatest(F.floor((F.col("size") - 1) / 2), F.lit(1))  # below half the size: no value twice
    at = (x * 31 + F.col("sentence") * 17 + F.col("seg") * 13 + F.col("j") * step) % F.col("size")
    slots = segments.filter("type is not null").withColumn("j", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).withColumn("at", at)
    slots = slots.join(F.broadcast(values), ["type", "at"])
    word = lambda w, tag: F.struct(w.alias("token"), tag.alias("tag"))
    comma, conjunction = word(F.lit(","), F.lit("O")), word(F.lit("and"), F.lit("O"))
    lead = (
        F.when(F.col("j") == 0, F.array().cast(PIECES))
        .when(F.col("n") == 2, F.array(conjunction))
        .when(F.col("j") == F.col("n") - 1, F.array(comma, conjunction))
        .otherwise(F.array(comma))
    )
    tag = lambda i: F.concat(F.when(i == 0, F.lit("B-")).otherwise(F.lit("I-")), F.col("type"))
    named = slots.select("id", "sentence", "seg", "j", F.concat(lead, F.transform(T.tokenize(F.col("value")), lambda w, i: word(w, tag(i)))).alias("t"))
    plain = segments.filter("literal is not null").select("id", "sentence", "seg", F.lit(0).alias("j"), F.transform(T.tokenize(F.col("literal")), lambda w: word(w, F.lit("O"))).alias("t"))
    parts = named.unionByName(plain).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("sentence", "seg", "j", "t"))).alias("p"))  # of one sample
    flat = parts.select("id", F.flatten(F.transform("p", lambda p: p["t"])).alias("t"))
    ids = F.array(*map(F.lit, C.LABELS))
    return flat.select("id", F.transform("t", lambda t: t["token"]).alias("words"), F.transform("t", lambda t: (F.array_position(ids, t["tag"]) - 1).cast("int")).alias("labels"))


def totals(samples: DataFrame) -> DataFrame:
    """One row (samples, tokens)."""
    return samples.agg(F.count("*").alias("samples"), F.coalesce(F.sum(F.size("words")), F.lit(0)).alias("tokens"))
