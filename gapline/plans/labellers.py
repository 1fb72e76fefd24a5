"""Labellers: documents to labelled tokens (doc_key, pos, word, glued, label).

`lexicon_labeller` needs no model: it marks the windows of words whose canonical key is in the vocabulary.
`train_token_classifier` fits a classifier on labelled samples with pyspark.ml. Any function of the same shape, such
as one around a transformer in mapInPandas, can stand in their place. What `of_texts` makes has `labels` besides: it
labels the words of one text in a task, so that spans and samples are made of texts without a row a word.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import FeatureHasher
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, StructType

from gapline import constants as C
from gapline.functions import text as T
from gapline.operators import sequence
from gapline.operators.lexicon import Scan
from gapline.operators.metrics import class_weights, entities, pair_scores, paired
from gapline.operators.sequence import tokens
from gapline.session import discard, materialize

#: Called once a task: what labels the words of one text, of which some are glued.
Labels = Callable[[], Callable[[list[str], list[bool]], list[str]]]
#: A term of several types gets the first of them.
TYPES = ["TECHNICALSKILL", "TOOLS", "SOFTSKILL", "QUALIFICATION", "DESIGNATION", "YEAROFEXPERIENCE"]
SHAPE = {"word": "word", "before": "before", "after": "after", "form": "form", "end": "end"}


def raw_vocabulary() -> list[tuple[str, str, int]]:
    """(raw term, type, rank) of all constants."""
    extra = {"TECHNICALSKILL": C.EXTRA_SKILLS, "QUALIFICATION": C.DEGREES + C.FIELDS}
    return [(t, k, i) for i, k in enumerate(TYPES) for t in [*C.VOCABULARY[k], *extra.get(k, [])]]


@cache
def vocabulary(spark: SparkSession) -> tuple[tuple[str, str], ...]:
    """(canonical term, type) of all constants."""
    rows = spark.createDataFrame(raw_vocabulary(), "raw string, type string, rank int").select(T.canonical(F.col("raw")).alias("term"), "type", "rank")
    return tuple(sorted(map(tuple, rows.groupBy("term").agg(F.min_by("type", "rank").alias("type")).collect())))


def in_tasks(text: Column, labels: Labels, result: str, rows: Callable[[list[str], list[bool], list[str]], list[tuple]]) -> Column:
    """What `rows` makes of each text's words, whether they are glued, and their labels: an array of structs `result`."""
    kinds = StructType.fromDDL(result)

    @F.arrow_udf(ArrayType(kinds))
    def made(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        label = labels()
        schema = to_arrow_schema(kinds)
        for batch in batches:
            found, ends = [], [0]
            for text in batch.to_pylist():
                if text:
                    words, glued = sequence.words_of(text)
                    found += rows(words, glued, label(words, glued))
                ends.append(len(found))
            columns = [pa.array(c, f.type) for c, f in zip(zip(*found) if found else [()] * len(schema), schema)]
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, fields=list(schema)))

    return made(text)


def of_texts(labels: Callable[[SparkSession], Labels]):
    """A labeller of whole texts around what labels the words of one text in a task."""

    def label(docs: DataFrame) -> DataFrame:
        found = in_tasks(F.col("text"), labels(docs.sparkSession), "word string, glued boolean, label string", lambda words, glued, said: list(zip(words, glued, said)))
        return docs.select("doc_key", F.posexplode(found).alias("pos", "z")).select("doc_key", "pos", "z.*")

    label.labels = labels
    return label


def lexicon_labels(spark: SparkSession) -> Labels:
    types = dict(vocabulary(spark))

    def labels() -> Callable[[list[str], list[bool]], list[str]]:
        scan = Scan(types)

        def label(words: list[str], glued: list[bool]) -> list[str]:
            out = ["O"] * len(words)
            for i, k, kind in scan(words):
                # a dot written flush before a hit's first word belongs to it: .NET
                begin = i - 1 if i and glued[i - 1] else i
                out[begin : i + k] = ["B-" + kind] + ["I-" + kind] * (i + k - begin - 1)
            return out

        return label

    return labels


#: docs: (doc_key, text).
lexicon_labeller = of_texts(lexicon_labels)


def _contexts(words: Column) -> Column:
    """Each word with those on either side of it, lower-cased."""
    beside = lambda w, i: F.coalesce(F.lower(F.get(w, i)), F.lit(""))
    return T.bind(words, lambda w: F.transform(w, lambda x, i: F.struct(x.alias("word"), beside(w, i - 1).alias("before"), beside(w, i + 1).alias("after"))))


def _features(rows: DataFrame) -> DataFrame:
    """Adds what a word's own spelling gives to rows of `_contexts`."""
    form = F.regexp_replace(F.regexp_replace(F.regexp_replace("word", "[A-Z]", "A"), "[a-z]", "a"), "[0-9]", "9")
    return rows.withColumns({"form": F.substring(form, 1, 6), "end": F.expr("right(lower(word), 3)")})


def train_token_classifier(
    samples: DataFrame, grid: tuple[float, ...] = (0.001, 0.01), features: int = 1 << 14, patience: int = 3, stride: int = 2, most_steps: int = 20
) -> tuple[PipelineModel, list[tuple[float, int, float]]]:
    """A classifier on samples (doc_key, words, labels), with balanced class weights, and how it was chosen: (strength,
    iterations, entity F1) of each step.

    For each regularisation in `grid` a step fits `stride` iterations more than the one before; what it says of a held-out
    tenth is decoded to entities and scored by their F1. After `patience` steps without a better score the next strength is
    tried; the best step of all is kept, however many come after it. Learns from all other samples: words with the same
    features and label are one row with the sum of their weights, which gives the same loss."""
    held = F.pmod(F.crc32(F.col("doc_key").cast("string").cast("binary")), F.lit(10)) == 0
    chosen = materialize(samples.select("doc_key", "words", "labels", held.alias("held")), "labelled")
    rows = chosen.select("doc_key", "held", F.posexplode(F.arrays_zip(_contexts(F.col("words")).alias("c"), F.col("labels").alias("label_id"))).alias("pos", "z"))
    rows = rows.select("doc_key", "held", "pos", "z.c.*", F.col("z.label_id").cast("double").alias("label_id")).filter(F.col("label_id").between(0, len(C.LABELS) - 1))
    hasher = FeatureHasher(inputCols=list(SHAPE), outputCol="features", numFeatures=features)
    alike = rows.filter("not held").groupBy("word", "before", "after", "label_id").agg(F.count("*").alias("n"))
    alike = alike.join(F.broadcast(class_weights(chosen.filter("not held"))), "label_id").withColumn("weight", F.col("weight") * F.col("n"))  # a row a label
    fit = materialize(hasher.transform(_features(alike)).select("label_id", "weight", "features"), "features")
    test = materialize(hasher.transform(_features(rows.filter("held"))).select("doc_key", "pos", "label_id", "features"), "held")
    names = F.array(*map(F.lit, C.LABELS))
    named = lambda df, column: df.select("doc_key", "pos", F.get(names, F.col(column).cast("int")).alias("label"))
    gold = materialize(entities(named(test, "label_id")), "gold")  # each step reads them
    best, best_score, history = None, -1.0, []
    for strength in grid:
        top, waited = -1.0, 0
        for step in range(1, most_steps + 1):
            model = LogisticRegression(labelCol="label_id", weightCol="weight", regParam=strength, maxIter=step * stride, tol=0.0, family="multinomial").fit(fit)
            score = pair_scores(paired(gold, entities(named(model.transform(test), "prediction")))).first()["f1"]
            history.append((strength, step * stride, score))
            if score > best_score:
                best, best_score = model, score
            top, waited = (score, 0) if score > top else (top, waited + 1)
            if waited == patience:
                break
    discard(chosen, fit, test, gold)
    return PipelineModel(stages=[hasher, best]), history


def save_classifier(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_classifier(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def classifier_labeller(model: PipelineModel):
    """A labeller around a trained classifier."""
    names = F.array(*map(F.lit, C.LABELS))

    def label(docs: DataFrame) -> DataFrame:
        words = F.arrays_zip(_contexts(T.tokenize(F.col("text"))).alias("c"), T.dot_glue(F.col("text")).alias("glued"))
        rows = docs.select("doc_key", F.posexplode(words).alias("pos", "z")).select("doc_key", "pos", "z.c.*", "z.glued")
        found = model.transform(_features(rows))
        return found.select("doc_key", "pos", "word", "glued", F.get(names, F.col("prediction").cast("int")).alias("label"))

    return label


def windowed(labeller, budget: int = C.MOST_SUBWORDS - C.SPECIAL_SUBWORDS, most_overlap: int = C.OVERLAP_WORDS):
    """A labeller that sees no more than `budget` subwords at once: each document goes to `labeller` window by window,
    and each word takes its label from the one window that owns it. Windows without any subword are left out."""

    def label(docs: DataFrame) -> DataFrame:
        words = docs.select("doc_key", T.tokenize(F.col("text")).alias("words")).withColumn("lengths", sequence.subword_lengths(F.col("words")))
        plans = words.withColumn("windows", sequence.plan_windows(F.col("lengths"), budget, most_overlap))
        cut = plans.select("doc_key", "words", "lengths", F.posexplode("windows").alias("win", "w"))
        part = lambda c: F.slice(c, F.col("w.start") + 1, F.col("w.end") - F.col("w.start"))
        cut = cut.select(F.struct("doc_key", "win", "w.start", "w.end").alias("doc_key"), F.array_join(part("words"), " ").alias("text"), F.exists(part("lengths"), lambda n: n > 0).alias("some"))
        found = labeller(cut.filter("some").select("doc_key", "text")).filter("label <> 'O'")
        found = found.select("doc_key.doc_key", "doc_key.win", (F.col("doc_key.start") + F.col("pos")).alias("pos"), "label")
        merged = sequence.merge_labels(sequence.window_rows(plans), found)
        return tokens(docs).join(merged.hint("merge"), ["doc_key", "pos"], "left").withColumn("label", F.coalesce("label", F.lit("O")))

    def labels(spark: SparkSession) -> Labels:
        of_window = labeller.labels(spark)

        def by_window() -> Callable[[list[str], list[bool]], list[str]]:
            whole = of_window()

            def within(words: list[str], glued: list[bool]) -> list[str]:
                lengths = [sequence.subwords(w) for w in words]
                windows = sequence._plan(np.asarray(lengths, np.int64), budget, most_overlap)
                parts = [(w["start"], w["end"]) for w in windows]
                said = [whole(words[a:b], glued[a:b]) if any(lengths[a:b]) else ["O"] * (b - a) for a, b in parts]
                return sequence.merged(windows, said)

            return within

        return by_window

    return of_texts(labels) if hasattr(labeller, "labels") else label


def labelled_samples(docs: DataFrame, labeller=lexicon_labeller) -> DataFrame:
    """(doc_key, words, labels) of documents (doc_key, text): what a labeller says, as samples to learn from."""
    if hasattr(labeller, "labels"):
        ids = {label: i for i, label in enumerate(C.LABELS)}
        found = in_tasks(F.col("text"), labeller.labels(docs.sparkSession), "word string, label_id int", lambda words, glued, said: [(w, ids[x]) for w, x in zip(words, said)])
        rows = docs.select("doc_key", found.alias("t")).filter(F.size("t") > 0)
        return rows.select("doc_key", F.col("t.word").alias("words"), F.col("t.label_id").alias("labels"))
    ids = F.array(*map(F.lit, C.LABELS))
    token = F.struct("pos", "word", (F.array_position(ids, F.col("label")) - 1).cast("int").alias("label_id"))
    rows = labeller(docs).groupBy("doc_key").agg(F.array_sort(F.collect_list(token)).alias("t"))  # of one document
    return rows.select("doc_key", F.transform("t", lambda t: t["word"]).alias("words"), F.transform("t", lambda t: t["label_id"]).alias("labels"))
