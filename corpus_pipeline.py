"""Corpus cleaning: toxicity, line dedup, SimHash near-dedup, benchmark decontamination, best-fit packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept.

Defined cases, for all stages: a null text is an empty one, except that it stays null; documents without a text are one
group of near copies, of which one stays; an id may be null or repeat: rows are told apart by their texts, and rows that
repeat both id and text fall to one in the near-copy stage; texts of any length are read whole; extra columns pass
through; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gapline.llm import decontaminate, linededup, packing, simhash, toxicity
from gapline.llm.common import discard, materialize, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    scored = toxicity.toxicity(docs, table(spark, sf_dir, "labels"))
    return scored.filter("not rejected").select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of lines that repeat, exactly or, if long, but for an edit, the first stays. A document goes if lines were removed
    from it and nothing but white space is left: all it said is said before."""
    kept = linededup.dedup_lines(docs, short=True).filter(r"n_removed = 0 or text rlike '[^\\s]'")
    changed = F.when(F.col("n_removed") > 0, F.char_length("text").cast("long"))
    return kept.withColumn("n_chars", F.coalesce(changed, "n_chars")).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return simhash.keep_first(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words benchmark passages make up a twentieth or more go."""
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.filter("not contaminated").select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences: every piece of every document with its place."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("simhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("best_fit_packing", pack_sequences),
]

#: The classifier and the closures of the dedup stages are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, done = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
        discard(*done)  # the table before is read no more
        done = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
