"""The library over files: `spark-submit -m` or `python -m gapline <command> ...`. Tables are Parquet folders."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from gapline import constants as C
from gapline.plans import analysis, labellers
from gapline.session import ship_package
from gapline.sources import conll, datagen, text


def arguments() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="gapline", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    texts = commands.add_parser("texts", help="text files to a table (doc_key, text), keyed by path")
    texts.add_argument("files")
    extract = commands.add_parser("extract", help="a table (doc_key, text) to spans (doc_key, category, ord, span)")
    extract.add_argument("docs")
    compare = commands.add_parser("analyze", help="documents and pairs (pair_id, jd_key, resume_key) to gaps, notes and mails; exit status 1 if a pair is refused")
    compare.add_argument("docs")
    compare.add_argument("pairs")
    compare.add_argument("--json", action="store_true", help="write (pair_id, json)")
    made = commands.add_parser("datagen", help="labelled samples as CoNLL files")
    made.add_argument("--samples", type=int, default=C.DATAGEN_SAMPLES)
    made.add_argument("--seed", type=int, default=C.DATAGEN_SEED)
    train = commands.add_parser("train", help="CoNLL files to a token classifier")
    train.add_argument("files")
    for command in (texts, extract, compare, made, train):
        command.add_argument("--out", required=True)
        if command in (extract, compare):
            command.add_argument("--model", help="a trained classifier in place of the lexicon")
    return parser


def main(argv: list[str] | None = None) -> int:
    asked = arguments().parse_args(argv)
    spark = SparkSession.builder.appName("gapline").getOrCreate()
    ship_package(spark)
    labeller = labellers.lexicon_labeller
    if getattr(asked, "model", None):
        labeller = labellers.classifier_labeller(labellers.load_classifier(asked.model))
    if asked.command == "texts":
        text.read_texts(spark, asked.files).withColumnRenamed("path", "doc_key").write.parquet(asked.out)
    elif asked.command == "extract":
        analysis.extract_spans(spark.read.parquet(asked.docs), labeller).write.parquet(asked.out)
    elif asked.command == "analyze":
        result = analysis.analyze(spark.read.parquet(asked.pairs), spark.read.parquet(asked.docs), labeller)
        told = analysis.to_json(result) if asked.json else analysis.write_feedback(result)
        (told.join(result.select("pair_id", "problem"), "pair_id") if asked.json else told).write.parquet(asked.out)
        return int(not spark.read.parquet(asked.out).filter("problem is not null").isEmpty())
    elif asked.command == "datagen":
        made = datagen.generate(spark, asked.samples, asked.seed)
        conll.write_conll(made, asked.out)
        print(*datagen.totals(made).first(), sep=" samples, ", end=" tokens\n")
    else:
        samples = conll.load_conll(spark, asked.files).select(F.concat_ws(":", "path", F.col("sample").cast("string")).alias("doc_key"), "words", "labels")
        labellers.save_classifier(labellers.train_token_classifier(samples)[0], asked.out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
