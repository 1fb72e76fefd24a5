"""Whole text files, and where a text comes from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gapline.functions import text as T


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): a row a file; files that are not UTF-8 fail with their name."""
    files = spark.read.format("binaryFile").load(path)
    text = F.col("content").cast("string")
    bad = F.raise_error(F.concat("path", F.lit(" is not UTF-8 text; convert it to plain text first"))).cast("string")
    return files.select("path", F.when(F.is_valid_utf8(text), text).otherwise(bad).alias("text"))


def resolve(inline: Column, from_file: Column, default: Column) -> Column:
    """struct(text, error): inline, else the file's text, else the default. Absent is null; blank is an error."""
    blank = lambda c: T.strip(c) == ""
    error = F.when(blank(inline), "supplied but empty").when(inline.isNull() & blank(from_file), "file is empty")
    return F.struct(F.when(error.isNull(), F.coalesce(inline, from_file, default)).alias("text"), error.alias("error"))
