"""Helpers that the training-data operators share: table access, shared storage, word splitting."""

from __future__ import annotations

import os
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gapline.session import discard, fresh_path, materialize, ship_package

__all__ = ["discard", "fresh_path", "materialize"]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Bytes: A-Z lowered, all else kept.
LOWER_ASCII = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Bytes: A-Z lowered, ASCII that is neither letter nor digit becomes a blank, bytes from 0x80 up are kept.
ALNUM_WORDS = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(col: Column) -> Column:
    return F.translate(col, UPPER, LOWER)


def encode(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def crc_bucket(col: Column, modulus: int) -> Column:
    """crc32 of the value as text, modulo; null counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def stable_hash(data: bytes, seed: int = 0) -> int:
    return zlib.crc32(data, seed)


def chunks_by_bytes(sizes, limit: int):
    """Slices of consecutive rows of at most `limit` bytes, one row at least."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield slice(start, i)
            start, total = i, 0
        total += n
    if len(sizes) > start:
        yield slice(start, len(sizes))


def single_thread() -> None:
    """One thread a task: Spark gives each task one core."""
    for name in ("OMP_NUM_THREADS", "OPENBLAS_NUM_THREADS", "RAYON_NUM_THREADS"):
        os.environ.setdefault(name, "1")
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
