"""WARC archives: written record by record, read back by boundary-chain verification.

Writing: Spark's text writer makes the files; a row is a record and the separator is the two line ends that close
it. Of records with equal payloads the one with the smallest page_id is a response, the others are revisits that
name it; payloads shorter than ``least`` bytes are all responses.

Reading: files are split wherever the magic stands, in as many tasks as Spark likes, be it the begin of a record or
part of a payload. Every such candidate has an offset (lengths summed by split, then over splits) and, if its
header can be read, the offset of its successor. Pointer jumping from the start of the file then retains only
the candidates that the chain reaches; all others lie inside payloads and are put back there. Payloads travel
only where a payload holds the magic.

Defined cases: a null html is the empty payload; a null page_id is written as such and comes after all others;
rows with the smallest page_id of their payload are all responses, however often they repeat; a record's id is made of
page_id and payload digest, so that only rows equal in both share one; payloads of any length are whole; an archive whose
chain breaks gives the records before the break; an empty table or folder gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gapline.llm.common import fresh_path, materialize

MAGIC, CLOSE, RECORDS_A_FILE = "WARC/1.1\r\n", "\r\n\r\n", 20_000
NO_ID = "null"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def sha1_base32(data: Column) -> Column:
    """SHA-1 in upper-case base32: each 5 of its 40 hex digits are 4 characters."""
    digits = F.sha1(data.cast("binary"))
    parts = []
    for group in range(8):
        bits = F.conv(F.substring(digits, 5 * group + 1, 5), 16, 10).cast("int")
        parts += [F.substring(F.lit(BASE32), F.shiftright(bits, shift).bitwiseAND(31) + 1, F.lit(1)) for shift in (15, 10, 5, 0)]
    return F.concat(*parts)


def records(pages: DataFrame, least: int = 0) -> DataFrame:
    """(value): the whole record of each page, without its closing line ends."""
    own = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    own = own.withColumn("digest", sha1_base32(F.col("html"))).withColumn("bytes", F.octet_length("html"))
    firsts = own.groupBy("digest", "bytes").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    firsts = materialize(firsts.drop("n"), "warc-copies")  # a table, so that Spark knows its size when it picks the join
    own = own.join(firsts, ["digest", "bytes"], "left")
    again = (F.col("bytes") >= least) & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    page = F.coalesce(F.col("page_id").cast("string"), F.lit(NO_ID))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    urn = lambda x: F.concat(F.lit("<urn:page:"), x, F.lit(":"), "digest", F.lit(">"))
    header = F.concat(
        F.lit(MAGIC),
        line("WARC-Type", F.when(again, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", urn(page)),
        line("WARC-Date", F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        line("WARC-Target-URI", F.regexp_replace("url", "[\r\n]", " ")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        F.when(again, F.concat(line("WARC-Refers-To", urn(F.col("first").cast("string"))), line("WARC-Profile", F.lit(REVISIT_PROFILE)))).otherwise(F.lit("")),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(again, F.lit(0)).otherwise(F.col("bytes")).cast("string")),
        F.lit("\r\n"),
    )
    return own.select(F.concat(header, F.when(again, F.lit("")).otherwise(F.col("html"))).alias("value"))


def write_archives(pages: DataFrame, path: str, least: int = 0, records_a_file: int = RECORDS_A_FILE) -> None:
    found = records(pages, least)
    found.write.option("lineSep", CLOSE).option("maxRecordsPerFile", records_a_file).text(path)


def segments(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, value): the text after each magic, up to the next one, in the order of the file's splits."""
    read = spark.read.option("lineSep", MAGIC).text(path)
    return read.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def placed(rows: DataFrame) -> DataFrame:
    """Adds `rel`: where the row's magic stands, counted from the end of what the splits before hold. A task reads
    a split in order, so a running sum of the sizes gives it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, at = None, 0
        for batch in batches:
            files, blocks = batch.column("file").to_pylist(), batch.column("block").to_pylist()
            rel = []
            for file, block, size in zip(files, blocks, batch.column("size").to_pylist()):
                if (file, block) != last:
                    last, at = (file, block), 0
                rel.append(at - len(MAGIC))
                at += size + len(MAGIC)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rel, pa.int64())], [*batch.schema.names, "rel"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{schema}, rel long")


def parsed(rows: DataFrame) -> DataFrame:
    """Adds head, length (of the payload; null without a readable header) and size."""
    head = F.when(F.instr("value", CLOSE) > 0, F.substring_index("value", CLOSE, 1))
    length = F.regexp_extract(F.concat(F.lit("\n"), "head"), r"(?i)\ncontent-length:[ \t]*(\d{1,18})[ \t]*(?:\r|$)", 1)
    rows = rows.withColumn("head", head).withColumn("length", F.when(length != "", length.cast("long")))
    return rows.withColumn("size", F.octet_length("value"))


INNER = "file string, block long, rel long, record long, is_head boolean"


def verify_chain(rows: pd.DataFrame) -> pd.DataFrame:
    """The candidates of one file (a few numbers each) that are not whole records in their own row.

    Pointer jumping from the file's start: after k rounds a pointer leads 2 ** k records on, and all candidates
    less far from the start are marked if the chain reaches them. Returned are the unmarked ones, with the record
    in whose payload they stand (null where the chain does not hold), and the records that hold them (is_head)."""
    rows = rows.sort_values(["block", "rel"], ignore_index=True)
    total = rows.groupby("block")["size"].sum() + rows.groupby("block")["size"].count() * len(MAGIC)
    base = rows["block"].map(total.cumsum() - total).to_numpy(np.int64)
    at = base + rows["rel"].to_numpy(np.int64)
    step = rows["step"].to_numpy(np.float64)
    n, known = len(rows), ~np.isnan(step) & (at >= 0)
    following = np.where(known, at + np.where(known, step, 0), -1).astype(np.int64)
    target = np.searchsorted(at, following)
    lands = known & (target < n)
    lands[lands] = at[target[lands]] == following[lands]
    pointer = np.append(np.where(lands, target, n), n)
    reached = np.append(at == 0, False)
    while True:
        more = reached.copy()
        more[pointer[reached.nonzero()[0]]] = True
        more[n] = False
        further = pointer[pointer]
        if (more == reached).all() and (further == pointer).all():
            break
        reached, pointer = more, further
    end = at[-1] + len(MAGIC) + rows["size"].iloc[-1]
    record = reached[:n] & known & (lands | (following == end))
    owner = np.maximum.accumulate(np.where(record, np.arange(n), -1))
    inside = ~record & (owner >= 0)
    inside[inside] = at[inside] < following[owner[inside]]
    heads = np.zeros(n, bool)
    heads[owner[inside]] = True
    odd = np.flatnonzero((~record | heads) & (at >= 0))
    of = np.where(inside | heads, at[owner], -1)[odd]
    out = rows.iloc[odd][["file", "block", "rel"]]
    return out.assign(record=pd.array(of, "Int64"), is_head=heads[odd])


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(file, head, body) of each record; body has exactly the bytes that the header states."""
    small = parsed(segments(spark, path)).select(
        "file", "block", F.octet_length("head").alias("head_bytes"), "length", "size"
    )
    step = F.col("head_bytes") + len(MAGIC) + len(CLOSE) + F.col("length") + len(CLOSE)
    chain = placed(small).select("file", "block", "rel", "size", step.alias("step"))
    odd = materialize(chain.groupBy("file").applyInPandas(verify_chain, INNER), "warc-odd")
    rows = placed(parsed(segments(spark, path))).filter("rel >= 0 or block > 0").join(odd, ["file", "block", "rel"], "left")
    rest = F.expr(f"substring(value, char_length(head) + {len(CLOSE) + 1})")
    plain = rows.filter("record is null and length is not null").select("file", "head", "length", rest.alias("text"))
    # payloads with the magic in them: the record's row and those inside are put together again
    cut = rows.filter("record >= 0").select("file", "record", F.struct(~F.col("is_head"), "block", "rel", "value", "head", "length").alias("part"))
    cut = cut.groupBy("file", "record").agg(F.array_sort(F.collect_list("part")).alias("parts"))  # of one record
    whole = F.array_join(F.transform("parts", lambda p: p["value"]), MAGIC)
    cut = cut.select("file", F.col("parts")[0]["head"].alias("head"), F.col("parts")[0]["length"].alias("length"), whole.alias("value"))
    both = plain.unionByName(cut.select("file", "head", "length", rest.alias("text")))
    both = both.withColumn("data", F.col("text").cast("binary")).filter("octet_length(data) >= length")
    return both.select("file", "head", F.expr("substring(data, 1, cast(length AS int))").cast("string").alias("body"))


def header_field(name: str):
    return F.regexp_extract(F.concat(F.lit("\n"), "head"), rf"(?i)\n{name}:[ \t]*([^\r\n]*)", 1)


def page_digests(found: DataFrame, kind: str = "long") -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to), worked out from what was read. A revisit
    has its payload's length from the response that it names, checked by digest."""
    ref = r"^<urn:page:(.*?)(?::[A-Z2-7]{32})?>$"
    rows = found.select(
        F.regexp_extract(header_field("WARC-Record-ID"), ref, 1).alias("id"),
        header_field("WARC-Type").alias("record_type"),
        F.regexp_extract(header_field("WARC-Payload-Digest"), r"sha1:(\w+)", 1).alias("stated"),
        F.regexp_extract(header_field("WARC-Refers-To"), ref, 1).alias("refers"),
        F.octet_length("body").cast("long").alias("bytes"),
        "body",
    )
    number = lambda c: F.when(F.col(c) != NO_ID, F.col(c)).cast(kind)
    responses = rows.filter("record_type = 'response'").withColumn("digest", sha1_base32(F.col("body"))).drop("body")
    first = responses.groupBy("id", "digest").agg(F.max("bytes").alias("payload_bytes"))
    revisits = rows.filter("record_type = 'revisit'").select("id", "record_type", "stated", "refers")
    named = revisits.join(first.withColumnRenamed("id", "refers").withColumnRenamed("digest", "stated"), ["refers", "stated"], "left")
    out = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    one = responses.select(number("id").alias("page_id"), F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", F.lit(None).cast(kind).alias("refers_to"))
    two = named.select(number("id").alias("page_id"), "payload_bytes", F.col("stated").alias("payload_digest"), "record_type", number("refers").alias("refers_to"))
    return one.select(*out).unionByName(two.select(*out))


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Archives in a fresh folder of the shared storage, and what reading them gives."""
    spark = pages.sparkSession
    path = fresh_path(spark, "warc")
    write_archives(pages, path, least)
    return page_digests(read_archives(spark, path), pages.schema["page_id"].dataType.simpleString())
