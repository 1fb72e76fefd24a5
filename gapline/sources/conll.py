"""CoNLL files: `token TAG` lines, samples between blank lines. Reading gives samples, counters and diagnostics.

Files are read by Spark's text reader in byte ranges, so one large file is many tasks. A line's place is its split (path,
begin of the byte range) and its place there; numbers of lines are prefix sums of two levels, within a split and over a
file's splits. One pass reads and parses the text, gathers the counters on the way and stores parts of samples: each task
cuts its lines at blank ones as they come, so that lines are neither dealt nor sorted. Numbers of samples are prefix sums
over runs of lines, and only samples that a run's end cuts are put together again.

Strict reading fails with the first bad line; lenient reading skips malformed lines, takes unknown tags as O and keeps
hidden characters inside a field. Hidden characters at a field's ends, byte-order marks among them, always go and are
reported. Lines that are not UTF-8 fail in both ways. An empty file gives no samples.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from gapline import constants as C
from gapline.functions import text as T
from gapline.session import materialize

FATAL = ("malformed", "interior", "unknown_tag")
SPLIT = ["path", "block"]
RUN = [*SPLIT, "run"]
PLAIN_LINE = rf"^[{T.PLAIN}]+ [{T.PLAIN}]+\z"
PARTS = "path string, block long, run long, at long, blanks long, whole boolean, words array<string>, labels array<int>"


def split_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, block, at, line): block is the begin of the line's byte range, `at` rises by one from line to line of it."""
    rows = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value"
    )
    line = F.when(F.is_valid_utf8("value"), F.col("value")).otherwise(F.raise_error(F.concat("path", F.lit(": not valid UTF-8"))).cast("string"))
    return rows.select(*SPLIT, "at", line.alias("line"))


def split_starts(rows: DataFrame, **sums: Column) -> DataFrame:
    """(path, block, first, lines, ...): a row a split, with its first `at` and what the file's splits before it sum to."""
    totals = rows.groupBy(*SPLIT).agg(F.min("at").alias("first"), F.count("*").alias("lines"), *[F.coalesce(F.sum(v), F.lit(0)).alias(k) for k, v in sums.items()])
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row a split
    return totals.select(*SPLIT, "first", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in ("lines", *sums)])


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, block, line_no, line), line_no from 1."""
    rows = split_lines(spark, path)
    numbered = rows.join(split_starts(rows), SPLIT)
    return numbered.select(*SPLIT, (F.col("lines") + F.col("at") - F.col("first") + 1).alias("line_no"), "line")


def scan(lines: DataFrame) -> DataFrame:
    """Adds token, tag, kind (null for a good line, else blank or why it is bad) and edge (hidden characters went). Most
    lines are two plain fields and a blank between, or nothing, and need no look at each character."""
    line, plain = F.col("line"), F.col("plain")
    fields = F.transform(T.chunks(line), lambda f: F.struct(f.alias("raw"), T.scan_invisible(f).alias("s")))
    rows = lines.withColumn("plain", line.rlike(PLAIN_LINE)).withColumn("f", F.when(~plain & (line != ""), fields))
    parts = F.transform(F.filter("f", lambda f: f["s"]["trimmed"] != ""), lambda f: f["s"]["trimmed"])
    inner = F.get(F.filter("f", lambda f: f["s"]["interior"].isNotNull()), 0)["s"]
    odd = F.col("f").isNotNull()
    rows = rows.withColumn("parts", F.when(plain, F.split(line, " ")).when(odd, parts).otherwise(F.array().cast("array<string>")))
    rows = rows.withColumn("edge", F.when(odd, F.exists("f", lambda f: f["s"]["trimmed"] != f["raw"])).otherwise(False)).withColumn("inner", F.when(odd, inner))
    tag = F.get("parts", 1)
    kind = (
        F.when(F.size("parts") == 0, "blank")
        .when(F.size("parts") != 2, "malformed")
        .when(F.col("inner").isNotNull(), F.when(tag.isin(*C.LABELS), "interior").otherwise("interior,unknown_tag"))
        .when(~tag.isin(*C.LABELS), "unknown_tag")
    )
    held = F.when(odd, F.size(F.filter("f", lambda f: f["s"]["interior"].isNotNull()))).otherwise(0)
    return rows.select(*lines.columns, F.get("parts", 0).alias("token"), tag.alias("tag"), kind.alias("kind"), "edge", F.size("parts").alias("n_fields"), F.col("inner")["interior"].alias("interior"), held.alias("n_interior"))


def diagnostics(lines: DataFrame) -> DataFrame:
    """(path, line_no, kind, detail): edge, malformed, interior and unknown_tag findings."""
    rows = scan(lines)
    code = F.concat(F.lit("U+"), F.lpad(F.hex(F.ascii("interior").cast("long")), 4, "0"))
    found = F.array_compact(
        F.array(
            F.when(F.col("edge"), F.struct(F.lit("edge").alias("kind"), F.col("line").alias("detail"))),
            F.when(F.col("kind") == "malformed", F.struct(F.lit("malformed").alias("kind"), F.concat(F.lit("expected 'token TAG' but found "), F.col("n_fields").cast("string"), F.lit(" field(s)")).alias("detail"))),
            F.when(F.col("kind").startswith("interior"), F.struct(F.lit("interior").alias("kind"), code.alias("detail"))),
            F.when(F.col("kind").endswith("unknown_tag"), F.struct(F.lit("unknown_tag").alias("kind"), F.col("tag").alias("detail"))),
        )
    )
    return rows.select("path", "line_no", F.explode(found).alias("d")).select("path", "line_no", "d.kind", "d.detail")


def summary(found: DataFrame) -> DataFrame:
    """(kind, n) of diagnostics."""
    return found.groupBy("kind").agg(F.count("*").alias("n"))


def frequent_unknown_tags(found: DataFrame, most: int = 10) -> DataFrame:
    """(tag, n): the most frequent unknown tags; of equal counts the one seen first."""
    tags = found.filter("kind = 'unknown_tag'").groupBy("detail").agg(F.count("*").alias("n"), F.min(F.struct("path", "line_no")).alias("first"))
    return tags.orderBy(F.desc("n"), "first").limit(most).select(F.col("detail").alias("tag"), "n")


def label_id(tag: Column) -> Column:
    return F.coalesce(F.array_position(F.array(*map(F.lit, C.LABELS)), tag) - 1, F.lit(-1)).cast("int")


#: Counters of a reading pass, over rows of `scan`.
COUNTERS = {
    "lines": F.count,
    "edge_lines": lambda one: F.count(F.when(F.col("edge"), one)),
    "malformed_lines": lambda one: F.count(F.when(F.col("kind") == "malformed", one)),
    "interior_fields": lambda one: F.coalesce(F.sum(F.when(F.col("kind").startswith("interior"), F.col("n_interior"))), F.lit(0)),
    "unknown_tags": lambda one: F.count(F.when(F.col("kind").endswith("unknown_tag"), one)),
    "words": lambda one: F.count(F.when(_is_word(), one)),
    "entity_words": lambda one: F.count(F.when(_is_word() & (label_id(F.col("tag")) > 0), one)),
}


def _is_word() -> Column:
    return F.col("kind").isNull() | ~F.col("kind").isin("blank", "malformed")


def counters() -> list[Column]:
    return [count(F.lit(1)).alias(name) for name, count in COUNTERS.items()]


def verdict(found: dict[str, int]) -> str | None:
    """What a summary says of a file as a whole: `all_malformed` and `empty` have no sample, `all_o` no entity."""
    if not found["words"]:
        return "all_malformed" if found["malformed_lines"] else "empty"
    return None if found["entity_words"] else "all_o"


def parse(spark: SparkSession, path: str, strict: bool = True) -> tuple[DataFrame, dict[str, int]]:
    """Parts of samples as a stored table, and the lines' counters, gathered by the pass that writes it."""
    seen = Observation("conll")
    rows = scan(split_lines(spark, path)).observe(seen, *counters())
    stored = materialize(parts_of(rows, "at"), "conll-parts")
    found = seen.get
    if strict and found["malformed_lines"] + found["interior_fields"] + found["unknown_tags"]:
        raise ValueError(first_bad(spark, path))
    return stored, found


def first_bad(spark: SparkSession, path: str) -> str:
    """What is wrong with the first bad line; the files are read again for it."""
    bad = scan(read_lines(spark, path)).filter("kind is not null and kind <> 'blank'")
    row = bad.orderBy("path", "line_no").select("path", "line_no", "kind", "line").first()
    return f"{row['path']}:{row['line_no']}: {row['kind']} in line {row['line']}"


def cut_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cuts each batch of lines (path, block, at, token, label, blank) into parts: a run is lines of one block whose places
    rise by one, and a part begins with a run or a blank line. Label is null for lines without a word."""
    for batch in batches:
        n = batch.num_rows
        if n == 0:
            continue
        path, block, at, token, label, blank = batch.columns
        marks = path.dictionary_encode(null_encoding="encode").indices
        steps = [np.diff(x.to_numpy(zero_copy_only=False)) for x in (marks, block, at)]
        first = np.concatenate([[True], (steps[0] != 0) | (steps[1] != 0) | (steps[2] != 1)])
        blank, word = blank.to_numpy(zero_copy_only=False), label.is_valid()
        begin = np.flatnonzero(first | blank)
        run = np.flatnonzero(first)[np.cumsum(first)[begin] - 1]
        before = np.cumsum(blank)
        closed = np.append((blank & ~first)[begin[1:]], False)  # by a blank line of the same run
        ends = np.concatenate([[0], np.cumsum(word.to_numpy(zero_copy_only=False))])[np.append(begin, n)]
        lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), x.filter(word)) for x in (token, label)]
        made = [path.take(pa.array(begin)), block.take(pa.array(begin)), at.take(pa.array(run)), at.take(pa.array(begin)), pa.array(before[begin] - before[run] + blank[run]), pa.array(blank[begin] & closed), *lists]
        yield pa.RecordBatch.from_arrays(made, ["path", "block", "run", "at", "blanks", "whole", "words", "labels"])


def parts_of(rows: DataFrame, order: str) -> DataFrame:
    """Parsed lines as parts of samples, `PARTS`: what stands between blank lines, cut where a run of lines ends (a batch, at
    most). A part is told by its run and the blank lines of the run up to it; a whole one has its sample to itself. The lines
    may come in any order, but those in a row make the longer runs."""
    label = F.when(_is_word(), F.greatest(label_id(F.col("tag")), F.lit(0)))
    blank = F.coalesce(F.col("kind") == "blank", F.lit(False))
    lines = rows.select("path", F.col("block").cast("long").alias("block"), F.col(order).cast("long").alias("at"), "token", label.alias("label"), blank.alias("blank"))
    return lines.mapInArrow(cut_parts, PARTS)


def group_samples(parts: DataFrame, order: str = "at") -> DataFrame:
    """(path, sample, words, labels) of stored parts; only samples with words. `sample` is the blank lines of the file before
    it: those of its run, and those of earlier runs, of which there is a row each. Only cut samples are grouped."""
    before = Window.partitionBy("path").orderBy("block", "run").rowsBetween(Window.unboundedPreceding, -1)  # a row a run
    runs = parts.groupBy(*RUN).agg(F.max("blanks").alias("n")).select(*RUN, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    rows = parts.filter(F.size("words") > 0).join(runs, RUN).withColumn("sample", F.col("base") + F.col("blanks"))
    place = F.struct("block", F.col(order).alias("at"), "words", "labels")
    cut = rows.filter("not whole").groupBy("path", "sample").agg(F.array_sort(F.collect_list(place)).alias("t"))  # of one sample
    joined = [F.flatten(F.transform("t", lambda t: t[c])).alias(c) for c in ("words", "labels")]  # noqa: B023
    return rows.filter("whole").select("path", "sample", "words", "labels").union(cut.select("path", "sample", *joined))


def samples_of(lines: DataFrame, strict: bool = True) -> DataFrame:
    """(path, sample, words, labels) of lines (path, line_no, line), as they are at hand; block: of a split, if known. Their
    parts are stored, as they are read more than once."""
    rows = scan(lines if "block" in lines.columns else lines.withColumn("block", F.lit(0)))
    if strict:
        message = F.concat("path", F.lit(":"), F.col("line_no").cast("string"), F.lit(": "), "kind", F.lit(" in line "), "line")
        rows = rows.withColumn("kind", F.when(F.col("kind") != "blank", F.raise_error(message).cast("string")).otherwise(F.col("kind")))
    return group_samples(materialize(parts_of(rows, "line_no"), "conll-parts"))


def load_conll(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """(path, sample, words, labels); sample counts a file's blank lines."""
    return group_samples(parse(spark, path, strict)[0])


def sample_text(words: Column, tags: Column) -> Column:
    """The lines of a sample, with the line end of its last one; the writer adds the blank line's."""
    return F.concat(F.array_join(F.zip_with(words, tags, lambda w, t: F.concat(w, F.lit(" "), t)), "\n"), F.lit("\n"))


def write_conll(samples: DataFrame, path: str) -> None:
    """Files of samples (words, labels)."""
    names = F.array(*map(F.lit, C.LABELS))
    text = sample_text(F.col("words"), F.transform("labels", lambda i: F.get(names, i)))
    samples.select(text.alias("value")).write.text(path)
