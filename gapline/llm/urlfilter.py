"""URL filters as a sort-merge range join.

A rule (host, path) holds for a host and its subdomains where the url's path starts with the rule's. Every
distinct (host, path) of the urls is listed under each of its parent hosts that some rule names; its key is the
reversed parent host, a slash, and the path. A rule's key turns into an interval, all keys that it begins.
Rules and urls are sorted together in ranges of keys; a sweep keeps the stack of rules whose intervals are
open, whose top is the longest rule under that host. A rule's row goes to every range that its interval meets,
so ranges are swept independently, however many urls a host has.

Defined cases: a null url, or one without "://", has empty host and path and fits no rule unless one names
the empty host and path; rules with a null host are ignored, a null path counts as empty; among rules that fit,
the longest host and path wins, then the longer host, then block before allow; repeated rows stay repeated.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapline.llm.common import lower_ascii, materialize

#: (host, path, verdict)
RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]
DEFAULT_VERDICT = "allow"
ROWS_A_RANGE, MOST_RANGES = 200_000, 2000
END = "\U0010ffff"


def url_parts(pages: DataFrame) -> DataFrame:
    """All columns with host and path, which replace columns of those names."""
    at = F.instr("url", "://")
    rest = F.when(at > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return pages.withColumns({"host": lower_ascii(F.regexp_extract(rest, r"^([^/?#]*)", 1)), "path": F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)})


def reversed_host(host):
    return F.array_join(F.reverse(F.split(host, r"\.")), ".")


def parents(host):
    """The host and every host above it."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))


def sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by range, key, rules first; gives each url its innermost open rule."""
    stack: list[tuple[str, str, str, str]] = []
    now = None
    for rows in batches:
        out = []
        columns = (rows[c] for c in ("range", "key", "is_url", "parent", "host", "path", "verdict"))
        for where, key, is_url, parent, host, path, verdict in zip(*columns):
            if where != now:
                now, stack = where, []
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if not is_url:
                if not stack or stack[-1][0] != key:  # of equal keys the first stands
                    stack.append((key, parent, path, verdict))
            elif stack:
                out.append((host, path, *stack[-1][1:]))
        yield pd.DataFrame(out, columns=["host", "path", "rule_host", "rule_path", "verdict"])


def split_points(keys: DataFrame, rows_a_range: int) -> list[str]:
    """Keys between which ranges lie, from a sample of at most some ten thousand (they only set where ranges end)."""
    n = keys.count()
    ranges = min(MOST_RANGES, 1 + n // rows_a_range)
    if ranges == 1:
        return []
    sample = keys.sample(fraction=min(1.0, 20 * ranges / n), seed=5).limit(40 * ranges)
    found = sorted({r[0] for r in sample.collect()})
    return sorted({found[len(found) * k // ranges] for k in range(1, ranges)}) if found else []


def match(urls: DataFrame, rules: DataFrame, rows_a_range: int = ROWS_A_RANGE) -> DataFrame:
    """(host, path, rule, verdict) for each distinct (host, path) of `urls` that fits a rule."""
    rules = rules.filter("host is not null").select("host", F.coalesce("path", F.lit("")).alias("path"), "verdict")
    rules = rules.withColumn("key", F.concat(reversed_host(F.col("host")), F.lit("/"), "path"))
    listed = urls.select("host", "path").distinct().withColumn("parent", F.explode(parents(F.col("host"))))
    named = rules.select(F.col("host").alias("parent")).distinct()
    listed = listed.join(named, "parent", "left_semi")
    listed = materialize(listed.withColumn("key", F.concat(reversed_host(F.col("parent")), F.lit("/"), "path")), "url-keys")
    points = split_points(listed.select("key"), rows_a_range)

    @F.pandas_udf("int")
    def range_of(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(np.array(points, object), key.to_numpy(object), "right") if points else np.zeros(len(key)), dtype="int32")

    urls_side = listed.select(range_of("key").alias("range"), "key", F.lit(True).alias("is_url"), "parent", "host", "path", F.lit("").alias("verdict"))
    rules_side = rules.withColumn("range", F.explode(F.sequence(range_of("key"), range_of(F.concat("key", F.lit(END))))))
    rules_side = rules_side.select("range", "key", F.lit(False).alias("is_url"), F.col("host").alias("parent"), "host", "path", "verdict")
    ordered = urls_side.unionByName(rules_side).repartition("range").sortWithinPartitions("range", "key", "is_url", F.desc("verdict"))
    fits = ordered.mapInPandas(sweep, "host string, path string, rule_host string, rule_path string, verdict string")
    rank = F.struct(F.length(F.concat("rule_host", "rule_path")).alias("n"), F.length("rule_host").alias("h"), F.col("verdict").alias("v"))
    best = fits.groupBy("host", "path").agg(F.max_by(F.struct("rule_host", "rule_path", "verdict"), rank).alias("best"))
    return best.select("host", "path", F.concat("best.rule_host", "best.rule_path").alias("rule"), "best.verdict")


def judge(pages: DataFrame, rules: DataFrame, default: str = DEFAULT_VERDICT) -> DataFrame:
    """All columns of `pages` with host, path, rule and verdict."""
    parts = url_parts(pages.drop("rule", "verdict"))
    found = match(parts, rules).select(F.col("host").alias("__host"), F.col("path").alias("__path"), "rule", "verdict")
    joined = parts.join(found, (parts["host"] == found["__host"]) & (parts["path"] == found["__path"]), "left")
    return joined.drop("__host", "__path").withColumn("verdict", F.coalesce("verdict", F.lit(default)))
