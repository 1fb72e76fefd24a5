"""Token labels: word windows, seams between them, one label a word, and entities from labels.

Tokens are rows (doc_key, pos, word, glued), pos from 0. Labels of windows are rows (doc_key, win, pos, label) of
the words that are not `O`; words that a window has no row for count as `O`. A labeller that works word by word inside a
task needs no such rows: `words_of`, `merged` and `spans_of` say the same of one document.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gapline import constants as C
from gapline.functions import text as T

WINDOWS = "array<struct<start:int,end:int>>"


def tokens(docs: DataFrame) -> DataFrame:
    """(doc_key, pos, word, glued) of (doc_key, text); glued: a dot flush against the next word."""
    zipped = F.arrays_zip(T.tokenize(F.col("text")).alias("word"), T.dot_glue(F.col("text")).alias("glued"))
    return docs.select("doc_key", F.posexplode(zipped).alias("pos", "t")).select("doc_key", "pos", "t.word", "t.glued")


_TOKEN, _FLUSH_DOT = re.compile(C.TOKEN_PATTERN), re.compile(rf"(\.(?=\S))|{C.TOKEN_PATTERN}")


def words_of(text: str) -> tuple[list[str], list[bool]]:
    """`tokens` of one text: its words, and which of them are glued."""
    words = _TOKEN.findall(text)
    return words, [dot != "" for dot in _FLUSH_DOT.findall(text)] if "." in words else [False] * len(words)


def subwords(word: str) -> int:
    """`subword_lengths` of one word of a text: hidden characters are words of their own."""
    return 0 if len(word) == 1 and unicodedata.category(word) in ("Cf", "Cc") else (len(word) + 3) // 4


def subword_lengths(words: Column) -> Column:
    """Stand-in for a tokenizer's counts: a subword for each four characters; none for hidden characters alone."""
    return F.transform(words, lambda w: F.when(w.rlike(rf"^{T.HIDDEN}+$"), 0).otherwise(F.ceil(F.char_length(w) / 4)).cast("int"))


def _plan(lengths: np.ndarray, budget: int, most_overlap: int) -> list[dict[str, int]]:
    n = len(lengths)
    if n and int(lengths.sum()) <= budget:
        return [{"start": 0, "end": n}]
    total = np.concatenate([[0], np.cumsum(lengths)])

    def fill(start: int) -> int:
        """The end of the window from `start`: as many words as the budget holds, one at least."""
        return max(start + 1, int(np.searchsorted(total, total[start] + budget, "right")) - 1)

    out, start = [], 0
    while n:
        end = min(fill(start), n)
        out.append({"start": start, "end": end})
        if end == n:
            break
        overlap = min(most_overlap, (end - start) // 2)
        while overlap and fill(end - overlap) <= end:
            overlap //= 2
        start = end - overlap
    return out


def plan_windows(lengths: Column, budget: int = C.MOST_SUBWORDS - C.SPECIAL_SUBWORDS, most_overlap: int = C.OVERLAP_WORDS) -> Column:
    """Overlapping windows of words within the subword budget; the overlap is halved while it gains no new word."""

    @F.pandas_udf(WINDOWS)
    def plan(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([None if x is None else _plan(np.asarray(x, np.int64), budget, most_overlap) for x in batch], dtype=object)

    return plan(lengths)


def window_rows(plans: DataFrame) -> DataFrame:
    """(doc_key, win, start, end) of (doc_key, windows)."""
    return plans.select("doc_key", F.posexplode("windows").alias("win", "w")).select("doc_key", "win", "w.start", "w.end")


def with_cuts(windows: DataFrame, labels: DataFrame, radius: int) -> DataFrame:
    """Windows (doc_key, win, start, end) with `named`, their words that are not O as an array of (pos, label), and `cut`,
    null for a document's last window. A row is a window with its own words only. Both tables are dealt by document once
    and never joined, so that no plan can send labels to the driver, however few rows it takes them for."""
    marks = labels.filter("label <> 'O'").select("doc_key", "win", F.struct("pos", "label").alias("named"))
    rows = windows.select("doc_key", "win", "start", "end").unionByName(marks, allowMissingColumns=True)
    rows = rows.repartition("doc_key").groupBy("doc_key", "win").agg(F.max("start").alias("start"), F.max("end").alias("end"), F.collect_list("named").alias("named"))  # of one window
    own = Window.partitionBy("doc_key").orderBy("win")
    both = rows.filter("start is not null").withColumn("lo", F.lead("start").over(own)).withColumn("then", F.lead("named").over(own)).withColumnRenamed("end", "hi")
    both = both.withColumn("mid", F.expr("(lo + hi) div 2").cast("int")).withColumn("r", F.least(F.lit(radius), F.expr("(hi - lo) div 4").cast("int")))
    inside = F.sequence(F.greatest("lo", F.col("mid") - F.col("r")), F.least(F.col("hi") - 1, F.col("mid") + F.col("r")))
    free = F.array_except(F.array_except(inside, F.col("named.pos")), F.col("then.pos"))
    ranked = F.transform(free, lambda p: F.struct(F.abs(p - F.col("mid")).alias("far"), p.alias("pos")))
    both = both.withColumn("cut", F.coalesce(F.when(F.col("hi") > F.col("lo"), F.array_min(ranked)["pos"]), "mid"))
    last = F.max("cut").over(own.rowsBetween(Window.unboundedPreceding, 0))
    return both.select("doc_key", "win", "start", F.col("hi").alias("end"), "named", F.when(F.col("lo").isNotNull(), last).alias("cut"))


def seams(windows: DataFrame, labels: DataFrame, radius: int = C.SEAM_RADIUS) -> DataFrame:
    """(doc_key, win, cut): where window `win` hands over to the next one: of the words near the middle of their
    overlap that both call O the nearest (the left one of two), else the middle; cuts never go back."""
    return with_cuts(windows, labels, radius).filter("cut is not null").select("doc_key", "win", "cut")


def merge_labels(windows: DataFrame, labels: DataFrame, radius: int = C.SEAM_RADIUS) -> DataFrame:
    """(doc_key, pos, label): each word's label from the one window that owns it; words called O have no row."""
    own = Window.partitionBy("doc_key").orderBy("win")
    owned = with_cuts(windows, labels, radius)
    owned = owned.select("doc_key", F.coalesce(F.lag("cut").over(own), "start").alias("lo"), F.coalesce("cut", "end").alias("hi"), "named")
    return owned.select("doc_key", "lo", "hi", F.inline("named")).filter("pos >= lo and pos < hi").select("doc_key", "pos", "label")


def merged(windows: list[dict[str, int]], labels: list[list[str]], radius: int = C.SEAM_RADIUS) -> list[str]:
    """`merge_labels` of one document: its labels from those of its windows, in order."""
    out: list[str] = []
    for j, (win, said) in enumerate(zip(windows, labels)):
        cut = hi = win["end"]
        if j + 1 < len(windows):
            lo, then = windows[j + 1]["start"], labels[j + 1]
            cut = mid = (lo + hi) // 2
            r = min(radius, (hi - lo) // 4)
            if hi > lo:
                free = [p for p in range(max(lo, mid - r), min(hi - 1, mid + r) + 1) if said[p - win["start"]] == then[p - lo] == "O"]
                cut = min(free, key=lambda p: (abs(p - mid), p), default=mid)
        out += said[len(out) - win["start"] : max(cut - win["start"], 0)]
    return out


def spans_of(words: list[str], glued: list[bool], labels: list[str]) -> list[tuple[str, int, str]]:
    """(category, ord, span): `clean_spans` of `group_words` of one document."""
    out, seen, i, n = [], set(), 0, len(words)
    dots = True in glued
    while i < n:
        if labels[i] == "O":
            i += 1
            continue
        first, kind = i, labels[i][2:]
        i += 1
        while i < n and labels[i][0] == "I" and labels[i][2:] == kind:
            i += 1
        # words of punctuation at either end go, but for dots flush before a word that stays
        a, b = first, i - 1
        while a <= b and not words[a][0].isalnum():
            a += 1
        while b > a and not words[b][0].isalnum():
            b -= 1
        while dots and first < a <= b and glued[a - 1]:
            a -= 1
        span = "".join(w if dot else w + " " for w, dot in zip(words[a : b + 1], glued[a : b + 1]))[:-1] if dots else " ".join(words[a : b + 1])
        category = kind.lower()
        if span and (category, span.lower()) not in seen:
            seen.add((category, span.lower()))
            out.append((category, first, span))
    return out


def label_runs(labelled: DataFrame) -> DataFrame:
    """Adds `category` and `run` to rows (doc_key, pos, label) that are not O: a run is an entity. A B label
    starts one, as does an I label whose type is not that of the word before."""
    own = Window.partitionBy("doc_key").orderBy("pos")
    rows = labelled.filter("label <> 'O'").withColumn("category", F.lower(F.expr("substring(label, 3)")))
    joins = (F.lag("pos").over(own) == F.col("pos") - 1) & (F.lag("category").over(own) == F.col("category")) & F.col("label").startswith("I-")
    return rows.withColumn("run", F.sum(F.when(joins, 0).otherwise(1)).over(own))


def group_words(labelled: DataFrame) -> DataFrame:
    """(doc_key, category, ord, span) of rows (doc_key, pos, word, glued, label). ord: the first word's place; a
    glued dot is written without a space."""
    parts = F.array_sort(F.collect_list(F.struct("pos", "word", "glued")))  # of one entity
    runs = label_runs(labelled).groupBy("doc_key", "category", "run").agg(F.min("pos").alias("ord"), parts.alias("parts"))
    start = F.struct(F.lit("").alias("text"), F.lit(True).alias("flush"))
    step = lambda s, p: F.struct(F.concat(s["text"], F.when(s["flush"], F.lit("")).otherwise(F.lit(" ")), p["word"]).alias("text"), p["glued"].alias("flush"))
    return runs.select("doc_key", "category", "ord", F.aggregate("parts", start, step, lambda s: s["text"]).alias("span"))


def clean_spans(spans: DataFrame) -> DataFrame:
    """Trimmed of punctuation words, without empty ones; of spans equal but for case, the first of a category stays."""
    trimmed = spans.withColumn("span", T.trim_edge_punctuation(F.col("span"))).filter("span <> ''")
    first = trimmed.groupBy("doc_key", "category", F.lower("span").alias("__low")).agg(F.min(F.struct("ord", "span")).alias("item"))
    return first.select("doc_key", "category", "item.ord", "item.span")


def align_labels(labels: Column, lengths: Column, size: int) -> Column:
    """Label ids for subwords: the word's id at its first subword, else the ignored id; special tokens at both ends,
    cut or padded to `size`."""
    ignored = F.lit(C.IGNORED_LABEL)
    # a word with subwords has one at least, so that no more than size - 2 of them can show; nor more subwords of one
    some = F.filter(F.arrays_zip(labels.alias("l"), lengths.alias("n")), lambda z: z["n"] > 0)
    inner = F.flatten(F.transform(F.slice(some, F.lit(1), F.lit(size - 2)), lambda z: F.concat(F.array(z["l"]), F.array_repeat(ignored, F.least(z["n"], F.lit(size)) - 1))))
    whole = F.concat(F.array(ignored), F.slice(inner, F.lit(1), F.lit(size - 2)), F.array(ignored))
    return F.concat(whole, F.array_repeat(ignored, F.greatest(F.lit(size) - F.size(whole), F.lit(0))))


def argmax(scores: Column) -> Column:
    """Place of the largest score from 0; the first one of equal ones."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")
