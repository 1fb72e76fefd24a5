"""Benchmark decontamination with an FM-index for each training shard.

A task gathers whole documents into shards, maps their words to the benchmark's vocabulary and joins the runs
of known words that are long enough to hold a test phrase (anything else cannot match). Over that text it
builds suffix array, Burrows-Wheeler transform, wavelet matrix and sampled suffix positions. All test phrases
are searched backward together; occurrences are located through the samples and merged into removal spans.

The benchmark goes to the tasks in blocks of at most about `block_bytes` of text (checked), one pass over the texts for
each block. With one block nothing is shuffled. With more, each pass writes a table of the distinct texts that it hits
(two hashes, spans, items), and these tables are joined to the rows: driver and tasks hold one block at a time, and a
task runs one Python worker, however large the benchmark.

Defined cases: a null text, in either table, has no words; a document without words is clean; benchmark items
without words never match; items of fewer words than a window are one window; rows repeated stay repeated;
a null item_id counts as the empty string; texts of any length are searched whole, each within one shard; an empty
table gives no rows, an empty benchmark clean ones; columns named like the added ones are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapline.llm.common import ALNUM_WORDS, chunks_by_bytes, encode, materialize

WINDOW, SAMPLE, SHARD_BYTES, BLOCK_BYTES = 13, 32, 8_000_000, 4_000_000


def suffix_array(text: np.ndarray) -> np.ndarray:
    """By prefix doubling; ends when all ranks differ. The text ends with a unique smallest symbol."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    order = np.argsort(rank, kind="stable")
    step = 1
    while True:
        following = np.zeros(n, np.int64)
        following[: n - step] = rank[step:] + 1
        key = rank * (n + 1) + following
        order = np.argsort(key)
        ordered = key[order]
        fresh = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        rank[order] = fresh
        if fresh[-1] == n - 1 or step >= n:
            return order
        step *= 2


class WaveletMatrix:
    def __init__(self, values: np.ndarray, bits: int):
        self.bits, self.ones, self.zeros = bits, [], []
        for b in range(bits - 1, -1, -1):
            bit = values >> b & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]).astype(np.int64))
            self.zeros.append(len(values) - int(self.ones[-1][-1]))
            values = np.concatenate([values[bit == 0], values[bit == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before its place."""
        begin = np.zeros_like(at)
        for level, b in enumerate(range(self.bits - 1, -1, -1)):
            ones, zeros = self.ones[level], self.zeros[level]
            one = (symbol >> b & 1).astype(bool)
            below, here = ones[begin], ones[at]
            begin, at = np.where(one, zeros + below, begin - below), np.where(one, zeros + here, at - here)
        return at - begin


class FMIndex:
    def __init__(self, text: np.ndarray, symbols: int, sample: int = SAMPLE):
        """text: symbols from 1; the end symbol 0 is appended here."""
        text = np.concatenate([text, [0]]).astype(np.int64)
        places = suffix_array(text)
        self.bwt = text[places - 1]
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols))])
        self.tree = WaveletMatrix(self.bwt, max(1, int(symbols - 1).bit_length()))
        self.sampled = places % sample == 0
        self.sampled_rank = np.concatenate([[0], np.cumsum(self.sampled)])
        self.samples = places[self.sampled]
        self.size = len(text)

    def step(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self.before[symbol] + self.tree.rank(symbol, at)

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffix range of each phrase (right-aligned rows of symbols), all phrases a symbol at a time."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.size, np.int64)
        for k in range(phrases.shape[1]):
            live = np.flatnonzero((lengths > k) & (low < high))
            if not len(live):
                break
            symbol = phrases[live, -1 - k]
            low[live], high[live] = self.step(symbol, low[live]), self.step(symbol, high[live])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: walk back to the next sampled one."""
        out, rows, moved = np.zeros(len(rows), np.int64), rows.copy(), np.zeros(len(rows), np.int64)
        open_rows = np.arange(len(rows))
        while len(open_rows):
            here = rows[open_rows]
            done = self.sampled[here]
            out[open_rows[done]] = self.samples[self.sampled_rank[here[done]]] + moved[open_rows[done]]
            open_rows, here = open_rows[~done], here[~done]
            rows[open_rows] = self.step(self.bwt[here], here)
            moved[open_rows] += 1
        return out


class Phrases:
    """The windows of a block of benchmark items: right-aligned rows of words, and the items of each. Equal windows are
    one row (or, if others with the same hash lie between them, more than one, which changes nothing)."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        self.names = [item for item, _ in items]
        words = [[self.vocabulary.setdefault(w, len(self.vocabulary) + 2) for w in text.translate(ALNUM_WORDS).split()] for _, text in items]
        counts = np.array([len(w) for w in words], np.int64)
        sizes = np.minimum(counts, window)
        times = np.where(counts > 0, counts - sizes + 1, 0)
        flat = np.concatenate([np.zeros(window, np.int32), *(np.array(w, np.int32) for w in words)])
        owner = np.repeat(np.arange(len(words)), times)
        end = np.repeat(window + np.cumsum(counts) - counts + sizes, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        rows = np.lib.stride_tricks.sliding_window_view(flat, window)[end - window].copy()
        lengths = sizes[owner]
        rows[np.arange(window) < window - lengths[:, None]] = 0
        mixed = np.zeros(len(rows), np.uint64)
        for k in range(window):
            mixed = (mixed ^ rows[:, k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
        order = np.argsort(mixed, kind="stable")
        rows = rows[order]
        first = np.flatnonzero(np.concatenate([[True], (rows[1:] != rows[:-1]).any(1)])) if len(rows) else np.zeros(0, np.int64)
        self.rows, self.lengths = rows[first], lengths[order][first]
        self.owners, self.begin = owner[order], np.append(first, len(rows))
        self.symbols = len(self.vocabulary) + 2
        self.shortest = int(self.lengths.min()) if len(first) else 0

    def items(self, row: int) -> list[str]:
        return [self.names[k] for k in self.owners[self.begin[row] : self.begin[row + 1]]]


def find_spans(texts: list[bytes], phrases: Phrases) -> tuple[list[int], list[list[tuple[int, int]]], list[set[str]]]:
    """Of each text of a shard: its words, the spans of words within any occurrence, the items that occur."""
    get, parts, counts = phrases.vocabulary.get, [], []
    for text in texts:
        words = text.translate(ALNUM_WORDS).split()
        ids = np.fromiter((get(w, 1) for w in words), np.int32, len(words))
        parts += (ids, [1])  # symbol 1: any unknown word, and the end of a document
        counts.append(len(words))
    spans: list[list[tuple[int, int]]] = [[] for _ in texts]
    items: list[set[str]] = [set() for _ in texts]
    if not len(phrases.lengths) or not texts:
        return counts, spans, items
    flat = np.concatenate(parts)
    edge = np.flatnonzero(np.diff(np.concatenate([[0], (flat > 1).view(np.int8), [0]])))
    begin, end = edge[::2], edge[1::2]
    long_enough = end - begin >= phrases.shortest
    begin, end = begin[long_enough], end[long_enough]
    if not len(begin):
        return counts, spans, items
    sizes = end - begin + 1  # with the separator behind it
    places = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(begin, sizes)
    index = FMIndex(flat[places], phrases.symbols)
    low, high = index.search(phrases.rows, phrases.lengths)
    some = np.flatnonzero(high > low)
    times = (high - low)[some]
    rows = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(low[some], times)
    which = np.repeat(some, times)
    at = places[index.locate(rows)]
    covered = np.zeros(len(flat) + 1, np.int64)
    np.add.at(covered, at, 1)
    np.add.at(covered, at + phrases.lengths[which], -1)
    hit = np.flatnonzero(np.diff(np.concatenate([[0], (np.cumsum(covered)[:-1] > 0).view(np.int8), [0]])))
    starts = np.cumsum([0, *(c + 1 for c in counts)])
    for a, b in zip(hit[::2].tolist(), hit[1::2].tolist()):
        d = int(np.searchsorted(starts, a, "right")) - 1
        spans[d].append((a - int(starts[d]), b - int(starts[d])))
    owner = np.searchsorted(starts, at, "right") - 1
    for d, w in np.unique(np.stack([owner, which]), axis=1).T.tolist() if len(at) else []:
        items[d].update(phrases.items(w))
    return counts, spans, items


def merge_spans(*groups) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted((int(a), int(b)) for g in groups for a, b in g):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def benchmark_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[str, bytes]]]:
    """The items in blocks whose text is about `block_bytes` each; the size is measured first."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.coalesce("text", F.lit("")).alias("text"))
    total = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    blocks = 1 + int(total // block_bytes)
    for block in range(blocks):
        part = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block)
        yield [(r["item"], encode(r["text"])) for r in part.collect()]


SPANS = "array<struct<begin:int,end:int>>"
EXTRA = {"n_words": "long", "spans": SPANS, "items": "array<string>"}


def searched(texts: DataFrame, block: list[tuple[str, bytes]], window: int, shard_bytes: int, only_hits: bool = False) -> DataFrame:
    """Adds n_words, spans (of word places, merged) and items (sorted) to rows with a text, which goes if only rows
    with spans are asked for."""
    held = texts.sparkSession.sparkContext.broadcast((block, window))  # about a block's bytes
    kept = [f for f in texts.schema if not (only_hits and f.name == "text")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        phrases = Phrases(*held.value)
        for rows in batches:
            found = [encode(t) for t in rows["text"]]
            counts, spans, items = [], [], []
            for part in chunks_by_bytes([len(t) for t in found], shard_bytes):
                for whole, some in zip((counts, spans, items), find_spans(found[part], phrases)):
                    whole += some
            out = rows.assign(n_words=counts, spans=[as_structs(merge_spans(s)) for s in spans], items=[sorted(x) for x in items])
            yield out[out["spans"].map(len) > 0].drop(columns="text") if only_hits else out

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [f"{k} {v}" for k, v in EXTRA.items()])
    return texts.mapInPandas(run, schema)


def as_structs(spans: list[tuple[int, int]]) -> list[dict[str, int]]:
    return [{"begin": a, "end": b} for a, b in spans]


def together(rows: DataFrame) -> DataFrame:
    """The spans and items of all passes merged for each text; __spans and __items hold a list a pass."""
    kept = [f for f in rows.schema if not f.name.startswith("__")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for found in batches:
            counts = [len(encode(t).translate(ALNUM_WORDS).split()) for t in found["text"]]
            spans = [as_structs(merge_spans(*([(x["begin"], x["end"]) for x in p] for p in (passes if passes is not None else ())))) for passes in found["__spans"]]
            items = [sorted({x for p in (passes if passes is not None else ()) for x in p}) for passes in found["__items"]]
            yield found[[f.name for f in kept]].assign(n_words=counts, spans=spans, items=items)

    return rows.mapInPandas(run, ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [f"{k} {v}" for k, v in EXTRA.items()]))


def removal_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Adds n_words, spans (of word places, merged) and items (sorted) to all columns of `docs`."""
    own = docs.select(*[c for c in docs.columns if c not in EXTRA])
    blocks = benchmark_blocks(benchmark, block_bytes)
    first, more = next(blocks), next(blocks, None)
    if more is None:
        return searched(own, first, window, shard_bytes)
    keys = [F.xxhash64("text").alias("__a"), F.xxhash64(F.lit(1), "text").alias("__b")]
    texts, passes, block = own.select("text", *keys), [], first
    while block is not None:
        hits = searched(texts, block, window, shard_bytes, only_hits=True).drop("n_words").dropDuplicates(["__a", "__b"])
        passes.append(materialize(hits, "benchmark-hits"))
        block, more = more, next(blocks, None)
    # a row a pass and text
    found = reduce(DataFrame.unionByName, passes).groupBy("__a", "__b").agg(F.collect_list("spans").alias("__spans"), F.collect_list("items").alias("__items"))
    return together(own.select("*", *keys).join(found, ["__a", "__b"], "left"))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """`docs` with n_words, n_hit, n_items, items_sha256, contaminated, spans and items."""
    found = removal_spans(docs, benchmark, window)
    found = found.withColumn("n_hit", F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + (s["end"] - s["begin"])))
    return found.withColumns(
        {
            "n_items": F.size("items").cast("long"),
            "items_sha256": F.sha2(F.array_join("items", ",").cast("binary"), 256),
            "contaminated": (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")),
        }
    )
