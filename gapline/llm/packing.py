"""Best-fit packing by exact-complement hashing.

Lengths lie between 1 and the capacity, so the corpus is summed up in a histogram of at most that many counts.
The plan is made on it: combinations of one, two or three lengths that exactly fill a gap are consumed as often
as their counts allow, and what is left is packed best-fit, longest first. A plan row puts a run of ranks of
one length into consecutive sequences. Pieces get their rank in their length from salted counts and a prefix
sum over the salts; a length gets as many salts as its count asks for, so no length, however frequent, is gathered in
one task.

Defined cases: a null or empty text is one piece, the end id alone; a text of over `capacity` ids is cut into
pieces of `capacity` ids, of which the first may be shorter; repeated rows and null ids are packed like others;
an empty table gives no rows.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gapline.llm.common import materialize, single_thread

CAPACITY, END_ID, CELL_ROWS, MOST_SENT = 2048, 0, 200_000, 1_000_000


class Encoder:
    """Ids of the byte-level vocabulary. Two libraries read the same vocabulary: the rank file's reader is
    several times as fast; texts with characters whose classes the libraries may see differently, or with one of the
    vocabulary's special tokens, go to the other."""

    def __init__(self, json_path: str, ranks_path: str):
        single_thread()
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks_path, "rb"))}
        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.plain = regex.compile(r"[\x00-\x7f\xa1-ɏ‐-‧€]*")
        self.slow = Tokenizer.from_file(json_path)
        special = [regex.escape(token.content) for token in self.slow.get_added_tokens_decoder().values()]
        self.special = regex.compile("|".join(special) if special else r"(?!)")

    def encode(self, text: str | None) -> np.ndarray:
        text = text or ""
        if self.plain.fullmatch(text) and not self.special.search(text):
            ids = self.fast.encode_ordinary(text)
        else:
            ids = self.slow.encode(text, add_special_tokens=False).ids
        ids.append(END_ID)
        return np.array(ids, "<u4")


def pieces(docs: DataFrame, capacity: int = CAPACITY, json_path: str | None = None, ranks_path: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) for each piece of each row."""
    json_path = json_path or public_tokenizers.path("byte_bpe_50k.json")
    ranks_path = ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = Encoder(json_path, ranks_path)
        for rows in batches:
            out, known = [], {}
            for doc, text in zip(rows["doc_id"], rows["text"]):
                if text not in known:
                    ids = encoder.encode(text)
                    count = -(-len(ids) // capacity)
                    cuts = [0, *(len(ids) - capacity * (count - k) for k in range(1, count)), len(ids)]
                    known[text] = [(k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
                out += [(doc, *p) for p in known[text]]
            yield pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def _fill_exact(count: np.ndarray, first: int, parts: int) -> Iterator[tuple[tuple[int, ...], int]]:
    """Combinations of `first` and at most `parts` more that exactly fill the capacity, with how often each is
    taken; lowers the counts."""
    capacity = len(count) - 1

    def take(*lengths: int) -> tuple[tuple[int, ...], int]:
        need = {x: lengths.count(x) for x in lengths}
        times = min(int(count[x]) // n for x, n in need.items())
        for x, n in need.items():
            count[x] -= times * n
        return lengths, times

    gap = capacity - first
    if gap == 0:
        yield take(first)
        return
    if count[gap] >= 1 + (gap == first):
        yield take(first, gap)
    while parts > 1 and count[first]:  # pairs: both halves of the gap at hand
        half = np.arange(1, gap // 2 + 1)
        fits = half[(count[half] > 0) & (count[gap - half] > 0)]
        made = 0
        for a in fits[::-1].tolist():
            got = take(first, gap - a, a)
            made += got[1]
            if got[1]:
                yield got
            if not count[first]:
                break
        if not made:
            break
    for a in range(gap - 2, 0, -1) if parts > 2 else ():  # triples: a, then a pair that fills what is left, a at least as long as both
        if not count[first]:
            return
        if not count[a]:
            continue
        rest = gap - a
        half = np.arange(1, rest // 2 + 1)
        half = half[rest - half <= a]
        for b in half[(count[half] > 0) & (count[rest - half] > 0)][::-1].tolist():
            got = take(first, a, rest - b, b)
            if got[1]:
                yield got
            if not count[first] or not count[a]:
                break


def _patterns(histogram: dict[int, int], capacity: int, parts: int) -> list[tuple[tuple[int, ...], int]]:
    """Sequences as lengths, with how many there are of each: exact fills first, then best-fit, longest first."""
    count = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        count[length] = n
    patterns: list[tuple[tuple[int, ...], int]] = []
    for first in range(capacity, 0, -1):
        if count[first]:
            patterns += [p for p in _fill_exact(count, first, parts) if p[1]]
    open_by_gap: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    for length in range(capacity, 0, -1):
        left = int(count[length])
        while left:
            gap = next((g for g in range(length, capacity) if open_by_gap.get(g)), None)
            if gap is None:
                each = min(capacity // length, left)
                times, left = left // each, left % each
                pattern = (length,) * each
            else:
                pattern, times = open_by_gap[gap].pop()
                if times > left:
                    open_by_gap[gap].append((pattern, times - left))
                    times = left
                left -= times
                pattern = (*pattern, length)
            open_by_gap.setdefault(capacity - sum(pattern), []).append((pattern, times))
    return patterns + [p for group in open_by_gap.values() for p in group]


def make_plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Rows (length, first rank, times, first sequence, offset): `times` pieces from that rank on go to as many
    consecutive sequences, each at that offset. Sequences are numbered from 0 without gaps. Exact fills of many
    parts can use up the short pieces that long ones need, so the fewest sequences of three plans win: fills by
    single lengths, by pairs too, and by triples too."""
    plans = [_patterns(histogram, capacity, parts) for parts in (3, 2, 1)]
    patterns = min(plans, key=lambda plan: sum(times for _, times in plan))
    rows, used, sequence = [], dict.fromkeys(histogram, 0), 0
    for pattern, times in patterns:
        offset = 0
        for length in pattern:
            rows.append((length, used[length], times, sequence, offset))
            used[length] += times
            offset += length
        sequence += times
    return rows


def pack(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Every piece with sequence_id and offset. What the driver sees is the histogram: at most `capacity` counts."""
    cut = materialize(pieces(docs, capacity), "pieces")
    histogram = {r[0]: r[1] for r in cut.groupBy("length").agg(F.count("*")).collect()}
    salts = [(length, -(-n // CELL_ROWS)) for length, n in histogram.items()]
    cells_in_all = sum(n for _, n in salts)
    salts = docs.sparkSession.createDataFrame(salts, "length long, salts long")
    cut = cut.join(F.broadcast(salts), "length")  # capacity rows at most
    cut = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("salts"))).drop("salts")
    cells = cut.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    cells = materialize(cells.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))), "length-cells")
    plan: dict[int, tuple[np.ndarray, ...]] = {}
    for length, *row in make_plan(histogram, capacity):
        plan.setdefault(length, []).append(row)
    plan = {k: tuple(np.array(x) for x in zip(*sorted(v))) for k, v in plan.items()}
    held = docs.sparkSession.sparkContext.broadcast(plan)

    cells = cells.select("length", "salt", "base")
    ranked = cut.join(F.broadcast(cells) if cells_in_all <= MOST_SENT else cells, ["length", "salt"])
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = ranked.withColumn("rank", F.col("base") + F.row_number().over(within) - 1).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "rank"
    )

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            sequence, offset = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
            lengths, ranks = rows["length"].to_numpy(), rows["rank"].to_numpy()
            for length in np.unique(lengths):
                at = np.flatnonzero(lengths == length)
                first, _, sequences, offsets = held.value[int(length)]
                row = np.searchsorted(first, ranks[at], "right") - 1
                sequence[at] = sequences[row] + ranks[at] - first[row]
                offset[at] = offsets[row]
            yield rows.drop(columns="rank").assign(sequence_id=sequence, offset=offset)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return ranked.mapInPandas(place, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
