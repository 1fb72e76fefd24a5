"""LM scoring by online logistic context mixing.

A text (A-Z lowered) is a sequence of words and one end, with gaps between them. Two kinds of bits are predicted.

*Which context codes the next word.* One bit a word says whether it has followed the word before it in any other
training text. If so it costs its share of what follows that word, else it is coded without context. Predictors over
hashed contexts (how often the word before was seen, the bits of up to twelve words before, how often the pairs before
were seen) give counts of zeros and ones, their logits are mixed by weights that a gate picks, the weights are learned
online, and an adaptive probability map refines the result.

*The bits of a word without context.* Predictors over hashed contexts of its last 1, 2, 3, 4 and 6 bytes are mixed
in the same way (the gate: bit place, contexts known, kind of unit). What they give is added to the word's share of the
training words, in the proportion that suits the training text best, and to a cache of the text's own words. These bits
end at the word's border, so they are worked out once for each distinct word, however often it occurs.

Online means that a text is predicted before it is learned. Rows have no order, so a training row is scored against the
counts of all *other* training rows: its own words and pairs are taken off. ``base_score`` counts all training rows.

Tasks turn their rows into blocks of about ``BLOCK_BYTES``, a row each: word ids of all its texts and a dictionary. Units
and pairs of words are counted by hash range, in as many pieces as the corpus's size asks for (``PIECE_BYTES`` of text
each): a block sends its units and its pairs' hashes, packed and sorted, and gets counts back in the same order.
Nothing that grows with the corpus is broadcast. With more than 2 ** ``FAN_BITS`` blocks or pieces they are sent in steps:
each step cuts what a node holds by a few more bits of the hash and merges the same cut of as many nodes, so that a node
stays as large as a block, and the most frequent words, which each block holds, become one before they go on; counts go
back through the same nodes. Rows are as many as blocks, times at most 2 ** ``FAN_BITS``, times the steps. A pair's
hash is so long that one in a million is taken for another. Only the spelling predictors have tables of bounded size: they
grow with the distinct units up to 2 ** ``MOST_SLOT_BITS`` slots for each order, one byte a count.

Defined cases: null is the empty text, which is one end; a null doc_id counts as empty for the choice of training
rows; repeated rows are scored alike and count each time; a text of more than a block is a block of its own; what tasks
learn is averaged by what each has read, so scores differ a little with the number of tasks, counts do not; without
training rows all counts are 0 and words are spelled; an empty table gives no rows; columns other than doc_id and text
are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapline.llm.common import LOWER_ASCII, chunks_by_bytes, crc_bucket, discard, encode, materialize

ORDERS = (1, 2, 3, 4, 6)
BLOCK_BYTES, PIECE_BYTES, LEAST_SLOT_BITS, MOST_SLOT_BITS, PIECE = 16_000_000, 32_000_000, 12, 22, 1 << 16
END, EMPTY = b"", b" \x00"
ODD_GAP = re.compile(rb"[\x20\x09-\x0D]{2,}|[\x09-\x0D]")
BLANKS = b" \t\n\r\x0b\x0c"
ADDED, RATE, STEPS, GATES, LEVELS = 0.1, 0.1, 24, 2 * 8, 12
CACHE_SHARE, CACHE_WORDS = 0.5, 100
MERGERS, WORDS_AT_ONCE, FAN_BITS = 64, 250_000, 10
BLANK_ID, END_ID = 0, 1  # in every block's dictionary
#: Counts from 0 to 255 as stored: exact up to 127, then in steps of some 9 per cent.
STORED = np.concatenate([np.arange(128), np.round(128 * 1.09 ** np.arange(128))]).astype(np.float32)
#: The logit of a pair of stored counts (zeros in the low byte, ones in the high byte).
LOGITS = (np.log(STORED + np.float32(ADDED))[:, None] - np.log(STORED + np.float32(ADDED))[None, :]).ravel()
#: The magnitude of its sum.
LEVEL = np.minimum(np.frexp(STORED[:, None] + STORED[None, :])[1], LEVELS - 1).astype(np.uint8).ravel()


def units_of(text: bytes) -> tuple[list[bytes], list[bytes], int]:
    """Words; gaps other than one blank, empty words and the end; how many gaps are one blank."""
    words = text.split()
    empty = (1 if not text else 0) + (text[:1] in BLANKS if text else 0) + (text[-1:] in BLANKS if text else 0)
    odd = ODD_GAP.findall(text)
    gaps = max(0, len(words) + empty - 1)
    return words, [*odd, *[EMPTY] * empty, END], gaps - len(odd)


def shrink(numbers: np.ndarray) -> bytes:
    """Numbers by byte place, compressed: the upper bytes, mostly zeros, lie together."""
    return zstandard.compress(numbers.view(np.uint8).reshape(-1, numbers.itemsize).T.tobytes(), 1)


def grow(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(data), np.uint8).reshape(size, -1).T).view(kind).ravel()


def shrink_units(units: list[bytes]) -> tuple[bytes, bytes]:
    return zstandard.compress(b"".join(units), 1), shrink(np.fromiter(map(len, units), np.uint32, len(units)))


def grow_units(data: bytes, sizes: bytes) -> list[bytes]:
    text, ends = zstandard.decompress(data), np.cumsum(grow(sizes, np.uint32), dtype=np.int64).tolist()
    return [text[a:b] for a, b in zip([0, *ends], ends)]


def hashes_of(units: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(u, 42) for u in units), np.uint64, len(units))


def pair_keys(before: np.ndarray, word: np.ndarray, bits: int) -> np.ndarray:
    """A hash of so many bits of two words from theirs."""
    mixed = (before * np.uint64(0x9E3779B97F4A7C15) ^ word) * np.uint64(0xD6E8FEB86659FD93)
    return (mixed ^ mixed >> np.uint64(32)) * np.uint64(0xA0761D6478BD642F) >> np.uint64(64 - bits)


def with_ends(ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of all texts from their words, ends included, and the token before each: an end before the first."""
    tokens = np.insert(ids, np.cumsum(counts), END_ID)
    return tokens, np.concatenate([[END_ID], tokens[:-1]]).astype(tokens.dtype)


class Pieces(NamedTuple):
    """How the corpus is cut: by so many upper bits of a hash; pairs have keys of so many bits."""

    bits: int
    key_bits: int

    @classmethod
    def of(cls, size: int) -> Pieces:
        return cls(max(1, (size // PIECE_BYTES).bit_length()), min(60, size.bit_length() + 20))


def blocks(docs: DataFrame, held_out: str, pieces: Pieces) -> DataFrame:
    """A row a block: its texts as ids of its dictionary (words, then gaps other than one blank and the end), and the
    dictionary by piece, with counts in training rows. Its first two entries, in the first piece, are blank and end."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = (
        f"block long, doc_ids array<{kind}>, held binary, n_bytes binary, n_words binary, n_others binary, n_blank binary, "
        "words binary, others binary, units binary, sizes binary, trained binary, by_piece binary"
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = TaskContext.get().partitionId() << 32
        for rows in batches:
            texts = [encode(t).translate(LOWER_ASCII) for t in rows["text"]]
            for part in chunks_by_bytes([len(t) for t in texts], BLOCK_BYTES):
                known: dict[bytes, int] = {b" ": BLANK_ID, END: END_ID}
                held = rows["held"].to_numpy(bool)[part]
                words, others, facts = [], [], []
                for text in texts[part]:
                    own, other, blank = units_of(text)
                    for w in set(own).union(other):
                        if w not in known:
                            known[w] = len(known)
                    words.append(np.fromiter(map(known.__getitem__, own), np.int32, len(own)))
                    others.append(np.fromiter(map(known.__getitem__, other), np.int32, len(other)))
                    facts.append((len(text), len(own), len(other), blank))
                units = list(known)
                piece = (hashes_of(units) >> np.uint64(64 - pieces.bits)).astype(np.int64)
                piece[:2] = 0
                order = np.argsort(piece, kind="stable")
                place = np.empty(len(units), np.int32)
                place[order] = np.arange(len(units), dtype=np.int32)
                facts = np.array(facts, np.int64)
                words, others = place[np.concatenate(words)], place[np.concatenate(others)]
                trained = sum(np.bincount(x[np.repeat(~held, facts[:, k])], minlength=len(units)) for k, x in ((1, words), (2, others)))
                trained[BLANK_ID] += facts[~held, 3].sum()
                data, sizes = shrink_units([units[k] for k in order.tolist()])
                row = [number, rows["doc_id"].iloc[part].tolist(), shrink(held), *(shrink(np.ascontiguousarray(facts[:, k])) for k in range(4))]
                row += [shrink(words), shrink(others), data, sizes, shrink(trained.astype(np.uint32)), shrink(np.bincount(piece, minlength=1 << pieces.bits))]
                yield pd.DataFrame([row], columns=[c.split()[0] for c in schema.split(", ")])
                number += 1

    return docs.select("doc_id", "text", F.expr(held_out).alias("held")).mapInPandas(run, schema)


class Exchange(NamedTuple):
    """The steps from blocks to pieces: after step k a node is a prefix of `piece_bits[k]` bits of the hash and a group
    of blocks that share `group_bits[k]` bits. Each step hands a node's rows to at most 2 ** FAN_BITS nodes."""

    piece_bits: tuple[int, ...]
    group_bits: tuple[int, ...]

    @classmethod
    def of(cls, bits: int, n_blocks: int) -> Exchange:
        all_groups = max(n_blocks - 1, 0).bit_length()
        steps = max(1, -(-max(bits, all_groups) // FAN_BITS))
        return cls(tuple(-(-bits * k // steps) for k in range(steps + 1)), tuple(all_groups * (steps - k) // steps for k in range(steps + 1)))

    @property
    def steps(self) -> int:
        return len(self.piece_bits) - 1

    def addressed(self, asked: DataFrame, step: int) -> DataFrame:
        """Adds the group `grp` that a row goes to, from the block or the group that sends it."""
        if step == 1:
            sender = F.pmod(F.xxhash64("from_grp"), F.lit(1 << self.group_bits[0]))
        else:
            sender = F.col("from_grp")
        return asked.withColumn("grp", F.shiftright(sender, self.group_bits[step - 1] - self.group_bits[step]))


def pieces_of(units: list[bytes], bits: int) -> np.ndarray:
    """The piece of each unit by the upper bits of its hash; blank and end are in the first."""
    found = (hashes_of(units) >> np.uint64(64 - bits)).astype(np.int64)
    found[[k for k, u in enumerate(units) if u == END or u == b" "]] = 0
    return found


SENT_UNITS = "piece int, from_piece int, from_grp long, units binary, sizes binary, trained binary"


def unit_requests(cut: DataFrame, bits: int) -> DataFrame:
    """Each block's dictionary by the upper `bits` bits of the piece; the sender is the block."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for r in rows.itertuples():
                units, trained = grow_units(r.units, r.sizes), grow(r.trained, np.uint32)
                ends = np.cumsum(grow(r.by_piece, np.int64).reshape(1 << bits, -1).sum(1)).tolist()
                out = [(k, 0, r.block, *shrink_units(units[a:b]), shrink(trained[a:b])) for k, (a, b) in enumerate(zip([0, *ends], ends)) if a < b]
                yield pd.DataFrame(out, columns=["piece", "from_piece", "from_grp", "units", "sizes", "trained"])

    return cut.select("block", "units", "sizes", "trained", "by_piece").mapInPandas(run, SENT_UNITS)


def unit_requests_of_nodes(nodes: DataFrame, bits: int) -> DataFrame:
    """As ``unit_requests``, for nodes, whose units are sorted by piece."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for r in rows.itertuples():
                units, n = grow_units(r.units, r.sizes), grow(r.numbers, np.int64)
                piece = pieces_of(units, bits)
                begin = np.flatnonzero(np.diff(piece, prepend=-1)).tolist()
                out = [(piece[a], r.piece, r.grp, *shrink_units(units[a:b]), shrink(n[a:b])) for a, b in zip(begin, [*begin[1:], len(units)])]
                yield pd.DataFrame(out, columns=["piece", "from_piece", "from_grp", "units", "sizes", "trained"])

    return nodes.select("piece", "grp", "units", "sizes", "numbers").mapInPandas(run, SENT_UNITS)


def sum_units(rows: pd.DataFrame, *, kind: type = np.uint32, sorted_by: int = 0) -> pd.DataFrame:
    """A node's distinct units with their counts (no sender), and for each sender which of them its own are. The units
    are sorted by so many bits of their piece, if the node is to send them on."""
    known: dict[bytes, int] = {}
    found = []
    for r in rows.itertuples():
        units = grow_units(r.units, r.sizes)
        found.append(np.fromiter((known.setdefault(u, len(known)) for u in units), np.int32, len(units)))
    n = np.zeros(len(known), np.int64)
    for at, data in zip(found, rows["trained"]):
        n[at] += grow(data, kind)
    units, piece, grp = list(known), rows["piece"].iloc[0], rows["grp"].iloc[0]
    if sorted_by:
        order = np.argsort(pieces_of(units, sorted_by), kind="stable")
        place = np.empty(len(units), np.int32)
        place[order] = np.arange(len(units), dtype=np.int32)
        units, n, found = [units[k] for k in order.tolist()], n[order], [place[x] for x in found]
    word = np.array([is_word(u) for u in units])
    gap = ~word & np.array([u != EMPTY for u in units])
    facts = {"distinct": len(units), "tokens": int(n[word].sum()), "vocabulary": int((n[word] > 0).sum()), "gaps": int(n[gap].sum())}
    data, sizes = shrink_units(units)
    whole = pd.DataFrame([{"piece": piece, "grp": grp, "from_piece": -1, "from_grp": -1, "units": data, "sizes": sizes, "numbers": shrink(n), **facts}])
    each = rows[["piece", "grp", "from_piece", "from_grp"]].assign(numbers=[shrink(x) for x in found])
    return pd.concat([whole, each.assign(units=None, sizes=None, **dict.fromkeys(facts, 0))], ignore_index=True)


UNITS = "piece int, grp long, from_piece int, from_grp long, units binary, sizes binary, numbers binary, distinct long, tokens long, vocabulary long, gaps long"
UNIT_ANSWER = "to_piece int, to_grp long, piece int, n binary, spelled binary"
PAIR_ANSWER = "to_piece int, to_grp long, piece int, pairs binary"


def dealt(rows: pd.DataFrame, **columns: np.ndarray) -> pd.DataFrame:
    """For each sender its own of a node's values, in the order in which it has asked."""
    at = [grow(x, np.int32) for x in rows["numbers"]]
    own = {"to_piece": rows["from_piece"], "to_grp": rows["from_grp"], "piece": rows["piece"]}
    return pd.DataFrame(own | {name: [shrink(values[x]) for x in at] for name, values in columns.items()})


def joined(answers: pd.DataFrame, column: str, kind: type) -> np.ndarray:
    """A node's or a block's values: those of its pieces, one after the other."""
    return np.concatenate([grow(x, kind) for x in answers.sort_values("piece")[column] if x is not None])


def handed_back(own: DataFrame, answers: DataFrame, kinds: dict[str, type], schema: str) -> DataFrame:
    """Answers to a step's nodes as answers to those who asked them."""

    def run(rows: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        return dealt(rows, **{c: joined(found, c, kind) for c, kind in kinds.items()})

    senders = own.filter("from_grp >= 0").select("piece", "grp", "from_piece", "from_grp", "numbers")
    return senders.groupBy("piece", "grp").cogroup(answers.groupBy("to_piece", "to_grp")).applyInPandas(run, schema)


def sent_units(cut: DataFrame, way: Exchange) -> list[DataFrame]:
    """Step by step what the nodes hold, as ``sum_units``; the last step's nodes are the pieces."""
    out, asked = [], unit_requests(cut, way.piece_bits[1])
    for step in range(1, way.steps + 1):
        onward = way.piece_bits[step + 1] if step < way.steps else 0
        merge = partial(sum_units, kind=np.uint32 if step == 1 else np.int64, sorted_by=onward)
        out.append(materialize(way.addressed(asked, step).groupBy("piece", "grp").applyInPandas(merge, UNITS), "lm-units"))
        if onward:
            asked = unit_requests_of_nodes(out[-1].filter("units is not null"), onward)
    return out


def pair_answers(cut: DataFrame, pieces: Pieces, way: Exchange) -> tuple[DataFrame, list[DataFrame]]:
    """To each block how often its pairs occur in all training rows, in the order of its pairs; and tables on the way."""
    held, asked = [], pair_requests(cut, pieces, way.piece_bits[1])
    for step in range(1, way.steps):
        merged = way.addressed(asked, step).groupBy("piece", "grp").applyInPandas(merged_pairs, PAIRS)
        held.append(materialize(merged, "lm-pairs"))
        asked = pair_requests_of_nodes(held[-1].filter("keys is not null"), pieces, way.piece_bits[step + 1])
    answers = way.addressed(asked, way.steps).groupBy("piece", "grp").applyInPandas(sum_pairs, PAIR_ANSWER)
    for own in reversed(held):
        answers = handed_back(own, answers, {"pairs": np.int64}, PAIR_ANSWER)
    return answers, held


def is_word(unit: bytes) -> bool:
    """Words and the end, not gaps and the marks of empty words."""
    return not unit or unit[0] not in BLANKS


SENT_PAIRS = "piece int, from_piece int, from_grp long, keys binary, times binary"


def _pairs_by_piece(keys: np.ndarray, times: np.ndarray, bits: int, key_bits: int, sender: tuple[int, int]) -> pd.DataFrame:
    """Sorted keys cut by their upper bits."""
    cuts = np.flatnonzero(np.diff((keys >> np.uint64(key_bits - bits)).astype(np.int64), prepend=-1)).tolist()
    piece = [int(keys[a]) >> key_bits - bits for a in cuts]
    out = [(k, *sender, shrink(np.diff(keys[a:b], prepend=np.uint64(0))), shrink(times[a:b])) for k, a, b in zip(piece, cuts, [*cuts[1:], len(keys)])]
    return pd.DataFrame(out, columns=["piece", "from_piece", "from_grp", "keys", "times"])


def pair_requests(cut: DataFrame, pieces: Pieces, bits: int) -> DataFrame:
    """Each block's pairs of words by the upper `bits` bits, sorted, and how often they occur in training."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for r in rows.itertuples():
                hashes, counts = hashes_of(grow_units(r.units, r.sizes)), grow(r.n_words, np.int64)
                tokens, before = with_ends(grow(r.words, np.int32), counts)
                learned = np.repeat(~grow(r.held, bool), counts + 1)
                both = np.sort(pair_keys(hashes[before], hashes[tokens], pieces.key_bits) << np.uint64(1) | learned)
                keys = both >> np.uint64(1)
                begin = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
                times = np.add.reduceat((both & np.uint64(1)).astype(np.int64), begin)
                yield _pairs_by_piece(keys[begin], times, bits, pieces.key_bits, (0, r.block))

    columns = ["block", "held", "n_words", "words", "units", "sizes"]
    return cut.select(*columns).mapInPandas(run, SENT_PAIRS)


def pair_requests_of_nodes(nodes: DataFrame, pieces: Pieces, bits: int) -> DataFrame:
    """As ``pair_requests``, for nodes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for r in rows.itertuples():
                yield _pairs_by_piece(grow_keys(r.keys), grow(r.times, np.int64), bits, pieces.key_bits, (r.piece, r.grp))

    return nodes.select("piece", "grp", "keys", "times").mapInPandas(run, SENT_PAIRS)


def grow_keys(data: bytes) -> np.ndarray:
    return np.cumsum(grow(data, np.uint64), dtype=np.uint64)


def total_pairs(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """The distinct keys of a node, how often they occur, and where each row's keys stand among them."""
    keys = [grow_keys(x) for x in rows["keys"]]
    known = np.sort(np.concatenate(keys))
    known = known[np.concatenate([[True], known[1:] != known[:-1]])]
    total, places = np.zeros(len(known), np.int64), [np.searchsorted(known, k).astype(np.int32) for k in keys]
    for at, times in zip(places, rows["times"]):
        total[at] += grow(times, np.int64)
    return known, total, places


PAIRS = "piece int, grp long, from_piece int, from_grp long, keys binary, times binary, numbers binary"


def merged_pairs(rows: pd.DataFrame) -> pd.DataFrame:
    """A node's distinct pairs with their counts (no sender), and for each sender which of them its own are."""
    known, total, places = total_pairs(rows)
    whole = rows[["piece", "grp"]].head(1).assign(from_piece=-1, from_grp=-1, keys=[shrink(np.diff(known, prepend=np.uint64(0)))], times=[shrink(total)], numbers=None)
    each = rows[["piece", "grp", "from_piece", "from_grp"]].assign(keys=None, times=None, numbers=[shrink(x) for x in places])
    return pd.concat([whole, each], ignore_index=True)


def sum_pairs(rows: pd.DataFrame) -> pd.DataFrame:
    """How often the pairs of a piece occur in all training rows, for each sender."""
    _, total, places = total_pairs(rows)
    own = {"to_piece": rows["from_piece"], "to_grp": rows["from_grp"], "piece": rows["piece"]}
    return pd.DataFrame(own | {"pairs": [shrink(total[at]) for at in places]})


def _spelled(units: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Bytes of all units with their terminators, each one's unit, whether it is a gap's, and context hashes by order."""
    gap = np.array([not u or (u[0] in BLANKS and u != EMPTY) for u in units])
    text = np.frombuffer(b"".join((b"" if u == EMPTY else u) + (b"\0" if g else b" ") for u, g in zip(units, gap)), np.uint8)
    sizes = np.array([(0 if u == EMPTY else len(u)) + 1 for u in units])
    owner = np.repeat(np.arange(len(units)), sizes)
    place = np.arange(len(text)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    is_gap = gap[owner]
    history = np.where(is_gap, np.uint64(7), np.uint64(3)) * np.uint64(0x9E3779B97F4A7C15)
    contexts = []
    for back in range(1, max(ORDERS) + 1):
        before = np.zeros(len(text), np.uint64)
        before[back:] = text[:-back] if back < len(text) else 0
        before = np.where(place >= back, before + np.uint64(1), np.uint64(0))
        history = (history ^ (before + np.uint64(back << 10))) * np.uint64(0xD6E8FEB86659FD93)
        history ^= history >> np.uint64(32)
        if back in ORDERS:
            contexts.append(history.copy())
    return text, owner, is_gap, contexts


def tables(bits: int) -> list[tuple[int, int]]:
    """(offset, bits) of each predictor's slots; up to three bytes make few contexts. Last: where they end."""
    sizes = [min(bits, MOST_SLOT_BITS - 3) if order < 4 else bits for order in ORDERS]
    return list(zip(np.cumsum([0, *(1 << b for b in sizes)]).tolist(), [*sizes, 0]))


def _slots(context: np.ndarray, node: np.ndarray, table: tuple[int, int]) -> np.ndarray:
    mixed = (context + node.astype(np.uint64)) * np.uint64(0xA0761D6478BD642F)
    mixed ^= mixed >> np.uint64(29)
    return ((mixed * np.uint64(0xE7037ED1A0B428DB)) >> np.uint64(64 - table[1])).astype(np.int64) + table[0]


def weight_of(count: np.ndarray) -> np.ndarray:
    """A unit's weight in the spelling model: the bit length of its count."""
    return np.frexp(count.astype(np.float64))[1].astype(np.int64)


def _parts(units: list[bytes], limit: int = 400_000):
    return chunks_by_bytes([len(u) + 1 for u in units], limit)


def count_bits(units: list[bytes], weights: np.ndarray, bits: int, into: np.ndarray) -> None:
    """Adds the units' zeros and ones to into[slot, bit]."""
    order_tables = tables(bits)
    for part in _parts(units):
        text, owner, _, contexts = _spelled(units[part])
        weight = weights[part][owner].astype(into.dtype)  # one type: else numpy adds in slow steps
        for k, context in enumerate(contexts):
            for place in range(7, -1, -1):
                bit = (text >> place & 1).astype(np.int64)
                node = (1 << (7 - place)) + (text.astype(np.int64) >> (place + 1))
                np.add.at(into.reshape(-1), 2 * _slots(context, node, order_tables[k]) + bit, weight)


class Model:
    """Counts, mixing weights and probability map. A predictor's weight depends on bit place and kind of unit, and on
    how often its context was seen; the last weight is that of a constant."""

    SHAPE = (GATES, len(ORDERS) * LEVELS + 1)

    def __init__(self, bits: int, stored: np.ndarray, weights: np.ndarray | None = None, map_ones=None, map_all=None):
        self.tables, self.stored = tables(bits), stored
        self.weights = np.full(self.SHAPE, 0.35) if weights is None else weights
        if weights is None:
            self.weights[:, -1] = 0
        centre = 1 / (1 + np.exp(-(np.arange(STEPS) - STEPS / 2 + 0.5) / 2))
        self.map_ones = np.tile(centre * 4, (256, 1)) if map_ones is None else map_ones
        self.map_all = np.full((256, STEPS), 4.0) if map_all is None else map_all
        self.squares = np.full(self.SHAPE, 1e-4)

    def pass_over(self, units: list[bytes], weights: np.ndarray, learn: bool) -> np.ndarray:
        """log10 probabilities of the units. When learning, a unit's own counts are left out of the predictors, and
        weights and map move after each prediction."""
        out = []
        pairs = self.stored.view("<u2")[..., 0]  # both counts of a slot at once
        last = self.SHAPE[1] - 1
        for part in _parts(units, 40_000):
            text, owner, is_gap, contexts = _spelled(units[part])
            weight = weights[part][owner]
            previous = np.concatenate([[0], text[:-1]]).astype(np.int32)
            previous[np.concatenate([[True], owner[1:] != owner[:-1]])] = 0
            previous *= STEPS
            cost = np.zeros(len(text))
            total = max(weight.sum(), 1)
            for place in range(7, -1, -1):
                bit = text >> place & 1
                node = (1 << (7 - place)) + (text.astype(np.int64) >> (place + 1))
                gate = (place * 2 + is_gap) * self.SHAPE[1]
                flat = self.weights.astype(np.float32).ravel()
                used, inputs, dot = [], [], flat[gate + last]
                if learn:
                    zero, one = np.where(bit == 0, weight, 0).astype(np.int16), np.where(bit == 1, weight, 0).astype(np.int16)
                for k, context in enumerate(contexts):
                    pair = pairs[_slots(context, node, self.tables[k])]
                    if learn:  # counts up to 127 are stored as they are; those of more hardly change by one unit
                        zeros, ones = (pair & 255).astype(np.int16), (pair >> 8).astype(np.int16)
                        zeros = np.where(zeros < 128, np.maximum(zeros - zero, 0), zeros)
                        ones = np.where(ones < 128, np.maximum(ones - one, 0), ones)
                        pair = ones.astype(np.int32) << 8 | zeros
                    logit = LOGITS[pair]
                    at = gate + k * LEVELS + LEVEL[pair]
                    dot = dot + logit * flat[at]
                    used.append(at)
                    inputs.append(logit)
                p = 1 / (1 + np.exp(-np.clip(dot, -18, 18)))
                step = np.clip(np.round(2 * dot + STEPS / 2 - 0.5), 0, STEPS - 1).astype(np.int32)
                at = previous + step
                mapped = (self.map_ones.ravel() / self.map_all.ravel()).astype(np.float32)[at]
                final = np.clip((p + mapped) / 2, 1e-6, 1 - 1e-6)
                cost += np.log(np.where(bit == 1, final, 1 - final))
                if learn:
                    error = (bit - p) * (weight / total)
                    for index, x in ((gate + last, 1), *zip(used, inputs)):
                        g = np.bincount(index, weights=error * x, minlength=flat.size).reshape(self.SHAPE)
                        self.squares += g * g
                        self.weights += RATE * g / np.sqrt(self.squares)
                    self.map_ones += np.bincount(at, weights=bit * weight, minlength=256 * STEPS).reshape(256, STEPS)
                    self.map_all += np.bincount(at, weights=weight, minlength=256 * STEPS).reshape(256, STEPS)
            out.append(np.bincount(owner, weights=cost, minlength=len(units[part])) / np.log(10))
        return np.concatenate(out) if out else np.zeros(0)


def quantize(counts: np.ndarray) -> np.ndarray:
    """Stored forms of counts; of pairs (zeros, ones) beyond the largest both are scaled down, so that their ratio stays."""
    if counts.ndim == 2:
        largest = counts.max(axis=1, keepdims=True, initial=1)
        counts = np.where(largest > STORED[-1], counts * (float(STORED[-1]) / largest), counts)
    return np.clip(np.searchsorted(STORED, counts, "right") - 1, 0, 255).astype(np.uint8)


def unit_lists(rows: pd.DataFrame, trained: bool) -> Iterator[tuple[list[bytes], np.ndarray]]:
    """Units and counts of each piece; only those that occur in training, on demand."""
    for r in rows.itertuples():
        units, n = grow_units(r.units, r.sizes), grow(r.numbers, np.int64)
        if trained:
            units, n = [u for u, k in zip(units, n.tolist()) if k], n[n > 0]
        yield units, n


def fit_spelling(units: DataFrame, distinct: int) -> tuple[int, DataFrame]:
    """Slot bits, and rows (piece, data): the summed bit counts of PIECE slots."""
    bits = int(np.clip(int(max(distinct, 1)).bit_length() + 2, LEAST_SLOT_BITS, MOST_SLOT_BITS))
    slots = tables(bits)[-1][0]

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        into = np.zeros((slots, 2), np.int32)
        for rows in batches:
            for units, n in unit_lists(rows, True):
                count_bits(units, weight_of(n), bits, into)
        for at in range(0, slots, PIECE):
            piece = into[at : at + PIECE]
            if piece.any():
                yield pd.DataFrame({"piece": [at // PIECE], "data": [zlib.compress(piece.tobytes(), 1)]})

    def summed(rows: pd.DataFrame, kind: type) -> np.ndarray:
        return sum(np.frombuffer(zlib.decompress(d), kind).reshape(-1, 2).astype(np.int64) for d in rows["data"])

    def add_up(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"piece": [key[0]], "data": [zlib.compress(summed(rows, np.int32).tobytes(), 1)]})

    def total(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"piece": [key[0]], "data": [zlib.compress(quantize(summed(rows, np.int64)).tobytes(), 1)]})

    kind = "piece int, data binary"
    sums = units.mapInPandas(count, kind).withColumn("part", F.spark_partition_id() % MERGERS)
    sums = sums.groupBy("piece", "part").applyInPandas(add_up, kind)  # a tree: no group grows with all tasks
    return bits, materialize(sums.groupBy("piece").applyInPandas(total, kind), "lm-counts")


def load_counts(bits: int, pieces: list[tuple[int, bytes]]) -> np.ndarray:
    stored = np.zeros((tables(bits)[-1][0], 2), np.uint8)
    for piece, data in pieces:
        got = np.frombuffer(zlib.decompress(data), np.uint8).reshape(-1, 2)
        stored[piece * PIECE : piece * PIECE + len(got)] = got
    return stored


def merge_learned(learned: DataFrame, size: int, maps: int) -> tuple[int, np.ndarray, np.ndarray]:
    """What tasks learned, rows (seen, data): mixing weights averaged by what each has seen, probability maps summed."""

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        seen, parts = rows["seen"].to_numpy(), np.stack([np.frombuffer(d) for d in rows["data"]])
        both = np.concatenate([seen @ parts[:, :size] / max(seen.sum(), 1), parts[:, size:].sum(0)])
        return pd.DataFrame({"seen": [int(seen.sum())], "data": [both.tobytes()]})

    parts = learned.withColumn("part", F.spark_partition_id() % MERGERS).groupBy("part").applyInPandas(merge, "seen long, data binary")
    rows = [r.asDict() for r in parts.collect()]  # MERGERS rows of fixed size at most
    if not rows:
        return 0, np.zeros(size), np.zeros(maps)
    one = merge(pd.DataFrame(rows))
    data = np.frombuffer(one["data"][0])
    return int(one["seen"][0]), data[:size], data[size:]


def spelling_scores(units: DataFrame, distinct: int) -> DataFrame:
    """(piece, units, sizes, numbers, spelled): each unit's log10 probability in the spelling model."""
    bits, counts = fit_spelling(units, distinct)
    context = units.sparkSession.sparkContext
    # one byte for each of fewer than 5 * 2 ** MOST_SLOT_BITS counts, compressed
    pieces = context.broadcast([(r["piece"], bytes(r["data"])) for r in counts.collect()])

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, seen = Model(bits, load_counts(bits, pieces.value)), 0
        for rows in batches:
            for units, n in unit_lists(rows, True):
                model.pass_over(units, weight_of(n), True)
                seen += int(weight_of(n).sum())
        if seen:
            fresh = Model(LEAST_SLOT_BITS, model.stored)
            parts = (model.weights, model.map_ones - fresh.map_ones, model.map_all - fresh.map_all)
            yield pd.DataFrame({"seen": [seen], "data": [np.concatenate([x.ravel() for x in parts]).tobytes()]})

    size = GATES * Model.SHAPE[1]
    total, weights, maps = merge_learned(units.mapInPandas(learn, "seen long, data binary"), size, 2 * 256 * STEPS)
    fresh = Model(LEAST_SLOT_BITS, np.zeros(0))
    ones, everything = maps.reshape(2, 256, STEPS)
    mixing = (weights.reshape(fresh.weights.shape) if total else fresh.weights, fresh.map_ones + ones, fresh.map_all + everything)
    held = context.broadcast(mixing)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = Model(bits, load_counts(bits, pieces.value), *held.value)
        for rows in batches:
            spelled = [shrink(model.pass_over(u, np.ones(len(u), np.int64), False).astype(np.float32)) for u, _ in unit_lists(rows, False)]
            yield rows.assign(spelled=spelled)

    columns = "piece int, units binary, sizes binary, numbers binary"
    return units.select("piece", "units", "sizes", "numbers").mapInPandas(score, f"{columns}, spelled binary")


def unit_answers(rows: pd.DataFrame, scored: pd.DataFrame) -> pd.DataFrame:
    """For each sender its units' counts and spelling scores, in the order of its dictionary."""
    return dealt(rows, n=grow(scored["numbers"].iloc[0], np.int64), spelled=grow(scored["spelled"].iloc[0], np.float32))


def grouped(keys: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """A stable order of keys below `most`, and where each distinct one begins in it."""
    bits = len(keys).bit_length()
    if int(most).bit_length() + bits < 63:  # sorted with their places, which is faster than sorting places by them
        packed = np.sort(keys.astype(np.int64) << bits | np.arange(len(keys)))
        order, sorted_keys = packed & ((1 << bits) - 1), packed >> bits
    else:
        order = np.argsort(keys, kind="stable")
        sorted_keys = keys[order]
    return order, np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]])) if len(keys) else np.zeros(0, np.int64)


def runs(keys: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """For each place, how often its key stands before it, and how often in all."""
    order, begin = grouped(keys, most)
    sizes = np.diff(np.append(begin, len(keys)))
    earlier, total = np.empty(len(keys), np.int32), np.empty(len(keys), np.int32)
    earlier[order] = np.arange(len(keys)) - np.repeat(begin, sizes)
    total[order] = np.repeat(sizes, sizes)
    return earlier, total


def pair_places(before: np.ndarray, tokens: np.ndarray, hashes: np.ndarray, bits: int) -> np.ndarray:
    """For each token, the place of its pair among the block's sorted keys."""
    order, begin = grouped(before.astype(np.int64) * len(hashes) + tokens, len(hashes) ** 2)
    first = order[begin]
    keys = pair_keys(hashes[before[first]], hashes[tokens[first]], bits)
    by_key = np.argsort(keys)
    rank = np.empty(len(keys), np.int32)
    rank[by_key] = np.cumsum(np.concatenate([[0], keys[by_key][1:] != keys[by_key][:-1]]))
    place = np.empty(len(tokens), np.int32)
    place[order] = np.repeat(rank, np.diff(np.append(begin, len(tokens))))
    return place


def log_sum(*terms: np.ndarray) -> np.ndarray:
    """log10 of a sum of numbers given by their log10."""
    return np.logaddexp.reduce([np.multiply(t, np.log(10)) for t in terms]) / np.log(10)


def log_of(x) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.log10(np.asarray(x, np.float64))


def cached_scores(earlier: np.ndarray, before: np.ndarray, static: np.ndarray) -> np.ndarray:
    """log10 costs of words with the text's own earlier words mixed in: `earlier` of the `before` words are the same."""
    share = CACHE_SHARE * before / (before + CACHE_WORDS)
    return log_sum(log_of(1 - share) + static, log_of(share * earlier / np.maximum(before, 1)))


def magnitude(count: np.ndarray, most: int) -> np.ndarray:
    return np.minimum(np.frexp(count.astype(np.float64))[1], most).astype(np.uint8)


class Follower:
    """Predicts the bit of each word that tells whether it was seen after the word before it.

    marks: a byte a word; four bits: the magnitude of the count of the word before (0: unknown, no bit is coded),
    one: the bit itself, three: the magnitude of the pair's count."""

    SIZES = (16, 64, 128, 1024, 128, 4096)
    OFFSETS = np.cumsum((0, *SIZES))
    GATES, BATCH = 64, 50_000
    SHAPE = (GATES, len(SIZES) + 1)

    def __init__(self, counts: np.ndarray, weights: np.ndarray | None = None, maps: np.ndarray | None = None):
        self.logits = (np.log(counts[1] + 0.4) - np.log(counts[0] + 0.4)).astype(np.float32)
        self.weights = np.full(self.SHAPE, 0.25) if weights is None else weights
        if weights is None:
            self.weights[:, -1] = 0
        centre = 1 / (1 + np.exp(-(np.arange(STEPS) - STEPS / 2 + 0.5) / 2))
        self.maps = np.stack([np.tile(centre * 4, (16, 1)), np.full((16, STEPS), 4.0)]) if maps is None else maps
        self.squares = np.full(self.SHAPE, 1e-2)

    @classmethod
    def contexts(cls, marks: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
        """Of the words that have a bit: which they are, their slots by predictor, gates, places in the map, bits."""
        place = np.arange(len(marks)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        seen, bit, pair = (marks & 15).astype(np.int64), (marks >> 4 & 1).astype(np.int64), (marks >> 5).astype(np.int64)
        coded = np.flatnonzero(seen)
        back = lambda x, k: np.where(place[coded] >= k, x[np.maximum(coded - k, 0)], 0)
        last = [back(bit, k) << (k - 1) for k in range(1, 13)]
        history = lambda k: np.add.reduce(last[:k])
        one, two, own = back(pair, 1), back(pair, 2), seen[coded]
        slots = [own, history(6), one * 16 + own, (one * 8 + two) * 16 + history(4), own * 8 + history(3), history(12)]
        return coded, [s + o for s, o in zip(slots, cls.OFFSETS)], one * 8 + own // 2, history(4), bit[coded]

    @classmethod
    def count(cls, marks: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Zeros and ones by slot."""
        _, slots, _, _, bit = cls.contexts(marks, sizes)
        ones = sum(np.bincount(s, weights=bit, minlength=cls.OFFSETS[-1]) for s in slots)
        return np.stack([sum(np.bincount(s, minlength=cls.OFFSETS[-1]) for s in slots) - ones, ones]).astype(np.int64)

    def pass_over(self, marks: np.ndarray, sizes: np.ndarray, learn: bool) -> np.ndarray:
        """log10 probabilities of the bits by word, 0 where none is coded. When learning, weights and map move after
        each prediction."""
        out = np.zeros(len(marks))
        coded, slots, gates, maps, bits = self.contexts(marks, sizes)
        for at in range(0, len(coded), self.BATCH):
            part = slice(at, at + self.BATCH)
            gate, place, bit = gates[part], maps[part], bits[part]
            inputs = np.stack([self.logits[s[part]] for s in slots] + [np.ones(len(bit), np.float32)])
            dot = np.einsum("kn,kn->n", inputs, self.weights.T[:, gate])
            p = 1 / (1 + np.exp(-np.clip(dot, -18, 18)))
            step = np.clip(np.round(2 * dot + STEPS / 2 - 0.5), 0, STEPS - 1).astype(np.int64)
            final = np.clip((p + self.maps[0, place, step] / self.maps[1, place, step]) / 2, 1e-7, 1 - 1e-7)
            out[coded[part]] = np.log10(np.where(bit == 1, final, 1 - final))
            if learn:
                for k in range(len(slots) + 1):
                    g = np.bincount(gate, weights=(bit - p) * inputs[k], minlength=self.GATES) / len(bit)
                    self.squares[:, k] += g * g
                    self.weights[:, k] += RATE * g / np.sqrt(self.squares[:, k])
                np.add.at(self.maps, (0, place, step), bit)
                np.add.at(self.maps, (1, place, step), 1)
        return out


def marked_parts(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray]]:
    """Rows a few texts at a time, with their marks in one array and the size of each."""
    for rows in batches:
        for part in chunks_by_bytes(rows["n_tokens"].tolist(), WORDS_AT_ONCE):
            few = rows.iloc[part]
            yield few, np.concatenate([np.frombuffer(m, np.uint8) for m in few["marks"]]), few["n_tokens"].to_numpy(np.int64)


def fit_follower(marked: DataFrame) -> Follower:
    """The mixer of the words' bits, from all training rows: exact sums of zeros and ones, then weights and map."""
    trained = marked.filter("not held_out").select("n_tokens", "marks")
    context = marked.sparkSession.sparkContext

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros((2, Follower.OFFSETS[-1]), np.int64)
        for _, marks, sizes in marked_parts(batches):
            counts += Follower.count(marks, sizes)
        some = np.flatnonzero(counts.any(0))
        yield pd.DataFrame({"slot": some, "zeros": counts[0, some], "ones": counts[1, some]})

    counts = np.zeros((2, Follower.OFFSETS[-1]), np.int64)
    sums = trained.mapInPandas(count, "slot long, zeros long, ones long").groupBy("slot").agg(F.sum("zeros"), F.sum("ones"))
    for slot, zeros, ones in sums.collect():  # as many rows as slots at most
        counts[:, slot] = zeros, ones
    held = context.broadcast(counts)

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, seen = Follower(held.value), 0
        fresh = model.maps.copy()
        for _, marks, sizes in marked_parts(batches):
            model.pass_over(marks, sizes, True)
            seen += len(marks)
        if seen:
            yield pd.DataFrame({"seen": [seen], "data": [np.concatenate([model.weights.ravel(), (model.maps - fresh).ravel()]).tobytes()]})

    fresh = Follower(counts)
    total, weights, maps = merge_learned(trained.mapInPandas(learn, "seen long, data binary"), fresh.weights.size, fresh.maps.size)
    return Follower(counts, weights.reshape(Follower.SHAPE) if total else None, fresh.maps + maps.reshape(fresh.maps.shape))


def best_share(scored: DataFrame, tokens: int) -> float:
    """How far a word's share of the training words counts beside its spelling: what makes them likeliest, each of
    them left out of its own count."""
    tried = np.arange(1, 20) / 20

    def gains(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gain = np.zeros(len(tried))
        for rows in batches:
            for (units, n), data in zip(unit_lists(rows, False), rows["spelled"]):
                kept = np.flatnonzero((n > 0) & np.array([is_word(u) for u in units]))
                share, spelled = np.maximum(n[kept] - 1, 0) / max(tokens - 1, 1), 10.0 ** np.maximum(grow(data, np.float32)[kept].astype(float), -300)
                gain += [n[kept] @ np.log10(t * share + (1 - t) * spelled) for t in tried]
        yield pd.DataFrame({"k": np.arange(len(tried)), "gain": gain})

    found = scored.mapInPandas(gains, "k int, gain double").groupBy("k").agg(F.sum("gain").alias("gain")).collect()  # as many rows as are tried
    return float(tried[max((r["gain"], r["k"]) for r in found)[1]]) if found else 0.5


class Marked(NamedTuple):
    """Texts with all that the corpus says of them: `marked`, rows (doc_id, held_out, n_bytes, n_tokens, n_known,
    base_score, coded, marks); coded: log10 probability of words and gaps once the words' bits are known. Beside it
    what it was worked out with: training tokens, units with their spelling scores, and a word's `share`."""

    marked: DataFrame
    tokens: int
    gaps: int
    units: DataFrame
    share: float


def mark(docs: DataFrame, modulus: int, remainder: int) -> Marked:
    pieces = Pieces.of(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    cut = docs.select("doc_id", "text", (crc_bucket(F.col("doc_id"), modulus) == remainder).alias("__held"))
    cut = materialize(blocks(cut, "__held", pieces), "lm-blocks")
    way = Exchange.of(pieces.bits, cut.count())
    units = sent_units(cut, way)
    whole = units[-1].filter("units is not null")
    facts = whole.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("distinct", "tokens", "vocabulary", "gaps")]).first()
    tokens, vocabulary, gaps = facts["tokens"], facts["vocabulary"], facts["gaps"]
    scored = materialize(spelling_scores(whole, facts["distinct"]), "lm-spelled")
    share = best_share(scored, tokens)
    by_unit = units[-1].filter("from_grp >= 0").select("piece", "from_piece", "from_grp", "numbers").groupBy("piece")
    answers = by_unit.cogroup(scored.select("piece", "numbers", "spelled").groupBy("piece")).applyInPandas(unit_answers, UNIT_ANSWER)
    for own in reversed(units[:-1]):
        answers = handed_back(own, answers, {"n": np.int64, "spelled": np.float32}, UNIT_ANSWER)
    pairs, on_the_way = pair_answers(cut, pieces, way)
    answers = answers.unionByName(pairs, allowMissingColumns=True)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, held_out boolean, n_bytes long, n_tokens long, n_known long, base_score double, coded double, marks binary"

    def look_up(rows: pd.DataFrame, table: pd.DataFrame) -> pd.DataFrame:
        """Of each text: its base score, what its words cost once their bits are known, gaps included, and marks."""
        r, times = rows.iloc[0], joined(table, "pairs", np.int64)
        if times.max(initial=0) < 1 << 31:
            times = times.astype(np.int32)  # half the memory
        n, spelled = joined(table, "n", np.int64), joined(table, "spelled", np.float32).astype(float)
        base_cost = np.log10((n + 1) / (tokens + vocabulary + 1))
        gap_cost = log_sum(log_of(0.999 * n / max(gaps, 1)), log_of(0.001) + spelled)
        held, counts, n_others, n_blank = grow(r["held"], bool), *(grow(r[c], np.int64) for c in ("n_words", "n_others", "n_blank"))
        tokens_of_all, before_all = with_ends(grow(r["words"], np.int32), counts)
        places = pair_places(before_all, tokens_of_all, hashes_of(grow_units(r["units"], r["sizes"])), pieces.key_bits)
        others = grow(r["others"], np.int32)
        # the last of a text's other units is the end, which is a token
        gap = np.bincount(np.repeat(np.arange(len(counts)), n_others), weights=gap_cost[others], minlength=len(counts)) - gap_cost[END_ID]
        gap += n_blank * gap_cost[BLANK_ID]
        ends, out = np.cumsum(counts + 1), []
        for part in chunks_by_bytes(counts.tolist(), WORDS_AT_ONCE):  # few texts at a time bound the arrays
            sizes = counts[part] + 1
            span = slice(ends[part.start] - sizes[0], ends[part.stop - 1])
            flat, before, pair = tokens_of_all[span], before_all[span], places[span]
            text = np.repeat(np.arange(len(sizes)), sizes)
            sums = lambda x: np.bincount(text, weights=x, minlength=len(sizes))  # noqa: E731, B023
            place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            earlier, own = runs(text * len(n) + flat, len(sizes) * len(n))
            _, own_pair = runs(text * len(times) + pair, len(sizes) * len(times))
            own_before = np.where(place > 0, own[np.arange(len(flat)) - 1], 1)  # the end stands once before a text
            learned = ~held[part][text]  # their own counts are taken off
            after, both = n[before] - own_before * learned, times[pair] - own_pair * learned
            seen = both > 0
            cost, missed = np.empty(len(flat)), np.flatnonzero(~seen)
            cost[seen] = np.log10(both[seen] / np.maximum(after[seen], 1))
            all_others = np.maximum(tokens - np.where(learned, sizes[text], 0), 1)[missed]
            static = log_sum(log_of(share * (n[flat] - own * learned)[missed] / all_others), log_of(1 - share) + spelled[flat[missed]])
            cost[missed] = cached_scores(earlier[missed], place[missed], static)
            marks = magnitude(after, 15) | seen.astype(np.uint8) << 4 | magnitude(both, 7) << 5
            few = {"n_tokens": sizes, "n_known": sums(n[flat] > 0).astype(np.int64), "base_score": sums(base_cost[flat]), "coded": sums(cost) + gap[part]}
            out.append(pd.DataFrame(few | {"marks": [m.tobytes() for m in np.split(marks, np.cumsum(sizes)[:-1])]}))
        table = pd.concat(out, ignore_index=True)
        return table.assign(doc_id=list(r["doc_ids"]), held_out=held, n_bytes=grow(r["n_bytes"], np.int64))[[c.split()[0] for c in schema.split(", ")]]

    marked = cut.drop("trained", "by_piece").groupBy("block").cogroup(answers.groupBy("to_grp")).applyInPandas(look_up, schema)
    marked = materialize(marked, "lm-marks")
    discard(cut, *units, *on_the_way)
    return Marked(marked, tokens, gaps, scored, share)


def finish(marked: DataFrame, tokens: int, follower: Follower) -> DataFrame:
    """Adds what the words' bits cost."""
    model = marked.sparkSession.sparkContext.broadcast(follower)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, marks, sizes in marked_parts(batches):
            bits = np.add.reduceat(model.value.pass_over(marks, sizes, False), np.cumsum(sizes) - sizes)
            yield rows.drop(columns=["marks", "coded"]).assign(score=rows["coded"] + bits)

    kind = marked.schema["doc_id"].dataType.simpleString()
    whole = marked.mapInPandas(run, f"doc_id {kind}, held_out boolean, n_bytes long, n_tokens long, n_known long, base_score double, score double")
    bits = F.when(F.col("n_bytes") > 0, -F.col("score") / F.log10(F.lit(2.0)) / F.col("n_bytes")).otherwise(F.lit(0.0))
    return whole.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score", "n_bytes", bits.alias("bits_per_byte"))


def score_documents(docs: DataFrame, modulus: int = 7, remainder: int = 2) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte) for each row;
    learns from the rows whose crc32(doc_id as text) modulo `modulus` is not `remainder`. bits_per_byte: the score in
    bits over the bytes of the text, 0 for an empty one."""
    found = mark(docs, modulus, remainder)
    return finish(found.marked, found.tokens, fit_follower(found.marked))
