"""SimHash near-duplicates by anchor-point covering.

Fingerprints are 64 bits. Two blocks of 31 bits each carry the perfect Hamming code of covering radius 1,
whose code words are the anchors. Fingerprints at most 3 bits apart differ in at most 1 bit of one of the
blocks, so within that block the second lies within 1 + 1 = 2 bits of the first one's anchor. Each
fingerprint goes to its own anchor and is replicated to every anchor within 2 bits (16 at most), and
fingerprints are compared anchor by anchor. Only distinct fingerprints take part: copies of a text cost nothing.
An anchor of more than ``MOST_MEMBERS`` fingerprints, such as a template's variants that agree in one block, is dealt out
again by the bits that are still open: they are cut into four parts, of which two fingerprints at most 3 bits apart share
one, and so on until the groups are small. No link is lost, and no task holds more than one such group.

Defined cases: a null or empty text, or one without words, has fingerprint zero and links like any other;
a null doc_id keeps its row, counts for linking, and is never a component's id unless all ids in it are null;
repeated rows stay repeated.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapline.llm.common import LOWER_ASCII, chunks_by_bytes, encode, materialize
from gapline.llm.components import connected_components

SHINGLE, THRESHOLD, BLOCK, MOST_MEMBERS = 3, 3, 31, 4096
BLOCK_MASK = (1 << BLOCK) - 1
#: XOR of the places (1 to 31) of the set bits, a byte of the block at a time: the syndrome of the Hamming code.
_SYNDROME = np.zeros((4, 256), np.int64)
for _byte in range(4):
    for _value in range(256):
        for _bit in range(8):
            if _value >> _bit & 1 and 8 * _byte + _bit < BLOCK:
                _SYNDROME[_byte, _value] ^= 8 * _byte + _bit + 1
#: For each syndrome s from 1: the 15 pairs of places whose XOR is s, as masks of two bits.
_PAIRS = np.zeros((BLOCK + 1, 15), np.int64)
for _s in range(1, BLOCK + 1):
    _PAIRS[_s] = [1 << (i - 1) | 1 << ((i ^ _s) - 1) for i in range(1, BLOCK + 1) if 0 < i ^ _s and i < i ^ _s]


def fingerprints(texts: list[bytes], size: int = SHINGLE) -> np.ndarray:
    """64-bit fingerprints: a bit is 1 if set in over half the shingles' hashes."""
    hashes, counts, digest = [], [], xxhash.xxh64_intdigest
    for text in texts:
        words = text.translate(LOWER_ASCII).split()
        if len(words) <= size:
            found = [digest(b" ".join(words), 42)] if words else []
        else:
            joined, ends, at = b" ".join(words), [], -1
            for w in words:
                at += len(w) + 1
                ends.append(at)
            begins = [0, *(e + 1 for e in ends[:-size])]
            found = [digest(joined[a:b], 42) for a, b in zip(begins, ends[size - 1 :])]
        hashes += found
        counts.append(len(found))
    counts = np.array(counts, np.int64)
    out = np.zeros(len(texts), np.uint64)
    some = np.flatnonzero(counts)
    if len(some):
        bits = np.unpackbits(np.array(hashes, np.uint64).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        starts = np.concatenate([[0], np.cumsum(counts[some])[:-1]])
        ones = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
        out[some] = np.packbits(2 * ones > counts[some][:, None], axis=1, bitorder="little").view("<u8").ravel()
    return out


def fingerprint_column(docs: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(*keys, fp): fp is the fingerprint as a signed long."""
    kinds = ", ".join(f"{k} {docs.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            texts = [encode(t) for t in rows["text"]]
            parts = [fingerprints(texts[p]) for p in chunks_by_bytes([len(t) for t in texts], 2_000_000)]
            yield rows[list(keys)].assign(fp=np.concatenate(parts or [np.zeros(0, np.uint64)]).view(np.int64))

    return docs.select(*keys, "text").mapInPandas(run, f"{kinds}, fp long")


def anchors(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, fingerprint, home) rows: each fingerprint's own anchor and all anchors within 2 bits, by block."""
    out = []
    for block in (0, 1):
        part = (fp.view(np.uint64) >> np.uint64(BLOCK * block)).astype(np.int64) & BLOCK_MASK
        s = _SYNDROME[0][part & 255] ^ _SYNDROME[1][part >> 8 & 255] ^ _SYNDROME[2][part >> 16 & 255] ^ _SYNDROME[3][part >> 24]
        home = part ^ np.where(s > 0, 1 << np.maximum(s - 1, 0), 0)
        tag = block << BLOCK
        out.append((home | tag, fp, np.ones(len(fp), bool)))
        off = np.flatnonzero(s)
        out.append((((part[off, None] ^ _PAIRS[s[off]]) | tag).ravel(), np.repeat(fp[off], 15), np.zeros(15 * len(off), bool)))
    return tuple(np.concatenate(x) for x in zip(*out))


def _forest(fp: np.ndarray, home: np.ndarray, threshold: int) -> list[tuple[int, int]]:
    """Links of one anchor: at most one a member, which join all that its comparisons join."""
    label = np.arange(len(fp))
    for i in np.flatnonzero(home):
        near = np.flatnonzero(np.bitwise_count((fp ^ fp[i]).view(np.uint64)) <= threshold)
        joined = np.unique(label[near])
        if len(joined) > 1:
            label[np.isin(label, joined)] = joined[0]
    moved = np.flatnonzero(label != np.arange(len(fp)))
    return list(zip(fp[moved].tolist(), fp[label[moved]].tolist()))


COMPARED = "a long, b long, home boolean, open long, again boolean"


def compare_sorted(batches: Iterator[pd.DataFrame], threshold: int, most: int) -> Iterator[pd.DataFrame]:
    """Links (a, b) from rows (key, fp, home, open) sorted by key; those of keys with more than `most` rows and open bits
    come back as they are, as (a: key, b: fp, home, open) with `again`. At most `most` rows and a batch are held."""
    carry: list[pd.DataFrame] = []
    passing = None  # a key whose rows go by

    def back(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"a": rows["key"], "b": rows["fp"], "home": rows["home"], "open": rows["open"], "again": True})

    def settle(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        key, fp, home, unsettled = (rows[c].to_numpy() for c in ("key", "fp", "home", "open"))
        cut = np.flatnonzero(np.diff(key)) + 1
        start, end = np.concatenate([[0], cut]), np.concatenate([cut, [len(key)]])
        large = (end - start > most) & (unsettled[start] != 0)
        if large.any():
            yield back(rows[np.repeat(large, end - start)])
        homes = np.add.reduceat(home.astype(np.int64), start)
        small = np.flatnonzero((end - start > 1) & (homes > 0) & ~large)
        found = [x for i in small for x in _forest(fp[start[i] : end[i]], home[start[i] : end[i]], threshold)]
        links = pd.DataFrame(np.array(found, np.int64).reshape(-1, 2), columns=["a", "b"])
        yield links.assign(home=False, open=0, again=False)

    for rows in batches:
        if passing is not None and len(rows):
            n = int(np.searchsorted(rows["key"].to_numpy(), passing, "right"))
            if n:
                yield back(rows.iloc[:n])
            rows = rows.iloc[n:]
        if not len(rows):
            continue
        keys, passing = rows["key"].to_numpy(), None
        inside = int(np.searchsorted(keys, keys[-1]))  # where the last key's rows begin
        if inside == 0 and carry and carry[-1]["key"].iloc[-1] == keys[-1]:
            carry.append(rows)
        else:
            whole = pd.concat([*carry, rows.iloc[:inside]])
            if len(whole):
                yield from settle(whole)
            carry = [rows.iloc[inside:]]
        if sum(map(len, carry)) > most and carry[0]["open"].iloc[0] != 0:
            yield back(pd.concat(carry))
            carry, passing = [], keys[-1]
    if carry:
        yield from settle(pd.concat(carry))


def deal_again(rows: pd.DataFrame, parts: int = THRESHOLD + 1) -> Iterator[pd.DataFrame]:
    """Each row under each part of its open bits, which are then settled."""
    for mask in rows["open"].unique().tolist():
        some = rows[rows["open"] == mask]
        places = [k for k in range(64) if mask >> k & 1]
        for number, part in enumerate(np.array_split(places, parts)):
            if len(part):
                own = np.array([sum(1 << int(k) for k in part)], np.uint64).view(np.int64)[0]
                mixed = some["key"].to_numpy().view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(number + 1)
                mixed = (mixed ^ (some["fp"].to_numpy() & own).view(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
                yield pd.DataFrame({"key": (mixed ^ mixed >> np.uint64(32)).view(np.int64), "fp": some["fp"], "home": some["home"], "open": mask & ~int(own)})


def near_pairs(prints: DataFrame, threshold: int = THRESHOLD, most: int = MOST_MEMBERS) -> DataFrame:
    """Links (a, b) between distinct fingerprints whose components equal those of all pairs within `threshold` bits."""
    if not 0 <= threshold <= 3:
        raise ValueError("the code covers thresholds up to 3")
    others = [np.array([~(BLOCK_MASK << BLOCK * block) & (1 << 64) - 1], np.uint64).view(np.int64)[0] for block in (0, 1)]

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            a, fp, home = anchors(rows["fp"].to_numpy())
            yield pd.DataFrame({"key": a, "fp": fp, "home": home, "open": np.where(a >> BLOCK, others[1], others[0])})

    kind, found = "key long, fp long, home boolean, open long", []
    rows = prints.select("fp").distinct().mapInPandas(spread, kind)
    while True:
        by_key = rows.repartition("key").sortWithinPartitions("key")
        compared = materialize(by_key.mapInPandas(lambda batches: compare_sorted(batches, threshold, most), COMPARED), "near-links")
        found.append(compared.filter("not again").select("a", "b"))
        large = compared.filter("again").select(F.col("a").alias("key"), F.col("b").alias("fp"), "home", "open")
        if large.isEmpty():
            return reduce(DataFrame.unionByName, found)
        rows = large.mapInPandas(lambda batches: (out for part in batches for out in deal_again(part)), kind)


def components_of(prints: DataFrame, first: Column, threshold: int) -> DataFrame:
    """(fp, first, component) for each distinct fingerprint; first: an aggregate over its rows."""
    distinct = prints.groupBy("fp").agg(first.alias("first"))
    parts = connected_components(near_pairs(prints, threshold))
    labelled = distinct.join(parts, distinct["fp"] == parts["node"], "left")
    return materialize(labelled.select("fp", "first", F.coalesce("component", "fp").alias("component")), "components")


def simhash_components(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of `docs`."""
    prints = materialize(fingerprint_column(docs), "fingerprints")
    labelled = components_of(prints, F.min("doc_id"), threshold)
    least = labelled.groupBy("component").agg(F.min("first").alias("component_id"))
    by_print = labelled.join(least, "component").select("fp", "component_id")
    return prints.join(by_print, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """One row of each component with all its columns: the first by (doc_id, text hash), a null doc_id after all
    others. Rows that repeat its doc_id and text leave one; rows that share a doc_id only, or have none, are told
    apart by their texts."""
    keyed = docs.withColumn("__th", F.xxhash64("text"))
    prints = materialize(fingerprint_column(keyed, ("doc_id", "__th")), "fingerprints")
    place = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "__th")
    heads = components_of(prints, F.min(place), threshold).groupBy("component").agg(F.min("first").alias("head"))
    heads = heads.select(F.col("head.doc_id").alias("__id"), F.col("head.__th").alias("__head"))
    chosen = keyed.join(heads, keyed["doc_id"].eqNullSafe(heads["__id"]) & (keyed["__th"] == heads["__head"]), "left_semi")
    return chosen.dropDuplicates(["doc_id", "__th"]).drop("__th")
