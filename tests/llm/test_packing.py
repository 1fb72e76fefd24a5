import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from gapline.llm import packing


def check(rows, capacity):
    by = {}
    for length, _, times, first, offset in rows:
        for k in range(times):
            by.setdefault(first + k, []).append((offset, length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    assert sorted(by) == list(range(len(by)))
    return len(by)


def test_plans_place_everything_and_are_tight():
    rng = np.random.default_rng(1)
    for n, top in ((0, 9), (1, 2048), (500, 2048), (5000, 900), (3000, 2048), (40, 3)):
        lengths = rng.integers(1, top + 1, n)
        values, counts = np.unique(lengths, return_counts=True)
        histogram = dict(zip(values.tolist(), counts.tolist()))
        rows = packing.make_plan(histogram, 2048)
        placed = {}
        for length, first, times, _, _ in rows:
            placed.setdefault(length, []).extend(range(first, first + times))
        assert {k: sorted(v) for k, v in placed.items()} == {k: list(range(v)) for k, v in histogram.items()}
        least = max(-(-int(lengths.sum()) // 2048), int((lengths > 1024).sum()))
        assert check(rows, 2048) <= least * 1.02 + 1


def test_exact_triples_are_found():
    assert check(packing.make_plan({5: 1, 3: 1, 2: 1, 7: 1, 1: 3}, 10), 10) == 2


def test_documents(spark):
    encoder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["", None, "hello world", "hello world", "né ☃ 漢字　x <|endoftext|>  \n\n y", "word " * 5000, "x" * 9000, "a <|endoftext|> b", "<|endoftext|>"]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(None, "a", 2)], "doc_id long, text string, length int")
    rows = packing.pack(docs).collect()
    for i, text in enumerate(texts):
        ids = np.array([*encoder.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        mine = sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows if r["doc_id"] == i)
        assert mine[0][1] == 0 and sum(m[2] for m in mine) == len(ids)
        assert all(m[2] == 2048 for m in mine[1:]) and all(m[3] == zlib.crc32(ids[m[1] : m[1] + m[2]].tobytes()) for m in mine)
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        assert all(a + n == b for (a, n), (b, _) in zip(sorted(parts), sorted(parts)[1:])) and sum(p[1] for p in parts) <= 2048
    assert packing.pack(docs.limit(0)).count() == 0


def test_both_encoders_agree():
    """Where the fast encoder is used it gives the ids of the other one."""
    encoder = packing.Encoder(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = np.random.default_rng(6)
    alphabet = [chr(c) for c in range(128)] + list("\xa1\xadéàßøñÿĀŐſƏǅɏ‐–—‘’“”•…‧€") + [" ", "  ", "\n", " \n ", "\r\n", "\t", "'s", "'LL", "the ", " 12", "<|endoftext|>"]
    fast = 0
    for _ in range(8000):
        text = "".join(rng.choice(alphabet, int(rng.integers(0, 30))))
        fast += bool(encoder.plain.fullmatch(text)) and "<|endoftext|>" not in text
        assert encoder.encode(text).tolist() == [*slow.encode(text, add_special_tokens=False).ids, 0], repr(text)
    assert fast > 4000


def test_frequent_lengths_are_salted(spark, monkeypatch):
    monkeypatch.setattr(packing, "CELL_ROWS", 7)
    docs = spark.createDataFrame([(i, "a b c") for i in range(60)] + [(i, "d") for i in range(5)], "doc_id long, text string")
    rows = packing.pack(docs).collect()
    assert len(rows) == 65 and {r["sequence_id"] for r in rows} == {0}
    spans = sorted((r["offset"], r["length"]) for r in rows)
    assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:]))
