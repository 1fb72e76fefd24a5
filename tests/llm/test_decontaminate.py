import hashlib
import re

import numpy as np

from gapline.llm import decontaminate as d

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, window=13):
    wins = {}
    for item, text in items:
        w = words(text)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            wins.setdefault(tuple(w[i : i + n]), set()).add(str(item))
    sizes = {len(k) for k in wins}
    out = []
    for doc, text in docs:
        w = words(text)
        hit, found = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (k := tuple(w[i : i + n])) in wins:
                    hit.update(range(i, i + n))
                    found |= wins[k]
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(found), sha, bool(hit) and 20 * len(hit) >= len(w)))
    return out


def test_suffix_array_and_search():
    rng = np.random.default_rng(3)
    for n, s in ((1, 2), (50, 2), (300, 5), (2000, 40)):
        text = rng.integers(1, s + 1, n)
        index = d.FMIndex(text, s + 1, sample=4)
        phrases = [text[i : i + k] for i in range(0, n, 7) for k in (1, 3, 6) if i + k <= n] + [rng.integers(1, s + 1, 4)]
        rows = np.zeros((len(phrases), 6), np.int64)
        for row, p in zip(rows, phrases):
            row[6 - len(p) :] = p
        low, high = index.search(rows, np.array([len(p) for p in phrases]))
        for p, a, b in zip(phrases, low, high):
            got = sorted(index.locate(np.arange(a, b)).tolist())
            assert got == [i for i in range(n - len(p) + 1) if (text[i : i + len(p)] == p).all()]


def test_against_brute_force(spark):
    rng = np.random.default_rng(5)
    vocab = ["a", "b", "c", "Dé", "x9", "zz"]
    text = lambda n: " ".join(rng.choice(vocab, n))
    items = [(1, text(20)), (2, text(13)), (3, "a b"), (4, ""), (5, None), (6, text(40)), (6, text(15)), (None, "zz zz zz a")]
    docs = [(i, text(int(n))) for i, n in enumerate(rng.integers(0, 60, 40))]
    docs += [(100, None), (101, ""), (102, "pre. " + items[0][1].upper().replace("É", "é") + "! post"), (102, items[1][1]), (None, items[5][1] * 2), (104, "a")]
    b = spark.createDataFrame(items, "item_id long, text string")
    want = [(x[0], *x[1:]) for x in brute(docs, [("" if i is None else i, t) for i, t in items])]
    for block_bytes, shard_bytes in ((10**6, 10**6), (60, 200)):
        df = spark.createDataFrame(docs, "doc_id long, text string")
        spans = d.removal_spans(df, b, block_bytes=block_bytes, shard_bytes=shard_bytes)
        assert {r["doc_id"]: len(r["items"]) for r in spans.collect() if r["doc_id"] != 102} == {x[0]: x[3] for x in want if x[0] != 102}
    got = d.contamination(df, b).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()
    key = lambda x: str(x)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_empty_tables_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b", 5, "x")], "doc_id long, text string, n_words int, item string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert d.contamination(docs, none).filter("contaminated").count() == 0
    assert d.contamination(docs.limit(0), none).count() == 0
