import numpy as np
import xxhash

from gapline.llm import simhash
from gapline.llm.components import connected_components


def brute_print(text):
    w = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()).split()
    s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, prints, threshold=3):
    label = list(range(len(ids)))
    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= threshold and label[i] != label[j]:
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    return [min((ids[k] for k in range(len(ids)) if label[k] == label[i] and ids[k] is not None), default=None) for i in range(len(ids))]


def test_anchor_cover_is_exact():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64)
    flips = [np.uint64(sum(1 << int(b) for b in rng.choice(64, k, replace=False))) for k in rng.integers(0, 5, 60)]
    for x, f in zip(base, flips):
        pair = np.array([x, x ^ f]).view(np.int64)
        a, fp, home = simhash.anchors(pair)
        met = {(int(k)) for k, v, h in zip(a, fp, home) if h and v == pair[0]} & {int(k) for k, v in zip(a, fp) if v == pair[1]}
        if int(f).bit_count() <= 3:
            assert met


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 100), (7, 7), (200, 201), (201, 203), (203, 200)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**{i: 0 for i in range(41)}, 90: 90, 100: 90, 200: 200, 201: 200, 203: 200}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_against_brute_force(spark):
    rng = np.random.default_rng(4)
    base = [" ".join(rng.choice(["Aa", "b", "cé", "d", "e9", "f", "g"], 60)) for _ in range(25)]
    texts = []
    for t in base:
        texts += [t, t.lower(), " ".join(t.split()[:-1]), t + " q", "  " + t.replace(" ", "\n")]
    texts += [None, "", "   ", "one", "one two", "ONE  two", "　"]
    rows = [(i * 3 + 1, t, "z") for i, t in enumerate(texts)] + [(None, texts[0], "z"), (1, texts[0], "z")]
    got = simhash.simhash_components(spark.createDataFrame(rows, "doc_id long, text string, fp string")).collect()
    prints = [brute_print(r[1]) for r in rows]
    want = [(r[0], f"{p:016x}", c) for r, p, c in zip(rows, prints, brute_components([r[0] for r in rows], prints))]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    kept = simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string, fp string"))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({w[2] for w in want})
    assert simhash.simhash_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_large_group_links_without_all_pairs():
    fp = np.arange(2000, dtype=np.int64)
    links = simhash._forest(fp, np.ones(2000, bool), 3)
    assert len(links) == 1999


def test_keep_first_keeps_a_row_of_each_component(spark):
    """Different texts without an id, or under one id, are all kept; copies are not."""
    rng = np.random.default_rng(6)
    a, b, c, d, e, f = (" ".join(rng.choice(["k", "l", "m", "n", "o", "p", "q", "r"], 80)) for _ in range(6))
    rows = [(None, a), (None, b), (None, a), (None, c), (3, c), (5, d), (5, e), (5, e), (4, f), (6, f), (6, d)]
    got = simhash.keep_first(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n int"))
    assert got.columns == ["doc_id", "text", "n"]
    assert sorted(map(str, (tuple(r)[:2] for r in got.collect()))) == sorted(map(str, [(None, a), (None, b), (3, c), (5, d), (5, e), (4, f)]))


def test_a_hot_anchor_is_dealt_out_again(spark):
    """Thousands of fingerprints that agree in one block: groups stay small, and all links are found."""
    rng = np.random.default_rng(9)
    fixed = int(rng.integers(0, 2**31))
    fp = [fixed | int(x) << 31 for x in rng.integers(0, 2**33, 1500)]
    fp += [x ^ sum(1 << int(b) for b in rng.choice(64, int(k), replace=False)) for x, k in zip(fp[:400], rng.integers(1, 6, 400))]
    fp = sorted(set(fp))
    table = spark.createDataFrame([(int(np.array([x], np.uint64).view(np.int64)[0]),) for x in fp], "fp long")
    parts = {}
    for most in (10, 40, 10_000):
        links = simhash.near_pairs(table, most=most)
        parts[most] = dict(map(tuple, connected_components(links).collect()))
    assert parts[10] == parts[40] == parts[10_000]
    values = np.array(fp, np.uint64)
    label = np.arange(len(fp))
    for i in range(len(fp)):
        near = np.flatnonzero(np.bitwise_count(values ^ values[i]) <= 3)
        joined = np.unique(label[near])
        label[np.isin(label, joined)] = joined[0]
    signed = values.view(np.int64)
    want = {}
    for k in np.unique(label):
        group = signed[label == k].tolist()
        if len(group) > 1:
            want |= dict.fromkeys(group, min(group))
    assert parts[10] == want
