import math
import re
import zlib

import numpy as np
import pytest

from gapline.llm import lm

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def brute_base(rows):
    counts, out = {}, []
    toks = lambda t: [*WORD.findall(lowered(t)), ""]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    for i, t in rows:
        if not held(i):
            for w in toks(t):
                counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    for i, t in rows:
        base = sum(math.log10((counts.get(w, 0) + 1) / (n + v + 1)) for w in toks(t))
        out.append((i, held(i), len(toks(t)), sum(w in counts for w in toks(t)), n, base))
    return out


def corpus(n=140):
    rng = np.random.default_rng(5)
    stems = ["".join(rng.choice(list("abcdeé"), 3)) for _ in range(60)]
    text = lambda k: " ".join(stems[int(x)] + rng.choice(["", "ing", "ed"]) for x in np.minimum(rng.geometric(0.08, k), 59))
    rows = [(i, text(int(rng.integers(1, 60)))) for i in range(n)]
    return rows + [(500, None), (501, ""), (502, "  \n\t a  b\r\n"), (None, "Abc ABC"), (7, rows[7][1]), (503, "x" * 3000), (504, "zz zz zz zz " * 200)]


def test_counts_and_base_against_brute_force(spark):
    rows = corpus()
    got = lm.score_documents(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, score int")).collect()
    want = brute_base(rows)
    key = lambda x: (x[0] is None, x[0] or 0, x[2])
    for g, w in zip(sorted((tuple(r) for r in got), key=key), sorted(want, key=key)):
        assert g[:5] == w[:5]
        assert math.isclose(g[5], w[5], rel_tol=1e-9)
        assert math.isfinite(g[6]) and g[6] < 0


def test_repeated_texts_cost_less(spark):
    """Texts that repeat their own words are cheaper by the word than the counts alone say; unknown words get finite costs."""
    rng = np.random.default_rng(8)
    once, twice = (" ".join("".join(rng.choice(list("abcdeé"), 6)) for _ in range(40)) for _ in range(2))
    rows = [*corpus(300), (600, once), (601, twice), (602, twice)]
    got = {r["doc_id"]: r for r in lm.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[504]["score"] > got[504]["base_score"]
    assert all(math.isclose(r["bits_per_byte"] * r["n_bytes"], -r["score"] / math.log10(2), abs_tol=1e-6) for r in got.values() if r["n_bytes"])
    assert max(got[601]["score"], got[602]["score"]) > 0.5 * got[600]["score"]


def spelled_alone(model, unit, bits):
    """A unit's log10 probability, one bit after the other, in plain numbers."""
    gap = not unit or (unit[:1] in lm.BLANKS and unit != lm.EMPTY)
    text = (b"" if unit == lm.EMPTY else unit) + (b"\0" if gap else b" ")
    full, cost = (1 << 64) - 1, 0.0
    for at, byte in enumerate(text):
        history, contexts = (7 if gap else 3) * 0x9E3779B97F4A7C15 & full, []
        for back in range(1, 7):
            before = text[at - back] + 1 if at >= back else 0
            history = (history ^ (before + (back << 10))) * 0xD6E8FEB86659FD93 & full
            history ^= history >> 32
            if back in lm.ORDERS:
                contexts.append(history)
        for place in range(7, -1, -1):
            bit, node, gate = byte >> place & 1, (1 << 7 - place) + (byte >> place + 1), place * 2 + gap
            dot = model.weights[gate, -1]
            for k, context in enumerate(contexts):
                offset, size = lm.tables(bits)[k]
                mixed = (context + node) * 0xA0761D6478BD642F & full
                mixed ^= mixed >> 29
                zeros, ones = (float(lm.STORED[c]) for c in model.stored[offset + ((mixed * 0xE7037ED1A0B428DB & full) >> 64 - size)])
                level = min(int(zeros + ones).bit_length(), lm.LEVELS - 1)
                dot += math.log((ones + lm.ADDED) / (zeros + lm.ADDED)) * model.weights[gate, k * lm.LEVELS + level]
            step = min(max(round(2 * dot + lm.STEPS / 2 - 0.5), 0), lm.STEPS - 1)
            previous = text[at - 1] if at else 0
            p = (1 / (1 + math.exp(-dot)) + model.map_ones[previous, step] / model.map_all[previous, step]) / 2
            cost += math.log10(p if bit else 1 - p)
    return cost


def learned_model(units, bits=14):
    counts = np.zeros((lm.tables(bits)[-1][0], 2), np.int32)
    lm.count_bits(units, np.ones(len(units), np.int64), bits, counts)
    model = lm.Model(bits, lm.quantize(counts))
    model.pass_over(units, np.ones(len(units), np.int64), True)
    return model, bits


def test_spelling_against_one_bit_at_a_time():
    rng = np.random.default_rng(3)
    units = sorted({"".join(rng.choice(["ab", "ti", "on", "é", "x"], int(rng.integers(1, 5)))).encode() for _ in range(300)})
    model, bits = learned_model([*units, b"", b"  ", b"\n"])
    tried = [*units[:40], b"", lm.EMPTY, b"\n", b"  ", b"zzz", b"abq", "漢字".encode()]
    got = model.pass_over(tried, np.ones(len(tried)), False)
    for unit, g in zip(tried, got):
        assert math.isclose(g, spelled_alone(model, unit, bits), rel_tol=1e-3), unit


def test_spelling_model_is_a_distribution():
    """Over all next bytes of a unit the probabilities add to one: no bit is paid for twice or not at all."""
    model, _ = learned_model([b"abc", b"abd", b"b"], 12)
    # a one-byte unit is its byte and the terminator; the terminator alone is the empty word
    one = model.pass_over([bytes([c]) for c in range(256) if bytes([c]) not in (b" ", b"\t", b"\n", b"\r", b"\x0b", b"\x0c")], np.ones(250, np.int64), False)
    assert (10.0**one).sum() < 1.0
    known, unknown = model.pass_over([b"abc", b"qzx"], np.ones(2, np.int64), False)
    assert known > unknown


def brute_scores(rows, spelled, share, tokens, gaps, follower):
    """Each text's score by going through it word by word; needs the learned spelling scores and mixing weights."""
    is_held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    count, pairs = {}, {}
    cut = []
    for i, t in rows:
        words, others, blank = lm.units_of(lowered(t).encode())
        words = [*words, b""]
        cut.append((i, words, others[:-1] + [b" "] * blank))
        if not is_held(i):
            for u in words + cut[-1][2]:
                count[u] = count.get(u, 0) + 1
            for p in zip([b"", *words], words):
                pairs[p] = pairs.get(p, 0) + 1
    out = []
    for i, words, others in cut:
        mine = 0 if is_held(i) else 1
        chain = list(zip([b"", *words], words))
        score, history, strengths = 0.0, [], [0, 0]
        for at, (before, word) in enumerate(chain):
            after = count.get(before, 0) - mine * (words.count(before) if at else 1)
            both = pairs.get((before, word), 0) - mine * chain.count((before, word))
            bit = both > 0
            if after:
                own = min(after.bit_length(), 15)
                h = lambda k: sum(b << n for n, b in enumerate(history[::-1][:k]))  # noqa: E731, B023
                one, two = strengths[-1], strengths[-2]
                slots = [own, h(6), one * 16 + own, (one * 8 + two) * 16 + h(4), own * 8 + h(3), h(12)]
                gate = one * 8 + own // 2
                dot = follower.weights[gate, -1] + sum(follower.logits[s + o] * w for s, o, w in zip(slots, follower.OFFSETS, follower.weights[gate]))
                step = min(max(round(2 * dot + lm.STEPS / 2 - 0.5), 0), lm.STEPS - 1)
                p = (1 / (1 + math.exp(-dot)) + follower.maps[0, h(4), step] / follower.maps[1, h(4), step]) / 2
                score += math.log10(p if bit else 1 - p)
            if bit:
                score += math.log10(both / after)
            else:
                others_n = max(tokens - mine * len(words), 1)
                static = share * (count.get(word, 0) - mine * words.count(word)) / others_n + (1 - share) * 10 ** spelled[word]
                cached = lm.CACHE_SHARE * at / (at + lm.CACHE_WORDS)
                score += math.log10((1 - cached) * static + cached * words[:at].count(word) / max(at, 1))
            history.append(int(bit))
            strengths.append(min(both.bit_length(), 7))
        for u in others:
            score += math.log10(0.999 * count.get(u, 0) / max(gaps, 1) + 0.001 * 10 ** spelled[u])
        out.append((i, score))
    return out


def test_score_against_brute_force(spark):
    rows = [r for r in corpus(60) if r[0] != 503]
    found = lm.mark(spark.createDataFrame(rows, "doc_id long, text string"), 7, 2)
    pieces = found.units.toPandas()
    spelled = {u: float(x) for (units, _), data in zip(lm.unit_lists(pieces, False), pieces["spelled"]) for u, x in zip(units, lm.grow(data, np.float32))}
    follower = lm.fit_follower(found.marked)
    want = brute_scores(rows, spelled, found.share, found.tokens, found.gaps, follower)
    got = [(r["doc_id"], r["score"]) for r in lm.finish(found.marked, found.tokens, follower).collect()]
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    for g, w in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert g[0] == w[0] and math.isclose(g[1], w[1], rel_tol=1e-5), (g, w)


def test_score_rests_on_the_mixers(spark):
    """Bits spelled at random in place of the mixer's prediction change the score by more than a fifth."""
    rng = np.random.default_rng(4)
    parts = ["ti", "on", "er", "and", "th", "es", "re", "ing", "at", "ou", "ha", "in"]
    word = lambda: str(rng.choice(["the", "of", "a"])) if rng.random() < 0.4 else "".join(rng.choice(parts, int(rng.integers(2, 5))))
    rows = [(i, " ".join(word() for _ in range(60))) for i in range(200)]
    found = lm.mark(spark.createDataFrame(rows, "doc_id long, text string"), 7, 2)
    follower = lm.fit_follower(found.marked)
    scores = lm.finish(found.marked, found.tokens, follower).collect()
    units = {u: -8 * (len(u) + 1) * math.log10(2) for units, _ in lm.unit_lists(found.units.toPandas(), False) for u in units}
    idle = lm.Follower(np.ones((2, lm.Follower.OFFSETS[-1]), np.int64))
    random = sum(x for _, x in brute_scores(rows, units, found.share, found.tokens, found.gaps, idle))
    assert sum(r["score"] for r in scores) > 0.8 * random


def marked_rows(docs):
    return sorted(map(str, (tuple(r) for r in lm.mark(docs, 7, 2).marked.drop("coded").collect())))


def test_many_blocks_are_merged_in_steps(spark, monkeypatch):
    """Blocks of a few texts, sent to their pieces at once or in steps of two bits: the same counts come back."""
    docs = spark.createDataFrame(corpus(60), "doc_id long, text string").repartition(3)
    monkeypatch.setattr(lm, "BLOCK_BYTES", 400)
    monkeypatch.setattr(lm, "PIECE_BYTES", 800)
    whole = marked_rows(docs)
    monkeypatch.setattr(lm, "FAN_BITS", 2)
    assert marked_rows(docs) == whole


def test_rows_grow_with_the_corpus(spark, monkeypatch):
    """Twice the texts, twice the rows and one step more at most."""
    monkeypatch.setattr(lm, "BLOCK_BYTES", 400)
    monkeypatch.setattr(lm, "PIECE_BYTES", 800)
    monkeypatch.setattr(lm, "FAN_BITS", 2)

    def sent(n):
        rows = [(i, f"w{i} w{i % 7} v{i} u{i} x{i} y{i} z{i}") for i in range(n)]
        docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
        pieces = lm.Pieces.of(sum(len(t) for _, t in rows))
        cut = lm.blocks(docs, "false", pieces)
        way = lm.Exchange.of(pieces.bits, cut.count())
        units = [u.filter("from_grp >= 0").count() for u in lm.sent_units(cut, way)]
        pairs = [u.filter("from_grp >= 0").count() for u in lm.pair_answers(cut, pieces, way)[1]]
        return cut.count(), way.steps, max(units), max(pairs)

    for n in (150, 300, 600):
        blocks, steps, units, pairs = sent(n)
        assert max(units, pairs) <= blocks * 2 ** (lm.FAN_BITS + 1) and steps <= blocks.bit_length()


def test_steps_keep_their_width():
    for bits, n in ((1, 1), (4, 40), (15, 62_500), (22, 6_000_000), (3, 100_000)):
        way = lm.Exchange.of(bits, n)
        assert way.piece_bits[-1] == bits and way.group_bits[-1] == 0
        for x in (way.piece_bits, way.group_bits):
            assert all(abs(a - b) <= lm.FAN_BITS for a, b in zip(x, x[1:]))


def test_without_training_rows(spark):
    held = [i for i in range(40) if zlib.crc32(str(i).encode()) % 7 == 2]
    got = lm.score_documents(spark.createDataFrame([(i, "a b") for i in held], "doc_id long, text string")).collect()
    assert len(got) == len(held) and all(r["train_tokens"] == 0 and r["n_known"] == 0 and math.isfinite(r["score"]) for r in got)
    assert lm.score_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_large_counts_keep_their_ratio():
    pairs = np.array([[8_000_000, 500_000_000], [500_000_000, 8_000_000], [3, 5], [2**40, 2**40]])
    zeros, ones = lm.STORED[lm.quantize(pairs)].T
    assert ones[0] / zeros[0] == pytest.approx(62.5, rel=0.1) and zeros[1] / ones[1] == pytest.approx(62.5, rel=0.1)
    assert (zeros[2], ones[2]) == (3, 5) and zeros[3] == ones[3] == lm.STORED[-1]
