"""Toxicity: a convolutional text classifier, trained in numpy.

A word's embedding is the sum of hashed rows for the word, its prefixes and its suffix. Filters of
several widths run over the word sequence, each is max-pooled over the whole text, and a logistic layer
gives the score. Training reads all labelled rows: shards of them learn side by side and are averaged after each
round. Scoring reads every whole text. Thresholds are calibrated by language; a score never sees the language.

Defined cases: a null or empty text scores like a text without words; rows with a null label are not
learned from; labels given twice count as toxic if any says so; of several texts under one id the first by text is
learned from, all are scored; texts of any length are read whole; repeated rows score alike; without any labelled row of
both classes every score is 0; an empty table gives no rows; columns named like the added ones are replaced.
"""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapline.llm.common import ALNUM_WORDS, chunks_by_bytes, crc_bucket, discard, encode, materialize, stable_hash

BUCKETS, DIM, WIDTHS, FILTERS, PAD = 1 << 16, 16, (1, 2, 3), 8, 2
GRAMS = ((None, None), (0, 3), (0, 4), (0, 5), (-4, None))
CALIBRATION_SHARE, STEPS = 5, 128
#: Training: rows and bytes of a shard, until there are SHARDS of them; rounds over all rows; rows and bytes of a batch; the
#: slices of the embeddings in which models are summed.
SHARD_ROWS, SHARD_BYTES, SHARDS, ROUNDS, BATCH, BATCH_BYTES, SLICES = 6000, 32_000_000, 256, 4, 48, 4_000_000, 64
DEFAULT_THRESHOLD = 0.7


def word_rows(word: bytes) -> list[int]:
    """The embedding rows of a word; row 0 is the zero row of padding."""
    return [1 + stable_hash(word[a:b], 17 * k + 1) % (BUCKETS - 1) for k, (a, b) in enumerate(GRAMS)]


class Vocabulary:
    """Word ids, with each word's embedding rows worked out once; forgets all beyond `limit` words."""

    def __init__(self, limit: int = 250_000):
        self.limit = limit
        self.clear()

    def clear(self) -> None:
        self.ids: dict[bytes, int] = {b"": 0}
        self.rows = np.zeros((1, len(GRAMS)), np.int64)
        self.projected: np.ndarray | None = None

    def index(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Word ids of all texts, each followed by padding, and where each text starts."""
        if len(self.ids) > self.limit:
            self.clear()
        ids, parts, starts, at = self.ids, [], [], 0
        pad = np.zeros(PAD, np.int32)
        for text in texts:
            words = text.translate(ALNUM_WORDS).split()
            for w in set(words):
                if w not in ids:
                    ids[w] = len(ids)
            parts += (np.fromiter(map(ids.__getitem__, words), np.int32, len(words)), pad)
            starts.append(at)
            at += len(words) + PAD
        known = len(self.rows)
        if len(ids) > known:
            fresh = [word_rows(w) for w in list(ids)[known:]]
            self.rows = np.concatenate([self.rows, np.array(fresh, np.int64)])
        return np.concatenate(parts), np.array(starts, np.int64)

    def project(self, model: dict) -> np.ndarray:
        """Each word's part in every filter at every place in it: one row of sum(WIDTHS) x FILTERS a word."""
        done = 0 if self.projected is None else len(self.projected)
        if done < len(self.rows):
            fresh = model["embed"][self.rows[done:]].sum(1) @ np.concatenate([k for kernel in model["kernels"] for k in kernel], 1)
            self.projected = fresh if not done else np.concatenate([self.projected, fresh])
        return self.projected


def pooled(projected: np.ndarray, flat: np.ndarray, starts: np.ndarray, where: bool = False):
    """Max-pooled filter outputs of each text, and on demand the positions of the maxima."""
    out, args, column = [], [], 0
    for width in WIDTHS:
        total = np.zeros((len(flat), FILTERS), np.float32)
        for k in range(width):
            total[: len(flat) - k] += np.ascontiguousarray(projected[:, column : column + FILTERS])[flat[k:]]
            column += FILTERS
        ends = np.append(starts[1:], len(flat))
        if where:
            args.append(np.stack([a + total[a:b].T.copy().argmax(1) for a, b in zip(starts, ends)]))
            out.append(np.take_along_axis(total, args[-1], 0))
        else:
            out.append(np.stack([total[a:b].max(0) for a, b in zip(starts, ends)]))
    features = np.concatenate(out, 1)
    return (features, np.concatenate(args, 1)) if where else features


def squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def raw_scores(model: dict, texts: list[bytes]) -> np.ndarray:
    scores, vocabulary = np.zeros(len(texts)), model.setdefault("vocabulary", Vocabulary())
    for part in chunks_by_bytes([len(t) for t in texts], 4_000_000):
        flat, starts = vocabulary.index(texts[part])
        features = pooled(vocabulary.project(model), flat, starts)
        scores[part] = np.maximum(features + model["shift"], 0) @ model["out"] + model["bias"]
    return scores


def score_texts(model: dict | None, texts: list[bytes]) -> np.ndarray:
    if model is None:
        return np.zeros(len(texts))
    return squash(model["slope"] * raw_scores(model, texts) + model["offset"])


def fresh_model(seed: int = 7) -> dict:
    """A model before training. `squares` are Adagrad's sums of squared gradients, which go from round to round with it."""
    rng = np.random.default_rng(seed)
    model = {
        "embed": rng.normal(0, 0.15, (BUCKETS, DIM)).astype(np.float32),
        "kernels": [rng.normal(0, 0.4, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS],
        "shift": np.full(len(WIDTHS) * FILTERS, -0.3, np.float32),
        "out": rng.normal(0, 0.4, len(WIDTHS) * FILTERS).astype(np.float32),
        "bias": np.float32(0),
        "slope": 1.0,
        "offset": 0.0,
        "thresholds": {},
    }
    model["embed"][0] = 0
    model["out"] = np.abs(model["out"])
    model["squares"] = {"embed": np.full(BUCKETS, 1e-6, np.float32)} | {k: np.full(np.shape(model[k]), 1e-6, np.float32) for k in ("shift", "out", "bias")}
    model["squares"] |= {("k", i): np.full(k.shape, 1e-6, np.float32) for i, k in enumerate(model["kernels"])}
    return model


def learn(model: dict, vocabulary: Vocabulary, texts: list[bytes], labels: np.ndarray, weight: np.ndarray, rate: float) -> np.ndarray:
    """One Adagrad step on a batch, in place; the embedding rows that it touched."""
    squares = model["squares"]
    flat, starts = vocabulary.index(texts)
    words, flat = np.unique(flat, return_inverse=True)
    rows = vocabulary.rows[words]
    vectors = model["embed"][rows].sum(1)
    features, args = pooled(vectors @ np.concatenate([k for kernel in model["kernels"] for k in kernel], 1), flat, starts, True)
    active = features + model["shift"]
    hidden = np.maximum(active, 0)
    p = squash(hidden @ model["out"] + model["bias"])
    error = ((p - labels) * weight / len(texts)).astype(np.float32)
    d_out = hidden.T @ error + 1e-4 * model["out"]
    d_hidden = np.outer(error, model["out"]) * (active > 0)
    d_shift, d_bias = d_hidden.sum(0), error.sum()
    touched, gradients = [], []
    for i, width in enumerate(WIDTHS):
        columns = slice(i * FILTERS, (i + 1) * FILTERS)
        at, d = args[:, columns], d_hidden[:, columns]
        d_kernel = np.zeros_like(model["kernels"][i])
        for k in range(width):
            word = flat[np.minimum(at + k, len(flat) - 1)]
            vec = vectors[word]  # texts x filters x DIM
            d_kernel[k] = np.einsum("tfd,tf->df", vec, d)
            d_vec = d[:, :, None] * model["kernels"][i][k].T[None]
            live = (d != 0) & (words[word] != 0)
            touched.append(rows[word[live]].ravel())
            gradients.append(np.repeat(d_vec[live], len(GRAMS), 0))
        squares["k", i] = squares["k", i] + d_kernel**2
        model["kernels"][i] = (model["kernels"][i] - rate * d_kernel / np.sqrt(squares["k", i])).astype(np.float32)
    at, d = np.concatenate(touched), np.concatenate(gradients)
    unique, inverse = np.unique(at, return_inverse=True)
    if len(unique):
        total = np.zeros((len(unique), DIM), np.float32)
        np.add.at(total, inverse, d)
        squares["embed"][unique] += (total**2).mean(1)
        model["embed"][unique] -= rate * total / np.sqrt(squares["embed"][unique])[:, None]
    for name, d in (("shift", d_shift), ("out", d_out), ("bias", d_bias)):
        squares[name] = squares[name] + d**2
        model[name] = (model[name] - rate * d / np.sqrt(squares[name])).astype(np.float32)
    return unique


#: The arrays of `dense`: kernels and their squares, then shift, out and bias and their squares.
SHAPES = [(w, DIM, FILTERS) for w in WIDTHS] * 2 + [(len(WIDTHS) * FILTERS,), (len(WIDTHS) * FILTERS,), ()] * 2


def dense(model: dict) -> np.ndarray:
    """All numbers but the embeddings and their squares, in one row."""
    squares = model["squares"]
    parts = [*model["kernels"], *[squares["k", i] for i in range(len(WIDTHS))], *[x[k] for x in (model, squares) for k in ("shift", "out", "bias")]]
    return np.concatenate([np.ravel(p) for p in parts]).astype(np.float64)


def assembled(embed: np.ndarray, embed_squares: np.ndarray, numbers: np.ndarray) -> dict:
    """The model of its embeddings and of what `dense` gave."""
    arrays = [a.reshape(s).astype(np.float32) for a, s in zip(np.split(numbers, np.cumsum([int(np.prod(s)) for s in SHAPES])[:-1]), SHAPES)]
    n = len(WIDTHS)
    squares = {"embed": embed_squares} | {("k", i): k for i, k in enumerate(arrays[n : 2 * n])} | dict(zip(("shift", "out", "bias"), arrays[-3:]))
    return {"embed": embed, "kernels": arrays[:n], "squares": squares, "slope": 1.0, "offset": 0.0, "thresholds": {}} | dict(zip(("shift", "out", "bias"), arrays[2 * n :]))


def learn_shard(packed: bytes, batches, balance: tuple[float, float], rounds: range):
    """What one shard's rows make of the model, as parts to be summed over shards: (slice, numbers). An embedding row counts
    by the batches that touched it, so that a word that few shards hold is not thinned out by the others; the rest counts by
    rows. Rows stream through; they are held if they are to be read more than once."""
    model, vocabulary = unpack(packed), Vocabulary()
    before = model["embed"].copy(), model["squares"]["embed"].copy()
    steps, n_rows = np.zeros(BUCKETS, np.float32), 0

    def parts():
        for rows in batches:
            texts, labels = [encode(t) for t in rows["text"]], rows["toxic"].to_numpy(np.float64)
            for part in chunks_by_bytes([len(t) for t in texts], BATCH_BYTES):
                for a in range(part.start, part.stop, BATCH):
                    yield texts[a : min(a + BATCH, part.stop)], labels[a : min(a + BATCH, part.stop)]

    held = list(parts()) if len(rounds) > 1 else None
    for k in rounds:
        if held:  # other batches in each round
            texts, labels = [t for b in held for t in b[0]], np.concatenate([b[1] for b in held])
            order = np.random.default_rng(k).permutation(len(texts))
            cuts = [order[part] for part in chunks_by_bytes([len(texts[i]) for i in order], BATCH_BYTES)]
            turns = [([texts[i] for i in c], labels[c]) for cut in cuts for c in np.array_split(cut, -(-len(cut) // BATCH))]
        else:
            turns = parts()
        n_rows = 0
        for texts, labels in turns:
            n_rows += len(texts)
            steps[learn(model, vocabulary, texts, labels, np.where(labels == 1, balance[1], balance[0]), 0.12 / (1 + 0.15 * k))] += 1
    if n_rows:
        moved = np.concatenate([model["embed"] - before[0], (model["squares"]["embed"] - before[1])[:, None], np.ones((BUCKETS, 1), np.float32)], 1) * steps[:, None]
        for i, numbers in enumerate(np.split(moved, SLICES)):
            yield i, numbers.astype(np.float32).tobytes()
        yield SLICES, np.append(dense(model) * n_rows, n_rows).tobytes()


def sum_parts(rows: pd.DataFrame) -> pd.DataFrame:
    """The parts of one slice, of all shards: at most SHARDS of some 70 KB."""
    at, rows = rows["slice"].iloc[0], rows.sort_values("shard")
    kind = np.float64 if at == SLICES else np.float32
    total = np.zeros(len(rows["numbers"].iloc[0]) // np.dtype(kind).itemsize)
    for numbers in rows["numbers"]:
        total += np.frombuffer(numbers, kind)
    return pd.DataFrame({"slice": [at], "numbers": [total.tobytes()]})


def averaged(packed: bytes, sums: dict[int, bytes]) -> bytes:
    """The model with the shards' average put in place."""
    model = unpack(packed)
    moved = np.concatenate([np.frombuffer(sums[i]) for i in range(SLICES)]).reshape(BUCKETS, DIM + 2)
    moved = (moved / np.maximum(moved[:, -1:], 1)).astype(np.float32)
    numbers = np.frombuffer(sums[SLICES])
    return pack(assembled(model["embed"] + moved[:, :DIM], model["squares"]["embed"] + moved[:, DIM], numbers[:-1] / numbers[-1]))


def calibrated(raw: np.ndarray, truth: np.ndarray, count: np.ndarray) -> tuple[float, float]:
    """Slope and offset from raw scores, of which each stands for `count` rows of one class."""
    share = (truth * count).sum() / count.sum()
    balance = np.where(truth == 1, 0.5 / share, 0.5 / (1 - share)) * count / count.sum()
    a, b = 1.0, 0.0
    for _ in range(400):
        gap = (squash(a * raw + b) - truth) * balance
        a, b = max(0.05, a - 0.5 * float(gap @ raw)), b - 0.5 * float(gap.sum())
    return a, b


def best_threshold(p: np.ndarray, truth: np.ndarray, count: np.ndarray, least: int = 10) -> float:
    """The threshold of best F1, midway in its gap, within 0.3 and 0.9; the default where a class is rare. Scores are steps
    from the highest down, and each stands for `count` rows, `truth` of them toxic."""
    if truth.sum() < least or (count - truth).sum() < least:
        return DEFAULT_THRESHOLD
    f1 = 2 * np.cumsum(truth) / (np.cumsum(count) + truth.sum())
    k = int(f1.argmax())
    below = p[k + 1] if k + 1 < len(p) else 0.0
    return float(np.clip((p[k] + below) / 2, 0.3, 0.9))


def pack(model: dict | None) -> bytes:
    if model is None:
        return b""
    out = io.BytesIO()
    names = sorted(model["thresholds"])
    values = np.array([model["thresholds"][n] for n in names])
    np.savez(out, langs=np.array(names, "U"), values=values, line=np.array([model["slope"], model["offset"]]), embed=model["embed"], squares=model["squares"]["embed"], dense=dense(model))
    return out.getvalue()


def unpack(data: bytes) -> dict | None:
    if not data:
        return None
    got = np.load(io.BytesIO(data))
    line = dict(zip(("slope", "offset"), map(float, got["line"])))
    return assembled(got["embed"], got["squares"], got["dense"]) | line | {"thresholds": dict(zip(map(str, got["langs"]), map(float, got["values"])))}


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, text, lang, toxic, held): all labelled documents whose crc32(doc_id) modulo 3 is not 1. held: those that do not
    train but calibrate."""
    known = labels.filter("doc_id is not null and toxic is not null").filter(crc_bucket(F.col("doc_id"), 3) != 1)
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    lang = F.col("lang") if "lang" in docs.columns else F.lit("")
    rows = docs.filter(crc_bucket(F.col("doc_id"), 3) != 1).select("doc_id", "text", F.coalesce(lang, F.lit("")).alias("lang")).join(known, "doc_id")
    rows = rows.groupBy("doc_id").agg(F.min(F.struct("text", "lang", "toxic")).alias("r"))
    held = F.crc32(F.coalesce("r.text", F.lit("")).cast("binary")) % CALIBRATION_SHARE == 0
    return rows.select(F.col("doc_id").cast("string").alias("key"), "r.text", "r.lang", F.col("r.toxic").cast("int").alias("toxic"), held.alias("held"))


def trained(rows: DataFrame, n_rows: int, n_bytes: int, share: float) -> bytes:
    """The packed model of all rows (key, text, toxic), of which `share` are toxic. Shards learn side by side from the same
    model and are averaged after each round over all rows; a single shard reads its rows as often as few rows need. Each
    round deals the rows out anew, so that shards mix."""
    spark, balance = rows.sparkSession, (0.5 / (1 - share), 0.5 / share)
    shards = max(1, min(SHARDS, max(-(-n_rows // SHARD_ROWS), -(-n_bytes // SHARD_BYTES))))
    passes = int(np.clip(36_000 / n_rows, ROUNDS, 40))  # small tables are read more often
    packed = pack(fresh_model())
    for rounds in [range(passes)] if shards == 1 else [range(k, k + 1) for k in range(ROUNDS)]:
        held_model = spark.sparkContext.broadcast(packed)

        def run(batches, rounds=rounds, held_model=held_model):
            place = TaskContext.get().partitionId()
            for at, numbers in learn_shard(held_model.value, batches, balance, rounds):
                yield pd.DataFrame({"slice": [at], "shard": [place], "numbers": [numbers]})

        mixed = F.xxhash64("key", F.lit(rounds[0]))
        dealt = rows.withColumn("mixed", mixed).repartitionById(shards, F.pmod("mixed", F.lit(shards)).cast("int"))
        parts = dealt.sortWithinPartitions("mixed", "key").select("text", "toxic").mapInPandas(run, "slice int, shard int, numbers binary")
        sums = parts.groupBy("slice").applyInPandas(sum_parts, "slice int, numbers binary").collect()  # the size of one model
        packed = averaged(packed, {r["slice"]: bytes(r["numbers"]) for r in sums})
        held_model.unpersist()
    return packed


def with_calibration(rows: DataFrame, packed: bytes) -> bytes:
    """The packed model with slope, offset and thresholds by language, from all rows (text, lang, toxic). Raw scores are
    counted by steps of 1 / STEPS, each of which stands as its rows' mean."""
    spark = rows.sparkSession
    held_model = spark.sparkContext.broadcast(packed)

    def run(batches):
        model = unpack(held_model.value)
        for part in batches:
            yield part[["lang", "toxic"]].assign(raw=np.clip(raw_scores(model, [encode(t) for t in part["text"]]), -30, 30))

    raw = rows.select("text", "lang", "toxic").mapInPandas(run, "lang string, toxic int, raw double")
    step = F.floor(F.col("raw") * STEPS).alias("step")
    # of each language and step a row; the mean of sums of whole numbers, so that their order does not show
    steps = raw.groupBy("lang", step).agg(F.sum("toxic").alias("toxic"), F.count("*").alias("n"), (F.sum(F.round(F.col("raw") * (1 << 20)).cast("long")) / F.count("*") / (1 << 20)).alias("raw"))
    steps = materialize(steps, "toxicity-steps")
    total = steps.groupBy("step").agg(F.sum("toxic").alias("toxic"), F.sum("n").alias("n"), F.avg("raw").alias("raw")).orderBy("step").toPandas()  # 60 * STEPS rows at most
    point, bad, count = total["raw"].to_numpy(), total["toxic"].to_numpy(float), total["n"].to_numpy(float)
    slope, offset = calibrated(np.tile(point, 2), np.repeat([1.0, 0.0], len(point)), np.concatenate([bad, count - bad]))

    def threshold(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("step", ascending=False)
        found = best_threshold(squash(slope * part["raw"].to_numpy() + offset), part["toxic"].to_numpy(float), part["n"].to_numpy(float))
        return pd.DataFrame({"lang": [part["lang"].iloc[0]], "threshold": [found]})

    found = steps.filter("lang <> ''").groupBy("lang").applyInPandas(threshold, "lang string, threshold double")
    limits = {r["lang"]: r["threshold"] for r in found.filter(F.col("threshold") != DEFAULT_THRESHOLD).collect()}  # a number a language
    discard(steps)
    return pack(unpack(packed) | {"slope": slope, "offset": offset, "thresholds": limits})


def fit(docs: DataFrame, labels: DataFrame) -> bytes:
    """The packed model, learned from all labelled documents whose crc32(doc_id) modulo 3 is not 1: a fifth of them, chosen
    by their texts, calibrates, the rest trains; all do both if either part lacks a class."""
    rows = materialize(labelled(docs, labels), "toxicity-rows")
    counted = {r["held"]: r for r in rows.groupBy("held").agg(F.count("*").alias("n"), F.sum("toxic").alias("bad"), F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).alias("size")).collect()}
    mixed = lambda r: r is not None and 0 < r["bad"] < r["n"]
    apart = mixed(counted.get(True)) and mixed(counted.get(False))
    used = [r for held, r in counted.items() if not (apart and held)]
    n, bad, size = (sum(r[k] for r in used) for k in ("n", "bad", "size"))
    packed = b""
    if 0 < bad < n:
        packed = trained(rows.filter("not held") if apart else rows, n, size, bad / n)
        packed = with_calibration(rows.filter("held") if apart else rows, packed)
    discard(rows)
    return packed


def classify(docs: DataFrame, packed: bytes, threshold: float = DEFAULT_THRESHOLD) -> DataFrame:
    """Adds score, predicted (score >= threshold) and rejected (score >= the threshold of the row's language)
    to all columns of `docs`. The model's size is fixed: BUCKETS x DIM numbers and a few more."""
    held_model = docs.sparkSession.sparkContext.broadcast(packed)
    extra = {"score": "double", "predicted": "int", "rejected": "boolean"}
    kept = [c for c in docs.columns if c not in extra]
    has_lang = "lang" in kept

    def run(batches):
        model = unpack(held_model.value)
        limits = model["thresholds"] if model else {}
        for rows in batches:
            score = score_texts(model, [encode(t) for t in rows["text"]])
            by_lang = [limits.get(x, threshold) for x in rows["lang"]] if has_lang else threshold
            yield rows.assign(score=score, predicted=(score >= threshold).astype("int32"), rejected=(score >= by_lang) & (score > 0))

    source = docs.select(*kept)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema] + [f"{k} {v}" for k, v in extra.items()])
    return source.mapInPandas(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return classify(docs, fit(docs, labels))
