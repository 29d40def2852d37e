"""Quality classifier: a linear support vector machine on Naive Bayes features.

Features of a text are indicators of n-grams: words, pairs of words, and singles and
triples of word shapes (what kinds of characters a word has, in which order, and
whether it repeats the word before), hashed into ``2 ** BITS`` places.  An indicator is
scaled by the log ratio of its smoothed counts in the two classes, texts are brought
to unit length, and a hinge-loss model is fitted by dual coordinate descent.  A share
of the training rows is kept back to turn margins into probabilities by a logistic
curve.

The fit uses at most ``SAMPLE`` labelled rows, those whose ids' hashes are smallest, so
that the driver's work and memory have a fixed bound; scoring covers all rows, whole
texts.  Only the text is an input of a score.

Cases: null and empty texts get the score of a text without n-grams; labels that are
null are not learnt from; of an id with several labels the least counts, of one with several
texts the least; without rows
of both classes every score is the training rows' mean label (0.5 without any); an
empty table gives an empty result.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doctide.llm.work import carried, sliced, with_carried

BITS, SAMPLE, KEPT_BACK = 20, 6000, 6
SMOOTHING, COST, EPOCHS, SEED = 1.0, 1.0, 20, 5
THRESHOLD = 0.3
WORDS_KEPT = 300_000

_SHAPES = (
    (re.compile(rb"[a-z]+"), b"a"), (re.compile(rb"[A-Z]+"), b"A"), (re.compile(rb"[0-9]+"), b"0"),
    (re.compile(rb"[\x80-\xff]+"), b"u"),
)
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _B
    return x ^ (x >> np.uint64(29))


def shape(word: bytes) -> bytes:
    """Kinds of characters, runs as one; a leading capital counts as a letter."""
    out = bytes((word[0] | 32,)) + word[1:] if 65 <= word[0] <= 90 else word
    for pattern, sign in _SHAPES:
        out = pattern.sub(sign, out)
    out = out.replace(b"ua", b"a").replace(b"au", b"a").replace(b"u", b"a")
    return re.sub(rb"(.)\1+", rb"\1", out)[:8]


class _Words(dict):
    def __missing__(self, word):
        pair = self[word] = (xxhash.xxh3_64_intdigest(word.lower()), xxhash.xxh3_64_intdigest(shape(word), 7))
        return pair


class Features:
    def __init__(self, bits: int = BITS):
        self.bits, self.words = bits, _Words()

    def of(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """(flat feature numbers, distinct and sorted within a text, number of features of each text)."""
        if len(self.words) > WORDS_KEPT:
            self.words.clear()
        split = [t.split() if t else [] for t in texts]
        counts = np.array([len(w) for w in split], np.int64)
        n = int(counts.sum())
        both = np.fromiter((x for ws in split for w in ws for x in self.words[w]), np.uint64, 2 * n)
        word, form = both[::2], both[1::2]
        text = np.repeat(np.arange(len(split), dtype=np.int64), counts)
        same = np.append(False, (word[1:] == word[:-1]) & (text[1:] == text[:-1]))[:n]
        form = np.where(same, form ^ _A, form)
        parts, owners = [_mix(word), _mix(form + _B)], [text, text]
        for x, length, salt in ((word, 2, 3), (form, 3, 5)):
            g = x[:max(n - length + 1, 0)].copy()
            for j in range(1, length):
                g = _mix(g * _A + x[j:j + len(g)])
            inside = text[:len(g)] == text[length - 1:length - 1 + len(g)]
            parts.append(_mix(g + np.uint64(salt))[inside])
            owners.append(text[:len(g)][inside])
        # how long the text is, as a power of two
        parts.append(_mix(np.log2(counts + 1).astype(np.uint64) + np.uint64(99)))
        owners.append(np.arange(len(split), dtype=np.int64))
        place = (np.concatenate(parts) >> np.uint64(64 - self.bits)).astype(np.int64)
        keys = np.unique((np.concatenate(owners) << self.bits) | place)
        return (keys & ((1 << self.bits) - 1)).astype(np.int32), np.bincount(keys >> self.bits, minlength=len(split))


class Model:
    """weight[f]: what feature f adds to the margin; square[f]: to the squared length of the text."""

    def __init__(self, ratio, weight, bias, slope, shift, constant=None):
        self.square, self.weight = (ratio ** 2).astype(np.float32), (ratio * weight).astype(np.float32)
        self.bias, self.slope, self.shift, self.constant = bias, slope, shift, constant

    def margins(self, flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        total = lambda table: np.diff(np.append(0, np.cumsum(table[flat].astype(np.float64)))[np.append(0, np.cumsum(sizes))])
        return total(self.weight) / np.sqrt(np.maximum(total(self.square), 1e-12)) + self.bias

    def scores(self, flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(sizes), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(flat, sizes) + self.shift, -30, 30)))


def log_ratios(rows: list[np.ndarray], labels: np.ndarray, size: int) -> np.ndarray:
    counts = [np.full(size, SMOOTHING), np.full(size, SMOOTHING)]
    for r, y in zip(rows, labels):
        counts[int(y)][r] += 1
    return np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())


def descend(rows: list[np.ndarray], labels: np.ndarray, ratio: np.ndarray) -> tuple[np.ndarray, float]:
    """Hinge loss, L2 penalty: each step sets one row's dual variable to its best value within [0, COST]."""
    values = [ratio[r] for r in rows]
    values = [v / max(np.sqrt(v @ v), 1e-6) for v in values]
    sign = np.where(labels > 0, 1.0, -1.0)
    weight, bias, dual = np.zeros(len(ratio)), 0.0, np.zeros(len(rows))
    rng = np.random.default_rng(SEED)
    for _ in range(EPOCHS):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            r, v, y = rows[i], values[i], sign[i]
            slope = y * (weight[r] @ v + bias) - 1
            new = min(max(dual[i] - slope / (v @ v + 1.0), 0.0), COST)
            step = (new - dual[i]) * y
            if step:
                weight[r] += step * v
                bias += step
                dual[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return weight, bias


def curve(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve, by Newton steps on smoothed targets."""
    ones = labels.sum()
    target = np.where(labels > 0, (ones + 1) / (ones + 2), 1 / (len(labels) - ones + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        g = np.array([((p - target) * margins).sum(), (p - target).sum()]) + 1e-6 * np.array([a, b])
        w = p * (1 - p) + 1e-9
        h = np.array([[(w * margins ** 2).sum() + 1e-6, (w * margins).sum()], [(w * margins).sum(), w.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)


def fit(rows: list[np.ndarray], labels: np.ndarray, bits: int = BITS) -> Model:
    size = 1 << bits
    none = np.zeros(size)
    if len(set(labels.tolist())) < 2:
        return Model(none, none, 0.0, 1.0, 0.0, float(labels.mean()) if len(labels) else 0.5)
    back = np.arange(len(rows)) % KEPT_BACK == 0
    if len(set(labels[~back].tolist())) < 2 or len(set(labels[back].tolist())) < 2:
        back[:] = False
    learn = np.flatnonzero(~back)
    part = [rows[i] for i in learn]
    ratio = log_ratios(part, labels[learn], size)
    weight, bias = descend(part, labels[learn], ratio)
    model = Model(ratio, weight, bias, 1.0, 0.0)
    tell = np.flatnonzero(back) if back.any() else learn
    sizes = np.array([len(rows[i]) for i in tell])
    model.slope, model.shift = curve(model.margins(np.concatenate([rows[i] for i in tell]), sizes), labels[tell])
    return model


def _featurise(bits: int):
    def run(batches):
        make = Features(bits)
        for batch in sliced(batches):
            flat, sizes = make.of(batch.column("text").to_pylist())
            edges = np.append(0, np.cumsum(sizes))
            raw = [flat[a:b].tobytes() for a, b in zip(edges, edges[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("order"), batch.column("label"), pa.array(raw, pa.binary())], ["order", "label", "features"])
    return run


def train(df: DataFrame, labels: DataFrame, text: str = "text", id_col: str = "doc_id", label: str = "quality",
          sample: int = SAMPLE, bits: int = BITS) -> Model:
    """Fit on at most sample labelled ids (the bound on what reaches the driver and is broadcast)."""
    chosen = (
        labels.filter(F.col(label).isNotNull() & F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).alias("_id")).agg(F.min(F.col(label)).cast("int").alias("label"))
        .withColumn("order", F.xxhash64("_id")).orderBy("order", "_id").limit(sample)
    )
    rows = df.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("text"))
    # one text an id, summed before the shuffle: no more than sample rows leave the executors
    texts = rows.join(F.broadcast(chosen), "_id").groupBy("order", "label").agg(F.min("text").alias("text"))
    got = texts.mapInArrow(_featurise(bits), "order long, label int, features binary").toArrow().sort_by("order")
    features = [np.frombuffer(x, np.int32) for x in got.column("features").to_pylist()]
    return fit(features, np.array([min(max(y, 0), 1) for y in got.column("label").to_pylist()]), bits)


def score(df: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",), bits: int = BITS) -> DataFrame:
    """keep's columns and score."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        make = Features(bits)
        for batch in sliced(batches, 2048):
            texts, out = batch.column("_text").to_pylist(), []
            at = 0
            while at < len(texts):  # about 4 MB at once
                n, size = at, 0
                while n < len(texts) and (n == at or size < 1 << 22):
                    size += len(texts[n] or b"")
                    n += 1
                out.append(shared.value.scores(*make.of(texts[at:n])))
                at = n
            yield pa.RecordBatch.from_pydict({
                "_keep": batch.column("_keep"), "score": pa.array(np.concatenate(out) if out else [], pa.float64())})

    rows = df.select(carried(keep), F.col(text).cast("binary").alias("_text"))
    return rows.mapInArrow(run, with_carried(rows, "score double")).select("_keep.*", "score")
