"""A quality classifier by naive Bayes support vectors.

The features are indicators of word n-grams, n from 1 to 3, of words in lower
case and of their forms (letter case, length, punctuation). Each is scaled by
its log-count ratio between the classes, then dual coordinate descent fits a
linear hinge-loss model, whose margins are calibrated on rows kept out of the
fit. The number of labelled rows used and the number of hashed features are
parameters, so that the model has a fixed bound and can be broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thermalake.llm.common import cut

BITS = 20
_MEMO, _MEMO_CHARS = 400_000, 48
_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def word_form(word: str) -> str:
    """The case of a word's letters, its length in steps of three, and up to three of the characters that follow them."""
    core = word.rstrip(_PUNCTUATION)
    tail = word[len(core) :][:3]
    if not core:
        case = "-"
    elif core.isupper():
        case = "A"
    elif core[0].isupper():
        case = "Aa"
    elif core.islower():
        case = "a"
    else:
        case = "?"
    return f"{case}{min(len(core), 9) // 3}{tail}"


class _Hashes(dict):
    """Words to the places of their two hashes, of the word and of its form, in `table`; long words are not held."""

    def __init__(self):
        import xxhash

        super().__init__()
        self.digest = xxhash.xxh64_intdigest
        self.used, self.table = 0, np.empty((2 * _MEMO, 2), np.uint64)

    def __missing__(self, word: str) -> int:
        at = self.used
        self.used += 1
        core = word.rstrip(_PUNCTUATION).lower()
        self.table[at] = self.digest(core.encode(), 1), self.digest(word_form(word).encode(), 2)
        if len(word) <= _MEMO_CHARS:
            self[word] = at
        return at


def mixed(value: np.ndarray) -> np.ndarray:
    """The 64-bit finalizer of the murmur hash, by which all bits depend on all."""
    value = (value ^ (value >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    value = (value ^ (value >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return value ^ (value >> np.uint64(33))


class Features:
    """Hashed n-gram indicators of whole texts."""

    def __init__(self, bits: int = BITS):
        self.size = 1 << bits
        self.memo = _Hashes()

    def text(self, text: str | None) -> np.ndarray:
        """Sorted features of a text; every text has one for its length."""
        words = (text or "").split()
        seen = np.zeros(self.size, bool) if len(words) > self.size // 8 else None
        found = [mixed(np.array([len(words).bit_length()], np.uint64))]
        before = np.empty((0, 2), np.uint64)
        for at in range(0, len(words), _MEMO):
            part = words[at : at + _MEMO]
            if self.memo.used + len(part) > len(self.memo.table):
                self.memo.clear()
                self.memo.used = 0
            own = self.memo.table[np.fromiter(map(self.memo.__getitem__, part), np.int64, len(part))]
            own = np.concatenate([before, own])
            one = mixed(own)
            two = mixed(one[:-1] * np.uint64(3) + own[1:])
            three = mixed(two[:-1] * np.uint64(5) + own[2:])
            found += [one[len(before) :].ravel(), two[max(0, len(before) - 1) :].ravel(), three.ravel()]
            before = own[-2:]
            if seen is not None:  # a long text's features are marked, not gathered
                for hashes in found:
                    seen[hashes & np.uint64(self.size - 1)] = True
                found = []
        if seen is not None:
            return np.flatnonzero(seen)
        return np.unique((np.concatenate(found) & np.uint64(self.size - 1)).astype(np.int64))


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    slope: float
    offset: float


def log_count_ratio(rows: list[np.ndarray], labels: np.ndarray, size: int, smooth: float = 1.0) -> np.ndarray:
    """log of (smoothed share of each feature among label 1) over (the same among label 0)."""
    ratio = []
    for label in (1, 0):
        own = [r for r, y in zip(rows, labels, strict=True) if y == label]
        count = np.bincount(np.concatenate(own), minlength=size) + smooth
        ratio.append(np.log(count / count.sum()))
    return ratio[0] - ratio[1]


def dual_descent(
    rows: list[np.ndarray], scale: np.ndarray, labels: np.ndarray, cost: np.ndarray, epochs: int = 12
) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise |w|^2 / 2 + sum of cost times hinge loss, over indicators times `scale`."""
    weights, bias = np.zeros(len(scale)), 0.0
    sign = np.where(labels == 1, 1.0, -1.0)
    norm = np.array([scale[r] @ scale[r] + 1.0 for r in rows])
    alpha = np.zeros(len(rows))
    draws = np.random.default_rng(10)
    for _ in range(epochs):
        for i in draws.permutation(len(rows)):
            row = rows[i]
            x = scale[row]
            slope = sign[i] * (weights[row] @ x + bias) - 1
            new = min(max(alpha[i] - slope / norm[i], 0.0), cost[i])
            if new != alpha[i]:
                change = (new - alpha[i]) * sign[i]
                weights[row] += change * x
                bias += change
                alpha[i] = new
    return weights * scale, bias


def calibrate(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve over margins, by Newton steps on smoothed labels."""
    high, low = (labels == 1).sum(), (labels == 0).sum()
    target = np.where(labels == 1, (high + 1) / (high + 2), 1 / (low + 2))
    x = np.stack([margins, np.ones(len(margins))], 1)
    w = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        w -= np.linalg.solve(hessian, x.T @ (p - target) + 1e-3 * (w - [1.0, 0.0]))
    return max(float(w[0]), 1e-3), float(w[1])


def fit(rows: list[np.ndarray], labels: np.ndarray, size: int, cost: float = 1.0) -> Model:
    """A model of labelled feature rows; with one class only, or none, every score is the smoothed share of label 1."""
    labels = np.asarray(labels)
    ones = int((labels == 1).sum())
    prior = (ones + 1) / (len(labels) + 2)
    if min(ones, len(labels) - ones) < 2:
        return Model(np.zeros(size), 0.0, 1.0, float(np.log(prior / (1 - prior))))
    kept = np.arange(len(rows)) % 5 == 0  # for the calibration
    if min(np.bincount(labels[kept], minlength=2).min(), np.bincount(labels[~kept], minlength=2).min()) < 1:
        kept[:] = False
    train = [r for r, k in zip(rows, kept, strict=True) if not k]
    y = labels[~kept]
    scale = log_count_ratio(train, y, size)
    each = cost * np.where(y == 1, len(y) / (2 * (y == 1).sum()), len(y) / (2 * (y == 0).sum()))
    weights, bias = dual_descent(train, scale, y, each)
    test = [r for r, k in zip(rows, kept, strict=True) if k] or train
    margins = np.array([weights[r].sum() + bias for r in test])
    return Model(weights, bias, *calibrate(margins, labels[kept] if kept.any() else labels))


def learn(docs: DataFrame, labels: DataFrame, most_rows: int = 6000, bits: int = BITS, most_features: int = 50_000_000) -> Model:
    """A model from (doc_id, text) and (doc_id, quality).

    Labels other than 0 and 1, labels without a document and documents without
    a label are passed over; of several labels of a document the larger counts,
    of several rows of a document the one with the largest hash of its text.
    Null texts count as empty ones, and of long texts every word is used.
    `most_rows` bounds the labelled documents used, and `most_features` the
    features of all of them together (4 bytes each on their way to the driver),
    both in expectation; hashes of the id choose them. Empty tables give the model in which every score is
    the smoothed share of label 1. Other columns are not read.
    """
    named = labels.filter("doc_id IS NOT NULL AND quality IN (0, 1)").select(F.col("doc_id").cast("long"), "quality")
    named = named.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    share = min(1.0, most_rows / max(1, named.count()))
    draw = F.pmod(F.xxhash64("doc_id", F.lit(10)), F.lit(1 << 40)) / float(1 << 40)
    chosen = named.filter(draw < share).select(F.col("doc_id").alias("_id"), "quality")
    # about most_rows rows of two numbers: a fixed size, small enough to send to every task
    met = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
    fields = "doc_id long, quality int, text_hash long, features binary"
    schema = pa.schema([("doc_id", pa.int64()), ("quality", pa.int32()), ("text_hash", pa.int64()), ("features", pa.binary())])

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Features(bits)
        for batch in batches:
            found = [make.text(t).astype("<i4").tobytes() for t in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found, pa.binary())], schema=schema)

    got = (
        met.select(F.col("doc_id").cast("long"), F.col("quality").cast("int"), F.xxhash64("text").alias("text_hash"), "text")
        .mapInArrow(extract, fields)
        .groupBy("doc_id")
        .agg(F.max(F.struct("text_hash", "features")).alias("best"), F.max("quality").alias("quality"))
    )
    got = cut(got.select("doc_id", "quality", "best.features"))
    features = (got.agg(F.sum(F.octet_length("features"))).first()[0] or 0) / 4
    draw = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 40)) / float(1 << 40)
    held = sorted(got.filter(draw < min(1.0, most_features / max(1.0, features))).collect(), key=lambda r: r.doc_id)
    rows = [np.frombuffer(bytes(r.features), "<i4") for r in held]
    return fit(rows, np.array([r.quality for r in held], np.int64), 1 << bits)


def score(docs: DataFrame, model: Model, bits: int = BITS) -> DataFrame:
    """(doc_id, score, predicted) per input row, from the text alone.

    Null texts score as empty ones, long ones by all their words. Repeated rows
    and null ids are rows like others; extra columns are not read; an empty
    table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, make = shared.value, Features(bits)
        for batch in batches:
            margins = np.array([own.weights[make.text(t)].sum() for t in batch.column(1).to_pylist()]) + own.bias
            chance = 1 / (1 + np.exp(-np.clip(margins * own.slope + own.offset, -500, 500)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(chance, pa.float64())], schema=schema)

    rated = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(rate, "doc_id long, score double")
    return rated.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
