"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Words are lower-cased runs of letters and digits (bytes above 127 count as letters). Features are the presence of
single words, of neighbouring pairs and of pairs one word apart, hashed to 2**BITS buckets. The regression has
a learning rate per coordinate and L1 sparsity, so that what scoring needs is a short list of buckets and weights,
which is broadcast with the scoring function. It is fitted in one task on a bounded sample of labelled rows: the
MAX_TRAINING rows of least hash among those that are not held out. Scoring reads every whole text.

Null texts count as empty; an empty text scores what the bias alone gives. Without training rows the score is 0 (but for
1e-15) and nothing is called toxic; with one label only, every score is that label's share, smoothed by half a row. Very
long texts are read whole. Repeated rows give repeated results, and count as often in the sample. An empty table gives
an empty result. Further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WordHasher, byte_slices, fold, map_batches, texts_as_bytes

BITS = 22
ALPHA, BETA, L1, L2 = 2.0, 1.0, 10.0, 0.5
#: Toxic rows are few; their gradients count so many times.
POSITIVE_WEIGHT = 3.0
#: Bound of the training sample, and how often it is gone through at any size.
MAX_TRAINING = 16_000
EPOCHS = 20
THRESHOLD = 0.5
#: Bias without any training row: nothing is called toxic, the score is 0 but for 1e-15.
NOTHING_KNOWN = -35.0

#: Lower-cased letter or digit of each byte; 32 for what separates words.
_CANON = np.full(256, 32, np.uint8)
_CANON[48:58] = np.arange(48, 58)
_CANON[97:123] = np.arange(97, 123)
_CANON[65:91] = np.arange(97, 123)
_CANON[128:] = np.arange(128, 256)

_hash = WordHasher()
_MIX = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def _features(text: bytes) -> np.ndarray:
    """Buckets of all n-grams and skip-grams, repeats included."""
    data = _CANON[np.frombuffer(text, np.uint8)]
    solid = np.concatenate(([False], data != 32, [False]))
    edges = np.flatnonzero(solid[1:] != solid[:-1])
    if not len(edges):
        return np.zeros(0, np.uint32)
    h = _hash(data, edges[::2], edges[1::2])
    with np.errstate(over="ignore"):
        parts = [h * _MIX[0]]
        for gap in (1, 2):
            if len(h) > gap:
                pair = (h[:-gap] * _MIX[1] + h[gap:] * _MIX[2]) ^ np.uint64(gap)
                parts.append((pair ^ (pair >> np.uint64(31))) * _MIX[0])
    return (np.concatenate(parts) >> np.uint64(64 - BITS)).astype(np.uint32)


def train(examples: list[tuple[np.ndarray, int]], epochs: int | None = None) -> tuple[np.ndarray, np.ndarray, float]:
    """Buckets and weights that are not zero, and the bias."""
    epochs = epochs or EPOCHS
    z = np.zeros((1 << BITS) + 1)
    n = np.zeros((1 << BITS) + 1)
    bias = 1 << BITS

    def weights(at: np.ndarray) -> np.ndarray:
        w = -(z[at] - np.sign(z[at]) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2)
        return np.where(np.abs(z[at]) <= L1, 0.0, w)

    for _ in range(epochs):
        for at, y in examples:
            at = np.append(at, bias)
            w = weights(at)
            g = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35))) - y
            g *= POSITIVE_WEIGHT if y else 1.0
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    at = np.flatnonzero(np.abs(z[:-1]) > L1)
    return at.astype(np.uint32), weights(at), float(weights(np.array([bias]))[0])


def fit(docs: DataFrame, labels: DataFrame, trains: Column, max_training: int = MAX_TRAINING) -> tuple[np.ndarray, np.ndarray, float]:
    """Fit on at most max_training labelled rows that `trains` (an expression on doc_id) admits."""
    chosen = labels.filter("toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic")).filter(trains)
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_training)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_slices(batches):
            packed = [np.unique(_features(t)).astype("<u4").tobytes() for t in texts_as_bytes(batch)]
            order = [hash_order(i) for i in batch.column("doc_id").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(order, pa.int64()), batch.column("doc_id"), batch.column("toxic").cast(pa.int32()), pa.array(packed, pa.binary())], ["order", "doc_id", "toxic", "packed"])

    # an id may have several rows: the bound holds for rows, and what is dealt to one task are features
    rows = map_batches(rows, features, "order long, doc_id long, toxic int, packed binary").orderBy("order", "doc_id", "toxic", "packed").limit(max_training)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("order", "doc_id", "toxic", "packed")]
            found += [(o, i, int(y > 0), p) for o, i, y, p in zip(*columns, strict=True)]
        found.sort()
        examples = [(np.frombuffer(p, "<u4"), y) for _, _, y, p in found]
        ones = sum(y for _, y in examples)
        if 0 < ones < len(examples):
            at, w, bias = train(examples)
        else:  # one label alone teaches its share only
            at, w, bias = np.zeros(0, np.uint32), np.zeros(0), float(np.log((ones + 0.5) / (len(examples) - ones + 0.5)))
        at, w = np.append(at.astype(np.int64), -1), np.append(w, 0.0)
        if examples:
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(w), pa.array(np.full(len(at), bias))], ["bucket", "weight", "bias"])

    got = map_batches(rows.repartition(1), run, "bucket long, weight double, bias double").collect()
    at = np.array([r.bucket for r in got if r.bucket >= 0], np.uint32)
    w = np.array([r.weight for r in got if r.bucket >= 0])
    return at, w, got[0].bias if got else NOTHING_KNOWN


def hash_order(i: int) -> int:
    """A fixed shuffle of the ids, so that the order of training does not follow them."""
    return (i * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> 20


def scores(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float]) -> DataFrame:
    """doc_id, score."""
    at, w, bias = model
    shared = docs.sparkSession.sparkContext.broadcast((at, w, bias))
    made: list[np.ndarray] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, w, bias = shared.value
        if not made:
            table = np.zeros(1 << BITS, np.float32)
            table[at] = w
            made.append(table)
        table = made[0]
        for batch in batches:
            out = np.empty(batch.num_rows)
            for k, text in enumerate(texts_as_bytes(batch)):
                f = _features(text)
                hit = np.unique(f[table[f] != 0])
                out[k] = 1.0 / (1.0 + np.exp(-np.clip(table[hit].astype(float).sum() + bias, -35, 35)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out)], ["doc_id", "score"])

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, held_out: Column | None = None, threshold: float = THRESHOLD, max_training: int = MAX_TRAINING) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    held_out = fold(F.col("doc_id"), 5) == 0 if held_out is None else held_out
    scored = scores(docs, fit(docs, labels, ~held_out, max_training))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
