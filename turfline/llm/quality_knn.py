"""Quality by nearest-neighbour voting in a latent-semantic space.

A text becomes counts of hashed terms in two blocks: its words (A-Z folded, WORDS buckets), and how they are written:
shapes of words (case, digits, closing punctuation, whether the word repeats the one before or one shortly before),
pairs of shapes, and trigrams of byte classes. Terms are weighted by tf-idf and projected to DIMS latent dimensions by
a truncated singular value decomposition, which is fitted here (randomized, with power iterations) on the labelled
sample. The labelled vectors (at most MAX_LABELLED) are broadcast; every document is compared with all of them by exact
cosine products, in blocks, and the NEIGHBOURS most similar vote with their similarity as weight.

Null texts count as empty; a text without terms has no direction and scores the share of label 1 in the sample.
Without labelled rows every score is 1.0 and nothing is rejected. Similarities are compared to six decimals; ties go to
the earlier labelled row, in the order of doc_id, label and terms. Very long texts are read whole. Repeated rows give
repeated results, and count as often in the sample. An empty table gives an empty result. Further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WordHasher, byte_slices, fold, map_batches, staged, texts_as_bytes, without_ids, word_bounds

#: Buckets of the shapes and of the words, and the weight of the words against the shapes.
SHAPES, WORDS = 2048, 8192
TERMS = SHAPES + WORDS
WORD_WEIGHT = 0.3
DIMS = 48
MAX_LABELLED = 4096
NEIGHBOURS = 15
BLOCK, FIT_BLOCK = 128, 256
THRESHOLD = 0.7

#: Classes of bytes: 0 other, 1 lower case or above 127, 2 upper case, 3 digit, 4 blank, 5 line end, 6 , . ; : ' - 7 ! ? 8 symbols
_CLASS = np.zeros(256, np.uint8)
_CLASS[97:123] = 1
_CLASS[128:] = 1
_CLASS[65:91] = 2
_CLASS[48:58] = 3
_CLASS[[32, 9]] = 4
_CLASS[[10, 11, 12, 13]] = 5
_CLASS[list(b",.;:'-\"()")] = 6
_CLASS[list(b"!?")] = 7
_CLASS[list(b"#$%&*|@^~_=+<>/\\[]{}`")] = 8

_hash = WordHasher()


def term_counts(text: bytes) -> np.ndarray:
    data = np.frombuffer(text, np.uint8)
    starts, ends = word_bounds(data)
    counts = np.zeros(TERMS, np.float32)
    if not len(starts):
        return counts
    kind = _CLASS[data]
    upper = np.concatenate(([0], np.cumsum(kind == 2)))
    lower = np.concatenate(([0], np.cumsum(kind == 1)))
    n_upper, n_lower = upper[ends] - upper[starts], lower[ends] - lower[starts]
    case = np.where(n_lower + n_upper == 0, 0, np.where(n_upper == 0, 1, np.where(n_lower > 0, 2, np.where(n_upper > 1, 3, 4))))
    last = kind[ends - 1].astype(np.int64)
    h = _hash(np.where((data >= 65) & (data <= 90), data + np.uint8(32), data), starts, ends)
    again = np.zeros(len(h), np.int64)
    for back in (4, 3, 2, 1):
        if len(h) > back:
            again[back:] = np.where(h[back:] == h[:-back], 1 if back > 1 else 2, again[back:])
    shape = (case * 9 + last) * 3 + again  # below 135
    counts[:135] = np.bincount(shape, minlength=135)
    counts[135:143] = np.bincount(np.minimum((ends - starts) // 4, 7), minlength=8)
    pairs = shape[:-1] * 135 + shape[1:]
    counts[256:1024] = np.bincount((pairs * 2654435761 >> 7) % 768, minlength=768)
    tri = kind[:-2].astype(np.int64) * 81 + kind[1:-1] * 9 + kind[2:] if len(kind) > 2 else np.zeros(0, np.int64)
    counts[1024 : 1024 + 729] = np.bincount(tri, minlength=729)
    # words that came before anywhere in the text, by twentieths of the share
    counts[2000 + int(20 * (1 - len(np.unique(h)) / len(h)))] = len(h)
    counts[SHAPES:] = np.bincount((h % np.uint64(WORDS)).astype(np.int64), minlength=WORDS)
    return counts


class Model(NamedTuple):
    idf: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float


def _weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Term weights of rows of counts: a term's share of the text, dampened, times idf; each block has a length of its own."""
    total = np.maximum(counts[:, SHAPES:].sum(axis=1, keepdims=True), 1)
    x = np.sqrt(counts / total) * idf
    for block, weight in ((x[:, :SHAPES], 1.0), (x[:, SHAPES:], WORD_WEIGHT)):
        block *= weight / np.maximum(np.linalg.norm(block, axis=1, keepdims=True), 1e-12)
    return x


def _project(counts: np.ndarray, idf: np.ndarray, axes: np.ndarray) -> np.ndarray:
    y = _weighted(counts, idf) @ axes
    return (y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-12)).astype(np.float32)


def latent_axes(blocks, dims: int, more: int = 16, rounds: int = 3) -> np.ndarray:
    """The leading right singular vectors of a matrix by randomized range finding; `blocks()` yields its rows in blocks."""
    times = lambda m: np.concatenate([x @ m for x in blocks()])

    def transposed(m: np.ndarray) -> np.ndarray:
        out, at = np.zeros((TERMS, m.shape[1]), np.float32), 0
        for x in blocks():
            out += x.T @ m[at : at + len(x)]
            at += len(x)
        return out

    q = np.linalg.qr(np.random.default_rng(0).normal(size=(TERMS, dims + more)).astype(np.float32))[0]
    for _ in range(rounds):
        q = np.linalg.qr(transposed(np.linalg.qr(times(q))[0]))[0]
    _, _, rotation = np.linalg.svd(times(q), full_matrices=False)
    return np.ascontiguousarray((q @ rotation.T)[:, :dims])


def fit(docs: DataFrame, labels: DataFrame, trains: Column, max_labelled: int = MAX_LABELLED, dims: int = DIMS) -> Model | None:
    """Latent axes and labelled vectors from at most max_labelled rows that `trains` (an expression on doc_id) admits."""
    chosen = labels.filter("quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("quality")).filter(trains)
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_slices(batches):
            packed = []
            for text in texts_as_bytes(batch):
                c = term_counts(text)
                at = np.flatnonzero(c)
                packed.append(at.astype("<u2").tobytes() + c[at].astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality").cast(pa.int32()), pa.array(packed, pa.binary())], ["doc_id", "quality", "terms"])

    found = map_batches(rows, run, "doc_id long, quality int, terms binary")
    # an id may have several rows: the bound holds for rows
    got = found.orderBy(F.xxhash64("doc_id"), "doc_id", "quality", "terms").limit(max_labelled).collect()
    if not got:
        return None
    got.sort(key=lambda r: (r.doc_id, r.quality, bytes(r.terms)))

    def counted(at: int) -> np.ndarray:
        counts = np.zeros((min(FIT_BLOCK, len(got) - at), TERMS), np.float32)
        for k, r in enumerate(got[at : at + FIT_BLOCK]):
            raw = bytes(r.terms)
            n = len(raw) // 6
            counts[k, np.frombuffer(raw, "<u2", n)] = np.frombuffer(raw, "<f4", n, 2 * n)
        return counts

    starts = range(0, len(got), FIT_BLOCK)
    seen = sum((counted(at) > 0).sum(axis=0) for at in starts)
    idf = np.log1p(len(got) / (1 + seen)).astype(np.float32)
    axes = latent_axes(lambda: (_weighted(counted(at), idf) for at in starts), min(dims, len(got)))
    y = np.array([r.quality > 0 for r in got], np.float32)
    return Model(idf, axes, np.concatenate([_project(counted(at), idf, axes) for at in starts]), y, float(y.mean()))


def nearest(cosine: np.ndarray, k: int) -> np.ndarray:
    """The k columns of greatest value of each row, by six decimals; of equal ones the first."""
    if k >= cosine.shape[1]:
        return np.broadcast_to(np.arange(cosine.shape[1]), cosine.shape)
    rounded = np.rint(cosine * 1e6).astype(np.int64)
    ranked = rounded * cosine.shape[1] - np.arange(cosine.shape[1])  # distinct: value first, then the earlier column
    return np.argpartition(-ranked, k - 1, axis=1)[:, :k]


def vote(latent: np.ndarray, model: Model, neighbours: int = NEIGHBOURS) -> np.ndarray:
    """Similarity-weighted share of label 1 among the nearest labelled vectors of each row."""
    k = min(neighbours, len(model.labels))
    out = np.empty(len(latent))
    for at in range(0, len(latent), BLOCK):
        block = latent[at : at + BLOCK]
        cosine = block @ model.vectors.T
        near = nearest(cosine, k)
        w = np.maximum(np.take_along_axis(cosine, near, axis=1), 0).astype(float)
        total = w.sum(axis=1)
        out[at : at + BLOCK] = np.where(total > 0, (w * model.labels[near]).sum(axis=1) / np.maximum(total, 1e-12), model.prior)
    return np.clip(out, 0, 1)


def scores(docs: DataFrame, model: Model | None, neighbours: int = NEIGHBOURS) -> DataFrame:
    """The columns of docs with score added."""
    if model is None:
        return docs.select("doc_id", F.lit(1.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(tuple(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*shared.value)
        for batch in byte_slices(batches):
            texts = texts_as_bytes(batch)
            out = np.empty(len(texts))
            for at in range(0, len(texts), BLOCK):
                counts = np.stack([term_counts(t) for t in texts[at : at + BLOCK]])
                out[at : at + BLOCK] = vote(_project(counts, m.idf, m.axes), m, neighbours)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out)], ["doc_id", "score"])

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, held_out: Column | None = None, threshold: float = THRESHOLD, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    held_out = fold(F.col("doc_id"), 4) == 2 if held_out is None else held_out
    scored = scores(docs, fit(docs, labels, ~held_out, max_labelled))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """docs without the documents that are rejected; the columns of docs. An id is rejected if any of its texts is."""
    gone = classify(docs, labels, **options).filter("predicted = 0").select("doc_id").distinct()
    return without_ids(docs, staged(gone, "quality-gone"))
