import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from turfline.llm import quality_knn, toxicity_ftrl
from turfline.llm.common import WordHasher

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, score string, held_out string, quality int, toxic int"


def frames(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def edge(spark):
    return spark.createDataFrame([(1, None, "en", "x", "y", 9, 9), (2, "", "en", "x", "y", 9, 9), (2, "", None, None, None, 0, 0), (None, "some words here", "en", "x", "y", 1, 1), (3, "word " * 100_000, "en", "x", "y", 1, 1)], DOCS)


@pytest.mark.parametrize(("module", "label", "modulus", "rest", "least"), [(quality_knn, "quality", 4, 2, 0.97), (toxicity_ftrl, "toxic", 5, 0, 0.9)])
def test_held_out(spark, module, label, modulus, rest, least):
    docs, labels = frames(spark)
    found = module.classify(docs, labels).join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % modulus == rest) for r in found)
    assert all(0 <= r.score <= 1 for r in found)
    out = [r for r in found if r.held_out]
    assert len(out) > 30
    assert np.mean([r.predicted == r[label] for r in out]) >= least


@pytest.mark.parametrize(("module", "label"), [(quality_knn, "quality"), (toxicity_ftrl, "toxic")])
def test_edges(spark, module, label):
    docs, labels = frames(spark)
    found = module.classify(edge(spark), labels.limit(0)).collect()
    assert len(found) == 5 and all(0 <= r.score <= 1 for r in found)
    assert {r.predicted for r in found} == {1 if module is quality_knn else 0}
    one = module.classify(edge(spark), spark.createDataFrame([(1, 0), (3, 0)], f"doc_id long, {label} int")).collect()
    assert {r.predicted for r in one} == {0}
    assert module.classify(docs.limit(0), labels).count() == 0
    mixed = module.classify(docs.select("doc_id", "text").unionByName(edge(spark).select("doc_id", "text")), labels.withColumn(label, F.when(F.col("doc_id") % 9 > 0, F.col(label))))
    rows = mixed.collect()
    assert len(rows) == docs.count() + 5 and all(r.score is not None for r in rows)


@pytest.mark.parametrize("module", [quality_knn, toxicity_ftrl])
def test_held_out_labels_do_not_count(spark, module):
    """Turning all held-out labels round changes no score."""
    docs, labels = frames(spark)
    turned = labels.withColumns({"quality": F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, 1 - F.col("quality")).otherwise(F.col("quality")), "toxic": F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic"))})
    a = {r.doc_id: r.score for r in module.classify(docs, labels).collect()}
    b = {r.doc_id: r.score for r in module.classify(docs.repartition(3), turned).collect()}
    assert a == pytest.approx(b, abs=1e-6)


def test_vote_equals_brute_force():
    rng = np.random.default_rng(0)
    unit = lambda x: (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    model = quality_knn.Model(None, None, unit(rng.normal(size=(300, 8))), (rng.random(300) < 0.6).astype(np.float32), 0.6)
    x = unit(rng.normal(size=(2500, 8)))
    found = quality_knn.vote(x, model)
    for i in range(0, 2500, 50):
        cosine = model.vectors @ x[i]
        top = np.argsort(-cosine)[: quality_knn.NEIGHBOURS]
        w = np.maximum(cosine[top], 0)
        assert found[i] == pytest.approx((w * model.labels[top]).sum() / w.sum(), abs=1e-5)
    assert quality_knn.vote(np.zeros((1, 8), np.float32), model)[0] == pytest.approx(0.6)


def test_ties_go_to_the_earlier_row():
    rng = np.random.default_rng(2)
    vectors = np.repeat(rng.normal(size=(20, 4)), 8, axis=0)[rng.permutation(160)]
    vectors = (vectors / np.linalg.norm(vectors, axis=1, keepdims=True)).astype(np.float32)
    model = quality_knn.Model(None, None, vectors, (rng.random(160) < 0.5).astype(np.float32), 0.5)
    x = vectors[rng.permutation(160)]
    for row, found in zip(x, quality_knn.vote(x, model), strict=True):
        cosine = vectors @ row
        top = sorted(range(160), key=lambda j: (-round(float(cosine[j]) * 1e6), j))[: quality_knn.NEIGHBOURS]
        w = np.maximum(cosine[top], 0)
        assert found == pytest.approx((w * model.labels[top]).sum() / w.sum(), abs=1e-5)


def test_words_count():
    a, b = (quality_knn.term_counts(t) for t in (b"The dog runs fast today.", b"Our sun sets late again."))
    assert (a[: quality_knn.SHAPES] == b[: quality_knn.SHAPES]).all() and (a != b).any()
    assert (quality_knn.term_counts(b"A dog") [quality_knn.SHAPES :] == quality_knn.term_counts(b"a DOG")[quality_knn.SHAPES :]).all()


def test_latent_axes_span_the_leading_directions():
    rng = np.random.default_rng(3)
    x = np.zeros((300, quality_knn.TERMS), np.float32)
    x[:, :60] = rng.normal(size=(300, 60)) * np.geomspace(30, 0.1, 60)
    axes = quality_knn.latent_axes(lambda: (x[k : k + 100] for k in range(0, 300, 100)), 5)
    want = np.linalg.svd(x, full_matrices=False)[2][:5].T
    assert np.linalg.svd(axes.T @ want)[1].min() > 0.99


def test_ftrl_equals_a_plain_loop():
    """The same regression in dictionaries, one coordinate at a time."""
    rng = np.random.default_rng(4)
    rows = [(np.unique(rng.integers(0, 30, 6)).astype(np.uint32), int(rng.random() < 0.4)) for _ in range(80)]
    t = toxicity_ftrl
    z, n = {}, {}
    weight = lambda i: 0.0 if abs(z.get(i, 0.0)) <= t.L1 else -(z[i] - math.copysign(t.L1, z[i])) / ((t.BETA + math.sqrt(n[i])) / t.ALPHA + t.L2)
    for _ in range(t.EPOCHS):
        for features, y in rows:
            at = [*features.tolist(), "bias"]
            w = {i: weight(i) for i in at}
            g = (1 / (1 + math.exp(-sum(w.values()))) - y) * (t.POSITIVE_WEIGHT if y else 1.0)
            for i in at:
                was = n.get(i, 0.0)
                z[i] = z.get(i, 0.0) + g - (math.sqrt(was + g * g) - math.sqrt(was)) / t.ALPHA * w[i]
                n[i] = was + g * g
    at, w, bias = t.train(rows)
    assert dict(zip(at.tolist(), w.tolist(), strict=True)) == pytest.approx({i: weight(i) for i in z if i != "bias" and weight(i)})
    assert bias == pytest.approx(weight("bias")) and len(at)


def test_word_hashes_depend_on_words_alone():
    hasher = WordHasher()
    data = np.frombuffer(b"abc x abc yabc a", np.uint8)
    h = hasher(data, np.array([0, 4, 6, 10, 15]), np.array([3, 5, 9, 14, 16]))
    assert h[0] == h[2] and len(set(h.tolist())) == 4


def test_features_are_ngrams_and_skipgrams():
    f = lambda t: set(toxicity_ftrl._features(t.encode()).tolist())
    assert f("") == f("!?") == set()
    assert len(f("a b c")) == 6  # three words, two pairs, one pair over a word
    assert f("A, b. c") == f("a b c") and f("a b") < f("a b c")


def test_ftrl_learns_and_is_sparse():
    rng = np.random.default_rng(1)
    rows = [(np.unique(np.append(rng.integers(0, 1000, 20), [5000] * y)).astype(np.uint32), int(y)) for y in (rng.random(600) < 0.2).astype(int)]
    at, w, bias = toxicity_ftrl.train(rows)
    weight = dict(zip(at.tolist(), w.tolist(), strict=True))
    assert weight[5000] + bias > 0 > bias and len(at) < 900
