import random

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F
from turfline.llm import shingle_sets, simhash_bk

SF = "/root/testdata/sf0.01"


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def slow_set(text, k=5):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def brute(rows):
    """doc_id of each row's group by comparing all pairs."""
    sets = [slow_set(t) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            a, b = len(sets[i]), len(sets[j])
            if (not a and not b) or (a and b and 5 * min(a, b) >= 4 * max(a, b) and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])):
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    out = []
    for k, (i, _) in enumerate(rows):
        ids = [r[0] for r, x in zip(rows, label, strict=True) if x == label[k] and r[0] is not None]
        out.append((i, min(ids) if ids else None))
    return out


def test_groups_match_all_pairs(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    passage = " ".join(word() for _ in range(40))
    rows = [(1000, None), (1001, ""), (1002, " \n"), (None, "one two"), (1003, "One  TWO"), (1004, "two one"), (None, None), (None, "alone")]
    for base in range(12):
        words = [word() for _ in range(rng.randint(20, 300))]
        for copy in range(rng.randint(1, 9)):
            changed = [word() if rng.random() < 0.02 else w for w in words]
            rows.append((base * 50 + copy, " ".join(changed) + (" " + passage if base % 2 else "")))
    rows.append(rows[-1])
    rng.shuffle(rows)
    want = sorted(brute(rows), key=str)
    assert len({c for _, c in want}) < len({i for i, _ in want})
    for options in ({"run_rows": 3, "short_rows": 1, "tree_nodes": 4, "elements": 400}, {"short_rows": 4}):
        found = simhash_bk.similar_groups(table(spark, rows), **options)
        assert sorted(((r.doc_id, r.component_id) for r in found.collect()), key=str) == want
    assert simhash_bk.similar_groups(table(spark, [])).count() == 0


def test_links_that_fingerprints_miss(spark):
    """Sets of similarity just above and below 4/5, and a chain of them through texts that are not alike."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefgh", k=7))
    rows = []
    for k in range(30):
        base = [word() for _ in range(200)]
        cut = 18 + k // 3  # five-word shingles: 196 in common but for the words at the end
        rows += [(4 * k, " ".join(base)), (4 * k + 1, " ".join(base[:-cut] + [word() for _ in range(cut)])), (4 * k + 2, " ".join([word() for _ in range(cut)] + base[cut:]))]
    want = sorted(brute(rows))
    assert 1 < len({c for _, c in want}) < len(rows)
    assert sorted((r.doc_id, r.component_id) for r in simhash_bk.similar_groups(table(spark, rows)).collect()) == want


def test_boundary(spark):
    sets = spark.createDataFrame([(1, list(range(9))), (2, list(range(8))), (3, list(range(7)))], "node long, shingles array<long>")
    pairs = spark.createDataFrame([(1, 2), (2, 3), (1, 3)], "a long, b long")
    assert {(r.a, r.b): r.alike for r in shingle_sets.verified(pairs, sets).collect()} == {(1, 2): True, (2, 3): True, (1, 3): False}


def top_of(label, x):
    while label[x] != x:
        x = label[x]
    return x


def spans(k, pairs, same=()):
    label = list(range(k))
    for i, j in [*same, *pairs]:
        label[top_of(label, i)] = top_of(label, j)
    return [frozenset(y for y in range(k) if top_of(label, y) == top_of(label, x)) for x in range(k)]


def test_clusters_are_complete():
    rng = np.random.default_rng(0)
    for _ in range(20):
        k = 40
        size, place, group = np.sort(rng.integers(5, 40, k)), rng.integers(0, 3, k), rng.integers(0, 8, k)
        found = [(i, j) for a, b in shingle_sets.spanned(size, place, group) for i, j in zip(a.tolist(), b.tolist(), strict=True)]
        want = [(i, j) for i in range(k) for j in range(i) if group[i] != group[j] and shingle_sets.may_be_alike(size[i], place[i], size[j], place[j])]
        assert spans(k, found) == spans(k, want) and len(found) < k


def test_alike_equals_all_pairs():
    rng = np.random.default_rng(1)
    for _ in range(20):
        base = rng.integers(0, 1 << 60, 60).astype(np.uint64)
        sets = [np.unique(np.where(rng.random(60) < rng.random() * 0.25, rng.integers(0, 1 << 60, 60).astype(np.uint64), base)) for _ in range(30)] + [np.zeros(0, np.uint64)]
        group = rng.integers(0, 12, 31).tolist()
        asks = [g != 3 for g in group]
        same = [(i, j) for i in range(31) for j in range(i) if group[i] == group[j]]
        want = [(i, j) for i in range(30) for j in range(i) if 5 * len(np.intersect1d(sets[i], sets[j])) >= 4 * len(np.union1d(sets[i], sets[j]))]
        assert spans(31, shingle_sets.alike(sets, group, asks), same) == spans(31, [x for x in want if asks[x[0]] or asks[x[1]]], same)


def test_stage_removes_all_near_copies(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").groupBy("text").agg(F.min("doc_id").alias("doc_id"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = {c for _, c in brute(rows)}
    assert len(want) == len(rows) - 5
    assert {r.doc_id for r in corpus_pipeline.near(spark, docs, SF).collect()} == want


def test_sets_are_dealt_out_in_portions(spark, monkeypatch):
    """However many pairs ask for a set, the sets that are sent at once are a share of all; the links stay the same."""
    rng = random.Random(5)
    sets = [(i, 20, sorted(rng.sample(range(22 if i < 6 else 60), 20))) for i in range(12)]
    pairs = [(i, j) for i in range(12) for j in range(i + 1, 12)]
    want = {(i, j) for i, j in pairs if 5 * len({*sets[i][2]} & {*sets[j][2]}) >= 4 * len({*sets[i][2]} | {*sets[j][2]})}
    table_ = spark.createDataFrame(sets, "node long, n long, shingles array<long>")
    asked, verified = [], shingle_sets.verified
    monkeypatch.setattr(shingle_sets, "verified", lambda some, all_: asked.append(some.count()) or verified(some, all_))
    found = shingle_sets.verified_links(spark.createDataFrame(pairs, "a long, b long"), table_, table_, least=300)
    assert 0 < len(want) < len(pairs) and {(r.a, r.b) for r in found.collect()} == want
    assert len(asked) == 9 and sum(asked) == len(pairs) and max(asked) < 20
    rows = []
    for base in range(6):
        words = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(rng.randint(40, 120))]
        rows += [(base * 10 + k, " ".join("x" if rng.random() < 0.02 else w for w in words)) for k in range(4)]
    found = simhash_bk.similar_groups(table(spark, rows), portion=400)
    assert len(asked) > 11 and sorted((r.doc_id, r.component_id) for r in found.collect()) == sorted(brute(rows))
