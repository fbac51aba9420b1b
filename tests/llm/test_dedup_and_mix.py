import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from turfline.llm import exact_dedup, quality_knn, simhash_bk, source_mix

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, locator int, fp string, size string"
SF = "/root/testdata/sf0.001"


def table(spark, rows):
    """Rows (doc_id, text, source) with further columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "en", s, 0, "x", 1, "y", "z") for i, t, s in rows], SCHEMA)


EDGE = [(1, "same", "a"), (2, "same", "a"), (2, "same", "a"), (3, None, "a"), (4, "", None), (5, "Same", "b"), (None, "same", "b"), (None, None, None), (6, "é" * 9, "b"), (7, "w " * 60_000, "b"), (8, "w " * 60_000, None)]


def brute_groups(rows):
    by = defaultdict(list)
    for i, t, _ in rows:
        by[t or ""].append(i)
    out = []
    for i, t, _ in rows:
        ids = [x for x in by[t or ""] if x is not None]
        out.append((i, max(ids) if ids else None, len(by[t or ""])))
    return sorted(out, key=str)


@pytest.mark.parametrize("digest", [exact_dedup.sha256_of, lambda x: F.lpad(F.hex(F.crc32(x.cast("binary")) % 2), 8, "0")])
def test_exact_groups(spark, digest):
    docs = table(spark, EDGE)
    found = exact_dedup.decisions(docs, digest, max_files_per_trigger=1).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size) for r in found), key=str) == brute_groups(EDGE)
    assert sum(r.kept for r in found) == len({t or "" for _, t, _ in EDGE})
    assert all(r.doc_id == r.keep_id for r in found if r.kept)


def test_exact_drop(spark):
    kept = exact_dedup.drop_copies(table(spark, EDGE))
    assert kept.columns == SCHEMA.replace(" long", "").replace(" string", "").replace(" int", "").split(", ")
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(2, "same"), (4, ""), (5, "Same"), (6, "é" * 9), (8, "w " * 60_000)], key=str)


def test_exact_empty(spark):
    assert exact_dedup.decisions(table(spark, []).limit(0)).count() == 0
    assert exact_dedup.drop_copies(table(spark, []).limit(0)).count() == 0


def test_exact_state_goes_on(spark, tmp_path):
    """A second run over new files continues the first one's state."""
    at = [str(tmp_path / x) for x in ("in", "state", "out")]
    schema = "doc_id long, digest string, n_bytes int, locator long"
    for rows in ([(1, "a", 1, 0), (2, "b", 1, 1)], [(9, "a", 1, 2), (5, "c", 1, 3)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(at[0])
        state = exact_dedup.keyed_state(spark.readStream.schema(schema).parquet(at[0]), at[1], at[2])
    assert {(r.digest, r.keep_id, r.group_size) for r in state.collect()} == {("a", 9, 2), ("b", 2, 1), ("c", 5, 1)}


def slow_fingerprint(text, k=3):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split(" ")
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", " ".join(words))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprint_equals_brute_force():
    rng = random.Random(1)
    texts = ["", " \t\n\x0b\x0c\r", "One", "ONE two", "A b C d e É è", "x y z w", "a  b\x1cc\x85d"]
    texts += ["".join(rng.choice("ab CÉ\n\t中.") for _ in range(rng.randrange(80))) for _ in range(200)]
    for t in texts:
        assert simhash_bk.fingerprint(t.encode()) == slow_fingerprint(t)


def brute_components(values, radius=3):
    label = list(range(len(values)))

    def top(x):
        while label[x] != x:
            x = label[x]
        return x

    v = np.array(values, np.uint64)
    for i in range(len(v)):
        for j in np.flatnonzero(np.bitwise_count(v[i] ^ v[:i]) <= radius):
            label[top(i)] = top(int(j))
    return [top(i) for i in range(len(v))]


@pytest.mark.parametrize("tree_nodes", [4096, 8])
def test_links_equal_all_pairs(spark, tree_nodes):
    rng = random.Random(2)
    values = [rng.getrandbits(64) for _ in range(150)]
    centre = rng.getrandbits(64)
    for _ in range(120):  # a dense group, and chains
        values.append(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(5))))
    for v in values[:40]:
        values.append(v ^ sum(1 << b for b in rng.sample(range(64), 3)))
    values = sorted(set(values))
    fps = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long")
    label = {r.node: r.label for r in simhash_bk.components(simhash_bk.links(fps, 3, tree_nodes)).collect()}
    signed = [r.fp for r in fps.collect()]
    want = brute_components(values)
    found = [label.get(s, s) for s in signed]
    groups = lambda x: {frozenset(i for i, y in enumerate(x) if y == k) for k in set(x)}
    assert groups(found) == groups(want)


def test_bk_tree_finds_all():
    rng = random.Random(3)
    values = list({rng.getrandbits(12) for _ in range(500)})
    tree = simhash_bk.BKTree()
    for v in values:
        tree.add(v)
    for q in values[:60]:
        assert sorted(tree.within(q, 3)) == sorted(v for v in values if (v ^ q).bit_count() <= 3)


def test_groups_and_keep(spark):
    rows = [(5, "a b c d", "s"), (3, "A  b c\td", "s"), (9, "quite another text here", "s"), (7, None, "s"), (8, " ", "s"), (None, "a b c d", "s"), (10, "one", "s")]
    found = {(r.doc_id, r.component_id) for r in simhash_bk.groups(table(spark, rows)).collect()}
    assert found == {(5, 3), (3, 3), (None, 3), (9, 9), (7, 7), (8, 7), (10, 10)}
    assert sorted(r.doc_id for r in simhash_bk.keep_one(table(spark, rows)).collect()) == [3, 7, 9, 10]
    assert simhash_bk.groups(table(spark, []).limit(0)).count() == 0


def test_groups_equal_brute_force_on_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    want = brute_components([slow_fingerprint(r.text) for r in rows])
    least = defaultdict(list)
    for r, k in zip(rows, want, strict=True):
        least[k].append(r.doc_id)
    assert {r.doc_id: r.component_id for r in simhash_bk.groups(docs).collect()} == {r.doc_id: min(least[k]) for r, k in zip(rows, want, strict=True)}


def slow_targets(size, weights=(5, 2, 1)):
    """Share out, cap, share the excess again, until none is above its cap."""
    names = sorted((s for s in size if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in size)
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    left, open_ = 1.5 * sum(size.values()), set(names)
    target = {}
    while open_:
        total = sum(w[s] for s in open_)
        over = {s for s in open_ if left * w[s] / total > 2 * size[s]}
        if not over:
            target |= {s: left * w[s] / total for s in open_}
            break
        target |= {s: 2.0 * size[s] for s in over}
        left -= sum(2.0 * size[s] for s in over)
        open_ -= over
    return target


def test_mix(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(["w"] * rng.randrange(1, 300)), rng.choice(["a", "b", "b", "b", "Z", "é", None, "𐀀", "￿"])) for i in range(800)]
    rows += [(900, None, "a"), (901, "", None), (902, " \n", "only empty"), (None, "w w w", "b"), (3, "w w", "b"), (3, "w w", "b")]
    docs = table(spark, rows)
    size = defaultdict(int)
    for _, t, s in rows:
        size[s] += len((t or "").split())
    want = slow_targets(size)
    found = source_mix.mix(docs, buckets=16).collect()
    assert len(found) == len(rows)
    taken = defaultdict(int)
    for r in found:
        assert r.target == pytest.approx(want[r.source]) and r.source_size == size[r.source]
        assert r.taken == r.copies * r.size <= 2 * r.size
        taken[r.source] += r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(10, 0.02 * t), (s, taken[s], t)
    again = source_mix.mix(docs.repartition(7), buckets=16).collect()
    assert sorted(map(str, found)) == sorted(map(str, again))
    assert sorted((r.doc_id or -1, r.taken) for r in source_mix.mix(docs, buckets=1).collect()) == sorted((r.doc_id or -1, r.taken) for r in found)
    mixed = source_mix.apply_mix(docs, buckets=16)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in found)
    assert source_mix.mix(docs.limit(0)).count() == 0


def test_pareto_ranks(spark):
    """What is taken first is what has the least rank (u / (1 - u)) / (p / (1 - p))."""
    docs = table(spark, [(i, "w " * (1 + i * i % 37), "a" if i % 2 else "b") for i in range(400)])
    rows = source_mix.mix(docs).collect()
    seen = 0
    for s in "ab":
        own = [r for r in rows if r.source == s]
        u = {r.doc_id: (int(hashlib.sha256(f"{source_mix.SEED}:{r.doc_id}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52 for r in own}
        base = min(r.copies for r in own)
        rest = own[0].target - base * own[0].source_size
        assert sum(r.p * r.size for r in own) == pytest.approx(rest, abs=1e-6)
        more = {r.doc_id for r in own if r.copies > base}
        rank = {r.doc_id: 0.0 if r.p >= 1 else u[r.doc_id] / (1 - u[r.doc_id]) * (1 - r.p) / r.p for r in own if r.p > 0}
        assert more == set(sorted(rank, key=lambda i: (rank[i], i))[: len(more)])
        if 0 < rest < own[0].source_size:
            seen += 1
            assert len({r.p for r in own}) > 5
            assert abs(sum(r.taken for r in own) - own[0].target) <= max(r.size for r in own if r.p < 1) / 2
    assert seen


def test_inclusion_frequencies(spark):
    """Over many sources of the same sizes a document is taken as often as its probability says."""
    sources, per_size = 40, 3
    docs = table(spark, [(1000 * s + i, "w " * (1 + i % 40), f"source {s}") for s in range(sources) for i in range(40 * per_size)])
    rows = source_mix.mix(docs, total_share=0.6, weights=(1,)).collect()
    p = {r.size: r.p for r in rows}
    assert len({x for x in p.values() if x < 1}) > 10 and max(p.values()) == 1
    taken = defaultdict(int)
    for r in rows:
        assert r.copies <= 1
        taken[r.size] += r.copies / (sources * per_size)
    assert all(abs(taken[s] - p[s]) < 0.15 for s in p)
    assert np.mean([taken[s] - p[s] for s in p]) == pytest.approx(0, abs=0.02)


def test_columns_of_any_name(spark):
    """Columns that have the names which the operators use themselves."""
    names = ["_id", "_sha", "_size", "_src", "key_id", "key_digest", "key_source", "key_size", "text_digest", "copies", "size", "copy", "gone_id", "p", "q", "node", "fp"]
    docs = table(spark, EDGE).select("doc_id", "text", "source", *[F.lit(k).alias(n) for k, n in enumerate(names)])
    labels = spark.createDataFrame([(1, 1), (3, 1)], "doc_id long, quality int")
    for out in (exact_dedup.drop_copies(docs), simhash_bk.keep_one(docs), simhash_bk.keep_one_similar(docs), source_mix.apply_mix(docs), quality_knn.keep_good(docs, labels)):
        assert out.columns == docs.columns
        rows = out.collect()
        assert rows and all(list(r)[3:] == list(range(len(names))) for r in rows)
