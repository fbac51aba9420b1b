"""Near-duplicate groups by SimHash fingerprints and BK-trees.

Texts get a 64-bit fingerprint from the XXH64 values of their word shingles. Fingerprints are reduced to
distinct ones, so that copies cost nothing further. Two fingerprints within `radius` bits agree in at least one
of radius + 1 blocks of bits; each value of each block is a shard, whose fingerprints make a BK-tree: children are
keyed by their Hamming distance to the parent, and a search follows only the edges within the radius. Shards
above TREE_NODES are split by a block of the bits that are left, up to DEPTH times (radius + 1 cells for each, as one of
these blocks agrees too), and what is still larger is cut into trees of bounded size, past each of which the shard's
other fingerprints are led one at a time. A
shard reports a spanning forest of its links, never all pairs. The forests are joined to components by
alternating star contraction. Trees and fingerprints never pass through the driver.

Groups by a similarity of shingle sets (`similar_groups`) begin with the same trees and are then completed exactly.

Null texts count as empty; texts without words have fingerprint zero and link like any other. Texts of fewer words
than a shingle are one shingle. Very long texts are hashed in slices. A null doc_id takes part but is never the smallest
id of its group. Ties: equal fingerprints are one node. Repeated rows give repeated results. An empty table gives an
empty result. Further columns of docs are not read and stay as they are, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shingle_sets
from .common import byte_slices, cleared, map_batches, small_side, staged, step, texts_as_bytes, without_ids

SHINGLE = 3
RADIUS = 3
SEED = 42
TREE_NODES = 4096
#: How often a shard above TREE_NODES is split by further blocks of bits before it is cut into several trees.
DEPTH = 3


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    words = text.lower().split()  # bytes: A-Z alone, and ASCII white space alone
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    n = max(1, len(words) - shingle + 1)
    last = ends[shingle - 1 :] if len(words) >= shingle else ends[-1:]
    digest = xxhash.xxh64_intdigest
    return majority(np.array([digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), last.tolist(), strict=True)], np.uint64))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes; zero for none."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):  # bits of one slice of a long text at a time
        ones += np.unpackbits(hashes[at : at + (1 << 14)].astype(">u8").view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_slices(batches):
            fps = np.array([fingerprint(t, shingle) for t in texts_as_bytes(batch)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps)], ["doc_id", "fp"])

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, fp long")


class BKTree:
    """Each node is [value, children by distance]."""

    def __init__(self) -> None:
        self.root: list | None = None

    def add(self, value: int) -> None:
        if self.root is None:
            self.root = [value, {}]
            return
        node = self.root
        while True:
            d = (node[0] ^ value).bit_count()
            child = node[1].get(d)
            if child is None:
                node[1][d] = [value, {}]
                return
            node = child

    def within(self, value: int, radius: int) -> list[int]:
        found = []
        todo = [self.root] if self.root else []
        while todo:
            node, children = todo.pop()
            d = (node ^ value).bit_count()
            if d <= radius:
                found.append(node)
            if children:
                todo += [child for edge, child in children.items() if d - radius <= edge <= d + radius]
        return found


class Forest:
    """Links that span the components of all links within a tree's values and from the queries to them.

    The tree and the names of what it has linked are bounded by the values put into the tree; a query leaves nothing.
    """

    def __init__(self, radius: int) -> None:
        self.radius, self.tree = radius, BKTree()
        self.parent: dict[int, int] = {}

    def _top(self, x: int) -> int:
        while (up := self.parent.setdefault(x, x)) != x:
            self.parent[x] = self.parent.setdefault(up, up)
            x = up
        return x

    def add(self, value: int, inside: bool) -> list[tuple[int, int]]:
        """The links that this value adds; it goes into the tree if `inside`."""
        links, seen = [], set()
        for other in self.tree.within(value, self.radius):
            top = self._top(other)
            if top not in seen:
                seen.add(top)
                links.append((value, other))
        # what the value touches is one component from now on
        tops = list(seen)
        if inside:
            self.tree.add(value)
            tops.append(self._top(value))
        for top in tops[1:]:
            self.parent[top] = tops[0]
        return links


def _blocks(n: int, bits: int) -> list[tuple[int, int]]:
    """Offsets and widths of n blocks that cover the bits."""
    cuts = [i * bits // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def links(fps: DataFrame, radius: int = RADIUS, tree_nodes: int = TREE_NODES) -> DataFrame:
    """a, b: links that span all groups of the distinct fingerprints `fps` (column fp)."""

    def finer_masks(mask: int) -> list[int]:
        """The mask with each block of the bits that it leaves open."""
        bits = [b for b in range(64) if not mask >> b & 1]
        return [mask | sum(1 << b for b in bits[at : at + width]) for at, width in _blocks(radius + 1, len(bits))]

    signed = lambda m: m - (1 << 64) if m >> 63 else m
    # the bits in which a cell's fingerprints agree name it: `mask`, and `value`, the fingerprint under the mask
    masks = finer_masks(0)
    open_rows = fps.select("fp", F.explode(F.array(*[F.lit(signed(m)) for m in masks])).alias("mask"))
    shards, depth = [], 0
    while True:
        keyed = open_rows.withColumn("value", F.col("fp").bitwiseAND(F.col("mask")))
        sizes = keyed.groupBy("mask", "value").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        sizes = staged(sizes, "simhash-shards")
        large = sizes.filter(F.col("n") > tree_nodes)
        last = depth == DEPTH or large.isEmpty()
        fits = keyed.join(sizes if last else sizes.filter(F.col("n") <= tree_nodes), ["mask", "value"])
        chunks = F.ceil(F.col("n") / tree_nodes).cast("int")
        fits = fits.withColumn("chunks", chunks).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"))
        fits = fits.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        shards.append(fits.select("mask", "value", "chunk", (F.col("own") == F.col("chunk")).alias("in_tree"), "fp"))
        if last:
            break
        # within the radius, one of radius + 1 blocks of the bits left open agrees as well
        finer = [F.when(F.col("mask") == signed(m), F.array(*[F.lit(signed(x)) for x in finer_masks(m)])) for m in masks]
        masks = sorted({x for m in masks for x in finer_masks(m)})
        open_rows = staged(keyed.join(large.select("mask", "value"), ["mask", "value"]).select("fp", F.explode(F.coalesce(*finer)).alias("mask")).distinct(), "simhash-finer")
        depth += 1
    key = ["mask", "value", "chunk"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        web: Forest | None = None
        out: list[tuple[int, int]] = []

        def emit() -> pa.RecordBatch:
            pairs = np.array(out, np.uint64).reshape(-1, 2).view(np.int64)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

        for batch in batches:
            keys = zip(*[batch.column(k).to_pylist() for k in key], strict=True)
            values = batch.column("fp").to_numpy().view(np.uint64).tolist()
            for k, inside, value in zip(keys, batch.column("in_tree").to_pylist(), values, strict=True):
                if k != held:
                    held, web = k, Forest(radius)
                out += web.add(value, inside)
            if out:
                yield emit()

    dealt = shards[0]
    for more in shards[1:]:
        dealt = dealt.unionByName(more)
    # a tree's own values come first, then its queries pass by one at a time
    dealt = dealt.repartition(*key).sortWithinPartitions(*key, F.desc("in_tree"), "fp")
    return map_batches(dealt, run, "a long, b long")


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """node, label: the least node of each node's component, by alternating large-star and small-star steps.

    Every step is staged in the shared folder. Hub nodes are reduced before they are dealt out and joined back.
    """
    edges = staged(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "components")
    state = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = staged(large.filter("u <> v"), "components")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        edges = staged(small.filter("u <> v").distinct(), "components")
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("components did not settle")
    own = edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(own)


def _named(slim: DataFrame, key: str, label: DataFrame) -> DataFrame:
    """slim with component_id: the least doc_id of the rows whose `key` has the same label (node, label)."""
    distinct = staged(slim.groupBy(key).agg(F.min("doc_id").alias("first_id")), "groups-distinct")
    label = label.select(F.col("node").alias("at"), "label")
    linked = label.join(distinct, F.col("at") == F.col(key)).select(key, "label", "first_id")
    least = linked.groupBy("label").agg(F.min("first_id").alias("least_id"))
    linked = linked.join(least, "label").select(F.col(key).alias("at"), "least_id")
    named = distinct.join(linked, distinct[key] == linked["at"], "left").select(F.col(key).alias("at"), F.coalesce("least_id", "first_id").alias("component_id"))
    named = staged(named, "groups-named")  # both sides of the last join are then plain exchanges, whose hot keys can be split
    return slim.join(named, slim[key] == named["at"]).select("doc_id", key, "component_id")


def groups(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, tree_nodes: int = TREE_NODES) -> DataFrame:
    """doc_id, fp, component_id: one row per row of docs; groups are linked by fingerprints within the radius."""
    slim = staged(fingerprints(docs, shingle), "simhash-slim")
    label = staged(components(links(slim.select("fp").distinct(), radius, tree_nodes)), "simhash-labels")
    return _named(slim, "fp", label)


def similar_groups(docs: DataFrame, shingle: int = shingle_sets.SHINGLE, radius: int = RADIUS, tree_nodes: int = TREE_NODES, run_rows: int = shingle_sets.RUN, short_rows: int = shingle_sets.SHORT, elements: int = shingle_sets.ELEMENTS, portion: int = shingle_sets.PORTION) -> DataFrame:
    """doc_id, node, component_id: one row per row of docs; groups are linked by a Jaccard similarity of 4/5 or more.

    The BK-trees over the fingerprints of the shingle sets come first: each of their links is compared exactly, as are
    neighbours under a shingle, which joins most copies, however many. As fingerprints of sets of similarity 4/5 differ in ten bits on average,
    a radius that finds them all would visit nearly the whole tree; the links beyond the radius are found by the sets
    themselves (`shingle_sets`), between groups only. The result is that of comparing all pairs.
    """
    sets = staged(shingle_sets.sets_of(docs, majority, shingle).withColumn("row", F.monotonically_increasing_id()), "similar-sets")
    slim = sets.select("doc_id", "node")
    nodes = staged(sets.groupBy("node").agg(F.min("fp").alias("fp"), F.min("row").alias("row"), F.min("n").alias("n"), F.count(F.lit(1)).alias("rows")), "similar-nodes")
    repeats = nodes.filter("rows > 1").select(F.col("node").alias("at"), F.col("row").alias("first"))
    # one row carries each set
    once = sets.join(small_side(repeats), F.col("node") == F.col("at"), "left").filter("first is null or first = row").select("node", "fp", "shingles")
    heads = staged(nodes.groupBy("fp").agg(F.min("node").alias("head")), "similar-heads")
    spark = docs.sparkSession
    name = lambda side: heads.select(F.col("fp").alias(side), F.col("head").alias(f"{side}_head"))
    near = step(spark, lambda: links(heads.select("fp"), radius, tree_nodes), "similar-near")
    found = near.join(name("a"), "a").join(name("b"), "b").select(F.col("a_head").alias("a"), F.col("b_head").alias("b"))
    same = nodes.join(heads, "fp").filter("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b"))

    def linked(pairs: DataFrame) -> DataFrame:
        return step(spark, lambda: shingle_sets.verified_links(pairs, once, nodes, portion), "similar-joined")

    with cleared(spark) as keep:
        first = shingle_sets.shared_prefixes(staged(shingle_sets.posts_of(once), "similar-posts"), keep, portion)
    first = first.withColumn("c", F.col("node"))
    next_to = step(spark, lambda: shingle_sets.candidates(first, shingle_sets.chained, run_rows), "similar-next")
    pairs = found.unionByName(same).unionByName(next_to).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pairs = staged(pairs, "similar-pairs")
    joined = linked(pairs)

    def regrouped() -> DataFrame:
        # a shingle of one text alone has gone for good: what is left is looked at by the groups there are now
        label = staged(components(joined), "similar-labels").select(F.col("node").alias("at"), "label")
        rows = first.drop("c").join(small_side(label), F.col("node") == F.col("at"), "left").select("h", "n", "node", "place", F.coalesce("label", "node").alias("c"))
        return shingle_sets.shared_posts(rows)

    short, long = shingle_sets.by_length(step(spark, regrouped, "similar-shared"), short_rows)
    apart = step(spark, lambda: shingle_sets.candidates(short, shingle_sets.counted, run_rows).join(pairs, ["a", "b"], "left_anti"), "similar-apart")
    joined = joined.unionByName(linked(apart))

    def clustered() -> DataFrame:
        clusters = components(shingle_sets.candidates(long, shingle_sets.spanned, run_rows)).select("node", F.col("label").alias("cluster"))
        clusters = staged(clusters.join(long.select("node", "n", "c").distinct(), "node"), "similar-clusters")
        return shingle_sets.cluster_links(clusters, once, elements)

    joined = joined.unionByName(step(spark, clustered, "similar-more"))
    return _named(slim, "node", step(spark, lambda: components(joined), "similar-labels"))


def _first_of_each(docs: DataFrame, grouped, **options) -> DataFrame:
    with cleared(docs.sparkSession) as keep:
        gone = grouped(docs, **options).filter(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id").distinct()
        gone = keep(gone, "groups-gone")
    return without_ids(docs, gone)


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """docs with one document of each group of fingerprints, the one of the smallest doc_id; the columns of docs.

    Rows of a null doc_id stay only if their whole group has no id; rows that repeat the kept doc_id all stay.
    """
    return _first_of_each(docs, groups, **options)


def keep_one_similar(docs: DataFrame, **options) -> DataFrame:
    """As keep_one, of each group of similar shingle sets."""
    return _first_of_each(docs, similar_groups, **options)
