"""Mixing sources to target weights by Pareto order sampling of whole documents.

Each source gets a target number of words: a share of the whole by weight, at most `max_epochs` times its own
size; what a source cannot take goes to the others by weight. A source that is to be read r times gives every
document floor(r) certain whole copies. What is left of its target is an unequal-probability sample of one more copy:
the inclusion probability p of a document grows with its size s as p = min(1, f s), f being such that the expected
words, the sum of p s, are what is left; documents with p = 1 are certain. A document gets the rank
Q = (u / (1 - u)) / (p / (1 - p)), u being a hash of its id, and the documents of least Q are taken. The sample's size is
fixed in words, the unit of the targets: it ends at the document whose middle lies at what is left, so a source misses
its target by half of one uncertain document at most. Ranks are cut in two steps, so that no source is sorted as a
whole: word totals of BUCKETS rank ranges, then the exact order within the one range in which the target falls.

Null texts have size 0, as have empty ones; documents without words take nothing. A null source is a source and
comes last. Equal ranks (repeated rows, certain documents) are ordered by id and size and repeated rows are taken
together. Very long texts are counted whole. An empty table gives an empty result. Further columns are not read and
stay as they are, whatever their names. Reruns agree: nothing depends on partitions or time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WS, fresh, small_side, staged

WEIGHTS = (5, 2, 1)
TOTAL_SHARE = 1.5
MAX_EPOCHS = 2
SEED = 20
BUCKETS = 4096


def sizes(docs: DataFrame) -> DataFrame:
    words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(f"[^{WS}]+"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", F.coalesce(words, F.lit(0)).cast("long").alias("size"))


def targets(sized: DataFrame, weights=WEIGHTS, total_share: float = TOTAL_SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """source, source_size, target. One row per source; sources that reach their cap first come first."""
    by = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").cast("binary").asc_nulls_last())
    rank = (F.row_number().over(order) - 1) % len(weights)
    by = by.withColumn("weight", F.element_at(F.array(*[F.lit(w).cast("double") for w in weights]), (rank + 1).cast("int")))
    by = by.withColumn("cap", (F.col("source_size") * max_epochs).cast("double"))
    upward = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").cast("binary").asc_nulls_last())
    before = upward.rowsBetween(Window.unboundedPreceding, -1)
    after = upward.rowsBetween(0, Window.unboundedFollowing)
    whole = F.sum("source_size").over(Window.partitionBy()) * total_share
    level = (whole - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    by = by.withColumn("level", level).withColumn("fits", F.col("cap") > F.col("weight") * F.col("level"))
    # from the first source below its cap on, all are below it and share its level, of sources that tie the greatest
    shared = F.min(F.when(F.col("fits"), F.struct((F.col("cap") / F.col("weight")).alias("at"), (-F.col("level")).alias("under")))).over(Window.partitionBy())
    by = by.withColumn("shared", -shared["under"])
    share = F.when(F.col("shared").isNull() | (F.col("cap") <= F.col("weight") * F.col("shared")), F.col("cap")).otherwise(F.col("weight") * F.col("shared"))
    return by.select("source", "source_size", share.alias("target"))


def uniform(column, seed: int = SEED):
    """A number of (0, 1) from 52 bits of SHA-256 of the seed and the id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(column.cast("string"), F.lit("null")))
    return (F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def factors(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """at_source, factor: of each source with a rest, the f for which the sum of s min(1, f s) is the rest.

    A window over the distinct sizes of a source, with exact sums of whole numbers: words above a size are certain
    where f is its reciprocal, the squares up to it are not.
    """
    per = sized.filter("size > 0").groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, 0)
    above = Window.partitionBy("source").orderBy("size").rowsBetween(1, Window.unboundedFollowing)
    per = per.withColumn("squares", F.sum(F.col("size") * F.col("size") * F.col("n")).over(upto))
    per = per.withColumn("above", F.coalesce(F.sum(F.col("size") * F.col("n")).over(above), F.lit(0)))
    per = per.join(small_side(plan.select("at_source", "rest"), 10_000), F.col("source").eqNullSafe(F.col("at_source")))
    fits = per.filter("rest > 0 and cast(squares as double) / size + above >= rest")
    best = fits.groupBy("at_source", "rest").agg(F.max_by(F.struct("squares", "above"), "size").alias("b"))
    return best.select(F.col("at_source").alias("of_source"), ((F.col("rest") - F.col("b.above")) / F.col("b.squares")).alias("factor"))


def mix(docs: DataFrame, weights=WEIGHTS, total_share: float = TOTAL_SHARE, max_epochs: int = MAX_EPOCHS, seed: int = SEED, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken, p: one row per row of docs."""
    sized = staged(sizes(docs), "mix-sizes")
    plan = targets(sized, weights, total_share, max_epochs)
    plan = plan.withColumn("certain", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    plan = plan.withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.col("certain") * F.col("source_size")))
    plan = staged(plan.withColumnRenamed("source", "at_source"), "mix-plan")
    found = factors(sized, plan)
    plan = plan.join(found, F.col("at_source").eqNullSafe(F.col("of_source")), "left").drop("of_source")
    plan = staged(plan.withColumn("factor", F.coalesce("factor", F.lit(0.0))), "mix-plan")

    u = uniform(F.col("doc_id"), seed)
    ranked = sized.join(small_side(plan, 10_000), F.col("source").eqNullSafe(F.col("at_source")))
    ranked = ranked.withColumn("p", F.least(F.lit(1.0), F.col("factor") * F.col("size")))
    odds = (u / (1 - u)) / (F.col("p") / (1 - F.col("p")))
    ranked = ranked.withColumn("q", F.when(F.col("p") >= 1, F.lit(0.0)).when(F.col("p") > 0, odds / (1 + odds)))
    ranked = ranked.withColumn("bucket", F.least(F.floor(F.col("q") * buckets), F.lit(buckets - 1)).cast("int"))

    # words up to the end of each rank range; the range in which a source's rest falls
    per = ranked.filter("q is not null").groupBy("at_source", "bucket").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"))
    upto = F.sum("words").over(Window.partitionBy("at_source").orderBy("bucket"))
    cut = per.withColumn("upto", upto).filter("upto > rest").groupBy("at_source").agg(
        F.min("bucket").alias("cut_bucket"), F.min_by(F.col("upto") - F.col("words"), "bucket").alias("below")
    )
    cut = staged(cut.withColumnRenamed("at_source", "cut_source"), "mix-cut")
    ranked = ranked.join(small_side(cut, 10_000), F.col("at_source").eqNullSafe(F.col("cut_source")), "left").drop("cut_source")

    # within that range: the last document whose middle lies below what is left
    inside = ranked.filter("q is not null and bucket = cut_bucket").groupBy("at_source", "q", "doc_id", "size").agg(
        F.first("below").alias("below"), F.first("rest").alias("rest"), (F.count(F.lit(1)) * F.col("size")).alias("own")
    )
    total = F.sum("own").over(Window.partitionBy("at_source").orderBy("q", "doc_id", "size")) + F.col("below")
    inside = inside.withColumn("total", total).filter("2 * total - own < 2 * rest")
    edge = inside.groupBy("at_source").agg(F.max(F.struct("q", "doc_id", "size")).alias("last"))
    edge = staged(edge.select(F.col("at_source").alias("edge_source"), "last"), "mix-edge")
    ranked = ranked.join(small_side(edge, 10_000), F.col("at_source").eqNullSafe(F.col("edge_source")), "left")
    here = F.struct("q", "doc_id", "size")
    inside = F.col("cut_bucket").isNull() | (F.col("bucket") < F.col("cut_bucket")) | ((F.col("bucket") == F.col("cut_bucket")) & F.col("last").isNotNull() & (here <= F.col("last")))
    taken = F.coalesce(F.col("q").isNotNull() & inside, F.lit(False))
    copies = F.when(F.col("size") > 0, F.col("certain") + taken.cast("long")).otherwise(0).cast("long")
    return ranked.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), "p")


def apply_mix(docs: DataFrame, **options) -> DataFrame:
    """docs with each row as often as the mix takes it; rows are found again by id, source and size."""
    key_id, key_source, key_size, copies, size, copy = fresh(docs, "key_id", "key_source", "key_size", "copies", "size", "copy")
    chosen = mix(docs, **options).filter("copies > 0").groupBy("doc_id", "source", "size").agg(F.max("copies").alias(copies))
    chosen = chosen.select(F.col("doc_id").alias(key_id), F.col("source").alias(key_source), F.col("size").alias(key_size), copies)
    rows = docs.withColumn(size, F.regexp_count(F.coalesce("text", F.lit("")), F.lit(f"[^{WS}]+")).cast("long"))
    same = F.col("doc_id").eqNullSafe(F.col(key_id)) & F.col("source").eqNullSafe(F.col(key_source)) & (F.col(size) == F.col(key_size))
    out = rows.join(chosen, same)
    return out.withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies)))).select(*[F.col(f"`{c}`") for c in docs.columns])
