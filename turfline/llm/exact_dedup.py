"""Exact deduplication by stateful streaming.

Every document becomes a slim row: digest, length, identifier and locator. A file stream over the slim rows
feeds a keyed aggregation whose state lies in RocksDB on disk, has no watermark and so never expires; for each
digest it retains the identifier and locator of the row that stays and how many rows it has seen. A batch of
the stream is pre-aggregated before it is dealt out by digest, so that a hot group of copies arrives as one row
a task. Digests with more than one row are hits: the full bytes of their rows are compared, by grouping on the
text itself, before any row is called a copy. Should one digest cover different texts, its rows are grouped by
text instead.

Null texts count as empty; empty texts are equal to each other. Of equal rows with one doc_id the one with the
smallest locator stays. A null doc_id ranks below all others. Very long texts are hashed and compared whole. An empty
table gives an empty result. Further columns are not read and stay as they are, whatever their names.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BROADCAST_ROWS, cleared, fresh, staged, staging_path, whole_text

#: Hex digits of a digest in the table that keeps single texts out of the byte check: 16**5 rows at most.
PREFIX_DIGITS = 5
STATE_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": STATE_PROVIDER,
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    # many small stores would each reserve megabytes of disk ahead
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def sha256_of(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


@contextmanager
def _conf(spark: SparkSession, values: dict[str, str]):
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def slim_rows(docs: DataFrame, digest=sha256_of) -> DataFrame:
    text = whole_text()
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        digest(text).alias("digest"),
        F.octet_length(text).alias("n_bytes"),
        F.monotonically_increasing_id().alias("locator"),
    )


def keyed_state(stream: DataFrame, checkpoint: str, sink: str) -> DataFrame:
    """Run the stream to its present end. One row per digest and length: keep_id, keep_locator, group_size.

    `checkpoint` holds the state between runs: a later run over new files continues it. `sink` gets the changed
    keys of each batch in a folder of the batch's own, which a repeated batch overwrites.
    """
    spark = stream.sparkSession
    keyed = stream.groupBy("digest", "n_bytes").agg(
        F.max(F.struct("doc_id", (-F.col("locator")).alias("low_first"))).alias("keeper"),
        F.count(F.lit(1)).alias("group_size"),
    )
    changed = keyed.select("digest", "n_bytes", "keeper.doc_id", (-F.col("keeper.low_first")).alias("locator"), "group_size")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")

    with _conf(spark, STATE_CONF):
        run = (
            changed.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        )
        run.awaitTermination()
    schema = T.StructType([*changed.schema.fields, T.StructField("batch", T.LongType())])
    seen = spark.read.schema(schema).parquet(sink) if run.lastProgress is not None else spark.createDataFrame([], schema)
    last = F.max_by(F.struct("doc_id", "locator", "group_size"), "batch").alias("last")
    return seen.groupBy("digest", "n_bytes").agg(last).select(
        "digest", "n_bytes", F.col("last.doc_id").alias("keep_id"), F.col("last.locator").alias("keep_locator"), F.col("last.group_size").alias("group_size")
    )


def _bytes_checked(docs: DataFrame, hits: DataFrame, digest) -> DataFrame:
    """Rows by digest and full text of the digests that have hits, with what the text's own group keeps."""
    text = whole_text()
    named = lambda c: F.xxhash64(c)
    if hits.count() > BROADCAST_ROWS:  # then by the first digits of the digest, a table of bounded size
        named = lambda c: F.substring(c, 1, PREFIX_DIGITS)
    few = hits.select(named(F.col("digest")).alias("name")).distinct()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest(text).alias("digest"), text.alias("text"))
    rows = rows.join(F.broadcast(few), named(F.col("digest")) == F.col("name"), "left_semi")
    return rows.groupBy("digest", "text").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))


def decisions(docs: DataFrame, digest=sha256_of, max_bytes_per_trigger: int = 64 << 30, max_files_per_trigger: int | None = None) -> DataFrame:
    """One row per row of docs: doc_id, locator, digest, keep_id, group_size, kept."""
    spark = docs.sparkSession
    slim = staged(slim_rows(docs, digest), "dedup-slim")
    at = slim.inputFiles()
    if at:
        folder = at[0].rsplit("/", 1)[0]
        stream = spark.readStream.schema(slim.schema)
        stream = stream.option("maxFilesPerTrigger", max_files_per_trigger) if max_files_per_trigger else stream.option("maxBytesPerTrigger", max_bytes_per_trigger)
        state = keyed_state(stream.parquet(folder), staging_path(spark, "dedup-state"), staging_path(spark, "dedup-changes"))
        state = staged(state, "dedup-groups")
    else:
        state = slim.select("digest", "n_bytes", F.col("doc_id").alias("keep_id"), F.col("locator").alias("keep_locator"), F.lit(0).cast("long").alias("group_size"))
    plain = slim.join(state.drop("n_bytes") if digest is sha256_of else state, ["digest"] if digest is sha256_of else ["digest", "n_bytes"])
    plain = plain.select(
        "doc_id", "locator", "digest", "keep_id", "group_size", (F.col("locator") == F.col("keep_locator")).alias("kept")
    )
    variants = _bytes_checked(docs, state.filter("group_size > 1"), digest)
    collided = variants.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    if collided.isEmpty():
        return plain
    collided = staged(collided, "dedup-collided")
    text = whole_text()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("locator"), digest(text).alias("digest"), text.alias("text"))
    rows = rows.join(collided.select("digest"), "digest", "left_semi")
    groups = rows.groupBy("digest", "text").agg(F.max(F.struct("doc_id", (-F.col("locator")).alias("low"))).alias("keeper"), F.count(F.lit(1)).alias("group_size"))
    apart = rows.join(groups, ["digest", "text"]).select(
        "doc_id", "locator", "digest", F.col("keeper.doc_id").alias("keep_id"), "group_size", (F.col("locator") == -F.col("keeper.low")).alias("kept")
    )
    return plain.join(collided.select("digest"), "digest", "left_anti").unionByName(apart)


def drop_copies(docs: DataFrame) -> DataFrame:
    """docs without the rows that the decisions drop; the columns of docs.

    Rows are found again by doc_id and digest. Of equal rows with one doc_id any one stays.
    """
    own, key_id, key_digest = fresh(docs, "text_digest", "key_id", "key_digest")
    with cleared(docs.sparkSession) as keep:
        # written first: else the rows of a hot digest would stay in the one task that the join has dealt them to
        found = staged(decisions(docs).select("doc_id", "digest", "kept"), "dedup-found")
        keys = found.groupBy(F.col("doc_id").alias(key_id), F.col("digest").alias(key_digest))
        keys = keep(keys.agg(F.max("kept").alias("stays"), F.count(F.lit(1)).alias("n")), "dedup-decisions")
    marked = docs.withColumn(own, sha256_of(whole_text()))

    def with_key(rows: DataFrame, wanted: DataFrame, how: str) -> DataFrame:
        same = F.col("doc_id").cast("long").eqNullSafe(F.col(key_id)) & (F.col(own) == F.col(key_digest))
        return rows.join(wanted.select(key_id, key_digest), same, how)

    left = with_key(marked, keys.filter("not stays"), "left_anti")
    twice = keys.filter("stays and n > 1")
    if twice.isEmpty():
        return left.drop(own)
    many = with_key(left, twice, "left_semi").dropDuplicates(["doc_id", own])
    return with_key(left, twice, "left_anti").unionByName(many).drop(own)
