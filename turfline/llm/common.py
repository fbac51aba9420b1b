"""What the operators of this subpackage share: staged tables, hashes of words, Arrow access."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WS = r"\x20\x09-\x0D"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and every executor see; a temporary one is made only where none is named."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    at = spark.sparkContext._jsc.sc().getCheckpointDir()
    if at.isDefined():
        return at.get()
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and every executor share")
    own = "file://" + tempfile.mkdtemp(prefix="staged-")
    spark.sparkContext.setCheckpointDir(own)
    return own


def staging_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


_written: list[list[str]] = []


@contextmanager
def cleared(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Delete what is staged within, but for the tables staged by the function given out."""
    _written.append([])

    def keep(df: DataFrame, name: str) -> DataFrame:
        out = staged(df, name)
        path = _written[-1].pop()
        if len(_written) > 1:
            _written[-2].append(path)
        return out

    try:
        yield keep
    finally:
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for path in _written.pop():
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)


def step(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """make(), staged; what was staged on the way is deleted."""
    with cleared(spark) as keep:
        return keep(make(), name)


@contextmanager
def _shuffles_released(spark: SparkSession) -> Iterator[None]:
    """What a write within shuffles is deleted when the write is done, not when the driver's garbage happens to be collected."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df as a table in the shared folder and read it back."""
    spark = df.sparkSession
    path = staging_path(spark, name)
    if _written:
        _written[-1].append(path)
    with _shuffles_released(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a table of ids or digests that may be broadcast: some tens of megabytes.
BROADCAST_ROWS = 1_000_000


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it holds at most `rows` rows, counted here; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.count() <= rows else df


def fresh(docs: DataFrame, *names: str) -> list[str]:
    """Names like the given ones that no column of docs has."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def without_ids(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs without the rows whose doc_id, null included, is in the one column of `gone`; the columns of docs."""
    (name,) = fresh(docs, "gone_id")
    gone = gone.toDF(name)
    return docs.join(gone, F.col("doc_id").cast("long").eqNullSafe(F.col(name)), "left_anti")


#: Bytes of rows that a Python worker is given at once, and of text that it turns into one output batch.
SLICE_BYTES = 1 << 20
#: Bytes of output between which a worker hands its free memory back.
RETURN_BYTES = 16 << 20


def byte_slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each piece holds at most `limit` bytes of the column, or one row."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes)
        at = 0
        while at < batch.num_rows:
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, "right")))
            yield batch.slice(at, stop - at)
            at = stop


def give_back() -> None:
    """Return this process's free memory to the system, where its C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """df.mapInArrow, its batches bounded by bytes as well as by rows: 10,000 long texts at once would fill a worker.

    The bound is a setting of the session, which is read when the plan runs: it stays, unless the session has one of its own.
    Workers outlive their tasks, so each task hands its free memory back at its end, and now and then on its way.
    """

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = 0
        try:
            for out in run(batches):
                held += out.nbytes
                yield out
                del out
                if held >= RETURN_BYTES:
                    held = 0
                    give_back()
        finally:
            give_back()

    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(key, None) is None:
        conf.set(key, str(SLICE_BYTES))
    return df.mapInArrow(tidy, schema)


def whole_text(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def fold(column: Column, modulus: int) -> Column:
    """crc32 of the decimal id modulo `modulus`; null for a null id."""
    return F.crc32(column.cast("string").cast("binary")) % modulus


def texts_as_bytes(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    values = batch.column(column)
    if pa.types.is_string(values.type) or pa.types.is_large_string(values.type):
        values = values.cast(pa.large_binary() if pa.types.is_large_string(values.type) else pa.binary())
    return [v or b"" for v in values.to_pylist()]


def texts_as_str(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    return [v or "" for v in batch.column(column).to_pylist()]


_BASE = np.uint64(0x9E3779B97F4A7C15)


def _inverse(odd: int) -> int:
    return pow(odd, -1, 1 << 64)


class WordHasher:
    """64-bit polynomial hashes of all words of a byte string, by prefix sums and without a Python loop.

    H(word) = sum of (byte + 1) * B**k over the word's own positions k, modulo 2**64.
    """

    def __init__(self) -> None:
        self._powers = np.ones(1, np.uint64)
        self._inverses = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self._powers) < n:
            size = max(n, 2 * len(self._powers), 1 << 16)
            with np.errstate(over="ignore"):
                for name, base in (("_powers", int(_BASE)), ("_inverses", _inverse(int(_BASE)))):
                    steps = np.full(size, base, np.uint64)
                    steps[0] = 1
                    setattr(self, name, np.multiply.accumulate(steps))

    def __call__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        self._grow(len(data) + 1)
        with np.errstate(over="ignore"):
            sums = np.zeros(len(data) + 1, np.uint64)
            np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self._powers[: len(data)], out=sums[1:])
            h = (sums[ends] - sums[starts]) * self._inverses[starts]
            h ^= h >> np.uint64(29)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(32)
        return h


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes other than ASCII white space."""
    solid = np.empty(len(data) + 2, bool)
    solid[0] = solid[-1] = False
    np.logical_not((data == 32) | ((data >= 9) & (data <= 13)), out=solid[1:-1])
    edges = np.flatnonzero(solid[1:] != solid[:-1])
    return edges[::2], edges[1::2]
