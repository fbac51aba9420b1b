"""Ordered sequences: runs of frames and flags, smoothing, closing, hysteresis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_run(df: DataFrame, keys: list[str], frame: str = "frame", name: str = "run") -> DataFrame:
    """Adds an id that is constant over maximal runs of consecutive frames within the keys."""
    order = Window.partitionBy(*keys).orderBy(frame)
    return df.withColumn(name, F.col(frame) - F.row_number().over(order))


def runs(df: DataFrame, keys: list[str], frame: str = "frame") -> DataFrame:
    """keys, first_frame, last_frame, n_frames of each run of consecutive frames."""
    found = with_run(df, keys, frame).groupBy(*keys, "run")
    return found.agg(F.min(frame).alias("first_frame"), F.max(frame).alias("last_frame"), F.count(F.lit(1)).alias("n_frames")).drop("run")


def smooth(df: DataFrame, keys: list[str], columns: list[str], window: int, frame: str = "frame") -> DataFrame:
    """Centred moving averages within runs of consecutive frames; a run's ends are continued by its end values.

    The window shrinks to the run's length, then to an odd number; below 3 nothing changes. One window over a run
    gives sums up to each row and the run's end values, from which any width follows: no width needs a shuffle of
    its own.
    """
    part = Window.partitionBy(*keys, "run")
    order = part.orderBy(frame)
    rows = with_run(df, keys, frame)
    rows = rows.withColumn("_n", F.count(F.lit(1)).over(part)).withColumn("_i", F.row_number().over(order) - 1)
    width = F.least(F.col("_n"), F.lit(window)).cast("int")
    half = F.floor((width - F.when(width % 2 == 0, 1).otherwise(0)) / 2).cast("int")
    rows = rows.withColumn("_half", half)
    widest = window // 2
    for c in columns:
        low, high = F.first(c).over(part.orderBy(frame).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), F.last(c).over(part.orderBy(frame).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        near = F.collect_list(c).over(order.rowsBetween(-widest, widest))
        rows = rows.withColumn(f"_near_{c}", near).withColumn(f"_low_{c}", low).withColumn(f"_high_{c}", high)
        before = F.least(F.col("_i"), F.lit(widest)).cast("int")  # rows of the list before this one
        start = F.greatest(before - F.col("_half"), F.lit(0))
        stop = F.least(before + F.col("_half"), F.size(f"_near_{c}") - 1)
        inner = F.aggregate(F.slice(f"_near_{c}", start + 1, stop - start + 1), F.lit(0.0), lambda a, x: a + x)
        missing_low = F.greatest(F.col("_half") - F.col("_i"), F.lit(0))
        missing_high = F.greatest(F.col("_half") - (F.col("_n") - 1 - F.col("_i")), F.lit(0))
        total = inner + F.col(f"_low_{c}") * missing_low + F.col(f"_high_{c}") * missing_high
        rows = rows.withColumn(f"_out_{c}", F.when(F.col("_half") < 1, F.col(c)).otherwise(total / (2 * F.col("_half") + 1)))
    return rows.select(*[F.col(f"_out_{c}").alias(c) if c in columns else F.col(c) for c in df.columns])


def flag_runs(df: DataFrame, keys: list[str], flag: str, order: str = "frame") -> DataFrame:
    """Adds _run, an id of maximal runs of equal flags, and _len, their lengths in rows."""
    w = Window.partitionBy(*keys).orderBy(order)
    changed = (F.col(flag) != F.lag(flag).over(w)).cast("int")
    marked = df.withColumn("_run", F.coalesce(F.sum(F.coalesce(changed, F.lit(0))).over(w), F.lit(0)))
    return marked.withColumn("_len", F.count(F.lit(1)).over(Window.partitionBy(*keys, "_run")))


def close_flags(df: DataFrame, keys: list[str], flag: str, max_hole: int, min_island: int, order: str = "frame") -> DataFrame:
    """Fills holes of at most max_hole rows between true runs, then drops true runs shorter than min_island rows."""
    part = Window.partitionBy(*keys)
    rows = flag_runs(df, keys, flag, order)
    inner = (F.col("_run") > F.min("_run").over(part)) & (F.col("_run") < F.max("_run").over(part))
    rows = rows.withColumn(flag, F.col(flag) | (inner & (F.col("_len") <= max_hole))).drop("_run", "_len")
    rows = flag_runs(rows, keys, flag, order)
    return rows.withColumn(flag, F.col(flag) & (F.col("_len") >= min_island)).drop("_run", "_len")


def carried(column: Column, keys: list[str], order: str = "frame") -> Column:
    """The last value that is not null, up to this row."""
    return F.last(column, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))


def coming(column: Column, keys: list[str], order: str = "frame") -> Column:
    """The next value that is not null, from this row on."""
    return F.first(column, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(0, Window.unboundedFollowing))
