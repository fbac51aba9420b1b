"""What is decided about frames before they are decoded: ranges, samples, borders, crops."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turfline import config as C


def frame_range(frames: DataFrame, start: int = 0, stop: int | None = None, stride: int = 1) -> DataFrame:
    """Frames of [start, stop) at the stride."""
    if stride < 1:
        raise ValueError("the stride is below 1")
    rows = frames.filter((F.col("frame") >= start) & ((F.col("frame") - start) % stride == 0))
    return rows if stop is None else rows.filter(F.col("frame") < stop)


def with_duration(clips: DataFrame) -> DataFrame:
    """Adds duration_s; 0 for an unknown rate."""
    return clips.withColumn("duration_s", F.when(F.col("fps") == 0, 0.0).otherwise(F.try_divide(F.col("frame_count").cast("double"), F.col("fps"))))


def sample_frames(clips: DataFrame, count: int = 8) -> DataFrame:
    """clip, seq, frame: evenly spread frames from first to last, cut to whole numbers; no more than there are."""
    rows = clips.withColumn("n", F.least(F.lit(count), F.greatest(F.col("frame_count"), F.lit(1))).cast("int"))
    rows = rows.withColumn("seq", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    step = (F.greatest(F.col("frame_count"), F.lit(1)) - 1) / F.greatest(F.col("n") - 1, F.lit(1)).cast("double")
    return rows.select("clip", "seq", F.floor(F.col("seq") * step).cast("long").alias("frame"))


def letterbox(brightness: DataFrame, threshold: float = 20.0, most: float = 0.3) -> DataFrame:
    """clip, axis, lead, trail: bars at both ends that are dark in every frame, at most a share of the size.

    brightness has clip, axis, ix, mean of each row or column of each frame.
    """
    lines = brightness.groupBy("clip", "axis", "ix").agg(F.max("mean").alias("top"))
    by = lines.groupBy("clip", "axis").agg(F.min(F.when(F.col("top") >= threshold, F.col("ix"))).alias("first"), F.max(F.when(F.col("top") >= threshold, F.col("ix"))).alias("last"), (F.max("ix") + 1).alias("n"))
    cap = F.floor(F.col("n") * most)
    lead = F.least(F.coalesce("first", "n"), cap).cast("long")
    trail = F.least(F.coalesce(F.col("n") - 1 - F.col("last"), F.col("n")), cap).cast("long")
    return by.select("clip", "axis", lead.alias("lead"), trail.alias("trail"))


def resolve_crop(clips: DataFrame, brightness: DataFrame | None = None, io: C.IO = C.IO()) -> DataFrame:
    """clips with crop_top, crop_bottom, crop_left, crop_right: the bars found by `letterbox`, or the configured crop.

    A clip without brightness has no bars.
    """
    edges = ("crop_top", "crop_bottom", "crop_left", "crop_right")
    if not io.auto_letterbox:
        return crop(clips.withColumns({e: F.lit(getattr(io, e)) for e in edges}))
    if brightness is None:
        raise ValueError("bars are found by the brightness of sampled frames")
    bars = letterbox(brightness, io.letterbox_threshold)
    side = lambda axis, at: F.coalesce(F.max(F.when(F.col("axis") == axis, F.col(at))), F.lit(0)).cast("int")
    found = bars.groupBy("clip").agg(side("row", "lead").alias(edges[0]), side("row", "trail").alias(edges[1]), side("column", "lead").alias(edges[2]), side("column", "trail").alias(edges[3]))
    return crop(clips.join(found, "clip", "left").withColumns({e: F.coalesce(e, F.lit(0)) for e in edges}))


def shift_into_crop(rows: DataFrame, crops: DataFrame, xs: tuple[str, ...] = ("x1", "x2"), ys: tuple[str, ...] = ("y1", "y2")) -> DataFrame:
    """Rows with their pixel columns counted from the corner of their clip's crop."""
    edges = crops.select(F.col("clip"), F.col("crop_left").alias("from_left"), F.col("crop_top").alias("from_top"))
    moved = rows.join(edges, "clip").withColumns({x: F.col(x) - F.col("from_left") for x in xs} | {y: F.col(y) - F.col("from_top") for y in ys})
    return moved.select(*rows.columns)


def named_frames(frames: DataFrame, wanted: DataFrame) -> DataFrame:
    """The frames that `wanted` (clip, frame) names; each once, however often it is named."""
    return frames.join(wanted.select("clip", "frame"), ["clip", "frame"], "left_semi")


def crop(clips: DataFrame) -> DataFrame:
    """Adds crop_w, crop_h; a crop that leaves nothing is an error."""
    w, h = F.col("width") - F.col("crop_left") - F.col("crop_right"), F.col("height") - F.col("crop_top") - F.col("crop_bottom")
    checked = lambda v: F.when(v > 0, v).otherwise(F.raise_error(F.lit("the crop leaves nothing")).cast("int"))
    return clips.withColumns({"crop_w": checked(w), "crop_h": checked(h)})


def trail(ball: DataFrame, length: int = 40) -> DataFrame:
    """clip, frame, age, x, y, weight: the ball's last positions at each frame, older ones fainter.

    A ring of the given length takes the positions that are there; a missing frame drops its oldest.
    """
    order = Window.partitionBy("clip").orderBy("frame")
    near = F.collect_list(F.when(F.col("x").isNotNull(), F.struct("frame", "x", "y"))).over(order.rowsBetween(-(length - 1), 0))
    rows = ball.withColumn("near", near).select("clip", "frame", F.posexplode("near"))
    size = F.max("pos").over(Window.partitionBy("clip", "frame")) + 1
    return rows.select("clip", "frame", F.col("pos").alias("age"), F.col("col.x").alias("x"), F.col("col.y").alias("y"), ((F.col("pos") + 1) / size).alias("weight"))
