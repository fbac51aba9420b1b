"""The pitch as generated tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turfline import config as C
from turfline.functions import geometry as G

# Sizes that do not follow the pitch's length and width, in metres.
PENALTY_DEPTH, PENALTY_WIDTH, GOAL_DEPTH, GOAL_WIDTH, SPOT, CIRCLE = 16.5, 40.32, 5.5, 18.32, 11.0, 9.15
#: 0-based vertices at which clicks do not agree with the model.
PHANTOM = (10, 11, 18, 19)
# Edges between 1-based vertices.
EDGES = (
    (1, 2), (2, 3), (3, 4), (4, 5), (5, 6), (7, 8), (10, 11), (11, 12), (12, 13), (14, 15), (15, 16), (16, 17), (18, 19), (19, 20), (20, 21), (23, 24),
    (25, 26), (26, 27), (27, 28), (28, 29), (29, 30), (1, 14), (2, 10), (3, 7), (4, 8), (5, 13), (6, 17), (14, 25), (18, 26), (23, 27), (24, 28), (21, 29), (17, 30),
)


def vertices(pitch: C.Pitch = C.Pitch()) -> list[tuple[int, float, float]]:
    """vertex (1-based), x, y: one half is written down by its offsets, the other mirrors it."""
    length, width, mid = pitch.length, pitch.width, pitch.width / 2
    across = [0.0, mid - PENALTY_WIDTH / 2, mid - GOAL_WIDTH / 2, mid + GOAL_WIDTH / 2, mid + PENALTY_WIDTH / 2, width]
    rows = [(0.0, y) for y in across]
    rows += [(GOAL_DEPTH, across[2]), (GOAL_DEPTH, across[3]), (SPOT, mid)]
    rows += [(PENALTY_DEPTH, y) for y in across[1:5]]
    rows += [(length / 2, y) for y in (0.0, mid - CIRCLE, mid + CIRCLE, width)]
    rows += [(length - PENALTY_DEPTH, y) for y in across[1:5]]
    rows += [(length - SPOT, mid), (length - GOAL_DEPTH, across[2]), (length - GOAL_DEPTH, across[3])]
    rows += [(length, y) for y in across]
    rows += [(length / 2 - CIRCLE, mid), (length / 2 + CIRCLE, mid)]
    return [(i, *p) for i, p in enumerate(rows, 1)]


def vertex_table(spark: SparkSession, pitch: C.Pitch = C.Pitch()) -> DataFrame:
    return spark.createDataFrame(vertices(pitch), "vertex int, x_m double, y_m double")


def edge_table(spark: SparkSession, pitch: C.Pitch = C.Pitch()) -> DataFrame:
    """edge, a, b, length_m."""
    at = {v: (x, y) for v, x, y in vertices(pitch)}
    return spark.createDataFrame([(i, a, b, math.dist(at[a], at[b])) for i, (a, b) in enumerate(EDGES)], "edge int, a int, b int, length_m double")


def control_points(pitch: C.Pitch = C.Pitch()) -> list[tuple[float, float]]:
    """Four corners and both ends of the halfway line."""
    return [(0.0, 0.0), (pitch.length, 0.0), (pitch.length, pitch.width), (0.0, pitch.width), (pitch.length / 2, 0.0), (pitch.length / 2, pitch.width)]


def circle_points(spark: SparkSession, pitch: C.Pitch = C.Pitch(), n: int = 64) -> DataFrame:
    """seq, x_m, y_m of the centre circle."""
    angle = F.col("id") * (2 * math.pi / n)
    return spark.range(n + 1).select(F.col("id").alias("seq"), (F.cos(angle) * CIRCLE + pitch.length / 2).alias("x_m"), (F.sin(angle) * CIRCLE + pitch.width / 2).alias("y_m"))


def padded_boundary(spark: SparkSession, margin: float, step: float = 1.0, pitch: C.Pitch = C.Pitch()) -> DataFrame:
    """side, seq, x_m, y_m: points along the pitch's outline widened by the margin, at most step apart."""
    x0, y0, x1, y1 = -margin, -margin, pitch.length + margin, pitch.width + margin
    corners = [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]
    sides = [(i, *a, *b, math.ceil(math.dist(a, b) / step)) for i, (a, b) in enumerate(zip(corners, corners[1:] + corners[:1], strict=True))]
    rows = spark.createDataFrame(sides, "side int, ax double, ay double, bx double, by double, n int")
    rows = rows.withColumn("seq", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    t = F.col("seq") / F.col("n")
    return rows.select("side", "seq", (F.col("ax") + (F.col("bx") - F.col("ax")) * t).alias("x_m"), (F.col("ay") + (F.col("by") - F.col("ay")) * t).alias("y_m"))


def polylines(spark: SparkSession, pitch: C.Pitch = C.Pitch(), circle: int = 48) -> DataFrame:
    """line, kind, seq, x_m, y_m: the straight edges, the centre circle and what the boxes leave of the penalty arcs."""
    at = {v: (x, y) for v, x, y in vertices(pitch)}
    straight = [(i, "edge", seq, *at[v]) for i, ends in enumerate(EDGES) for seq, v in enumerate(ends)]
    out = spark.createDataFrame(straight, "line int, kind string, seq int, x_m double, y_m double")
    round_ = [(len(EDGES), "circle", pitch.length / 2, 0.0, 2 * math.pi, circle, 1.0)]
    beyond = (PENALTY_DEPTH - SPOT) / CIRCLE
    if beyond < 1:
        half, n = math.acos(max(beyond, -1.0)), max(circle // 4, 8) - 1
        round_ += [(len(EDGES) + 1, "arc", SPOT, -half, half, n, 1.0), (len(EDGES) + 2, "arc", pitch.length - SPOT, -half, half, n, -1.0)]
    rows = spark.createDataFrame(round_, "line int, kind string, cx double, low double, high double, n int, side double")
    rows = rows.withColumn("seq", F.explode(F.sequence(F.lit(0), F.col("n"))))
    angle = F.col("low") + (F.col("high") - F.col("low")) * F.col("seq") / F.col("n")
    return out.unionByName(rows.select("line", "kind", "seq", (F.col("cx") + F.cos(angle) * F.col("side") * CIRCLE).alias("x_m"), (F.sin(angle) * CIRCLE + pitch.width / 2).alias("y_m")))


def outline_in_image(calibration: DataFrame, margin: float = 1.0, step: float = 1.0, pitch: C.Pitch = C.Pitch()) -> DataFrame:
    """clip, frame, side, seq, x, y: the widened outline in each frame's image.

    Points on the horizon go, and those on its far side: what lies there has a denominator of another sign than the
    median of the frame. Frames with fewer than three points have no outline.
    """
    spark = calibration.sparkSession
    points = padded_boundary(spark, margin, step, pitch).agg(F.array_sort(F.collect_list(F.struct("side", "seq", "x_m", "y_m"))).alias("points"))
    # a frame becomes many points: frames are dealt to all tasks first, however few bytes they are
    rows = calibration.filter("h is not null").select("clip", "frame", "h").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "clip", "frame")
    rows = rows.select("clip", "frame", G.mat_inv(F.col("h")).alias("inv")).crossJoin(F.broadcast(points))  # one row of points

    def place(p: Column) -> Column:
        at = G.project(F.col("inv"), p["x_m"], p["y_m"])
        return F.struct(p["side"].alias("side"), p["seq"].alias("seq"), at["x"].alias("x"), at["y"].alias("y"), G.denominator(F.col("inv"), p["x_m"], p["y_m"]).alias("w"))

    def seen(placed: Column) -> Column:
        """Those on the side of the median denominator, null for fewer than three."""
        middle = G.let(F.sort_array(F.transform(placed, lambda p: p["w"])), lambda w: F.get(w, ((F.size(w) - 1) / 2).cast("int")) + F.get(w, (F.size(w) / 2).cast("int")))
        kept = G.let(F.signum(middle), lambda side: F.filter(placed, lambda p: F.signum(p["w"]) == side))
        return G.let(kept, lambda k: F.when(F.size(k) >= 3, k))

    # one expression, whose parts are bound: what is named in steps is computed anew wherever it is used. The outer form keeps a copy out of a filter
    placed = F.filter(F.transform("points", place), lambda p: F.abs(p["w"]) > G.EPS)
    rows = rows.select("clip", "frame", F.explode_outer(G.let(placed, seen)).alias("p")).filter("p is not null")
    return rows.select("clip", "frame", "p.side", "p.seq", "p.x", "p.y")


def minimap(clips: DataFrame, share: float = 0.25, margin_share: float = 0.025, gap_share: float = 0.03, pitch: C.Pitch = C.Pitch()) -> DataFrame:
    """clip, panel_w, panel_h, scale, margin, x0, y0 of a panel at the foot of the frame; an error where it does not fit."""
    panel = F.bround(F.col("width") * share).cast("int")
    rows = clips.withColumn("panel_w", panel).withColumn("margin", F.greatest(F.lit(2), F.bround(F.col("panel_w") * margin_share).cast("int")))
    rows = rows.withColumn("scale", (F.col("panel_w") - F.col("margin") * 2) / pitch.length)
    rows = rows.withColumn("panel_h", F.bround(F.col("scale") * pitch.width + F.col("margin") * 2).cast("int"))
    gap = F.bround(F.col("height") * gap_share).cast("int")
    rows = rows.withColumn("x0", F.floor((F.col("width") - F.col("panel_w")) / 2).cast("int")).withColumn("y0", F.col("height") - F.col("panel_h") - gap)
    y0 = F.when((F.col("y0") >= 0) & (F.col("scale") > 0), F.col("y0")).otherwise(F.raise_error(F.lit("the panel does not fit")).cast("int"))
    return rows.select("clip", "panel_w", "panel_h", "scale", "margin", "x0", y0.alias("y0"))
