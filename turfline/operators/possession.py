"""Who holds the ball: nearest players, hysteresis, shares."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turfline import config as C
from turfline.functions import geometry as G
from turfline.operators.projection import with_speed

KEY = ["clip", "frame"]


def holders(labels: DataFrame) -> DataFrame:
    """clip, track_id, side: team_a, team_b or keeper; others never hold the ball."""
    side = F.when(F.col("role").isin("team_a", "team_b"), F.col("role")).when(F.col("role") == "goalkeeper", "keeper")
    return labels.select("clip", "track_id", side.alias("side")).filter("side is not null")


def nearest_players(positions: DataFrame, ball: DataFrame, labels: DataFrame) -> DataFrame:
    """clip, frame, track_id, side, dist: the eligible player nearest to the ball; ties go to the smaller id."""
    eligible = positions.join(holders(labels), ["clip", "track_id"]).select(*KEY, "track_id", "side", F.col("x_m").alias("px"), F.col("y_m").alias("py"))
    pairs = eligible.join(ball.filter("x_m is not null").select(*KEY, "x_m", "y_m"), KEY)
    dist = G.distance(F.col("px"), F.col("py"), F.col("x_m"), F.col("y_m"))
    best = pairs.groupBy(*KEY).agg(F.min(F.struct(dist.alias("dist"), F.col("track_id"), F.col("side"))).alias("b"))
    return best.select(*KEY, "b.track_id", "b.side", "b.dist")


def possession(positions: DataFrame, ball: DataFrame, labels: DataFrame, fps: float, cfg: C.Possession = C.Possession()) -> DataFrame:
    """clip, frame, state, track_id: one row per ball frame.

    A frame's touch is the track that could acquire, 0 rows of whom make a run: -1 for a missing or unreliable ball,
    -2 for none. The acquire_frames-th row of a run of one track makes it the holder; a run of more than the allowed
    missing rows makes it unknown; the last of these events holds.
    """
    rows = with_speed(ball, fps).join(nearest_players(positions, ball, labels), KEY, "left")
    missing = F.col("x_m").isNull() | ~F.col("reliable")
    touch = (F.col("dist") <= cfg.radius_m) & (F.col("speed") <= cfg.max_ball_speed_mps) & ~F.col("airborne")
    rows = rows.select(*KEY, "side", F.when(missing, F.lit(-1)).when(touch, F.col("track_id")).otherwise(F.lit(-2)).cast("long").alias("touch"))
    order = Window.partitionBy("clip").orderBy("frame")
    changed = (F.col("touch") != F.lag("touch").over(order)).cast("int")
    rows = rows.withColumn("run", F.coalesce(F.sum(F.coalesce(changed, F.lit(0))).over(order), F.lit(0)))
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("clip", "run").orderBy("frame")))
    lost = round(cfg.max_unknown_s * fps)
    event = F.when((F.col("touch") >= 0) & (F.col("n") >= cfg.acquire_frames), F.struct(F.col("side").alias("state"), F.col("touch").alias("track_id"))).when(
        (F.col("touch") == -1) & (F.col("n") > lost), F.struct(F.lit("unknown").alias("state"), F.lit(-1).cast("long").alias("track_id"))
    )
    held = F.last(event, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("held", held)
    return rows.select(*KEY, F.coalesce("held.state", F.lit("unknown")).alias("state"), F.coalesce("held.track_id", F.lit(-1)).cast("long").alias("track_id"))


def shares(states: DataFrame) -> DataFrame:
    """clip, team_a, team_b (of the attributed frames), keeper_share, unknown_share (of all)."""
    n = {s: F.count_if(F.col("state") == s) for s in ("team_a", "team_b", "keeper")}
    by = states.groupBy("clip").agg(*[c.alias(f"n_{s}") for s, c in n.items()], F.count(F.lit(1)).alias("n"))
    attributed = F.col("n_team_a") + F.col("n_team_b")
    part = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    return by.select(
        "clip", part(F.col("n_team_a"), attributed).alias("team_a"), part(F.col("n_team_b"), attributed).alias("team_b"),
        part(F.col("n_keeper"), F.col("n")).alias("keeper_share"), part(F.col("n") - attributed - F.col("n_keeper"), F.col("n")).alias("unknown_share"),
    )


def running_share(states: DataFrame, spine: DataFrame | None = None) -> DataFrame:
    """clip, frame, share: team a's part of the attributed frames so far; null before the first.

    With a spine, frames without a state carry the last share on.
    """
    order = Window.partitionBy("clip").orderBy("frame").rowsBetween(Window.unboundedPreceding, 0)
    a = F.sum((F.col("state") == "team_a").cast("long")).over(order)
    both = F.sum(F.col("state").isin("team_a", "team_b").cast("long")).over(order)
    rows = states.select(*KEY, F.try_divide(a.cast("double"), both.cast("double")).alias("share"))
    if spine is None:
        return rows
    rows = spine.select(*KEY).join(rows, KEY, "left")
    return rows.withColumn("share", F.last("share", ignorenulls=True).over(order))


def bar_split(share: str, width: int):
    """Column at which a share bar changes colour; null stays null."""
    return F.bround(F.least(F.greatest(F.col(share), F.lit(0.0)), F.lit(1.0)) * width).cast("int")
