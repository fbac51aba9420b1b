"""Detections, masks and positions on the pitch plane."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turfline import config as C
from turfline.functions import geometry as G
from turfline.operators import runs

KEY = ["clip", "frame"]


def foot_points(detections: DataFrame, classes: tuple[int, ...] | None = None, min_confidence: float = 0.0) -> DataFrame:
    """Adds foot_x, foot_y, centre_x, centre_y, box_w, box_h; rows of other classes or less confidence go."""
    rows = detections.filter(F.col("confidence") >= min_confidence)
    if classes is not None:
        rows = rows.filter(F.col("class_id").isin(*classes))
    x, y = (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2
    return rows.withColumns({"foot_x": x, "foot_y": F.col("y2"), "centre_x": x, "centre_y": y, "box_w": F.col("x2") - F.col("x1"), "box_h": F.col("y2") - F.col("y1")})


def remap_classes(raw: DataFrame, ball_confidence: float | None = None) -> DataFrame:
    """Class ids by trimmed lower-case name; unknown names go, and ball rows below a floor of their own."""
    ids = F.create_map(*[F.lit(x) for pair in C.CLASS_IDS.items() for x in pair])
    rows = raw.withColumn("class_id", F.try_element_at(ids, F.lower(F.trim("name")))).filter("class_id is not null")
    if ball_confidence is not None:
        rows = rows.filter((F.col("class_id") != C.BALL) | (F.col("confidence") >= ball_confidence))
    return rows


def _with_calibration(rows: DataFrame, calibration: DataFrame, how: str) -> DataFrame:
    return rows.join(calibration.select(*KEY, "h", "low_confidence"), KEY, how)


def project_tracks(tracks: DataFrame, calibration: DataFrame, drop_low_confidence: bool = False) -> DataFrame:
    """clip, frame, track_id, x_m, y_m, reliable; frames without a homography go.

    Low-confidence frames stay and are not reliable, or go as well (the policy of stitching).
    """
    usable = calibration.filter("h is not null")
    if drop_low_confidence:
        usable = usable.filter("not low_confidence")
    p = G.project(F.col("h"), (F.col("x1") + F.col("x2")) / 2, F.col("y2"))
    rows = _with_calibration(tracks, usable, "inner").withColumn("p", p)
    return rows.select(*KEY, "track_id", F.col("p.x").alias("x_m"), F.col("p.y").alias("y_m"), (~F.col("low_confidence")).alias("reliable"))


def project_ball(ball: DataFrame, calibration: DataFrame) -> DataFrame:
    """clip, frame, x_m, y_m, source, airborne, reliable: every ball row; without position or homography null and not reliable."""
    p = F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), G.project(F.col("h"), F.col("x"), F.col("y")))
    rows = _with_calibration(ball, calibration, "left").withColumn("p", p)
    there = F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("h").isNotNull()
    return rows.select(*KEY, F.col("p.x").alias("x_m"), F.col("p.y").alias("y_m"), "source", "airborne", (there & ~F.coalesce("low_confidence", F.lit(True))).alias("reliable"))


def off_field_mask(detections: DataFrame, calibration: DataFrame, margin: float = 1.0, by_class: dict[int, float] | None = None, pitch: C.Pitch = C.Pitch()) -> DataFrame:
    """Detections whose foot lies on the widened pitch; all of a frame without a homography or of low confidence."""
    rows = _with_calibration(detections, calibration, "left")
    wide: Column = F.lit(margin)
    for class_id, own in (by_class or {}).items():
        wide = F.when(F.col("class_id") == class_id, F.lit(own)).otherwise(wide)
    p = G.project(F.col("h"), (F.col("x1") + F.col("x2")) / 2, F.col("y2"))
    passes = F.col("h").isNull() | F.coalesce("low_confidence", F.lit(True)) | G.inside_pitch(p, wide, pitch.length, pitch.width)
    return rows.filter(passes).select(*detections.columns)


def gate_candidates(candidates: DataFrame, calibration: DataFrame, ball: C.Ball = C.Ball(), pitch: C.Pitch = C.Pitch()) -> DataFrame:
    """Ball candidates of plausible size on the widened pitch; frames without a trusted homography pass by size alone."""
    size = F.greatest("w", "h_px")
    rows = _with_calibration(candidates.filter(size.between(ball.min_box_px, ball.max_box_px)), calibration, "left")
    p = G.project(F.col("h"), F.col("x"), F.col("y"))
    passes = F.col("h").isNull() | F.coalesce("low_confidence", F.lit(True)) | G.inside_pitch(p, ball.mask_margin_m, pitch.length, pitch.width)
    return rows.filter(passes).select(*candidates.columns)


def merge_candidates(candidates: DataFrame, merge_dist_px: float = 20.0) -> DataFrame:
    """Greedy suppression within a frame: by falling confidence, a candidate within the distance of a kept one goes."""
    item = F.struct((-F.col("confidence")).alias("rank"), F.col("cand_ix"), F.col("x"), F.col("y"))
    frames = candidates.groupBy(*KEY).agg(F.array_sort(F.collect_list(item)).alias("items"))
    none = F.slice("items", 1, 0)

    def step(kept: Column, c: Column) -> Column:
        apart = F.forall(kept, lambda k: G.distance(c["x"], c["y"], k["x"], k["y"]) > merge_dist_px)
        return F.when(apart, F.concat(kept, F.array(c))).otherwise(kept)

    kept = frames.select(*KEY, F.explode(F.aggregate("items", none, step)).alias("k")).select(*KEY, "k.cand_ix")
    return candidates.join(kept, [*KEY, "cand_ix"], "left_semi")


def smooth_positions(positions: DataFrame, window: int = 15) -> DataFrame:
    return runs.smooth(positions, ["clip", "track_id"], ["x_m", "y_m"], window)


def smooth_ball(ball: DataFrame, window: int = 15) -> DataFrame:
    """Missing frames break the runs and stay."""
    present = runs.smooth(ball.filter("x_m is not null"), ["clip"], ["x_m", "y_m"], window)
    return present.unionByName(ball.filter("x_m is null"))


def with_speed(ball: DataFrame, fps: float) -> DataFrame:
    """Adds speed in m/s against the frame just before; null after a gap or without a position."""
    w = Window.partitionBy("clip").orderBy("frame")
    px, py, pf = F.lag("x_m").over(w), F.lag("y_m").over(w), F.lag("frame").over(w)
    speed = G.distance(F.col("x_m"), F.col("y_m"), px, py) * fps
    return ball.withColumn("speed", F.when(pf == F.col("frame") - 1, speed))


def with_uncertainty(ball: DataFrame, max_plausible_mps: float = 25.0) -> DataFrame:
    """Adds uncertain, reason and verified. No speed is no evidence; the bound itself is plausible."""
    reasons = [
        F.when(F.col("x_m").isNull(), "no position"),
        F.when(F.col("airborne"), "airborne"),
        F.when(F.col("source") == "interpolated", "interpolated"),
        F.when(~F.col("reliable"), "low-confidence homography"),
        F.when(F.col("speed") > max_plausible_mps, F.concat(F.lit("implausible speed "), F.rint("speed").cast("long").cast("string"), F.lit(" m/s"))),
    ]
    rows = ball.withColumn("reason", F.concat_ws(", ", *reasons)).withColumn("uncertain", F.col("reason") != "")
    return rows.withColumn("verified", (F.col("source") == "detected") & ~F.col("uncertain"))


def radar_frames(positions: DataFrame, ball: DataFrame) -> DataFrame:
    """Every frame that has positions or a ball row."""
    return positions.select(*KEY).union(ball.select(*KEY)).distinct()


def draw_list(positions: DataFrame, ball: DataFrame, labels: DataFrame, kits: DataFrame, scale: float = 10.0, margin: int = 40) -> DataFrame:
    """What a radar shows: kind, pixel position, radius, colour and whether it is filled. Unknown kits are grey."""
    dots = positions.join(labels.select("clip", "track_id", "role", "team"), ["clip", "track_id"], "left")
    dots = dots.join(F.broadcast(kits), ["role", "team"], "left")
    grey = lambda c: F.coalesce(c, F.lit(128))
    px, py = G.to_pixels(F.col("x_m"), scale, margin), G.to_pixels(F.col("y_m"), scale, margin)
    players = dots.select(*KEY, F.lit("player").alias("kind"), px.alias("x_px"), py.alias("y_px"), F.lit(6).alias("radius"), grey("b").alias("b"), grey("g").alias("g"), grey("r").alias("r"), F.lit(True).alias("filled"))
    balls = ball.filter("x_m is not null").select(
        *KEY, F.lit("ball").alias("kind"), px.alias("x_px"), py.alias("y_px"), F.when(F.col("uncertain"), 8).otherwise(4).alias("radius"), F.lit(255).alias("b"), F.lit(255).alias("g"), F.lit(255).alias("r"), (~F.col("uncertain")).alias("filled")
    )
    return players.unionByName(balls)


def display_ids(tracks: DataFrame) -> DataFrame:
    """clip, track_id, display_id: numbered by first appearance."""
    first = tracks.groupBy("clip", "track_id").agg(F.min(F.struct("frame", "row_ix")).alias("first"))
    return first.select("clip", "track_id", F.row_number().over(Window.partitionBy("clip").orderBy("first", "track_id")).cast("long").alias("display_id"))


def render_counters(ball: DataFrame, tracks: DataFrame) -> DataFrame:
    """Ball rows by source, frames that have both, and whether there is none."""
    both = ball.filter("source <> 'missing'").select(*KEY).distinct().join(tracks.select(*KEY).distinct(), KEY, "left_semi").groupBy("clip").agg(F.count(F.lit(1)).alias("overlap"))
    by = ball.groupBy("clip").agg(*[F.count_if(F.col("source") == s).alias(f"n_{s}") for s in ("detected", "interpolated", "missing")])
    return by.join(both, "clip", "left").withColumn("overlap", F.coalesce("overlap", F.lit(0)).cast("long")).withColumn("warn", F.col("overlap") == 0)
