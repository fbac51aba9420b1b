"""Calibration: anchors, homography fits, fusion between anchors, quality and gates."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turfline import config as C
from turfline.functions import geometry as G
from turfline.operators import ball as B
from turfline.operators import pitch as P
from turfline.operators import runs
from turfline.plans.lineage import cut

KEY = ["clip", "frame"]
#: How many frames of most jitter, and clicks of largest residual, a report lists.
WORST_FRAMES, WORST_CLICKS = 5, 3


# --- fits -------------------------------------------------------------------------------------------------------


def dlt(src: np.ndarray, dst: np.ndarray) -> np.ndarray | None:
    """Homography from src to dst by the normalised direct linear transform; None if the points do not determine one."""
    if len(src) < 4 or not (np.isfinite(src).all() and np.isfinite(dst).all()):
        return None

    def normal(p: np.ndarray) -> np.ndarray:
        centre = p.mean(axis=0)
        spread = np.sqrt(((p - centre) ** 2).sum(axis=1)).mean()
        k = math.sqrt(2) / spread if spread > 0 else 1.0
        return np.array([[k, 0, -k * centre[0]], [0, k, -k * centre[1]], [0, 0, 1]])

    ta, tb = normal(src), normal(dst)
    a = np.c_[src, np.ones(len(src))] @ ta.T
    b = np.c_[dst, np.ones(len(dst))] @ tb.T
    zero = np.zeros_like(a)
    rows = np.concatenate((np.c_[a, zero, -b[:, :1] * a], np.c_[zero, a, -b[:, 1:2] * a]))
    _, s, vt = np.linalg.svd(rows)
    if s[7] < 1e-10:
        return None
    h = np.linalg.inv(tb) @ vt[-1].reshape(3, 3) @ ta
    return h / h[2, 2] if abs(h[2, 2]) > 1e-12 and abs(np.linalg.det(h)) > 1e-12 else None


def apply_h(h: np.ndarray, p: np.ndarray) -> np.ndarray:
    q = np.c_[p, np.ones(len(p))] @ h.T
    with np.errstate(divide="ignore", invalid="ignore"):
        return q[:, :2] / q[:, 2:]


def ransac(image: np.ndarray, pitch: np.ndarray, threshold: float = 10.0, rounds: int = 500, seed: int = 0) -> tuple[np.ndarray, np.ndarray, float] | None:
    """Image-to-pitch homography, inlier mask and median inlier error in pixels.

    The threshold counts in the image, so the fit runs from pitch to image and is inverted.
    """
    n = len(image)
    if n < 4 or not (np.isfinite(image).all() and np.isfinite(pitch).all()):
        return None
    rng = np.random.default_rng(seed)
    best, best_key = None, (0, -np.inf)
    for k in range(rounds):
        pick = np.arange(n) if k == 0 else rng.choice(n, 4, replace=False)
        h = dlt(pitch[pick], image[pick])
        if h is None:
            continue
        error = np.linalg.norm(apply_h(h, pitch) - image, axis=1)
        mask = error <= threshold
        key = (int(mask.sum()), -float(error[mask].sum()) if mask.any() else -np.inf)
        if key > best_key:
            best, best_key = mask, key
    if best is None or best.sum() < 4:
        return None
    h = dlt(pitch[best], image[best])
    if h is None:
        return None
    error = np.linalg.norm(apply_h(h, pitch) - image, axis=1)
    mask = error <= threshold
    if mask.sum() < 4 or abs(np.linalg.det(h)) < 1e-12:
        return None
    inverse = np.linalg.inv(h)
    return inverse / inverse[2, 2], mask, float(np.median(error[mask]))


FIT = "clip string, frame long, h array<double>, inliers int, total int, reproj_err_px double, outliers array<int>"


def solve_anchors(points: DataFrame, cfg: C.Calibration = C.Calibration()) -> DataFrame:
    """One homography per labelled frame (null where none fits), with its outliers, worst first. Frames are independent."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pt_ix")
        image, pitch = pdf[["img_x", "img_y"]].to_numpy(float), pdf[["pitch_x", "pitch_y"]].to_numpy(float)
        fit = ransac(image, pitch, cfg.ransac_thresh_px)
        row = {"clip": pdf["clip"].iloc[0], "frame": pdf["frame"].iloc[0], "total": len(pdf), "h": None, "inliers": 0, "reproj_err_px": None, "outliers": []}
        if fit is not None:
            h, _, error = fit
            px = np.linalg.norm(apply_h(np.linalg.inv(h), pitch) - image, axis=1)
            worst = [int(i) for i in np.argsort(-px, kind="stable") if px[i] > cfg.ransac_thresh_px]
            row |= {"h": h.ravel().tolist(), "inliers": int((px <= cfg.ransac_thresh_px).sum()), "reproj_err_px": error, "outliers": worst}
        return pd.DataFrame([row])[["clip", "frame", "h", "inliers", "total", "reproj_err_px", "outliers"]]

    return cut(points.groupBy(*KEY).applyInPandas(solve, FIT))  # used several times over by what follows


def filter_anchor_points(points: DataFrame, drop_phantom: bool = True, drop_excluded: bool = True) -> DataFrame:
    """Points without phantom vertices and excluded ones; a frame left with fewer than four keeps them all."""
    keep: Column = F.lit(True)
    if drop_phantom:
        keep = keep & ~F.coalesce((F.col("vertex") - 1).isin(*P.PHANTOM), F.lit(False))
    if drop_excluded:
        keep = keep & ~F.coalesce(~F.lower("exclude").isin("", "false", "0"), F.lit(False))
    left = F.count_if("keep").over(Window.partitionBy(*KEY))
    return points.withColumn("keep", keep).withColumn("left", left).filter("keep or left < 4").drop("keep", "left")


def upsert_anchor_points(old: DataFrame, new: DataFrame) -> DataFrame:
    """Newly labelled frames replace their old points; other frames stay."""
    return new.unionByName(old.join(new.select(*KEY).distinct(), KEY, "left_anti"))


# --- plausibility -------------------------------------------------------------------------------------------------


def _ring(points: list[Column]) -> tuple[Column, Column]:
    """Area of a polygon (shoelace), and whether it is convex."""
    n = len(points)
    cross = lambda o, a, b: (a["x"] - o["x"]) * (b["y"] - o["y"]) - (a["y"] - o["y"]) * (b["x"] - o["x"])
    area = sum((points[i]["x"] * points[(i + 1) % n]["y"] - points[(i + 1) % n]["x"] * points[i]["y"] for i in range(n)), F.lit(0.0))
    turns = [cross(points[i], points[(i + 1) % n], points[(i + 2) % n]) for i in range(n)]
    left, right = F.lit(True), F.lit(True)
    for t in turns:
        left, right = left & (t > 0), right & (t < 0)
    return F.abs(area) / 2, left | right


def with_plausible(calibration: DataFrame, width: int, height: int, pitch: C.Pitch = C.Pitch()) -> DataFrame:
    """Adds plausible: the pitch's outline is a convex quadrilateral in front of the camera, and the image's corners
    cover a sensible part of the pitch plane."""
    rows = calibration.withColumn("_inv", G.mat_inv(F.col("h")))
    outline = [(0.0, 0.0), (pitch.length, 0.0), (pitch.length, pitch.width), (0.0, pitch.width)]
    corners = [(0.0, 0.0), (float(width), 0.0), (float(width), float(height)), (0.0, float(height))]

    def seen(m: Column, pts: list[tuple[float, float]]) -> tuple[list[Column], Column]:
        w = [G.denominator(m, F.lit(x), F.lit(y)) for x, y in pts]
        front, behind, away = F.lit(True), F.lit(True), F.lit(True)
        for v in w:
            front, behind, away = front & (v > 0), behind & (v < 0), away & (F.abs(v) >= G.EPS)
        return [G.project(m, F.lit(x), F.lit(y)) for x, y in pts], (front | behind) & away

    quad, quad_ok = seen(F.col("_inv"), outline)
    foot, foot_ok = seen(F.col("h"), corners)
    _, convex = _ring(quad)
    area, _ = _ring(foot)
    whole = pitch.length * pitch.width
    plausible = quad_ok & convex & foot_ok & area.between(0.05 * whole, 20 * whole)
    return rows.withColumn("footprint_m2", area).withColumn("plausible", F.coalesce(plausible, F.lit(False))).drop("_inv")


def with_valid(fits: DataFrame, width: int, height: int, cfg: C.Calibration = C.Calibration()) -> DataFrame:
    """Adds valid: enough inliers, little error, plausible."""
    rows = with_plausible(fits, width, height)
    return rows.withColumn("valid", F.coalesce((F.col("inliers") >= cfg.min_inliers) & (F.col("reproj_err_px") <= cfg.max_reproj_px) & F.col("plausible"), F.lit(False)))


# --- between anchors ------------------------------------------------------------------------------------------------


def anchor_neighbours(spine: DataFrame, anchors: DataFrame, cfg: C.Calibration = C.Calibration()) -> DataFrame:
    """clip, frame, prev_anchor, next_anchor, weight, low_confidence: as-of both ways.

    The weight is the frame's place between its anchors by position among the clip's frames; low confidence is more
    than the allowed number of frames from the nearer anchor.
    """
    order = Window.partitionBy("clip").orderBy("frame")
    rows = spine.select(*KEY).join(anchors.select(*KEY, F.col("frame").alias("at")), KEY, "left").withColumn("pos", F.row_number().over(order))
    mark = F.when(F.col("at").isNotNull(), F.struct("frame", "pos"))
    rows = rows.withColumns({"p": runs.carried(mark, ["clip"]), "n": runs.coming(mark, ["clip"])})
    span = F.col("n.pos") - F.col("p.pos")
    weight = F.when(span.isNull(), F.lit(None)).when(span == 0, 0.0).otherwise((F.col("pos") - F.col("p.pos")) / span)
    away = F.least(F.col("frame") - F.col("p.frame"), F.col("n.frame") - F.col("frame"))
    return rows.select(*KEY, F.col("p.frame").alias("prev_anchor"), F.col("n.frame").alias("next_anchor"), weight.alias("weight"), F.coalesce(away > cfg.max_propagated_frames, F.lit(True)).alias("low_confidence"))


def _warp_matrix(prefix: str) -> Column:
    c = lambda n: F.col(prefix + n)
    return F.array(c("cos"), -c("sin"), c("tx"), c("sin"), c("cos"), c("ty"), F.lit(0.0), F.lit(0.0), F.lit(1.0))


def _unwarp_matrix(prefix: str) -> Column:
    """The inverse of a similarity, without the general inverse's many terms."""
    c = lambda n: F.col(prefix + n)
    norm = c("cos") * c("cos") + c("sin") * c("sin")
    a, b = c("cos") / norm, c("sin") / norm
    return F.array(a, b, -(a * c("tx") + b * c("ty")), -b, a, b * c("tx") - a * c("ty"), F.lit(0.0), F.lit(0.0), F.lit(1.0))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _blend(a: pd.Series, b: pd.Series, weight: pd.Series) -> pd.Series:
    """Mixes two homographies where the control points land in the image, and fits anew; else the nearer one."""
    points = np.array(P.control_points())
    out = []
    for ha, hb, w in zip(a, b, weight, strict=True):
        if ha is None or hb is None:
            out.append(hb if ha is None else ha)
            continue
        ma, mb = np.asarray(ha, float).reshape(3, 3), np.asarray(hb, float).reshape(3, 3)
        nearer = mb if w >= 0.5 else ma
        try:
            mixed = (1 - w) * apply_h(np.linalg.inv(ma), points) + w * apply_h(np.linalg.inv(mb), points)
            h = dlt(mixed, points) if np.isfinite(mixed).all() else None
        except np.linalg.LinAlgError:
            h = None
        out.append((nearer if h is None else h).ravel().tolist())
    return pd.Series(out)


def fuse(spine: DataFrame, solved: DataFrame, motion: DataFrame, cfg: C.Calibration = C.Calibration()) -> DataFrame:
    """Calibration of every frame: H_f = H_a W_a W_f^-1 from the anchors either side, cross-faded.

    One set of prefix warps serves every pair of frames. Frames outside all anchors take the single estimate.
    """
    good = solved.filter("h is not null")
    near = anchor_neighbours(spine, good, cfg)
    w = B.cumulative_warps(spine, motion)
    at = good.join(w, KEY).select("clip", F.col("frame").alias("anchor"), G.mat_mul(F.col("h"), _warp_matrix("")).alias("hw"), "h", "inliers", "reproj_err_px")
    rows = near.join(w.select(*KEY, _unwarp_matrix("").alias("inv")), KEY)
    side = lambda name: at.select("clip", F.col("anchor").alias(f"{name}_anchor"), F.col("hw").alias(f"{name}_hw"))
    rows = rows.join(side("prev"), ["clip", "prev_anchor"], "left").join(side("next"), ["clip", "next_anchor"], "left")
    rows = rows.withColumns({"ha": G.mat_mul(F.col("prev_hw"), F.col("inv")), "hb": G.mat_mul(F.col("next_hw"), F.col("inv"))})
    own = at.select("clip", F.col("anchor").alias("frame"), F.col("h").alias("own"), "inliers", "reproj_err_px")
    rows = rows.join(own, KEY, "left").join(motion.select(*KEY, "gmc"), KEY, "left")
    h = F.when(F.col("own").isNotNull(), F.col("own")).when(F.col("ha").isNotNull() & F.col("hb").isNotNull(), _blend(F.col("ha"), F.col("hb"), F.coalesce("weight", F.lit(0.0)))).otherwise(F.coalesce("ha", "hb"))
    eye = F.array(*[F.lit(v) for v in (1.0, 0.0, 0.0, 0.0, 1.0, 0.0)])
    source = F.when(F.col("own").isNotNull(), "solved").when(F.coalesce("ha", "hb").isNotNull(), "propagated").otherwise("none")
    return rows.select(*KEY, h.alias("h"), source.alias("source"), (F.col("low_confidence") | F.coalesce("ha", "hb").isNull()).alias("low_confidence"), F.coalesce("gmc", eye).alias("gmc"), F.coalesce("inliers", F.lit(0)).alias("inliers"), "reproj_err_px")


def served_motion(spine: DataFrame, motion: DataFrame) -> DataFrame:
    """The motion into every frame; the identity where none is known."""
    eye = F.array(*[F.lit(v) for v in (1.0, 0.0, 0.0, 0.0, 1.0, 0.0)])
    return spine.select(*KEY).join(motion.select(*KEY, "gmc"), KEY, "left").withColumn("gmc", F.coalesce("gmc", eye))


# --- quality ------------------------------------------------------------------------------------------------------------


def anchor_quality(points: DataFrame, solved: DataFrame, cfg: C.Calibration = C.Calibration(), pitch: C.Pitch = C.Pitch()) -> DataFrame:
    """clip, frame, n_points, n_inliers, inlier_ratio, median_residual_m, x_min, x_max, reaches_left, reaches_right, end_reach, outlier_indices."""
    rows = points.join(solved.select(*KEY, "h"), KEY, "left")
    p, q = G.project(F.col("h"), F.col("img_x"), F.col("img_y")), G.project(G.mat_inv(F.col("h")), F.col("pitch_x"), F.col("pitch_y"))
    rows = rows.withColumn("m", G.distance(p["x"], p["y"], F.col("pitch_x"), F.col("pitch_y"))).withColumn("px", G.distance(q["x"], q["y"], F.col("img_x"), F.col("img_y")))
    bad = F.col("px") > cfg.ransac_thresh_px
    by = rows.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("n_points"),
        F.count_if(F.col("px").isNotNull() & ~bad).alias("n_inliers"),
        F.median("m").alias("median_residual_m"),
        F.min("pitch_x").alias("x_min"),
        F.max("pitch_x").alias("x_max"),
        F.array_sort(F.collect_list(F.when(bad, F.struct((-F.col("px")).alias("k"), F.col("pt_ix"))))).alias("bad"),
    )
    by = by.withColumns({"inlier_ratio": F.col("n_inliers") / F.col("n_points"), "reaches_left": F.col("x_min") <= cfg.end_zone_m, "reaches_right": F.col("x_max") >= pitch.length - cfg.end_zone_m})
    reach = F.when(F.col("reaches_left") & F.col("reaches_right"), "BOTH").when(F.col("reaches_left"), "LEFT").when(F.col("reaches_right"), "RIGHT").otherwise("neither")
    return by.select(*KEY, "n_points", "n_inliers", "inlier_ratio", "median_residual_m", "x_min", "x_max", "reaches_left", "reaches_right", reach.alias("end_reach"), F.transform("bad", lambda b: b["pt_ix"]).alias("outlier_indices"), F.transform(F.slice("bad", 1, WORST_CLICKS), lambda b: b["pt_ix"]).alias("worst_clicks"))


def jitter(calibration: DataFrame, motion: DataFrame, pitch: C.Pitch = C.Pitch()) -> DataFrame:
    """clip, frame, residual_px: median over the control points of how far they move in the image beyond the camera's
    motion. A frame without a homography breaks the chain."""
    order = Window.partitionBy("clip").orderBy("frame")
    rows = calibration.select(*KEY, G.mat_inv(F.col("h")).alias("inv")).join(motion.select(*KEY, "gmc"), KEY, "left")
    rows = rows.withColumn("m", G.lift(F.col("gmc")))
    before = F.when(F.lag("frame").over(order) == F.col("frame") - 1, F.lag("inv").over(order))
    rows = rows.withColumn("before", before).filter("before is not null and inv is not null")
    apart = lambda p, q: G.distance(p["x"], p["y"], q["x"], q["y"])
    carried = lambda c: G.let(G.project(F.col("before"), c["x"], c["y"]), lambda a: G.project(F.col("m"), a["x"], a["y"]))
    moved = lambda c: G.let(carried(c), lambda p: G.let(G.project(F.col("inv"), c["x"], c["y"]), lambda q: apart(p, q)))
    points = F.array(*[G.point(F.lit(x), F.lit(y)) for x, y in P.control_points(pitch)])
    rows = rows.withColumn("d", F.array_sort(F.transform(points, moved)))
    return rows.select(*KEY, ((F.col("d")[2] + F.col("d")[3]) / 2).alias("residual_px"))


def jitter_summary(residuals: DataFrame, cfg: C.Calibration = C.Calibration()) -> DataFrame:
    """clip, n, median_px, p90_px, max_px, worst_frames (above the noise, worst first)."""
    by = residuals.groupBy("clip").agg(
        F.count(F.lit(1)).alias("n"), F.median("residual_px").alias("median_px"), F.percentile("residual_px", F.lit(0.9)).alias("p90_px"), F.max("residual_px").alias("max_px"),
        F.array_sort(F.collect_list(F.when(F.col("residual_px") > cfg.jitter_noise_px, F.struct((-F.col("residual_px")).alias("k"), F.col("frame"))))).alias("worst"),
    )
    by = by.withColumn("worst_frames", F.transform("worst", lambda w: w["frame"])).drop("worst")
    return by.withColumn("worst_listed", F.slice("worst_frames", 1, WORST_FRAMES))


def anchor_coverage(clips: DataFrame, anchors: DataFrame, max_gap: int = 150) -> DataFrame:
    """clip, severity, message, frame: what is wrong with the spread of a clip's labelled frames.

    Fewer than two anchors, or one past the end, are fatal and hide the advisories on gaps, head and tail.
    """
    order = Window.partitionBy("clip").orderBy("frame")
    rows = anchors.select(*KEY).distinct().withColumn("gap", F.col("frame") - F.lag("frame").over(order))
    gaps = F.array_sort(F.collect_list(F.when(F.col("gap") > max_gap, F.struct(F.col("frame"), F.col("gap")))))
    by = rows.groupBy("clip").agg(F.count(F.lit(1)).alias("n"), F.min("frame").alias("first"), F.max("frame").alias("last"), gaps.alias("gaps"))
    by = clips.select("clip", "frame_count").join(by, "clip", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    note = lambda severity, message, frame: F.array(F.struct(F.lit(severity).alias("severity"), F.lit(message).alias("message"), frame.cast("long").alias("frame")))
    none = F.array().cast("array<struct<severity:string,message:string,frame:bigint>>")
    few = F.when(F.col("n") < 2, note("fatal", "fewer than two anchors", F.col("n"))).otherwise(none)
    past = F.when(F.col("last") >= F.col("frame_count"), note("fatal", "anchor past the end", F.col("last"))).otherwise(none)
    fatal = F.concat(few, past)
    head = F.when(F.col("first") > max_gap, note("advisory", "head", F.col("first"))).otherwise(none)
    tail = F.when(F.col("frame_count") - 1 - F.col("last") > max_gap, note("advisory", "tail", F.col("last"))).otherwise(none)
    wide = F.transform("gaps", lambda g: F.struct(F.lit("advisory").alias("severity"), F.lit("gap").alias("message"), g["frame"].cast("long").alias("frame")))
    said = F.when(F.size(fatal) > 0, fatal).otherwise(F.concat(head, F.coalesce(wide, none), tail))
    return by.select("clip", F.explode(said).alias("s")).select("clip", "s.*")


def suggest_anchors(clips: DataFrame, max_gap: int = 150) -> DataFrame:
    """clip, frame: evenly spread frames no further apart than max_gap; a clip of fewer than two frames is an error."""
    last = F.col("frame_count") - 1
    rows = clips.withColumn("last", F.when(last >= 1, last).otherwise(F.raise_error(F.lit("a clip needs two frames")).cast("long")))
    rows = rows.withColumn("n", F.greatest(F.lit(1), F.ceil(F.col("last") / max_gap)).cast("long"))
    rows = rows.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n"))))
    return rows.select("clip", F.bround(F.col("i") * F.col("last") / F.col("n")).cast("long").alias("frame"))


def calibration_metrics(calibration: DataFrame) -> DataFrame:
    """clip, frames, solved, propagated, uncalibrated, low_confidence, median_inliers, median_reproj_px."""
    solved = F.col("source") == "solved"
    return calibration.groupBy("clip").agg(
        F.count(F.lit(1)).alias("frames"), F.count_if(solved).alias("solved"), F.count_if(F.col("source") == "propagated").alias("propagated"), F.count_if(F.col("source") == "none").alias("uncalibrated"),
        F.count_if("low_confidence").alias("low_confidence"), F.median(F.when(solved, F.col("inliers"))).alias("median_inliers"), F.median(F.when(solved, F.col("reproj_err_px"))).alias("median_reproj_px"),
    )


# --- the held-out gate -----------------------------------------------------------------------------------------------------


def holdout_errors(points: DataFrame, solved: DataFrame, motion: DataFrame, spine: DataFrame, cfg: C.Calibration = C.Calibration()) -> DataFrame:
    """Leave one anchor out: each anchor but the first is predicted from the anchors beside it, the last one-way.

    clip, held_frame, seeded_from, fused_with, pt_ix, error_px, error_m, pitch_x. Nothing is solved anew: the
    neighbours' own fits are carried by the prefix warps to the held frame and mixed there.
    """
    order = Window.partitionBy("clip").orderBy("frame")
    labelled = points.select(*KEY).distinct()
    fits = labelled.join(solved.select(*KEY, "h"), KEY, "left").join(B.cumulative_warps(spine, motion), KEY)
    fits = fits.withColumn("hw", F.when(F.col("h").isNotNull(), G.mat_mul(F.col("h"), _warp_matrix(""))))
    fits = fits.withColumns({"prev": F.lag("frame").over(order), "next": F.lead("frame").over(order), "hw_prev": F.lag("hw").over(order), "hw_next": F.lead("hw").over(order)})
    held = fits.filter("prev is not null")
    inv = _unwarp_matrix("")
    held = held.withColumns({"ha": G.mat_mul(F.col("hw_prev"), inv), "hb": G.mat_mul(F.col("hw_next"), inv), "w": (F.col("frame") - F.col("prev")) / (F.coalesce("next", F.col("frame")) - F.col("prev"))})
    h = F.when(F.col("ha").isNotNull() & F.col("hb").isNotNull(), _blend(F.col("ha"), F.col("hb"), F.col("w"))).otherwise(F.coalesce("ha", "hb"))
    held = held.select("clip", F.col("frame"), "prev", "next", h.alias("h"))
    rows = points.join(held, KEY)
    p, q = G.project(F.col("h"), F.col("img_x"), F.col("img_y")), G.project(G.mat_inv(F.col("h")), F.col("pitch_x"), F.col("pitch_y"))
    return rows.select(
        "clip", F.col("frame").alias("held_frame"), F.col("prev").alias("seeded_from"), F.col("next").alias("fused_with"), "pt_ix",
        G.distance(q["x"], q["y"], F.col("img_x"), F.col("img_y")).alias("error_px"), G.distance(p["x"], p["y"], F.col("pitch_x"), F.col("pitch_y")).alias("error_m"), F.col("pitch_x"),
    )


def region_breakdown(errors: DataFrame, pitch_length: float = 105.0) -> DataFrame:
    """clip, region, n, median_m, p90_m of the thirds of the pitch by labelled x; every third has a row."""
    x = F.col("pitch_x")
    region = F.when(x < pitch_length / 3, "near_third").when(x < 2 * pitch_length / 3, "middle_third").otherwise("far_third")
    by = errors.groupBy("clip", region.alias("region")).agg(F.count(F.lit(1)).alias("n"), F.median("error_m").alias("median_m"), F.percentile("error_m", F.lit(0.9)).alias("p90_m"))
    names = F.explode(F.array(*[F.lit(r) for r in ("near_third", "middle_third", "far_third")]))
    every = errors.select("clip").distinct().select("clip", names.alias("region"))
    return every.join(by, ["clip", "region"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))


def holdout_summary(errors: DataFrame) -> DataFrame:
    """clip, points, anchors, median_m, p90_m, median_px, p90_px."""
    p90 = lambda c: F.percentile(c, F.lit(0.9))
    return errors.groupBy("clip").agg(
        F.count(F.lit(1)).alias("points"), F.count_distinct("held_frame").alias("anchors"), F.median("error_m").alias("median_m"), p90("error_m").alias("p90_m"), F.median("error_px").alias("median_px"), p90("error_px").alias("p90_px")
    )


def holdout_by_anchor(errors: DataFrame) -> DataFrame:
    """clip, held_frame, seeded_from, fused_with, points, median_m, p90_m, median_px: one row per held-out anchor."""
    return errors.groupBy("clip", "held_frame", "seeded_from", "fused_with").agg(
        F.count(F.lit(1)).alias("points"), F.median("error_m").alias("median_m"), F.percentile("error_m", F.lit(0.9)).alias("p90_m"), F.median("error_px").alias("median_px")
    )


def anchor_gaps(anchors: DataFrame) -> DataFrame:
    """clip, frame, gap: frames from each labelled frame to the one before it; the first has none."""
    order = Window.partitionBy("clip").orderBy("frame")
    return anchors.select(*KEY).distinct().select(*KEY, (F.col("frame") - F.lag("frame").over(order)).alias("gap"))


def provenance_block(clips: DataFrame, anchors: DataFrame, sources: DataFrame) -> DataFrame:
    """clip, video, anchors, anchors_sha256_12, clip_frame_count, anchor_frames, anchor_gaps: what a calibration was made of.

    `sources` has clip, video, anchors and fingerprint. A clip without anchors has empty lists.
    """
    listed = F.array_sort(F.collect_list(F.struct("frame", "gap")))
    by = anchor_gaps(anchors).groupBy("clip").agg(listed.alias("g"))
    rows = clips.select("clip", "frame_count").join(sources, "clip").join(by, "clip", "left")
    frames = F.coalesce(F.transform("g", lambda x: x["frame"]), F.array().cast("array<long>"))
    gaps = F.coalesce(F.transform(F.filter("g", lambda x: x["gap"].isNotNull()), lambda x: x["gap"]), F.array().cast("array<long>"))
    return rows.select("clip", "video", "anchors", F.col("fingerprint").alias("anchors_sha256_12"), F.col("frame_count").alias("clip_frame_count"), frames.alias("anchor_frames"), gaps.alias("anchor_gaps"))


def check_gate(summary: DataFrame, gate_median_m: float | None) -> DataFrame:
    """clip, failure: medians that are not finite fail, as do those above the gate; equality passes; no gate, no failure."""
    if gate_median_m is None:
        return summary.select("clip", F.lit(None).cast("string").alias("failure")).limit(0)
    m = F.col("median_m")
    bad = m.isNull() | F.isnan(m) | (F.abs(m) == float("inf"))
    failure = F.when(bad, "the held-out median is not finite").when(m > gate_median_m, F.format_string("the held-out median %.3f m is above the gate", m))
    return summary.select("clip", failure.alias("failure")).filter("failure is not null")
