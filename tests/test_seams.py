import io
import itertools
import math

import numpy as np
import pytest
import yaml
from pyspark.sql import functions as F
from turfline import config as C
from turfline.operators import pitch as P
from turfline.operators import video as V
from turfline.plans import guards, stages
from turfline.sources import detectors, files
from turfline.streaming import stateful, tracker


def test_crop_is_found_or_configured(spark):
    clips = spark.createDataFrame([("a", 100, 50), ("b", 100, 50)], "clip string, width int, height int")
    dark = spark.createDataFrame([("a", axis, i, 0.0 if i < (3 if axis == "row" else 0) or i > 46 and axis == "row" else 90.0) for axis, n in (("row", 50), ("column", 100)) for i in range(n)], "clip string, axis string, ix long, mean double")
    found = {r.clip: (r.crop_top, r.crop_bottom, r.crop_left, r.crop_right, r.crop_w, r.crop_h) for r in V.resolve_crop(clips, dark).collect()}
    assert found == {"a": (3, 3, 0, 0, 100, 44), "b": (0, 0, 0, 0, 100, 50)}
    manual = V.resolve_crop(clips, io=C.IO(auto_letterbox=False, crop_top=5, crop_left=10))
    boxes = spark.createDataFrame([("a", 20.0, 20.0, 30.0, 40.0)], "clip string, x1 double, y1 double, x2 double, y2 double")
    assert [tuple(r) for r in V.shift_into_crop(boxes, manual).collect()] == [("a", 10.0, 15.0, 20.0, 35.0)]
    with pytest.raises(Exception, match="leaves nothing"):
        V.resolve_crop(clips, io=C.IO(auto_letterbox=False, crop_top=25, crop_bottom=25)).collect()


def test_arcs_lie_beyond_the_boxes(spark):
    rows = P.polylines(spark).collect()
    arcs = [r for r in rows if r.kind == "arc"]
    assert len({r.line for r in rows}) == len(P.EDGES) + 3 and len(arcs) == 24
    assert all(r.x_m >= 16.5 - 1e-9 or r.x_m <= 105 and r.x_m >= 105 - 16.5 - 9.15 for r in arcs)
    assert {round(math.dist((r.x_m, r.y_m), (11 if r.x_m < 52 else 94, 34)), 6) for r in arcs} == {9.15}


def test_outline_keeps_one_side_of_the_horizon(spark):
    flat, tilted = ([1.0, 0.0, 0.0, 0.0, 1.0, 0.0, t, 0.0, 1.0] for t in (0.0, 0.02))
    table = spark.createDataFrame([("c", 0, flat), ("c", 1, tilted), ("c", 2, None)], "clip string, frame long, h array<double>")
    n = {r.frame: r.n for r in P.outline_in_image(table).groupBy("frame").agg(F.count("*").alias("n")).collect()}
    assert n[0] == 2 * (107 + 70) and 3 <= n[1] < n[0] and 2 not in n


def test_scaffold_loads_as_it_was(tmp_path):
    text = guards.scaffold()
    assert C.from_mapping(yaml.safe_load(text)) == C.Config()
    other = C.from_mapping({"pitch": {"length": 104.0}, "io": {"auto_letterbox": False}})
    assert C.from_mapping(yaml.safe_load(guards.scaffold(other))) == other


def test_guards(spark, tmp_path):
    assert guards.require_file(spark, str(tmp_path)) == str(tmp_path)
    with pytest.raises(FileNotFoundError):
        guards.require_file(spark, str(tmp_path / "none"))
    expected = spark.createDataFrame([("a", "x"), ("b", None), ("c", "z")], "clip string, fingerprint string")
    found = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "q")], "clip string, fingerprint string")
    assert guards.require_provenance(files.verify_fingerprints(found, expected.filter("clip <> 'c'"))) == ["b"]
    with pytest.raises(ValueError, match="c: fatal"):
        guards.require_provenance(files.verify_fingerprints(found, expected))


def test_registry_is_complete():
    functions = {s.name: print for s in stages.STAGES}
    stages.check_registry(functions)
    with pytest.raises(ValueError, match="without a function"):
        stages.check_registry({k: v for k, v in functions.items() if k != "gate"})
    with pytest.raises(ValueError, match="no stage"):
        stages.check_registry(functions | {"other": print})
    assert all("external:ball_weights" not in s.inputs for s in stages.build_stages(False)) and stages.build_stages() == stages.STAGES


def test_detector_seam():
    d = detectors.Detector("x", imgsz=1280, conf=0.25, ball_conf=0.5)
    assert d.reconfigured(conf=0.1) == detectors.Detector("x", 1280, 0.1, 0.5)
    assert d.reconfigured(ball_conf=None).ball_conf is None and d.reconfigured() == d
    assert [detectors.resolve_device(*a) for a in (("cpu",), ("auto", ("mps",)), ("auto", ("mps", "cuda")), ("auto",))] == ["cpu", "mps", "cuda", "cpu"]


def test_calibration_archive(spark, tmp_path):
    (tmp_path / "clip7").mkdir()
    h = np.stack([np.eye(3), np.full((3, 3), np.nan)])
    arrays = {"frame_idx": np.array([0, 1]), "H": h, "gmc": np.zeros((2, 2, 3)), "source": np.array([1, 0]), "low_confidence": np.array([False, True]), "inliers": np.array([9, 0]), "reproj_err_px": np.array([0.5, np.nan])}
    out = io.BytesIO()
    np.savez_compressed(out, **arrays, frame_shape=np.array([720, 1280]))
    (tmp_path / "clip7" / "calibration.npz").write_bytes(out.getvalue())
    rows = files.read_calibration_archive(spark, f"{tmp_path}/*/calibration.npz").orderBy("frame").collect()
    assert [(r.clip, r.frame, r.h, r.source, r.low_confidence, r.inliers) for r in rows] == [("clip7", 0, np.eye(3).ravel().tolist(), "solved", False, 9), ("clip7", 1, None, "none", True, 0)]
    assert [tuple(r) for r in files.read_frame_shape(spark, f"{tmp_path}/*/calibration.npz").collect()] == [("clip7", 720, 1280)]
    np.savez_compressed(tmp_path / "clip7" / "calibration.npz", **arrays)
    assert [tuple(r) for r in files.read_frame_shape(spark, f"{tmp_path}/*/calibration.npz").collect()] == [("clip7", None, None)]


def test_last_line_of_a_frame_counts(spark, tmp_path):
    path = tmp_path / "ball.csv"
    path.write_text("frame,x,y,source,airborne,confidence\n0,1.00,1.00,detected,0,0.500\n1,,3.00,missing,0,0.000\n0,2.00,2.00,detected,1,0.600\n")
    assert sorted((r.frame, r.x, r.airborne) for r in files.read_ball(spark, str(path), "c").collect()) == [(0, 2.0, True), (1, None, False)]


def test_players_are_filtered_before_they_are_tracked(spark):
    rows = [("c", f, k, x, 30.0, x + 4, 40.0, conf, cls) for f in range(6) for k, (x, conf, cls) in enumerate(((50.0 + f, 0.9, 2), (50.0 + f, 0.05, 2), (300.0, 0.9, 2), (60.0, 0.9, 0))) if f != 3]
    found = spark.createDataFrame(rows, "clip string, frame long, det_ix int, x1 double, y1 double, x2 double, y2 double, confidence double, class_id int")
    spine = spark.createDataFrame([("c", f) for f in range(6)], "clip string, frame long")
    calibration = spine.select("*", F.array(*[F.lit(float(i in (0, 4, 8))) for i in range(9)]).alias("h"), F.lit(False).alias("low_confidence"))
    motion = spine.withColumn("gmc", F.lit(None).cast("array<double>"))
    out = tracker.track_players(found, spine, calibration, motion).collect()
    assert sorted((r.frame, r.track_id, r.x1) for r in out) == [(f, 1, 50.0 + f) for f in (0, 1, 2, 4, 5)]


def test_ball_is_looked_for_where_it_is_expected(spark):
    rows = [("c", f, 0, 100.0 + 5 * f if f < 4 else None, 80.0 if f < 4 else None, 10.0, 10.0, 0.8) for f in range(8)]
    table = spark.createDataFrame(rows, "clip string, frame long, cand_ix int, x double, y double, w double, h_px double, confidence double").withColumns({"gmc": F.lit(None).cast("array<double>"), "h": F.lit(None).cast("array<double>")})

    def look(clip, frame, x0, y0, size):
        x, y = 100.0 + 5 * frame - x0, 80.0 - y0
        return [(x - 5, y - 5, x + 5, y + 5, 0.3), (x - 100, y - 100, x + 100, y + 100, 0.9)] if 0 <= x < size and 0 <= y < size else []

    out = stateful.observe_ball(table, look, 640, 360, C.Ball(roi_size=64)).orderBy("frame").collect()
    assert [(r.frame, r.x, r.source) for r in out] == [(f, 100.0 + 5 * f, "full" if f < 4 else "roi") for f in range(8)]


def test_matching_solves_linked_boxes_alone(monkeypatch):
    """As many pairs as can be, of least distance; boxes that nothing links take no part in each other's assignment."""
    rng = np.random.default_rng(2)
    sizes, assign = [], tracker.assign
    monkeypatch.setattr(tracker, "assign", lambda cost: sizes.append(len(cost)) or assign(cost))
    apart = np.array([[100.0 * k, 0, 100.0 * k + 10, 10] for k in range(60)])
    assert tracker.match(apart, apart[::3] + 1, 0.8) == [(3 * k, k) for k in range(20)] and max(sizes, default=0) <= 2
    for _ in range(40):
        corner = rng.random((8, 2)) * 20
        a, b = np.split(np.hstack([corner, corner + 4 + rng.random((8, 2)) * 6]), 2)
        distance = 1 - tracker.overlap(a, b)
        best = min(((-len(p := [(i, j) for i, j in enumerate(order) if distance[i, j] <= 0.8]), sum(distance[i, j] for i, j in p), p) for order in itertools.permutations(range(4))), key=lambda x: x[:2])
        assert sorted(tracker.match(a, b, 0.8)) == best[2]
    tracks = tracker.Tracks(C.Tracking())
    tracks.step(apart, np.full(60, 0.9))
    tracks.move(np.array([[1.0, 0, 5], [0, 1, 0]]))
    again = tracker.Tracks(C.Tracking(), tracks.pack())
    assert again.pack() == tracks.pack() and again.step(apart[:2] + 4, np.full(2, 0.9)) == [1, 2]


def test_outline_is_dealt_out_and_computed_once(spark):
    h = [0.2, 0.001, 0.5, 0.0, 0.7, 0.3, 0.0, 0.0, 1.0]
    rows = spark.createDataFrame([("c", f, h) for f in range(200)], "clip string, frame long, h array<double>").coalesce(1)
    out = P.outline_in_image(rows, 3.0, 40.0)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert out.count() == 2000 and plan.count("sort_array") + plan.count("array_sort(transform") == 1
    assert out.select(F.spark_partition_id()).distinct().count() > 1
