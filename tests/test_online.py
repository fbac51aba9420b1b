import numpy as np
import pytest
from pyspark.sql import functions as F
from turfline.plans import guards
from turfline.sources import detectors
from turfline.streaming import tracker

SCHEMA = "clip string, frame long, det_ix int, x1 double, y1 double, x2 double, y2 double, confidence double, class_id int, gmc array<double>"


def walk(frames=30):
    rows = []
    for f in range(frames):
        for k, (x, conf) in enumerate(((10.0 + f, 0.9), (200.0 - f, 0.3 if f % 5 == 4 else 0.8))):
            if not (k == 0 and 10 <= f < 13):
                rows.append(("c", f, k, x, 50.0, x + 20, 90.0, conf, 2, None))
    return rows


def test_tracks_keep_their_ids(spark):
    rows = tracker.track(spark.createDataFrame(walk(), SCHEMA)).collect()
    left, right = {r.track_id for r in rows if r.x1 < 100}, {r.track_id for r in rows if r.x1 > 150}
    assert left == {1} and right == {2}


def test_tracks_follow_the_camera(spark):
    rows = [("c", f, 0, 10.0 + 30 * f, 50.0, 30.0 + 30 * f, 90.0, 0.9, 2, [1.0, 0.0, 30.0, 0.0, 1.0, 0.0] if f else None) for f in range(5)]
    assert {r.track_id for r in tracker.track(spark.createDataFrame(rows, SCHEMA)).collect()} == {1}
    still = spark.createDataFrame(rows, SCHEMA).withColumn("gmc", F.lit(None).cast("array<double>"))
    assert len({r.track_id for r in tracker.track(still).collect()}) == 5


def test_stream_equals_batch(spark, tmp_path):
    table = spark.createDataFrame(walk(), SCHEMA)
    for k in range(3):
        table.filter(f"frame >= {10 * k} and frame < {10 * k + 10}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        run = tracker.track(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        run.awaitTermination()
    order = ["frame", "row_ix"]
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).orderBy(*order).collect()] == [tuple(r) for r in tracker.track(table).orderBy(*order).collect()]


def test_overlap():
    a = np.array([[0, 0, 2, 2.0]])
    assert tracker.overlap(a, np.array([[1, 1, 3, 3.0], [5, 5, 6, 6], [0, 0, 2, 2]]))[0].tolist() == pytest.approx([1 / 7, 0, 1])


def test_detector_seam(spark):
    @detectors.register("constant")
    def constant(confidence):
        return lambda pdf: pdf.assign(det_ix=0, x1=1.0, y1=2.0, x2=3.0, y2=4.0, confidence=confidence, name="player")

    rows = detectors.detect(spark.createDataFrame([("c", 1), ("c", 2)], "clip string, frame long"), "constant", confidence=0.5).collect()
    assert [(r.frame, r.confidence) for r in rows] == [(1, 0.5), (2, 0.5)]
    with pytest.raises(ValueError):
        detectors.detect(spark.range(1), "nothing")


def test_guards(spark):
    with pytest.raises(ValueError):
        guards.require_rows(spark.range(0), "positions")
    with pytest.raises(ValueError):
        guards.require_stride_one(2)
    clips = spark.createDataFrame([("a", 25.0), ("b", 50.0)], "clip string, fps double")
    with pytest.raises(ValueError, match="b"):
        guards.require_fps(clips, 25.0)
    assert guards.checklist(spark.createDataFrame([("x",)], "file string"), ("x", "y")).filter("not done").count() == 1
