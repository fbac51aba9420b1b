"""Identities, teams, calibration, plans, formats."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from turfline import config as C
from turfline.functions import colour, geometry
from turfline.operators import calibration as Q
from turfline.operators import pitch, stitch, teams, video
from turfline.plans import stages
from turfline.sources import files
from turfline.streaming import stateful

RNG = random.Random(11)


def test_config():
    assert C.from_mapping(None) == C.Config()
    assert C.from_mapping({"ball": {"max_gap": 5}}).ball.max_gap == 5
    for bad in ({"pitch": {"length": 90}}, {"io": {"crop_top": -1}}, {"nothing": {}}):
        with pytest.raises(ValueError):
            C.from_mapping(bad)


def test_projection_guards(spark):
    h = F.array(*[F.lit(v) for v in (0.1, 0.0, 0.0, 0.0, 0.1, 0.0, 0.01, 0.0, 1.0)])
    row = spark.range(1).select(geometry.project(h, F.lit(500.0), F.lit(300.0)).alias("p"), geometry.project(h, F.lit(-100.0), F.lit(0.0)).alias("q")).first()
    assert (row.p.x, row.p.y) == pytest.approx((50 / 6, 30 / 6)) and row.q.x is None


def test_matrices(spark):
    m = np.array([[1.2, 0.1, 5], [-0.2, 0.9, -3], [0.001, 0.002, 1]])
    c = F.array(*[F.lit(float(v)) for v in m.ravel()])
    row = spark.range(1).select(geometry.mat_inv(c).alias("i"), geometry.mat_mul(c, geometry.mat_inv(c)).alias("e"), geometry.mat_inv(geometry.mat_mul(F.array(*[F.lit(0.0)] * 9), c)).alias("n")).first()
    assert row.i == pytest.approx(np.linalg.inv(m).ravel().tolist()) and row.e == pytest.approx(np.eye(3).ravel().tolist(), abs=1e-9) and row.n is None


def pieces(spark, rows):
    """id, role, first, last, head, tail, v, n, confidence"""
    flat = [("c", i, role, a, b, *map(float, (*head, *tail, *v)), n, conf) for i, role, a, b, head, tail, v, n, conf in rows]
    return spark.createDataFrame(flat, "clip string, track_id long, role string, first_frame long, last_frame long, head_x double, head_y double, tail_x double, tail_y double, vx double, vy double, n_frames long, role_confidence double")


def slow_cost(a, b, fps, cfg):
    if a[0] == b[0]:
        return None
    penalty = 0.0
    if a[1] != b[1]:
        if min(a[8], b[8]) >= cfg.role_trust_conf:
            return None
        penalty = cfg.w_role_mismatch
    if b[2] < a[3] - geometry.frames_for(cfg.overlap_tolerance_s, fps):
        return None
    dt = max(1, b[2] - a[3]) / fps
    if dt > cfg.max_gap_s or (min(a[7], b[7]) < geometry.frames_for(cfg.min_tracklet_s, fps) and dt > cfg.short_fragment_max_gap_s):
        return None
    reach = cfg.v_max_ms * dt + cfg.pos_sigma_m
    if math.dist(a[5], b[4]) > reach:
        return None
    miss = math.dist(b[4], (a[5][0] + a[6][0] * dt, a[5][1] + a[6][1] * dt))
    return cfg.w_pos * miss / reach + cfg.w_time * dt / cfg.max_gap_s + penalty


def random_pieces(n):
    out = []
    for i in range(n):
        a = RNG.randrange(400)
        b = a + RNG.randrange(1, 120)
        out.append((i, RNG.choice(["team_a", "team_b"]), a, b, (RNG.uniform(0, 40), RNG.uniform(0, 30)), (RNG.uniform(0, 40), RNG.uniform(0, 30)), (RNG.gauss(0, 2), RNG.gauss(0, 2)), RNG.choice([1, 2, 3, 50]), RNG.choice([0.5, 0.9, 1.0])))
    return out


@pytest.mark.parametrize("fps", [25.0, 60.0])
def test_links_equal_all_pairs(spark, fps):
    rows = random_pieces(60)
    want = {(a[0], b[0]): c for a in rows for b in rows if (c := slow_cost(a, b, fps, C.Stitch())) is not None}
    got = {(r.a, r.b): r.cost for r in stitch.link_candidates(pieces(spark, rows), fps).collect()}
    assert got == pytest.approx(want) and want


def test_assignment_equals_brute_force():
    rng = np.random.default_rng(5)
    for n in range(1, 7):
        for _ in range(10):
            cost = rng.random((n, n)) * np.where(rng.random((n, n)) < 0.3, 1e6, 1)
            best = min(sum(cost[i, p[i]] for i in range(n)) for p in itertools.permutations(range(n)))
            picked = stitch.assign(cost)
            assert sorted(picked) == list(range(n)) and sum(cost[i, j] for i, j in enumerate(picked)) == pytest.approx(best)


def test_stitch_chain(spark):
    rows = [(1, "team_a", 0, 100, (0, 0), (10.0, 0.0), (5.0, 0.0), 101, 1.0), (2, "team_a", 110, 200, (10.8, 0.0), (20.0, 0.0), (5.0, 0.0), 91, 1.0), (3, "team_a", 206, 260, (20.5, 0.0), (30.0, 0.0), (5.0, 0.0), 55, 1.0), (4, "team_b", 110, 200, (10.8, 0.0), (20.0, 0.0), (5.0, 0.0), 91, 1.0)]
    table = pieces(spark, rows)
    links = stitch.solve_links(table, stitch.link_candidates(table, 60.0))
    roots = {r.old_id: r.new_id for r in stitch.chain_roots(table, links).collect()}
    assert roots == {1: 1, 2: 1, 3: 1, 4: 4}


def test_roots_of_a_cycle(spark):
    table = pieces(spark, [(i, "team_a", 0, 1, (0, 0), (0, 0), (0, 0), 2, 1.0) for i in range(1, 6)])
    links = spark.createDataFrame([("c", 1, 2), ("c", 2, 1), ("c", 4, 5)], "clip string, a long, b long")
    assert {r.old_id: r.new_id for r in stitch.chain_roots(table, links).collect()} == {1: 2, 2: 1, 3: 3, 4: 4, 5: 4}


def test_roster(spark):
    table = pieces(spark, [(i, "team_a", 0 if i < 3 else 11, 10 if i < 3 else 20, (0, 0), (0, 0), (0, 0), 2, 1.0) for i in range(1, 6)] + [(9, "unknown", 0, 20, (0, 0), (0, 0), (0, 0), 2, 1.0)])
    same = spark.createDataFrame([("c", i, i) for i in range(1, 6)], "clip string, old_id long, new_id long")
    assert [(r.role, r.overflow) for r in stitch.roster_overflow(table, same, 2).collect()] == [("team_a", 1)]
    assert stitch.roster_overflow(table, same, 3).count() == 0


def observations(spark, rows):
    return spark.createDataFrame([("c", i, *map(float, lab), 20, 100, zone, 100, {int(k): int(v) for k, v in counts.items()}) for i, lab, zone, counts in rows], "clip string, track_id long, l double, a double, b double, n_samples long, n_frames long, goal_zone_fraction double, zone_frames long, class_counts map<int,bigint>")


def test_palette_finds_kits_keepers_referees(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal((120, 190, 160), 3), 0.1, {2: 100}) for i in range(10)] + [(10 + i, rng.normal((225, 128, 128), 3), 0.1, {2: 100}) for i in range(10)]
    rows += [(30, (60, 90, 200), 0.95, {1: 80, 2: 20}), (31, (180, 60, 60), 0.9, {1: 90, 2: 10})] + [(40 + i, rng.normal((25, 128, 128), 2), 0.1, {3: 100}) for i in range(2)]
    found = teams.fit_palette(observations(spark, rows)).orderBy("target_ix").collect()
    assert sorted(r.role for r in found) == ["goalkeeper", "goalkeeper", "referee", "team_a", "team_b"]
    by = {r.role: (r.l, r.a, r.b) for r in found if r.role != "goalkeeper"}
    assert by["team_a"] == pytest.approx((120, 190, 160), abs=4) and by["team_b"] == pytest.approx((225, 128, 128), abs=4) and by["referee"] == pytest.approx((25, 128, 128), abs=4)


def test_average_linkage():
    x = np.array([[0, 0, 0], [1, 0, 0], [10, 0, 0], [11, 0, 0], [50, 0, 0]], float)
    assert teams.average_linkage(x, 5.0) == [0, 0, 1, 1, 2] and len(set(teams.average_linkage(x, 100.0))) == 1


def test_votes(spark):
    palette = spark.createDataFrame([("c", 0, "team_a", 0, 0.0, 0.0, 0.0), ("c", 1, "team_b", 1, 100.0, 0.0, 0.0), ("c", 2, "referee", -1, 0.0, 100.0, 0.0)], "clip string, target_ix int, role string, team int, l double, a double, b double")
    rows = [("c", 1, s, 1.0, 0.0, 0.0) for s in range(3)] + [("c", 1, 9, 50.0, 0.0, 0.0), ("c", 1, 10, None, None, None)]
    rows += [("c", 2, 0, 99.0, 0.0, 0.0), ("c", 2, 1, 1.0, 0.0, 0.0), ("c", 2, 2, 99.0, 0.0, 0.0), ("c", 2, 3, 1.0, 0.0, 0.0)] + [("c", 3, s, 0.0, 99.0, 0.0) for s in range(4)] + [("c", 4, 0, None, None, None)]
    samples = spark.createDataFrame(rows, "clip string, track_id long, seq long, l double, a double, b double")
    life = spark.createDataFrame([("c", t, 100) for t in range(5)], "clip string, track_id long, n_frames long")
    found = {r.track_id: (r.role, r.team, r.confidence, r.n_samples, r.n_rejected) for r in teams.vote_labels(samples, palette, life).collect()}
    assert found == {1: ("team_a", 0, 1.0, 3, 2), 2: ("team_b", 1, 0.5, 4, 0), 3: ("unknown", -1, 0.0, 4, 0), 4: ("unknown", -1, 0.0, 0, 1)}


H = np.array([[0.09, 0.01, -5], [0.002, 0.13, -8], [0.00001, 0.0004, 1.0]])


def anchor_points(spark, noise=0.0, bad=()):
    rng = np.random.default_rng(2)
    rows = []
    for v, x, y in pitch.vertices()[:20]:
        image = Q.apply_h(np.linalg.inv(H), np.array([[x, y]]))[0] + rng.normal(0, noise, 2) + (60 if v in bad else 0)
        rows.append(("c", 0, v - 1, *map(float, image), x, y, v, None))
    return spark.createDataFrame(rows, "clip string, frame long, pt_ix int, img_x double, img_y double, pitch_x double, pitch_y double, vertex int, exclude string")


def test_homography_is_recovered(spark):
    points = anchor_points(spark, 0.2, bad=(3, 15))
    fit = Q.solve_anchors(points).first()
    assert fit.inliers == 18 and sorted(fit.outliers) == [2, 14]
    p = Q.apply_h(np.array(fit.h).reshape(3, 3), np.array([[640.0, 360.0]]))
    assert p[0].tolist() == pytest.approx(Q.apply_h(H, np.array([[640.0, 360.0]]))[0].tolist(), abs=0.3)
    quality = Q.anchor_quality(points, Q.solve_anchors(points)).first()
    assert (quality.n_points, quality.n_inliers, quality.end_reach) == (20, 18, "LEFT")


def test_dlt_rejects_degenerate_points():
    line = np.array([[0, 0], [1, 1], [2, 2], [3, 3.0]])
    assert Q.dlt(line, line) is None and Q.dlt(line[:3], line[:3]) is None
    assert Q.ransac(line * np.nan, line) is None


def test_anchor_filter_falls_back(spark):
    points = anchor_points(spark)
    assert Q.filter_anchor_points(points).count() == 20 - 4
    few = points.filter("pt_ix < 12 and pt_ix >= 8")
    assert Q.filter_anchor_points(few).count() == 4


def test_fusion_follows_the_camera(spark):
    spine = spark.createDataFrame([("c", f) for f in range(21)], "clip string, frame long")
    motion = spark.createDataFrame([("c", f, [1.0, 0.0, 2.0, 0.0, 1.0, -1.0]) for f in range(21)], "clip string, frame long, gmc array<double>")
    at = {f: H @ np.linalg.inv(np.array([[1, 0, 2.0 * f], [0, 1, -1.0 * f], [0, 0, 1]])) for f in (5, 15)}
    solved = spark.createDataFrame([("c", f, (h / h[2, 2]).ravel().tolist(), 8, 0.5) for f, h in at.items()], "clip string, frame long, h array<double>, inliers int, reproj_err_px double")
    rows = Q.fuse(spine, solved, motion, C.Calibration(max_propagated_frames=4)).orderBy("frame").collect()
    for r in rows:
        truth = H @ np.linalg.inv(np.array([[1, 0, 2.0 * r.frame], [0, 1, -1.0 * r.frame], [0, 0, 1]]))
        assert np.array(r.h) / r.h[8] == pytest.approx((truth / truth[2, 2]).ravel(), abs=1e-6)
        assert r.source == ("solved" if r.frame in (5, 15) else "propagated")
        assert r.low_confidence == (min(abs(r.frame - 5), abs(r.frame - 15)) > 4)


def test_gate(spark):
    rows = spark.createDataFrame([("a", 0.4), ("b", 0.5), ("c", 0.51), ("d", float("nan")), ("e", None)], "clip string, median_m double")
    assert {r.clip for r in Q.check_gate(rows, 0.5).collect()} == {"c", "d", "e"} and Q.check_gate(rows, None).count() == 0


def test_stage_run(spark, tmp_path):
    root = str(tmp_path / "stages")
    one = {n: (lambda s, _: {"t": s.range(3)}) for n in ("x", "y", "z")}
    assert stages.run(spark, root, one, ["x", "y", "z"]) == ["x", "y", "z"]
    assert stages.run(spark, root, one, ["x", "y", "z"]) == []
    assert stages.run(spark, root, one, ["x", "y", "z"], "y") == ["y", "z"]
    with pytest.raises(ValueError):
        stages.run(spark, root, one, ["x"], "nothing")


def test_files_round_trip(spark, tmp_path):
    at = lambda n: str(tmp_path / n)
    tracks = spark.createDataFrame([("k", f, i, 10 + i, 1.25 + f, 2.5, 11.25 + f, 22.5, 0.7, 2) for f in (0, 3) for i in range(2)], "clip string, frame long, row_ix int, track_id long, x1 double, y1 double, x2 double, y2 double, confidence double, class_id int")
    files.write_mot(tracks, at("mot"))
    line = spark.read.text(at("mot") + "/clip=k").first().value
    assert line == "0,10,2.25,3.50,10.00,20.00,1,2,-1"
    back = files.read_mot(spark, at("mot") + "/clip=k", "k")
    assert sorted(map(tuple, back.drop("confidence").collect())) == sorted(map(tuple, tracks.drop("confidence").collect()))
    assert {r.confidence for r in back.collect()} == {1.0}
    ball = spark.createDataFrame([("k", 0, 1.234, 5.678, "detected", True, 0.1236), ("k", 1, None, None, "missing", False, 0.0)], "clip string, frame long, x double, y double, source string, airborne boolean, confidence double")
    files.write_ball(ball, at("ball"))
    assert [tuple(r)[1:] for r in files.read_ball(spark, at("ball") + "/clip=k", "k").orderBy("frame").collect()] == [(0, 1.23, 5.68, "detected", True, 0.124), (1, None, None, "missing", False, 0.0)]
    calib = spark.createDataFrame([("k", 0, [float(i) for i in range(9)], "solved", False), ("k", 1, None, "none", True), ("k", 2, [float("nan")] * 9, "propagated", True)], "clip string, frame long, h array<double>, source string, low_confidence boolean")
    files.write_calibration(calib, at("calib"))
    got = {r.frame: (r.h, r.source) for r in files.read_calibration(spark, at("calib")).collect()}
    assert got == {0: ([float(i) for i in range(9)], "solved"), 1: (None, "none"), 2: (None, "propagated")}


def test_anchor_json(spark, tmp_path):
    path = tmp_path / "clip1"
    path.mkdir()
    (path / "anchors.json").write_text('{"video": "v", "frames": {"10": [{"image": [1, 2], "pitch": [3, 4], "vertex": 5}, {"image": [5, 6], "pitch": [7, 8], "exclude": "seen"}]}}')
    points = files.read_anchors(spark, str(path / "anchors.json"))
    assert [tuple(r) for r in points.orderBy("pt_ix").collect()] == [("clip1", 10, 0, 1.0, 2.0, 3.0, 4.0, 5, None), ("clip1", 10, 1, 5.0, 6.0, 7.0, 8.0, None, "seen")]
    (path / "again.json").write_text(files.anchors_json(points).first().value)
    assert sorted(map(tuple, files.read_anchors(spark, str(path / "again.json")).collect()), key=str) == sorted(map(tuple, points.collect()), key=str)
    for bad in ('{"frames": {"x": [{"image": [1, 2], "pitch": [3, 4]}]}}', '{"frames": {"1": [{"image": [1], "pitch": [3, 4]}]}}'):
        (path / "bad.json").write_text(bad)
        with pytest.raises(Exception, match="no frame number|no pair"):
            files.read_anchors(spark, str(path / "bad.json")).collect()


def test_palette_json(spark):
    palette = spark.createDataFrame([("c", 0, "team_a", 0, 1.0, 2.0, 3.0, 20.0), ("c", 1, "referee", -1, 4.0, 5.0, 6.0, 20.0)], "clip string, target_ix int, role string, team int, l double, a double, b double, reject_radius double")
    assert sorted(map(tuple, files.read_palette(files.palette_json(palette)).collect())) == sorted(map(tuple, palette.collect()))


def test_colours(spark):
    row = spark.range(1).select(colour.hex_to_bgr(F.lit("#1e90ff")).alias("h"), colour.lab_to_bgr(F.lit(255.0), F.lit(128.0), F.lit(128.0)).alias("w"), colour.lab_to_bgr(F.lit(0.0), F.lit(128.0), F.lit(128.0)).alias("k"), colour.lab_to_bgr(F.lit(136.0), F.lit(208.0), F.lit(195.0)).alias("r")).first()
    assert tuple(row.h) == (255, 144, 30) and tuple(row.w) == (255, 255, 255) and tuple(row.k) == (0, 0, 0)
    assert row.r.r >= 250 and row.r.g <= 6 and row.r.b <= 6


def test_letterbox_is_capped(spark):
    rows = [("c", "row", i, 5.0 if i < 10 or i >= 90 else 100.0) for i in range(100)] + [("d", "row", i, 1.0) for i in range(10)]
    got = {r.clip: (r.lead, r.trail) for r in video.letterbox(spark.createDataFrame(rows, "clip string, axis string, ix long, mean double")).collect()}
    assert got == {"c": (10, 10), "d": (3, 3)}


def test_minimap_must_fit(spark):
    clips = spark.createDataFrame([("a", 1920, 1080)], "clip string, width int, height int")
    assert pitch.minimap(clips).first().panel_w == 480
    with pytest.raises(Exception, match="does not fit"):
        pitch.minimap(spark.createDataFrame([("a", 1920, 200)], "clip string, width int, height int")).collect()


def test_ball_filter_stream_equals_batch(spark, tmp_path):
    rows = [("c", f, 0, 100.0 + 4 * f + RNG.gauss(0, 1), 50.0 + RNG.gauss(0, 1), 0.8, None) if f % 9 else ("c", f, None, None, None, None, None) for f in range(40)]
    schema = "clip string, frame long, cand_ix int, x double, y double, confidence double, gmc array<double>"
    table = spark.createDataFrame(rows, schema)
    batch = stateful.follow_ball(table).orderBy("frame").collect()
    assert max(abs(r.x - (100 + 4 * r.frame)) for r in batch if r.frame > 5) < 8
    for k in range(4):
        table.filter(f"frame >= {10 * k} and frame < {10 * k + 10}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        run = stateful.follow_ball(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        run.awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out")).orderBy("frame").collect()
    assert [tuple(r) for r in out] == [tuple(r) for r in batch]


def test_torso_samples(spark):
    good, grass, dark = (100.0, 120.0, 140.0, 10.0, 200.0), (100.0, 90.0, 150.0, 60.0, 200.0), (5.0, 128.0, 128.0, 0.0, 0.0)
    edge = (100.0, 120.0, 140.0, 30.0, 200.0)  # the bounds of grass are no grass
    rows = [("c", 1, 0, *p) for p in (good, edge, grass)] + [("c", 2, 0, *p) for p in (good, dark, grass, grass)]
    got = {r.track_id: r.l for r in teams.torso_samples(spark.createDataFrame(rows, "clip string, track_id long, seq long, l double, a double, b double, hue double, sat double")).collect()}
    assert got == {1: 100.0, 2: None}


def test_samples_of_short_clips(spark):
    clips = spark.createDataFrame([("a", 3), ("b", 0), ("c", 100)], "clip string, frame_count long")
    got = {}
    for r in video.sample_frames(clips, 8).orderBy("clip", "seq").collect():
        got.setdefault(r.clip, []).append(r.frame)
    assert got == {"a": [0, 1, 2], "b": [0], "c": np.linspace(0, 99, 8, dtype=int).tolist()}


def test_excluded_points(spark):
    points = anchor_points(spark).withColumn("exclude", F.when(F.col("pt_ix") == 0, "true").when(F.col("pt_ix") == 1, "false").when(F.col("pt_ix") == 2, ""))
    assert Q.filter_anchor_points(points, drop_phantom=False).count() == 19
