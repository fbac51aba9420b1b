"""Windows against plain loops, on random rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from turfline import config as C
from turfline.operators import ball, possession, projection, runs

RNG = random.Random(7)


def rows_with_gaps(n, clips=("a", "b")):
    return [(c, f, RNG.gauss(0, 3) + f * 0.1, RNG.gauss(0, 3)) for c in clips for f in range(n) if RNG.random() < 0.8]


@pytest.mark.parametrize("window", [1, 2, 4, 5, 15])
def test_smooth(spark, window):
    data = rows_with_gaps(80)
    got = {(r.clip, r.frame): (r.x_m, r.y_m) for r in runs.smooth(spark.createDataFrame(data, "clip string, frame long, x_m double, y_m double"), ["clip"], ["x_m", "y_m"], window).collect()}
    for c in "ab":
        own = [r for r in data if r[0] == c]
        start = 0
        while start < len(own):
            end = start
            while end + 1 < len(own) and own[end + 1][1] == own[end][1] + 1:
                end += 1
            run = own[start : end + 1]
            width = min(window, len(run))
            width -= width % 2 == 0
            for i, r in enumerate(run):
                half = width // 2 if width >= 3 else 0
                part = [run[min(max(k, 0), len(run) - 1)] for k in range(i - half, i + half + 1)]
                assert got[c, r[1]] == pytest.approx((np.mean([p[2] for p in part]), np.mean([p[3] for p in part])))
            start = end + 1


@pytest.mark.parametrize(("hole", "island"), [(0, 1), (2, 3), (5, 18), (1, 4)])
def test_close_flags(spark, hole, island):
    flags = [RNG.random() < 0.6 for _ in range(200)]
    want = list(flags)
    on = [i for i, f in enumerate(want) if f]
    for a, b in zip(on, on[1:], strict=False):
        if b - a - 1 <= hole:
            want[a:b] = [True] * (b - a)
    i = 0
    while i < len(want):
        j = i
        while j < len(want) and want[j]:
            j += 1
        if j > i and j - i < island:
            want[i:j] = [False] * (j - i)
        i = max(j, i + 1)
    df = spark.createDataFrame([("c", i, f) for i, f in enumerate(flags)], "clip string, frame long, flag boolean")
    assert [r.flag for r in runs.close_flags(df, ["clip"], "flag", hole, island).orderBy("frame").collect()] == want


def loop_possession(frames, near, cfg, fps):
    """frames: (frame, x, y, airborne, reliable); near: frame -> (track, side, dist)."""
    state, holder, candidate, count, missing, before, out = "unknown", -1, None, 0, 0, None, []
    for f, x, y, airborne, reliable in frames:
        speed = None
        if before and x is not None and before[1] is not None and before[0] == f - 1:
            speed = np.hypot(x - before[1], y - before[2]) * fps
        before = (f, x, y)
        if x is None or not reliable:
            missing += 1
            if missing > round(cfg.max_unknown_s * fps):
                state, holder = "unknown", -1
            candidate, count = None, 0
        else:
            missing = 0
            track, side, dist = near.get(f, (None, None, np.inf))
            if dist <= cfg.radius_m and speed is not None and speed <= cfg.max_ball_speed_mps and not airborne:
                count = count + 1 if track == candidate else 1
                candidate = track
                if count >= cfg.acquire_frames:
                    state, holder = side, track
            else:
                candidate, count = None, 0
        out.append((f, state, holder))
    return out


def test_possession_equals_loop(spark):
    cfg, fps = C.Possession(radius_m=2.0, acquire_frames=3, max_ball_speed_mps=12.0, max_unknown_s=0.4), 10.0
    frames, players, x, y = [], [], 50.0, 30.0
    for f in range(600):
        if RNG.random() < 0.02:
            continue
        x, y = x + RNG.gauss(0, 0.4), y + RNG.gauss(0, 0.4)
        gone = f % 50 > 42
        frames.append((f, None if gone else x, None if gone else y, RNG.random() < 0.03, RNG.random() < 0.97))
        players += [("c", f, t, x + RNG.gauss(0, 2), y + RNG.gauss(0, 2), True) for t in range(1, 6)]
    roles = {1: "team_a", 2: "team_b", 3: "goalkeeper", 4: "referee"}
    side = {1: "team_a", 2: "team_b", 3: "keeper"}
    near = {}
    at = {f[0]: f for f in frames}
    for _, f, t, px, py, _ in players:
        if t in side and at[f][1] is not None:
            d = float(np.sqrt((px - at[f][1]) ** 2 + (py - at[f][2]) ** 2))
            if f not in near or d < near[f][2]:
                near[f] = (t, side[t], d)
    positions = spark.createDataFrame(players, "clip string, frame long, track_id long, x_m double, y_m double, reliable boolean")
    track = spark.createDataFrame([("c", f, x, y, "detected", a, r) for f, x, y, a, r in frames], "clip string, frame long, x_m double, y_m double, source string, airborne boolean, reliable boolean")
    labels = spark.createDataFrame([("c", t, r) for t, r in roles.items()], "clip string, track_id long, role string")
    got = [(r.frame, r.state, r.track_id) for r in possession.possession(positions, track, labels, fps, cfg).orderBy("frame").collect()]
    assert got == loop_possession(frames, near, cfg, fps)
    shares = possession.shares(spark.createDataFrame([("c", s) for _, s, _ in got], "clip string, state string")).first()
    a, b, n = sum(s == "team_a" for _, s, _ in got), sum(s == "team_b" for _, s, _ in got), len(got)
    assert shares.team_a == pytest.approx(a / max(1, a + b)) and shares.unknown_share == pytest.approx(sum(s == "unknown" for _, s, _ in got) / n)


def test_warps_and_interpolation(spark):
    n = 60
    motion = {f: (1 + RNG.gauss(0, 0.01), RNG.gauss(0, 0.02), RNG.gauss(0, 2), RNG.gauss(0, 2)) for f in range(n) if f % 7}
    w, total = {0: np.eye(3)}, np.eye(3)
    for f in range(1, n):
        if f in motion:
            a, b, tx, ty = motion[f]
            total = np.array([[a, -b, tx], [b, a, ty], [0, 0, 1]]) @ total
        w[f] = total
    spine = spark.createDataFrame([("c", f) for f in range(n)], "clip string, frame long")
    moves = spark.createDataFrame([("c", f, [a, -b, tx, b, a, ty]) for f, (a, b, tx, ty) in motion.items()], "clip string, frame long, gmc array<double>")
    for r in ball.cumulative_warps(spine, moves).collect():
        assert [r.cos, -r.sin, r.tx, r.sin, r.cos, r.ty] == pytest.approx(w[r.frame][:2].ravel().tolist())
    path = [(f, RNG.uniform(0, 900), RNG.uniform(0, 500)) for f in (3, 4, 9, 30, 33)]
    table = spark.createDataFrame([("c", f, x, y, 0.9) for f, x, y in path], "clip string, frame long, x double, y double, confidence double")
    got = {r.frame: (r.source, r.x, r.y) for r in ball.interpolate_gaps(spine, table, moves, 4).collect()}
    assert len(got) == n
    for (fa, xa, ya), (fb, xb, yb) in zip(path, path[1:], strict=False):
        for f in range(fa + 1, fb):
            if fb - fa - 1 > 4:
                assert got[f] == ("missing", None, None)
                continue
            pa = (w[f] @ np.linalg.inv(w[fa]) @ [xa, ya, 1])[:2]
            pb = (w[f] @ np.linalg.inv(w[fb]) @ [xb, yb, 1])[:2]
            k = (f - fa) / (fb - fa)
            assert got[f][0] == "interpolated" and got[f][1:] == pytest.approx(tuple((1 - k) * pa + k * pb))
    assert got[0][0] == got[59][0] == "missing" and got[9] == ("detected", path[2][1], path[2][2])


def arc(spark, n=81):
    states = [("c", f, 300.0 + 2 * f, 500 - 16 * f + 0.2 * f * f, "detected", 0.8) for f in range(n)]
    return spark.createDataFrame(states, "clip string, frame long, x double, y double, source string, confidence double")


def test_parabola(spark):
    none = spark.createDataFrame([], "clip string, frame long, gmc array<double>")
    flags = [r.flag for r in ball.parabola_flags(arc(spark), none).orderBy("frame").collect()]
    ys = np.array([500 - 16 * f + 0.2 * f * f for f in range(81)])
    for i, flag in enumerate(flags):
        lo, hi = max(0, i - 15), min(81, i + 16)
        t = np.arange(lo, hi) - i
        a, b, _ = np.polyfit(t, ys[lo:hi], 2)
        assert flag == (len(t) >= 15 and a >= 0.05 and t[0] <= -b / (2 * a) <= t[-1]), i
    assert any(flags)
    roll = arc(spark).withColumn("y", F.col("frame") * 2.0)
    assert not any(r.flag for r in ball.parabola_flags(roll, none).collect())


def test_path_prefers_the_moving_ball(spark):
    real = [("c", f, 0, 100.0 + 5 * f, 200.0, 0.85) for f in range(20) if f not in (7, 8)]
    still = [("c", f, 1, 700.0, 90.0, 0.5) for f in range(20)]
    table = spark.createDataFrame(real + still, "clip string, frame long, cand_ix int, x double, y double, confidence double")
    spine = spark.createDataFrame([("c", f) for f in range(20)], "clip string, frame long")
    none = spark.createDataFrame([], "clip string, frame long, gmc array<double>")
    assert sorted((r.frame, r.cand_ix) for r in ball.solve_path(table, none, spine).collect()) == [(f, 0) for _, f, *_ in real]


def brute_path(frames, xy, confidence, cfg):
    """The cheapest chain by trying every subset with one candidate a frame."""
    n, best, kept = len(frames), cfg.miss_cost * (frames[-1] - frames[0] + 1), []
    for mask in range(1, 1 << n):
        chain = [i for i in range(n) if mask >> i & 1]
        if len({frames[i] for i in chain}) < len(chain):
            continue
        cost = cfg.miss_cost * (frames[chain[0]] - frames[0] + frames[-1] - frames[chain[-1]]) + sum(cfg.conf_weight * (1 - confidence[i]) for i in chain)
        for a, b in zip(chain, chain[1:], strict=False):
            gap = frames[b] - frames[a]
            if gap > cfg.max_gap:
                cost += cfg.miss_cost * (gap - 1)
                continue
            speed = np.hypot(*(xy[b] - xy[a])) / gap
            cost += np.inf if speed > cfg.max_speed_px else cfg.miss_cost * (gap - 1) + cfg.speed_weight * speed / cfg.max_speed_px
        if cost < best - 1e-12:
            best, kept = cost, chain
    return best, kept


def test_path_equals_brute_force():
    rng = np.random.default_rng(3)
    cfg = C.Ball(max_gap=4)
    for _ in range(30):
        frames = np.sort(rng.integers(0, 14, 9))
        xy, confidence = rng.uniform(0, 120, (9, 2)), rng.uniform(0, 1, 9)
        _, kept = brute_path(frames, xy, confidence, cfg)
        assert ball.least_cost_path(frames, xy, np.ones(9), confidence, cfg) == kept


def test_merge_is_greedy_by_confidence(spark):
    rows = [("c", 0, 0, 0.0, 0.0, 0.5), ("c", 0, 1, 20.0, 0.0, 0.9), ("c", 0, 2, 41.0, 0.0, 0.5), ("c", 0, 3, 21.0, 20.1, 0.9), ("c", 1, 0, 0.0, 0.0, 0.1)]
    table = spark.createDataFrame(rows, "clip string, frame long, cand_ix int, x double, y double, confidence double")
    assert sorted((r.frame, r.cand_ix) for r in projection.merge_candidates(table).collect()) == [(0, 1), (0, 2), (0, 3), (1, 0)]
