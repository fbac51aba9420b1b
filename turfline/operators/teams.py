"""Teams and roles from colour samples: observations, palettes, votes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turfline import config as C

LAB = ("l", "a", "b")


def torso_band(x1: Column, y1: Column, x2: Column, y2: Column, width: int, height: int, cfg: C.TeamID = C.TeamID()) -> Column:
    """top, bottom, left, right of the torso of a box in an image, rounded half to even and clipped to it; null for
    boxes too small to sample."""
    w, h = x2 - x1, y2 - y1
    low = lambda v: F.greatest(F.lit(0), F.bround(v).cast("int"))
    high = lambda v, most: F.least(F.lit(most), F.bround(v).cast("int"))
    half = cfg.torso_width / 2
    top, bottom = low(y1 + h * cfg.torso_top), high(y1 + h * cfg.torso_bottom, height)
    left, right = low(x1 + w * (0.5 - half)), high(x1 + w * (0.5 + half), width)
    fits = (h >= cfg.min_box_h_px) & (bottom - top >= 3) & (right - left >= 3)
    return F.when(fits, F.struct(top.alias("top"), bottom.alias("bottom"), left.alias("left"), right.alias("right")))


def torso_samples(pixels: DataFrame, cfg: C.TeamID = C.TeamID()) -> DataFrame:
    """clip, track_id, seq, l, a, b: the median colour of a torso's pixels that are neither grass, shadow nor glare;
    null when too few are left. Pixels carry l, a, b, hue, sat."""
    grass = (F.col("hue") > cfg.grass_hue_lo) & (F.col("hue") < cfg.grass_hue_hi) & (F.col("sat") > cfg.grass_sat_min)
    keep = ~grass & F.col("l").between(cfg.shadow_l_min, cfg.highlight_l_max)
    by = pixels.withColumn("keep", keep).groupBy("clip", "track_id", "seq")
    enough = F.avg(F.col("keep").cast("double")) >= cfg.min_kept_fraction
    return by.agg(*[F.when(enough, F.median(F.when(F.col("keep"), F.col(c)))).alias(c) for c in LAB])


def class_histogram(tracks: DataFrame) -> DataFrame:
    """clip, track_id, n_frames, class_counts."""
    by = tracks.groupBy("clip", "track_id", "class_id").agg(F.count(F.lit(1)).alias("n"))
    return by.groupBy("clip", "track_id").agg(F.sum("n").alias("n_frames"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("class_id", "n")))).alias("class_counts"))


def distinct_ids(tracks: DataFrame) -> DataFrame:
    """clip, class_id (null for all), n_ids, n_rows."""
    by = tracks.groupBy("clip", "class_id").agg(F.count_distinct("track_id").alias("n_ids"), F.count(F.lit(1)).alias("n_rows"))
    return by.unionByName(tracks.groupBy("clip").agg(F.count_distinct("track_id").alias("n_ids"), F.count(F.lit(1)).alias("n_rows")).withColumn("class_id", F.lit(None).cast("int")))


def goal_zone(positions: DataFrame, zone_m: float = 20.0, length: float = 105.0) -> DataFrame:
    """clip, track_id, goal_zone_fraction, zone_frames: the share of a track's positions near either goal line."""
    near = (F.col("x_m") < zone_m) | (F.col("x_m") > length - zone_m)
    return positions.groupBy("clip", "track_id").agg((F.count_if(near) / F.count(F.lit(1))).alias("goal_zone_fraction"), F.count(F.lit(1)).alias("zone_frames"))


def observations(samples: DataFrame, lifetimes: DataFrame | None = None, zones: DataFrame | None = None, histogram: DataFrame | None = None) -> DataFrame:
    """clip, track_id, l, a, b (medians of accepted samples), n_samples, n_frames, zone share, class counts.

    Tracks without an accepted sample are left out; a lifetime that is not known is the number of samples.
    """
    seen = samples.filter("l is not null")
    out = seen.groupBy("clip", "track_id").agg(*[F.median(c).alias(c) for c in LAB], F.count(F.lit(1)).alias("n_samples"))
    key = ["clip", "track_id"]
    if lifetimes is not None:
        out = out.join(lifetimes.select(*key, F.col("n_frames").alias("life")), key, "left")
    if zones is not None:
        out = out.join(zones, key, "left")
    if histogram is not None:
        out = out.join(histogram.select(*key, "class_counts"), key, "left")
    life = F.coalesce(F.col("life"), F.col("n_samples")) if lifetimes is not None else F.col("n_samples")
    share = F.coalesce("goal_zone_fraction", F.lit(0.0)) if zones is not None else F.lit(0.0)
    frames = F.coalesce("zone_frames", F.lit(0)) if zones is not None else F.lit(0)
    counts = F.coalesce(F.col("class_counts"), F.create_map().cast("map<int,bigint>")) if histogram is not None else F.create_map().cast("map<int,bigint>")
    return out.select(*key, *LAB, "n_samples", life.alias("n_frames"), share.alias("goal_zone_fraction"), frames.cast("long").alias("zone_frames"), counts.alias("class_counts"))


def fit_eligible(obs: DataFrame, cfg: C.TeamID = C.TeamID()) -> DataFrame:
    return obs.filter((F.col("n_samples") >= cfg.min_samples_fit) & (F.col("n_frames") >= cfg.min_track_frames_fit))


def lab_distance(prefix_a: str = "", prefix_b: str = "t_") -> Column:
    return F.sqrt(sum((F.pow(F.col(prefix_a + c) - F.col(prefix_b + c), F.lit(2.0)) for c in LAB), F.lit(0.0)))


def with_nearest(rows: DataFrame, palette: DataFrame, keys: list[str], margin: float | None = None) -> DataFrame:
    """Adds target_ix and dist of the nearest palette target, and runner_up.

    With a margin, target_ix is null where the runner-up is closer than margin times the nearest. A palette is a
    handful of rows a clip: both of its ends are kept in one array, so that samples are neither shuffled nor multiplied.
    """
    targets = palette.groupBy("clip").agg(F.array_sort(F.collect_list(F.struct("target_ix", *LAB))).alias("_t"))
    dist = lambda t: F.sqrt(sum((F.pow(F.col(c) - t[c], F.lit(2.0)) for c in LAB), F.lit(0.0)))
    near = F.array_sort(F.transform("_t", lambda t: F.struct(dist(t).alias("dist"), t["target_ix"].alias("target_ix"))))
    out = rows.join(targets, "clip").withColumn("_n", near)
    runner = F.when(F.size("_n") > 1, F.get("_n", F.lit(1))["dist"])
    best = F.get("_n", F.lit(0))
    ok = F.lit(True) if margin is None else F.coalesce(~(runner < best["dist"] * margin), F.lit(True))
    return out.select(*rows.columns, F.when(ok, best["target_ix"]).alias("target_ix"), best["dist"].alias("dist"), runner.alias("runner_up"))


def reject_radius(rows: DataFrame, palette: DataFrame, cfg: C.TeamID = C.TeamID()) -> DataFrame:
    """clip, radius: the larger of the floor and median + k MAD of the distances to the nearest target."""
    near = with_nearest(rows, palette, ["clip"])
    mid = near.groupBy("clip").agg(F.median("dist").alias("mid"))
    mad = near.join(mid, "clip").groupBy("clip").agg(F.first("mid").alias("mid"), F.median(F.abs(F.col("dist") - F.col("mid"))).alias("mad"))
    return mad.select("clip", F.greatest(F.lit(cfg.min_reject_radius), F.col("mid") + F.col("mad") * cfg.reject_k_mad).alias("radius"))


def vote_labels(samples: DataFrame, palette: DataFrame, lifetimes: DataFrame | None = None, cfg: C.TeamID = C.TeamID()) -> DataFrame:
    """clip, track_id, role, team, confidence, n_samples, n_rejected.

    Each accepted sample votes for its nearest target by margin; ties go to the target seen first. Too few votes are
    unknown, and so is a rare role without the evidence that a fit would ask for.
    """
    seen = samples.filter("l is not null")
    votes = with_nearest(seen, palette, ["clip"], cfg.min_margin).select("clip", "track_id", "seq", "target_ix")
    votes = votes.unionByName(samples.filter("l is null").select("clip", "track_id", "seq", F.lit(None).cast("int").alias("target_ix")))
    by = votes.groupBy("clip", "track_id", "target_ix").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first"))
    cast_votes = F.col("target_ix").isNotNull()
    best = F.max_by("target_ix", F.when(cast_votes, F.struct(F.col("n"), (-F.col("first")).alias("early"))))
    out = by.groupBy("clip", "track_id").agg(
        best.alias("target_ix"), F.coalesce(F.max(F.when(cast_votes, F.col("n"))), F.lit(0)).alias("top"), F.coalesce(F.sum(F.when(cast_votes, F.col("n"))), F.lit(0)).alias("n_samples"), F.coalesce(F.sum(F.when(~cast_votes, F.col("n"))), F.lit(0)).alias("n_rejected")
    )
    out = out.join(F.broadcast(palette.select("clip", "target_ix", "role", "team")), ["clip", "target_ix"], "left")
    known = (F.col("n_samples") >= cfg.min_samples_assign) & F.col("role").isNotNull()
    if lifetimes is not None:
        out = out.join(lifetimes.select("clip", "track_id", F.col("n_frames").alias("life")), ["clip", "track_id"], "left")
        evidence = (F.col("n_samples") >= cfg.min_samples_fit) & (F.coalesce("life", F.lit(0)) >= cfg.min_track_frames_fit)
        known = known & (~F.col("role").isin("goalkeeper", "referee") | evidence)
    return out.select(
        "clip", "track_id", F.when(known, F.col("role")).otherwise("unknown").alias("role"), F.when(known, F.col("team")).otherwise(-1).cast("int").alias("team"),
        F.when(known, F.col("top") / F.col("n_samples")).otherwise(0.0).alias("confidence"), "n_samples", "n_rejected",
    )


def silhouette(points: DataFrame, label: str = "label") -> DataFrame:
    """clip, silhouette: Euclidean, over one row per observed track.

    Every pair of a clip's tracks is compared: a clip has tens of tracks, and the number of clips is what grows.
    """
    a = points.select("clip", F.col("track_id").alias("i"), F.col(label).alias("li"), *[F.col(c) for c in LAB])
    b = points.select("clip", F.col("track_id").alias("j"), F.col(label).alias("lj"), *[F.col(c).alias("t_" + c) for c in LAB])
    mean = a.join(b, "clip").filter("i <> j").groupBy("clip", "i", "li", "lj").agg(F.avg(lab_distance()).alias("d"))
    by = mean.groupBy("clip", "i", "li").agg(F.min(F.when(F.col("lj") == F.col("li"), F.col("d"))).alias("own"), F.min(F.when(F.col("lj") != F.col("li"), F.col("d"))).alias("other"))
    s = F.when(F.col("own").isNull() | F.col("other").isNull(), 0.0).otherwise(F.coalesce(F.try_divide(F.col("other") - F.col("own"), F.greatest("own", "other")), F.lit(0.0)))
    return by.groupBy("clip").agg(F.avg(s).alias("silhouette"))


def kmeans2(x: np.ndarray, n_init: int = 20, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Two centroids and the labels of the best of n_init runs (seeded by distance), each run to its fixed point."""
    rng = np.random.default_rng(seed)
    best: tuple[float, np.ndarray, np.ndarray] | None = None
    for _ in range(n_init):
        first = x[rng.integers(len(x))]
        d = ((x - first) ** 2).sum(axis=1)
        second = x[rng.choice(len(x), p=d / d.sum())] if d.sum() > 0 else first
        centre = np.stack([first, second])
        for _ in range(100):
            label = ((x[:, None] - centre[None]) ** 2).sum(axis=2).argmin(axis=1)
            new = np.stack([x[label == k].mean(axis=0) if (label == k).any() else centre[k] for k in (0, 1)])
            if np.array_equal(new, centre):
                break
            centre = new
        cost = ((x - centre[label]) ** 2).sum()
        if best is None or cost < best[0]:
            best = (cost, centre, label)
    return best[1], best[2]


def average_linkage(x: np.ndarray, radius: float) -> list[int]:
    """Cluster of each row: the two clusters of least mean distance are joined while it is below the radius."""
    groups = [[i] for i in range(len(x))]
    dist = np.linalg.norm(x[:, None] - x[None], axis=2)
    while len(groups) > 1:
        pairs = [(dist[np.ix_(a, b)].mean(), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j]
        d, i, j = min(pairs)
        if d >= radius:
            break
        groups[i] += groups.pop(j)
    out = [0] * len(x)
    for k, members in enumerate(groups):
        for m in members:
            out[m] = k
    return out


def keeper_scores(members: DataFrame) -> DataFrame:
    """clip, cluster, score: zone share weighted by frames, plus half the share of frames classed as goalkeeper."""
    m = members.withColumn("seen", F.aggregate(F.map_values("class_counts"), F.lit(0).cast("long"), lambda a, x: a + x)).withColumn("gk", F.coalesce(F.try_element_at("class_counts", F.lit(C.GOALKEEPER)), F.lit(0)))
    by = m.groupBy("clip", "cluster").agg(F.sum(F.col("goal_zone_fraction") * F.col("zone_frames")).alias("z"), F.sum("zone_frames").alias("w"), F.sum("gk").alias("gk"), F.sum("seen").alias("seen"))
    part = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))
    return by.select("clip", "cluster", (part("z", "w") + 0.5 * part("gk", "seen")).alias("score"))


def resolve_roles(members: DataFrame, cfg: C.TeamID = C.TeamID()) -> DataFrame:
    """clip, track_id, role, gk_ix: the best-scoring clusters that qualify are goalkeepers, the rest are referees."""
    scores = keeper_scores(members)
    order = Window.partitionBy("clip").orderBy(F.desc("score"), "cluster")
    ranked = scores.withColumn("rank", F.row_number().over(order))
    keeper = (F.col("score") >= cfg.gk_zone_frac) & (F.col("rank") <= cfg.max_goalkeepers)
    ranked = ranked.select("clip", "cluster", F.when(keeper, "goalkeeper").otherwise("referee").alias("role"), F.when(keeper, F.col("rank") - 1).cast("int").alias("gk_ix"))
    return members.join(ranked, ["clip", "cluster"]).select("clip", "track_id", "role", "gk_ix")


PALETTE = "clip string, target_ix int, role string, team int, l double, a double, b double, reject_radius double"


def _split_outliers(part: pd.DataFrame, radius: float, cfg: C.TeamID) -> list[tuple[str, int, np.ndarray]]:
    """Role, number and row positions of each colour cluster that counts: keepers by falling score, then all referees."""
    if part.empty:
        return []
    cluster = np.array(average_linkage(part[list(LAB)].to_numpy(float), radius))
    scored = []
    for c in sorted(set(cluster.tolist())):
        rows = part[cluster == c]
        frames = rows["zone_frames"].sum()
        zone = float((rows["goal_zone_fraction"] * rows["zone_frames"]).sum() / frames) if frames else 0.0
        counts = [dict(m) for m in rows["class_counts"]]
        seen = sum(sum(m.values()) for m in counts)
        scored.append((zone + (0.5 * sum(m.get(C.GOALKEEPER, 0) for m in counts) / seen if seen else 0.0), c))
    keepers = [c for s, c in sorted(scored, key=lambda p: -p[0]) if s >= cfg.gk_zone_frac][: cfg.max_goalkeepers]
    out = [("goalkeeper", k, np.flatnonzero(cluster == c)) for k, c in enumerate(keepers)]
    rest = np.flatnonzero(~np.isin(cluster, keepers))
    return [*out, ("referee", -1, rest)] if len(rest) else out


def fit_palette(obs: DataFrame, cfg: C.TeamID = C.TeamID()) -> DataFrame:
    """A clip's palette, outliers first: two provisional kits and a radius from the data; the kits anew from what lies
    within it; the rest split into goalkeepers and referees, once more without those nearer a kit than their role.

    One small group a clip (a row per track); clips are independent.
    """

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf[list(LAB)].to_numpy(float)
        if len(x) < 2:
            raise ValueError("a palette needs two tracks with enough samples")
        to_nearest = lambda p, c: np.linalg.norm(p[:, None] - c[None], axis=2).min(axis=1)
        d = to_nearest(x, kmeans2(x)[0])
        mid = float(np.median(d))
        radius = max(cfg.min_reject_radius, mid + cfg.reject_k_mad * float(np.median(np.abs(d - mid))))
        base = x[d <= radius] if (d <= radius).sum() >= 2 else x
        kits, label = kmeans2(base)
        if 0 < label.sum() < len(label) and (spread := silhouette_of(base, label)) < cfg.min_silhouette:
            raise ValueError(f"the kits do not separate: silhouette {spread:.2f}")
        outside = pdf[d > radius]
        roles = _split_outliers(outside, radius, cfg)
        far = x[d > radius]
        firm = np.zeros(len(far), bool)
        for _, _, at in roles:
            firm[at] = np.linalg.norm(far[at] - far[at].mean(axis=0), axis=1) <= to_nearest(far[at], kits)
        if not firm.all():
            outside, far = outside[firm], far[firm]
            roles = _split_outliers(outside, radius, cfg)
        rows = [("team_a" if k == 0 else "team_b", k, kits[c]) for k, c in enumerate(canonical_order(kits))]
        rows += [(role, k, far[at].mean(axis=0)) for role, k, at in roles]
        return pd.DataFrame([(pdf["clip"].iloc[0], i, role, team, *map(float, lab), radius) for i, (role, team, lab) in enumerate(rows)], columns=["clip", "target_ix", "role", "team", *LAB, "reject_radius"])

    return fit_eligible(obs, cfg).groupBy("clip").applyInPandas(fit, PALETTE)


def silhouette_of(x: np.ndarray, label: np.ndarray) -> float:
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    out = []
    for i in range(len(x)):
        same = label == label[i]
        if same.sum() < 2 or same.all():
            out.append(0.0)
            continue
        own, other = d[i][same].sum() / (same.sum() - 1), d[i][~same].mean()
        out.append((other - own) / max(own, other) if max(own, other) else 0.0)
    return float(np.mean(out))


def canonical_order(centre: np.ndarray) -> list[int]:
    """Kits by rising value on the channel in which they differ most."""
    widest = int(np.abs(centre[1] - centre[0]).argmax())
    return [0, 1] if centre[0][widest] <= centre[1][widest] else [1, 0]


def palette_order(palette: DataFrame) -> DataFrame:
    """clip, channel, low_ix, high_ix, words: the channel in which the two kits differ most, and the kits by it."""
    a, b = palette.filter("role = 'team_a'"), palette.filter("role = 'team_b'")
    both = a.select("clip", F.col("target_ix").alias("ia"), *[F.col(c).alias("a_" + c) for c in LAB]).join(b.select("clip", F.col("target_ix").alias("ib"), *[F.col(c).alias("b_" + c) for c in LAB]), "clip")
    diff = {c: F.abs(F.col("a_" + c) - F.col("b_" + c)) for c in LAB}
    most = F.greatest(*diff.values())
    channel = F.when(diff["l"] == most, "l").when(diff["a"] == most, "a").otherwise("b")
    pick = lambda p: F.when(F.col("channel") == "l", F.col(p + "_l")).when(F.col("channel") == "a", F.col(p + "_a")).otherwise(F.col(p + "_b"))
    both = both.withColumn("channel", channel)
    first = pick("a") <= pick("b")
    words = F.when(F.col("channel") == "l", "darker/lighter").when(F.col("channel") == "a", "greener/redder").otherwise("bluer/yellower")
    return both.select("clip", "channel", F.when(first, F.col("ia")).otherwise(F.col("ib")).alias("low_ix"), F.when(first, F.col("ib")).otherwise(F.col("ia")).alias("high_ix"), words.alias("words"))


def kit_colours(labels: DataFrame, kits: DataFrame) -> DataFrame:
    """labels with b, g, r of their kit; grey where there is none."""
    out = labels.join(F.broadcast(kits), ["role", "team"], "left")
    return out.withColumns({c: F.coalesce(c, F.lit(128)) for c in ("b", "g", "r")})
