"""Rejoining the fragments of one identity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turfline import config as C
from turfline.functions import geometry as G
from turfline.plans.lineage import cut


def tracklets(positions: DataFrame, labels: DataFrame, fps: float, velocity_window_s: float = 0.08) -> DataFrame:
    """One row per clip and track: its ends, the velocity over its last rows, its role."""
    n_tail = G.frames_for(velocity_window_s, fps)
    back = F.row_number().over(Window.partitionBy("clip", "track_id").orderBy(F.desc("frame")))
    at = F.struct("x_m", "y_m")
    rows = positions.withColumn("back", back)
    by = rows.groupBy("clip", "track_id").agg(
        F.min("frame").alias("first_frame"),
        F.max("frame").alias("last_frame"),
        F.min_by(at, "frame").alias("head"),
        F.max_by(at, "frame").alias("tail"),
        F.min(F.when(F.col("back") <= n_tail, F.struct("frame", "x_m", "y_m"))).alias("start"),
        F.count(F.lit(1)).alias("n_frames"),
    )
    span = F.col("last_frame") - F.col("start.frame")
    speed = lambda c: F.when((F.col("n_frames") >= 2) & (span > 0), (F.col(f"tail.{c}") - F.col(f"start.{c}")) * fps / span).otherwise(0.0)
    by = by.join(labels.select("clip", "track_id", "role", "confidence"), ["clip", "track_id"], "left")
    return by.select(
        "clip", "track_id", F.coalesce("role", F.lit("unknown")).alias("role"), "first_frame", "last_frame",
        F.col("head.x_m").alias("head_x"), F.col("head.y_m").alias("head_y"), F.col("tail.x_m").alias("tail_x"), F.col("tail.y_m").alias("tail_y"),
        speed("x_m").alias("vx"), speed("y_m").alias("vy"), "n_frames", F.coalesce("confidence", F.lit(0.0)).alias("role_confidence"),
    )


def link_candidates(pieces: DataFrame, fps: float, cfg: C.Stitch = C.Stitch()) -> DataFrame:
    """clip, a, b, cost of every allowed link from the end of a to the start of b.

    A range join on cells of time: a's end is looked for in the cells that b's start can lie in, so that rows meet
    only within the longest gap and the tolerated overlap.
    """
    tolerance = G.frames_for(cfg.overlap_tolerance_s, fps)
    reach_frames = int(cfg.max_gap_s * fps) + 1
    cell = max(1, reach_frames + tolerance)
    a = pieces.select("clip", *[F.col(c).alias(f"a_{c}") for c in pieces.columns if c != "clip"])
    b = pieces.select("clip", *[F.col(c).alias(f"b_{c}") for c in pieces.columns if c != "clip"])
    floor = lambda c: F.floor(c / cell).cast("long")
    a = a.withColumn("cell", F.explode(F.sequence(floor(F.col("a_last_frame") - tolerance), floor(F.col("a_last_frame") + reach_frames))))
    pairs = a.join(b.withColumn("cell", floor(F.col("b_first_frame"))), ["clip", "cell"]).filter("a_track_id <> b_track_id")
    differ = F.col("a_role") != F.col("b_role")
    trusted = F.least("a_role_confidence", "b_role_confidence") >= cfg.role_trust_conf
    dt = F.greatest(F.lit(1), F.col("b_first_frame") - F.col("a_last_frame")) / F.lit(fps)
    pairs = pairs.withColumn("dt", dt)
    pairs = pairs.filter(~(differ & trusted)).filter(F.col("b_first_frame") >= F.col("a_last_frame") - tolerance).filter(F.col("dt") <= cfg.max_gap_s)
    short = F.least("a_n_frames", "b_n_frames") < G.frames_for(cfg.min_tracklet_s, fps)
    pairs = pairs.filter(~(short & (F.col("dt") > cfg.short_fragment_max_gap_s)))
    reach = F.col("dt") * cfg.v_max_ms + cfg.pos_sigma_m
    pairs = pairs.filter(G.distance(F.col("b_head_x"), F.col("b_head_y"), F.col("a_tail_x"), F.col("a_tail_y")) <= reach)
    miss = G.distance(F.col("b_head_x"), F.col("b_head_y"), F.col("a_tail_x") + F.col("a_vx") * F.col("dt"), F.col("a_tail_y") + F.col("a_vy") * F.col("dt"))
    cost = miss / reach * cfg.w_pos + F.col("dt") / cfg.max_gap_s * cfg.w_time + F.when(differ, cfg.w_role_mismatch).otherwise(0.0)
    return pairs.select("clip", F.col("a_track_id").alias("a"), F.col("b_track_id").alias("b"), cost.alias("cost"))


def assign(cost: np.ndarray) -> list[int]:
    """Column of each row in a least-cost assignment of a square matrix, by shortest augmenting paths with potentials."""
    n = len(cost)
    u, v = np.zeros(n + 1), np.zeros(n + 1)
    row_of = np.zeros(n + 1, int)
    for i in range(1, n + 1):
        row_of[0], j = i, 0
        least, used, way = np.full(n + 1, np.inf), np.zeros(n + 1, bool), np.zeros(n + 1, int)
        while row_of[j]:
            used[j] = True
            slack = cost[row_of[j] - 1] - u[row_of[j]] - v[1:]
            better = ~used[1:] & (slack < least[1:])
            least[1:][better], way[1:][better] = slack[better], j
            free = np.flatnonzero(~used[1:]) + 1
            k = free[np.argmin(least[free])]
            step = least[k]
            u[row_of[used]] += step
            v[used] -= step
            least[~used] -= step
            j = k
        while j:
            row_of[j] = row_of[way[j]]
            j = way[j]
    out = [0] * n
    for j in range(1, n + 1):
        out[row_of[j] - 1] = j - 1
    return out


def solve_links(pieces: DataFrame, links: DataFrame, cfg: C.Stitch = C.Stitch()) -> DataFrame:
    """clip, a, b: the links of a least-cost one-to-one assignment that cost no more than the limit.

    The assignment is global within a clip, hence one group per clip; clips are independent.
    """

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf[pdf.b.isna()].sort_values(["first_frame", "a"])
        ids = rows.a.tolist()
        at = {t: k for k, t in enumerate(ids)}
        cost = np.full((len(ids), len(ids)), 1e6)
        for r in pdf[pdf.b.notna()].itertuples():
            cost[at[r.a], at[int(r.b)]] = r.cost
        picked = assign(cost) if len(ids) > 1 else []
        found = [(pdf["clip"].iloc[0], ids[i], ids[j]) for i, j in enumerate(picked) if cost[i, j] <= cfg.max_link_cost]
        return pd.DataFrame(found, columns=["clip", "a", "b"])

    nodes = pieces.select("clip", F.col("track_id").alias("a"), F.lit(None).cast("long").alias("b"), F.lit(None).cast("double").alias("cost"), "first_frame")
    both = nodes.unionByName(links.select("clip", "a", "b", "cost", F.lit(None).cast("long").alias("first_frame")))
    return both.groupBy("clip").applyInPandas(solve, "clip string, a long, b long")


def chain_roots(pieces: DataFrame, successors: DataFrame, rounds: int = 40) -> DataFrame:
    """clip, old_id, new_id: each track's first predecessor, by doubling the steps that pointers take.

    A walk around a cycle ends before it meets its start again, so each member of a cycle takes its own successor.
    """
    nodes = pieces.select("clip", F.col("track_id").alias("old_id")).distinct()
    up = successors.select("clip", F.col("b").alias("old_id"), F.col("a").alias("up"))
    state = cut(nodes.join(up, ["clip", "old_id"], "left").select("clip", "old_id", F.coalesce("up", "old_id").alias("new_id")))
    longest = state.groupBy("clip").count().agg(F.max("count")).first()[0] or 1
    for _ in range(min(rounds, longest.bit_length())):
        jump = state.select("clip", F.col("old_id").alias("new_id"), F.col("new_id").alias("next"))
        state = cut(state.join(jump, ["clip", "new_id"]).select("clip", "old_id", F.col("next").alias("new_id")))
    heads = up.select("clip", F.col("old_id").alias("new_id"), F.lit(True).alias("in_cycle"))
    after = successors.select("clip", F.col("a").alias("old_id"), F.col("b").alias("after"))
    out = state.join(heads, ["clip", "new_id"], "left").join(after, ["clip", "old_id"], "left")
    return out.select("clip", "old_id", F.when(F.col("in_cycle"), F.col("after")).otherwise(F.col("new_id")).alias("new_id"))


def apply_remap(tracks: DataFrame, remap: DataFrame) -> DataFrame:
    """Tracks under their new ids, one row per frame and identity: the root's own, else the most confident, else the first."""
    rows = tracks.join(remap.select("clip", F.col("old_id").alias("track_id"), "new_id"), ["clip", "track_id"], "left")
    rows = rows.withColumn("new_id", F.coalesce("new_id", "track_id"))
    order = Window.partitionBy("clip", "frame", "new_id").orderBy(F.desc(F.col("track_id") == F.col("new_id")), F.desc("confidence"), "row_ix")
    kept = rows.withColumn("rn", F.row_number().over(order)).filter("rn = 1")
    return kept.withColumn("track_id", F.col("new_id")).select(*tracks.columns)


def roster_overflow(pieces: DataFrame, remap: DataFrame, roster: int = 11) -> DataFrame:
    """clip, role, overflow: identities of a known role alive at once beyond the roster."""
    ids = pieces.join(remap.select("clip", F.col("old_id").alias("track_id"), "new_id"), ["clip", "track_id"], "left").filter("role <> 'unknown'")
    spans = ids.groupBy("clip", "role", F.coalesce("new_id", "track_id").alias("id")).agg(F.min("first_frame").alias("a"), F.max("last_frame").alias("b"))
    event = F.explode(F.array(F.struct(F.col("a").alias("at"), F.lit(1).alias("delta")), F.struct((F.col("b") + 1).alias("at"), F.lit(-1).alias("delta"))))
    events = spans.select("clip", "role", event.alias("e")).select("clip", "role", "e.*").groupBy("clip", "role", "at", "delta").agg(F.sum("delta").alias("change"))
    live = F.sum("change").over(Window.partitionBy("clip", "role").orderBy("at", "delta"))
    peak = events.withColumn("live", live).groupBy("clip", "role").agg(F.max("live").alias("peak"))
    return peak.filter(F.col("peak") > roster).select("clip", "role", (F.col("peak") - roster).alias("overflow"))


def merge_report(remap: DataFrame) -> DataFrame:
    """clip, before, after, n_merged: identities before and after, and how many changed."""
    return remap.groupBy("clip").agg(F.count_distinct("old_id").alias("before"), F.count_distinct("new_id").alias("after"), F.count_if(F.col("old_id") != F.col("new_id")).alias("n_merged"))
