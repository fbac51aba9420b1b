"""The registered queries of the tracking operators, with their SQL for DuckDB.

A query's columns are listed once: `x:d` is a double, rounded to six places on both sides, `x:i` a whole number.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turfline import config as C
from turfline.functions import colour as K
from turfline.functions import geometry as G
from turfline.operators import ball as B
from turfline.operators import calibration as Q
from turfline.operators import pitch as P
from turfline.operators import possession as S
from turfline.operators import projection as J
from turfline.operators import runs as R
from turfline.operators import stitch as L
from turfline.operators import teams as M
from turfline.operators import video as V
from turfline.plans import stages as T
from turfline.plans.lineage import shared_folder
from turfline.sources import files as X
from turfline.sources.adapters import Views, with_clause
from turfline.streaming import tracker as online

POSSESSION = C.Possession(radius_m=25.0, acquire_frames=2, max_ball_speed_mps=60.0, max_unknown_s=3.0)
STITCH = C.Stitch(max_gap_s=30.0, v_max_ms=2.0, pos_sigma_m=15.0, max_link_cost=1.5, velocity_window_s=3.0, min_tracklet_s=2.0, short_fragment_max_gap_s=10.0, overlap_tolerance_s=4.0)
FPS = 1.0
KEY = ["clip", "frame"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _columns(spec: str) -> list[tuple[str, str]]:
    return [(c.partition(":")[0], c.partition(":")[2]) for c in spec.split()]


def query(spec: str, views: str = "", sql: str | None = None):
    """Register a function of the views as a query; sql is its body for DuckDB over the named views."""

    def register(f: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(Views(spark, sf_dir))
            kinds = {"d": lambda c: F.round(F.col(c).cast("double"), 6) + F.lit(0.0), "i": lambda c: F.col(c).cast("long"), "": F.col}
            return df.select(*[kinds[k](c).alias(c) for c, k in _columns(spec)])

        QUERIES[f.__name__] = run
        if sql is not None:
            kinds = {"d": "round(cast({0} as double), 6) + 0e0", "i": "cast({0} as bigint)", "": "{0}"}
            head = with_clause(views.split(), "duckdb") if views else ""
            body = sql.strip()
            if body.lower().startswith("with recursive "):
                head, body = head.replace("with ", "with recursive ", 1), "with " + body[15:]
            if body.lower().startswith("with "):
                head, body = (head + ",\n" if head else "with ") + body[5:].rsplit("\nselect ", 1)[0], "select " + body.rsplit("\nselect ", 1)[1]
            ORACLES[f.__name__] = f"{head}\nselect {', '.join(f'{kinds[k].format(c)} as {c}' for c, k in _columns(spec))} from ({body}) q"
        return f

    return register


def _apply(x: str, y: str, h: str = "h") -> tuple[str, str]:
    """SQL of a point through the columns h0 to h8."""
    w = f"({h}6 * ({x}) + {h}7 * ({y}) + {h}8)"
    safe = f"(case when abs({w}) >= 1e-9 then {w} end)"
    return f"(({h}0 * ({x}) + {h}1 * ({y}) + {h}2) / {safe})", f"(({h}3 * ({x}) + {h}4 * ({y}) + {h}5) / {safe})"


FX, FY = _apply("(x1 + x2) / 2", "y2")
BX, BY = _apply("x", "y")

# --- projections and filters ---


@query("clip frame det_ix:i foot_x:d foot_y:d centre_x:d centre_y:d box_w:d box_h:d", "detections", """
select clip, frame, det_ix, (x1 + x2) / 2 as foot_x, y2 as foot_y, (x1 + x2) / 2 as centre_x, (y1 + y2) / 2 as centre_y, x2 - x1 as box_w, y2 - y1 as box_h
from detections where class_id in (1, 2, 3) and confidence >= 0.25""")
def foot_points(v: Views) -> DataFrame:
    return J.foot_points(v.detections, (C.GOALKEEPER, C.PLAYER, C.REFEREE), 0.25)


@query("clip frame det_ix:i class_id:i", "detections", """
select * from (
  select clip, frame, det_ix, confidence, case lower(trim(name)) when 'ball' then 0 when 'goalkeeper' then 1 when 'player' then 2 when 'referee' then 3 end as class_id
  from (select * replace (case name when 'purchase' then ' Ball' when 'view' then 'PLAYER ' when 'error' then 'Goalkeeper' else name end as name) from detections) r
) x where class_id is not null and (class_id <> 0 or confidence >= 0.5)""")
def class_remap(v: Views) -> DataFrame:
    name = F.when(F.col("name") == "purchase", " Ball").when(F.col("name") == "view", "PLAYER ").when(F.col("name") == "error", "Goalkeeper").otherwise(F.col("name"))
    return J.remap_classes(v.detections.drop("class_id").withColumn("name", name), 0.5)


PROJECTED = f"select t.clip, t.frame, track_id, {FX} as x_m, {FY} as y_m, not low_confidence as reliable from tracks t join calibration0 c on t.clip = c.clip and t.frame = c.frame where h0 is not null"


@query("clip frame track_id:i x_m:d y_m:d reliable", "tracks calibration0", PROJECTED)
def project_tracks(v: Views) -> DataFrame:
    return J.project_tracks(v.tracks, v.calibration)


@query("clip frame track_id:i x_m:d y_m:d reliable", "tracks calibration0", PROJECTED + " and not low_confidence")
def project_tracks_confident(v: Views) -> DataFrame:
    return J.project_tracks(v.tracks, v.calibration, drop_low_confidence=True)


BALL_M = f"""select b.clip, b.frame, {BX} as x_m, {BY} as y_m, b.source, airborne, coalesce(h0 is not null and x is not null and not low_confidence, false) as reliable
from ball b left join calibration0 c on b.clip = c.clip and b.frame = c.frame"""


@query("clip frame x_m:d y_m:d source airborne reliable", "ball calibration0", BALL_M)
def project_ball(v: Views) -> DataFrame:
    return J.project_ball(v.ball, v.calibration)


@query("clip frame det_ix:i class_id:i", "detections calibration0", f"""
select d.clip, d.frame, det_ix, class_id from detections d left join calibration0 c on d.clip = c.clip and d.frame = c.frame
where h0 is null or coalesce(low_confidence, true)
   or coalesce({FX} between -(case when class_id = 3 then 3 else 1 end) and 105 + (case when class_id = 3 then 3 else 1 end)
   and {FY} between -(case when class_id = 3 then 3 else 1 end) and 68 + (case when class_id = 3 then 3 else 1 end), false)""")
def off_field_mask(v: Views) -> DataFrame:
    return J.off_field_mask(v.detections, v.calibration, 1.0, {C.REFEREE: 3.0})


@query("clip frame cand_ix:i x:d y:d", "candidates calibration0", f"""
select d.clip, d.frame, cand_ix, x, y from candidates d left join calibration0 c on d.clip = c.clip and d.frame = c.frame
where greatest(w, h_px) between 4 and 40 and (h0 is null or coalesce(low_confidence, true) or coalesce({BX} between -6 and 111 and {BY} between -6 and 74, false))""")
def gate_candidates(v: Views) -> DataFrame:
    return J.gate_candidates(v.candidates, v.calibration)


@query("clip frame cand_ix:i", "candidates", """
with recursive ranked as (select *, row_number() over (partition by clip, frame order by confidence desc, cand_ix) as r from candidates),
walk as (
  select clip, frame, r, [{'x': x, 'y': y}] as kept, true as keeps from ranked where r = 1
  union all
  select n.clip, n.frame, n.r,
         case when len(list_filter(w.kept, lambda k: sqrt((k.x - n.x) * (k.x - n.x) + (k.y - n.y) * (k.y - n.y)) <= 20)) = 0 then list_append(w.kept, {'x': n.x, 'y': n.y}) else w.kept end,
         len(list_filter(w.kept, lambda k: sqrt((k.x - n.x) * (k.x - n.x) + (k.y - n.y) * (k.y - n.y)) <= 20)) = 0
  from walk w join ranked n on n.clip = w.clip and n.frame = w.frame and n.r = w.r + 1
)
select r.clip, r.frame, r.cand_ix from ranked r join walk w on r.clip = w.clip and r.frame = w.frame and r.r = w.r where w.keeps""")
def nms_candidates(v: Views) -> DataFrame:
    return J.merge_candidates(v.candidates)


# --- sequences ---

RUN = "select *, frame - row_number() over (partition by clip, track_id order by frame) as run from p"


@query("clip track_id:i first_frame:i last_frame:i n_frames:i", "tracks", """
select clip, track_id, min(frame) as first_frame, max(frame) as last_frame, count(*) as n_frames
from (select *, frame - row_number() over (partition by clip, track_id order by frame) as run from tracks) r group by clip, track_id, run""")
def contiguous_runs(v: Views) -> DataFrame:
    return R.runs(v.tracks, ["clip", "track_id"])


def _smooth_sql(source: str, keys: str, kept: str, window: int = 15) -> str:
    part = f"partition by {keys}, run"
    return f"""
with p as ({source}),
r as (select *, frame - row_number() over (partition by {keys} order by frame) as run from p where x_m is not null),
n as (select *, count(*) over ({part}) as n, row_number() over ({part} order by frame) - 1 as i, first_value(x_m) over ({part} order by frame) as x0, first_value(y_m) over ({part} order by frame) as y0,
  first_value(x_m) over ({part} order by frame desc) as x9, first_value(y_m) over ({part} order by frame desc) as y9 from r),
h as (select *, cast(floor((least(n, {window}) - case when least(n, {window}) % 2 = 0 then 1 else 0 end) / 2) as bigint) as half from n),
s as (
  select a.clip, a.frame, {kept}, a.half,
    (sum(b.x_m) + any_value(a.x0) * greatest(any_value(a.half - a.i), 0) + any_value(a.x9) * greatest(any_value(a.half - (a.n - 1 - a.i)), 0)) / (2 * any_value(a.half) + 1) as x_m,
    (sum(b.y_m) + any_value(a.y0) * greatest(any_value(a.half - a.i), 0) + any_value(a.y9) * greatest(any_value(a.half - (a.n - 1 - a.i)), 0)) / (2 * any_value(a.half) + 1) as y_m
  from h a join h b on {" and ".join(f"a.{k.strip()} = b.{k.strip()}" for k in keys.split(","))} and a.run = b.run and b.i between a.i - a.half and a.i + a.half
  group by a.clip, a.frame, {kept}, a.half
)"""


@query("clip frame track_id:i x_m:d y_m:d reliable", "tracks calibration0", _smooth_sql(PROJECTED, "clip, track_id", "a.track_id, a.reliable") + "\nselect * from s")
def smooth_positions(v: Views) -> DataFrame:
    return J.smooth_positions(J.project_tracks(v.tracks, v.calibration))


SMOOTH_BALL = _smooth_sql(BALL_M, "clip", "a.source, a.airborne, a.reliable")


@query("clip frame x_m:d y_m:d source airborne reliable", "ball calibration0", SMOOTH_BALL + "\nselect clip, frame, x_m, y_m, source, airborne, reliable from s union all select clip, frame, x_m, y_m, source, airborne, reliable from p where x_m is null")
def smooth_ball(v: Views) -> DataFrame:
    return J.smooth_ball(J.project_ball(v.ball, v.calibration))


SPEED = f"""with p as ({BALL_M}),
sp as (
  select *, case when lag(frame) over w = frame - 1 then sqrt((x_m - lag(x_m) over w) * (x_m - lag(x_m) over w) + (y_m - lag(y_m) over w) * (y_m - lag(y_m) over w)) end as speed
  from p window w as (partition by clip order by frame)
)"""


@query("clip frame speed:d", "ball calibration0", SPEED + "\nselect clip, frame, speed from sp where speed is not null")
def ball_speeds(v: Views) -> DataFrame:
    return J.with_speed(J.project_ball(v.ball, v.calibration), FPS).filter("speed is not null")


REASON = SPEED + """,
why as (
  select *, concat_ws(', ', case when x_m is null then 'no position' end, case when airborne then 'airborne' end, case when source = 'interpolated' then 'interpolated' end,
    case when not reliable then 'low-confidence homography' end, case when speed > 25 then concat('implausible speed ', cast(cast(round_even(speed, 0) as bigint) as string), ' m/s') end) as reason
  from sp
)"""


@query("clip frame uncertain reason", "ball calibration0", REASON + "\nselect clip, frame, reason <> '' as uncertain, reason from why")
def ball_uncertain(v: Views) -> DataFrame:
    return J.with_uncertainty(J.with_speed(J.project_ball(v.ball, v.calibration), FPS))


@query("clip frame", "ball calibration0", REASON + "\nselect clip, frame from why where source = 'detected' and reason = ''")
def ball_verified(v: Views) -> DataFrame:
    return J.with_uncertainty(J.with_speed(J.project_ball(v.ball, v.calibration), FPS)).filter("verified")


@query("clip frame airborne", "ball", """
with f as (select clip, frame, source = 'missing' as flag from ball),
a as (select *, sum(case when flag is distinct from prev then 1 else 0 end) over (partition by clip order by frame) as run from (select *, lag(flag) over (partition by clip order by frame) as prev from f) x),
b as (select *, count(*) over (partition by clip, run) as n, min(run) over (partition by clip) as lo, max(run) over (partition by clip) as hi from a),
c as (select clip, frame, flag or (run > lo and run < hi and n <= 2) as flag from b),
d as (select *, sum(case when flag is distinct from prev then 1 else 0 end) over (partition by clip order by frame) as run from (select *, lag(flag) over (partition by clip order by frame) as prev from c) x),
e as (select *, count(*) over (partition by clip, run) as n from d)
select clip, frame, flag and n >= 4 as airborne from e""")
def close_flags(v: Views) -> DataFrame:
    rows = v.ball.select(*KEY, (F.col("source") == "missing").alias("airborne"))
    return R.close_flags(rows, ["clip"], "airborne", 2, 4)


# --- possession ---

NEAREST = f"""pl as ({PROJECTED}),
near as (
  select clip, frame, track_id, side, dist from (
    select pl.clip, pl.frame, pl.track_id, case l.role when 'goalkeeper' then 'keeper' else l.role end as side,
      sqrt((pl.x_m - sp.x_m) * (pl.x_m - sp.x_m) + (pl.y_m - sp.y_m) * (pl.y_m - sp.y_m)) as dist,
      row_number() over (partition by pl.clip, pl.frame order by sqrt((pl.x_m - sp.x_m) * (pl.x_m - sp.x_m) + (pl.y_m - sp.y_m) * (pl.y_m - sp.y_m)), pl.track_id) as rn
    from pl join labels0 l on pl.clip = l.clip and pl.track_id = l.track_id and l.role <> 'referee' join sp on pl.clip = sp.clip and pl.frame = sp.frame where sp.x_m is not null
  ) x where rn = 1
)"""


def _positions(v: Views) -> tuple[DataFrame, DataFrame]:
    return J.project_tracks(v.tracks, v.calibration), J.project_ball(v.ball, v.calibration)


@query("clip frame track_id:i side dist:d", "tracks calibration0 ball labels0", SPEED + ",\n" + NEAREST + "\nselect * from near")
def nearest_player(v: Views) -> DataFrame:
    players, ball = _positions(v)
    return S.nearest_players(players, ball, v.labels)


STATES = SPEED + ",\n" + NEAREST + """,
touch as (
  select sp.clip, sp.frame, side, case when sp.x_m is null or not sp.reliable then -1 when dist <= 25 and speed <= 60 and not airborne then track_id else -2 end as touch
  from sp left join near on sp.clip = near.clip and sp.frame = near.frame
),
tr as (select *, sum(case when touch is distinct from prev then 1 else 0 end) over (partition by clip order by frame) as run from (select *, lag(touch) over (partition by clip order by frame) as prev from touch) x),
tn as (select *, row_number() over (partition by clip, run order by frame) as n from tr),
tev as (select *, case when touch >= 0 and n >= 2 then concat(side, '|', cast(touch as string)) when touch = -1 and n > 3 then 'unknown|-1' end as event from tn),
held as (select clip, frame, coalesce(last_value(event ignore nulls) over (partition by clip order by frame rows between unbounded preceding and current row), 'unknown|-1') as h from tev),
states as (select clip, frame, split_part(h, '|', 1) as state, cast(split_part(h, '|', 2) as bigint) as track_id from held)"""


def _states(v: Views) -> DataFrame:
    players, ball = _positions(v)
    return S.possession(players, ball, v.labels, FPS, POSSESSION)


@query("clip frame state track_id:i", "tracks calibration0 ball labels0", STATES + "\nselect * from states")
def possession_states(v: Views) -> DataFrame:
    return _states(v)


@query("clip team_a:d team_b:d keeper_share:d unknown_share:d", "tracks calibration0 ball labels0", STATES + """
select clip, coalesce(count(*) filter (state = 'team_a') / nullif(count(*) filter (state in ('team_a', 'team_b')), 0)::double, 0) as team_a,
  coalesce(count(*) filter (state = 'team_b') / nullif(count(*) filter (state in ('team_a', 'team_b')), 0)::double, 0) as team_b,
  count(*) filter (state = 'keeper') / count(*)::double as keeper_share, count(*) filter (state = 'unknown') / count(*)::double as unknown_share
from states group by clip""")
def possession_summary(v: Views) -> DataFrame:
    return S.shares(_states(v))


@query("clip frame share:d split:i", "tracks calibration0 ball labels0 spine", STATES + """,
sh as (
  select clip, frame, sum(case when state = 'team_a' then 1 else 0 end) over w / nullif(sum(case when state in ('team_a', 'team_b') then 1 else 0 end) over w, 0)::double as share
  from states window w as (partition by clip order by frame)
),
filled as (select s.clip, s.frame, last_value(share ignore nulls) over (partition by s.clip order by s.frame rows between unbounded preceding and current row) as share from spine s left join sh on s.clip = sh.clip and s.frame = sh.frame)
select clip, frame, share, round_even(least(greatest(share, 0), 1) * 200, 0) as split from filled""")
def running_share(v: Views) -> DataFrame:
    return S.running_share(_states(v), v.spine).withColumn("split", S.bar_split("share", 200))


@query("clip track_id:i display_id:i", "tracks", """
select clip, track_id, row_number() over (partition by clip order by f, r) as display_id
from (select clip, track_id, min(frame) as f, arg_min(row_ix, frame) as r from tracks group by clip, track_id) x""")
def display_ids(v: Views) -> DataFrame:
    return J.display_ids(v.tracks)


@query("clip n_detected:i n_interpolated:i n_missing:i overlap:i warn", "ball tracks", """
with c as (select clip, count(*) filter (source = 'detected') as n_detected, count(*) filter (source = 'interpolated') as n_interpolated, count(*) filter (source = 'missing') as n_missing from ball group by clip),
o as (select b.clip, count(distinct b.frame) as overlap from ball b join tracks t on b.clip = t.clip and b.frame = t.frame where b.source <> 'missing' group by b.clip)
select c.*, coalesce(overlap, 0) as overlap, coalesce(overlap, 0) = 0 as warn from c left join o on c.clip = o.clip""")
def render_counters(v: Views) -> DataFrame:
    return J.render_counters(v.ball, v.tracks)


@query("clip frame", "tracks calibration0 ball", f"""
with pl as ({PROJECTED})
select clip, frame from pl union select clip, frame from ball where source <> 'missing'""")
def radar_frames(v: Views) -> DataFrame:
    return J.radar_frames(J.project_tracks(v.tracks, v.calibration), v.ball.filter("source <> 'missing'"))


@query("clip frame kind x_px:i y_px:i radius:i b:i g:i r:i filled", "tracks calibration0 ball labels0 kits", REASON + f""",
pl as ({PROJECTED})
select * from (
select pl.clip, pl.frame, 'player' as kind, round_even(x_m * 10 + 40, 0) as x_px, round_even(y_m * 10 + 40, 0) as y_px, 6 as radius, coalesce(k.b, 128) as b, coalesce(k.g, 128) as g, coalesce(k.r, 128) as r, true as filled
  from pl left join labels0 l on pl.clip = l.clip and pl.track_id = l.track_id left join kits k on l.role = k.role and l.team = k.team
union all
 select clip, frame, 'ball', round_even(x_m * 10 + 40, 0), round_even(y_m * 10 + 40, 0), case when reason <> '' then 8 else 4 end, 255, 255, 255, reason = '' from why where x_m is not null) u""")
def draw_list(v: Views) -> DataFrame:
    players, ball = _positions(v)
    return J.draw_list(players, J.with_uncertainty(J.with_speed(ball, FPS)), v.labels, v.kits)


# --- aggregates over tracks ---


@query("clip track_id:i goal_zone_fraction:d zone_frames:i", "tracks calibration0", f"""
with pl as ({PROJECTED})
select clip, track_id, count(*) filter (x_m < 20 or x_m > 85) / count(*)::double as goal_zone_fraction, count(*) as zone_frames from pl group by clip, track_id""")
def goal_zone_fraction(v: Views) -> DataFrame:
    return M.goal_zone(J.project_tracks(v.tracks, v.calibration))


@query("clip track_id:i n_frames:i as_keeper:i as_player:i", "tracks", """
select clip, track_id, count(*) as n_frames, count(*) filter (class_id = 1) as as_keeper, count(*) filter (class_id = 2) as as_player from tracks group by clip, track_id""")
def class_histogram(v: Views) -> DataFrame:
    n = lambda c: F.coalesce(F.try_element_at("class_counts", F.lit(c)), F.lit(0))
    return M.class_histogram(v.tracks).withColumns({"as_keeper": n(1), "as_player": n(2)})


@query("clip class_id:i n_ids:i n_rows:i", "tracks", """
select clip, class_id, count(distinct track_id) as n_ids, count(*) as n_rows from tracks group by clip, class_id union all select clip, null, count(distinct track_id), count(*) from tracks group by clip""")
def distinct_ids(v: Views) -> DataFrame:
    return M.distinct_ids(v.tracks)


@query("clip track_id:i l:d a:d b:d n_samples:i n_frames:i", "samples", """
select clip, track_id, median(l) as l, median(a) as a, median(b) as b, count(*) as n_samples, count(*) as n_frames from samples where l is not null group by clip, track_id""")
def lab_median(v: Views) -> DataFrame:
    return M.observations(v.samples)


TARGETS = """near as (
  select s.clip, s.track_id, s.seq, p.target_ix, sqrt((s.l - p.l) * (s.l - p.l) + (s.a - p.a) * (s.a - p.a) + (s.b - p.b) * (s.b - p.b)) as dist
  from samples s join palette p on s.clip = p.clip where s.l is not null
),
best as (
  select *, row_number() over (partition by clip, track_id, seq order by dist, target_ix) as rn, lead(dist) over (partition by clip, track_id, seq order by dist, target_ix) as runner_up from near
)"""


@query("clip track_id:i seq:i target_ix:i dist:d runner_up:d", "samples palette", f"""
with {TARGETS}
select clip, track_id, seq, case when not coalesce(runner_up < dist * 1.25, false) then target_ix end as target_ix, dist, runner_up from best where rn = 1""")
def nearest_with_margin(v: Views) -> DataFrame:
    return M.with_nearest(v.samples.filter("l is not null"), v.palette, ["clip"], 1.25)


@query("clip radius:d", "samples palette", f"""
with {TARGETS},
d as (select * from best where rn = 1),
m as (select clip, median(dist) as mid from d group by clip)
select d.clip, greatest(20, any_value(m.mid) + 3.5 * median(abs(dist - m.mid))) as radius from d join m on d.clip = m.clip group by d.clip""")
def reject_radius(v: Views) -> DataFrame:
    return M.reject_radius(v.samples.filter("l is not null"), v.palette)


@query("clip track_id:i role team:i confidence:d n_samples:i n_rejected:i", "samples palette", f"""
with {TARGETS},
votes as (
  select clip, track_id, seq, case when not coalesce(runner_up < dist * 1.25, false) then target_ix end as target_ix from best where rn = 1
  union all select clip, track_id, seq, null from samples where l is null
),
counts as (select clip, track_id, target_ix, count(*) as n, min(seq) as first from votes group by clip, track_id, target_ix),
tops as (select *, row_number() over (partition by clip, track_id order by target_ix is null, n desc, first) as rn from counts),
totals as (select clip, track_id, coalesce(sum(n) filter (target_ix is not null), 0) as n_samples, coalesce(sum(n) filter (target_ix is null), 0) as n_rejected from counts group by clip, track_id),
j as (
  select o.*, p.role as r, p.team as t, x.n as top, o.n_samples >= 3 and p.role is not null and (p.role not in ('goalkeeper', 'referee') or o.n_samples >= 5 and o.n_samples + o.n_rejected >= 15) as known
  from totals o join tops x on o.clip = x.clip and o.track_id = x.track_id and x.rn = 1 left join palette p on o.clip = p.clip and x.target_ix = p.target_ix
)
select clip, track_id, case when known then r else 'unknown' end as role, case when known then t else -1 end as team, case when known then top / n_samples::double else 0 end as confidence, n_samples, n_rejected from j""")
def vote_labels(v: Views) -> DataFrame:
    life = v.samples.groupBy("clip", "track_id").agg(F.count(F.lit(1)).alias("n_frames"))
    return M.vote_labels(v.samples, v.palette, life)


@query("clip silhouette:d", "samples", """
with p as (select clip, seq as id, track_id as label, l, a, b from samples where l is not null),
d as (
  select x.clip, x.id, x.label as li, y.label as lj, avg(sqrt((x.l - y.l) * (x.l - y.l) + (x.a - y.a) * (x.a - y.a) + (x.b - y.b) * (x.b - y.b))) as d
  from p x join p y on x.clip = y.clip and x.id <> y.id group by x.clip, x.id, x.label, y.label
),
s as (select clip, id, min(case when li = lj then d end) as own, min(case when li <> lj then d end) as other from d group by clip, id)
select clip, avg(case when own is null or other is null then 0 else coalesce((other - own) / nullif(greatest(own, other), 0), 0) end) as silhouette from s group by clip""")
def silhouette(v: Views) -> DataFrame:
    points = v.samples.filter("l is not null").select("clip", F.col("track_id").alias("label"), F.col("seq").alias("track_id"), "l", "a", "b")
    return M.silhouette(points)


@query("clip channel low_ix:i high_ix:i words", "palette", """
with d as (select x.clip, x.target_ix as ia, y.target_ix as ib, y.l - x.l as dl, y.a - x.a as da, y.b - x.b as db from palette x join palette y on x.clip = y.clip and x.role = 'team_a' and y.role = 'team_b'),
c as (select *, case when abs(dl) >= greatest(abs(da), abs(db)) then 'l' when abs(da) >= abs(db) then 'a' else 'b' end as channel from d),
s as (select *, case channel when 'l' then dl when 'a' then da else db end as diff from c)
select clip, channel, case when diff >= 0 then ia else ib end as low_ix, case when diff >= 0 then ib else ia end as high_ix, case channel when 'l' then 'darker/lighter' when 'a' then 'greener/redder' else 'bluer/yellower' end as words from s""")
def palette_order(v: Views) -> DataFrame:
    return M.palette_order(v.palette)


@query("clip cluster:i score:d", "tracks calibration0", f"""
with pl as ({PROJECTED}),
z as (select clip, track_id, count(*) filter (x_m < 20 or x_m > 85) / count(*)::double as share, count(*) as n from pl group by clip, track_id),
h as (select clip, track_id, count(*) as seen, count(*) filter (class_id = 1) as gk from tracks group by clip, track_id)
select z.clip, z.track_id % 3 as cluster, sum(share * n) / sum(n) + 0.5 * sum(gk) / sum(seen) as score from z join h on z.clip = h.clip and z.track_id = h.track_id group by z.clip, z.track_id % 3""")
def keeper_scores(v: Views) -> DataFrame:
    members = M.goal_zone(J.project_tracks(v.tracks, v.calibration)).join(M.class_histogram(v.tracks), ["clip", "track_id"])
    return M.keeper_scores(members.withColumn("cluster", (F.col("track_id") % 3).cast("int")))


# --- stitching: a track's pieces are its stays of 60 frames ---

PIECES = f"""pos as (select clip, frame, track_id * 100 + frame // 60 as track_id, x_m, y_m from ({PROJECTED}) p where not (frame % 60 between 20 + track_id and 30 + track_id)),
o as (select *, row_number() over (partition by clip, track_id order by frame desc) as back from pos),
g as (
  select clip, track_id, min(frame) as first_frame, max(frame) as last_frame, arg_min(x_m, frame) as head_x, arg_min(y_m, frame) as head_y, arg_max(x_m, frame) as tail_x, arg_max(y_m, frame) as tail_y,
    min(frame) filter (back <= 3) as f3, arg_min(x_m, frame) filter (back <= 3) as x3, arg_min(y_m, frame) filter (back <= 3) as y3, count(*) as n_frames
  from o group by clip, track_id
),
pieces as (
  select g.clip, g.track_id, coalesce(l.role, 'unknown') as role, first_frame, last_frame, head_x, head_y, tail_x, tail_y,
    case when n_frames >= 2 and last_frame > f3 then (tail_x - x3) / (last_frame - f3) else 0 end as vx, case when n_frames >= 2 and last_frame > f3 then (tail_y - y3) / (last_frame - f3) else 0 end as vy,
    n_frames, coalesce(l.confidence, 0) as role_confidence
  from g left join labels0 l on g.clip = l.clip and g.track_id // 100 = l.track_id and g.track_id // 100 <> 5
)"""


def _pieces(v: Views) -> DataFrame:
    p = J.project_tracks(v.tracks, v.calibration).filter("not (frame % 60 between 20 + track_id and 30 + track_id)")
    p = p.withColumn("track_id", F.col("track_id") * 100 + F.floor(F.col("frame") / 60))
    ids = p.select("clip", "track_id").distinct()
    labels = ids.withColumn("of", F.floor(F.col("track_id") / 100)).join(v.labels.filter("track_id <> 5").select("clip", F.col("track_id").alias("of"), "role", "confidence"), ["clip", "of"]).drop("of")
    return L.tracklets(p, labels, FPS, STITCH.velocity_window_s)


@query("clip track_id:i role first_frame:i last_frame:i head_x:d head_y:d tail_x:d tail_y:d vx:d vy:d n_frames:i role_confidence:d", "tracks calibration0 labels0", f"with {PIECES}\nselect * from pieces")
def tracklets(v: Views) -> DataFrame:
    return _pieces(v)


LINKS = PIECES + """,
pairs as (
  select a.clip, a.track_id as a, b.track_id as b, greatest(1, b.first_frame - a.last_frame)::double as dt, a.role <> b.role as differ, least(a.role_confidence, b.role_confidence) as conf,
    least(a.n_frames, b.n_frames) as short, b.first_frame >= a.last_frame - 4 as later, a.tail_x, a.tail_y, a.vx, a.vy, b.head_x, b.head_y
  from pieces a join pieces b on a.clip = b.clip and a.track_id <> b.track_id
),
links as (
  select clip, a, b, sqrt((head_x - tail_x - vx * dt) * (head_x - tail_x - vx * dt) + (head_y - tail_y - vy * dt) * (head_y - tail_y - vy * dt)) / (2 * dt + 15) + 0.2 * dt / 30 + case when differ then 0.2 else 0 end as cost
  from pairs where later and dt <= 30 and not (differ and conf >= 0.9) and not (short < 2 and dt > 10)
    and sqrt((head_x - tail_x) * (head_x - tail_x) + (head_y - tail_y) * (head_y - tail_y)) <= 2 * dt + 15
)"""


@query("clip a:i b:i cost:d", "tracks calibration0 labels0", f"with {LINKS}\nselect * from links")
def link_candidates(v: Views) -> DataFrame:
    return L.link_candidates(_pieces(v), FPS, STITCH)


@query("clip a:i b:i")
def solve_links(v: Views) -> DataFrame:
    pieces = _pieces(v)
    return L.solve_links(pieces, L.link_candidates(pieces, FPS, STITCH), STITCH)


#: Every track's pieces of rising number follow each other, but for each fifth.
FOLLOW = """succ as (
  select clip, track_id as a, lead(track_id) over (partition by clip, track_id // 100 order by track_id) as b from pieces
),
successors as (select * from succ where b is not null and b % 5 <> 0),
roots as (
  select p.clip, p.track_id as old_id, (select max(h.track_id) from pieces h where h.clip = p.clip and h.track_id // 100 = p.track_id // 100 and h.track_id <= p.track_id
     and not exists (select 1 from successors s where s.clip = h.clip and s.b = h.track_id)) as new_id
  from pieces p
)"""


def _roots(v: Views) -> tuple[DataFrame, DataFrame]:
    from pyspark.sql import Window

    pieces = _pieces(v)
    after = F.lead("track_id").over(Window.partitionBy("clip", F.floor(F.col("track_id") / 100)).orderBy("track_id"))
    successors = pieces.select("clip", F.col("track_id").alias("a"), after.alias("b")).filter("b is not null and b % 5 <> 0")
    return pieces, L.chain_roots(pieces, successors)


@query("clip old_id:i new_id:i", "tracks calibration0 labels0", f"with {PIECES},\n{FOLLOW}\nselect * from roots")
def chain_roots(v: Views) -> DataFrame:
    return _roots(v)[1]


@query("clip before:i after:i n_merged:i", "tracks calibration0 labels0", f"with {PIECES},\n{FOLLOW}\nselect clip, count(distinct old_id) as before, count(distinct new_id) as after, count(*) filter (old_id <> new_id) as n_merged from roots group by clip")
def merge_report(v: Views) -> DataFrame:
    return L.merge_report(_roots(v)[1])


@query("clip role overflow:i", "tracks calibration0 labels0", f"""with {PIECES},
{FOLLOW},
spans as (select p.clip, p.role, r.new_id, min(first_frame) as a, max(last_frame) + 1 as b from pieces p join roots r on p.clip = r.clip and p.track_id = r.old_id where p.role <> 'unknown' group by p.clip, p.role, r.new_id),
e as (select clip, role, a as moment, 1 as delta from spans union all select clip, role, b, -1 from spans),
l as (select clip, role, sum(delta) over (partition by clip, role order by moment, delta rows between unbounded preceding and current row) as live from e)
select clip, role, max(live) - 1 as overflow from l group by clip, role having max(live) > 1""")
def roster_overflow(v: Views) -> DataFrame:
    pieces, roots = _roots(v)
    return L.roster_overflow(pieces, roots, 1)


@query("clip frame track_id:i row_ix:i confidence:d", "tracks", """
with m as (select *, case when track_id in (1, 2) then 2 when track_id in (4, 5, 6) then 4 else track_id end as new_id from tracks),
r as (select *, row_number() over (partition by clip, frame, new_id order by track_id = new_id desc, confidence desc, row_ix) as rn from m)
select clip, frame, new_id as track_id, row_ix, confidence from r where rn = 1""")
def apply_remap(v: Views) -> DataFrame:
    ids = v.tracks.select("clip", F.col("track_id").alias("old_id")).distinct()
    new = F.when(F.col("old_id").isin(1, 2), 2).when(F.col("old_id").isin(4, 5, 6), 4).otherwise(F.col("old_id"))
    return L.apply_remap(v.tracks, ids.withColumn("new_id", new.cast("long")))


# --- warps, anchors, calibration ---

WARPS = """mo as (
  select s.clip, s.frame, case when s.frame = 0 then 1 else coalesce(m.a, 1) end as a, case when s.frame = 0 then 0 else coalesce(m.b, 0) end as b,
    case when s.frame = 0 then 0 else coalesce(m.tx, 0) end as tx, case when s.frame = 0 then 0 else coalesce(m.ty, 0) end as ty
  from spine s left join motion0 m on s.clip = m.clip and s.frame = m.frame
),
w0 as (select *, sum(ln(sqrt(a * a + b * b))) over w as lg, sum(atan2(b, a)) over w as an from mo window w as (partition by clip order by frame)),
w1 as (select *, exp(lg) * cos(an) as c, exp(lg) * sin(an) as s from w0),
w2 as (select *, sum((c * tx + s * ty) / (c * c + s * s)) over w as ux, sum((c * ty - s * tx) / (c * c + s * s)) over w as uy from w1 window w as (partition by clip order by frame)),
warps as (select clip, frame, c, s, c * ux - s * uy as wx, s * ux + c * uy as wy from w2)"""


@query("clip frame cos:d sin:d tx:d ty:d", "spine motion0", f"with {WARPS}\nselect clip, frame, c as cos, s as sin, wx as tx, wy as ty from warps")
def cumulative_warps(v: Views) -> DataFrame:
    return B.cumulative_warps(v.spine, v.motion)


FILLED = WARPS + """,
pth as (select clip, frame, x, y, confidence from ball where source = 'detected'),
ref as (select p.*, (c * (x - wx) + s * (y - wy)) / (c * c + s * s) as rx, (c * (y - wy) - s * (x - wx)) / (c * c + s * s) as ry from pth p join warps w on p.clip = w.clip and p.frame = w.frame),
nb as (
  select w.*, r.x, r.y, r.confidence, last_value(r.frame ignore nulls) over lo as fa, last_value(r.rx ignore nulls) over lo as ax, last_value(r.ry ignore nulls) over lo as ay,
    first_value(r.frame ignore nulls) over hi as fb, first_value(r.rx ignore nulls) over hi as bx, first_value(r.ry ignore nulls) over hi as by_
  from warps w left join ref r on w.clip = r.clip and w.frame = r.frame
  window lo as (partition by w.clip order by w.frame rows between unbounded preceding and current row), hi as (partition by w.clip order by w.frame rows between current row and unbounded following)
),
filled as (
  select clip, frame, case when x is not null then x when fb - fa - 1 <= 4 then (1 - (frame - fa) / (fb - fa)::double) * (c * ax - s * ay + wx) + (frame - fa) / (fb - fa)::double * (c * bx - s * by_ + wx) end as x,
    case when x is not null then y when fb - fa - 1 <= 4 then (1 - (frame - fa) / (fb - fa)::double) * (s * ax + c * ay + wy) + (frame - fa) / (fb - fa)::double * (s * bx + c * by_ + wy) end as y,
    case when x is not null then 'detected' when fb - fa - 1 <= 4 then 'interpolated' else 'missing' end as source, case when x is not null then confidence else 0 end as confidence
  from nb
)"""


def _filled(v: Views) -> DataFrame:
    return B.interpolate_gaps(v.spine, v.ball.filter("source = 'detected'"), v.motion, 4)


@query("clip frame x:d y:d source confidence:d", "spine motion0 ball", f"with {FILLED}\nselect * from filled")
def interpolate_gaps(v: Views) -> DataFrame:
    return _filled(v)


AIR = C.Ball(airborne_min_frames=3, airborne_residual_px=60.0, airborne_curvature_min=0.05, airborne_speed_ms=15.0)


FAST = f"""seen as (select f.clip, f.frame, case when h0 is not null and not low_confidence then {BX} end as px, case when h0 is not null and not low_confidence then {BY} end as py
  from (select * from filled where source = 'detected') f left join calibration0 c on f.clip = c.clip and f.frame = c.frame),
lagged as (select *, lag(px) over w as qx, lag(py) over w as qy, lag(frame) over w as fr from seen window w as (partition by clip order by frame)),
fast as (select * from lagged where frame - fr <= 3 and sqrt((px - qx) * (px - qx) + (py - qy) * (py - qy)) / (frame - fr) > 15),
marked as (select s.clip, s.frame, exists (select 1 from fast t where t.clip = s.clip and s.frame between t.fr and t.frame) as flag from spine s),
ru as (select *, sum(case when flag is distinct from prev then 1 else 0 end) over (partition by clip order by frame) as run from (select *, lag(flag) over (partition by clip order by frame) as prev from marked) x),
le as (select *, count(*) over (partition by clip, run) as n from ru)"""


@query("clip frame flag", "spine motion0 ball calibration0", f"with {FILLED},\n{FAST}\nselect clip, frame, flag and n >= 3 as flag from le")
def airborne_speed(v: Views) -> DataFrame:
    return B.speed_flags(_filled(v), v.calibration, FPS, AIR)


ARC = """pt as (select f.clip, f.frame, (c * (f.y - wy) - s * (f.x - wx)) / (c * c + s * s) as y from filled f join warps w on f.clip = w.clip and f.frame = w.frame where f.source = 'detected'),
sums as (
  select a.clip, a.frame, count(*) as n, min(b.frame - a.frame) as t0, max(b.frame - a.frame) as t9, regr_count(1, 1) as one,
    sum((b.frame - a.frame)::double) as s1, sum(power(b.frame - a.frame, 2)) as s2, sum(power(b.frame - a.frame, 3)) as s3, sum(power(b.frame - a.frame, 4)) as s4,
    sum(b.y) as m0, sum((b.frame - a.frame) * b.y) as m1, sum(power(b.frame - a.frame, 2) * b.y) as m2, sum(b.y * b.y) as yy
  from pt a join pt b on a.clip = b.clip and b.frame between a.frame - 15 and a.frame + 15 group by a.clip, a.frame having count(*) >= 15
),
de as (select *, s4 * (s2 * n - s1 * s1) - s3 * (s3 * n - s1 * s2) + s2 * (s3 * s1 - s2 * s2) as dd from sums),
co as (
  select *, (m2 * (s2 * n - s1 * s1) - s3 * (m1 * n - s1 * m0) + s2 * (m1 * s1 - s2 * m0)) / dd as qa, (s4 * (m1 * n - s1 * m0) - m2 * (s3 * n - s1 * s2) + s2 * (s3 * m0 - m1 * s2)) / dd as qb,
    (s4 * (s2 * m0 - m1 * s1) - s3 * (s3 * m0 - m1 * s2) + m2 * (s3 * s1 - s2 * s2)) / dd as qc from de where abs(dd) > 1e-9
),
ok as (select clip, frame from co where qa >= 0.05 and sqrt(greatest(0, yy - qa * m2 - qb * m1 - qc * m0) / n) <= 60 and -qb / (2 * qa) between t0 and t9)"""


@query("clip frame flag", "spine motion0 ball", f"with {FILLED},\n{ARC}\nselect s.clip, s.frame, o.frame is not null as flag from spine s left join ok o on s.clip = o.clip and s.frame = o.frame")
def airborne_parabola(v: Views) -> DataFrame:
    return B.parabola_flags(_filled(v), v.motion, AIR)


@query("clip frame airborne source", "spine motion0 ball calibration0", f"""with {FILLED},
{FAST},
{ARC},
either as (select l.clip, l.frame, (l.flag and l.n >= 3) or o.frame is not null as flag from le l left join ok o on l.clip = o.clip and l.frame = o.frame),
r1 as (select *, sum(case when flag is distinct from prev then 1 else 0 end) over (partition by clip order by frame) as run from (select *, lag(flag) over (partition by clip order by frame) as prev from either) x),
r2 as (select *, count(*) over (partition by clip, run) as n, min(run) over (partition by clip) as lo, max(run) over (partition by clip) as hi from r1),
r3 as (select clip, frame, flag or (run > lo and run < hi and n <= {AIR.airborne_max_hole}) as flag from r2),
r4 as (select *, sum(case when flag is distinct from prev then 1 else 0 end) over (partition by clip order by frame) as run from (select *, lag(flag) over (partition by clip order by frame) as prev from r3) x),
r5 as (select *, count(*) over (partition by clip, run) as n from r4)
select f.clip, f.frame, flag and n >= {AIR.airborne_min_frames} as airborne, source from filled f join r5 on f.clip = r5.clip and f.frame = r5.frame""")
def flag_airborne(v: Views) -> DataFrame:
    return B.flag_airborne(_filled(v), v.motion, v.calibration, FPS, AIR)


@query("clip frame cand_ix:i")
def solve_path(v: Views) -> DataFrame:
    gated = J.merge_candidates(J.gate_candidates(v.candidates, v.calibration))
    return B.solve_path(gated, v.motion, v.spine, C.Ball(max_speed_px=200.0))


@query("clip frame x:d y:d source airborne")
def ball_trajectory(v: Views) -> DataFrame:
    gated = J.merge_candidates(J.gate_candidates(v.candidates, v.calibration))
    return B.build_trajectory(gated, v.motion, v.calibration, v.spine, FPS, C.Ball(max_speed_px=200.0))


@query("clip frame prev_anchor:i next_anchor:i weight:d low_confidence", "spine anchors", """
with p as (select *, row_number() over (partition by clip order by frame) as pos from spine),
m as (select p.clip, p.frame, p.pos, a.frame as anc from p left join anchors a on p.clip = a.clip and p.frame = a.frame),
n as (
  select *, max(anc) over lo as fa, max(case when anc is not null then pos end) over lo as pa, min(anc) over hi as fb, min(case when anc is not null then pos end) over hi as pb
  from m window lo as (partition by clip order by frame rows between unbounded preceding and current row), hi as (partition by clip order by frame rows between current row and unbounded following)
)
select clip, frame, fa as prev_anchor, fb as next_anchor, case when pa is null or pb is null then null when pb = pa then 0 else (pos - pa) / (pb - pa)::double end as weight,
  case when fa is null and fb is null then true else least(coalesce(frame - fa, 1000000), coalesce(fb - frame, 1000000)) > 40 end as low_confidence from n""")
def asof_anchor(v: Views) -> DataFrame:
    return Q.anchor_neighbours(v.spine, v.anchors, C.Calibration(max_propagated_frames=40))


@query("clip frame a:d b:d tx:d ty:d", "spine motion0", "select s.clip, s.frame, coalesce(a, 1) as a, coalesce(b, 0) as b, coalesce(tx, 0) as tx, coalesce(ty, 0) as ty from spine s left join motion0 m on s.clip = m.clip and s.frame = m.frame")
def served_motion(v: Views) -> DataFrame:
    g = F.col("gmc")
    return Q.served_motion(v.spine, v.motion).select(*KEY, g[0].alias("a"), g[3].alias("b"), g[2].alias("tx"), g[5].alias("ty"))


def _inverse_sql() -> str:
    m = lambda a, b, c, d: f"(h{a} * h{b} - h{c} * h{d})"
    minors = [(4, 8, 5, 7), (2, 7, 1, 8), (1, 5, 2, 4), (5, 6, 3, 8), (0, 8, 2, 6), (2, 3, 0, 5), (3, 7, 4, 6), (1, 6, 0, 7), (0, 4, 1, 3)]
    det = f"(h0 * {m(4, 8, 5, 7)} - h1 * {m(3, 8, 5, 6)} + h2 * {m(3, 7, 4, 6)})"
    return ", ".join(f"{m(*x)} / {det} as g{i}" for i, x in enumerate(minors))


def _jitter_sql() -> str:
    parts = []
    for x, y in P.control_points():
        ax, ay = _apply(str(x), str(y), "p")
        bx, by = _apply(str(x), str(y), "g")
        parts.append(f"sqrt(power(a * {ax} - b * {ay} + tx - {bx}, 2) + power(b * {ax} + a * {ay} + ty - {by}, 2))")
    lagged = ", ".join(f"lag(g{i}) over w as p{i}" for i in range(9))
    return f"""inv as (select clip, frame, {_inverse_sql()} from calibration0),
lg as (select *, lag(frame) over w as pf, {lagged} from inv window w as (partition by clip order by frame)),
mv as (select l.*, coalesce(m.a, 1) as a, coalesce(m.b, 0) as b, coalesce(m.tx, 0) as tx, coalesce(m.ty, 0) as ty from lg l left join motion0 m on l.clip = m.clip and l.frame = m.frame where pf = l.frame - 1 and p0 is not null and g0 is not null),
ji as (select clip, frame, list_median([{", ".join(parts)}]) as residual_px from mv)"""


@query("clip frame residual_px:d", "calibration0 motion0", f"with {_jitter_sql().replace('list_median', 'list_median')}\nselect * from ji")
def jitter(v: Views) -> DataFrame:
    return Q.jitter(v.calibration, v.motion)


@query("clip n:i median_px:d p90_px:d max_px:d n_worst:i", "calibration0 motion0", f"with {_jitter_sql()}\nselect clip, count(*) as n, median(residual_px) as median_px, quantile_cont(residual_px, 0.9) as p90_px, max(residual_px) as max_px, count(*) filter (residual_px > 2) as n_worst from ji group by clip")
def jitter_summary(v: Views) -> DataFrame:
    return Q.jitter_summary(Q.jitter(v.calibration, v.motion)).withColumn("n_worst", F.size("worst_frames"))


def _plausible_sql() -> str:
    quad = [_apply(str(x), str(y), "g") for x, y in [(0, 0), (105, 0), (105, 68), (0, 68)]]
    foot = [_apply(str(x), str(y), "h") for x, y in [(0, 0), (640, 0), (640, 360), (0, 360)]]
    w = lambda h, pts: [f"({h}6 * {x} + {h}7 * {y} + {h}8)" for x, y in pts]
    wq, wf = w("g", [(0, 0), (105, 0), (105, 68), (0, 68)]), w("h", [(0, 0), (640, 0), (640, 360), (0, 360)])
    side = lambda ws: "((" + " and ".join(f"{v} > 0" for v in ws) + ") or (" + " and ".join(f"{v} < 0" for v in ws) + ")) and " + " and ".join(f"abs({v}) >= 1e-9" for v in ws)
    turn = [f"((q{(i + 1) % 4}x - q{i}x) * (q{(i + 2) % 4}y - q{i}y) - (q{(i + 1) % 4}y - q{i}y) * (q{(i + 2) % 4}x - q{i}x))" for i in range(4)]
    area = " + ".join(f"(f{i}x * f{(i + 1) % 4}y - f{(i + 1) % 4}x * f{i}y)" for i in range(4))
    points = ", ".join([f"{x} as q{i}x, {y} as q{i}y" for i, (x, y) in enumerate(quad)] + [f"{x} as f{i}x, {y} as f{i}y" for i, (x, y) in enumerate(foot)])
    return f"""
with inv as (select clip, frame, {", ".join(f"h{i}" for i in range(9))}, {_inverse_sql()} from calibration0),
pts as (select *, {side(wq)} as qok, {side(wf)} as fok, {points} from inv)
select clip, frame, abs({area}) / 2 as footprint_m2, coalesce(qok and fok and (({" and ".join(t + " > 0" for t in turn)}) or ({" and ".join(t + " < 0" for t in turn)})) and abs({area}) / 2 between 0.05 * 7140 and 20 * 7140, false) as plausible from pts"""


@query("clip frame footprint_m2:d plausible", "calibration0", _plausible_sql())
def plausible(v: Views) -> DataFrame:
    return Q.with_plausible(v.calibration, 640, 360)


@query("clip frames:i solved:i propagated:i uncalibrated:i low_confidence:i median_inliers:d median_reproj_px:d", "calibration0", """
select clip, count(*) as frames, count(*) filter (source = 'solved') as solved, count(*) filter (source = 'propagated') as propagated, count(*) filter (source = 'none') as uncalibrated,
  count(*) filter (low_confidence) as low_confidence, median(inliers) filter (source = 'solved') as median_inliers, median(reproj_err_px) filter (source = 'solved') as median_reproj_px from calibration0 group by clip""")
def calibration_metrics(v: Views) -> DataFrame:
    return Q.calibration_metrics(v.calibration)


KEPT_POINTS = """with k as (select *, not (coalesce(vertex - 1 in (10, 11, 18, 19), false) or coalesce(length(exclude) > 0, false)) as keep from anchor_points),
kept as (select * from (select *, sum(case when keep then 1 else 0 end) over (partition by clip, frame) as left_ from k) x where keep or left_ < 4)"""


@query("clip frame pt_ix:i img_x:d img_y:d", "anchor_points", KEPT_POINTS + "\nselect clip, frame, pt_ix, img_x, img_y from kept")
def anchor_points_kept(v: Views) -> DataFrame:
    return Q.filter_anchor_points(v.anchor_points)


@query("clip severity message frame:i", "clips anchors", """
with g as (select *, frame - lag(frame) over (partition by clip order by frame) as gap from anchors),
a as (select c.clip, c.frame_count, count(g.frame) as n, min(g.frame) as first, max(g.frame) as last from clips c left join g on c.clip = g.clip group by c.clip, c.frame_count),
fatal as (select clip, 'fatal' as severity, 'fewer than two anchors' as message, n as frame from a where n < 2 union all select clip, 'fatal', 'anchor past the end', last from a where last >= frame_count)
select * from fatal union all
select * from (
 select clip, 'advisory' as severity, 'head' as message, first as frame from a where first > 80
 union all select clip, 'advisory', 'gap', frame from g where gap > 80
 union all select clip, 'advisory', 'tail', last from a where frame_count - 1 - last > 80) v where clip not in (select clip from fatal)""".replace("\nselect * from fatal union all\nselect * from (\n select", "\nselect * from (select * from fatal union all select * from (\n select").rstrip() + ") u")
def anchor_coverage(v: Views) -> DataFrame:
    return Q.anchor_coverage(v.clips, v.anchors, 80)


@query("clip frame:i", "clips", """
with n as (select clip, frame_count - 1 as last, greatest(1, ceil((frame_count - 1) / 150.0))::bigint as n from clips)
select clip, round_even(i * last / n::double, 0) as frame from n cross join (select unnest(range(0, 100)) as i) s where i <= n""")
def suggest_anchors(v: Views) -> DataFrame:
    return Q.suggest_anchors(v.clips)


def _solved(v: Views) -> tuple[DataFrame, DataFrame]:
    points = Q.filter_anchor_points(v.anchor_points)
    return points, Q.solve_anchors(points)


@query("clip frame row_ix:i track_id:i x1:d y1:d x2:d y2:d class_id:i")
def track_players(v: Views) -> DataFrame:
    return online.track_players(v.detections, v.spine, v.calibration, v.motion)


@query("clip frame h0:d inliers:i total:i reproj_err_px:d")
def solve_anchors(v: Views) -> DataFrame:
    return _solved(v)[1].withColumn("h0", F.col("h")[0])


@query("clip frame n_points:i n_inliers:i inlier_ratio:d median_residual_m:d end_reach")
def anchor_quality(v: Views) -> DataFrame:
    points, solved = _solved(v)
    return Q.anchor_quality(points, solved)


@query("clip frame source low_confidence h0:d h4:d")
def fused_calibration(v: Views) -> DataFrame:
    return Q.fuse(v.spine, _solved(v)[1], v.motion).withColumns({"h0": F.col("h")[0], "h4": F.col("h")[4]})


@query("clip held_frame:i seeded_from:i fused_with:i pt_ix:i error_px:d error_m:d pitch_x:d")
def holdout_errors(v: Views) -> DataFrame:
    points, solved = _solved(v)
    return Q.holdout_errors(points, solved, v.motion, v.spine)


ERRORS = "err as (select clip, frame as held_frame, pt_ix, abs(img_x - pitch_x / 0.21) as error_px, abs(img_x * 0.21 - pitch_x) as error_m, pitch_x from anchor_points)"


def _errors(v: Views) -> DataFrame:
    return v.anchor_points.select("clip", F.col("frame").alias("held_frame"), "pt_ix", F.abs(F.col("img_x") - F.col("pitch_x") / 0.21).alias("error_px"), F.abs(F.col("img_x") * 0.21 - F.col("pitch_x")).alias("error_m"), "pitch_x")


@query("clip region n:i median_m:d p90_m:d", "anchor_points", f"""
with {ERRORS},
b as (select *, case when pitch_x < 35 then 'near_third' when pitch_x < 70 then 'middle_third' else 'far_third' end as region from err),
every as (select distinct clip, r.region from err cross join (select unnest(['near_third', 'middle_third', 'far_third']) as region) r)
select e.clip, e.region, count(b.error_m) as n, median(b.error_m) as median_m, quantile_cont(b.error_m, 0.9) as p90_m from every e left join b on e.clip = b.clip and e.region = b.region group by e.clip, e.region""")
def region_breakdown(v: Views) -> DataFrame:
    return Q.region_breakdown(_errors(v))


@query("clip points:i anchors:i median_m:d p90_m:d median_px:d p90_px:d", "anchor_points", f"""
with {ERRORS}
select clip, count(*) as points, count(distinct held_frame) as anchors, median(error_m) as median_m, quantile_cont(error_m, 0.9) as p90_m, median(error_px) as median_px, quantile_cont(error_px, 0.9) as p90_px from err group by clip""")
def holdout_summary(v: Views) -> DataFrame:
    return Q.holdout_summary(_errors(v))


@query("clip held_frame:i points:i median_m:d p90_m:d median_px:d", "anchor_points", f"""
with {ERRORS}
select clip, held_frame, count(*) as points, median(error_m) as median_m, quantile_cont(error_m, 0.9) as p90_m, median(error_px) as median_px from err group by clip, held_frame""")
def holdout_by_anchor(v: Views) -> DataFrame:
    return Q.holdout_by_anchor(_errors(v).withColumns({"seeded_from": F.lit(None).cast("long"), "fused_with": F.lit(None).cast("long")}))


@query("clip frame gap:i", "anchors", "select clip, frame, frame - lag(frame) over (partition by clip order by frame) as gap from anchors")
def anchor_gaps(v: Views) -> DataFrame:
    return Q.anchor_gaps(v.anchors)


@query("clip video anchors_sha256_12 clip_frame_count:i frames gaps", "clips anchors", """
with g as (select clip, frame, frame - lag(frame) over (partition by clip order by frame) as gap from anchors),
l as (select clip, string_agg(frame::varchar, ',' order by frame) as frames, string_agg(gap::varchar, ',' order by frame) as gaps from g group by clip)
select c.clip, c.clip || '.mp4' as video, substr(sha256(c.clip), 1, 12) as anchors_sha256_12, c.frame_count as clip_frame_count, coalesce(frames, '') as frames, coalesce(gaps, '') as gaps
from clips c left join l on c.clip = l.clip""")
def provenance(v: Views) -> DataFrame:
    sources = v.clips.select("clip", F.concat("clip", F.lit(".mp4")).alias("video"), F.concat("clip", F.lit(".json")).alias("anchors"), F.substring(F.sha2("clip", 256), 1, 12).alias("fingerprint"))
    block = Q.provenance_block(v.clips, v.anchors, sources)
    return block.withColumns({"frames": F.array_join("anchor_frames", ","), "gaps": F.array_join("anchor_gaps", ",")})


# --- pitch, colours, frames, stages ---


@query("line:i kind seq:i x_m:d y_m:d", "", f"""
with spots as (select * from (values {", ".join(f"({i}, {x!r}, {y!r})" for i, x, y in P.vertices())}) t(vertex, x, y)),
ends as (select * from (values {", ".join(f"({i}, {k}, {e})" for i, edge in enumerate(P.EDGES) for k, e in enumerate(edge))}) t(line, seq, vertex)),
curves as (select * from (values (33, 'circle', 52.5, 0e0, 2 * pi(), 48, 1), (34, 'arc', 11, -acos(5.5e0 / 9.15e0), acos(5.5e0 / 9.15e0), 11, 1), (35, 'arc', 94, -acos(5.5e0 / 9.15e0), acos(5.5e0 / 9.15e0), 11, -1)) t(line, kind, cx, low, high, n, side)),
steps as (select c.*, i as seq, low + (high - low) * i / n::double as angle from curves c cross join (select unnest(range(0, 49)) as i) s where i <= n)
select * from (select line, 'edge' as kind, seq, x as x_m, y as y_m from ends join spots on ends.vertex = spots.vertex union all select line, kind, seq, cx + cos(angle) * side * 9.15e0, 34 + sin(angle) * 9.15e0 from steps) u""")
def pitch_polylines(v: Views) -> DataFrame:
    return P.polylines(v.spark)


@query("clip frame side:i seq:i x:d y:d", "calibration0", f"""
with inv as (select clip, frame, {_inverse_sql()} from calibration0 where h0 is not null),
sides as (select * from (values (0,-3,-3,108,-3,3),(1,108,-3,108,71,2),(2,108,71,-3,71,3),(3,-3,71,-3,-3,2)) t(side, ax, ay, bx, by_, n)),
pts as (select side, i as seq, ax + (bx - ax) * i / n::double as px, ay + (by_ - ay) * i / n::double as py from sides cross join (select unnest(range(0, 200)) as i) s where i < n),
w as (select *, g6 * px + g7 * py + g8 as w from inv cross join pts),
m as (select clip, frame, sign(median(w)) as sg from w where abs(w) > 1e-9 group by clip, frame),
k as (select w.*, count(*) over (partition by w.clip, w.frame) as n from w join m on w.clip = m.clip and w.frame = m.frame where abs(w) > 1e-9 and sign(w) = sg)
select clip, frame, side, seq, (g0 * px + g1 * py + g2) / w as x, (g3 * px + g4 * py + g5) / w as y from k where n >= 3""")
def pitch_outline(v: Views) -> DataFrame:
    return P.outline_in_image(v.calibration, 3.0, 40.0)


@query("clip frame", "spine anchors", "select s.clip, s.frame from spine s where exists (select 1 from anchors a where a.clip = s.clip and a.frame = s.frame)")
def named_frames(v: Views) -> DataFrame:
    return V.named_frames(v.spine, v.anchors)


@query("clip frame det_ix:i x1:d y1:d x2:d y2:d", "detections", """
with b as (select clip, cast(floor(y2) as bigint) as ix, case when y2 < 12 or y2 > 90 then 10 else x2 end as mean from detections),
l as (select clip, ix, max(mean) as top from b group by clip, ix),
g as (select clip, min(ix) filter (top >= 20) as first, max(ix) + 1 as n from l group by clip),
c as (select clip, least(coalesce(first, n), floor(n * 0.3::double)) as top from g)
select d.clip, d.frame, det_ix, x1, y1 - top as y1, x2, y2 - top as y2 from detections d join c on d.clip = c.clip""")
def crop_boxes(v: Views) -> DataFrame:
    y = F.col("y2")
    mean = F.when((y < 12) | (y > 90), 10.0).otherwise(F.col("x2"))
    crops = V.resolve_crop(v.clips, v.detections.select("clip", F.lit("row").alias("axis"), F.floor(y).cast("long").alias("ix"), mean.alias("mean")))
    return V.shift_into_crop(v.detections, crops)


# --- formats: written and read again ---


def _again(v: Views, name: str, write, read, rows: DataFrame) -> DataFrame:
    path = f"{shared_folder(v.spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    write(rows, path)
    return read(path)


@query("clip track_id:i role team:i confidence:d", "labels0", "select clip, track_id, role, team, confidence from labels0")
def teams_file(v: Views) -> DataFrame:
    rows = v.labels.withColumns({"n_samples": F.lit(5).cast("long"), "n_rejected": F.lit(1).cast("long")})
    return _again(v, "teams", X.write_teams, lambda p: _clips(X.read_teams(v.spark, f"{p}/*/*.csv")), rows)


@query("clip frame track_id:i x_m:d y_m:d reliable", "tracks calibration0", f"with pl as ({PROJECTED})\nselect clip, frame, track_id, round(x_m, 3) as x_m, round(y_m, 3) as y_m, reliable from pl")
def positions_file(v: Views) -> DataFrame:
    return _again(v, "positions", X.write_positions, lambda p: _clips(X.read_positions(v.spark, f"{p}/*/*.csv")), J.project_tracks(v.tracks, v.calibration))


@query("clip frame state track_id:i", "tracks calibration0 ball labels0", STATES + "\nselect * from states")
def possession_file(v: Views) -> DataFrame:
    return _again(v, "possession", X.write_possession, lambda p: _clips(X.read_possession(v.spark, f"{p}/*/*.csv")), _states(v))


@query("clip frame h0:d h4:d source low_confidence inliers:i reproj_err_px:d", "calibration0", "select clip, frame, h0, h4, source, low_confidence, inliers, reproj_err_px from calibration0")
def calibration_file(v: Views) -> DataFrame:
    rows = _again(v, "calibration", X.write_calibration, lambda p: X.read_calibration(v.spark, p), v.calibration)
    return rows.withColumns({"h0": F.col("h")[0], "h4": F.col("h")[4]})


@query("clip target_ix:i role team:i l:d a:d b:d", "palette", "select clip, target_ix, role, team, l, a, b from palette")
def palette_file(v: Views) -> DataFrame:
    return X.read_palette(X.palette_json(v.palette.withColumn("reject_radius", F.lit(20.0))))


@query("clip frame pt_ix:i img_x:d img_y:d pitch_x:d pitch_y:d vertex:i exclude", "anchor_points", "select clip, frame, pt_ix, img_x, img_y, pitch_x, pitch_y, vertex, exclude from anchor_points")
def anchors_file(v: Views) -> DataFrame:
    write = lambda rows, path: X.anchors_json(rows).repartition("clip").write.partitionBy("clip").text(path)
    return _again(v, "anchors", write, lambda p: _clips(X.read_anchors(v.spark, f"{p}/*/*.txt")), v.anchor_points)


def _clips(rows: DataFrame) -> DataFrame:
    """Folders are named clip=...: the name alone."""
    return rows.withColumn("clip", F.regexp_replace("clip", "^clip=", ""))


@query("vertex:i x_m:d y_m:d", "", """
select * from (values (1,0,0),(2,0,13.84),(3,0,24.84),(4,0,43.16),(5,0,54.16),(6,0,68),(7,5.5,24.84),(8,5.5,43.16),(9,11,34),(10,16.5,13.84),(11,16.5,24.84),(12,16.5,43.16),(13,16.5,54.16),
 (14,52.5,0),(15,52.5,24.85),(16,52.5,43.15),(17,52.5,68),(18,88.5,13.84),(19,88.5,24.84),(20,88.5,43.16),(21,88.5,54.16),(22,94,34),(23,99.5,24.84),(24,99.5,43.16),
 (25,105,0),(26,105,13.84),(27,105,24.84),(28,105,43.16),(29,105,54.16),(30,105,68),(31,43.35,34),(32,61.65,34)) t(vertex, x_m, y_m)""")
def pitch_vertices(v: Views) -> DataFrame:
    return P.vertex_table(v.spark)


@query("edge:i a:i b:i length_m:d", "", f"""
with spots as (select * from (values {", ".join(f"({i}, {x!r}, {y!r})" for i, x, y in P.vertices())}) t(vertex, x, y)),
edges as (select * from (values {", ".join(f"({i}, {a}, {b})" for i, (a, b) in enumerate(P.EDGES))}) t(edge, a, b))
select edge, a, b, sqrt(power((q.x - p.x)::double, 2) + power((q.y - p.y)::double, 2)) as length_m from edges join spots p on a = p.vertex join spots q on b = q.vertex""")
def pitch_edges(v: Views) -> DataFrame:
    return P.edge_table(v.spark)


@query("side:i seq:i x_m:d y_m:d", "", """
with sides as (select * from (values (0,-3,-3,108,-3,111),(1,108,-3,108,71,74),(2,108,71,-3,71,111),(3,-3,71,-3,-3,74)) t(side, ax, ay, bx, by_, n))
select side, i as seq, ax + (bx - ax) * i / n::double as x_m, ay + (by_ - ay) * i / n::double as y_m from sides cross join (select unnest(range(0, 200)) as i) s where i < n""")
def padded_boundary(v: Views) -> DataFrame:
    return P.padded_boundary(v.spark, 3.0)


@query("clip panel_w:i panel_h:i scale:d margin:i x0:i y0:i", "clips", """
with a as (select *, round_even(width * 0.25::double, 0) as panel_w from clips),
b as (select *, greatest(2, round_even(panel_w * 0.025::double, 0)) as margin from a),
c as (select *, (panel_w - margin * 2) / 105::double as scale from b),
d as (select *, round_even(scale * 68 + margin * 2, 0) as panel_h from c)
select clip, panel_w, panel_h, scale, margin, floor((width - panel_w) / 2) as x0, height - panel_h - round_even(height * 0.03::double, 0) as y0 from d""")
def minimap_geometry(v: Views) -> DataFrame:
    return P.minimap(v.clips)


@query("code b:i g:i r:i ink", "", """
with codes as (select unnest(['#1e90ff', 'ffd700', '#000000', '#ffffff']) as code),
parts as (select code, ltrim(code, '#') as d from codes),
bgr as (select code, ('0x' || substr(d, 5, 2))::int as b, ('0x' || substr(d, 3, 2))::int as g, ('0x' || substr(d, 1, 2))::int as r from parts)
select *, case when b * 0.114 + g * 0.587 + r * 0.299 > 150 then 'black' else 'white' end as ink from bgr""")
def hex_colours(v: Views) -> DataFrame:
    rows = v.spark.createDataFrame([("#1e90ff",), ("ffd700",), ("#000000",), ("#ffffff",)], "code string").withColumn("c", K.hex_to_bgr(F.col("code")))
    return rows.select("code", "c.*").withColumn("ink", K.ink_on(F.col("b"), F.col("g"), F.col("r")))


@query("clip target_ix:i b:i g:i r:i", "palette", """
with w as (select clip, target_ix, (l * 100 / 255 + 16) / 116 as fy, (a - 128) / 500 as da, (b - 128) / 200 as db from palette),
f as (select clip, target_ix, list_transform([fy + da, fy, fy - db], lambda t: case when t > 6e0 / 29 then t * t * t else (t - 4e0 / 29) * 3 * power(6e0 / 29, 2) end) as c from w),
xyz as (select clip, target_ix, c[1] * 0.950456e0 as x, c[2] as y, c[3] * 1.088754e0 as z from f),
lin as (select clip, target_ix, [x * 0.055648e0 - y * 0.204043e0 + z * 1.057311e0, x * -0.969256e0 + y * 1.875991e0 + z * 0.041556e0, x * 3.240479e0 - y * 1.537150e0 - z * 0.498535e0] as c from xyz),
lev as (select clip, target_ix, list_transform(c, lambda v: least(greatest(round_even(255 * case when v <= 0.0031308e0 then v * 12.92e0 else power(greatest(v, 0e0), 1 / 2.4e0) * 1.055e0 - 0.055e0 end, 0), 0), 255)) as c from lin)
select clip, target_ix, c[1] as b, c[2] as g, c[3] as r from lev""")
def lab_colours(v: Views) -> DataFrame:
    return v.palette.withColumn("c", K.lab_to_bgr(F.col("l"), F.col("a"), F.col("b"))).select("clip", "target_ix", "c.*")


@query("clip track_id:i b:i g:i r:i", "labels0 kits", "select l.clip, l.track_id, coalesce(k.b, 128) as b, coalesce(k.g, 128) as g, coalesce(k.r, 128) as r from labels0 l left join kits k on l.role = k.role and l.team = k.team")
def kit_colours(v: Views) -> DataFrame:
    return M.kit_colours(v.labels, v.kits)


@query("clip frame det_ix:i top:i bottom:i left_:i right_:i", "detections", """
with d as (select *, y2 - y1 as h, x2 - x1 as w from detections),
b as (
  select clip, frame, det_ix, h, greatest(0, round_even(y1 + h * 0.2::double, 0)) as top, least(90, round_even(y1 + h * 0.5::double, 0)) as bottom,
    greatest(0, round_even(x1 + w * (0.5::double - 0.3::double), 0)) as left_, least(480, round_even(x1 + w * (0.5::double + 0.3::double), 0)) as right_ from d
)
select * from b where h >= 24 and bottom - top >= 3 and right_ - left_ >= 3""")
def torso_bands(v: Views) -> DataFrame:
    band = M.torso_band(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"), 480, 90)
    return v.detections.withColumn("t", band).filter("t is not null").select(*KEY, "det_ix", "t.top", "t.bottom", F.col("t.left").alias("left_"), F.col("t.right").alias("right_"))


@query("clip frame x0:i y0:i", "ball", "select clip, frame, greatest(0, least(round_even(x - 32, 0), 480 - 64)) as x0, greatest(0, least(round_even(y - 32, 0), 100 - 64)) as y0 from ball where x is not null")
def roi_windows(v: Views) -> DataFrame:
    corner = B.roi_window(F.col("x"), F.col("y"), 64, 480, 100)
    return v.ball.filter("x is not null").withColumn("c", corner).select(*KEY, F.col("c.x").alias("x0"), F.col("c.y").alias("y0"))


@query("clip frame", "spine", "select clip, frame from spine where frame >= 30 and frame < 300 and (frame - 30) % 4 = 0")
def frame_range(v: Views) -> DataFrame:
    return V.frame_range(v.spine, 30, 300, 4)


@query("clip seq:i frame:i duration_s:d", "clips", "select clip, i as seq, floor(i * ((frame_count - 1) / 7::double)) as frame, case when fps = 0 then 0 else frame_count / fps end as duration_s from clips cross join (select unnest(range(0, 8)) as i) s")
def sample_frames(v: Views) -> DataFrame:
    return V.sample_frames(v.clips).join(V.with_duration(v.clips).select("clip", "duration_s"), "clip")


@query("clip axis lead:i trail:i", "detections", """
with b as (select clip, 'row' as axis, cast(floor(y2) as bigint) as ix, case when y2 < 12 or y2 > 90 then 10 else x2 end as mean from detections),
l as (select clip, axis, ix, max(mean) as top from b group by clip, axis, ix),
g as (select clip, axis, min(ix) filter (top >= 20) as first, max(ix) filter (top >= 20) as last, max(ix) + 1 as n from l group by clip, axis)
select clip, axis, least(coalesce(first, n), floor(n * 0.3::double)) as lead, least(coalesce(n - 1 - last, n), floor(n * 0.3::double)) as trail from g""")
def letterbox(v: Views) -> DataFrame:
    y = F.col("y2")
    mean = F.when((y < 12) | (y > 90), 10.0).otherwise(F.col("x2"))
    return V.letterbox(v.detections.select("clip", F.lit("row").alias("axis"), F.floor(y).cast("long").alias("ix"), mean.alias("mean")))


@query("clip frame age:i weight:d", "ball", """
with n as (select a.clip, a.frame, b.frame as f, row_number() over (partition by a.clip, a.frame order by b.frame) - 1 as age, count(*) over (partition by a.clip, a.frame) as n
  from ball a join ball b on a.clip = b.clip and b.frame between a.frame - 9 and a.frame and b.x is not null)
select clip, frame, age, (age + 1) / n::double as weight from n""")
def ball_trail(v: Views) -> DataFrame:
    return V.trail(v.ball, 10)


EXISTING = ("external:video", "external:anchors", "calibration.npz", "calibration_metrics.json", "holdout_metrics.json", "tracks.txt", "teams.csv")


@query("ord:i name runs", "", f"""
with s as (select * from (values {", ".join(f"({i}, '{s.name}', {list(s.outputs)!r}, {str(s.skip_ok).lower()})" for i, s in enumerate(T.STAGES))}) t(ord, name, outputs, skip_ok))
select ord, name, not (skip_ok and list_has_all({list(EXISTING)!r}, outputs)) or ord >= 5 as runs from s""")
def stage_plan(v: Views) -> DataFrame:
    existing = v.spark.createDataFrame([(f,) for f in EXISTING], "file string")
    return T.plan(T.stage_table(v.spark), existing, "project")


@query("name file", "", f"""
with s as (select * from (values {", ".join(f"({i}, '{s.name}', {list(s.inputs)!r}, {list(s.outputs)!r}, {str(s.skip_ok).lower()})" for i, s in enumerate(T.STAGES))}) t(ord, name, inputs, outputs, skip_ok)),
runs as (select * from s where not (skip_ok and list_has_all({list(EXISTING)!r}, outputs))),
made as (select ord, unnest(outputs) as file from runs),
wanted as (select ord, name, unnest(inputs) as file from runs)
select w.name, w.file from wanted w where not list_contains({list(EXISTING)!r}, w.file) and not exists (select 1 from made m where m.file = w.file and m.ord < w.ord)""")
def missing_inputs(v: Views) -> DataFrame:
    existing = v.spark.createDataFrame([(f,) for f in EXISTING], "file string")
    return T.missing_inputs(T.plan(T.stage_table(v.spark), existing), existing)


@query("clip track_id:i role gk_ix:i", "tracks calibration0", f"""
with pl as ({PROJECTED}),
z as (select clip, track_id, count(*) filter (x_m < 20 or x_m > 85) / count(*)::double as share, count(*) as n from pl group by clip, track_id),
h as (select clip, track_id, count(*) as seen, count(*) filter (class_id = 1) as gk from tracks group by clip, track_id),
m as (select z.*, h.seen, h.gk, z.track_id % 3 as cluster from z join h on z.clip = h.clip and z.track_id = h.track_id),
sc as (select clip, cluster, sum(share * n) / sum(n) + 0.5 * sum(gk) / sum(seen) as score from m group by clip, cluster),
rk as (select *, row_number() over (partition by clip order by score desc, cluster) as rn from sc)
select m.clip, m.track_id, case when score >= 0.3 and rn <= {C.TeamID().max_goalkeepers} then 'goalkeeper' else 'referee' end as role,
  case when score >= 0.3 and rn <= {C.TeamID().max_goalkeepers} then rn - 1 end as gk_ix from m join rk on m.clip = rk.clip and m.cluster = rk.cluster""")
def resolve_roles(v: Views) -> DataFrame:
    members = M.goal_zone(J.project_tracks(v.tracks, v.calibration)).join(M.class_histogram(v.tracks), ["clip", "track_id"])
    return M.resolve_roles(members.withColumn("cluster", (F.col("track_id") % 3).cast("int")), C.TeamID(gk_zone_frac=0.3))


@query("clip target_ix:i role team:i l:d a:d b:d reject_radius:d")
def fit_palette(v: Views) -> DataFrame:
    return M.fit_palette(M.observations(v.samples), C.TeamID(min_silhouette=-1.0))
