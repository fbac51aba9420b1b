"""Tracking tables derived from the general tables `events` and `embeddings`.

Each view is one SQL text that Spark and DuckDB both read; the few differences are written out under DIALECT. A
clip is fifty users (for colour samples, 250 vectors), a frame an hour of the month: the number of clips grows with the
tables, what a clip holds does not.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FRAMES = 720

DIALECT = {
    "spark": {"bucket": "user_id div 50", "batch": "vec_id div 250", "events": "{events}", "embeddings": "{embeddings}", "series": "select explode(sequence(0L, {n}L - 1)) as i", "e0": "embedding[0]", "e1": "embedding[1]", "e2": "embedding[2]"},
    "duckdb": {"bucket": "user_id // 50", "batch": "vec_id // 250", "events": "events", "embeddings": "embeddings", "series": "select unnest(range(0, {n})) as i", "e0": "embedding[1]", "e1": "embedding[2]", "e2": "embedding[3]"},
}

#: Parameters of a frame's homography; none of them ends, so that products do not fall on the edges of rounding.
H = ("0.2112345678e0 + frame / 97123e0", "(frame % 5) / 997e0", "0.4987654321e0", "(frame % 7) / 1999e0", "0.6812345678e0", "0.3012345678e0", "0e0", "(frame % 3) / 100003e0", "1e0")

VIEWS = {
    "ev": ("", """
        select event_id, event_type, user_id, concat('c', cast(<bucket> as string)) as clip,
               cast((day(ts) - 1) * 24 + hour(ts) as bigint) as frame,
               cast(round(value * 100) as bigint) as cents, cast(regexp_extract(props, '([0-9]+)', 1) as bigint) as k
        from <events>"""),
    "frames": ("", "select cast(i as bigint) as frame from (<series:720>) s"),
    "clips": ("", "select concat('c', cast(i as string)) as clip, 640 as width, 360 as height, 1e0 as fps, cast(720 - i % 3 * 100 as bigint) as frame_count from (select distinct <bucket> as i from <events>) s"),
    "spine": ("clips frames", "select clip, frame from clips cross join frames"),
    "detections": ("ev", """
        select clip, frame, cast(row_number() over (partition by clip, frame order by event_id) as int) as det_ix,
               cents / 100e0 - (1 + k % 40) / 2e0 as x1, k - (2 + k % 37) * 1e0 as y1, cents / 100e0 + (1 + k % 40) / 2e0 as x2, k * 1e0 as y2,
               (k + 1) / 101e0 as confidence,
               case event_type when 'purchase' then 0 when 'error' then 1 when 'signup' then 3 else 2 end as class_id, event_type as name
        from ev"""),
    "candidates": ("detections", """
        select clip, frame, det_ix as cand_ix, (x1 + x2) / 2 as x, (y1 + y2) / 2 as y, x2 - x1 as w, y2 - y1 as h_px, confidence,
               case when det_ix % 2 = 0 then 'full' else 'roi' end as source
        from detections where class_id <> 2"""),
    "tracks0": ("detections ev", """
        select clip, frame, user_id % 8 as track_id, sum(cents) / (count(*) * 100e0) as mx, sum(k) / (count(*) * 1e0) as my,
               (max(k) + 1) / 101e0 as confidence,
               min(case event_type when 'error' then 1 when 'signup' then 3 else 2 end) as class_id
        from ev where event_type <> 'purchase' group by clip, frame, user_id % 8"""),
    "tracks": ("tracks0", """
        select clip, frame, cast(row_number() over (partition by clip, frame order by track_id) as int) as row_ix, track_id,
               mx - 1 as x1, my - 4 as y1, mx + 1 as x2, my as y2, confidence, class_id
        from tracks0"""),
    "ball0": ("ev", "select clip, frame, sum(cents) / (count(*) * 100e0) as x, sum(k) / (count(*) * 1e0) as y, (max(k) + 1) / 101e0 as confidence from ev where event_type = 'purchase' group by clip, frame"),
    "ball": ("spine ball0", """
        select s.clip, s.frame, b.x, b.y, case when b.x is null then 'missing' when s.frame % 13 = 0 then 'interpolated' else 'detected' end as source,
               s.frame % 29 = 0 as airborne, case when b.x is null or s.frame % 13 = 0 then 0e0 else b.confidence end as confidence
        from spine s left join ball0 b on s.clip = b.clip and s.frame = b.frame"""),
    "calibration0": ("spine", f"""
        select clip, frame, {", ".join(f"case when frame % 41 <> 0 then {e} end as h{i}" for i, e in enumerate(H))},
               case when frame % 41 = 0 then 'none' when frame % 90 = 0 then 'solved' else 'propagated' end as source,
               frame % 17 = 0 as low_confidence, cast(6 + frame % 5 as int) as inliers, case when frame % 90 = 0 then 1e0 + (frame % 7) / 10e0 end as reproj_err_px
        from spine where frame % 53 <> 1"""),
    "motion0": ("spine", """
        select clip, frame, (1 + 0.0005e0 * (frame % 5 - 2)) * cos(0.001e0 * (frame % 7 - 3)) as a, (1 + 0.0005e0 * (frame % 5 - 2)) * sin(0.001e0 * (frame % 7 - 3)) as b,
               (frame % 11 - 5) * 0.5e0 as tx, (frame % 13 - 6) * 0.25e0 as ty
        from spine where frame % 23 <> 0"""),
    "anchors": ("spine", "select clip, frame from spine where frame % 90 = 0 and (clip <> 'c1' or frame <> 270)"),
    "anchor_points": ("anchors", """
        select clip, frame, cast(i as int) as pt_ix, ((i * 37) % 106 - 0.5e0) / 0.21e0 + ((frame + i * 7) % 5 - 2) * 0.8e0 as img_x,
               ((i * 23) % 69 - 0.3e0) / 0.68e0 + ((frame * 3 + i) % 7 - 3) * 0.5e0 as img_y, (i * 37) % 106 * 1e0 as pitch_x, (i * 23) % 69 * 1e0 as pitch_y,
               cast(i + 1 as int) as vertex, case when (frame + i) % 9 = 0 or (frame = 450 and i > 2) then 'bad' end as exclude
        from anchors cross join (<series:14>) s"""),
    "labels0": ("tracks0", """
        select distinct clip, track_id, case when track_id < 3 then 'team_a' when track_id < 6 then 'team_b' when track_id = 6 then 'goalkeeper' else 'referee' end as role,
               cast(case when track_id < 3 then 0 when track_id < 6 then 1 when track_id = 6 then 0 else -1 end as int) as team, 0.5e0 + track_id / 20e0 as confidence
        from tracks0"""),
    "samples": ("", """
        select concat('c', cast(<batch> as string)) as clip, cast(label as bigint) as track_id, vec_id as seq,
               case when vec_id % 7 <> 0 then round(128 + 100 * cast(<e0> as double), 3) end as l,
               case when vec_id % 7 <> 0 then round(128 + 100 * cast(<e1> as double), 3) end as a,
               case when vec_id % 7 <> 0 then round(128 + 100 * cast(<e2> as double), 3) end as b
        from <embeddings>"""),
    "palette": ("", """
        select concat('c', cast(s.i as string)) as clip, t.* from (select distinct <batch> as i from <embeddings>) s cross join (
          select 0 as target_ix, 'team_a' as role, 0 as team, 135e0 as l, 120e0 as a, 130e0 as b
          union all select 1, 'team_b', 1, 118e0, 133e0, 126e0
          union all select 2, 'goalkeeper', 0, 128e0, 140e0, 138e0
          union all select 3, 'referee', -1, 127e0, 121e0, 117e0) t"""),
    "kits": ("", "select 'team_a' as role, 0 as team, 10 as b, 20 as g, 230 as r union all select 'team_b', 1, 240, 240, 240 union all select 'goalkeeper', 0, 20, 220, 30"),
}


def text(name: str, dialect: str) -> str:
    words, out = DIALECT[dialect], VIEWS[name][1]
    for n in (14, 720):
        out = out.replace(f"<series:{n}>", words["series"].replace("{n}", str(n)))
    for k in ("bucket", "batch", "events", "embeddings", "e0", "e1", "e2"):
        out = out.replace(f"<{k}>", words[k])
    return out


def with_clause(names: list[str], dialect: str) -> str:
    """The views of the names and all that they need, as a WITH clause."""
    order: list[str] = []

    def add(name: str) -> None:
        for need in VIEWS[name][0].split():
            add(need)
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    return "with " + ",\n".join(f"{n} as ({text(n, dialect)})" for n in order)


class Views:
    """The views over the tables of a folder, as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        sql = f"{with_clause([name], 'spark')} select * from {name}"
        used = {t: self.spark.read.parquet(f"{self.dir}/{t}.parquet") for t in ("events", "embeddings") if "{" + t + "}" in sql}
        return self.spark.sql(sql, **used)

    @property
    def calibration(self) -> DataFrame:
        h = F.when(F.col("h0").isNotNull(), F.array(*[f"h{i}" for i in range(9)]))
        return self.calibration0.select("clip", "frame", h.alias("h"), "source", "low_confidence", "inliers", "reproj_err_px")

    @property
    def motion(self) -> DataFrame:
        return self.motion0.select("clip", "frame", F.array("a", -F.col("b"), "tx", "b", "a", "ty").alias("gmc"))

    @property
    def labels(self) -> DataFrame:
        return self.labels0
