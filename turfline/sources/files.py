"""Readers and writers of the tracking formats.

Clips are folders: a path names one clip's file and the clip is passed in, or the path has wildcards and the clip is
the name of the file's folder.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Columns of the formats.
MOT = "frame bigint, id bigint, x double, y double, w double, h double, conf double, class double, vis double"
BALL = "frame bigint, x double, y double, source string, airborne int, confidence double"
CANDIDATES = "frame bigint, x double, y double, confidence double, source string"
TEAMS = "track_id bigint, team int, role string, confidence double, n_samples bigint, n_rejected bigint"
POSITIONS = "frame bigint, track_id bigint, x_m double, y_m double, reliable int"
BALL_POSITIONS = "frame bigint, x_m double, y_m double, source string, airborne int, reliable int"
POSSESSION = "frame bigint, state string, track_id bigint"
SOURCE_CODES = ("none", "solved", "propagated")
LEAST_ANCHOR_POINTS = 4


def _clip(clip: str | None) -> Column:
    return F.lit(clip) if clip is not None else F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)


def _csv(spark: SparkSession, path: str, schema: str, clip: str | None, header: bool = True) -> DataFrame:
    rows = spark.read.schema(schema).csv(path, header=header, nullValue="", mode="FAILFAST")
    return rows.select(_clip(clip).alias("clip"), "*")


def read_mot(spark: SparkSession, path: str, clip: str | None = None) -> DataFrame:
    """tracks of a challenge file: positions lose their shift by one, confidence counts as 1, frames keep their number."""
    rows = spark.read.schema(MOT).csv(path, mode="PERMISSIVE")
    rows = rows.select(_clip(clip).alias("clip"), "*", F.monotonically_increasing_id().alias("_line")).filter("frame is not null")
    ix = F.row_number().over(Window.partitionBy("clip", "frame").orderBy("_line")) - 1
    x, y = F.col("x") - 1, F.col("y") - 1
    return rows.select(
        "clip", "frame", ix.alias("row_ix"), F.col("id").alias("track_id"), x.alias("x1"), y.alias("y1"), (x + F.col("w")).alias("x2"), (y + F.col("h")).alias("y2"), F.lit(1.0).alias("confidence"), F.col("class").cast("int").alias("class_id")
    )


def fixed(column: Column, digits: int) -> Column:
    """A number with so many decimals; null for null."""
    return F.when(column.isNotNull(), F.format_string(f"%.{digits}f", column))


def mot_rows(tracks: DataFrame) -> DataFrame:
    """One column of lines, with the key columns for sorting."""
    parts = [F.col("frame").cast("string"), F.col("track_id").cast("string"), fixed(F.col("x1") + 1, 2), fixed(F.col("y1") + 1, 2), fixed(F.col("x2") - F.col("x1"), 2), fixed(F.col("y2") - F.col("y1"), 2), F.lit("1"), F.col("class_id").cast("string"), F.lit("-1")]
    return tracks.select("clip", "frame", "row_ix", F.concat_ws(",", *parts).alias("value"))


def write_mot(tracks: DataFrame, path: str) -> None:
    """Lines in order of frame and row, one folder a clip."""
    rows = mot_rows(tracks).repartition("clip").sortWithinPartitions("clip", "frame", "row_ix")
    rows.select("clip", "value").write.mode("overwrite").partitionBy("clip").text(path)


def _write_csv(rows: DataFrame, path: str, keys: list[str], names: list[str]) -> None:
    rows.repartition("clip").sortWithinPartitions("clip", *keys).select("clip", *names).write.mode("overwrite").partitionBy("clip").csv(path, header=True, emptyValue="", nullValue="")


def _last(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of rows of one key the last line of the file."""
    others = [c for c in rows.columns if c not in keys]
    last = rows.withColumn("line", F.monotonically_increasing_id()).groupBy(*keys).agg(F.max_by(F.struct(*others), "line").alias("r"))
    return last.select(*keys, "r.*").select(*rows.columns)


def read_ball(spark: SparkSession, path: str, clip: str | None = None) -> DataFrame:
    """Rows without x or y have no position; of several rows of a frame the last one counts."""
    rows = _last(_csv(spark, path, BALL, clip), ["clip", "frame"])
    there = F.col("x").isNotNull() & F.col("y").isNotNull()
    return rows.select("clip", "frame", F.when(there, F.col("x")).alias("x"), F.when(there, F.col("y")).alias("y"), "source", F.col("airborne").cast("boolean").alias("airborne"), "confidence")


def write_ball(ball: DataFrame, path: str) -> None:
    rows = ball.select("clip", "frame", fixed(F.col("x"), 2).alias("x"), fixed(F.col("y"), 2).alias("y"), "source", F.col("airborne").cast("int").alias("airborne"), fixed(F.col("confidence"), 3).alias("confidence"))
    _write_csv(rows, path, ["frame"], ["frame", "x", "y", "source", "airborne", "confidence"])


def read_candidates(spark: SparkSession, path: str, clip: str | None = None) -> DataFrame:
    rows = _csv(spark, path, CANDIDATES, clip).withColumn("_line", F.monotonically_increasing_id())
    ix = F.row_number().over(Window.partitionBy("clip", "frame").orderBy("_line")) - 1
    return rows.withColumn("cand_ix", ix).drop("_line")


def write_candidates(candidates: DataFrame, path: str) -> None:
    rows = candidates.select("clip", "frame", "cand_ix", fixed(F.col("x"), 2).alias("x"), fixed(F.col("y"), 2).alias("y"), fixed(F.col("confidence"), 3).alias("confidence"), "source")
    _write_csv(rows, path, ["frame", "cand_ix"], ["frame", "x", "y", "confidence", "source"])


def read_teams(spark: SparkSession, path: str, clip: str | None = None) -> DataFrame:
    return _csv(spark, path, TEAMS, clip)


def write_teams(labels: DataFrame, path: str) -> None:
    rows = labels.select("clip", "track_id", "team", "role", fixed(F.col("confidence"), 4).alias("confidence"), "n_samples", "n_rejected")
    _write_csv(rows, path, ["track_id"], ["track_id", "team", "role", "confidence", "n_samples", "n_rejected"])


def read_positions(spark: SparkSession, path: str, clip: str | None = None) -> DataFrame:
    return _csv(spark, path, POSITIONS, clip).withColumn("reliable", F.col("reliable").cast("boolean"))


def write_positions(positions: DataFrame, path: str) -> None:
    rows = positions.select("clip", "frame", "track_id", fixed(F.col("x_m"), 3).alias("x_m"), fixed(F.col("y_m"), 3).alias("y_m"), F.col("reliable").cast("int").alias("reliable"))
    _write_csv(rows, path, ["frame", "track_id"], ["frame", "track_id", "x_m", "y_m", "reliable"])


def read_ball_positions(spark: SparkSession, path: str, clip: str | None = None) -> DataFrame:
    return _csv(spark, path, BALL_POSITIONS, clip).withColumns({c: F.col(c).cast("boolean") for c in ("airborne", "reliable")})


def write_ball_positions(ball: DataFrame, path: str) -> None:
    rows = ball.select("clip", "frame", fixed(F.col("x_m"), 3).alias("x_m"), fixed(F.col("y_m"), 3).alias("y_m"), "source", F.col("airborne").cast("int").alias("airborne"), F.col("reliable").cast("int").alias("reliable"))
    _write_csv(rows, path, ["frame"], ["frame", "x_m", "y_m", "source", "airborne", "reliable"])


def read_possession(spark: SparkSession, path: str, clip: str | None = None) -> DataFrame:
    return _csv(spark, path, POSSESSION, clip)


def write_possession(states: DataFrame, path: str) -> None:
    _write_csv(states, path, ["frame"], ["frame", "state", "track_id"])


def write_calibration(calibration: DataFrame, path: str) -> None:
    """Columns of a clip together; the source as its code."""
    code = F.array_position(F.array(*[F.lit(s) for s in SOURCE_CODES]), F.col("source")) - 1
    calibration.withColumn("source", code.cast("int")).repartition("clip").sortWithinPartitions("clip", "frame").write.mode("overwrite").partitionBy("clip").parquet(path)


def read_calibration(spark: SparkSession, path: str) -> DataFrame:
    """A homography with a value that is not a number is none."""
    rows = spark.read.parquet(path)
    h = F.when(~F.exists("h", lambda v: F.isnan(v)), F.col("h"))
    return rows.withColumns({"h": h, "source": F.element_at(F.array(*[F.lit(s) for s in SOURCE_CODES]), F.col("source") + 1)})


CALIBRATION = "clip string, frame bigint, h array<double>, source string, low_confidence boolean, gmc array<double>, inliers int, reproj_err_px double"


def _archives(spark: SparkSession, path: str, clip: str | None) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select(_clip(clip).alias("clip"), "content")


def read_calibration_archive(spark: SparkSession, path: str, clip: str | None = None) -> DataFrame:
    """calibration rows of compressed array archives (.npz), one a clip; a homography with a value that is not a number is none."""

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["clip"], batch["content"], strict=True):
                with np.load(io.BytesIO(content)) as data:
                    a = {k: data[k] for k in ("frame_idx", "H", "gmc", "source", "low_confidence", "inliers", "reproj_err_px")}
                n = len(a["frame_idx"])
                h, gmc = a["H"].reshape(n, 9).astype(float), a["gmc"].reshape(n, 6).astype(float)
                yield pd.DataFrame({
                    "clip": [name] * n, "frame": a["frame_idx"].astype("int64"), "h": [None if np.isnan(x).any() else x for x in h], "source": [SOURCE_CODES[int(k)] for k in a["source"]],
                    "low_confidence": a["low_confidence"].astype(bool), "gmc": list(gmc), "inliers": a["inliers"].astype("int32"), "reproj_err_px": a["reproj_err_px"].astype(float),
                })

    return _archives(spark, path, clip).mapInPandas(unpack, CALIBRATION)


def read_frame_shape(spark: SparkSession, path: str, clip: str | None = None) -> DataFrame:
    """clip, height, width of the frames a calibration was fitted in; null where the archive does not say."""

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, content in zip(batch["clip"], batch["content"], strict=True):
                with np.load(io.BytesIO(content)) as data:
                    rows.append((name, *(map(int, data["frame_shape"]) if "frame_shape" in data else (None, None))))
            yield pd.DataFrame(rows, columns=["clip", "height", "width"]).astype({"height": "Int32", "width": "Int32"})

    return _archives(spark, path, clip).mapInPandas(unpack, "clip string, height int, width int")


def read_anchors(spark: SparkSession, path: str, clip: str | None = None) -> DataFrame:
    """anchor_points of a labelling file {frames: {"<frame>": [{image, pitch, vertex, exclude}]}}.

    A key that is no number or a point that is no pair is an error.
    """
    point = "struct<image:array<double>,pitch:array<double>,vertex:int,exclude:string>"
    raw = spark.read.text(path, wholetext=True).select(_clip(clip).alias("clip"), F.from_json("value", f"struct<frames:map<string,array<{point}>>>", {"mode": "FAILFAST"}).alias("j"))
    rows = raw.select("clip", F.explode("j.frames").alias("key", "points")).select("clip", "key", F.posexplode("points").alias("pt_ix", "p"))
    frame = F.when(F.col("key").rlike("^[0-9]+$"), F.col("key").try_cast("long")).otherwise(F.raise_error(F.concat(F.lit("no frame number: "), F.col("key"))).cast("long"))
    pair = lambda c: F.when(F.size(f"p.{c}") == 2, F.col(f"p.{c}")).otherwise(F.raise_error(F.lit(f"{c} is no pair")).cast("array<double>"))
    rows = rows.select("clip", frame.alias("frame"), "pt_ix", pair("image").alias("i"), pair("pitch").alias("q"), "p.vertex", "p.exclude")
    return rows.select("clip", "frame", "pt_ix", F.col("i")[0].alias("img_x"), F.col("i")[1].alias("img_y"), F.col("q")[0].alias("pitch_x"), F.col("q")[1].alias("pitch_y"), "vertex", "exclude")


def anchors_json(points: DataFrame) -> DataFrame:
    """clip, value: the labelling document of each clip."""
    item = F.struct(F.array("img_x", "img_y").alias("image"), F.array("pitch_x", "pitch_y").alias("pitch"), "vertex", "exclude")
    frames = points.groupBy("clip", "frame").agg(F.transform(F.array_sort(F.collect_list(F.struct("pt_ix", item.alias("p")))), lambda x: x["p"]).alias("points"))
    by = frames.groupBy("clip").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("frame").cast("string").alias("k"), "points")))).alias("frames"))
    return by.select("clip", F.to_json(F.struct("frames")).alias("value"))


def palette_json(palette: DataFrame) -> DataFrame:
    """clip, value: targets in order, as one JSON document with sorted keys."""
    item = F.struct(F.array("l", "a", "b").alias("lab"), "role", "team")
    by = palette.groupBy("clip").agg(F.first("reject_radius").alias("reject_radius"), F.transform(F.array_sort(F.collect_list(F.struct("target_ix", item.alias("t")))), lambda x: x["t"]).alias("targets"))
    return by.select("clip", F.to_json(F.struct("reject_radius", "targets")).alias("value"))


def read_palette(documents: DataFrame) -> DataFrame:
    """palette rows of documents with clip and value."""
    j = F.from_json("value", "struct<reject_radius:double,targets:array<struct<lab:array<double>,role:string,team:int>>>")
    rows = documents.select("clip", j.alias("j")).select("clip", "j.reject_radius", F.posexplode("j.targets").alias("target_ix", "t"))
    return rows.select("clip", "target_ix", "t.role", "t.team", F.col("t.lab")[0].alias("l"), F.col("t.lab")[1].alias("a"), F.col("t.lab")[2].alias("b"), "reject_radius")


def metrics_json(rows: DataFrame) -> DataFrame:
    """clip, value: each row's columns as one document."""
    return rows.select("clip", F.to_json(F.struct(*[c for c in rows.columns if c != "clip"])).alias("value"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row per entry of a model manifest."""
    return spark.read.json(path, multiLine=True)


def fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """path, sha256, fingerprint (its first twelve digits) of each file."""
    digest = F.sha2("content", 256)
    return spark.read.format("binaryFile").load(path).select("path", digest.alias("sha256"), F.substring(digest, 1, 12).alias("fingerprint"))


def verify_fingerprints(found: DataFrame, expected: DataFrame) -> DataFrame:
    """clip, problem: fatal where fingerprints differ, noted where none is recorded."""
    rows = expected.select("clip", F.col("fingerprint").alias("want")).join(found.select("clip", F.col("fingerprint").alias("got")), "clip", "left")
    return rows.select("clip", F.when(F.col("want").isNull(), "noted: no fingerprint").when(F.col("want") != F.col("got"), "fatal: another clip").alias("problem")).filter("problem is not null")
