"""Checks before work."""

from __future__ import annotations

from dataclasses import fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turfline import config as C


def require_rows(df: DataFrame, what: str) -> DataFrame:
    """df, or an error if it has no rows."""
    if df.isEmpty():
        raise ValueError(f"{what} has no rows: nothing is written")
    return df


def require_stride_one(stride: int) -> None:
    if stride != 1:
        raise ValueError("what is tracked must have every frame")


def require_fps(clips: DataFrame, fps: float, tolerance: float = 0.5) -> DataFrame:
    """clips, or an error naming those whose rate is another."""
    off = clips.filter(F.abs(F.col("fps") - fps) > tolerance).select("clip").limit(5).collect()
    if off:
        raise ValueError(f"clips of another rate than {fps}: {', '.join(r.clip for r in off)}")
    return clips


def require_file(spark: SparkSession, path: str) -> str:
    """path, or an error if its file system has nothing there."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        raise FileNotFoundError(path)
    return path


def require_provenance(problems: DataFrame) -> list[str]:
    """Clips of which only a note can be made; an error if any clip's labels are another's (`verify_fingerprints`)."""
    fatal = problems.filter("problem like 'fatal%'").orderBy("clip").limit(5).collect()
    if fatal:
        raise ValueError("; ".join(f"{r.clip}: {r.problem}" for r in fatal))
    return [r.clip for r in problems.filter("problem like 'noted%'").select("clip").orderBy("clip").collect()]


def scaffold(config: C.Config = C.Config()) -> str:
    """A config file with every section and value written out, so that a run can be repeated from it alone."""
    shown = lambda v: "null" if v is None else str(v).lower() if isinstance(v, bool) else repr(v)
    lines = []
    for section in fields(config):
        part = getattr(config, section.name)
        lines += [f"{section.name}:", *(f"  {f.name}: {shown(getattr(part, f.name))}" for f in fields(part)), ""]
    return "\n".join(lines)


def checklist(existing: DataFrame, wanted: tuple[str, ...]) -> DataFrame:
    """file, done: what a new clip still lacks."""
    rows = existing.sparkSession.createDataFrame([(i, w) for i, w in enumerate(wanted)], "ord int, file string")
    return rows.join(existing.select("file", F.lit(True).alias("done")), "file", "left").select("ord", "file", F.coalesce("done", F.lit(False)).alias("done"))
