"""Stages over written tables: which to run, what is missing, and running them."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Stage:
    name: str
    inputs: tuple[str, ...]
    outputs: tuple[str, ...]
    skip_ok: bool = True


# The stages in order, with what they read and write.
STAGES = (
    Stage("calibrate", ("external:video", "external:anchors"), ("calibration.npz", "calibration_metrics.json")),
    Stage("gate", ("calibration.npz", "external:anchors"), ("holdout_metrics.json",), skip_ok=False),
    Stage("players", ("external:video", "calibration.npz", "external:weights"), ("tracks.txt", "teams.csv", "palette.json")),
    Stage("stitch", ("tracks.txt", "teams.csv"), ("stitched.txt",)),
    Stage("ball", ("external:video", "calibration.npz", "external:ball_weights"), ("ball.csv", "candidates.csv")),
    Stage("project", ("stitched.txt", "teams.csv", "ball.csv", "calibration.npz"), ("positions.csv", "ball_positions.csv", "possession.csv")),
    Stage("radar", ("positions.csv", "ball_positions.csv", "possession.csv", "teams.csv"), ("radar.mp4",)),
    Stage("annotate", ("external:video", "stitched.txt", "teams.csv", "palette.json", "ball.csv", "positions.csv", "ball_positions.csv", "possession.csv"), ("demo.mp4",)),
)


def build_stages(ball_weights_required: bool = True) -> tuple[Stage, ...]:
    """The stages; without weights of its own the ball is found by the players' detector, and none are waited for."""
    if ball_weights_required:
        return STAGES
    return tuple(replace(s, inputs=tuple(i for i in s.inputs if i != "external:ball_weights")) for s in STAGES)


def check_registry(functions: dict, stages: Sequence[Stage] = STAGES) -> None:
    """An error if a stage has no function, or a function no stage."""
    names = {s.name for s in stages}
    if missing := names - set(functions):
        raise ValueError(f"stages without a function: {sorted(missing)}")
    if unknown := set(functions) - names:
        raise ValueError(f"functions of no stage: {sorted(unknown)}")


def stage_table(spark: SparkSession, stages: Sequence[Stage] = STAGES) -> DataFrame:
    return spark.createDataFrame([(i, s.name, list(s.inputs), list(s.outputs), s.skip_ok) for i, s in enumerate(stages)], "ord int, name string, inputs array<string>, outputs array<string>, skip_ok boolean")


def plan(stages: DataFrame, existing: DataFrame, force_from: str | None = None) -> DataFrame:
    """Adds runs: a stage is skipped only if it may be, all its outputs exist and no earlier stage is forced."""
    have = existing.agg(F.collect_set("file").alias("have"))
    rows = stages.crossJoin(have)  # one row of names against the short list of stages
    done = F.col("skip_ok") & (F.size(F.array_except("outputs", "have")) == 0)
    forced = F.lit(False)
    if force_from is not None:
        first = stages.filter(F.col("name") == force_from).select("ord").first()
        if first is None:
            raise ValueError(f"no stage {force_from}")
        forced = F.col("ord") >= first.ord
    return rows.select(*stages.columns, (~done | forced).alias("runs"))


def missing_inputs(planned: DataFrame, existing: DataFrame) -> DataFrame:
    """name, file: inputs of stages to run that neither exist nor are made by an earlier stage to run."""
    runs = planned.filter("runs")
    made = runs.select("ord", F.explode("outputs").alias("file")).select(F.col("ord").alias("by"), "file")
    wanted = runs.select("ord", "name", F.explode("inputs").alias("file")).join(existing, "file", "left_anti")
    return wanted.join(made, (wanted["file"] == made["file"]) & (made["by"] < wanted["ord"]), "left_anti").select("name", "file")


def run(spark: SparkSession, root: str, functions: dict[str, Callable[[SparkSession, str], dict[str, DataFrame]]], order: Sequence[str], force_from: str | None = None) -> list[str]:
    """Run stages in order, each writing its tables under root; complete ones are skipped. The names that ran.

    A table is complete when its _STAGE marker is there, which the file system of the root is asked for.
    """
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()

    def complete(name: str) -> bool:
        path = jvm.org.apache.hadoop.fs.Path(f"{root}/{name}/_STAGE")
        return path.getFileSystem(conf).exists(path)

    if force_from is not None and force_from not in order:
        raise ValueError(f"no stage {force_from}")
    ran, forced = [], False
    for name in order:
        forced = forced or name == force_from
        if complete(name) and not forced:
            continue
        for table, df in functions[name](spark, root).items():
            df.write.mode("overwrite").parquet(f"{root}/{name}/{table}")
        path = jvm.org.apache.hadoop.fs.Path(f"{root}/{name}/_STAGE")
        path.getFileSystem(conf).create(path, True).close()
        ran.append(name)
    return ran
