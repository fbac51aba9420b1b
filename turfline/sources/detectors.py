"""The seam for model inference: a detector is any callable that turns a batch of frames into rows of detections."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from turfline.operators.projection import remap_classes

DETECTIONS = "clip string, frame bigint, det_ix int, x1 double, y1 double, x2 double, y2 double, confidence double, name string"

KEEP = object()


class Tracker(Protocol):
    """What follows boxes from frame to frame."""

    def move(self, affine: np.ndarray) -> None:
        """Take the tracks along with the camera."""

    def step(self, boxes: np.ndarray, confidence: np.ndarray) -> list[int]:
        """Track id of each box of the next frame, or 0."""


class Renderer(Protocol):
    """What turns positions into rows to draw."""

    def __call__(self, players: DataFrame, ball: DataFrame, labels: DataFrame, kits: DataFrame) -> DataFrame: ...


@dataclass(frozen=True)
class Detector:
    """A registered detector with its options."""

    name: str
    imgsz: int | None = None
    conf: float | None = None
    ball_conf: float | None = None

    def reconfigured(self, imgsz: int | None = None, conf: float | None = None, ball_conf: float | None | object = KEEP) -> Detector:
        """The same model with other thresholds. None keeps a value, but for ball_conf, where it means no floor."""
        ball_conf = self.ball_conf if ball_conf is KEEP else ball_conf
        return replace(self, imgsz=self.imgsz if imgsz is None else imgsz, conf=self.conf if conf is None else conf, ball_conf=ball_conf)

    def detect(self, frames: DataFrame) -> DataFrame:
        """Detections, with class ids; the ball's own floor applies."""
        options = {k: v for k, v in (("imgsz", self.imgsz), ("conf", self.conf)) if v is not None}
        return remap_classes(detect(frames, self.name, **options), self.ball_conf)


def resolve_device(preference: str = "auto", available: tuple[str, ...] = ()) -> str:
    """The device of a worker: the preferred one, or the first of cuda and mps that is there, or the processor."""
    if preference != "auto":
        return preference
    return next((d for d in ("cuda", "mps") if d in available), "cpu")


_known: dict[str, Callable[..., Callable[[pd.DataFrame], pd.DataFrame]]] = {}


def register(name: str):
    """Register a factory: called once a task with the options, it returns the detector."""

    def keep(factory: Callable[..., Callable[[pd.DataFrame], pd.DataFrame]]):
        _known[name] = factory
        return factory

    return keep


def detect(frames: DataFrame, name: str, **options) -> DataFrame:
    """Detections of frames (clip, frame and whatever the detector reads), by Arrow batches."""
    if name not in _known:
        raise ValueError(f"no detector {name}")
    factory = _known[name]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        detector = factory(**options)
        for batch in batches:
            yield detector(batch)

    return frames.mapInPandas(run, DETECTIONS)
