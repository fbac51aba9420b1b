"""Online association of boxes to tracks: two passes over a frame's detections, by overlap with the tracks' boxes moved
along with the camera. A table is one group a clip, a stream keeps the tracks as state; frames come in order."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from turfline import config as C
from turfline.operators import projection
from turfline.operators.stitch import assign

TRACKS = "clip string, frame long, row_ix int, track_id long, x1 double, y1 double, x2 double, y2 double, confidence double, class_id int"
STATE = "last long, tracks string"
BOX = ["x1", "y1", "x2", "y2"]


def overlap(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Intersection over union of every box of a with every box of b."""
    inner = np.maximum(np.minimum(a[:, 2, None], b[:, 2]) - np.maximum(a[:, 0, None], b[:, 0]), 0)
    inner = inner * np.maximum(np.minimum(a[:, 3, None], b[:, 3]) - np.maximum(a[:, 1, None], b[:, 1]), 0)
    area = lambda x: (x[:, 2] - x[:, 0]) * (x[:, 3] - x[:, 1])
    return inner / np.maximum(area(a)[:, None] + area(b) - inner, 1e-12)


def _linked(edges: list[tuple[int, int]]) -> list[tuple[list[int], list[int]]]:
    """The connected parts of a two-sided graph, as sorted ends on both sides."""
    of_a: dict[int, list[int]] = {}
    of_b: dict[int, list[int]] = {}
    for i, j in edges:
        of_a.setdefault(i, []).append(j)
        of_b.setdefault(j, []).append(i)
    parts = []
    while of_a:
        i, js = of_a.popitem()
        left, right, todo = [i], set(js), list(js)
        while todo:
            for k in of_b[todo.pop()]:
                if k in of_a:
                    left.append(k)
                    more = [j for j in of_a.pop(k) if j not in right]
                    right.update(more)
                    todo += more
        parts.append((sorted(left), sorted(right)))
    return parts


def match(a: np.ndarray, b: np.ndarray, most: float) -> list[tuple[int, int]]:
    """One-to-one pairs, as many as can be and of least total distance (one minus overlap), none above `most`.

    Boxes that no allowed pair links, even through others, do not bear on each other: each linked part is solved alone.
    """
    if not len(a) or not len(b):
        return []
    distance = 1 - overlap(a, b)
    rows, columns = np.nonzero(distance <= most)
    edges = list(zip(rows.tolist(), columns.tolist(), strict=True))
    if len({i for i, _ in edges}) == len({j for _, j in edges}) == len(edges):
        return edges
    pairs = []
    for left, right in _linked(edges):
        if len(left) == len(right) == 1:
            pairs.append((left[0], right[0]))
            continue
        n = max(len(left), len(right))
        part = distance[np.ix_(left, right)]
        cost = np.full((n, n), 1e3)
        cost[: len(left), : len(right)] = np.where(part <= most, part, 1e3)
        pairs += [(left[i], right[j]) for i, j in enumerate(assign(cost)[: len(left)]) if j < len(right) and part[i, j] <= most]
    return sorted(pairs)


class Tracks:
    """Living tracks of a clip: ids, boxes, frames since last seen."""

    def __init__(self, cfg: C.Tracking, packed: str | None = None) -> None:
        self.cfg = cfg
        rows, self.next_id = ([], 1) if packed is None else json.loads(packed)
        self.ids, self.lost = np.array([r["id"] for r in rows], np.int64), np.array([r["lost"] for r in rows], np.int64)
        self.boxes = np.array([r["box"] for r in rows], float).reshape(-1, 4)

    def pack(self) -> str:
        rows = zip(self.ids.tolist(), self.boxes.tolist(), self.lost.tolist(), strict=True)
        return json.dumps([[{"id": i, "box": box, "lost": lost} for i, box, lost in rows], self.next_id])

    def move(self, affine: np.ndarray) -> None:
        self.boxes = (self.boxes.reshape(-1, 2, 2) @ affine[:, :2].T + affine[:, 2]).reshape(-1, 4)

    def step(self, boxes: np.ndarray, confidence: np.ndarray) -> list[int]:
        """Track id of each detection, or 0."""
        cfg, ids = self.cfg, np.zeros(len(boxes), np.int64)
        open_tracks = np.arange(len(self.ids))
        for low, high, most in ((cfg.track_high_thresh, np.inf, cfg.match_thresh), (cfg.track_low_thresh, cfg.track_high_thresh, 0.5)):
            at = np.flatnonzero((confidence >= low) & (confidence < high))
            pairs = match(self.boxes[open_tracks], boxes[at], most)
            if pairs:
                i, j = map(list, zip(*pairs, strict=True))
                found, seen = open_tracks[i], at[j]
                self.boxes[found], self.lost[found] = boxes[seen], -1
                ids[seen] = self.ids[found]
                open_tracks = np.delete(open_tracks, i)
        self.lost += 1
        new = np.flatnonzero((ids == 0) & (confidence >= cfg.new_track_thresh))
        ids[new] = np.arange(self.next_id, self.next_id + len(new))
        self.next_id += len(new)
        kept = np.flatnonzero(self.lost <= cfg.track_buffer)
        self.ids, self.lost = np.concatenate([self.ids[kept], ids[new]]), np.concatenate([self.lost[kept], np.zeros(len(new), np.int64)])
        self.boxes = np.concatenate([self.boxes[kept], boxes[new]])
        return ids.tolist()


def _run(clip: str, pdf: pd.DataFrame, last: int, tracks: Tracks) -> tuple[pd.DataFrame, int]:
    pdf = pdf[pdf["frame"] > last].sort_values(["frame", "det_ix"])
    frame, gmc, boxes, confidence = pdf["frame"].to_numpy(np.int64), pdf["gmc"].to_numpy(), pdf[BOX].to_numpy(float), pdf["confidence"].to_numpy(float)
    seen = pdf["x1"].notna().to_numpy() & (confidence >= tracks.cfg.min_conf)
    starts = np.unique(frame, return_index=True)[1].tolist()
    ids, row_ix = np.zeros(len(frame), np.int64), np.zeros(len(frame), np.int64)
    for start, stop in zip(starts, [*starts[1:], len(frame)], strict=False):
        if gmc[start] is not None:
            tracks.move(np.asarray(gmc[start], float).reshape(2, 3))
        at = np.flatnonzero(seen[start:stop]) + start
        ids[at] = tracks.step(boxes[at], confidence[at])
        kept = at[ids[at] != 0]
        row_ix[kept] = np.arange(len(kept))
    kept = np.flatnonzero(ids)
    columns = {"clip": clip, "frame": frame[kept], "row_ix": row_ix[kept], "track_id": ids[kept]} | {c: boxes[kept, k] for k, c in enumerate(BOX)}
    out = pd.DataFrame(columns | {"confidence": confidence[kept], "class_id": pdf["class_id"].to_numpy()[kept].astype(np.int64)})
    return out, int(frame[-1]) if len(frame) else last


def track_players(detections: DataFrame, spine: DataFrame, calibration: DataFrame, motion: DataFrame, cfg: C.Tracking = C.Tracking(), pitch: C.Pitch = C.Pitch()) -> DataFrame:
    """tracks of raw detections: people of enough confidence on the field, associated along the camera's motion.

    Every frame of the spine counts, so that a frame without detections ages the tracks.
    """
    people = projection.foot_points(detections, (C.GOALKEEPER, C.PLAYER, C.REFEREE), cfg.min_conf).select(*detections.columns)
    people = projection.off_field_mask(people, calibration, cfg.mask_margin_m, {C.REFEREE: cfg.mask_margin_referee_m}, pitch)
    rows = spine.select("clip", "frame").join(motion.select("clip", "frame", "gmc"), ["clip", "frame"], "left").join(people, ["clip", "frame"], "left")
    return track(rows.select("clip", "frame", "det_ix", *BOX, "confidence", "class_id", "gmc"), cfg)


def track(detections: DataFrame, cfg: C.Tracking = C.Tracking()) -> DataFrame:
    """tracks of detections with clip, frame, det_ix, x1 to y2, confidence, class_id and gmc (null: no motion).

    Class and field filters come before; a frame without detections is a row without a box, so that it ages the tracks.
    """

    def step(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, packed = state.get if state.exists else (-1, None)
        tracks = Tracks(cfg, packed)
        out, last = _run(key[0], pd.concat(list(pdfs)), last, tracks)
        state.update((last, tracks.pack()))
        yield out

    if detections.isStreaming:
        return detections.groupBy("clip").applyInPandasWithState(step, TRACKS, STATE, "append", GroupStateTimeout.NoTimeout)
    return detections.groupBy("clip").applyInPandas(lambda key, pdf: _run(key[0], pdf, -1, Tracks(cfg))[0], TRACKS)
