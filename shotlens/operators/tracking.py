"""Greedy tracking of boxes through the sampled frames of a shot."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class TrackRules:
    max_gap: int = 2
    least_iou: float = 0.30
    most_centre: float = 0.20
    least_length: int = 3


def _iou(a: tuple, b: tuple) -> float:
    both = max(0.0, min(a[2], b[2]) - max(a[0], b[0])) * max(0.0, min(a[3], b[3]) - max(a[1], b[1]))
    union = sum(max(0.0, x[2] - x[0]) * max(0.0, x[3] - x[1]) for x in (a, b)) - both
    return both / union if union > 0 else 0.0


class Tracker:
    """Boxes of one shot in the order of frames and, within a frame, of falling confidence. A box joins the live track with
    the best overlap less centre distance; a track takes one box a frame and lives for max_gap frames without one."""

    def __init__(self, rules: TrackRules, width: float, height: float):
        self.rules, self.diagonal = rules, math.hypot(max(width, 1.0), max(height, 1.0))
        self.live: dict[int, tuple[int, tuple]] = {}  # frame and box of each track that may go on, in the order of the tracks
        self.tracks, self.now = 0, -math.inf

    def add(self, frame: int, box: tuple) -> int:
        if frame != self.now:
            self.now = frame
            self.live = {k: x for k, x in self.live.items() if frame - x[0] <= self.rules.max_gap + 1}
        best, found = -math.inf, -1
        for k, (seen, at) in self.live.items():
            if frame == seen:
                continue
            overlap = _iou(box, at)
            far = math.hypot((box[0] + box[2] - at[0] - at[2]) / 2, (box[1] + box[3] - at[1] - at[3]) / 2) / self.diagonal
            if overlap < self.rules.least_iou and far > self.rules.most_centre:
                continue
            if overlap - far > best:
                best, found = overlap - far, k
        if found < 0:
            found = self.tracks
            self.tracks += 1
        self.live[found] = frame, box
        return found


def track_boxes(df: DataFrame, keys: Sequence[str], frame: str, box: Sequence[str], confidence: str, order: str, width: float, height: float, rules: TrackRules = TrackRules()) -> DataFrame:
    """Every box of a track of at least `least_length` boxes, with local_track_id (trk_000 ...), track_len and track_conf.

    Shots are dealt to tasks and streamed in the order of frames, so that a task holds one shot's live tracks and a batch
    of boxes at a time, however long a shot is; `order` breaks ties of confidence."""
    cols = [*keys, frame, *box, confidence, order]
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in cols)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shot, tracker = None, None
        for part in batches:
            ids = []
            for key, f, b in zip(part[list(keys)].itertuples(index=False, name=None), part[frame].tolist(), part[list(box)].itertuples(index=False, name=None), strict=True):
                if key != shot:
                    shot, tracker = key, Tracker(rules, width, height)
                ids.append(f"trk_{tracker.add(f, b):03d}")
            yield part.assign(local_track_id=ids)

    rows = df.select(*cols).repartition(*keys).sortWithinPartitions(*keys, frame, F.desc(confidence), order)
    placed = rows.mapInPandas(run, f"{kinds}, local_track_id string")
    by = Window.partitionBy(*keys, "local_track_id")
    return placed.withColumns({"track_len": F.count("*").over(by), "track_conf": F.avg(confidence).over(by)}).where(F.col("track_len") >= rules.least_length)
