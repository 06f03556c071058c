"""The greedy tracker on a stream of boxes, with keyed state and event-time timers.

Boxes wait in a shot's state until the watermark has passed their frame, whatever the order of the files; then they go
through the tracker in the order of frames. Beside them the state holds the live tracks only: a timer ends a track when no
frame that could go on with it can come any more, and its length and mean confidence are sent."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from shotlens.operators.tracking import Tracker, TrackRules
from shotlens.session import ship

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SIDES = "x1 double, y1 double, x2 double, y2 double"
OUT = "frame long, box_id long, track int, track_len long, track_conf double"


class LiveTracker(StatefulProcessor):
    """Rows (key, ms, frame, box_id, x1, y1, x2, y2, conf) in; a row for each box with its track, and one without a frame
    for each track that ended."""

    def __init__(self, key: str, rules: TrackRules, width: float, height: float, frame_ms: int):
        self.key, self.rules, self.width, self.height, self.frame_ms = key, rules, width, height, frame_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", f"ms long, rank double, box_id long, frame long, conf double, {SIDES}")
        self.live = handle.getListState("live", f"track int, frame long, ms long, {SIDES}, track_len long, conf_sum double, conf_n long")
        self.seen = handle.getValueState("seen", "tracks int, upto long")

    def _ends(self, ms: int) -> int:
        """From when on no frame can come that goes on with a track last seen at `ms`."""
        return ms + (self.rules.max_gap + 1) * self.frame_ms + 1

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        # Each call of the state is a message to the JVM: one for all rows of a batch, and a timer for the first frame only.
        new = []
        for part in rows:
            for ms, frame, box_id, x1, y1, x2, y2, conf in zip(*(part[c].tolist() for c in ("ms", "frame", "box_id", "x1", "y1", "x2", "y2", "conf")), strict=True):
                known = conf is not None and conf == conf
                new.append((int(ms), -float(conf) if known else float("inf"), int(box_id), int(frame), float(conf) if known else None, float(x1), float(y1), float(x2), float(y2)))
        if new:
            self.waiting.appendList(new)
            self.handle.registerTimer(min(x[0] for x in new))
        yield self._rows(key, [])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        made, upto = self.seen.get() or (0, -1)
        if upto >= mark:  # an earlier timer of this batch has done it all
            yield self._rows(key, [])
            return
        boxes = {tuple(x[:3]): tuple(x[3:]) for x in self.waiting.get()}
        due = sorted((k, v) for k, v in boxes.items() if k[0] <= mark)
        rest = [(*k, *v) for k, v in boxes.items() if k[0] > mark]
        tracks = {x[0]: list(x[1:]) for x in self.live.get()}
        tracker = Tracker(self.rules, self.width, self.height)
        tracker.tracks, tracker.live = made, {no: (t[0], tuple(t[2:6])) for no, t in sorted(tracks.items())}
        out = []
        for (ms, _, box_id), (frame, conf, *box) in due:
            no = tracker.add(frame, tuple(box))
            before = tracks.get(no, [None] * 6 + [0, 0.0, 0])
            tracks[no] = [frame, ms, *box, before[6] + 1, before[7] + (conf or 0.0), before[8] + (conf is not None)]
            out.append((frame, box_id, no, None, None))
        kept = []
        for no, t in sorted(tracks.items()):
            if no not in tracker.live or self._ends(t[1]) <= mark:
                out.append((None, None, no, t[6], t[7] / t[8] if t[8] else None))
            else:
                kept.append((no, *t))
        for state, now in ((self.waiting, rest), (self.live, kept)):
            if now:
                state.put(now)
            else:
                state.clear()
        later = [x[0] for x in rest] + [self._ends(x[2]) for x in kept]
        if later:  # the next timer does all that is due then
            self.handle.registerTimer(min(later))
        self.seen.update((tracker.tracks, mark))
        yield self._rows(key, out)

    def _rows(self, key: tuple, out: list[tuple]) -> pd.DataFrame:
        names = [x.split()[0] for x in OUT.split(", ")]
        df = pd.DataFrame(out, columns=names).astype({"frame": "Int64", "box_id": "Int64", "track": "Int32", "track_len": "Int64", "track_conf": "Float64"})
        df.insert(0, self.key, pd.Series([key[0]] * len(out), dtype=object))
        return df

    def close(self) -> None:
        pass


@contextmanager
def keyed_state(spark: SparkSession):
    """Streams that are started inside keep their state in RocksDB, which keyed state and timers need."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


def live_tracks(rows: DataFrame, key: str, at: str, frame: str, box: Sequence[str], confidence: str, order: str, width: float, height: float, frame_ms: int, late: str, rules: TrackRules = TrackRules()) -> DataFrame:
    """The stream of boxes with their tracks, and of tracks that ended (`frame` null). Frames are `frame_ms` apart at least;
    a frame's boxes have one time `at`, after 1970 (before any watermark Spark
    takes that time for one); boxes that come more than `late` behind the latest time are dropped. `order` is a
    whole number that tells the boxes of a shot apart and breaks ties of confidence. Start it inside `keyed_state`."""
    ship(rows.sparkSession)
    timed = rows.withWatermark(at, late).select(key, at, F.unix_millis(at).alias("ms"), F.col(frame).cast("long").alias("frame"), F.col(order).cast("long").alias("box_id"), *(F.col(c).cast("double").alias(n) for c, n in zip(box, ("x1", "y1", "x2", "y2"), strict=True)), F.col(confidence).cast("double").alias("conf"))
    kind = rows.schema[key].dataType.simpleString()
    return timed.groupBy(key).transformWithStateInPandas(LiveTracker(key, rules, width, height, frame_ms), f"`{key}` {kind}, {OUT}", "append", "eventTime")


def finished_tracks(sent: DataFrame, key: str, least_length: int) -> DataFrame:
    """From what live_tracks has sent: the boxes of ended tracks of at least `least_length` boxes, as track_boxes has them."""
    ended = sent.where("frame IS NULL").where(F.col("track_len") >= least_length).select(key, "track", "track_len", "track_conf")
    return sent.where("frame IS NOT NULL").select(key, "frame", "box_id", "track").join(ended, [key, "track"]).withColumn("local_track_id", F.format_string("trk_%03d", "track")).drop("track")
