"""What video, face and language models have to offer, and fakes that answer from their input alone.

A provider takes and returns a DataFrame; a real one works in `mapInPandas` or `pandas_udf` on the executors."""

from __future__ import annotations

import re
import time
from collections.abc import Callable
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class VideoSource(Protocol):
    def info(self, clips: DataFrame) -> DataFrame:
        """clip_path -> fps, n_frames, width, height, duration."""

    def frames(self, clips: DataFrame, sample_fps: float) -> DataFrame:
        """clip_path -> frame_idx, sample_order, timestamp_sec, image."""


class FaceDetector(Protocol):
    def detect(self, frames: DataFrame) -> DataFrame:
        """Frames with boxes, det_conf and landmarks."""


class FaceEmbedder(Protocol):
    def embed(self, crops: DataFrame) -> DataFrame:
        """Crops with `embedding array<float>`."""


class GazeEstimator(Protocol):
    def estimate(self, crops: DataFrame) -> DataFrame:
        """Crops with frame, timestamp, success, confidence, gaze and pose angles and action units."""


class TextModel(Protocol):
    def complete(self, tasks: DataFrame, prompt: str, answer: str) -> DataFrame:
        """Tasks with an answer column."""


class FakeVideo:
    """Clips of 25 frames a second and 640 by 360, as long as their row says (column duration, else 4 s)."""

    def info(self, clips: DataFrame) -> DataFrame:
        d = F.coalesce(F.col("duration"), F.lit(4.0)) if "duration" in clips.columns else F.lit(4.0)
        return clips.withColumns({"fps": F.lit(25.0), "n_frames": F.floor(d * 25).cast("long"), "width": F.lit(640), "height": F.lit(360), "duration": d})

    def frames(self, clips: DataFrame, sample_fps: float = 5.0) -> DataFrame:
        return sample_frames(self.info(clips), sample_fps)


class FakeDetector:
    """Two faces a frame, side by side, that move by a pixel a frame."""

    def detect(self, frames: DataFrame) -> DataFrame:
        x = F.col("frame_idx").cast("double")
        face = lambda left, conf: F.struct((left + x).alias("x1"), F.lit(40.0).alias("y1"), (left + x + 60).alias("x2"), F.lit(100.0).alias("y2"), F.lit(conf).alias("det_conf"))
        return frames.select("*", F.explode(F.array(face(F.lit(40.0), 0.9), face(F.lit(400.0), 0.8))).alias("f")).select(*frames.columns, "f.*")


class FakeGaze:
    """Every crop looks to the left, surely."""

    def estimate(self, crops: DataFrame) -> DataFrame:
        angles = {c: F.lit(v) for c, v in (("gaze_angle_x", -0.5), ("gaze_angle_y", 0.0), ("pose_Rx", 0.0), ("pose_Ry", -0.4), ("pose_Rz", 0.0))}
        return crops.withColumns({"success": F.lit(1), "confidence": F.lit(0.95)} | angles)


class FakeText:
    """Answers that name no event: a valid object without a claim."""

    def complete(self, tasks: DataFrame, prompt: str = "prompt", answer: str = "answer") -> DataFrame:
        return tasks.withColumn(answer, F.when(F.col(prompt).isNotNull(), F.lit('{"events": []}')))


class FakeEmbedder:
    """Eight numbers from a hash of the crop's key."""

    def embed(self, crops: DataFrame, key: str = "crop_id") -> DataFrame:
        return crops.withColumn("embedding", F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: (F.pmod(F.xxhash64(F.col(key), i), F.lit(2001)) - 1000) / 1000.0))


def sample_frames(clips: DataFrame, sample_fps: float) -> DataFrame:
    """Every n-th frame of a clip, n = fps / sample_fps rounded and 1 at least: frame_idx, sample_order, timestamp_sec."""
    step = F.greatest(F.lit(1).cast("long"), F.bround(F.col("fps") / F.lit(sample_fps)).cast("long"))
    some = clips.where("n_frames > 0").withColumn("__step", step).select("*", F.posexplode(F.sequence(F.lit(0).cast("long"), F.col("n_frames") - 1, F.col("__step"))).alias("sample_order", "frame_idx"))
    return some.withColumn("timestamp_sec", F.col("frame_idx") / F.col("fps")).drop("__step")


def available(*modules: str) -> dict[str, bool]:
    """Which optional Python modules can be imported, without importing them."""
    import importlib.util

    return {m: importlib.util.find_spec(m) is not None for m in modules}


def with_retry(call: Callable[[], str], is_limit: Callable[[Exception], bool], wait: Callable[[Exception], float], attempts: int = 5, sleep: Callable[[float], None] = time.sleep) -> str:
    """The call's answer; an error that `is_limit` holds for is tried again after `wait` seconds, `attempts` times in all.
    Any other error, and the last one, is raised."""
    for attempt in range(attempts):
        try:
            return call()
        except Exception as e:
            if attempt == attempts - 1 or not is_limit(e):
                raise
            sleep(wait(e))
    raise ValueError("at least one attempt is needed")


def wait_seconds(message: str, default: float = 3.0) -> float:
    """The delay that an error's text asks for ("try again in 1.5s"), half a second at least."""
    found = re.search(r"try again in ([0-9.]+)\s*s", message, re.I)
    try:
        return max(0.5, float(found[1])) if found else max(0.5, default)
    except ValueError:
        return max(0.5, default)
