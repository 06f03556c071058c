"""Face tracks: summaries, crop envelopes and time bins of per-frame measurements."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shotlens.functions.numeric import clamp, even_int, finite_float, ratio, safe_float
from shotlens.functions.timecode import bin_index, frame_time

# Action units measured as intensities and as presence.
AU_R = ("AU01", "AU02", "AU04", "AU05", "AU06", "AU07", "AU09", "AU10", "AU12", "AU14", "AU15", "AU17", "AU20", "AU23", "AU25", "AU26", "AU45")
AU_C = ("AU04", "AU12", "AU25", "AU26", "AU45", "AU28", "AU06", "AU07")


@dataclass(frozen=True)
class BinRules:
    width: float = 0.5
    least_frames: int = 5
    least_ratio: float = 0.5
    least_confidence: float = 0.80
    digits: int = 6


def shot_detections(boxes: DataFrame, keys: Sequence[str], frame: str, confidence: str) -> DataFrame:
    return boxes.groupBy(*keys).agg(F.count_distinct(frame).alias("frames_with_faces"), F.count("*").alias("detections"), F.avg(confidence).alias("mean_conf"))


def track_summary(tracks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A shot's tracks: how many, the longest, and their boxes."""
    return tracks.groupBy(*keys).agg(F.count_distinct("local_track_id").alias("track_count"), F.max("track_len").alias("longest"), F.count("*").alias("boxes"))


def crop_envelope(boxes: DataFrame, keys: Sequence[str], width: Column, height: Column, margin: float = 0.35, time: str | None = None, clip: Column | None = None, padding: float = 0.25, bin_width: float = 0.5) -> DataFrame:
    """The square, even crop that holds all of a track's boxes with a margin, inside the frame; with `time` its seconds."""
    times = [F.min(time).alias("first_t"), F.max(time).alias("last_t")] if time else []
    e = boxes.groupBy(*keys).agg(F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"), F.count("*").alias("track_len"), F.avg("conf").alias("track_conf"), *times)
    w, h = width.cast("double"), height.cast("double")
    side = even_int(F.least(F.greatest(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")) * (1 + 2 * margin), w, h))
    e = e.withColumn("side", side)
    at = lambda a, b, size: even_int(F.greatest(F.lit(0.0), F.least((F.col(a) + F.col(b)) / 2 - F.col("side") / 2, size - F.col("side"))), 0)
    e = e.withColumns({"crop_x": at("x1", "x2", w), "crop_y": at("y1", "y2", h)})
    e = e.withColumns({"crop_w": even_int(F.least(F.col("side").cast("double"), w - F.col("crop_x"))), "crop_h": even_int(F.least(F.col("side").cast("double"), h - F.col("crop_y")))}).drop("side")
    if not time:
        return e
    start, end = F.greatest(F.lit(0.0), F.col("first_t") - padding), F.least(clip, F.col("last_t") + padding)
    return e.withColumns({"crop_start_sec": start, "crop_end_sec": F.when(end <= start, F.least(clip, start + bin_width)).otherwise(end)}).drop("first_t", "last_t")


def quality(n_valid: Column, valid_ratio: Column, conf_mean: Column, n_pose: Column, pose_ratio: Column, rules: BinRules = BinRules()) -> Column:
    reliable = (n_valid >= rules.least_frames) & (valid_ratio >= rules.least_ratio) & F.coalesce(conf_mean >= rules.least_confidence, F.lit(False))
    return F.when(reliable, "gaze_reliable").when((n_pose >= rules.least_frames) & (pose_ratio >= rules.least_ratio), "pose_fallback").otherwise("unknown")


def expression(r: dict[str, Column], c: dict[str, Column]) -> Column:
    """First that holds: smile, frown, open mouth, closed eyes; nulls hold nothing."""
    at = lambda x, least: F.coalesce(x >= least, F.lit(False))
    return (
        F.when(at(r["AU12"], 1.0) | at(c["AU12"], 0.5), "smile").when(at(r["AU04"], 1.0) | at(c["AU04"], 0.5), "concern_or_frown")
        .when(at(c["AU25"], 0.5) | at(c["AU26"], 0.5), "surprise_or_open_mouth").when(at(c["AU45"], 0.5), "blink_or_eyes_closed").otherwise("neutral_or_unknown")
    )


def shot_time(frames: DataFrame, at: str = "timestamp", frame: str = "frame", start: str = "crop_start_sec") -> Column:
    """Seconds of a frame in its shot: its time, or by 30 frames a second its number (0 without one), after the clip's start
    where the table has one."""
    number = finite_float(F.col(frame)) if frame in frames.columns else F.lit(None).cast("double")
    within = frame_time(finite_float(F.col(at)), number)
    return safe_float(F.col(start), 0.0) + within if start in frames.columns else within


def time_bins(frames: DataFrame, keys: Sequence[str], at: Column, rules: BinRules = BinRules(), au_r: Sequence[str] = (), au_c: Sequence[str] = (), pose: Sequence[str] = ("pose_Rx", "pose_Ry", "pose_Rz"), gaze: Sequence[str] = ("gaze_angle_x", "gaze_angle_y"), order: Sequence[str] = ()) -> DataFrame:
    """Tumbling bins of per-frame measurements: counts, ratios, mean and median confidence, mean and population deviation of
    gaze over valid frames and of pose over frames with all angles, action units over all frames, and the quality label.

    One hash aggregate that is combined before its shuffle (the median keeps a bin's values). Frames for which `at` is null go;
    `shot_time` gives frames without a time one by their number. With `order` (columns that tell a bin's frames apart) means are
    of sums in that order: without, the last bit of a mean, and so a label whose limit it meets exactly, hangs on the partitions."""
    num = lambda c: finite_float(F.col(c))
    valid = (safe_float(F.col("success"), 1.0).cast("int") == 1) & num("confidence").isNotNull()
    posed = F.lit(True)
    for c in pose:
        posed = posed & num(c).isNotNull()
    f = frames.withColumns({"bin_idx": bin_index(at, rules.width), "__v": valid, "__p": posed}).where("bin_idx IS NOT NULL")
    only = lambda flag, c: F.when(F.col(flag), num(c))
    r = lambda c: F.round(c, rules.digits)
    means = {"__conf": only("__v", "confidence")}
    aggs = [F.count("*").alias("n_frames_total"), F.count_if("__v").alias("n_frames_valid"), F.count_if("__p").alias("__n_pose"), r(F.median(only("__v", "confidence"))).alias("confidence_median")]
    for flag, cols in (("__v", gaze), ("__p", pose)):
        for c in cols:
            means[f"{c}_mean"] = only(flag, c)
            aggs.append(r(F.stddev_pop(only(flag, c))).alias(f"{c}_std"))
    means |= {f"{a}_r_mean": num(f"{a}_r") for a in au_r} | {f"{a}_c_ratio": num(f"{a}_c") for a in au_c}
    if order:
        aggs += [F.sort_array(F.collect_list(F.struct(*order, *(x.alias(f"__m{i}") for i, x in enumerate(means.values()))))).alias("__frames"), *(F.count(x).alias(f"__n{i}") for i, x in enumerate(means.values()))]
        total = lambda i: F.aggregate("__frames", F.lit(0.0), lambda s, x: s + F.coalesce(x[f"__m{i}"], F.lit(0.0)))
        out = f.groupBy(*keys, "bin_idx").agg(*aggs)
        out = out.withColumns({name: F.try_divide(total(i), F.col(f"__n{i}")) for i, name in enumerate(means)}).drop("__frames", *(f"__n{i}" for i in range(len(means))))
    else:
        out = f.groupBy(*keys, "bin_idx").agg(*aggs, *(F.avg(x).alias(name) for name, x in means.items()))
    out = out.withColumns({f"{c}_mean": r(F.col(f"{c}_mean")) for c in (*gaze, *pose)})
    vr, pr = ratio(F.col("n_frames_valid"), F.col("n_frames_total")), ratio(F.col("__n_pose"), F.col("n_frames_total"))
    out = out.withColumns({"gaze_quality": quality(F.col("n_frames_valid"), vr, F.col("__conf"), F.col("__n_pose"), pr, rules), "valid_ratio": r(vr), "confidence_mean": r(F.col("__conf")), "bin_start_sec": F.round(F.col("bin_idx") * rules.width, 3), "bin_end_sec": F.round((F.col("bin_idx") + 1) * rules.width, 3)})
    if au_r or au_c:
        missing = F.lit(None).cast("double")
        out = out.withColumn("expression_proxy", expression({a: F.col(f"{a}_r_mean") if a in au_r else missing for a in ("AU12", "AU04")}, {a: F.col(f"{a}_c_ratio") if a in au_c else missing for a in ("AU12", "AU04", "AU25", "AU26", "AU45")}))
    return out.drop("__n_pose", "__conf")


def present_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: for each column whether any row has a value, and the names of those."""
    some = df.agg(*(F.coalesce(F.bool_or(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) != ""), F.lit(False)).alias(c) for c in columns))
    return some.withColumn("present", F.filter(F.array(*(F.when(F.col(c), F.lit(c)) for c in columns)), lambda x: x.isNotNull()))


def clamped(boxes: DataFrame, width: float, height: float, least: float) -> DataFrame:
    """Boxes cut to the frame; those whose sides fall below `least` go."""
    b = boxes.withColumns({"x1": clamp(F.col("x1"), 0.0, width), "y1": clamp(F.col("y1"), 0.0, height), "x2": clamp(F.col("x2"), 0.0, width), "y2": clamp(F.col("y2"), 0.0, height)})
    return b.where((F.col("x2") - F.col("x1") >= least) & (F.col("y2") - F.col("y1") >= least))
