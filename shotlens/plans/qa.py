"""Reports on the final table: summaries, comparisons, audit samples, precision of reviewed labels, direction calibration."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shotlens.operators.sampling import bucket_sample, quotas

METRICS = ("assigned", "unknown", "ambiguous", "rejected", "low_score", "low_margin")
#: Audit buckets and their sizes.
AUDIT = {"assigned": 30, "low_score": 30, "low_margin": 30, "unknown": 20, "ambiguous": 20}
PRECISION_GATE = 0.80


def group_summary(df: DataFrame, groups: Sequence[str], means: Sequence[str], digits: int = 6) -> DataFrame:
    return df.groupBy(*groups).agg(F.count("*").alias("row_count"), *(F.round(F.avg(F.coalesce(c, F.lit(0.0))), digits).alias(f"mean_{c}") for c in means))


def inferred_status(status: Column, reason: Column) -> Column:
    r = F.coalesce(reason, F.lit(""))
    return F.coalesce(F.nullif(status, F.lit("")), F.when(r.isin("", "assigned"), "assigned").when(r == "low_margin", "ambiguous").when(r == "low_score", "rejected").when(r.isin("gaze_quality_unknown", "no_candidate"), "unknown"))


def status_counts(df: DataFrame, status: str = "proxy_status", reason: str = "failure_reason") -> DataFrame:
    """metric, n for all METRICS."""
    s, r = inferred_status(F.col(status), F.col(reason)), F.col(reason)
    one = df.agg(*(F.count_if((r if m.startswith("low_") else s) == m).alias(m) for m in METRICS))
    return one.select(F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("n")) for m in METRICS))).alias("x")).select("x.*")


def compare(before: DataFrame, after: DataFrame) -> DataFrame:
    b, a = status_counts(before).withColumnRenamed("n", "before"), status_counts(after).withColumnRenamed("n", "after")
    return b.join(a, "metric", "full").select("metric", "before", "after", (F.col("after") - F.col("before")).alias("delta"))


def audit_samples(final: DataFrame, key: str, seed: int = 13, sizes: dict[str, int] | None = None) -> DataFrame:
    sizes = sizes or AUDIT
    return bucket_sample(final, {b: ((F.col("failure_reason") if b.startswith("low_") else F.col("proxy_status")) == b, n) for b, n in sizes.items()}, key, seed)


def label_precision(labels: DataFrame, groups: Sequence[str], label: str = "human_label", bucket: str | None = "sample_bucket") -> DataFrame:
    """Reviewed rows per group: counts, precision, and whether it passes the gate (which holds for the assigned bucket)."""
    got = labels.where(F.trim(F.coalesce(label, F.lit(""))) != "").groupBy(*groups).agg(F.count("*").alias("reviewed_count"), F.count_if(F.col(label) == "correct").alias("correct_count"), *(F.count_if(F.col(label) == x).alias(f"{x}_count") for x in ("wrong_target", "bad_identity", "bad_frame_or_track")))
    p = F.col("correct_count") / F.col("reviewed_count")
    gate = p >= PRECISION_GATE if bucket is None else (F.col(bucket) != "assigned") | (p >= PRECISION_GATE)
    return got.withColumns({"precision": F.round(p, 6), "sft_ready": gate})


def conflict(gaze: Column, pose: Column) -> Column:
    return gaze.isin("left", "right") & pose.isin("left", "right") & (gaze != pose)


def agreement(measured: Column, human: Column) -> Column:
    """True or false where both are directions, else null."""
    return F.when(human.isin("left", "right", "center") & measured.isin("left", "right", "center"), measured == human)


def calibration(df: DataFrame, human: str, gaze: str, pose: str, groups: Sequence[str] = ()) -> DataFrame:
    """How often measured directions agree with a reviewer's; a sign is likely flipped where most disagree."""
    rows = df.where(F.trim(F.coalesce(human, F.lit(""))) != "")
    judged = ~F.col(human).isin("unclear", "bad_track", "up", "down")
    g, p = F.when(judged, agreement(F.col(gaze), F.col(human))), F.when(judged, agreement(F.col(pose), F.col(human)))
    both = lambda c: (F.col(human) == "center") & (F.col(c) == "center")
    rate = lambda c: F.round(F.try_divide(F.count_if(c), F.count(c)), 6)
    return rows.groupBy(*groups).agg(
        F.count("*").alias("reviewed_count"), F.count_if(F.col(human) == "bad_track").alias("bad_track_count"), F.count_if(F.col(human) == "unclear").alias("unclear_count"), rate(g).alias("gaze_lr_accuracy"), rate(p).alias("pose_lr_accuracy"),
        F.count_if(both(gaze)).alias("gaze_center_agreement"), F.count_if(both(pose)).alias("pose_center_agreement"), F.count_if(conflict(F.col(gaze), F.col(pose))).alias("gaze_pose_conflict_count"),
        (F.count_if(~g) > F.count_if(g)).alias("likely_gaze_sign_flipped"), (F.count_if(~p) > F.count_if(p)).alias("likely_pose_sign_flipped"),
    )


def evidence_rows(samples: DataFrame, evidence: DataFrame, keys: Sequence[str], order: Sequence[Column | str] = ()) -> DataFrame:
    """Every sample with what another source says about it; of several rows with its keys (movie, sequence, shot and bin)
    the last in `order`, then by all other columns."""
    rest = [c for c in evidence.columns if c not in keys]
    first = evidence.groupBy(*keys).agg(F.max(F.struct(*(F.expr(c) if isinstance(c, str) else c for c in order), F.struct(*rest).alias("__row")))["__row"].alias("__row"))
    return samples.join(first.select(*keys, "__row.*"), list(keys), "left")


def audit_rows(samples: DataFrame, related: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The rows of a related table (candidates, boxes of a track) that belong to each sample, with its sample_index and
    sample_bucket and `row_no`, their place (from 0) in the sample in `order`; a row of several samples is there for each.
    Samples without such rows have none."""
    few = samples.select(*keys, "sample_index", "sample_bucket")
    place = F.row_number().over(Window.partitionBy("sample_index").orderBy(*order)) - 1
    return related.join(few, list(keys)).withColumn("row_no", place.cast("long"))


def evidence_summary(rows: DataFrame, groups: Sequence[str], seen: str, agrees: Column, quota: int) -> DataFrame:
    """For each group: samples, those with evidence in `seen`, those that agree, those without, and how many the quota lacks."""
    return rows.groupBy(*groups).agg(F.count("*").alias("samples"), F.count(seen).alias("reviewed"), F.count_if(agrees).alias("agree"), F.count_if(F.col(seen).isNull()).alias("missing"), F.greatest(F.lit(0).cast("long"), quota - F.count(seen)).alias("shortfall"))


def note_priority(note: Column, gaze: Column, pose: Column, quality: Column) -> Column:
    n = F.lower(F.coalesce(note, F.lit("")))
    plus = lambda c, x: F.when(c, x).otherwise(0)
    return plus(F.contains(n, F.lit("gaze/head")) | F.contains(n, F.lit("direction")), 8) + plus(F.contains(n, F.lit("x=left")) & F.contains(n, F.lit("pose=right")), 8) + plus(conflict(gaze, pose), 5) + plus(quality == "gaze_reliable", 2) + plus(quality == "pose_fallback", 1)


def comparison_samples(samples: DataFrame, key: str, order: str) -> tuple[DataFrame, DataFrame]:
    """Ten assigned, five wrong targets (filled up with assigned rows of high risk), five low scores, five low margins."""
    wrong = F.col("human_label") == "wrong_target"
    risky = (F.col("gaze_direction_bucket") != F.col("pose_direction_bucket")) | F.col("gaze_direction_bucket").isin("left", "right") | F.col("pose_direction_bucket").isin("left", "right")
    there = samples.where(wrong).select(key).distinct().limit(5).count()
    reserved = samples.where(wrong).select(F.col(key), F.lit(True).alias("__wrong")).distinct()
    rows = samples.join(reserved, key, "left")
    bucket = F.col("sample_bucket")
    parts = [("assigned", (bucket == "assigned") & F.col("__wrong").isNull(), 10), ("wrong_target", wrong, 5), ("assigned_high_risk", (bucket == "assigned") & risky, 5 - there), ("low_score", bucket == "low_score", 5), ("low_margin_ambiguous", bucket.isin("low_margin", "ambiguous"), 5)]
    rank = note_priority(F.col("human_notes"), F.col("gaze_direction_bucket"), F.col("pose_direction_bucket"), F.col("gaze_quality"))
    chosen, short = quotas(rows, key, parts, rank, order)
    return chosen.drop("__wrong"), short


def top_up(reviewed: DataFrame, rest: DataFrame, key: str, rank: Column, order: str, most: int) -> DataFrame:
    """All reviewed rows first, then others by falling rank, `most` in all."""
    both = reviewed.withColumns({"__src": F.lit(0), "__rank": F.lit(0)}).unionByName(rest.join(reviewed.select(key), key, "left_anti").withColumns({"__src": F.lit(1), "__rank": rank}))
    return both.orderBy("__src", F.desc("__rank"), order).limit(most).drop("__src", "__rank")
