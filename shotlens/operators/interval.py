"""Joins of points with intervals, by equi-joins on covered places or on bins of a constant width."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def expand(df: DataFrame, low: str, high: str, place: str) -> DataFrame:
    """A row for each whole number from low to high; none where the interval is empty or null."""
    return df.where(F.col(low) <= F.col(high)).withColumn(place, F.explode(F.sequence(F.col(low), F.col(high))))


def overlay(points: DataFrame, ranges: DataFrame, keys: Sequence[str], place: str, low: str, high: str, take: Sequence[str], order: str) -> DataFrame:
    """Every point with columns of the range [low, high] of whole places that covers it; of several the last by `order`.

    The ranges are expanded to places, so that the join is an equi-join; meant for short ranges (alignment spans, shot
    windows)."""
    covered = expand(ranges, low, high, "__place").groupBy(*keys, "__place").agg(F.max_by(F.struct(*take), F.col(order)).alias("__hit"))
    return points.join(covered.withColumnRenamed("__place", place), [*keys, place], "left").select(*points.columns, *(F.col("__hit")[c].alias(c) for c in take))


def contained(points: DataFrame, ranges: DataFrame, keys: Sequence[str], at: str, low: str, high: str, width: float) -> DataFrame:
    """Pairs of points and ranges with low <= at < high. Both go to bins of `width`; a range is copied to each bin that it
    touches, so that wide ranges want a wide bin."""
    b = lambda c: F.floor(F.col(c) / F.lit(float(width))).cast("long")
    p = points.withColumn("__bin", b(at))
    r = ranges.withColumn("__bin", F.explode(F.sequence(b(low), b(high))))
    return p.join(r, [*keys, "__bin"]).where((F.col(at) >= F.col(low)) & (F.col(at) < F.col(high))).drop("__bin")


def collect_range(ranges: DataFrame, points: DataFrame, keys: Sequence[str], place: str, low: str, high: str, fields: Sequence[str], name: str) -> DataFrame:
    """Every range with its points' structs (place first, then fields) in the order of their places; an empty list if none."""
    parts = expand(ranges.select(*keys, low, high).distinct(), low, high, place).join(points, [*keys, place]).groupBy(*keys, low, high).agg(F.sort_array(F.collect_list(F.struct(place, *fields))).alias(name))
    kind = parts.schema[name].dataType
    return ranges.join(parts, [*keys, low, high], "left").withColumn(name, F.coalesce(F.col(name), F.array().cast(kind)))
