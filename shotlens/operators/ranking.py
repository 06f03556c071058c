"""Row numbers, top-k, margins, and lookups that keep the first or last duplicate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def number_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], name: str, start: int = 0) -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1 + start)


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], k: int, name: str = "rank") -> DataFrame:
    """The first k rows of each group, numbered from 1. Spark cuts each partition to k a group before the shuffle."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= k)


def keep_last(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Of rows with equal keys the last by `order`, as a lookup that later rows overwrite. An aggregate: no sort, and
    combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("__r")).select(*keys, "__r.*")


def keep_first(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(order)).alias("__r")).select(*keys, "__r.*")


def top_two(df: DataFrame, keys: Sequence[str], score: str, order: Sequence[str], take: Sequence[str], missing: float = 0.0) -> DataFrame:
    """For each group the row of the best (score, then `order`, all falling), the second score and the margin."""
    ranked = df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(score, *order, *[c for c in take if c not in (score, *order)])), asc=False).alias("__s"), F.count("*").alias("candidate_count"))
    top, second = F.col("__s")[0], F.try_element_at("__s", F.lit(2))
    return ranked.select(*keys, *(top[c].alias(c) for c in take), top[score].alias("top_score"), F.coalesce(second[score], F.lit(missing)).alias("second_score"), (top[score] - F.coalesce(second[score], F.lit(missing))).alias("score_margin"), "candidate_count")


def argmax_first_seen(df: DataFrame, keys: Sequence[str], value: str, weight: Column, order: str) -> DataFrame:
    """For each key the value with the largest sum of weights (`n`), of equal ones the one seen first; `total` is the
    key's whole weight."""
    sums = df.groupBy(*keys, value).agg(F.sum(weight).alias("n"), F.min(order).alias("__first"))
    return sums.groupBy(*keys).agg(F.max_by(F.struct(value, "n"), F.struct(F.col("n"), -F.col("__first"))).alias("__b"), F.sum("n").alias("total")).select(*keys, F.col(f"__b.{value}").alias(value), F.col("__b.n").alias("n"), "total")
