"""Driver queries of the engine's own operators and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shotlens.catalog import relational, script, stages, video

_PARTS = (script, relational, video, stages)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for part in _PARTS for name, (f, _) in part.Q.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in _PARTS for name, (_, sql) in part.Q.items() if sql}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["timebin_quality"](spark, sf_dir)
