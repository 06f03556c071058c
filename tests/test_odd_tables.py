"""Queries over tables whose files have no order, or whose ids have gaps, against their SQL over the same rows."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.1"


def _twin(name: str, tables: dict[str, str]) -> set[tuple]:
    c = duckdb.connect()
    c.execute("SET threads = 1")
    for t, path in tables.items():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    return set(c.execute(entry.oracle_sql()[name]).fetchall())


def _ours(spark, name: str, folder: str) -> set[tuple]:
    return {tuple(r) for r in entry.queries()[name](spark, folder).collect()}


@pytest.mark.parametrize("name", ["timebin_quality", "expression_case"])
def test_labels_at_their_limit_do_not_hang_on_the_files(spark, tmp_path, name):
    events = spark.read.parquet(f"{SMALL}/events.parquet")
    events.repartition(7, F.xxhash64("event_id")).write.parquet(f"{tmp_path}/events.parquet")
    assert _ours(spark, name, str(tmp_path)) == _twin(name, {"events": f"{SMALL}/events.parquet"})


def test_a_table_that_ends_within_a_shot(spark, tmp_path):
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").where("vec_id < 30 OR vec_id = 41")
    rows.coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert _ours(spark, "single_speakers", str(tmp_path)) == _twin("single_speakers", {"embeddings": f"{tmp_path}/embeddings.parquet/*.parquet"})
