"""Set operations on tables and arrays."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def union_all(*tables: DataFrame) -> DataFrame:
    """All rows; the columns are the ordered union of all, missing ones null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def set_columns(a: str, b: str) -> list[Column]:
    """Sorted intersection, difference and union of two array columns, and whether they overlap."""
    return [F.sort_array(F.array_intersect(a, b)).alias("both"), F.sort_array(F.array_except(a, b)).alias("only_a"), F.sort_array(F.array_union(a, b)).alias("either"), F.arrays_overlap(a, b).alias("overlap")]


def distinct_pairs(a: str | Column, b: str | Column) -> Column:
    return F.count_distinct(a, b)
