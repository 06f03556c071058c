"""Order-dependent choices as folds over a sorted array: they stay in the JVM, one array per group.

A group is a shot's box pairs: some hundred structs at most.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType


def _sortable(df: DataFrame) -> tuple[DataFrame, list[Column]]:
    """The table with its maps as arrays of entries, by which rows can be sorted, and the columns as they were."""
    maps = [f.name for f in df.schema if isinstance(f.dataType, MapType)]
    return df.withColumns({c: F.map_entries(c) for c in maps}), [F.map_from_entries(c).alias(c) if c in maps else F.col(c) for c in df.columns]


def greedy_pairs(df: DataFrame, keys: Sequence[str], order: Sequence[Column], left: str, right: str) -> DataFrame:
    """Greedy one-to-one match: pairs in the given total order, each left and right side once in a group."""
    names = [f"__o{i}" for i in range(len(order))]
    rows, back = _sortable(df)
    start = F.array().cast(rows.select(F.array(F.struct(*rows.columns)).alias("x")).schema["x"].dataType)
    rows = rows.withColumns(dict(zip(names, order, strict=True)))
    item = F.struct(*names, F.struct(*df.columns).alias("__row"))

    def step(taken: Column, x: Column) -> Column:
        used = F.exists(taken, lambda t: (t[left] == x["__row"][left]) | (t[right] == x["__row"][right]))
        return F.when(used, taken).otherwise(F.concat(taken, F.array(x["__row"])))

    groups = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(item)).alias("__items"))
    return groups.select(F.explode(F.aggregate("__items", start, step)).alias("__row")).select("__row.*").select(*back)
