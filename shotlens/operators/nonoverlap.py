"""Greedy choice of ranges that share no place, for groups of any number of ranges.

Ranges that overlap, directly or through others, form an island; islands don't touch, so each is gone through apart from the
others, as a stream of rows in the order of choice. Beside a batch of rows a task holds the taken ranges of one island,
sorted: they share no place, so that one bisection tells whether a range is free.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shotlens.session import ship


class Taken:
    """Ranges that share no place, sorted."""

    def __init__(self) -> None:
        self.lows: list = []
        self.ends: dict = {}

    def add(self, low, high) -> bool:
        """Take a range if it shares no place with those taken."""
        k = bisect_right(self.lows, high)
        if k and self.ends[self.lows[k - 1]] >= low:
            return False
        insort(self.lows, low)
        self.ends[low] = high
        return True


def non_overlapping(df: DataFrame, keys: Sequence[str], order: Sequence[Column], low: str, high: str, most: int | None = None) -> DataFrame:
    """Greedy choice in the given order: a row is taken unless it shares a place in [low, high] with one taken before.

    `order` must be total (columns to sort rising). With `most` at least one row is taken, even if it is 0. Rows whose low or
    high is null, or whose low lies above their high, share no place with any and are all taken."""
    ship(df.sparkSession)
    keys = list(keys)
    names = [f"__o{i}" for i in range(len(order))]
    rows = df.withColumns(dict(zip(names, order, strict=True)) | {"__free": ~F.coalesce(F.col(low) <= F.col(high), F.lit(False))})
    # a range begins an island if it lies behind all that began before it
    begun = Window.partitionBy(*keys, "__free").orderBy(low, high)
    before = F.max(high).over(begun.rowsBetween(Window.unboundedPreceding, -1))
    first = F.coalesce((F.col(low) > before).cast("long"), F.lit(1).cast("long"))
    island = F.sum("__first").over(begun.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumn("__first", first).withColumn("__island", F.when(~F.col("__free"), island)).drop("__first", "__free")
    rows = rows.repartition(*keys, "__island").sortWithinPartitions(*keys, "__island", *names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, taken = None, Taken()
        for b in batches:
            col = lambda c: b.column(b.schema.get_field_index(c)).to_pylist()  # noqa: B023, E731
            where, keep = list(zip(*(col(k) for k in keys), col("__island"), strict=True)), []
            for here, x, y in zip(where, col(low), col(high), strict=True):
                if here != at:
                    at, taken = here, Taken()
                keep.append(here[-1] is None or taken.add(x, y))
            yield b.filter(pa.array(keep, pa.bool_()))

    out = rows.mapInArrow(run, rows.schema)
    if most is not None:
        out = out.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*names))).where(F.col("__n") <= max(1, most))
    return out.select(*df.columns)
