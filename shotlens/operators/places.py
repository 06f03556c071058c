"""Places of rows in the order of their group, and blocks of bounded size, without one task for a whole group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shotlens.session import materialise

#: Rows of a table of counts up to which it is broadcast; a larger one is joined.
FEW_ROWS = 100_000
#: Rows of a task, where a table is dealt by its count of rows.
TASK_ROWS = 25_000


def tasks_for(rows: DataFrame) -> int | None:
    """The number of tasks for a table of so many rows, for `dealt`; None where each core gets no more than one."""
    spark = rows.sparkSession
    n = -(-rows.count() // TASK_ROWS)
    return max(n, int(spark.conf.get("spark.sql.shuffle.partitions"))) if n > spark.sparkContext.defaultParallelism else None


def dealt(df: DataFrame, parts: int | None, *keys: str) -> DataFrame:
    """The table dealt by `keys` to `parts` tasks; as it is, if that is None.

    Adaptive execution puts partitions together by their compressed bytes, down to a task for each core, and rows that repeat
    themselves take many times these in memory: so a task's share would grow with the table. It leaves a given number alone,
    and what is joined to such a table by the same keys, or grouped by these and more, is dealt to as many."""
    return df.repartition(parts, *keys) if parts else df


def small(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """The table, written once and, if it has at most FEW_ROWS rows, marked for broadcast."""
    df = materialise(spark, df, name)
    return F.broadcast(df) if df.limit(FEW_ROWS + 1).count() <= FEW_ROWS else df


def placed(spark: SparkSession, rows: DataFrame, group: Sequence[str], order: Sequence[Column | str], name: str) -> DataFrame:
    """The rows with `place` (from 0, in the group's order) and `size` (rows of the group). Null groups are groups.

    A group may hold most rows, so no window over it: the table is dealt by ranges of (*group, *order), a row's place in its
    range is counted in the task, and the ranges' counts, a row for each range and group, give what comes before. Rows that
    are equal in the order get places in any order."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    group = list(group)
    dealt = rows.repartitionByRange(n, *group, *order).sortWithinPartitions(*group, *order)
    dealt = materialise(spark, dealt.withColumn("__at", F.monotonically_increasing_id()), name)
    dealt = dealt.withColumn("__range", F.shiftright("__at", 33))
    ranges = dealt.groupBy(*group, "__range").agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    of = Window.partitionBy(*group)
    before = F.sum("__n").over(of.orderBy("__range")) - F.col("__n") - F.col("__first")
    ranges = small(spark, ranges.select(*(F.col(c).alias(f"__g{i}") for i, c in enumerate(group)), F.col("__range").alias("__r"), before.alias("__before"), F.sum("__n").over(of).alias("size")), f"{name}-ranges")
    same = F.col("__range") == F.col("__r")
    for i, c in enumerate(group):
        same = same & F.col(c).eqNullSafe(F.col(f"__g{i}"))
    return dealt.join(ranges, same).withColumn("place", F.col("__at") + F.col("__before")).drop("__at", "__range", "__r", "__before", *(f"__g{i}" for i in range(len(group))))


def in_blocks(spark: SparkSession, rows: DataFrame, group: Sequence[str], order: Sequence[str], size: int, name: str) -> DataFrame:
    """One row for each block of at most `size` rows that follow each other in a group: the group, `block` (from 0) and
    `items`, the rows in order as structs (order columns first). Places are only counted where a group has more rows."""
    rest = [c for c in rows.columns if c not in (*group, *order)]
    most = rows.groupBy(*group).count().agg(F.max("count")).head()[0] or 0
    if most > size:
        rows = placed(spark, rows, group, order, f"{name}-order").withColumn("block", F.floor(F.col("place") / size).cast("long"))
    else:
        rows = rows.withColumn("block", F.lit(0).cast("long"))
    return rows.groupBy(*group, "block").agg(F.sort_array(F.collect_list(F.struct(*order, *rest))).alias("items"))
