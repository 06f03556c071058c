"""Operators over ordered rows: windows of neighbouring shots, smoothing, neighbours, timelines and anchors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def consecutive_windows(df: DataFrame, keys: Sequence[str], place: str, fields: Sequence[str], shortest: int, longest: int, name: str = "shots") -> DataFrame:
    """Every run of `shortest` to `longest` rows whose places are consecutive numbers, as an array of structs in order.

    One sort per key, and at most `longest` rows are held for a row. A repeated place breaks a run, as a gap does."""
    w = Window.partitionBy(*keys).orderBy(place, *[f for f in fields if f != place])
    ahead = F.collect_list(F.struct(place, *[f for f in fields if f != place])).over(w.rowsBetween(0, longest - 1))
    runs = df.select(*keys, ahead.alias("__ahead")).select(*keys, "__ahead", F.explode(F.sequence(F.lit(shortest), F.lit(longest))).alias("__n")).where(F.size("__ahead") >= F.col("__n"))
    runs = runs.select(*keys, F.slice("__ahead", 1, F.col("__n")).alias(name))
    first = F.col(name)[0][place]
    return runs.where(F.forall(F.transform(F.col(name), lambda x, i: x[place] == first + i), lambda ok: ok))


def change_count(values: Column) -> Column:
    """Changes between neighbours of an array, blanks left out first."""
    kept = F.filter(values, lambda x: F.coalesce(x, F.lit("")) != "")
    return F.when(F.size(kept) < 2, 0).otherwise(F.size(F.filter(F.zip_with(F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0))), F.slice(kept, 2, F.greatest(F.size(kept) - 1, F.lit(0))), lambda a, b: a != b), lambda x: x)))


def neighbour_union(df: DataFrame, keys: Sequence[str], order: Sequence[str], labels: str, name: str) -> DataFrame:
    """The labels of the rows just before and after, each once."""
    w = Window.partitionBy(*keys).orderBy(*order)
    nothing = F.array().cast(df.schema[labels].dataType)
    return df.withColumn(name, F.array_union(F.coalesce(F.lag(labels).over(w), nothing), F.coalesce(F.lead(labels).over(w), nothing)))


def smooth_isolated(df: DataFrame, keys: Sequence[str], order: Sequence[str], status: str, same: Sequence[str], copy: Sequence[str], confidence: str, factor: float = 0.90, open_states: Sequence[str] = ("unknown", "ambiguous"), fixed: str = "assigned", name: str = "smoothing_applied") -> DataFrame:
    """A row in an open state between two fixed ones that agree in `same` takes their values and the smaller confidence
    times `factor`. A smoothed row needs two fixed neighbours, so that no two are adjacent and lag and lead suffice."""
    w = Window.partitionBy(*keys).orderBy(*order)
    before, after = (F.struct(status, confidence, *dict.fromkeys([*same, *copy])) for _ in range(2))
    out = df.withColumn("__p", F.lag(before).over(w)).withColumn("__n", F.lead(after).over(w))
    agree = F.lit(True)
    for c in same:
        agree = agree & F.col("__p")[c].eqNullSafe(F.col("__n")[c])
    hit = F.coalesce(F.col(status).isin(*open_states) & (F.col("__p")[status] == fixed) & (F.col("__n")[status] == fixed) & agree, F.lit(False))
    out = out.withColumn("__hit", hit)
    lowered = F.bround(F.least(F.col("__p")[confidence], F.col("__n")[confidence]) * factor, 6)
    changes = {c: F.when(F.col("__hit"), F.col("__p")[c]).otherwise(F.col(c)) for c in copy}
    changes |= {status: F.when(F.col("__hit"), F.lit(fixed)).otherwise(F.col(status)), confidence: F.when(F.col("__hit"), lowered).otherwise(F.col(confidence)), name: F.col("__hit").cast("int")}
    return out.withColumns(changes).drop("__p", "__n", "__hit")


def adjacent_values(df: DataFrame, groups: Sequence[str], order: Sequence[str], same: Sequence[str], value: str, before: str, after: str) -> DataFrame:
    """The value of the row before and after in the order of (groups, order), where it has equal `same` columns.

    The neighbour may lie in another shot: the order runs through `groups`, not through single streams."""
    w = Window.partitionBy(*groups).orderBy(*order)
    side = F.struct(*same, value)
    out = df.withColumn("__p", F.lag(side).over(w)).withColumn("__n", F.lead(side).over(w))
    pick = lambda c: F.when(F.lit(True) if not same else _all(F.col(c)[s] == F.col(s) for s in same), F.col(c)[value])
    return out.withColumns({before: F.coalesce(pick("__p"), F.lit("")), after: F.coalesce(pick("__n"), F.lit(""))}).drop("__p", "__n")


def _all(conditions) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def timeline(df: DataFrame, keys: Sequence[str], order: Sequence[str], ratio: str, start: str, end: str, digits: int | None = 2, origin: str | None = None) -> DataFrame:
    """t0 and t1 of events that share [start, end] in proportion to their ratios (negative: 0); the last one ends at the
    end. A group whose ratios sum to 0 goes. `origin` is subtracted."""
    by = Window.partitionBy(*keys)
    w = by.orderBy(*order)
    out = df.withColumn("__r", F.greatest(F.coalesce(F.col(ratio).cast("double"), F.lit(0.0)), F.lit(0.0)))
    out = out.withColumn("__all", F.sum("__r").over(by)).where("__all > 0")
    upto = F.sum("__r").over(w.rowsBetween(Window.unboundedPreceding, 0))
    out = out.withColumns({"__upto": upto, "__last": F.lead(F.lit(1)).over(w).isNull()})
    length = F.greatest(F.col(end) - F.col(start), F.lit(0.0))
    zero = F.col(origin) if origin else F.lit(0.0)
    t0 = F.col(start) + length * ((F.col("__upto") - F.col("__r")) / F.col("__all")) - zero
    t1 = F.when(F.col("__last"), F.col(end)).otherwise(F.col(start) + length * (F.col("__upto") / F.col("__all"))) - zero
    if digits is not None:
        t0, t1 = F.bround(t0, digits), F.bround(t1, digits)
    return out.withColumns({"t0": t0, "t1": t1}).drop("__r", "__all", "__upto", "__last")


def anchor_range(df: DataFrame, keys: Sequence[str], order: str, anchor: str, size: str, radius: int = 8, low: str = "range_low", high: str = "range_high", later: str | None = None) -> DataFrame:
    """The places [low, high] that may match a row: between the nearest anchors before and after, `radius` wider; with one
    anchor, or two that cross, around one; in a table without anchors around the row's proportional place. `size` is the
    number of places of the other side. A row's value of `later` is an anchor for the rows after it only."""
    by = Window.partitionBy(*keys)
    w = by.orderBy(order)
    upto = w.rowsBetween(Window.unboundedPreceding, -1)
    before = F.last(F.coalesce(anchor, later) if later else anchor, ignorenulls=True).over(upto)
    some = F.count(anchor).over(by) + (F.count(later).over(upto) if later else 0)
    after = F.first(anchor, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    out = df.withColumns({"__b": before, "__a": after, "__any": some, "__i": F.row_number().over(w) - 1, "__n": F.count("*").over(by)})
    b, a, last = F.col("__b"), F.col("__a"), F.col(size) - 1
    near = F.bround(F.col("__i") / F.greatest(F.col("__n") - 1, F.lit(1)) * F.greatest(last, F.lit(0))).cast("long")
    between = b.isNotNull() & a.isNotNull() & (b <= a)
    lo = F.when(F.col("__any") == 0, near - radius).when(between, b - radius).when(b.isNotNull(), b - radius).when(a.isNotNull(), a - radius).otherwise(F.lit(0))
    hi = F.when(F.col("__any") == 0, near + radius).when(between, a + radius).when(b.isNotNull(), b + radius).when(a.isNotNull(), a + radius).otherwise(F.lit(2 * radius))
    return out.withColumns({low: F.greatest(lo, F.lit(0)).cast("long"), high: F.least(hi, last).cast("long")}).drop("__b", "__a", "__any", "__i", "__n")
