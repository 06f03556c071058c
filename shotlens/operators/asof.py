"""As-of and nearest joins as one sort per key: union of both sides, then the last (or next) right row seen.

Linear in the rows, whatever the gaps; no range join and no cross product. The shuffle key is `keys`; a right row is
carried as one struct.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _carried(left: DataFrame, right: DataFrame, keys: Sequence[str], left_at: str, right_at: str, forward: bool, order: Sequence[str], same_place: bool = False) -> DataFrame:
    """Left rows with `__hit`: the last strictly earlier right row, or the first strictly later one; with `same_place` one
    at the very same place counts too."""
    r = right.select(*keys, F.col(right_at).alias("__at"), F.lit(0 if not forward else 1).alias("__side"), F.struct(*right.columns).alias("__row"), F.lit(None).cast(left.select(F.struct(*left.columns).alias("x")).schema["x"].dataType).alias("__left"), F.struct(*[F.col(c) for c in order]).alias("__tie") if order else F.struct(F.lit(0)).alias("__tie"))
    tie = r.schema["__tie"].dataType
    lside = F.lit(-1 if forward == same_place else 2)  # the left row's side among right rows at the very same place
    l = left.select(*keys, F.col(left_at).alias("__at"), lside.alias("__side"), F.lit(None).cast(r.schema["__row"].dataType).alias("__row"), F.struct(*left.columns).alias("__left"), F.lit(None).cast(tie).alias("__tie"))  # noqa: E741
    both = l.unionByName(r)
    if forward:
        w = Window.partitionBy(*keys).orderBy(F.desc("__at"), F.desc("__side"), F.desc("__tie")).rowsBetween(Window.unboundedPreceding, -1)
    else:
        w = Window.partitionBy(*keys).orderBy("__at", "__side", F.desc("__tie")).rowsBetween(Window.unboundedPreceding, -1)
    return both.withColumn("__hit", F.last("__row", ignorenulls=True).over(w)).where("__left IS NOT NULL")


def asof_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_at: str, right_at: str, take: dict[str, str], tolerance: float | None = None, forward: bool = False, order: Sequence[str] = (), gap: str = "gap", same_place: bool = False) -> DataFrame:
    """Every left row with columns of the nearest right row strictly before it (strictly after, with `forward`; or at the
    very same place, with `same_place`).

    `take` maps right columns to output names. Beyond `tolerance` they are null, as is `gap`. Of right rows at one place
    the one with the least `order` counts. Rows whose keys or places are null find nothing.
    """
    found = _carried(left, right, keys, left_at, right_at, forward, order, same_place)
    hit, at = F.col("__hit"), F.col(f"__left.{left_at}")
    distance = (hit[right_at] - at) if forward else (at - hit[right_at])
    ok = hit.isNotNull() & distance.isNotNull()
    if tolerance is not None:
        ok = ok & (distance <= tolerance)
    return found.select("__left.*", *(F.when(ok, hit[c]).alias(n) for c, n in take.items()), F.when(ok, distance).alias(gap))


def nearest_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_at: str, right_at: str, take: dict[str, str], order: Sequence[str] = (), gap: str = "gap") -> DataFrame:
    """Every left row with the right row nearest to it on either side; ties go to the earlier one."""
    names = list(take.values())
    back = asof_join(left, right, keys, left_at, right_at, {c: f"__b_{n}" for c, n in take.items()}, order=order, gap="__b_gap")
    both = asof_join(back, right, keys, left_at, right_at, {c: f"__f_{n}" for c, n in take.items()}, forward=True, order=order, gap="__f_gap", same_place=True)
    use_back = F.col("__b_gap").isNotNull() & (F.col("__f_gap").isNull() | (F.col("__b_gap") <= F.col("__f_gap")))
    return both.select(*left.columns, *(F.when(use_back, F.col(f"__b_{n}")).otherwise(F.col(f"__f_{n}")).alias(n) for n in names), F.when(use_back, F.col("__b_gap")).otherwise(F.col("__f_gap")).alias(gap))
