"""Numbers that may be text, missing, NaN or infinite."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_float(c: Column, default: float | None = 0.0) -> Column:
    """A double, or the default for null, bad text and NaN; infinity passes."""
    x = c.try_cast("double")
    return F.when(x.isNull() | F.isnan(x), F.lit(default).cast("double")).otherwise(x)


def finite_float(c: Column, default: float | None = None) -> Column:
    """As safe_float, with the default for infinity too."""
    x = c.try_cast("double")
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), F.lit(default).cast("double")).otherwise(x)


def direction_bucket(c: Column, threshold: float) -> Column:
    """left below -threshold, right above it, else center; unknown for what isn't a finite number."""
    x = finite_float(c)
    return F.when(x.isNull(), "unknown").when(x < -threshold, "left").when(x > threshold, "right").otherwise("center")


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def even_int(c: Column, minimum: int = 2) -> Column:
    """Rounded (ties to even), then down to an even number, at least the minimum."""
    n = F.greatest(F.lit(minimum).cast("long"), F.bround(c).cast("long"))
    return F.greatest(F.lit(minimum).cast("long"), n - F.pmod(n, F.lit(2)))


def ratio(a: Column, b: Column, default: float | None = 0.0) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(default).cast("double"))
