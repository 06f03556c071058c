"""Angles from what gaze and pose models put out: logits over bins of degrees, and rotation matrices."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the public gaze model: 90 bins of 4 degrees from -180 on.
STEP, START = 4.0, -180.0


def expected_bin(logits: Column) -> Column:
    """The soft-max expectation of a bin's number, from 0; null for a null or empty array or one that holds a null or NaN.
    The largest logit is taken off first, so that no exponential overflows."""
    top = F.array_max(logits)
    weighed = F.transform(logits, lambda x, i: F.struct((F.exp(x - top)).alias("e"), i.cast("double").alias("i")))
    total = F.aggregate(weighed, F.struct(F.lit(0.0).alias("e"), F.lit(0.0).alias("ei")), lambda acc, x: F.struct((acc["e"] + x["e"]).alias("e"), (acc["ei"] + x["e"] * x["i"]).alias("ei")), lambda acc: acc["ei"] / acc["e"])
    fine = (F.size(logits) > 0) & F.forall(logits, lambda x: x.isNotNull() & ~F.isnan(x))
    return F.when(fine, total)


def bin_angle(logits: Column, step: float = STEP, start: float = START) -> Column:
    """Radians of the expected angle."""
    return F.radians(expected_bin(logits.cast("array<double>")) * step + start)


def euler(rotation: Column) -> Column:
    """struct<pitch,yaw,roll> in radians of a 3 by 3 rotation matrix (an array of 9, row by row); null for other arrays.
    Where the matrix looks straight up or down, roll is 0."""
    r = lambda i, j: F.get(rotation, F.lit(3 * i + j)).cast("double")
    flat = F.sqrt(r(0, 0) * r(0, 0) + r(1, 0) * r(1, 0))
    regular = flat >= 1e-6
    pitch = F.when(regular, F.atan2(r(2, 1), r(2, 2))).otherwise(F.atan2(-r(1, 2), r(1, 1)))
    roll = F.when(regular, F.atan2(r(1, 0), r(0, 0))).otherwise(0.0)
    return F.when(F.size(rotation) == 9, F.struct(pitch.alias("pitch"), F.atan2(-r(2, 0), flat).alias("yaw"), roll.alias("roll")))
