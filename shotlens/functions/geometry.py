"""Boxes and vectors. A box is a struct of x1, y1, x2, y2."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shotlens.functions.numeric import clamp


def box(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.struct(x1.cast("double").alias("x1"), y1.cast("double").alias("y1"), x2.cast("double").alias("x2"), y2.cast("double").alias("y2"))


def overlap_1d(a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(a2, b2) - F.greatest(a1, b1))


def area(b: Column) -> Column:
    return F.greatest(F.lit(0.0), b.x2 - b.x1) * F.greatest(F.lit(0.0), b.y2 - b.y1)


def iou(a: Column, b: Column) -> Column:
    both = overlap_1d(a.x1, a.x2, b.x1, b.x2) * overlap_1d(a.y1, a.y2, b.y1, b.y2)
    union = area(a) + area(b) - both
    return F.when(union > 0, both / union).otherwise(0.0)


def centre(b: Column) -> tuple[Column, Column]:
    return (b.x1 + b.x2) / 2, (b.y1 + b.y2) / 2


def centre_distance(a: Column, b: Column, width: Column, height: Column) -> Column:
    """Between centres, as a share of the frame's diagonal."""
    (ax, ay), (bx, by) = centre(a), centre(b)
    w, h = F.greatest(width.cast("double"), F.lit(1.0)), F.greatest(height.cast("double"), F.lit(1.0))
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by)) / F.sqrt(w * w + h * h)


def scale_box(b: Column, src_w: Column, src_h: Column, dst_w: Column, dst_h: Column) -> Column:
    """Null unless all sizes are positive."""
    ok = (src_w > 0) & (src_h > 0) & (dst_w > 0) & (dst_h > 0)
    return F.when(ok, box(b.x1 * dst_w / src_w, b.y1 * dst_h / src_h, b.x2 * dst_w / src_w, b.y2 * dst_h / src_h))


def clamp_box(b: Column, width: Column, height: Column) -> Column:
    return box(clamp(b.x1, 0.0, float("inf")), clamp(b.y1, 0.0, float("inf")), F.least(b.x2, width.cast("double")), F.least(b.y2, height.cast("double")))


def body_score(face: Column, body: Column) -> Column:
    """How well a face lies in the head of a body: 0.45 inside, 0.20 in the upper 62 %, 0.20 times the overlap in x, 0.15
    times the nearness to the head's centre at 25 % of the height."""
    cx, cy = centre(face)
    w, h = F.greatest(F.lit(1.0), body.x2 - body.x1), F.greatest(F.lit(1.0), body.y2 - body.y1)
    face_w = F.greatest(F.lit(1.0), face.x2 - face.x1)
    in_x = cx.between(body.x1, body.x2)
    inside = in_x & cy.between(body.y1, body.y2)
    upper = in_x & cy.between(body.y1, body.y1 + h * 0.62)
    dx = F.abs(cx - (body.x1 + body.x2) / 2) / (w / 2)
    dy = F.abs(cy - (body.y1 + h * 0.25)) / (h * 0.35)
    near = F.greatest(F.lit(0.0), 1 - 0.5 * dx - 0.5 * dy)
    return clamp(0.45 * inside.cast("double") + 0.20 * upper.cast("double") + 0.20 * overlap_1d(face.x1, face.x2, body.x1, body.x2) / face_w + 0.15 * near)


def side_of(subject_x: Column, target_x: Column, dead_zone: float = 1.0) -> Column:
    d = target_x - subject_x
    return F.when(d.isNull(), "unknown").when(d < -dead_zone, "left").when(d > dead_zone, "right").otherwise("center")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def unit(v: Column) -> Column:
    """A vector of length 1; empty for a null, empty or zero vector. The vector and its length are bound as items of arrays
    of one, or they would be computed again for every component."""
    scaled = lambda a, n: F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n)).otherwise(F.array().cast("array<double>"))
    return F.transform(F.array(v), lambda a: F.transform(F.array(F.sqrt(dot(a, a))), lambda n: scaled(a, n))[0])[0]


def cosine(a: Column, b: Column) -> Column:
    """Of unit vectors; -1 where one is empty or the sizes differ."""
    return F.when((F.size(a) > 0) & (F.size(a) == F.size(b)), dot(a, b)).otherwise(-1.0)

