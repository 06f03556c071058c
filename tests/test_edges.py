"""Nulls, texts that are no numbers, and orders at their ends."""

import math

from pyspark.sql import functions as F

from shotlens.functions.numeric import clamp, direction_bucket, even_int, finite_float, ratio, safe_float
from shotlens.operators.asof import asof_join
from shotlens.operators.ranking import keep_first, keep_last
from shotlens.plans.tracks import crop_envelope


def test_numbers_from_texts(spark):
    texts = ["1.5", " 2 ", "1e3", "nan", "NaN", "inf", "-inf", "Infinity", "", "x", None, "-0.2", "0.21"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = df.orderBy("i").select(safe_float(F.col("t")).alias("s"), safe_float(F.col("t"), None).alias("n"), finite_float(F.col("t")).alias("f"), direction_bucket(F.col("t"), 0.2).alias("d")).collect()
    assert [r["s"] for r in got] == [1.5, 2.0, 1000.0, 0.0, 0.0, math.inf, -math.inf, math.inf, 0.0, 0.0, 0.0, -0.2, 0.21]
    assert [r["n"] for r in got][8:11] == [None] * 3 and [r["f"] for r in got][3:11] == [None] * 8
    assert [r["d"] for r in got] == ["right"] * 3 + ["unknown"] * 8 + ["center", "right"]
    odd = spark.createDataFrame([(1, 0), (3, 2), (None, 2), (5, None)], "a int, b int")
    assert [r[0] for r in odd.select(ratio(F.col("a"), F.col("b"))).collect()] == [0.0, 1.5, 0.0, 0.0]
    values = spark.createDataFrame([(-1.0,), (2.5,), (3.5,), (7.0,), (None,)], "x double")
    assert [tuple(r) for r in values.select(even_int(F.col("x")), clamp(F.col("x"), 0.0, 3.0)).collect()][:4] == [(2, 0.0), (2, 2.5), (4, 3.0), (6, 3.0)]


def test_crops_stay_in_the_frame_and_their_times_in_the_clip(spark):
    rows = [("a", 0.0, 0.0, 20.0, 10.0, 0.9, 0.1), ("a", 10.0, 0.0, 30.0, 12.0, 0.7, 3.9), ("b", 600.0, 340.0, 640.0, 360.0, 0.5, 2.0), ("c", -5.0, 0.0, 900.0, 400.0, 0.5, 9.0), ("d", 5.0, 5.0, 5.0, 5.0, None, None)]
    df = spark.createDataFrame(rows, "k string, x1 double, y1 double, x2 double, y2 double, conf double, t double").withColumn("k", F.col("k"))
    out = {r["k"]: r for r in crop_envelope(df, ["k"], F.lit(640), F.lit(360), 0.35, "t", F.lit(4.0)).collect()}
    a, b, c, d = (out[k] for k in "abcd")
    assert (a["crop_x"], a["crop_y"], a["crop_w"], a["crop_h"], a["track_len"]) == (0, 0, 50, 50, 2) and abs(a["track_conf"] - 0.8) < 1e-12
    assert (a["crop_start_sec"], a["crop_end_sec"]) == (0.0, 4.0) and (b["crop_start_sec"], b["crop_end_sec"]) == (1.75, 2.25)
    assert (c["crop_start_sec"], c["crop_end_sec"]) == (8.75, 4.0)  # the frame lies behind the clip: one bin long at most
    assert all(r["crop_x"] % 2 == r["crop_y"] % 2 == r["crop_w"] % 2 == r["crop_h"] % 2 == 0 and 0 <= r["crop_x"] <= 640 - r["crop_w"] and 0 <= r["crop_y"] <= 360 - r["crop_h"] for r in (a, b, c, d))
    assert d["track_conf"] is None and d["crop_w"] == 2


def test_rows_without_a_place_find_nothing(spark):
    left = spark.createDataFrame([("k", None), ("k", 5), (None, 5)], "k string, at int")
    right = spark.createDataFrame([("k", None, "x"), ("k", 4, "y"), ("k", 4, None), (None, 4, "z")], "k string, at int, v string")
    got = sorted(((r["k"], r["at"]), r["v"], r["gap"]) for r in asof_join(left.where("k IS NOT NULL"), right, ["k"], "at", "at", {"v": "v"}, order=["v"]).withColumn("at", F.coalesce("at", F.lit(-1))).collect())
    assert got == [(("k", -1), None, None), (("k", 5), None, 1)]  # of rows at one place that of the least order, nulls first
    first = keep_first(right.where("k = 'k'"), ["k"], "at").collect()
    last = keep_last(right.where("k = 'k'"), ["k"], "at").collect()
    assert [r["at"] for r in first] in ([None], [4]) and [r["at"] for r in last] == [4]
