"""Driver queries on tables that go beyond what their first rows or days hold."""

import datetime
import json

from pyspark.sql import functions as F

from shotlens.functions.text import line_class
from shotlens.queries import queries

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event(i, day, user=1, value=0.0, k=50):
    return (i, datetime.datetime(2024, 1, 1) + datetime.timedelta(days=day, seconds=i), user, "error" if i % 5 == 0 else "view", value, json.dumps({"k": k}))


def test_stream_timebin_holds_every_day_in_any_order_of_files(spark, tmp_path):
    days = [*range(40, 0, -2), 400]
    for n, day in enumerate(days):  # later days in the earlier files, more files than a batch takes
        spark.createDataFrame([event(10 * n + j, day) for j in range(3)] + [event(10 * n + 3, 3)], EVENTS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    got = {(r["bin_start_s"] - 1704067200) // 86400: (r["n_frames_total"], r["n_frames_valid"]) for r in queries()["stream_timebin"](spark, str(tmp_path)).collect()}
    want = {d: (3, 2) for d in days} | {3: (len(days), len(days))}
    assert got == want


def test_crop_envelope_holds_the_whole_track(spark, tmp_path):
    rows = [event(i, 0, value=100.0, k=50) for i in range(40)] + [event(40, 0, value=250.0, k=120), event(41, 0, value=20.0, k=90)]
    spark.createDataFrame(rows, EVENTS).write.parquet(f"{tmp_path}/events.parquet")
    got = {r["det"]: (r["track_len"], r["crop_w"], r["crop_h"], r["crop_x"], r["crop_y"]) for r in queries()["crop_envelope"](spark, str(tmp_path)).collect()}
    # boxes of 60 by 60 at (2 k, value): 200 by 210 and 140 by 140 over all frames
    assert got == {0: (21, 314, 314, 42, 46), 1: (21, 210, 210, 64, 0)}


def test_line_classify_classes_whole_lines(spark, tmp_path):
    text = "\n".join(["some words", "and more", "john smith and mary jones then walk slowly over the hill, and they talk about the weather of the day."])
    spark.createDataFrame([(i, text) for i in range(12)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    lines = [(" " * i + (t.upper() if k == 2 else t),) for i in range(12) for k, t in enumerate(text.split("\n"))]
    want = spark.createDataFrame(lines, "line string").groupBy(line_class(F.col("line")).alias("kind")).count().collect()
    assert {r["kind"]: r["n"] for r in queries()["line_classify"](spark, str(tmp_path)).collect()} == {r["kind"]: r["count"] for r in want}
