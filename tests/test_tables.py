"""Table functions against the column forms; readers, writers and operators at their edges."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shotlens.functions.tables import register
from shotlens.operators import gallery, similarity
from shotlens.operators.asof import nearest_join
from shotlens.operators.nonoverlap import non_overlapping
from shotlens.operators.states import action_chunks, speeches
from shotlens.plans.identity import bodies_of
from shotlens.plans.qa import evidence_rows
from shotlens.plans.tracks import BinRules, shot_time, time_bins
from shotlens.sources import readers, writers


def test_table_functions_equal_the_column_forms(spark):
    rng = random.Random(3)
    rows = [(f"m{m}", i + 1, rng.choice("SDDDNBO"), f"  text {m} {i} ") for m in range(12) for i in range(rng.randint(0, 60))]
    lines = spark.createDataFrame(rows, "movie string, line_no int, kind string, line string")
    rng.shuffle(rows)
    spark.createDataFrame(rows, lines.schema).createOrReplaceTempView("odd_lines")
    register(spark)
    for name, columns, want in (("speeches", "movie, segment_idx, speaker_line, dialogue, start_line, end_line", speeches), ("action_chunks", "movie, other_idx, other_text, start_line, end_line", action_chunks)):
        got = spark.sql(f"SELECT {columns} FROM {name}(TABLE(odd_lines), 'movie')").collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, want(lines, ["movie"]).select(*columns.split(", ")).collect())) and len(got) > 20
    with pytest.raises(Exception, match="missing columns: line"):
        spark.sql("SELECT * FROM speeches(TABLE(SELECT movie, line_no, kind FROM odd_lines), 'movie')").collect()


def test_nearest_at_large_places(spark):
    for kind, place in (("double", float), ("decimal(20,3)", __import__("decimal").Decimal), ("long", int)):
        left = spark.createDataFrame([("k", place(1_700_000_000)), ("k", place(1_700_000_007)), ("k", None), ("z", place(1))], f"k string, at {kind}")
        right = spark.createDataFrame([("k", place(1_700_000_000), 2), ("k", place(1_700_000_000), 1), ("k", place(1_699_999_995), 3), ("k", place(1_700_000_009), 4)], f"k string, at {kind}, id int")
        got = [(r["at"], r["id"], r["gap"]) for r in nearest_join(left, right, ["k"], "at", "at", {"id": "id"}, ["id"]).orderBy("k", "at").collect()]
        assert got == [(None, None, None), (1_700_000_000, 1, 0), (1_700_000_007, 4, 2), (1, None, None)]
    at = __import__("datetime").datetime
    left = spark.createDataFrame([(1, at(2024, 1, 1, 12, 0, 0))], "k int, at timestamp_ntz")
    right = spark.createDataFrame([(1, at(2024, 1, 1, 12, 0, 0), "same"), (1, at(2024, 1, 1, 11, 59, 59), "before")], "k int, at timestamp_ntz, t string")
    assert nearest_join(left, right, ["k"], "at", "at", {"t": "t"}).head()["t"] == "same"


def test_frames_without_a_time_count_by_number(spark):
    rows = [(0.1, 9, 1, 0.9), (None, 15, 1, 0.9), (None, 29, 1, 0.9), (None, None, 0, 0.9), (float("nan"), 31, 1, 0.9)]
    df = spark.createDataFrame(rows, "timestamp double, frame int, success int, confidence double").withColumn("crop_start_sec", F.lit(1.0))
    got = {r["bin_idx"]: r["n_frames_total"] for r in time_bins(df, [], shot_time(df), BinRules(), pose=[], gaze=[]).collect()}
    assert got == {2: 2, 3: 2, 4: 1}  # 1.1 and 1.0; 1.5 and 1.967; 2.033


def test_of_several_evidence_rows_the_last_counts(spark):
    samples = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    rows = [(1, 1, "a"), (1, 3, "b"), (1, 2, "c"), (2, 5, None), (2, 5, "x")]
    for seed in range(4):
        random.Random(seed).shuffle(rows)
        got = evidence_rows(samples, spark.createDataFrame(rows, "k int, ord int, v string"), ["k"], ["ord"])
        assert [r["v"] for r in got.orderBy("k").collect()] == ["b", "x", None]


def loop_non_overlapping(rows, most=None):
    taken = []
    for r in sorted(rows):
        _, low, high = r
        if most is not None and len(taken) >= max(1, most):
            break
        if low is None or high is None or low > high or all(t[1] is None or t[2] is None or t[1] > t[2] or high < t[1] or t[2] < low for t in taken):
            taken.append(r)
    return taken


@pytest.mark.parametrize("most", [None, 0, 3])
def test_non_overlap_equals_the_loop(spark, most):
    rng, rows = random.Random(4), []
    for m in range(30):
        span = rng.choice([10, 200])
        for r in range(rng.randint(1, 60)):
            low = rng.randint(0, span)
            rows.append((f"m{m}" if m else None, r, rng.choice([low, low, low, None]) if m % 3 == 0 else low, low + rng.randint(-1 if m % 5 == 0 else 0, 9)))
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, {"a": 1}, [r[1]]) for r in rows], "m string, r int, low int, high int, extra map<string,int>, list array<int>")
    got = sorted((r["m"] or "", r["r"]) for r in non_overlapping(df, ["m"], [F.col("r")], "low", "high", most).collect())
    want = sorted((m or "", r[0]) for m in {x[0] for x in rows} for r in loop_non_overlapping([x[1:] for x in rows if x[0] == m], most))
    assert got == want
    assert non_overlapping(df.limit(0), ["m"], [F.col("r")], "low", "high", most).count() == 0


def test_many_ranges_of_one_movie(spark):
    """200,000 windows: the taken ones are found by bisection."""
    df = spark.range(200_000).selectExpr("'m' AS m", "id AS r", "(id * 7919) % 1000003 AS low", "(id * 7919) % 1000003 + id % 11 AS high")
    got = {r["r"] for r in non_overlapping(df, ["m"], [F.col("r")], "low", "high").select("r").collect()}
    free, want = bytearray(1_000_100), set()
    for i in range(200_000):
        low = i * 7919 % 1000003
        if not any(free[low : low + i % 11 + 1]):
            free[low : low + i % 11 + 1] = b"\x01" * (i % 11 + 1)
            want.add(i)
    assert got == want


def test_gallery_search_equals_the_scan(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(12, 16))
    vector = lambda: (centres[rng.integers(12)] + 0.15 * rng.normal(size=16)).tolist()
    protos = [(i, f"nm{i % 7}", vector()) for i in range(600)] + [(600, "nm1", [0.0] * 15 + [1.0])]
    protos += [(601, "nm2", protos[3][2]), (602, "nm3", protos[3][2])]  # equal vectors
    asks = [(i, vector(), None if i % 3 else [f"nm{i % 7}", "nm1"]) for i in range(200)] + [(200, protos[3][2], None), (201, None, None), (202, [], ["nm2"]), (203, [1.0], None), (204, vector(), ["nobody"])]
    g = spark.createDataFrame(protos, "proto int, label string, v array<double>")
    q = spark.createDataFrame(asks, "id int, v array<double>, may array<string>")
    args = ("id", "v", "proto", "label", 0.5, 0.01)
    got = gallery.nearest_two(q, g, *args, allow="may")
    cols = ["id", F.round("top_score", 9).alias("top"), F.round("second_score", 9).alias("second"), F.round("margin", 9).alias("margin"), "prototype_id", "label"]
    rows = lambda df: sorted(map(tuple, df.select(*cols).collect()))
    assert rows(got) == rows(similarity.best_match(q, g, *args, allow="may"))
    seen = {r["id"]: r["visited"] for r in got.collect()}
    free = [seen[i] for i in range(200) if i % 3]
    assert sum(free) < 0.5 * 603 * len(free)  # over half of all pairs are never compared
    assert rows(gallery.nearest_two(q, g.limit(0), *args)) == rows(similarity.best_match(q, g.limit(0), *args))
    assert gallery.nearest_two(q.limit(0), g, *args).count() == 0


def test_bodies_reviewed_rows_and_previews(spark, tmp_path):
    docs = spark.createDataFrame([("tt1", [("a1", "7", "nm1", [100, 50], ([1, 2, 3, 4],)), ("a2", "x", None, [100, 50], ([5, 6, 7, 8],)), ("a3", "8", "nm2", [1], ([1, 2, 3, 4],)), ("a4", "8", "nm2", [100, 50], None)])], "movie_id string, cast array<struct<id:string,shot_idx:string,pid:string,resolution:array<int>,body:struct<bbox:array<int>>>>")
    got = sorted(tuple(r) for r in bodies_of(docs).collect())
    assert got == [("tt1", "shot_0007", "a1", "nm1", 1.0, 2.0, 3.0, 4.0, 100.0, 50.0), ("tt1", "x", "a2", "", 5.0, 6.0, 7.0, 8.0, 100.0, 50.0)]
    labels = tmp_path / "labels.csv"
    labels.write_text("row,human_label\n1,left\n2, \n3,\n4,right\n")
    assert [r["row"] for r in readers.read_reviewed(spark, str(labels)).orderBy("row").collect()] == ["1", "4"]
    assert readers.read_reviewed(spark, f"{tmp_path}/none.csv").count() == 0
    assert [r["row"] for r in writers.preview(spark.createDataFrame([(3,), (1,), (2,)], "row int"), ["row"], 2).collect()] == [1, 2]
    spaced = tmp_path / "spaced.csv"
    spaced.write_text(" a , b\n1, x \n")
    assert readers.read_csv(spark, str(spaced), strip_names=True).columns == ["a", "b"] and readers.read_csv(spark, str(spaced)).columns == [" a ", " b"]


def test_checked_json_in_ranges_of_bytes(spark, tmp_path):
    import json

    from shotlens.sources import checked_json

    checked_json.register(spark)
    rng, good, bad = random.Random(8), [], []
    for k in range(3):
        with open(tmp_path / f"{k}.jsonl", "wb") as f:
            for i in range(200):
                kind = rng.random()
                at = f.tell()
                if kind < 0.05:
                    text = rng.choice([b"not json", b'{"a": "x"}', b"[1]", b'{"a": 1', b'{"a": true}', b'{"b": "\xff"}', b'{"s": {"x": "y"}}'])
                    bad.append((f"{k}.jsonl", at, text.decode("utf-8", "replace")))
                elif kind < 0.1:
                    text = b"  "
                else:
                    row = {"a": i, "b": "ä" * rng.randint(0, 30), "c": [1, 2.5], "s": {"x": k}, "more": 1}
                    good.append((i, row["b"], [1.0, 2.5], k, None))
                    text = json.dumps(row, ensure_ascii=False).encode()
                f.write(text + (b"" if k == 2 and i == 199 else b"\n"))
    (tmp_path / "_SUCCESS").write_text("")
    schema = f"a long, b string, c array<double>, s struct<x:long>, _rescued {checked_json.RESCUED}"
    for split in ("50", "1000", "100000"):
        rows = spark.read.format("checked_json").schema(schema).option("splitBytes", split).load(str(tmp_path)).collect()
        assert sorted((r["a"], r["b"], r["c"], r["s"]["x"], r["_rescued"]) for r in rows if not r["_rescued"]) == sorted(good, key=lambda x: x[:4])
        assert sorted((r["_rescued"]["file"].rsplit("/", 1)[1], r["_rescued"]["start"], r["_rescued"]["line"]) for r in rows if r["_rescued"]) == sorted(bad)
    with pytest.raises(Exception, match="the line at byte"):
        spark.read.format("checked_json").schema("a long, s struct<x:long>").load(f"file:{tmp_path}").collect()
    assert spark.read.format("checked_json").schema("a long").option("pathGlobFilter", "*.none").load(str(tmp_path)).count() == 0
    with pytest.raises(Exception, match="needs a schema"):
        spark.read.format("checked_json").load(str(tmp_path)).collect()


def test_audit_rows_and_config_files(spark, tmp_path):
    from shotlens.config import load, rules
    from shotlens.plans.qa import audit_rows

    samples = spark.createDataFrame([("s", 1, 0, "low"), ("s", 2, 1, "high"), ("s", 1, 2, "high"), ("t", 9, 3, "low")], "seq string, k int, sample_index int, sample_bucket string")
    rows = spark.createDataFrame([("s", 1, 5, "b"), ("s", 1, 4, "a"), ("s", 2, 1, "c"), ("x", 1, 1, "d")], "seq string, k int, ord int, v string")
    got = sorted((r["sample_index"], r["row_no"], r["v"], r["sample_bucket"]) for r in audit_rows(samples, rows, ["seq", "k"], ["ord"]).collect())
    assert got == [(0, 0, "a", "low"), (0, 1, "b", "low"), (1, 0, "c", "high"), (2, 0, "a", "high"), (2, 1, "b", "high")]
    (tmp_path / "base.json").write_text('{"bins": {"width": 0.5, "digits": 4}, "name": "x"}')
    (tmp_path / "run.json").write_text('{"bins": {"width": 1.0}, "name": null}')
    values = load(spark, f"{tmp_path}/base.json", f"{tmp_path}/run.json")
    assert values == {"bins": {"width": 1.0, "digits": 4}, "name": "x"} and rules(BinRules, values["bins"]) == BinRules(width=1.0, digits=4)
    with pytest.raises(FileNotFoundError, match="none.json"):
        load(spark, f"{tmp_path}/none.json")
