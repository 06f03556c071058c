"""Streams in order, resumed runs, and files that are written and read again."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from shotlens.sources import readers, writers
from shotlens.streaming.live import live_bins, live_last_choice, live_smoothing, run_available, run_updates

AT = datetime.datetime(2024, 1, 1)


def put(spark, folder, rows):
    """A file of rows (key, minute, choice)."""
    data = [(k, AT + datetime.timedelta(minutes=m), c) for k, m, c in rows]
    spark.createDataFrame(data, "k string, at timestamp, choice string").coalesce(1).write.mode("append").parquet(folder)


def stream(spark, folder):
    return spark.readStream.schema("k string, at timestamp, choice string").option("maxFilesPerTrigger", 1).parquet(folder)


def minutes(df, name):
    return sorted((r["k"], int((r["at"] - AT).total_seconds() // 60), r[name]) for r in df.collect())


def test_last_choice_in_the_order_of_time(spark, tmp_path):
    src = f"{tmp_path}/in"
    put(spark, src, [("a", 3, "z"), ("a", 1, "x"), ("b", 2, None)])  # out of order within a batch
    put(spark, src, [("a", 2, None), ("a", 5, None), ("b", 4, "y")])  # and across batches
    put(spark, src, [("a", 6, "w"), ("b", 6, None), ("c", 500, None)])  # its time lets all others go
    out = run_available(spark, live_last_choice(stream(spark, src), "k", "at", "choice", "10 minutes"), "last")
    got = [r for r in minutes(out, "previous") if r[0] != "c"]
    assert got == [("a", 1, None), ("a", 2, "x"), ("a", 3, "x"), ("a", 5, "z"), ("a", 6, "z"), ("b", 2, None), ("b", 4, None), ("b", 6, "y")]


def test_smoothing_waits_for_the_next_row(spark, tmp_path):
    src = f"{tmp_path}/in"
    put(spark, src, [("a", 2, None), ("a", 1, "x"), ("a", 3, "x"), ("a", 4, None)])
    put(spark, src, [("a", 5, "y"), ("a", 6, None), ("a", 7, None), ("a", 8, "y")])
    put(spark, src, [("c", 500, None)])
    out = run_available(spark, live_smoothing(stream(spark, src), "k", "at", "choice", "10 minutes"), "smooth")
    assert [r for r in minutes(out, "smoothed") if r[0] == "a"] == [("a", 1, "x"), ("a", 2, "x"), ("a", 3, "x"), ("a", 4, None), ("a", 5, "y"), ("a", 6, None), ("a", 7, None)]


def test_a_run_goes_on_from_its_checkpoint(spark, tmp_path):
    src, keep = f"{tmp_path}/in", f"{tmp_path}/kept"

    def run():
        rows = stream(spark, src).select("k", "at", F.col("choice").isNotNull().alias("ok"), F.lit(0.9).alias("conf"))
        return {r["k"]: r["n_frames_total"] for r in run_updates(spark, live_bins(rows, ["k"], "at", "1 day", None, "ok", "conf"), ["k", "bin_start"], "bins", keep).collect()}

    put(spark, src, [("a", 1, "x"), ("b", 2, "x")])
    assert run() == {"a": 1, "b": 1}
    put(spark, src, [("a", 3, "x")])
    assert run() == {"a": 2, "b": 1} and run() == {"a": 2, "b": 1}


def test_json_lines_say_which_line_is_bad(spark, tmp_path):
    p = tmp_path / "x.jsonl"
    p.write_text('{"a": 1}\n\n{"a": 2}\nnot json\n{"a": 3}\n')
    with pytest.raises(ValueError, match=r"x\.jsonl: line 4"):
        readers.read_jsonl(spark, str(p), "a long")
    assert sorted(r["a"] for r in readers.read_jsonl(spark, str(p), "a long", strict=False).collect()) == [1, 2, 3]
    p.write_text('{"a": 1}\n')
    assert readers.read_jsonl(spark, str(p), "a long").collect()[0]["a"] == 1


def test_csv_begins_with_a_byte_order_mark(spark, tmp_path):
    to = f"{tmp_path}/x"
    writers.write_csv(spark.createDataFrame([(1, "a")], "n int, t string"), to, bom=True)
    part = next(p for p in (tmp_path / "x").glob("*.csv"))
    assert part.read_bytes().startswith(b"\xef\xbb\xbfn,t")
    assert readers.read_csv(spark, to).columns == ["n", "t"]


def test_documents_scripts_and_videos(spark, tmp_path):
    (tmp_path / "tt1.json").write_text('{"cast": [{"id": "nm1", "name": "A", "character": "B"}, {"id": "", "name": "x"}], "story": []}')
    meta = readers.read_meta(spark, f"{tmp_path}/tt1.json").collect()
    assert [(r["movie_id"], r["pid"], r["name"]) for r in meta] == [("tt1", "nm1", "A")]
    assert readers.read_annotations(spark, f"{tmp_path}/tt1.json").head()["movie_id"] == "tt1"
    (tmp_path / "tt1.txt").write_bytes(b"INT. HOUSE\n caf\xc3\xa9 \xff\n")
    script = readers.read_script(spark, f"{tmp_path}/tt1.txt").head()
    assert script["movie_id"] == "tt1" and script["text"] == "INT. HOUSE\n café \n"
    for name in ("tt1_long.mp4", "tt1.mkv", "tt1b.mp4"):
        (tmp_path / name).write_bytes(b"")
    assert readers.pick_video(spark, str(tmp_path), "tt1").endswith("/tt1.mkv") and readers.pick_video(spark, str(tmp_path), "tt9") is None
    assert {r["path"].rsplit("/", 1)[1]: r["length"] for r in readers.files(spark, str(tmp_path), "*.txt").collect()} == {"tt1.txt": 20}
    with pytest.raises(FileNotFoundError, match="nothing"):
        readers.require(spark, str(tmp_path), f"{tmp_path}/nothing")
    assert readers.movie_root("out/m/final_proxy/t.csv", "m") == "out/m" and readers.movie_root("t.csv", "m") == "outputs/video_proxy/m"
    page = writers.audit_html(spark.createDataFrame([("<b>", None)], "a string, b string"), ["a", "b"], "T & t")
    assert "<td>&lt;b&gt;</td><td></td>" in page and "T &amp; t" in page


def test_cache_keeps_the_last_answer(spark, tmp_path):
    to = f"{tmp_path}/cache"
    assert readers.read_cache(spark, to).count() == 0
    writers.append_cache(spark.createDataFrame([("k1", "old", 1), ("k2", "only", 1)], "cache_key string, answer string, ord long"), to)
    writers.append_cache(spark.createDataFrame([("k1", "new", 2)], "cache_key string, answer string, ord long"), to)
    assert {r["cache_key"]: r["answer"] for r in readers.read_cache(spark, to).collect()} == {"k1": "new", "k2": "only"}


def test_streams_in_order_against_a_loop(spark, tmp_path):
    rng, rows = random.Random(7), []
    for n, k in enumerate(["a", "b", None, *(f"k{i}" for i in range(20))]):
        minutes_ = rng.sample(range(1000), 40) if n else range(0, 1000, 25)
        rows += [(k, m, rng.choice(["x", "y", None])) for m in minutes_]
    rows += [("tie", 7, None), ("tie", 7, "z"), ("tie", 9, None)]  # equal times: nulls first
    rng.shuffle(rows)
    src = f"{tmp_path}/in"
    for i in range(3):
        put(spark, src, rows[i::3])
    put(spark, src, [("end", 100_000, None)])
    last, smooth = [], []
    for k in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == k), key=lambda r: (r[1], r[2] is not None, r[2]))
        v = [None, *(r[2] for r in mine), None]
        for i, (_, m, c) in enumerate(mine, 1):
            last.append((k, m, next((x for x in v[i - 1 :: -1] if x), None)))
            smooth.append((k, m, v[i - 1] if c is None and v[i - 1] == v[i + 1] else c))
    order = lambda found: sorted((r for r in found if r[0] != "end"), key=repr)
    found = lambda df, name: order((r["k"], int((r["at"] - AT).total_seconds() // 60), r[name]) for r in df.collect())
    assert found(run_available(spark, live_last_choice(stream(spark, src), "k", "at", "choice", "1000 minutes"), "last"), "previous") == order(last)
    # the last row of a key follows when it has been silent for a week
    assert found(run_available(spark, live_smoothing(stream(spark, src), "k", "at", "choice", "1000 minutes"), "smooth"), "smoothed") == order(smooth)
