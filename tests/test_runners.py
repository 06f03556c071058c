"""Angles against numpy, one load a task, and a limit that tasks side by side keep together."""

import math
import os
import time

import numpy as np
from pyspark.sql import functions as F

from shotlens.functions.angles import bin_angle, euler
from shotlens.runners import Bucket, call_all, run_gaze


def test_expected_angles(spark):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.normal(size=90) * 5).tolist()) for i in range(20)] + [(20, [1000.0, -1000.0] + [0.0] * 88), (21, None), (22, []), (23, [1.0, float("nan")]), (24, [1.0, None]), (25, [3.0])]
    got = {r["i"]: r["a"] for r in spark.createDataFrame(rows, "i int, x array<double>").select("i", bin_angle(F.col("x")).alias("a")).collect()}
    for i, x in rows[:21]:
        p = np.exp(np.array(x) - max(x))
        assert abs(got[i] - math.radians(float(p @ np.arange(90) / p.sum()) * 4 - 180)) < 1e-9
    assert [got[i] for i in range(21, 25)] == [None] * 4 and abs(got[25] + math.pi) < 1e-12


def test_euler(spark):
    def matrix(x, y, z):
        cx, sx, cy, sy, cz, sz = (f(v) for v in (x, y, z) for f in (math.cos, math.sin))
        return [cz * cy, cz * sy * sx - sz * cx, cz * sy * cx + sz * sx, sz * cy, sz * sy * sx + cz * cx, sz * sy * cx - cz * sx, -sy, cy * sx, cy * cx]

    angles = [(0.1, -0.4, 0.7), (-1.2, 0.3, -2.0), (0.0, 0.0, 0.0)]
    df = spark.createDataFrame([(i, matrix(*a)) for i, a in enumerate(angles)] + [(3, [1.0]), (4, None), (5, matrix(0.5, math.pi / 2, 0.0))], "i int, r array<double>")
    got = {r["i"]: r["e"] for r in df.select("i", euler(F.col("r")).alias("e")).collect()}
    assert all(np.allclose(got[i], a) for i, a in enumerate(angles)) and got[3] is None and got[4] is None
    assert np.allclose(got[5], (0.5, math.pi / 2, 0.0))


def test_weights_are_loaded_once_a_task(spark, tmp_path):
    folder = str(tmp_path)

    def load():
        open(f"{folder}/{os.getpid()}-{time.monotonic_ns()}", "w").close()
        return lambda x: [np.array([[v, 0.0, 1.0] for v in x]), np.array([[0.0, v] for v in x])]

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    df = spark.range(0, 200, 1, 2).select(F.when(F.col("id") % 5 != 0, F.col("id") / 100).alias("image"), "id")
    got = {r["id"]: (r["pitch"], r["yaw"]) for r in run_gaze(df, load, "image").collect()}
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(os.listdir(folder)) == 2  # two tasks of ten batches
    p = np.exp([0.07, 0.0, 1.0])
    assert got[5] == (None, None) and abs(got[7][0] - math.radians(p @ [0, 1, 2] / p.sum() * 4 - 180)) < 1e-9
    run_gaze(df.where("id < 0"), load, "image").collect()
    assert len(os.listdir(folder)) == 2


def test_a_bucket_never_gives_more_than_its_rate():
    now = [0.0]
    bucket = Bucket(4.0, 1, lambda: now[0], lambda s: now.__setitem__(0, now[0] + s))
    times = []
    for k in range(40):
        now[0] += 0.7 if k % 10 == 0 else 0.01
        bucket.take()
        times.append(now[0])
    assert all(b - a >= 0.25 * 4 - 1e-6 for a, b in zip(times, times[5:], strict=False)) and times[0] >= 0.25


def test_four_tasks_keep_one_limit(spark, tmp_path):
    """A service that refuses what comes too fast, and every third call's first attempt besides."""
    log, rate = str(tmp_path / "log"), 40.0

    def load():
        def call(text):
            with open(log, "a") as f:
                f.write(f"{time.time()}\n")
            if text == "bad":
                raise ValueError("no")
            seen = f"{log}-{text}"
            if int(text) % 3 == 0 and not os.path.exists(seen):
                open(seen, "w").close()
                raise TimeoutError("too fast")
            return text.upper() + "!"

        return call

    tasks = spark.createDataFrame([(i, str(i)) for i in range(60)] + [(99, "bad")], "id int, prompt string")
    done, left = call_all(tasks, load, "id", "prompt", rate, 4, lambda e: isinstance(e, TimeoutError))
    got = {r["id"]: (r["answer"], r["error"]) for r in done.collect()}
    assert left.count() == 0 and got == {i: (f"{i}!", None) for i in range(60)} | {99: (None, "ValueError: no")}
    times = sorted(float(x) for x in open(log))
    assert len(times) == 61 + 20 and all(sum(t <= x < t + 0.5 for x in times) <= rate * 0.5 + 4 for t in times)
    never = call_all(tasks.where("id = 1"), lambda: lambda text: (_ for _ in ()).throw(TimeoutError()), "id", "prompt", 100.0, 1, lambda e: True, rounds=2)
    assert never[0].count() == 0 and [r["id"] for r in never[1].collect()] == [1]
