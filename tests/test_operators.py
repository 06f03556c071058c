"""Operators and stage plans on small tables, against hand-made values, loops and properties."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shotlens.operators import alignment
from shotlens.operators.alignment import AlignmentRules, _score, _spans, align, align_spans
from shotlens.operators.asof import asof_join, nearest_join
from shotlens.operators.folds import greedy_pairs
from shotlens.operators.nonoverlap import non_overlapping
from shotlens.operators.states import action_chunks, script_lines, speeches
from shotlens.operators.tracking import TrackRules, track_boxes
from shotlens.operators.windows import consecutive_windows, timeline
from shotlens.plans.candidates import duration_tent, sequence_score
from shotlens.plans.context import parse_script


def test_alignment_by_hand():
    steps = align_spans(["hello there", "xyz"], ["hello there"])
    assert [(s["type"], s["raw_start"], s["raw_end"], s["dialogue_start"]) for s in steps] == [("match", 0, 0, 0), ("skip_raw", 1, 1, None)]
    assert align_spans(["a"], []) == [] and align_spans([], ["a"]) == []
    score = lambda x, y: round(_score(_spans([x], 1)[0][0], _spans([y], 1)[0][0])[0], 6)
    assert (score("hello there dorothy", "hello dorothy"), score("no no no", "no"), score("a", "b")) == (0.713333, 0.9, 0.0)


def brute_alignment(raw, said, rules):
    """Plain relaxation over all cells and spans."""
    n, m = len(raw), len(said)
    best, move = {(0, 0): 0.0}, {}
    for i in range(n + 1):
        for j in range(m + 1):
            if (i, j) not in best:
                continue
            options = [((i + 1, j), -rules.skip_raw)] * (i < n) + [((i, j + 1), -rules.skip_dialogue)] * (j < m)
            for a in range(1, min(rules.raw_span, n - i) + 1):
                for c in range(1, min(rules.dialogue_span, m - j) + 1):
                    s = _score(_spans([" ".join(raw[i : i + a])], 1)[0][0], _spans([" ".join(said[j : j + c])], 1)[0][0])[0]
                    if s >= rules.least_score:
                        options.append(((i + a, j + c), s))
            for cell, gain in options:
                if best[i, j] + gain > best.get(cell, float("-inf")):
                    best[cell], move[cell] = best[i, j] + gain, (i, j)
    path, at = [], (n, m)
    while at != (0, 0):
        path.append((move[at], at))
        at = move[at]
    return path[::-1]


def test_alignment_of_a_short_movie_is_that_of_a_long_one(monkeypatch):
    """Movies are matched as a whole or row by row, with the same steps; the first way reads each row once."""
    rng, calls = np.random.default_rng(6), []
    plain = alignment._Rows.next
    monkeypatch.setattr(alignment._Rows, "next", lambda self: calls.append(self.i) or plain(self))
    for n, m in ((1, 1), (5, 4), (9, 30), (60, 40), (3, 0)):
        raw, said = ([" ".join(f"w{x}" for x in rng.integers(0, 25, rng.integers(0, 9))) for _ in range(k)] for k in (n, m))
        got = align_spans(raw, said)
        assert len(calls) == (n + 1 if m else 0)
        with monkeypatch.context() as long:
            long.setattr(alignment, "SMALL", 0)
            assert got == align_spans(raw, said)
        calls.clear()


def test_alignment_deals_movies_apart(spark):
    rows = [(k, i, f"{k} word {i} of {i * 7 % 5}") for k in ("a", "b", None, "c") for i in range(6)] + [("d", 0, "alone")]
    df = spark.createDataFrame(rows, "movie string, i long, t string")
    out = align(df, df.where("i <> 2 AND movie IS DISTINCT FROM 'd'"), ["movie"], "i", "t", "t").collect()
    for k in ("a", "b", None, "c"):
        mine = [t.lower() for m, _, t in rows if m == k]
        want = align_spans([t.replace("None", "none") for t in mine], [t for i, t in enumerate(mine) if i != 2])
        got = sorted((r["step_idx"], r["type"], r["raw_start"], r["dialogue_end"], r["match_score"]) for r in out if r["movie"] == k)
        assert got == [(i, s["type"], s["raw_start"], s["dialogue_end"], s["match_score"]) for i, s in enumerate(want)]
    assert not [r for r in out if r["movie"] == "d"]


def test_alignment_against_brute_force(spark):
    rng = random.Random(1)
    for _ in range(40):
        say = lambda: " ".join(rng.choice("abcdefg") for _ in range(rng.randint(0, 4)))
        raw, said = [say() for _ in range(rng.randint(1, 7))], [say() for _ in range(rng.randint(1, 7))]
        got = align_spans(raw, said)
        i = j = 0
        cells = []
        for s in got:
            a = 0 if s["raw_start"] is None else s["raw_end"] - s["raw_start"] + 1
            c = 0 if s["dialogue_start"] is None else s["dialogue_end"] - s["dialogue_start"] + 1
            cells.append(((i, j), (i + a, j + c)))
            i, j = i + a, j + c
        assert cells == brute_alignment(raw, said, AlignmentRules())
    df = spark.createDataFrame([("m", 0, "Hello there"), ("m", 1, "xyz"), ("k", 0, "a")], "movie string, i int, t string")
    out = align(df, df.where("movie = 'm' AND i = 0"), ["movie"], "i", "t", "t").orderBy("step_idx").collect()
    assert [(r["movie"], r["type"], r["is_confident_match"]) for r in out] == [("m", "match", True), ("m", "skip_raw", False)]


SCRIPT = "          DOROTHY (CONT'D)\n     Hello\n     12.\n     there\n\n     stray"


def test_state_machines_by_hand(spark):
    said, other = parse_script(spark.createDataFrame([("m", SCRIPT)], "movie_id string, text string"))
    assert [(r["speaker"], r["dialogue"], r["start_line"], r["end_line"]) for r in said.collect()] == [("DOROTHY", "Hello there", 2, 4)]
    assert sorted((r["other_text"], r["start_line"]) for r in other.collect()) == [("stray", 6), ("there", 4)]


def test_state_machines_against_loops(spark):
    rng = random.Random(2)
    docs = {i: [rng.choice("SDNBO") for _ in range(rng.randint(1, 25))] for i in range(40)}
    lines = spark.createDataFrame([(i, n, k, f"{k}{n}") for i, ks in docs.items() for n, k in enumerate(ks, 1)], "doc int, line_no int, kind string, line string")
    want_said, want_other = [], []
    for i, ks in docs.items():
        speaker, got, first = None, [], None
        for n, k in enumerate([*ks, "S"], 1):
            if k == "N":
                continue
            if speaker and k == "D":
                first, got = first or n, [*got, f"D{n}"]
                continue
            if speaker and got:
                want_said.append((i, first, n - 1, " ".join(got)))
            speaker, got, first = (k == "S") or None, [], None
        buf, inside = [], False
        for n, k in enumerate([*ks, "B"], 1):
            if k in "NBS":
                if buf:
                    want_other.append((i, buf[0], buf[-1]))
                buf, inside = [], k == "S"
            elif not (inside and k == "D"):
                inside, buf = False, [*buf, n]
    assert sorted((r["doc"], r["start_line"], r["end_line"], r["dialogue"]) for r in speeches(lines, ["doc"]).collect()) == sorted(want_said)
    assert sorted((r["doc"], r["start_line"], r["end_line"]) for r in action_chunks(lines, ["doc"]).collect()) == sorted(want_other)
    assert script_lines(spark.createDataFrame([(1, "a\r\nb\n")], "d int, t string"), ["d"], "t").count() == 3


def test_asof_by_hand(spark):
    chunks = spark.createDataFrame([("m", 5, 10, "a"), ("m", 15, 20, "b"), ("m", 40, 60, "c")], "k string, s int, e int, t string")
    rows = spark.createDataFrame([("m", 30, 31), ("m", 46, 47), ("x", 1, 2), (None, 30, 31)], "k string, a int, z int")
    got = asof_join(asof_join(rows, chunks, ["k"], "a", "e", {"t": "p"}, 25, gap="pg"), chunks, ["k"], "z", "s", {"t": "n"}, 25, forward=True, gap="ng").orderBy("a", F.col("k").desc()).collect()
    assert [(r["a"], r["p"], r["pg"], r["n"], r["ng"]) for r in got] == [(1, None, None, None, None), (30, "b", 10, "c", 9), (30, None, None, None, None), (46, None, None, None, None)]
    near = nearest_join(spark.createDataFrame([("m", 10), ("m", 13), ("m", 0)], "k string, at int"), spark.createDataFrame([("m", 8, "x"), ("m", 12, "y"), ("m", 13, "z")], "k string, at int, t string"), ["k"], "at", "at", {"t": "hit"}, ["t"])
    assert sorted((r["at"], r["hit"], r["gap"]) for r in near.collect()) == [(0, "x", 8), (10, "x", 2), (13, "z", 0)]


def test_windows_and_greedy(spark):
    rows = spark.createDataFrame([("m", i) for i in (1, 2, 3, 5, 6, 7)], "m string, i int")
    w = consecutive_windows(rows, ["m"], "i", [], 3, 10)
    assert sorted([x["i"] for x in r["shots"]] for r in w.collect()) == [[1, 2, 3], [5, 6, 7]]
    ranked = spark.createDataFrame([("m", 1, 1, 3), ("m", 2, 3, 5), ("m", 3, 4, 6)], "m string, r int, lo int, hi int")
    pick = lambda most: sorted((r["lo"], r["hi"]) for r in non_overlapping(ranked, ["m"], [F.col("r")], "lo", "hi", most).collect())
    assert pick(None) == [(1, 3), (4, 6)] and pick(0) == [(1, 3)] and pick(1) == [(1, 3)]
    rng = random.Random(3)
    many = [("m", k, s := rng.randint(0, 60), s + rng.randint(0, 8)) for k in range(60)]
    got = non_overlapping(spark.createDataFrame(many, ranked.schema), ["m"], [F.col("r")], "lo", "hi").collect()
    assert all(a["hi"] < c["lo"] or c["hi"] < a["lo"] for a in got for c in got if a != c)
    pairs = spark.createDataFrame([("s", 3.0, "a", "x"), ("s", 2.0, "a", "y"), ("s", 1.0, "b", "y"), ("s", 0.5, "b", "x")], "s string, v double, l string, r string")
    assert sorted((r["l"], r["r"]) for r in greedy_pairs(pairs, ["s"], [-F.col("v")], "l", "r").collect()) == [("a", "x"), ("b", "y")]


def test_scores_by_hand(spark):
    lit = lambda *v: [F.lit(x) for x in v]
    got = spark.range(1).select(sequence_score(*lit(10, 2, 4, 2, 1.0, 2, 0.0, 0, 0, 0)).alias("a"), sequence_score(*lit(6, 1, 2, 1, 0.5, 1, 3.0, 2, 0, 1)).alias("b"), duration_tent(F.lit(36.0)).alias("c")).head()
    assert list(got) == [18.7, 12.2, 0.0]


def test_timeline_tiles_the_shot(spark):
    ev = spark.createDataFrame([("s", 1, 1.0, 10.0, 14.0), ("s", 2, 3.0, 10.0, 14.0), ("z", 1, 0.0, 0.0, 5.0)], "k string, o int, r double, a double, z double").withColumn("zero", F.lit(10.0))
    assert [(r["t0"], r["t1"]) for r in timeline(ev, ["k"], ["o"], "r", "a", "z", 2, "zero").orderBy("o").collect()] == [(0.0, 1.0), (1.0, 4.0)]


def test_tracker_by_hand(spark):
    rows = spark.createDataFrame([("s", 0, 0.0, 0.0, 100.0, 100.0, 0.9, 1), ("s", 1, 10.0, 0.0, 110.0, 100.0, 0.9, 2), ("s", 1, 500.0, 300.0, 510.0, 310.0, 0.5, 3)], "shot string, frame int, x1 double, y1 double, x2 double, y2 double, conf double, id int")
    run = lambda n: sorted((r["id"], r["local_track_id"], r["track_len"]) for r in track_boxes(rows, ["shot"], "frame", ["x1", "y1", "x2", "y2"], "conf", "id", 640, 360, TrackRules(least_length=n)).collect())
    assert run(3) == [] and run(2) == [(1, "trk_000", 2), (2, "trk_000", 2)] and len(run(1)) == 3


@pytest.mark.parametrize("empty", [True, False])
def test_empty_tables(spark, empty):
    df = spark.createDataFrame([] if empty else [("m", 1)], "m string, i int")
    assert consecutive_windows(df, ["m"], "i", [], 3, 10).count() == 0
