"""The tie-break with memory over blocks, against a plain loop; places of rows; the live tracker against the batch one."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from shotlens.operators.places import placed
from shotlens.operators.recurrence import Effect, carry_choice, effect_of, winner
from shotlens.operators.tracking import TrackRules, track_boxes

TIES = "array<struct<k1:int,k2:double,k4:int,k5:int,id:string,row:struct<id:string>>>"


def loop(rows):
    """(chosen id or None, by_tie) of each row (fixed id or None, ties) in order."""
    last, out = "", []
    for fixed, ties in rows:
        if fixed is not None:
            out.append((fixed, False))
            last = fixed
            continue
        keys = sorted(((t[0], t[1], int(last != "" and t[4] == last), t[2], t[3], t[4]) for t in ties), reverse=True)
        if keys and (len(keys) == 1 or keys[0][:5] > keys[1][:5]):
            last = keys[0][5]
            out.append((last, True))
        else:
            out.append((None, False))
    return out


def random_rows(rng, n):
    rows = []
    for _ in range(n):
        ties = [(rng.randint(0, 1), rng.choice([0.5, 0.7]), 1, rng.randint(0, 1), i) for i in rng.sample("abcde", rng.randint(0, 3))]
        rows.append((rng.choice("abc") if rng.random() < 0.1 else None, ties))
    return rows


def test_effects_compose_as_rows_do():
    rng = random.Random(1)
    for _ in range(300):
        rows = random_rows(rng, rng.randint(0, 12))
        parts = [effect_of(f is not None, f, [dict(zip(("k1", "k2", "k4", "k5", "id"), t, strict=True)) for t in ties]) for f, ties in rows]
        cut = rng.randint(0, len(parts))
        halves = []
        for some in (parts[:cut], parts[cut:]):
            whole = Effect()
            for p in some:
                whole = whole.then(p)
            halves.append(whole)
        both = halves[0].then(halves[1])
        for last in ("", "a", "b", "c", "d", "e", "z"):
            now = last
            for p in parts:
                now = p(now)
            assert both(last) == halves[1](halves[0](last)) == now
    constant = Effect("a").then(Effect(None, {"a": "b", "c": "d"}))
    assert constant.otherwise == "b" and not constant.given  # a fixed choice leaves one outcome
    assert winner([], "") == -1 and winner([{"k1": None, "k2": 1.0, "k4": 1, "k5": 1, "id": "a"}, {"k1": 0, "k2": float("nan"), "k4": 1, "k5": 1, "id": "b"}], "") == 1


@pytest.mark.parametrize("block", [3, 4096])
def test_choices_of_blocks_equal_the_loop(spark, monkeypatch, block):
    from shotlens.operators import recurrence

    monkeypatch.setattr(recurrence, "FAN", 4)  # three storeys of effects
    rng = random.Random(block)
    streams = {"long": random_rows(rng, 150), "short": random_rows(rng, 2), None: random_rows(rng, 20)}
    rows = [(k, i, (f,) if f is not None else None, [(*t, (t[4],)) for t in ties] if ties or i % 2 else None) for k, r in streams.items() for i, (f, ties) in enumerate(r)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, f"k string, at int, fixed struct<id:string>, ties {TIES}")
    got = {(r["k"], r["at"]): (r["chosen"]["id"] if r["chosen"] else None, r["by_tie"]) for r in carry_choice(df, ["k"], ["at"], "fixed", "ties", block).collect()}
    assert got == {(k, i): x for k, r in streams.items() for i, x in enumerate(loop(r))}
    assert carry_choice(df.limit(0), ["k"], ["at"], "fixed", "ties", block).count() == 0


def test_a_stream_of_many_blocks(spark):
    """200,000 bins of one stream, 49 blocks."""
    n = 200_000
    k = F.col("at") * 7919 % 101
    name = lambda c: F.concat(F.lit("c"), (c % 5).cast("string"))
    tie = lambda c: F.struct(F.lit(1).alias("k1"), F.lit(0.5).alias("k2"), F.lit(1).alias("k4"), F.lit(3).alias("k5"), name(c).alias("id"), F.struct(name(c).alias("id")).alias("row"))
    df = spark.range(n).select(F.lit("s").alias("k"), F.col("id").alias("at")).select("k", "at", F.when(k == 0, F.struct(name(F.col("at")).alias("id"))).alias("fixed"), F.when(k % 3 == 1, F.array(tie(k), tie(k + 1))).when(k == 3, F.array(tie(k))).alias("ties"))
    got = [(r["at"], r["id"]) for r in carry_choice(df, ["k"], ["at"], "fixed", "ties").select("at", "chosen.id").orderBy("at").collect()]
    last, want = "", []
    for at in range(n):
        k, chosen = at * 7919 % 101, None
        if k == 0:
            chosen = f"c{at % 5}"
        elif k == 3:
            chosen = "c3"
        elif k % 3 == 1 and last in (f"c{k % 5}", f"c{(k + 1) % 5}"):
            chosen = last
        last = chosen or last
        want.append((at, chosen))
    assert got == want


def test_places_of_a_hot_group(spark):
    rows = [("hot", i, i % 7) for i in range(500)] + [(None, i, 0) for i in range(20)] + [("one", 5, 5)]
    random.Random(2).shuffle(rows)
    df = spark.createDataFrame(rows, "g string, i int, x int")
    got = placed(spark, df, ["g"], [F.desc("i")], "places").collect()
    assert {(r["g"], r["i"]): (r["place"], r["size"]) for r in got} == {(g, i): {"hot": (499 - i, 500), None: (19 - i, 20), "one": (0, 1)}[g] for g, i, _ in rows}
    assert placed(spark, df.limit(0), ["g"], ["i"], "places").count() == 0


BOX = "shot string, at timestamp, frame int, box_id int, x1 double, y1 double, x2 double, y2 double, conf double"


def test_live_tracks_equal_the_batch_tracker(spark, tmp_path):
    """Files in any order, two runs over one checkpoint, confidences that are equal or missing."""
    from shotlens.streaming.live import run_to_end
    from shotlens.streaming.tracks import finished_tracks, keyed_state, live_tracks

    rng, rows, start = random.Random(5), [], datetime.datetime(2024, 1, 1)
    for shot in ("a", "b", "c"):
        for frame in range(0, 40):
            for k in range(rng.randint(0, 3)):
                x, y = 20 * k + frame * 0.7 + rng.random() * 4, rng.random() * 30
                rows.append((shot, start + datetime.timedelta(seconds=frame), frame, len(rows), x, y, x + 30, y + 30, rng.choice([0.5, 0.9, rng.random()])))
    rng.shuffle(rows)
    for part in range(4):
        spark.createDataFrame(rows[part::4], BOX).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    closing = spark.createDataFrame([("z", start + datetime.timedelta(days=30), 10**6, -1, 0.0, 0.0, 1.0, 1.0, 0.5)], BOX)
    rules = TrackRules(least_length=3)
    follow = lambda r: live_tracks(r, "shot", "at", "frame", ["x1", "y1", "x2", "y2"], "conf", "box_id", 640, 360, 1000, "1 day", rules)
    with keyed_state(spark):
        sent = run_to_end(spark, f"{tmp_path}/in", follow, closing, "live", files_per_trigger=1)
    got = {tuple(r) for r in finished_tracks(sent, "shot", 3).select("shot", "frame", "box_id", "local_track_id", "track_len", F.round("track_conf", 9)).collect()}
    batch = track_boxes(spark.createDataFrame(rows, BOX), ["shot"], "frame", ["x1", "y1", "x2", "y2"], "conf", "box_id", 640, 360, rules)
    want = {tuple(r) for r in batch.select("shot", "frame", "box_id", "local_track_id", "track_len", F.round("track_conf", 9)).collect()}
    assert got == want and len(want) > 100


def test_live_state_holds_live_tracks_only(spark, tmp_path):
    """What is left in the state after the last batch: the tracks that a later frame could go on with."""
    from shotlens.streaming.live import read_events, run_available
    from shotlens.streaming.tracks import keyed_state, live_tracks

    start, keep = datetime.datetime(2024, 1, 1), f"{tmp_path}/kept"
    put = lambda rows: spark.createDataFrame([(s, start + datetime.timedelta(seconds=f), f, i, 0.0, 0.0, 9.0, 9.0, 0.5) for s, f, i in rows], BOX).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    follow = lambda: live_tracks(read_events(spark, f"{tmp_path}/in"), "shot", "at", "frame", ["x1", "y1", "x2", "y2"], "conf", "box_id", 640, 360, 1000, "1 second", TrackRules(max_gap=2))
    with keyed_state(spark):
        put([("a", f, f) for f in range(60)] + [("b", f, 100 + f) for f in range(5)])
        run_available(spark, follow(), "t", keep)
        put([("a", f, f) for f in range(60, 90)])  # a later run goes on with the same track
        sent = run_available(spark, follow(), "t", keep).collect()
        state = lambda name: spark.read.format("statestore").option("stateVarName", name).load(f"{keep}/t-checkpoint")
        live, waiting = state("live").count(), state("waiting").count()
    assert {(r["shot"], r["track"]) for r in sent} == {("a", 0), ("b", 0)} and [(r["shot"], r["track_len"]) for r in sent if r["frame"] is None] == [("b", 5)]
    assert live == 1 and waiting <= 2


def test_a_batch_of_boxes_is_one_message_to_the_state():
    """However many boxes a shot has in a batch, they are appended at once and wait for one timer."""
    import pandas as pd

    from shotlens.streaming.tracks import LiveTracker

    class Handle:
        calls: list = []

        def __getattr__(self, name):
            def call(*args):
                self.calls.append(name)
                return self

            return call

    tracker = LiveTracker("shot", TrackRules(), 640, 360, 1000)
    tracker.init(Handle())
    Handle.calls.clear()
    rows = pd.DataFrame([(1000 * f, f, f, 0.0, 0.0, 9.0, 9.0, 0.5) for f in range(500)], columns=["ms", "frame", "box_id", "x1", "y1", "x2", "y2", "conf"])
    assert all(len(x) == 0 for x in tracker.handleInputRows(("a",), iter([rows]), None))
    assert Handle.calls == ["appendList", "registerTimer"]


def test_blocks_become_objects_one_at_a_time():
    import pyarrow as pa

    from shotlens.operators.recurrence import _each

    values = _each(pa.RecordBatch.from_pydict({"rows": [[{"id": "a"}], [], None]}), "rows")
    assert iter(values) is values and list(values) == [[{"id": "a"}], [], None]
