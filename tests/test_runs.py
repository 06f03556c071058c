"""Whole runs over hand-made inputs, and their parameters."""

import pytest
from pyspark.sql import functions as F

from shotlens import config, providers
from shotlens.functions.text import clean_text, line_class
from shotlens.plans import manifest
from shotlens.plans.candidates import WindowRules
from shotlens.plans.llm import INTENTS, prompt, warnings
from shotlens.plans.runs import TextRun, VideoRun, text_run, video_run, write_run
from shotlens.plans.targets import TargetRules
from shotlens.sources import writers

SAID = ["where is the little dog today", "he ran over the green hill again", "then we must follow him at once", "I shall bring a lantern and rope", "the storm will be here very soon"]


def script():
    out = ["INT. FARM HOUSE"]
    for k, text in enumerate(SAID):
        out += ["", " " * 20 + ("DOROTHY" if k % 2 == 0 else "HUNK"), " " * 10 + text, "", "She looks at the door."]
    return "\n".join(out)


def test_text_run(spark, tmp_path):
    shots = spark.createDataFrame([("m", k, f"shot_{k:04d}", 3.0 * k, 3.0 * k + 3.0, t, [t], ["nm1"]) for k, t in enumerate(SAID)], "movie_id string, shot_idx int, shot_id string, shot_start_time double, shot_end_time double, subtitle_text string, subtitle_sentences array<string>, cast_pids array<string>")
    scripts = spark.createDataFrame([("m", script())], "movie_id string, text string")
    run = text_run(shots, scripts, TextRun(windows=WindowRules(longest_sec=15.0)), model=providers.FakeText())
    ctx = run["context"].orderBy("shot_idx").collect()
    assert [r["main_speaker"] for r in ctx] == ["DOROTHY", "HUNK", "DOROTHY", "HUNK", "DOROTHY"] and all(r["match_score"] == 1.0 for r in ctx)
    chosen = run["candidates"].collect()
    assert len(chosen) == 1 and (chosen[0]["start_shot_idx"], chosen[0]["end_shot_idx"], chosen[0]["speaker_changes"]) == (0, 4, 4)
    tasks = run["tasks"].collect()
    assert [t["main_char"] for t in tasks] == ["DOROTHY"] and "OBSERVE" in tasks[0]["prompt"] and "SEARCH" not in tasks[0]["prompt"]
    event = '{"events": [{"shot_id": "shot_0001", "order_in_shot": "1", "duration_ratio": "1", "target": "hunk", "gaze_intent": "OBSERVE"}]}'
    cache = spark.createDataFrame([(tasks[0]["cache_key"], event, 1)], "cache_key string, answer string, ord long")
    again = text_run(shots, scripts, TextRun(windows=WindowRules(longest_sec=15.0)), cache=cache)
    assert [(r["t0"], r["t1"], r["target"]) for r in again["timeline"].collect()] == [(3.0, 6.0, "HUNK")]
    found = again["answers"].select(warnings(F.col("answer.events"), F.array(F.lit("shot_0001")), INTENTS).alias("w")).head()["w"]
    assert found == [] and run["manifest"].count() == 5
    paths = write_run({k: again[k] for k in ("candidates", "timeline")}, str(tmp_path / "out"))
    assert spark.read.parquet(paths["timeline"]).count() == 1 and (tmp_path / "out" / "timeline" / "_SUCCESS").exists()
    writers.write_tasks(run["tasks"], str(tmp_path / "prompts"), "prompt")
    assert len(list((tmp_path / "prompts").glob("sequence_id=*/main_char=DOROTHY/*.txt"))) == 1


def test_video_run_keeps_subject_and_bin(spark):
    shots = spark.createDataFrame([("q", "s1", 1, "two_person_dialogue_simple", ["A"], ["A", "B"]), ("q", "s2", 2, "multi_person", [], [])], "sequence_id string, shot_id string, shot_idx int, stage_type string, aligned_speakers array<string>, active_speakers array<string>")
    crops = spark.createDataFrame([("q", s, i, t, k / 10) for s, i in (("s1", 1), ("s2", 2)) for t in ("trk_000", "trk_001") for k in range(10)], "sequence_id string, shot_id string, shot_idx int, local_track_id string, timestamp_sec double")
    frames = providers.FakeGaze().estimate(crops)
    boxes = crops.select("shot_id", "local_track_id", "timestamp_sec", F.when(F.col("local_track_id") == "trk_000", 100.0).otherwise(10.0).alias("bbox_cx"), F.lit(0.8).alias("track_conf"))
    ids = spark.createDataFrame([("s1", t, f"pid:{p}", p, "", "", 0.9, "linked_pid", 0.8) for t, p in (("trk_000", "nm1"), ("trk_001", "nm2"))], "shot_id string, local_track_id string, global_person_id string, cast_pid string, character_name string, cast_name string, identity_confidence double, identity_status string, track_conf double")
    run = video_run(shots, frames, boxes, ids, VideoRun(targets=TargetRules(ambiguous_margin=0.01)))
    final = run["final"].orderBy("subject_local_track_id", "bin_idx").collect()
    assert [(r["shot_id"], r["subject_local_track_id"], r["bin_idx"]) for r in final] == [("s1", t, b) for t in ("trk_000", "trk_001") for b in (0, 1)]
    assert {r["target_id"] for r in final if r["subject_local_track_id"] == "trk_000"} == {"trk_001"} and final[0]["gaze_quality"] == "gaze_reliable"
    assert run["sequences"].head()["assignment_count"] == 4
    with pytest.raises(ValueError, match="no match for q/s2"):
        video_run(shots.where("shot_id = 's1'"), frames, boxes, ids)


def test_parameters():
    assert config.merged({"a": 1, "b": {"x": 1, "y": 2}}, {"a": None, "b": {"y": 3}}, None, {"c": None}) == {"a": 1, "b": {"x": 1, "y": 3}, "c": None}
    assert config.rules(WindowRules, {"least_shots": 4}).least_shots == 4
    with pytest.raises(ValueError, match="WindowRules has no nothing"):
        config.rules(WindowRules, {"nothing": 1})
    assert config.parse('{"a": [1]}') == {"a": [1]} and config.resolve("x/y", "/r/") == "/r/x/y" and config.resolve("s3://b/x", "/r") == "s3://b/x"
    assert providers.available("json", "no_such_module_here") == {"json": True, "no_such_module_here": False}


def test_retry_waits_for_limits_only():
    waits, calls = [], []

    def call():
        calls.append(1)
        if len(calls) < 3:
            raise RuntimeError("limit: try again in 1.5s")
        return "ok"

    assert providers.with_retry(call, lambda e: "limit" in str(e), lambda e: providers.wait_seconds(str(e)), sleep=waits.append) == "ok" and waits == [1.5, 1.5]
    with pytest.raises(KeyError):
        providers.with_retry(lambda: {}["x"], lambda e: False, lambda e: 0.0)
    assert providers.wait_seconds("no hint") == 3.0 and providers.wait_seconds("try again in 0.1 s") == 0.5


def test_small_values(spark, tmp_path):
    rows = spark.createDataFrame([("\t  a b \r\n",), (None,), (" " * 12 + "JOHN\r",), ("   \t",)], "t string")
    assert [r["c"] for r in rows.select(clean_text(F.col("t")).alias("c")).collect()] == ["a b", "", "JOHN", ""]
    assert [r["c"] for r in rows.select(line_class(F.col("t")).alias("c")).collect()][2:] == ["S", "B"]
    assert "OBSERVE" in spark.range(1).select(prompt(F.struct(F.lit(1).alias("x"))).alias("p")).head()["p"]
    with pytest.raises(ValueError, match="no match for 1, 2"):
        manifest.must_match(spark.range(3), spark.range(1), ["id"])
    protos = spark.createDataFrame([("p", "nm1", [1.0, 0.0])], "prototype_id string, cast_pid string, embedding array<double>")
    writers.write_gallery(protos, str(tmp_path / "g"))
    assert spark.read.parquet(str(tmp_path / "g" / "vectors")).head()["embedding"] == [1.0, 0.0] and spark.read.csv(str(tmp_path / "g" / "index"), header=True).columns == ["prototype_id", "cast_pid"]
    clips = spark.createDataFrame([("a.mp4", 2.0)], "clip_path string, duration double")
    faces = providers.FakeDetector().detect(providers.FakeVideo().frames(clips, 5.0))
    assert faces.count() == 20 and faces.agg(F.max("x2")).head()[0] == 505.0


def test_tracker_against_brute_force(spark):
    """Every track that a shot ever had is looked at, whether it is still live or not."""
    import math
    import random

    from shotlens.operators.tracking import TrackRules, track_boxes

    rng, rules = random.Random(3), TrackRules(least_length=1)
    rows, n = [], 0
    for shot in range(3):
        for frame in sorted(rng.choices(range(40), k=60)):
            x, y = rng.choice((0, 40, 80, 200, 400)) + rng.randint(0, 9), rng.randint(0, 30)
            rows.append((shot, frame, float(x), float(y), float(x + 60), float(y + 60), round(rng.random(), 2), n))
            n += 1
    want = {}
    for shot in range(3):
        seen: list[tuple[int, tuple]] = []
        for r in sorted((r for r in rows if r[0] == shot), key=lambda r: (r[1], -r[6], r[7])):
            box, scored = r[2:6], []
            for k, (frame, at) in enumerate(seen):
                both = max(0, min(box[2], at[2]) - max(box[0], at[0])) * max(0, min(box[3], at[3]) - max(box[1], at[1]))
                iou, far = both / (7200 - both), math.dist(((box[0] + box[2]) / 2, (box[1] + box[3]) / 2), ((at[0] + at[2]) / 2, (at[1] + at[3]) / 2)) / math.hypot(640, 360)
                if 1 <= r[1] - frame <= rules.max_gap + 1 and (iou >= rules.least_iou or far <= rules.most_centre):
                    scored.append((iou - far, -k))
            k = -max(scored)[1] if scored else len(seen)
            seen[k : k + 1] = [(r[1], box)]
            want[r[7]] = f"trk_{k:03d}"
    df = spark.createDataFrame(rows, "shot int, frame int, x1 double, y1 double, x2 double, y2 double, conf double, id int")
    got = {r["id"]: r["local_track_id"] for r in track_boxes(df, ["shot"], "frame", ["x1", "y1", "x2", "y2"], "conf", "id", 640, 360, rules).collect()}
    assert got == want and len(set(want.values())) > 10


def test_stage_tables_meet_without_an_exchange(spark):
    """In the final table only what comes from outside is dealt anew: identities, tracks, shots, and the result to meet these."""
    from shotlens.plans import targets
    from shotlens.session import CO_PARTITION, bucketed

    track = ["shot_id", "local_track_id"]
    bins = spark.range(40).selectExpr("'q' AS sequence_id", "concat('s', id % 5) AS shot_id", "1 AS shot_idx", "concat('trk_', id % 2) AS local_track_id", "id AS bin_idx", "id / 2.0 AS bin_start_sec", "id / 2.0 + 0.5 AS bin_end_sec", "'gaze_reliable' AS gaze_quality", "0.0D AS gaze_angle_x_mean", "0.0D AS gaze_angle_y_mean", "0.0D AS pose_Ry_mean", "1.0D AS valid_ratio", "0.9D AS confidence_mean")
    tracks = spark.createDataFrame([(f"s{i}", f"trk_{k}", 0.1, 10.0 + 90 * k, 0.9) for i in range(5) for k in range(2)], "shot_id string, local_track_id string, timestamp_sec double, bbox_cx double, track_conf double")
    ids = spark.createDataFrame([("s1", "trk_0", "g", "p", "", "", 0.9, "linked_pid", 0.8)], "shot_id string, local_track_id string, global_person_id string, cast_pid string, character_name string, cast_name string, identity_confidence double, identity_status string, track_conf double")
    shots = spark.createDataFrame([("q", f"s{i}", 1, "two_person_dialogue_simple", ["A"], ["A", "B"]) for i in range(5)], "sequence_id string, shot_id string, shot_idx int, stage_type string, aligned_speakers array<string>, active_speakers array<string>")
    plain = targets.candidates(bins, tracks, ids, shots)
    b, c = bucketed(spark, bins, "bins", track), bucketed(spark, plain, "cands", track)
    a = bucketed(spark, targets.assignments(b, c, ids, shots), "assigned", track)
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold", CO_PARTITION)}
    try:
        for k, v in zip(before, ("false", "-1", "false"), strict=True):
            spark.conf.set(k, v)
        final = targets.final_table(b, ids, a, shots, tracks, c)
        plan = final._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 4, plan
        assert sorted(map(repr, final.collect())) == sorted(map(repr, targets.final_table(bins, ids, a.select("*"), shots, tracks, plain).collect())) and final.count() == 40
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_many_bins_are_dealt_by_their_count(spark, monkeypatch):
    """Adaptive execution would put all of these rows together in one task. Nothing is dealt twice for one join."""
    import re

    from shotlens.operators import places
    from shotlens.plans import targets
    from shotlens.session import materialise

    monkeypatch.setattr(places, "TASK_ROWS", 10)
    bins = spark.range(80).selectExpr("'q' AS sequence_id", "concat('s', id % 40) AS shot_id", "1 AS shot_idx", "concat('trk_', id % 2) AS local_track_id", "id AS bin_idx", "id / 2.0 AS bin_start_sec", "id / 2.0 + 0.5 AS bin_end_sec", "if(id % 7 = 0, 'unknown', 'gaze_reliable') AS gaze_quality", "id % 11 / 10.0D - 0.5D AS gaze_angle_x_mean", "0.0D AS gaze_angle_y_mean", "id % 5 / 5.0D - 0.4D AS pose_Ry_mean", "1.0D AS valid_ratio", "0.9D AS confidence_mean")
    bins = materialise(spark, bins.withColumn("bin_start_sec", F.when(F.col("bin_idx") == 0, F.lit(-0.0)).otherwise(F.col("bin_start_sec"))), "bins")
    tracks = spark.createDataFrame([(f"s{i % 40}", f"trk_{k}", i / 2 + 0.1, 10.0 + 90 * k, 0.9) for i in range(80) for k in range(2)], "shot_id string, local_track_id string, timestamp_sec double, bbox_cx double, track_conf double")
    ids = spark.createDataFrame([(f"s{i}", f"trk_{i % 2}", "g", f"p{i % 3}", "", "", 0.9, "linked_pid", 0.8) for i in range(0, 40, 3)], "shot_id string, local_track_id string, global_person_id string, cast_pid string, character_name string, cast_name string, identity_confidence double, identity_status string, track_conf double")
    shots = spark.createDataFrame([("q", f"s{i}", i, "two_person_dialogue_simple", ["A"], ["A", "B"]) for i in range(40)], "sequence_id string, shot_id string, shot_idx int, stage_type string, aligned_speakers array<string>, active_speakers array<string>")
    n = places.tasks_for(bins)
    assert n == 8 and places.tasks_for(bins.limit(40)) is None

    def stages(parts):
        c = targets.candidates(bins, tracks, ids, shots, parts=parts)
        a = targets.assignments(bins, c, ids, shots, parts=parts)
        return c, a, targets.final_table(bins, ids, a, shots, tracks, c, parts)

    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plain, some = stages(None), stages(n)
        for p, s in zip(plain, some, strict=True):
            assert p.columns == s.columns and sorted(map(repr, p.collect())) == sorted(map(repr, s.collect()))
        for s in (some[0], some[2]):
            assert s.select(F.spark_partition_id().alias("p")).distinct().count() > 4
        assert some[0].where("candidate_side = 'right'").count() == some[0].where("candidate_side = 'left'").count() == 40  # boxes are found at -0.0 too
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        for s in stages(n):
            plan = s._jdf.queryExecution().executedPlan().toString()
            assert "REPARTITION_BY_NUM" in plan and not re.search(r"ENSURE_REQUIREMENTS[^\n]*\n(?:[^\n]*Project[^\n]*\n)?[^\n]*REPARTITION_BY_NUM", plan), plan
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
