"""Stage plans: targets, identities, final table and reports, on the cases that their semantics turn on."""

from pyspark.sql import functions as F

from shotlens.plans import qa
from shotlens.plans.identity import alias_table, cascade, gallery_matches, speaker_pids
from shotlens.plans.manifest import manifest, stage_counts, stage_filter
from shotlens.plans.targets import TargetRules, assignments, candidates, final_table
from shotlens.plans.tracks import BinRules, time_bins
from shotlens.providers import FakeText, FakeVideo
from shotlens.sources.readers import read_context, read_csv, read_csv_or_empty, read_jsonl, typed_context
from shotlens.sources.writers import summary_json, write_csv, write_jsonl


def test_stage_filter(spark):
    df = spark.createDataFrame([("1", "single_speaking"), ("2", "two_person_dialogue_simple"), ("3", "multi_person"), ("4", "unknown")], "shot_id string, stage_type string")
    assert sorted(r["shot_id"] for r in stage_filter(df).collect()) == ["1", "2"]
    assert stage_filter(df, "all").count() == 4 and stage_filter(df, "multi_person").count() == 1
    assert {r["stage_type"]: r["n"] for r in stage_counts(df).collect()}["multi_person"] == 1


def test_identity_fallback_and_gallery(spark):
    tracks = spark.createDataFrame([("s1", "trk_000", 0.9)], "shot_id string, local_track_id string, track_conf double")
    none = spark.createDataFrame([], "shot_id string, local_track_id string, pid string, score double, cast_pid string, confidence double")
    cast = spark.createDataFrame([("nm1", 0, ["Dorothy Gale", "DOROTHY"])], "pid string, input_ord int, aliases array<string>")
    shots = spark.createDataFrame([("s1", ["DOROTHY"], ["nm1"])], "shot_id string, speakers array<string>, pids array<string>")
    speakers = speaker_pids(shots.withColumn("shot_ord", F.lit(0)), alias_table(cast))
    people = spark.createDataFrame([("nm1", "J", "Dorothy")], "pid string, cast_name string, character_name string")
    r = cascade(tracks, none, none, shots, speakers, people).head()
    assert (r["cast_pid"], r["identity_source"], r["identity_confidence"], r["identity_status"]) == ("nm1", "single_speaker_single_track", 0.58, "linked_pid")
    protos = spark.createDataFrame([("p0", "nm1", [1.0, 0.0]), ("p1", "nm2", [0.99, 0.01])], "prototype_id string, cast_pid string, embedding array<double>")
    q = lambda v: spark.createDataFrame([("s1", "trk_000", v)], "shot_id string, local_track_id string, embedding array<double>")
    assert gallery_matches(q([1.0, 0.0]), shots.withColumn("pids", F.array().cast("array<string>")), protos).count() == 0  # the margin is too small
    assert gallery_matches(q([0.0, 1.0]), shots, protos).count() == 0  # of nm1 only, whose score is too low
    assert gallery_matches(q([1.0, 0.0]), shots, protos).head()["confidence"] == 0.95


BINS = "sequence_id string, shot_id string, shot_idx int, local_track_id string, bin_idx long, bin_start_sec double, bin_end_sec double, gaze_quality string, gaze_angle_x_mean double, gaze_angle_y_mean double, pose_Ry_mean double, valid_ratio double, confidence_mean double"


def stage(spark, quality=("gaze_reliable",), gaze=0.5):
    bins = spark.createDataFrame([("q", "s1", 1, "trk_000", i, float(i), i + 1.0, k, gaze, 0.0, 0.4, 1.0, 0.9) for i, k in enumerate(quality)], BINS)
    tracks = spark.createDataFrame([("s1", t, i + 0.1, x, 0.8) for i in range(len(quality)) for t, x in (("trk_000", 10.0), ("trk_001", 100.0))], "shot_id string, local_track_id string, timestamp_sec double, bbox_cx double, track_conf double")
    ids = spark.createDataFrame([("s1", t, f"pid:{p}", p, "", "", 0.9, "linked_pid", 0.8) for t, p in (("trk_000", "nm1"), ("trk_001", "nm2"))], "shot_id string, local_track_id string, global_person_id string, cast_pid string, character_name string, cast_name string, identity_confidence double, identity_status string, track_conf double")
    shots = spark.createDataFrame([("q", "s1", 1, "two_person_dialogue_simple", ["A"], ["A", "B"])], "sequence_id string, shot_id string, shot_idx int, stage_type string, aligned_speakers array<string>, active_speakers array<string>")
    return bins, tracks, ids, shots


def test_target_with_identity(spark):
    bins, tracks, ids, shots = stage(spark)
    rules = TargetRules(least_score=0.1, ambiguous_margin=0.01, require_quality=False)
    c = candidates(bins, tracks, ids, shots, rules)
    r = assignments(bins, c, ids, shots, rules).head()
    assert (r["target_id"], r["target_cast_pid"], r["target_global_person_id"], r["proxy_status"], r["subject_cast_pid"]) == ("trk_001", "nm2", "pid:nm2", "assigned", "nm1")
    f = final_table(bins, ids, assignments(bins, c, ids, shots, rules), shots, tracks, c).head()
    assert (f["target_id"], f["proxy_status"], f["has_onscreen_person_candidate"], f["candidate_count"]) == ("trk_001", "assigned", 1, 7) and "trk_001" in f["candidate_list"]
    bare = final_table(bins, ids.limit(0), assignments(bins.limit(0), c, ids, shots, rules), shots, tracks, c.limit(0)).head()
    assert (bare["failure_reason"], bare["identity_status"], bare["candidate_list"], bare["target_type"]) == ("missing_assignment", "unknown", "[]", "unknown")


def test_smoothing(spark):
    bins, tracks, ids, shots = stage(spark, ("gaze_reliable", "unknown", "gaze_reliable"))
    rows = assignments(bins, candidates(bins, tracks, ids, shots), ids, shots, TargetRules(ambiguous_margin=0.10)).orderBy("bin_idx").collect()
    assert [(r["raw_proxy_status"], r["raw_failure_reason"], r["proxy_status"], r["smoothing_applied"]) for r in rows] == [("assigned", "assigned", "assigned", 0), ("unknown", "gaze_quality_unknown", "assigned", 1), ("assigned", "assigned", "assigned", 0)]
    assert rows[1]["proxy_confidence"] == 0.9 and rows[1]["prev_target_id"] == "trk_001" and rows[0]["prev_target_id"] == ""


CAND = "sequence_id string, shot_id string, local_track_id string, bin_idx long, candidate_type string, candidate_id string, candidate_global_person_id string, candidate_cast_pid string, candidate_identity_confidence double, total_score double"


def test_low_score_and_low_margin(spark):
    bins, _, ids, shots = stage(spark)
    quiet = shots.withColumn("active_speakers", F.array().cast("array<string>")).withColumn("aligned_speakers", F.array().cast("array<string>"))
    one = lambda *rows: spark.createDataFrame([("q", "s1", "trk_000", 0, k, i, "", "", 0.0, s) for k, i, s in rows], CAND)
    low = assignments(bins, one(("offscreen_participant", "A", 0.1)), ids, quiet).head()
    assert (low["proxy_status"], low["failure_reason"], low["target_id"]) == ("rejected", "low_score", "unknown")
    near = assignments(bins, one(("offscreen_participant", "A", 0.60), ("offscreen_participant", "B", 0.58)), ids, quiet).head()
    assert (near["proxy_status"], near["failure_reason"], near["target_type"], near["target_id"]) == ("ambiguous", "low_margin", "ambiguous", "A")


def test_time_bins(spark):
    rows = [("t", 0.0, 1, 1.0, 0.5), ("t", 0.25, 1, 2.0, 0.5), ("t", 0.3, 1, 4.0, 0.5), ("t", 0.4, 1, 8.0, 0.5), ("t", 0.45, 0, 9.0, 0.5), ("t", 0.6, 0, 1.0, 0.5)]
    df = spark.createDataFrame(rows, "track string, ts double, success int, gaze_angle_x double, confidence double")
    out = time_bins(df, ["track"], F.col("ts"), BinRules(), pose=[], gaze=["gaze_angle_x"]).orderBy("bin_idx").collect()
    assert [(r["bin_idx"], r["n_frames_total"], r["n_frames_valid"], r["gaze_angle_x_std"]) for r in out] == [(0, 5, 4, 2.680951), (1, 1, 0, None)]


def test_reports(spark):
    labels = spark.createDataFrame([("m", "assigned", "wrong_target"), ("m", "assigned", ""), ("m", "low_score", "correct")], "movie_id string, sample_bucket string, human_label string")
    got = {r["sample_bucket"]: (r["precision"], r["sft_ready"]) for r in qa.label_precision(labels, ["movie_id", "sample_bucket"]).collect()}
    assert got == {"assigned": (0.0, False), "low_score": (1.0, True)}
    cal = spark.createDataFrame([("left", "left", "right")], "h string, g string, p string")
    r = qa.calibration(cal, "h", "g", "p").head()
    assert (r["gaze_lr_accuracy"], r["pose_lr_accuracy"], r["gaze_pose_conflict_count"], r["likely_pose_sign_flipped"]) == (1.0, 0.0, 1, True)
    rows = [(i, "assigned", "", "", "left", "right", "gaze_reliable") for i in range(20)] + [(20 + i, "low_score", "", "", "center", "center", "") for i in range(5)] + [(30 + i, "low_margin", "", "", "center", "center", "") for i in range(5)]
    rows[3] = (3, "assigned", "wrong_target", "gaze/head", "left", "right", "gaze_reliable")
    s = spark.createDataFrame(rows, "id int, sample_bucket string, human_label string, human_notes string, gaze_direction_bucket string, pose_direction_bucket string, gaze_quality string")
    chosen, short = qa.comparison_samples(s, "id", "id")
    kinds = [r["sample_subtype"] for r in chosen.collect()]
    assert len(kinds) == 25 and kinds.count("wrong_target") == 1 and kinds.count("assigned_high_risk") == 4
    assert sum(r["shortfall"] for r in short.where("sample_subtype <> 'wrong_target'").collect()) == 0


def test_files_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("m", 1, ["a", "b"], 'x "q"\ny'), ("m", 2, None, None)], "movie_id string, shot_idx int, aligned_speakers array<string>, subtitle_text string")
    write_csv(df, str(tmp_path / "c"), ["movie_id", "shot_idx", "aligned_speakers", "subtitle_text", "gone"])
    back = read_csv(spark, str(tmp_path / "c"), ["movie_id"]).orderBy("shot_idx").collect()
    assert back[0]["subtitle_text"] == 'x "q"\ny' and back[0]["gone"] is None
    ctx = typed_context(read_csv(spark, str(tmp_path / "c"))).orderBy("shot_idx").collect()
    assert ctx[0]["aligned_speakers"] == ["a", "b"] and ctx[0]["main_speaker"] == "a" and ctx[1]["has_dialogue_text"] is False
    write_jsonl(df, str(tmp_path / "j"))
    assert read_jsonl(spark, str(tmp_path / "j"), "movie_id string, shot_idx int").count() == 2
    assert read_csv_or_empty(spark, str(tmp_path / "none"), ["a"]).columns == ["a"]
    assert '"n": 2' in summary_json(df.agg(F.count("*").alias("n")))
    assert callable(read_context)


def test_providers_and_manifest(spark):
    clips = spark.createDataFrame([("a.mp4", 2.0)], "clip_path string, duration double")
    f = FakeVideo().frames(clips, 5.0).orderBy("frame_idx").collect()
    assert [r["frame_idx"] for r in f] == list(range(0, 50, 5)) and f[1]["timestamp_sec"] == 0.2
    assert FakeText().complete(spark.createDataFrame([("p",)], "prompt string")).head()["answer"] == '{"events": []}'
    pk = spark.createDataFrame([("q", [(3, 1.0, 2.5, "hi", 2)])], "sequence_id string, shots array<struct<shot_idx:int,shot_start_time:double,shot_end_time:double,subtitle_text:string,num_cast:int>>")
    r = manifest(pk).head()
    assert (r["shot_id"], r["duration"], r["stage_type"]) == ("shot_0003", 1.5, "two_person_dialogue_simple")
