"""Gaze targets: candidates for each subject and bin, their scores, the assignment with its tie-breaks, and smoothing."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shotlens.functions.geometry import side_of
from shotlens.functions.numeric import clamp, direction_bucket, finite_float
from shotlens.functions.text import normalize_label
from shotlens.operators.recurrence import carry_choice
from shotlens.operators.interval import contained
from shotlens.operators.places import dealt
from shotlens.operators.windows import adjacent_values, neighbour_union, smooth_isolated
from shotlens.session import materialise

# Rank of the candidate types in ties, source of a tie's winner, types that name nobody.
PRIORITY = {"onscreen_local_track": 5, "current_speaker": 4, "offscreen_participant": 3, "offscreen_place_or_away": 2, "down_self_or_think": 1}
TIE_SOURCE = "openface_rule+tie_break:active_participant,identity_confidence,temporal_continuity,non_generic_away"
GENERIC = ("offscreen_place_or_away", "down_self_or_think", "unknown")
BIN = ("sequence_id", "shot_id", "local_track_id", "bin_idx")
SHOT, TRACK = ("sequence_id", "shot_id"), ("shot_id", "local_track_id")


@dataclass(frozen=True)
class TargetRules:
    direction: float = 0.20
    pose: float = 0.25
    least_score: float = 0.55
    ambiguous_margin: float = 0.15
    require_quality: bool = True
    identity: float = 0.60
    current_speaker: bool = True
    offscreen: bool = True


def start_key(start: str) -> Column:
    """A bin's start as text, equal for equal numbers. Spark rewrites keys that are doubles for its joins, and would deal
    rows that were dealt by them once more."""
    return (F.col(start) + F.lit(0.0)).cast("string").alias("__start")


def bin_boxes(tracks: DataFrame, bins: DataFrame, width: float = 0.5) -> DataFrame:
    """Mean centre of every track of a shot in every bin of it: shot_id, track, bin_start_sec, cx. Boxes meet bins by an
    equi-join on the shot and cells of `width` seconds, the usual width of a bin (others are right too)."""
    spans = bins.select("shot_id", "bin_start_sec", "bin_end_sec").distinct()
    return contained(tracks, spans, ["shot_id"], "timestamp_sec", "bin_start_sec", "bin_end_sec", width).groupBy("shot_id", F.col("local_track_id").alias("track"), "bin_start_sec").agg(F.avg("bbox_cx").alias("cx"))


def reverse_labels(shots: DataFrame, identities: DataFrame, least: float = 0.60) -> DataFrame:
    """sequence_id, shot_id, reverse_labels: whom the shots before and after (by the number of shot_idx) surely show."""
    names = F.array_distinct(F.filter(F.transform(F.array("cast_pid", "character_name", "cast_name"), normalize_label), lambda x: x != ""))
    sure = identities.where(F.col("identity_confidence") >= least).select("shot_id", F.explode(names).alias("l")).groupBy("shot_id").agg(F.sort_array(F.collect_set("l")).alias("labels"))
    rows = shots.join(sure, "shot_id", "left").withColumns({"labels": F.coalesce("labels", F.array().cast("array<string>")), "__n": F.coalesce(F.col("shot_idx").try_cast("double"), F.lit(0.0))})
    return neighbour_union(rows, ["sequence_id"], ["__n", "shot_id"], "labels", "reverse_labels").select("sequence_id", "shot_id", "reverse_labels")


def side_score(direction: Column, side: Column, match: float, conflict: float, centre: float) -> Column:
    return F.when((direction == "unknown") | (side == "unknown"), 0.0).when((direction == "center") | (side == "center"), centre).when(direction == side, match).otherwise(conflict)


def score(kind: Column, side: Column, identity: Column, gaze: Column, pose: Column, gaze_y: Column, quality: Column, stage: Column, visible: Column, label: Column, subject: Column, active: Column, aligned: Column, reverse: Column, rules: TargetRules = TargetRules()) -> Column:
    """A struct of six components, the note and the total (clamped to 0..1, six decimals before any comparison).

    `label`, and the arrays subject, active, aligned and reverse, are normalised labels."""
    alone = (stage == "single_speaking") | (visible <= 1)
    turned = F.when(gaze != "center", 0.10).otherwise(0.0)
    on, speaks, off, down, away = (kind == k for k in ("onscreen_local_track", "current_speaker", "offscreen_participant", "down_self_or_think", "offscreen_place_or_away"))
    has = lambda a: F.coalesce(F.array_contains(a, label), F.lit(False))
    two = on & (stage == "two_person_dialogue_simple") & gaze.isin("left", "right") & (gaze == side)
    below = F.coalesce(finite_float(gaze_y) > rules.direction, F.lit(False))
    lateral = gaze.isin("left", "right") | pose.isin("left", "right")
    itself, other, back, live = speaks & alone & has(subject), off & alone & ~has(aligned), off & has(reverse), off & has(active)
    plus = lambda c, x: F.when(c, x).otherwise(0.0)
    direction = F.when(on, side_score(gaze, side, 0.45, -0.30, 0.05) + plus(two, 0.15)).when(speaks | off, turned).when(down, plus(below, 0.25)).when(away, plus(lateral, 0.20)).otherwise(0.0)
    body = F.when(on, side_score(pose, side, 0.25, -0.15, 0.03)).otherwise(0.0)
    who = plus(on & (identity >= rules.identity), 0.08)
    dialogue = F.when(speaks, 0.35 - plus(itself, 0.22)).when(off, 0.20 + plus(other, 0.25) + plus(back, 0.18) + plus(live, 0.05)).when(down | away, 0.05).otherwise(0.0)
    good = F.when(quality == "gaze_reliable", 0.15).when(quality == "pose_fallback", 0.05).otherwise(0.0)
    doubt = F.when(kind == "unknown", 0.0).otherwise(F.when(quality == "pose_fallback", 0.05).when(quality == "unknown", 0.5).otherwise(0.0) + plus(on & (identity > 0) & (identity < rules.identity), 0.04))
    notes = F.array(
        F.when(two, "two_person_visible_direction_prior"), F.when(on, F.concat(F.lit("onscreen_side="), side)), F.when(itself, "single_visible_speaker_is_subject"), F.when(speaks, "speaker_prior"), F.when(other, "single_visible_interlocutor_prior"),
        F.when(back, "reverse_shot_prior"), F.when(live, "active_participant_prior"), F.when(off, "participant_prior"), F.when(down & below, "positive_gaze_y"), F.when(away & lateral, "lateral_away"),
    )
    r = lambda c, n: F.bround(c, 6).alias(n)
    return F.struct(
        r(direction, "direction_score"), r(body, "pose_score"), r(who, "identity_score"), r(dialogue, "dialogue_score"), r(good, "quality_score"), r(doubt, "uncertainty_penalty"),
        F.array_join(F.filter(notes, lambda x: x.isNotNull()), ";").alias("score_note"), r(clamp(direction + body + who + dialogue + good - doubt), "total_score"),
    )


def candidates(bins: DataFrame, tracks: DataFrame, identities: DataFrame, shots: DataFrame, rules: TargetRules = TargetRules(), parts: int | None = None) -> DataFrame:
    """Every candidate of every bin with its score; one row per (bin, type, id).

    bins: BIN, shot_idx, bin_start_sec, bin_end_sec, gaze_quality, gaze_angle_x_mean, gaze_angle_y_mean, pose_Ry_mean; tracks:
    shot_id, local_track_id, timestamp_sec, bbox_cx; identities: shot_id, local_track_id, global_person_id, cast_pid,
    character_name, cast_name, identity_confidence; shots: sequence_id, shot_id, shot_idx, stage_type, aligned_speakers[],
    active_speakers[]. parts: places.tasks_for(bins), if the bins are many."""
    who = identities.dropDuplicates(TRACK)
    names = F.array_distinct(F.transform(F.array("cast_pid", "character_name", "cast_name"), normalize_label))
    in_shot = tracks.groupBy("shot_id").agg(F.sort_array(F.collect_set("local_track_id")).alias("visible"))
    at = bin_boxes(tracks, bins).select("shot_id", "track", start_key("bin_start_sec"), "cx")
    rev = reverse_labels(shots.select("sequence_id", "shot_id", "shot_idx").distinct(), who, rules.identity)
    b = bins.withColumns({"gaze_dir": direction_bucket(F.col("gaze_angle_x_mean"), rules.direction), "pose_dir": direction_bucket(F.col("pose_Ry_mean"), rules.pose)})
    b = dealt(b, parts, *SHOT).join(shots.drop("shot_idx").dropDuplicates(SHOT), list(SHOT), "left").join(rev, list(SHOT), "left")
    b = dealt(b, parts, "shot_id").join(in_shot, "shot_id", "left")
    b = dealt(b, parts, *TRACK).join(who.select("shot_id", "local_track_id", names.alias("subject_labels")), ["shot_id", "local_track_id"], "left")
    nothing = F.array().cast("array<string>")
    b = b.withColumns({c: F.coalesce(c, nothing) for c in ("aligned_speakers", "active_speakers", "visible", "reverse_labels")} | {"subject_labels": F.coalesce("subject_labels", F.array(F.lit(""))), "stage_type": F.coalesce("stage_type", F.lit(""))})
    b = dealt(b.withColumn("__start", start_key("bin_start_sec")), parts, *TRACK, "__start").join(at.select("shot_id", F.col("track").alias("local_track_id"), "__start", F.col("cx").alias("subject_cx")), [*TRACK, "__start"], "left")
    spec = lambda kind, ident, side: F.struct(F.lit(kind).alias("candidate_type"), ident.alias("candidate_id"), F.lit(side).cast("string").alias("side0"))
    each = lambda a, kind, side: F.transform(a, lambda x: spec(kind, x, side))
    specs = [each(F.filter("visible", lambda x: x != F.col("local_track_id")), "onscreen_local_track", None)]
    if rules.current_speaker:
        specs.append(each(F.col("aligned_speakers"), "current_speaker", "offscreen"))
    if rules.offscreen:
        specs.append(each(F.filter("active_speakers", lambda x: (x != "") & ~F.array_contains(F.col("visible"), x)), "offscreen_participant", "offscreen"))
    specs.append(F.array(spec("down_self_or_think", F.lit("down_self_or_think"), "self"), spec("offscreen_place_or_away", F.lit("offscreen_place_or_away"), "offscreen"), spec("unknown", F.lit("unknown"), "unknown")))
    c = b.withColumn("c", F.explode(F.array_distinct(F.concat(*specs)))).select("*", "c.*").drop("c")
    seen = F.col("candidate_type") == "onscreen_local_track"
    c = c.withColumn("candidate_local_track_id", F.when(seen, F.col("candidate_id")).otherwise(""))
    c = dealt(c, parts, "shot_id", "candidate_local_track_id", "__start").join(at.select("shot_id", F.col("track").alias("candidate_local_track_id"), "__start", F.col("cx").alias("target_cx")), ["shot_id", "candidate_local_track_id", "__start"], "left")
    c = dealt(c, parts, "shot_id", "candidate_local_track_id").join(who.select("shot_id", F.col("local_track_id").alias("candidate_local_track_id"), F.col("global_person_id").alias("candidate_global_person_id"), F.col("cast_pid").alias("candidate_cast_pid"), F.col("identity_confidence").alias("candidate_identity_confidence")), ["shot_id", "candidate_local_track_id"], "left")
    c = c.withColumns({"candidate_side": F.when(seen, side_of(F.col("subject_cx"), F.col("target_cx"))).otherwise(F.col("side0")), "candidate_identity_confidence": F.coalesce("candidate_identity_confidence", F.lit(0.0)), "candidate_global_person_id": F.coalesce("candidate_global_person_id", F.lit("")), "candidate_cast_pid": F.coalesce("candidate_cast_pid", F.lit(""))})
    labels = lambda a: F.transform(a, normalize_label)
    s = score(F.col("candidate_type"), F.col("candidate_side"), F.col("candidate_identity_confidence"), F.col("gaze_dir"), F.col("pose_dir"), F.col("gaze_angle_y_mean"), F.col("gaze_quality"), F.col("stage_type"), F.size("visible"), normalize_label(F.col("candidate_id")), F.col("subject_labels"), labels(F.col("active_speakers")), labels(F.col("aligned_speakers")), F.col("reverse_labels"), rules)
    kept = [*BIN, "candidate_type", "candidate_id", "candidate_local_track_id", "candidate_global_person_id", "candidate_cast_pid", "candidate_identity_confidence", "candidate_side"]
    return c.withColumn("s", s).select(*kept, F.col("gaze_dir").alias("gaze_direction_bucket"), F.col("pose_dir").alias("pose_direction_bucket"), "s.*")


def priority(kind: Column) -> Column:
    out = F.lit(0)
    for k, n in PRIORITY.items():
        out = F.when(kind == k, n).otherwise(out)
    return out


def status_of(reason: Column) -> Column:
    return F.when(reason == "assigned", "assigned").when(reason == "low_margin", "ambiguous").when(reason == "low_score", "rejected").otherwise("unknown")


def assignments(bins: DataFrame, cands: DataFrame, identities: DataFrame, shots: DataFrame, rules: TargetRules = TargetRules(), parts: int | None = None) -> DataFrame:
    """One row per bin: the target, the status and reason, scores and margin, before and after smoothing, and the targets of the
    neighbouring rows.

    The two best of a bin decide; only bins within the margin go through the fold that remembers a stream's last choice. What
    the bins need of their candidates is written once, without the rest. parts: as for `candidates`."""
    stream = ["sequence_id", "shot_id", "local_track_id"]
    ctx = shots.select("sequence_id", "shot_id", F.transform(F.coalesce("active_speakers", F.array().cast("array<string>")), normalize_label).alias("__act"), F.transform(F.coalesce("aligned_speakers", F.array().cast("array<string>")), normalize_label).alias("__ali")).dropDuplicates(SHOT)
    label = normalize_label(F.col("candidate_id"))
    live = F.when(label == "", 0).when(F.coalesce(F.array_contains("__act", label), F.lit(False)), 2).when(F.coalesce(F.array_contains("__ali", label), F.lit(False)), 1).otherwise(0)
    row = F.struct(F.col("candidate_id").alias("id"), F.col("candidate_type").alias("kind"), F.col("total_score").alias("score"), F.col("candidate_global_person_id").alias("person"), F.col("candidate_cast_pid").alias("pid"), F.col("candidate_identity_confidence").alias("identity"))
    item = F.struct("total_score", priority(F.col("candidate_type")).alias("priority"), "candidate_id", live.alias("live"), F.col("candidate_identity_confidence").alias("identity"), (~F.col("candidate_type").isin(*GENERIC)).cast("int").alias("specific"), row.alias("row"))
    listed = dealt(cands, parts, *SHOT).join(ctx, list(SHOT), "left").groupBy(*BIN).agg(F.sort_array(F.collect_list(F.when(F.col("candidate_type") != "unknown", item)), asc=False).alias("ranked"), F.count("*").alias("candidate_count"))
    b = dealt(bins, parts, *BIN).join(listed, list(BIN), "left").withColumn("candidate_count", F.coalesce("candidate_count", F.lit(0)))
    n = F.coalesce(F.size("ranked"), F.lit(0))
    top, second = F.try_element_at("ranked", F.lit(1)), F.try_element_at("ranked", F.lit(2))
    b = b.withColumns({"top_score": F.coalesce(top["total_score"], F.lit(0.0)), "second_score": F.coalesce(second["total_score"], F.lit(0.0))}).withColumn("score_margin", F.bround(F.col("top_score") - F.col("second_score"), 6))
    tied = (n > 1) & (F.col("score_margin") < rules.ambiguous_margin)
    reason = F.when(F.lit(rules.require_quality) & (F.coalesce("gaze_quality", F.lit("")) == "unknown"), "gaze_quality_unknown").when(n <= 0, "no_candidate").when(F.col("top_score") < rules.least_score, "low_score").when(tied, "low_margin").otherwise("assigned")
    near = F.filter("ranked", lambda x: F.bround(F.col("top_score") - x["total_score"], 6) < rules.ambiguous_margin)
    tie = F.transform(near, lambda x: F.struct(x["live"].alias("k1"), x["identity"].alias("k2"), x["specific"].alias("k4"), x["priority"].alias("k5"), x["row"]["id"].alias("id"), x["row"].alias("row")))
    b = b.withColumn("reason", reason).withColumns({"__fixed": F.when(F.col("reason") == "assigned", top["row"]), "__ties": F.when(F.col("reason") == "low_margin", tie).otherwise(F.filter(tie, lambda x: F.lit(False))), "__top_id": top["candidate_id"]})
    b = materialise(bins.sparkSession, b.drop("ranked"), "ranked-bins")
    chosen = carry_choice(dealt(b.select(*BIN, "bin_start_sec", "__fixed", "__ties"), parts, *stream), stream, ["bin_start_sec", "bin_idx"], "__fixed", "__ties")
    at = [*BIN, "__start"]
    b = dealt(b.drop("__fixed", "__ties").withColumn("__start", start_key("bin_start_sec")), parts, *at).join(chosen.withColumn("__start", start_key("bin_start_sec")).drop("bin_start_sec"), at, "left").withColumn("raw_failure_reason", F.when(F.coalesce("by_tie", F.lit(False)), "assigned").otherwise(F.col("reason")))
    got = F.col("chosen")
    b = b.withColumn("raw_proxy_status", status_of(F.col("raw_failure_reason")))
    low = F.col("raw_failure_reason") == "low_margin"
    who = identities.dropDuplicates(TRACK).select(*TRACK, F.col("global_person_id").alias("subject_global_person_id"), F.col("cast_pid").alias("subject_cast_pid"), F.col("identity_confidence").alias("subject_identity_confidence"))
    b = dealt(b, parts, *TRACK).join(who, list(TRACK), "left").withColumns({"subject_global_person_id": F.coalesce("subject_global_person_id", F.lit("")), "subject_cast_pid": F.coalesce("subject_cast_pid", F.lit("")), "subject_identity_confidence": F.coalesce("subject_identity_confidence", F.lit(0.0))})
    sure = F.col("subject_identity_confidence") >= rules.identity
    b = b.withColumns({
        "target_type": F.when(low, "ambiguous").otherwise(F.coalesce(got["kind"], F.lit("unknown"))), "target_id": F.when(low, F.col("__top_id")).otherwise(F.coalesce(got["id"], F.lit("unknown"))),
        "target_global_person_id": F.when(sure, F.coalesce(got["person"], F.lit(""))).otherwise(""), "target_cast_pid": F.when(sure, F.coalesce(got["pid"], F.lit(""))).otherwise(""), "target_identity_confidence": F.when(sure, F.coalesce(got["identity"], F.lit(0.0))).otherwise(0.0),
        "proxy_confidence": F.when(low, F.col("top_score")).otherwise(F.coalesce(got["score"], F.lit(0.0))), "proxy_status": F.col("raw_proxy_status"),
        "gaze_direction_bucket": direction_bucket(F.col("gaze_angle_x_mean"), rules.direction), "pose_direction_bucket": direction_bucket(F.col("pose_Ry_mean"), rules.pose),
    })
    copy = ["target_type", "target_id", "target_global_person_id", "target_cast_pid", "target_identity_confidence"]
    b = smooth_isolated(b, stream, ["bin_start_sec", "bin_idx"], "proxy_status", ["target_id", "target_type"], copy, "proxy_confidence")
    b = b.withColumns({"failure_reason": F.when(F.col("smoothing_applied") == 1, "assigned").otherwise(F.col("raw_failure_reason")), "proxy_source": F.when(F.col("smoothing_applied") == 1, "openface_rule+temporal_smoothing").when(F.coalesce("by_tie", F.lit(False)), TIE_SOURCE).otherwise("openface_rule")})
    b = b.withColumn("__shot", F.col("shot_idx").cast("string"))  # a text order, on purpose
    b = adjacent_values(b, ["sequence_id"], ["__shot", "local_track_id", "bin_start_sec", "bin_idx"], ["local_track_id"], "target_id", "prev_target_id", "next_target_id")
    return b.drop("reason", "__start", "__top_id", "chosen", "by_tie", "__shot")


def sequence_report(assigned: DataFrame) -> DataFrame:
    """A package per sequence: rows, candidates, and counts by type, status and reason as maps."""
    counts = []
    for c in ("target_type", "proxy_status", "failure_reason"):
        per = assigned.groupBy("sequence_id", c).agg(F.count("*").alias("n")).groupBy("sequence_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(c, "n")))).alias(f"{c}_counts"))
        counts.append(per)
    out = assigned.groupBy("sequence_id").agg(F.count("*").alias("assignment_count"), F.sum("candidate_count").alias("candidate_count"))
    for per in counts:
        out = out.join(per, "sequence_id")
    return out


def histograms(df: DataFrame, group: str, columns: Sequence[str]) -> DataFrame:
    """Counts of each column's values, overall and by group, from one scan: metric, value, group (null: overall), n."""
    long = df.select(F.col(group).alias("grp"), F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).cast("string").alias("value")) for c in columns))).alias("x")).select("grp", "x.*")
    return long.groupingSets([[F.col("metric"), F.col("value")], [F.col("metric"), F.col("value"), F.col("grp")]], F.col("metric"), F.col("value"), F.col("grp")).agg(F.count("*").alias("n"), F.grouping("grp").alias("overall"))


def final_table(bins: DataFrame, identities: DataFrame, assigned: DataFrame, shots: DataFrame, tracks: DataFrame, cands: DataFrame, parts: int | None = None) -> DataFrame:
    """One row per subject and bin from six tables. A blank assignment field falls through to the identity's; a missing
    assignment has its own defaults. parts: as for `candidates`; None for tables that lie in buckets of a track."""
    key = list(BIN)
    who = identities.dropDuplicates(TRACK).select(*TRACK, F.col("global_person_id").alias("i_person"), F.col("cast_pid").alias("i_pid"), F.col("identity_confidence").alias("i_conf"), F.col("identity_status").alias("i_status"), F.col("track_conf").alias("i_track"))
    a = assigned.select(*key, F.lit(1).alias("__a"), *(F.col(c).alias(f"a_{c}") for c in ("subject_global_person_id", "subject_cast_pid", "subject_identity_confidence", "gaze_direction_bucket", "pose_direction_bucket", "candidate_count", "target_type", "target_id", "target_global_person_id", "proxy_confidence", "proxy_status", "proxy_source", "failure_reason", "top_score", "second_score", "score_margin"))).dropDuplicates(key)
    kinds = F.collect_set("candidate_type")
    c = dealt(cands, parts, *key).groupBy(*key).agg(F.count("*").alias("c_count"), kinds.alias("c_kinds"), F.to_json(F.sort_array(F.collect_list(F.struct("candidate_type", "candidate_id", "candidate_global_person_id", "candidate_cast_pid", "candidate_side", "total_score")))).alias("c_list"))
    t = tracks.groupBy(*TRACK).agg(F.bround(F.avg("track_conf"), 6).alias("t_conf"))
    m = shots.select("shot_id", "stage_type").dropDuplicates(["shot_id"])
    # tables that are dealt by the track meet first; the shots' stages, a row a shot, come last
    j = dealt(dealt(bins, parts, *key).join(a, key, "left").join(c, key, "left"), parts, *TRACK)
    j = dealt(j.join(who, list(TRACK), "left").join(t, list(TRACK), "left"), parts, "shot_id").join(m, "shot_id", "left")
    text = lambda x, y: F.coalesce(F.nullif(x, F.lit("")), y, F.lit(""))
    given = lambda n, d: F.when(F.col("__a").isNull(), F.lit(d)).otherwise(F.col(f"a_{n}")).alias(n)
    has = lambda *k: F.coalesce(F.arrays_overlap("c_kinds", F.array(*(F.lit(x) for x in k))), F.lit(False)).cast("int")
    return j.select(
        "sequence_id", "shot_id", "shot_idx", F.coalesce("stage_type", F.lit("")).alias("stage_type"), "bin_idx", "bin_start_sec", "bin_end_sec", F.col("local_track_id").alias("subject_local_track_id"),
        text(F.col("a_subject_global_person_id"), F.col("i_person")).alias("subject_global_person_id"), text(F.col("a_subject_cast_pid"), F.col("i_pid")).alias("subject_cast_pid"), F.coalesce("a_subject_identity_confidence", "i_conf", F.lit(0.0)).alias("identity_confidence"), text(F.col("i_status"), F.lit("unknown")).alias("identity_status"),
        "gaze_quality", F.coalesce("a_gaze_direction_bucket", direction_bucket(F.col("gaze_angle_x_mean"), 0.20)).alias("gaze_direction_bucket"), F.coalesce("a_pose_direction_bucket", direction_bucket(F.col("pose_Ry_mean"), 0.25)).alias("pose_direction_bucket"), "gaze_angle_x_mean", "gaze_angle_y_mean", "valid_ratio", F.col("confidence_mean").alias("openface_confidence"),
        F.coalesce("i_track", "t_conf").alias("track_confidence"), F.coalesce("a_candidate_count", "c_count", F.lit(0)).alias("candidate_count"), has("onscreen_local_track").alias("has_onscreen_person_candidate"), has("current_speaker", "offscreen_participant").alias("has_offscreen_person_candidate"), has("current_speaker").alias("current_speaker_available"), F.coalesce("c_list", F.lit("[]")).alias("candidate_list"),
        given("target_type", "unknown"), given("target_id", "unknown"), given("target_global_person_id", ""), given("proxy_confidence", 0.0), given("proxy_status", "unknown"), given("proxy_source", ""), given("failure_reason", "missing_assignment"), given("top_score", 0.0), given("second_score", 0.0), given("score_margin", 0.0),
    )
