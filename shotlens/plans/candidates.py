"""Candidate sequences: windows of consecutive shots, gated, scored and chosen without overlap."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shotlens.functions.text import clean_speaker_name, is_narration, is_singing, sequence_id, truncate, unique_join, visual_cues
from shotlens.operators.nonoverlap import non_overlapping
from shotlens.operators.windows import change_count, consecutive_windows


@dataclass(frozen=True)
class WindowRules:
    shortest_sec: float = 5.0
    longest_sec: float = 20.0
    least_shots: int = 3
    most_shots: int = 10
    least_utterances: int = 2
    least_changes: int = 1
    least_average_sec: float = 1.0
    least_speakers: int = 1
    most_speakers: int = 4
    all_dialogue: bool = True
    unknown_speaker: bool = True


def duration_tent(seconds: Column, low: float = 8.0, high: float = 18.0) -> Column:
    return F.when(seconds < low, seconds / low).when(seconds > high, F.greatest(F.lit(0.0), 1 - (seconds - high) / max(high, 1.0))).otherwise(1.0)


def sequence_score(seconds: Column, changes: Column, utterances: Column, speakers: Column, coverage: Column, cast: Column, visual: Column, gaze: Column, camera: Column, scenes: Column) -> Column:
    """Capped weighted sum, less 2 for each scene boundary; four decimals."""
    cap = lambda c, most: F.least(c.cast("double"), F.lit(float(most)))
    parts = cap(changes, 5) * 2.0 + cap(utterances, 12) * 0.8 + cap(speakers, 4) * 1.5 + duration_tent(seconds.cast("double")) * 3.0 + coverage * 4.0
    return F.bround(parts + cap(cast, 4) * 0.75 + visual * 0.7 + cap(gaze, 4) + cap(camera, 4) * 0.6 - scenes * 2.0, 4)


SHOT_FIELDS = ("shot_idx", "shot_start_time", "shot_end_time", "has_dialogue_text", "utterance_count_shot", "aligned_speakers", "main_speaker", "cast_pids", "match_source", "subtitle_text", "aligned_script_dialogue", "prev_other_text", "next_other_text")


def candidate_sequences(context: DataFrame, rules: WindowRules = WindowRules()) -> DataFrame:
    """Every window of a movie's context (movie_id and SHOT_FIELDS) that passes the gates, with its features and score.

    A window is an array of its shots: no join of the table with itself, and a shot meets at most `most_shots` others."""
    w = consecutive_windows(context, ["movie_id"], "shot_idx", SHOT_FIELDS, rules.least_shots, rules.most_shots)
    first, last = F.col("shots")[0], F.element_at("shots", -1)
    n = F.size("shots")
    w = w.withColumn("total_sec", (last["shot_end_time"] - first["shot_start_time"]).cast("double"))
    w = w.where(F.col("total_sec").between(rules.shortest_sec, rules.longest_sec) & (F.col("total_sec") / n >= rules.least_average_sec))
    if rules.all_dialogue:
        w = w.where(F.forall("shots", lambda s: s["has_dialogue_text"]))
    names = F.filter(F.flatten(F.transform("shots", lambda s: F.transform(s["aligned_speakers"], clean_speaker_name))), lambda x: x != "")
    w = w.withColumns({
        "utterance_count": F.aggregate("shots", F.lit(0).cast("long"), lambda a, s: a + s["utterance_count_shot"]), "active_speakers": F.sort_array(F.array_distinct(names)),
        "speaker_changes": change_count(F.transform("shots", lambda s: clean_speaker_name(s["main_speaker"]))),
    })
    speakers = F.size("active_speakers")
    w = w.where((F.col("utterance_count") >= rules.least_utterances) & (F.col("speaker_changes") >= rules.least_changes) & (speakers <= rules.most_speakers) & ((speakers >= rules.least_speakers) | ((speakers == 0) & F.lit(rules.unknown_speaker))))
    action = unique_join(F.concat(F.transform("shots", lambda s: s["prev_other_text"]), F.transform("shots", lambda s: s["next_other_text"])), "\n")
    blob = F.array_join(F.flatten(F.transform("shots", lambda s: F.array(s["subtitle_text"], s["aligned_script_dialogue"], s["prev_other_text"], s["next_other_text"]))), " ", "")
    w = w.where(~is_narration(F.col("active_speakers")) & ~is_singing(blob)).withColumn("v", visual_cues(action))
    matched = F.size(F.filter("shots", lambda s: F.trim(F.coalesce(s["match_source"], F.lit(""))) != ""))
    pids = F.filter(F.flatten(F.transform("shots", lambda s: F.coalesce(s["cast_pids"], F.array().cast("array<string>")))), lambda x: F.trim(x) != "")
    sources = F.transform("shots", lambda s: F.coalesce(s["match_source"], F.lit("")))
    out = w.select(
        sequence_id(F.col("movie_id").cast("string"), first["shot_idx"], last["shot_idx"]).alias("sequence_id"), "movie_id", first["shot_idx"].alias("start_shot_idx"), last["shot_idx"].alias("end_shot_idx"),
        F.bround(first["shot_start_time"].cast("double"), 3).alias("start_time_sec"), F.bround(last["shot_end_time"].cast("double"), 3).alias("end_time_sec"), n.alias("shot_count"), F.bround("total_sec", 3).alias("total_sec"), F.bround(F.col("total_sec") / n, 3).alias("avg_shot_sec"),
        "utterance_count", "active_speakers", speakers.alias("active_speaker_count"), "speaker_changes", F.sort_array(F.array_distinct(pids)).alias("cast_pid_union"),
        F.array_max(F.transform("shots", lambda s: F.coalesce(F.size(s["cast_pids"]), F.lit(0)))).alias("cast_count_max"),
        F.map_from_entries(F.transform(F.array_distinct(sources), lambda x: F.struct(x, F.size(F.filter(sources, lambda y: y == x))))).alias("match_source_counts"),
        F.bround(matched / n, 4).alias("match_coverage"), truncate(F.array_join(F.transform("shots", lambda s: F.coalesce(s["subtitle_text"], F.lit(""))), " "), 350).alias("subtitle_preview"), "v.*",
    )
    c = F.col
    return out.withColumn("score", sequence_score(c("total_sec"), c("speaker_changes"), c("utterance_count"), c("active_speaker_count"), c("match_coverage"), c("cast_count_max"), c("visual_action_score"), c("gaze_verb_count"), c("camera_cue_count"), c("scene_boundary_count")))


#: Rank of candidates: columns to sort rising; the last two make it total.
def rank_order() -> list[Column]:
    return [-F.col("score"), -F.col("speaker_changes"), -F.col("utterance_count"), -F.col("visual_action_score"), F.col("shot_count"), F.col("start_shot_idx"), F.col("end_shot_idx")]


def select_sequences(candidates: DataFrame, most: int | None = None) -> DataFrame:
    return non_overlapping(candidates, ["movie_id"], rank_order(), "start_shot_idx", "end_shot_idx", most)


def selection_summary(every: DataFrame, selected: DataFrame, order: Sequence[Column | str] = ("sequence_id",), top: int = 10) -> DataFrame:
    """One row: counts and cue totals over all candidates, and the first `top` of the selected ones."""
    fields = ("sequence_id", "movie_id", "score", "start_shot_idx", "end_shot_idx", "total_sec")
    total = every.agg(F.count("*").alias("all_candidate_count"), F.count_if(F.col("visual_action_score") > 0).alias("visual_candidates_with_score"), *(F.coalesce(F.sum(c), F.lit(0)).alias(n) for c, n in (("camera_cue_count", "camera_cue_total"), ("gaze_verb_count", "gaze_verb_total"), ("movement_cue_count", "movement_cue_total"))))
    first = selected.orderBy(*order).limit(top).select(*fields).withColumn("__n", F.monotonically_increasing_id())  # `top` rows of one partition
    listed = first.agg(F.sort_array(F.collect_list(F.struct("__n", *fields))).alias("top_sequences"))
    return total.crossJoin(selected.agg(F.count("*").alias("selected_candidate_count"))).crossJoin(listed)  # one row each


def sequence_packages(selected: DataFrame, context: DataFrame, fields: Sequence[str]) -> DataFrame:
    from shotlens.operators.interval import collect_range

    return collect_range(selected, context.select("movie_id", "shot_idx", *[f for f in fields if f != "shot_idx"]), ["movie_id"], "shot_idx", "start_shot_idx", "end_shot_idx", [f for f in fields if f != "shot_idx"], "shots")
