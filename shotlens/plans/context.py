"""Alignment of shots with a screenplay: steps, the texts around them, and the overlay on shots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shotlens.functions.text import canonical_speaker, clean_line, line_class, unique_join
from shotlens.operators.alignment import AlignmentRules, align
from shotlens.operators.asof import asof_join
from shotlens.operators.interval import collect_range, overlay
from shotlens.operators.ranking import number_rows
from shotlens.operators.states import action_chunks, script_lines, speeches

REPAIR_SCOPE = "unmatched_or_low_confidence"
MAX_GAP = 25


def parse_script(scripts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Speeches and action chunks of (movie_id, text)."""
    lines = script_lines(scripts, ["movie_id"], "text").withColumn("kind", line_class(F.col("line")))
    said = speeches(lines, ["movie_id"]).withColumns({"speaker": canonical_speaker(F.col("speaker_line")), "dialogue": clean_line(F.col("dialogue"))})
    return said, action_chunks(lines, ["movie_id"])


def with_action(steps: DataFrame, chunks: DataFrame, start: str, end: str, tolerance: int = MAX_GAP) -> DataFrame:
    """Rows (script places start and end) with the action chunk before and after: idx, gap and text; none beyond
    `tolerance` lines."""
    c = chunks.select("movie_id", "other_idx", "start_line", "end_line", "other_text")
    back = asof_join(steps, c, ["movie_id"], start, "end_line", {"other_idx": "prev_other_idx", "other_text": "prev_other_text"}, tolerance, order=["other_idx"], gap="prev_other_gap")
    out = asof_join(back, c, ["movie_id"], end, "start_line", {"other_idx": "next_other_idx", "other_text": "next_other_text"}, tolerance, forward=True, order=["other_idx"], gap="next_other_gap")
    return out.withColumns({x: F.coalesce(x, F.lit("")) for x in ("prev_other_text", "next_other_text")})


def alignment_steps(shots: DataFrame, speeches_: DataFrame, chunks: DataFrame, rules: AlignmentRules = AlignmentRules()) -> DataFrame:
    """Steps with the texts, speakers and script lines of their spans. shots: movie_id, row_idx, shot_idx, subtitle_text;
    speeches: movie_id, segment_idx, speaker, dialogue, start_line, end_line."""
    steps = align(shots.select("movie_id", "row_idx", "subtitle_text"), speeches_.select("movie_id", F.col("segment_idx").alias("row_idx"), "dialogue"), ["movie_id"], "row_idx", "subtitle_text", "dialogue", rules)
    steps = steps.withColumns({c: F.col(c).cast("long") for c in ("raw_start", "raw_end", "dialogue_start", "dialogue_end")})
    raw = collect_range(steps.where("raw_start IS NOT NULL"), shots.select("movie_id", F.col("row_idx").cast("long").alias("row_idx"), "shot_idx", "subtitle_text"), ["movie_id"], "row_idx", "raw_start", "raw_end", ["shot_idx", "subtitle_text"], "raw")
    said = collect_range(steps.where("dialogue_start IS NOT NULL"), speeches_.select("movie_id", F.col("segment_idx").cast("long").alias("segment_idx"), "speaker", "dialogue", "start_line", "end_line"), ["movie_id"], "segment_idx", "dialogue_start", "dialogue_end", ["speaker", "dialogue", "start_line", "end_line"], "said")
    both = steps.join(raw.select("movie_id", "step_idx", "raw"), ["movie_id", "step_idx"], "left").join(said.select("movie_id", "step_idx", "said"), ["movie_id", "step_idx"], "left")
    out = both.select(
        *steps.columns, F.col("raw.shot_idx").alias("shot_idx_list"), F.coalesce(F.array_join("raw.subtitle_text", " | "), F.lit("")).alias("raw_text"),
        F.coalesce("said.speaker", F.array().cast("array<string>")).alias("speaker_list"), F.coalesce(F.array_join("said.dialogue", " | "), F.lit("")).alias("dialogue_text"),
        F.col("said")[0]["start_line"].alias("script_start_line"), F.try_element_at("said", F.lit(-1))["end_line"].alias("script_end_line"),
    )
    return with_action(out, chunks, "script_start_line", "script_end_line")


def full_context(shots: DataFrame, steps: DataFrame, confident: float = 0.60, source: str = "raw_dp") -> DataFrame:
    """Every shot row with what its confident step gives it; else empty texts, score 0 and no source."""
    sure = steps.where((F.col("type") == "match") & (F.coalesce("match_score", F.lit(0.0)) >= confident) & F.col("raw_start").isNotNull())
    given = sure.select(
        "movie_id", "step_idx", "raw_start", "raw_end", F.col("raw_text").alias("aligned_raw_text"), F.col("dialogue_text").alias("aligned_script_dialogue"), F.col("speaker_list").alias("aligned_speakers"),
        unique_join(F.array("prev_other_text", "dialogue_text", "next_other_text"), "\n\n").alias("aligned_script_text"), "prev_other_text", "next_other_text", F.bround("match_score", 4).alias("match_score"), F.lit(source).alias("match_source"),
        F.col("dialogue_start").alias("script_block_start_idx"), (F.col("dialogue_end") - F.col("dialogue_start") + 1).alias("script_block_window_len"), "script_start_line", "script_end_line",
    )
    take = [c for c in given.columns if c not in ("movie_id", "step_idx", "raw_start", "raw_end")]
    out = overlay(shots.withColumn("row_idx", F.col("row_idx").cast("long")), given, ["movie_id"], "row_idx", "raw_start", "raw_end", take, "step_idx")
    texts = ("aligned_raw_text", "aligned_script_dialogue", "aligned_script_text", "prev_other_text", "next_other_text", "match_source")
    return out.withColumns({c: F.coalesce(c, F.lit("")) for c in texts} | {"aligned_speakers": F.coalesce("aligned_speakers", F.array().cast("array<string>")), "match_score": F.coalesce("match_score", F.lit(0.0)), "bridge_other_text": F.lit("")})


def numbered_shots(shots: DataFrame) -> DataFrame:
    return number_rows(shots, ["movie_id"], ["shot_idx", "shot_start_time", "shot_id"], "row_idx")


def match_summary(df: DataFrame, score: str, confident: float) -> DataFrame:
    sure = F.col(score) >= confident
    return df.agg(F.count("*").alias("n_steps"), F.count_if(sure).alias("n_confident"), F.round(F.avg(F.when(sure, F.col(score))), 4).alias("mean_confident"))


def repair_rows(df: DataFrame, scope: str = REPAIR_SCOPE, most: int | None = None, order: str = "shot_idx") -> DataFrame:
    """Rows with a subtitle and without a match source; the first `most` of them."""
    if scope != REPAIR_SCOPE:
        raise ValueError(f"unknown scope {scope!r}")
    out = df.where((F.trim(F.coalesce("subtitle_text", F.lit(""))) != "") & (F.trim(F.coalesce("match_source", F.lit(""))) == "")).withColumn("repair_reason", F.lit(scope))
    return out if most is None else out.orderBy(order).limit(most)
