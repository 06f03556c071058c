"""Whole runs: one function for the text stages and one for the video stages, with typed parameters. A run returns its
tables by name. Tables that several others come from are written to the shared folder once; the rest is computed where it is
used."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shotlens.operators.alignment import AlignmentRules
from shotlens.plans import candidates, context, identity, llm, manifest, targets, tracks
from shotlens.providers import TextModel
from shotlens.session import bucketed, materialise
from shotlens.sources.readers import typed_context
from shotlens.sources.writers import write_parquet

SHOT_FIELDS = ("shot_id", "shot_start_time", "shot_end_time", "subtitle_text", "aligned_script_dialogue", "aligned_speakers", "cast_pids", "num_cast", "prev_other_text", "next_other_text")


@dataclass(frozen=True)
class TextRun:
    alignment: AlignmentRules = field(default_factory=AlignmentRules)
    windows: candidates.WindowRules = field(default_factory=candidates.WindowRules)
    most_sequences: int | None = None
    speakers_per_sequence: int | None = 1


@dataclass(frozen=True)
class VideoRun:
    stages: str | None = None
    bins: tracks.BinRules = field(default_factory=tracks.BinRules)
    identity: identity.IdentityRules = field(default_factory=identity.IdentityRules)
    targets: targets.TargetRules = field(default_factory=targets.TargetRules)


def text_run(shots: DataFrame, scripts: DataFrame, run: TextRun = TextRun(), cache: DataFrame | None = None, model: TextModel | None = None) -> dict[str, DataFrame]:
    """From shots (movie_id, shot_idx, shot_id, shot_start_time, shot_end_time, subtitle_text, subtitle_sentences, cast_pids)
    and scripts (movie_id, text) to aligned context, chosen sequences, tasks and timelines. `cache` holds answers
    (cache_key, answer, ord)."""
    rows = context.numbered_shots(shots)
    said, chunks = context.parse_script(scripts)
    steps = context.alignment_steps(rows, said, chunks, run.alignment)
    spark = shots.sparkSession
    steps = materialise(spark, steps, "steps")
    full = materialise(spark, typed_context(context.full_context(rows, steps, run.alignment.confident)), "context")
    every = materialise(spark, candidates.candidate_sequences(full, run.windows), "all-candidates")
    chosen = candidates.select_sequences(every, run.most_sequences)
    packages = materialise(spark, candidates.sequence_packages(chosen, full, SHOT_FIELDS), "packages")
    tasks = llm.packages_for_tasks(packages, run.speakers_per_sequence)
    cached = cache if cache is not None else spark.createDataFrame([], "cache_key string, answer string, ord long")
    answers = llm.answers_for(tasks, cached, model)
    parsed = answers.select("sequence_id", "movie_id", "main_char", llm.parse_answer(F.col("answer"), F.col("sequence_id"), F.col("movie_id"), F.col("main_char")).alias("answer"))
    of = packages.select("sequence_id", F.explode("shots").alias("s")).select("sequence_id", "s.shot_id", "s.shot_start_time", "s.shot_end_time")
    return {"steps": steps, "context": full, "all_candidates": every, "candidates": chosen, "packages": packages, "manifest": manifest.manifest(packages), "tasks": tasks, "answers": parsed, "timeline": llm.gaze_timeline(parsed, of)}


def video_run(shots: DataFrame, frames: DataFrame, boxes: DataFrame, identities: DataFrame, run: VideoRun = VideoRun()) -> dict[str, DataFrame]:
    """From a manifest (sequence_id, shot_id, shot_idx, stage_type, aligned_speakers, active_speakers), measured frames
    (sequence_id, shot_id, shot_idx, local_track_id, timestamp_sec, or frame where that is null, and what tracks.time_bins reads), tracked boxes (shot_id,
    local_track_id, timestamp_sec, bbox_cx, track_conf) and identities to the final table. Frames of shots that aren't in the
    manifest are an error, those of stage types that aren't wanted go."""
    wanted = manifest.stage_filter(shots, run.stages)
    manifest.must_match(frames, shots, ["sequence_id", "shot_id"])
    kept = manifest.allowed_only(frames, wanted, ["sequence_id", "shot_id"])
    spark = shots.sparkSession
    # stage tables lie in buckets of a track, so that the joins of the later stages leave them where they are
    track = ["shot_id", "local_track_id"]
    bins = bucketed(spark, tracks.time_bins(kept, ["sequence_id", "shot_id", "shot_idx", "local_track_id"], tracks.shot_time(kept, "timestamp_sec", start=""), run.bins), "bins", track)
    cands = bucketed(spark, targets.candidates(bins, boxes, identities, wanted, run.targets), "target-candidates", track)
    assigned = bucketed(spark, targets.assignments(bins, cands, identities, wanted, run.targets), "assignments", track)
    final = targets.final_table(bins, identities, assigned, wanted, boxes, cands)
    return {"bins": bins, "target_candidates": cands, "assignments": assigned, "final": final, "sequences": targets.sequence_report(assigned)}


def write_run(tables: Mapping[str, DataFrame], folder: str, mode: str = "fail") -> dict[str, str]:
    """Each table as Parquet under its name, in the run's order; the paths by name. Spark marks a folder that was written
    in full with _SUCCESS."""
    paths = {name: f"{folder.rstrip('/')}/{name}" for name in tables}
    for name, df in tables.items():
        write_parquet(df, paths[name], mode)
    return paths
