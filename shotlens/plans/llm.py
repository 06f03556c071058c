"""Tasks for a language model and its answers: cached, parsed, checked, applied. Live calls are a provider's."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shotlens.functions.jsonish import json_object, stable_key
from shotlens.functions.text import first_distinct, target_name
from shotlens.operators.windows import anchor_range, timeline
from shotlens.providers import TextModel

# What a gaze may be meant as.
INTENTS = ("ADDRESS", "LISTEN", "THINK", "AVOID", "REACT", "OBSERVE")
EVENT = "struct<shot_id:string,order_in_shot:string,phase:string,duration_ratio:string,target:string,gaze_intent:string,evidence:string>"
ANSWER = f"struct<sequence_id:string,movie_id:string,main_char:string,events:array<{EVENT}>>"


def packages_for_tasks(packages: DataFrame, most_speakers: int | None = 1) -> DataFrame:
    """A task for each active speaker of a sequence: main_char, pre_script (five distinct texts at most) and prompt key."""
    speakers = F.col("active_speakers") if most_speakers is None else F.slice("active_speakers", 1, most_speakers)
    before = F.transform(F.slice("shots", 1, 3), lambda s: s["prev_other_text"])
    out = packages.withColumn("pre_script", first_distinct(F.concat(F.array("script_action_preview"), before), 5)).withColumn("main_char", F.explode(speakers))
    return out.withColumn("prompt", prompt(F.struct("sequence_id", "movie_id", "main_char", "pre_script", "script_action_preview", "active_speakers", "shots"))).withColumn("cache_key", stable_key(F.col("sequence_id"), F.col("main_char"), F.col("prompt")))


def prompt(package: Column, intents: Sequence[str] = INTENTS, targets: Sequence[str] = ("CHARACTER", "OBJECT", "OFFSCREEN", "DOWN", "UP", "LEFT", "RIGHT", "GROUP")) -> Column:
    return F.concat_ws("\n", F.lit("Answer with one JSON object: sequence_id, movie_id, main_char and events (shot_id, order_in_shot, phase, duration_ratio, target, gaze_intent, evidence)."), F.lit("gaze_intent is one of: " + ", ".join(intents)), F.lit("Without a named character, target is one of: " + ", ".join(targets)), F.to_json(package))


def cache_misses(tasks: DataFrame, cache: DataFrame) -> DataFrame:
    return tasks.join(cache.select("cache_key").distinct(), "cache_key", "left_anti").select(*tasks.columns)


def answers_for(tasks: DataFrame, cache: DataFrame, model: TextModel | None = None) -> DataFrame:
    """Each task with its answer: the cached one (last by `ord`), else the model's, else null."""
    last = cache.groupBy("cache_key").agg(F.max_by("answer", "ord").alias("answer"))
    hit = tasks.join(last, "cache_key", "inner")
    miss = cache_misses(tasks, cache)
    return hit.unionByName(miss.withColumn("answer", F.lit(None).cast("string")) if model is None else model.complete(miss, "prompt", "answer"), allowMissingColumns=True)


def parse_answer(text: Column, sequence: Column | None = None, movie: Column | None = None, char: Column | None = None) -> Column:
    """ANSWER from a model's text (fences and talk around the object go); blank fields fall back to the task's; events that
    are no list become an empty list."""
    raw = F.from_json(F.coalesce(json_object(text), F.lit("{}")), ANSWER)
    field = lambda n, d: F.coalesce(F.nullif(raw[n], F.lit("")), d if d is not None else F.lit(None).cast("string")).alias(n)
    return F.struct(field("sequence_id", sequence), field("movie_id", movie), field("main_char", char), F.coalesce(raw["events"], F.array().cast(f"array<{EVENT}>")).alias("events"))


def warnings(events: Column, shot_ids: Column, intents: Sequence[str]) -> Column:
    """What is wrong with each event, as an array of texts."""
    known = F.array(*(F.lit(x) for x in intents)) if intents else None

    def of(e: Column, i: Column) -> Column:
        head = F.concat(F.lit("event["), i.cast("string"), F.lit("] "))
        n = e["duration_ratio"].try_cast("double")
        intent = F.trim(F.coalesce(e["gaze_intent"], F.lit("")))
        found = [
            F.when(~F.array_contains(shot_ids, F.coalesce(e["shot_id"], F.lit(""))), F.concat(head, F.lit("invalid shot_id: "), F.coalesce(e["shot_id"], F.lit("")))),
            F.when(n.isNull() & e["duration_ratio"].isNotNull(), F.concat(head, F.lit("invalid duration_ratio: "), e["duration_ratio"])).when(F.coalesce(n, F.lit(0.0)) <= 0, F.concat(head, F.lit("non-positive duration_ratio: "), F.coalesce(n, F.lit(0.0)).cast("string"))),
            F.when(F.lit(False) if known is None else ~F.array_contains(known, intent), F.concat(head, F.lit("unknown gaze_intent: "), intent)),
        ]
        return F.filter(F.array(*found), lambda x: x.isNotNull())

    return F.when(F.size(events) == 0, F.array(F.lit("zero events"))).otherwise(F.flatten(F.transform(events, of)))


def gaze_timeline(answers: DataFrame, shots: DataFrame) -> DataFrame:
    """Events with t0 and t1 from the sequence's start. answers: sequence_id, main_char, answer (ANSWER); shots:
    sequence_id, shot_id, shot_start_time, shot_end_time. Events of other shots go."""
    e = answers.select("sequence_id", "main_char", F.posexplode("answer.events").alias("no", "e")).select("sequence_id", "main_char", "no", F.col("e.shot_id").alias("shot_id"), F.coalesce(F.floor(F.col("e.order_in_shot").try_cast("double")), F.lit(1)).alias("place"), F.col("e.duration_ratio").try_cast("double").alias("ratio"), target_name(F.col("e.target")).alias("target"), F.coalesce("e.gaze_intent", F.lit("")).alias("gaze_intent"), F.coalesce("e.evidence", F.lit("")).alias("evidence"))
    starts = shots.groupBy("sequence_id").agg(F.min("shot_start_time").alias("origin"))
    at = e.join(shots.select("sequence_id", "shot_id", "shot_start_time", "shot_end_time").dropDuplicates(["sequence_id", "shot_id"]), ["sequence_id", "shot_id"]).join(starts, "sequence_id")
    out = timeline(at, ["sequence_id", "main_char", "shot_id"], ["place", "no"], "ratio", "shot_start_time", "shot_end_time", 2, "origin")
    return out.select("sequence_id", "main_char", "t0", "t1", "target", F.col("shot_id").alias("source_shot_id"), "gaze_intent", "evidence")


def apply_answers(rows: DataFrame, answers: DataFrame, dialogue: DataFrame, keys: Sequence[str], place: str, threshold: float) -> DataFrame:
    """Rows overlaid with answers (keys, place, match, segment_idx, confidence 0-100) that match, reach the threshold and name
    an existing segment."""
    good = answers.where(F.col("match") & (F.coalesce("confidence", F.lit(0.0)) >= threshold * 100) & F.col("segment_idx").isNotNull())
    hit = good.join(dialogue.withColumnRenamed("speaker", "__speaker").withColumnRenamed("dialogue", "__dialogue"), [*keys, "segment_idx"]).select(*keys, place, "confidence", "segment_idx", "__speaker", "__dialogue")
    out = rows.join(hit, [*keys, place], "left")
    ok = F.col("__speaker").isNotNull()
    new = {"speaker": F.when(ok, F.col("__speaker")).otherwise(F.col("speaker")), "match_source": F.when(ok, "llm_local_fill").otherwise(F.col("match_source")), "match_score": F.when(ok, F.bround(F.col("confidence") / 100, 4)).otherwise(F.col("match_score")), "aligned_script_dialogue": F.when(ok, F.col("__dialogue")), "script_block_start_idx": F.when(ok, F.col("segment_idx"))}
    return out.withColumns(new).drop("confidence", "segment_idx", "__speaker", "__dialogue")


def repair_ranges(context: DataFrame, sizes: DataFrame, radius: int = 8, accepted: str | None = None) -> DataFrame:
    """For each row to repair the dialogue segments [range_low, range_high] that an answer may choose from. sizes: movie_id,
    n_segments. `accepted` is a column with the segment of a row's accepted answer: rows are then asked in their order,
    and an accepted row is an anchor for the rows after it."""
    from shotlens.plans.context import repair_rows

    placed = anchor_range(context.join(sizes, "movie_id"), ["movie_id"], "row_idx", "script_block_start_idx", "n_segments", radius, later=accepted)
    return repair_rows(placed, order="row_idx")


def accepted_segments(rows: DataFrame, answers: DataFrame, dialogue: DataFrame, keys: Sequence[str], place: str, threshold: float) -> DataFrame:
    """Rows with `accepted`: the segment of the answer (keys, place, match, segment_idx, confidence 0-100), where it
    matches, reaches the threshold and names an existing segment."""
    good = answers.where(F.col("match") & (F.coalesce("confidence", F.lit(0.0)) >= threshold * 100) & F.col("segment_idx").isNotNull())
    hit = good.join(dialogue.select(*keys, "segment_idx").distinct(), [*keys, "segment_idx"], "left_semi").select(*keys, place, F.col("segment_idx").alias("accepted"))
    return rows.join(hit, [*keys, place], "left")
