"""Annotation documents to shot rows, and what is known of a shot's cast."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shotlens.functions.text import padded
from shotlens.functions.timecode import sec_to_hms


def flatten_stories(docs: DataFrame) -> DataFrame:
    """A row per subtitle item that has a shot, from documents with story[]{id, description, subtitle[]{shot, duration[2],
    sentences[]}}; sorted columns, no driver work. Items without a duration have null times."""
    items = docs.select("movie_id", F.explode("story").alias("s")).select("movie_id", "s.id", "s.description", F.explode("s.subtitle").alias("x")).where("x.shot IS NOT NULL")
    at = lambda i: F.try_element_at("x.duration", F.lit(i)).cast("double")
    out = items.select("movie_id", F.col("id").alias("story_id"), F.col("description").alias("story_description"), F.col("x.shot").cast("long").alias("shot_idx"), at(1).alias("shot_start_time"), at(2).alias("shot_end_time"), F.coalesce("x.sentences", F.array().cast("array<string>")).alias("subtitle_sentences"))
    return out.withColumns({"shot_id": padded("shot_", 4, F.col("shot_idx")), "shot_start_time_hms": sec_to_hms(F.col("shot_start_time")), "shot_end_time_hms": sec_to_hms(F.col("shot_end_time"))})


def cast_names(seen: DataFrame, people: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The sorted names of the people (pid, name) seen in each shot, with the pid where there is no name."""
    named = seen.join(people.dropDuplicates(["pid"]), "pid", "left").select(*keys, F.coalesce(F.nullif("name", F.lit("")), F.col("pid").cast("string")).alias("n"))
    return named.groupBy(*keys).agg(F.sort_array(F.collect_set("n")).alias("cast_names")).withColumn("num_cast", F.size("cast_names"))


def shot_level(docs: DataFrame, seen: DataFrame, people: DataFrame) -> DataFrame:
    """The shot table: flattened items with cast_names (empty where nobody is seen) and num_cast."""
    out = flatten_stories(docs).join(cast_names(seen, people, ["movie_id", "shot_idx"]), ["movie_id", "shot_idx"], "left")
    return out.withColumns({"cast_names": F.coalesce("cast_names", F.array().cast("array<string>")), "num_cast": F.coalesce("num_cast", F.lit(0))})


def shot_summary(df: DataFrame, key: Sequence[str], movie: str, shot: str, text: str, start: str, end: str) -> DataFrame:
    return df.agg(
        F.count("*").alias("n_rows"), F.count_distinct(movie).alias("n_movies"), F.count_distinct(shot).alias("n_shot_idx"), F.count_if(F.col(text).isNull()).alias("n_null_text"), F.count_if(F.trim(text) == "").alias("n_empty_text"),
        F.min(start).alias("first_start"), F.max(end).alias("last_end"), (F.count("*") - F.count_distinct(*key)).alias("n_duplicates"),
    )
