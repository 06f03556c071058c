"""Readers: CSV and JSON with multi-line cells and byte-order marks, documents, scripts, caches."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shotlens.functions.jsonish import parse_list
from shotlens.functions.numeric import safe_float
from shotlens.functions.text import clean_text, padded, unique_join, utterance_count
from shotlens.session import ship

SUBTITLE = "struct<shot:long,duration:array<double>,sentences:array<string>>"
ANNOTATION = f"movie_id string, cast array<struct<id:string,shot_idx:string,pid:string,possible_pids:array<string>,resolution:array<double>,body:struct<bbox:array<double>>>>, story array<struct<id:string,description:string,subtitle:array<{SUBTITLE}>>>"
META = "cast array<struct<id:string,name:string,character:string>>"
SHOT_COLUMNS = ("movie_id", "shot_idx", "shot_start_time", "shot_end_time")


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p))


def require(spark: SparkSession, *paths: str) -> None:
    """Raise FileNotFoundError for inputs that aren't there, all of them in one message, before any work starts."""
    missing = [p for p in paths if not exists(spark, p)]
    if missing:
        raise FileNotFoundError(", ".join(missing))


def read_csv(spark: SparkSession, path: str, required: Sequence[str] = (), strip_names: bool = False) -> DataFrame:
    """All columns as text; quoted cells may span lines; a byte-order mark goes. Empty cells are null."""
    df = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', encoding="UTF-8")
    df = df.toDF(*[c.lstrip("﻿").strip() if strip_names else c.lstrip("﻿") for c in df.columns])
    return _required(df, required)


def read_csv_or_empty(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    if exists(spark, path):
        return read_csv(spark, path)
    return spark.createDataFrame([], ", ".join(f"`{c}` string" for c in columns))


def read_jsonl(spark: SparkSession, path: str, schema: str | None = None, strict: bool = True) -> DataFrame:
    """JSON lines; blank lines go. Strict: a line that is no JSON raises an error with its file and number, found by a scan
    before any work; else it is dropped."""
    reader = spark.read.option("mode", "DROPMALFORMED")
    if strict:
        lines = spark.read.text(path).select("value", F.input_file_name().alias("file")).where("trim(value) <> ''")
        bad = lines.where(F.try_parse_json("value").isNull()).select("file").limit(1).collect()
        if bad:
            ship(spark)
            numbered = spark.read.text(bad[0]["file"]).rdd.zipWithIndex()  # only to name the line of an error
            line = numbered.filter(lambda x: x[0][0].strip() and not _is_json(x[0][0])).first()[1] + 1
            raise ValueError(f"{bad[0]['file']}: line {line} is no JSON")
    return (reader.schema(schema) if schema else reader).json(path)


def _is_json(line: str) -> bool:
    try:
        json.loads(line)
    except ValueError:
        return False
    return True


def movie_root(table_path: str, movie_id: str) -> str:
    """The folder of a movie's outputs from the path of its final table."""
    folder, _, _ = table_path.rpartition("/")
    return folder.rpartition("/")[0] if folder.rpartition("/")[2] == "final_proxy" else f"outputs/video_proxy/{movie_id}"


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Whole documents, one per file."""
    return spark.read.schema(schema).json(path, multiLine=True)


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    return _with_movie(read_json(spark, path, ANNOTATION))


def read_meta(spark: SparkSession, path: str) -> DataFrame:
    """A row per cast member: movie_id (from the file's name), pid, name, character, input_ord."""
    docs = _with_movie(read_json(spark, path, f"movie_id string, {META}"))
    return docs.select("movie_id", F.posexplode("cast").alias("input_ord", "c")).select("movie_id", "input_ord", F.col("c.id").alias("pid"), F.coalesce("c.name", F.lit("")).alias("name"), F.coalesce("c.character", F.lit("")).alias("character")).where("pid <> ''")


def _with_movie(df: DataFrame) -> DataFrame:
    stem = F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[^./]*)?$", 1)
    return df.withColumn("movie_id", F.coalesce("movie_id", stem))


def read_script(spark: SparkSession, path: str) -> DataFrame:
    """movie_id (from the file's name) and text, whole; bytes that are no UTF-8 are replaced and go."""
    f = spark.read.format("binaryFile").load(path)
    stem = F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1)
    return f.select(stem.alias("movie_id"), F.replace(F.make_valid_utf8(F.col("content").cast("string")), F.lit("\ufffd"), F.lit("")).alias("text"))


def read_shots(spark: SparkSession, path: str) -> DataFrame:
    """A shot table of .csv, .jsonl, .json (a list, or an object with data[]) or Parquet: required columns checked, shot_id
    filled in, subtitle_text derived."""
    if path.endswith(".csv"):
        df = read_csv(spark, path)
    elif path.endswith(".jsonl"):
        df = read_jsonl(spark, path)
    elif path.endswith(".json"):
        df = spark.read.json(path, multiLine=True)
        df = df.select(F.explode("data").alias("d")).select("d.*") if df.columns == ["data"] else df
    else:
        df = spark.read.parquet(path)
    df = _required(df, SHOT_COLUMNS)
    idx = safe_float(F.col("shot_idx"), None).cast("long")
    have = dict(df.dtypes)
    sentences = F.col("subtitle_sentences") if have.get("subtitle_sentences", "").startswith("array") else parse_list(F.col("subtitle_sentences")) if "subtitle_sentences" in have else F.array().cast("array<string>")
    out = df.withColumns({"shot_idx": idx, "shot_start_time": safe_float(F.col("shot_start_time"), None), "shot_end_time": safe_float(F.col("shot_end_time"), None), "subtitle_sentences": sentences})
    return out.withColumns({"shot_id": F.coalesce(F.nullif(F.col("shot_id"), F.lit("")) if "shot_id" in have else F.lit(None).cast("string"), padded("shot_", 4, idx)), "subtitle_text": F.array_join(F.filter(F.transform("subtitle_sentences", clean_text), lambda x: x != ""), " ")})


TEXTS = ("subtitle_text", "aligned_raw_text", "aligned_script_dialogue", "aligned_script_text", "prev_other_text", "bridge_other_text", "next_other_text", "match_source")


def typed_context(df: DataFrame) -> DataFrame:
    """A full-context table, typed: missing texts empty, lists parsed, numbers cast, main_speaker and counts derived."""
    have = dict(df.dtypes)
    listed = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>")) if have.get(c, "").startswith("array") else parse_list(F.col(c)) if c in have else F.array().cast("array<string>")
    out = df.withColumns({c: clean_text(F.col(c)) if c in have else F.lit("") for c in TEXTS} | {c: listed(c) for c in ("subtitle_sentences", "aligned_speakers", "cast_pids")})
    number = lambda c: safe_float(F.col(c), 0.0) if c in have else F.lit(0.0)
    out = out.withColumns({"shot_idx": safe_float(F.col("shot_idx"), None).cast("long"), "shot_start_time": number("shot_start_time"), "shot_end_time": number("shot_end_time"), "match_score": number("match_score")})
    text = unique_join(F.array("subtitle_text", "aligned_script_dialogue"), " ")
    return out.withColumns({"num_cast": F.size("cast_pids"), "main_speaker": F.coalesce(F.try_element_at("aligned_speakers", F.lit(1)), F.lit("")), "has_dialogue_text": text != "", "utterance_count_shot": utterance_count(F.col("subtitle_sentences"), F.col("subtitle_text")).cast("long")})


def read_context(spark: SparkSession, path: str) -> DataFrame:
    return typed_context(read_csv(spark, path, ("movie_id", "shot_idx")) if path.endswith(".csv") else spark.read.parquet(path))


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """Responses: the last row of each key; rows without a key get one of their fields; bad lines go. Empty if absent."""
    schema = "cache_key string, movie_id string, row_idx string, shot_id string, model string, answer string, ord long"
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    df = read_jsonl(spark, path, schema, strict=False)
    key = F.coalesce(F.nullif("cache_key", F.lit("")), F.concat_ws("|", *(F.coalesce(c, F.lit("")) for c in ("movie_id", "row_idx", "shot_id", "model"))))
    df = df.withColumns({"cache_key": key, "ord": F.coalesce("ord", F.monotonically_increasing_id())})
    return df.groupBy("cache_key").agg(F.max_by("answer", "ord").alias("answer"), F.max("ord").alias("ord"))


def read_reviewed(spark: SparkSession, path: str, label: str = "human_label") -> DataFrame:
    return read_csv_or_empty(spark, path, [label]).where(F.trim(F.coalesce(label, F.lit(""))) != "")


def files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """path, length (bytes) and modified of a folder's files; their content isn't read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "length", F.col("modificationTime").alias("modified"))


def pick_video(spark: SparkSession, folder: str, movie_id: str, suffixes: Sequence[str] = (".mp4", ".mkv", ".avi", ".mov")) -> str | None:
    """The movie's file in a folder: the exact stem first, then the shortest name that starts with the id."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{movie_id}*")
    found = [str(s.getPath()) for s in p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p) or []]
    named = [(x.rsplit("/", 1)[-1], x) for x in found if x.lower().endswith(tuple(suffixes))]
    return min(named, key=lambda n: (n[0].rsplit(".", 1)[0] != movie_id, len(n[0]), n[0]), default=(None, None))[1]


def _required(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


