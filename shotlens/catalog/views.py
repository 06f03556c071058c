"""Adapter views: the test tables seen as shots, frames, boxes and script lines; the SQL twins build on the same views.

Whole-number durations keep sums exact. All of them read only the columns that they need."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, shot_idx, role, text, voice (four speakers), dur, start_sec, end_sec: a conversation's turns as shots."""
    n = F.length("text")
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    return table(spark, sf_dir, "conversations").select(
        "conv_id", F.col("turn").alias("shot_idx"), "role", "text", (n % 4).alias("voice"), n.alias("dur"), F.coalesce(F.sum(n).over(before), F.lit(0)).alias("start_sec"),
    ).withColumn("end_sec", F.col("start_sec") + F.col("dur"))


V_SHOT = """v_shot AS (
  SELECT conv_id, turn AS shot_idx, role, text, length(text) % 4 AS voice, length(text) AS dur,
         CAST(coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_sec,
         CAST(coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) + length(text) AS end_sec
  FROM conversations)"""


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """stream, event_id, t (seconds of 2024), kind, success, conf, k, gaze_x, pose_y: a user's events as frames."""
    k = F.get_json_object("props", "$.k").cast("int")
    micros = F.timestamp_diff("MICROSECOND", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts"))
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("stream"), "event_id", (micros / F.lit(1e6)).alias("t"), F.col("event_type").alias("kind"), (F.col("event_type") != "error").cast("int").alias("success"),
        ((150 + k) / 250.0).alias("conf"), k.alias("k"), ((k - 50) / 100.0).alias("gaze_x"), ((F.col("event_id") % 101 - 50) / 100.0).alias("pose_y"), "value",
    )


V_FRAME = """v_frame AS (
  SELECT user_id AS stream, event_id, epoch_us(CAST(ts AS TIMESTAMP) ) / 1e6 - epoch_us(TIMESTAMP '2024-01-01 00:00:00') / 1e6 AS t0,
         (epoch_us(CAST(ts AS TIMESTAMP)) - epoch_us(TIMESTAMP '2024-01-01 00:00:00')) / 1e6 AS t, event_type AS kind, CAST(event_type <> 'error' AS INT) AS success,
         (150 + CAST(json_extract(props, '$.k') AS INT)) / 250.0 AS conf, CAST(json_extract(props, '$.k') AS INT) AS k, (CAST(json_extract(props, '$.k') AS INT) - 50) / 100.0 AS gaze_x,
         (event_id % 101 - 50) / 100.0 AS pose_y, value
  FROM events)"""


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """shot, frame (two boxes each), event_id, det (place in the frame), x1, y1, x2, y2, conf: events as boxes of 60 by 60."""
    f = frames(spark, sf_dir)
    n = F.row_number().over(Window.partitionBy("stream").orderBy("t", "event_id")) - 1
    x, y = (F.col("k") * 2).cast("double"), F.floor("value").cast("double")
    return f.withColumn("n", n).select(F.col("stream").alias("shot"), F.floor(F.col("n") / 2).cast("int").alias("frame"), (F.col("n") % 2).cast("int").alias("det"), "event_id", x.alias("x1"), y.alias("y1"), (x + 60).alias("x2"), (y + 60).alias("y2"), F.col("conf"))


V_BOX = """v_box AS (
  SELECT stream AS shot, CAST(n // 2 AS INT) AS frame, CAST(n % 2 AS INT) AS det, event_id, CAST(k * 2 AS DOUBLE) AS x1, floor(value) AS y1, CAST(k * 2 + 60 AS DOUBLE) AS x2, floor(value) + 60 AS y2, conf
  FROM (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY t, event_id) - 1 AS n FROM v_frame))"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, line_no, line, kind: a document's lines, with classes by their length."""
    parts = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).withColumn("line_no", F.col("line_no") + 1)
    n = F.length("line")
    return parts.withColumn("kind", F.when(n == 0, "B").when(n % 7 == 0, "N").when(n % 5 == 0, "S").when(n % 3 == 0, "O").otherwise("D"))


V_LINE = """v_line AS (
  SELECT doc_id, i AS line_no, parts[i] AS line, CASE WHEN length(parts[i]) = 0 THEN 'B' WHEN length(parts[i]) % 7 = 0 THEN 'N' WHEN length(parts[i]) % 5 = 0 THEN 'S' WHEN length(parts[i]) % 3 = 0 THEN 'O' ELSE 'D' END AS kind
  FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents), unnest(range(1, len(parts) + 1)) AS u(i))"""
