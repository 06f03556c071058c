"""Screenplay state machines as window sums over classified lines: no user function.

A line has a class S (speaker), D (dialogue), N (noise), B (blank) or O (other); see functions.text.line_class. The two
machines treat noise differently: it doesn't end a speech, but it ends an action chunk and the speech around it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def script_lines(df: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """line_no (from 1) and line of every text."""
    parts = F.split(F.coalesce(F.col(text), F.lit("")), r"\r\n|\r|\n")
    return df.select(*keys, F.posexplode(parts).alias("line_no", "line")).withColumn("line_no", F.col("line_no") + 1)


def speeches(lines: DataFrame, keys: Sequence[str], place: str = "line_no", kind: str = "kind", text: str = "line") -> DataFrame:
    """Speeches: speaker_line, dialogue (its lines, joined by a space), start_line (first line of dialogue), end_line (the
    line before what ended it) and segment_idx. A speech ends at the next speaker, or at the first line that is neither
    dialogue nor noise; one without a line of dialogue is none."""
    w = Window.partitionBy(*keys).orderBy(place)
    numbered = lines.withColumn("__g", F.sum((F.col(kind) == "S").cast("int")).over(w)).where("__g > 0")
    inner = Window.partitionBy(*keys, "__g").orderBy(place)
    stops = numbered.withColumn("__stops", F.sum(F.col(kind).isin("O", "B").cast("int")).over(inner))
    spoken = (F.col(kind) == "D") & (F.col("__stops") == 0)
    found = stops.groupBy(*keys, "__g").agg(
        F.max(F.when(F.col(kind) == "S", F.trim(text))).alias("speaker_line"),
        F.min(F.when(spoken, F.col(place))).alias("start_line"),
        F.coalesce(F.min(F.when(F.col(kind).isin("O", "B"), F.col(place))) - 1, F.max(place)).alias("end_line"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(spoken, F.struct(place, F.trim(text).alias("t"))))), lambda x: x["t"]), " ").alias("dialogue"),
    )
    found = found.where("start_line IS NOT NULL")
    return found.withColumn("segment_idx", F.row_number().over(Window.partitionBy(*keys).orderBy("start_line")) - 1).drop("__g")


def action_chunks(lines: DataFrame, keys: Sequence[str], place: str = "line_no", kind: str = "kind", text: str = "line") -> DataFrame:
    """Blocks of other text: start_line, end_line, other_text (lines joined by a line feed) and other_idx. Dialogue lines
    count once a line of another kind has ended the speech; blank and noise lines end a block and a speech."""
    w = Window.partitionBy(*keys).orderBy(place)
    cut = F.col(kind).isin("S", "N", "B")
    numbered = lines.withColumn("__g", F.sum(cut.cast("int")).over(w))
    inner = Window.partitionBy(*keys, "__g").orderBy(place)
    inside = numbered.withColumns({"__speech": F.max(F.when(F.col(kind) == "S", 1).otherwise(0)).over(inner), "__others": F.sum((F.col(kind) == "O").cast("int")).over(inner)})
    kept = inside.where(F.col(kind).isin("D", "O") & ((F.col("__speech") == 0) | (F.col("__others") > 0)))
    found = kept.groupBy(*keys, "__g").agg(F.min(place).alias("start_line"), F.max(place).alias("end_line"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(place, F.trim(text).alias("t")))), lambda x: x["t"]), "\n").alias("other_text"))
    return found.withColumn("other_idx", F.row_number().over(Window.partitionBy(*keys).orderBy("start_line")) - 1).drop("__g")
