"""The screenplay parsers as table functions: SELECT * FROM speeches(TABLE(lines), 'movie_id').

The lines come as a table with the group's column, line_no, kind (S, D, N, B or O; see functions.text.line_class) and line.
The functions ask for the group and the order of lines themselves, so that a call needs no PARTITION BY, and read a group
as a stream: they hold the lines of one speech or chunk. The column forms in operators.states do the same with windows."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import LongType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from shotlens.session import ship

NEEDED = ("line_no", "kind", "line")


def _analyze(lines: AnalyzeArgument, group: AnalyzeArgument, out: StructType) -> AnalyzeResult:
    if not lines.isTable:
        raise ValueError("the first argument is a table: TABLE(...)")
    key = group.value
    missing = [c for c in (*NEEDED, key) if c not in lines.dataType.fieldNames()]
    if missing:
        raise ValueError(f"missing columns: {', '.join(map(str, missing))}")
    schema = StructType().add(key, lines.dataType[key].dataType)
    for f in out.fields:
        schema = schema.add(f)
    return AnalyzeResult(schema, partitionBy=[PartitioningColumn(key)], orderBy=[OrderingColumn("line_no")])


class SpeechLines:
    """One row for each speech: the group, segment_idx, speaker_line, dialogue, start_line and end_line."""

    OUT = StructType().add("segment_idx", LongType()).add("speaker_line", StringType()).add("dialogue", StringType()).add("start_line", LongType()).add("end_line", LongType())

    @staticmethod
    def analyze(lines: AnalyzeArgument, group: AnalyzeArgument) -> AnalyzeResult:
        return _analyze(lines, group, SpeechLines.OUT)

    def __init__(self) -> None:
        self.key, self.speaker, self.said, self.first, self.end, self.last, self.found = None, None, [], None, None, None, 0

    def _close(self) -> Iterator[tuple]:
        if self.said:
            yield self.key, self.found, self.speaker, " ".join(self.said), self.first, self.last if self.end is None else self.end
            self.found += 1
        self.speaker, self.said, self.first, self.end = None, [], None, None

    def eval(self, row, group: str) -> Iterator[tuple]:
        kind, place = row["kind"], row["line_no"]
        self.key = row[group]
        if kind == "S":
            yield from self._close()
            self.speaker = (row["line"] or "").strip(" ")
        elif self.speaker is not None and self.end is None:
            if kind in ("O", "B"):
                self.end = place - 1
            elif kind == "D":
                self.first = place if self.first is None else self.first
                self.said.append((row["line"] or "").strip(" "))
        self.last = place

    def terminate(self) -> Iterator[tuple]:
        yield from self._close()


class ChunkLines:
    """One row for each action chunk: the group, other_idx, other_text, start_line and end_line."""

    OUT = StructType().add("other_idx", LongType()).add("other_text", StringType()).add("start_line", LongType()).add("end_line", LongType())

    @staticmethod
    def analyze(lines: AnalyzeArgument, group: AnalyzeArgument) -> AnalyzeResult:
        return _analyze(lines, group, ChunkLines.OUT)

    def __init__(self) -> None:
        self.key, self.speaking, self.held, self.first, self.last, self.found = None, False, [], None, None, 0

    def _close(self) -> Iterator[tuple]:
        if self.held:
            yield self.key, self.found, "\n".join(self.held), self.first, self.last
            self.found += 1
        self.held, self.first = [], None

    def eval(self, row, group: str) -> Iterator[tuple]:
        kind = row["kind"]
        self.key = row[group]
        if kind in ("S", "N", "B"):
            yield from self._close()
            self.speaking = kind == "S"
        elif kind == "O" or kind == "D" and not self.speaking:
            self.speaking = False
            self.first = row["line_no"] if self.first is None else self.first
            self.last = row["line_no"]
            self.held.append((row["line"] or "").strip(" "))

    def terminate(self) -> Iterator[tuple]:
        yield from self._close()


def register(spark: SparkSession) -> None:
    """Make speeches(TABLE(lines), 'group') and action_chunks(TABLE(lines), 'group') known to the session's SQL."""
    ship(spark)
    spark.udtf.register("speeches", udtf(SpeechLines))
    spark.udtf.register("action_chunks", udtf(ChunkLines))
