"""JSON lines as a data source that says which records are bad: spark.read.format("checked_json").schema(...).load(folder).

Files are read in ranges of bytes by as many tasks. A line that is no JSON object, or whose values don't have the schema's
types, is an error that names file and byte; with a field `_rescued` (RESCUED) in the schema it becomes a row in which that
field alone is set. Values that a line lacks are null, further ones are left out; blank lines count as none."""

from __future__ import annotations

import json
import posixpath
from collections.abc import Iterator
from fnmatch import fnmatch

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BooleanType, DataType, DoubleType, IntegerType, LongType, StringType, StructType

from shotlens.session import ship

RESCUED = "struct<file:string,start:long,line:string>"
FIELD, SPLIT_BYTES, ROWS = "_rescued", 64 << 20, 2000


class Misfit(ValueError):
    pass


def fitted(value, kind: DataType):
    """A JSON value as a value of the type; texts may stand for any value, as it was written."""
    if value is None:
        return None
    if isinstance(kind, StringType):
        return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)
    if isinstance(kind, BooleanType) and isinstance(value, bool):
        return value
    if isinstance(kind, (IntegerType, LongType)) and isinstance(value, int) and not isinstance(value, bool) and abs(value) < (1 << (31 if isinstance(kind, IntegerType) else 63)):
        return value
    if isinstance(kind, DoubleType) and isinstance(value, (int, float)) and not isinstance(value, bool):
        return float(value)
    if isinstance(kind, ArrayType) and isinstance(value, list):
        return [fitted(v, kind.elementType) for v in value]
    if isinstance(kind, StructType) and isinstance(value, dict):
        return {f.name: fitted(value.get(f.name), f.dataType) for f in kind.fields}
    raise Misfit(f"{json.dumps(value)[:80]} is no {kind.simpleString()}")


class Part(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


class CheckedJson(DataSource):
    @classmethod
    def name(cls) -> str:
        return "checked_json"

    def schema(self) -> str:
        raise ValueError("checked_json needs a schema: spark.read.format('checked_json').schema(...)")

    def reader(self, schema: StructType) -> Reader:
        return Reader(schema, self.options)


class Reader(DataSourceReader):
    def __init__(self, schema: StructType, options):
        self.schema = schema
        self.uri, self.glob = options["path"], options.get("pathGlobFilter", "*")
        self.split = int(options.get("splitBytes", SPLIT_BYTES))

    def partitions(self) -> list[Part]:
        system, root = pafs.FileSystem.from_uri(self.uri) if "://" in self.uri or self.uri.startswith("file:") else (pafs.LocalFileSystem(), self.uri)
        top = system.get_file_info(root)
        if top.type == pafs.FileType.NotFound:
            raise FileNotFoundError(self.uri)
        found = [top] if top.is_file else [x for x in system.get_file_info(pafs.FileSelector(root)) if x.is_file and x.base_name[0] not in "._" and fnmatch(x.base_name, self.glob)]
        return [Part(x.path, a, min(a + self.split, x.size)) for x in sorted(found, key=lambda x: x.path) for a in range(0, x.size, self.split)]

    def _lines(self, part: Part) -> Iterator[tuple[int, bytes]]:
        """Place and bytes of the lines that begin in the range."""
        system = pafs.FileSystem.from_uri(self.uri)[0] if "://" in self.uri or self.uri.startswith("file:") else pafs.LocalFileSystem()
        with system.open_input_file(part.path) as f:
            at = max(0, part.start - 1)  # a line begins at `start` if a line feed is before it
            f.seek(at)
            rest, skip, size = b"", part.start > 0, 1 << 20
            while at < part.end or rest:
                piece = f.read(size)
                lines = (rest + piece).split(b"\n")
                rest = lines.pop() if piece else b""
                for line in lines:
                    if skip:
                        skip = False
                    elif at < part.end:
                        yield at, line
                    at += len(line) + 1
                if not piece or at >= part.end:
                    return

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        schema, arrow = self.schema, to_arrow_schema(self.schema)
        rescue = FIELD in schema.fieldNames()
        held: list[dict] = []
        for at, line in self._lines(partition) if partition else ():  # of no files Spark makes one empty part
            if not line.strip():
                continue
            try:
                value = json.loads(line)
                if not isinstance(value, dict):
                    raise Misfit(f"{line[:80]!r} is no JSON object")
                held.append({f.name: None if f.name == FIELD else fitted(value.get(f.name), f.dataType) for f in schema.fields})
            except ValueError as e:  # also what json and UTF-8 raise
                if not rescue:
                    raise ValueError(f"{posixpath.basename(partition.path)}: the line at byte {at} can't be read: {e}") from None
                held.append({f.name: {"file": partition.path, "start": at, "line": line.decode("utf-8", "replace")} if f.name == FIELD else None for f in schema.fields})
            if len(held) >= ROWS:
                yield pa.RecordBatch.from_pylist(held, schema=arrow)
                held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=arrow)


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(CheckedJson)
