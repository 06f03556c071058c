"""What the operators of this package share: Arrow batches, tables of the test schema, and caches of bounded size."""

from __future__ import annotations

import contextlib
import ctypes
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shotlens.session import ship

#: Rows and bytes of an Arrow batch at most; a single longer row makes a batch of its own.
BATCH_ROWS, BATCH_BYTES = 2000, 2 << 20
SPACE = re.compile(rb"[ \t-\r]")


def prepared(spark: SparkSession) -> SparkSession:
    """Ship the package and bound the Arrow batches, so that a worker's memory doesn't follow the texts' lengths."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_arrow(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow whose tasks give their memory back: Spark keeps a Python worker for the tasks of later stages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batches)
        finally:
            give_back()

    return df.mapInArrow(run, schema)


def joined(batches: Iterator[pa.RecordBatch], rows: int, size: int) -> Iterator[pa.RecordBatch]:
    """Batches of about `rows` rows or `size` bytes from smaller ones, for work that gains by many rows at a time."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= rows or sum(x.nbytes for x in held) >= size:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def pieces(text: bytes, size: int) -> Iterator[bytes]:
    """The text cut before white space into pieces of about `size` bytes."""
    at = 0
    while at < len(text):
        cut = SPACE.search(text, at + size)
        end = cut.start() if cut else len(text)
        yield text[at:end]
        at = end


def give_back() -> None:
    """Return what Arrow's pool and the C library hold without use to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def column_bytes(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    """A string column as UTF-8 bytes."""
    col = batch.column(batch.schema.get_field_index(name))
    return col.cast(pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary()).to_pylist()


def column_list(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def batch_of(**columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def crc_fold(doc_id, n: int):
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")) if isinstance(doc_id, str) else F.crc32(doc_id.cast("string").cast("binary")), F.lit(n))


def places(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The places of slices, each n long, one after another."""
    return np.arange(n.sum()) + np.repeat(begin - (np.cumsum(n) - n), n)


def trim(cache: dict, limit: int) -> None:
    """Empty a cache that has over `limit` entries: only speed depends on its contents."""
    if len(cache) > limit:
        cache.clear()


#: crc32 of the bytes `b` (a list) by the table `t.t`, which SQL makes from the polynomial.
CRC_TABLE = "SELECT list(list_reduce([i] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)"


def crc_sql(text: str) -> str:
    """crc32 of a text's UTF-8 bytes in DuckDB, beside a table `crc` with CRC_TABLE's list `t`."""
    return f"xor(list_reduce([4294967295] || list_transform(range(octet_length(encode({text}))), lambda k: CAST('0x' || substr(hex(encode({text})), 2 * k + 1, 2) AS BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"
