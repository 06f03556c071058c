"""A table with one row for each key, fed by appended batches: an answer cache that streams and reruns can share.

A batch goes to a folder of its own; what counts is what the newest manifest lists. A manifest is a small JSON file under a
number that no other has, so that a writer either adds the next one or finds that another was first. A batch whose number
the manifest has is left out, so that a batch repeated after a crash changes nothing. Compaction writes the last row of each
key into files of key ranges and lists these alone.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


@dataclass(frozen=True)
class Manifest:
    version: int = 0
    folders: tuple[str, ...] = ()
    batches: dict[str, int] = field(default_factory=dict)  # of each writer the last batch


class KeyedTable:
    """`keys` tell rows apart; of rows with the same keys that with the largest `order` (then by all other columns) counts."""

    def __init__(self, spark: SparkSession, folder: str, schema: str, keys: Sequence[str], order: str):
        self.spark, self.folder, self.schema, self.keys, self.order = spark, folder.rstrip("/"), schema, list(keys), order

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _fs(self):
        return self._path("x").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _versions(self) -> list[int]:
        fs, at = self._fs(), self._path("manifest")
        return sorted(int(x.getPath().getName().split(".")[0]) for x in fs.listStatus(at)) if fs.exists(at) else []

    def manifest(self) -> Manifest:
        """The newest whole manifest: one that a writer left unfinished doesn't count."""
        for version in reversed(self._versions()):
            stream = self._fs().open(self._path(f"manifest/{version:012d}.json"))
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            stream.close()
            try:
                x = json.loads(text)
                return Manifest(version, tuple(x["folders"]), x["batches"])
            except ValueError:
                continue
        return Manifest()

    def _commit(self, change: Callable[[Manifest], Manifest | None], tries: int = 20) -> bool:
        """Write the manifest that `change` makes of the newest one; where another writer takes the number, try again with
        what that one wrote. False if `change` finds nothing to do."""
        for _ in range(tries):
            number = max([0, *self._versions()]) + 1  # before the manifest is read: a later one takes this number
            new = change(self.manifest())
            if new is None:
                return False
            path = self._path(f"manifest/{number:012d}.json")
            try:
                out = self._fs().create(path, False)
            except Exception as e:  # py4j wraps Java's exceptions
                if "already exists" not in str(e):
                    raise
                continue
            out.write(json.dumps({"folders": new.folders, "batches": new.batches}).encode())
            out.close()
            return True
        raise RuntimeError(f"{self.folder}: other writers took {tries} manifests in a row")

    def _rows(self, folders: Sequence[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*(f"{self.folder}/{f}" for f in folders)) if folders else self.spark.createDataFrame([], self.schema)

    def _last(self, rows: DataFrame) -> DataFrame:
        rest = [c for c in rows.columns if c not in (*self.keys, self.order)]
        return rows.groupBy(*self.keys).agg(F.max(F.struct(self.order, *rest)).alias("x")).select(*self.keys, "x.*").select(*rows.columns)

    def read(self) -> DataFrame:
        """One row for each key, as of the newest manifest."""
        return self._last(self._rows(self.manifest().folders))

    def merge(self, batch: DataFrame, number: int, writer: str = "stream") -> bool:
        """Add a batch; False if it, or a later one of this writer, is in already. Its folder has a name of its own, so that
        what a crashed attempt left behind is never read."""
        if self.manifest().batches.get(writer, -1) >= number:
            return False
        name = f"data/{writer}-{number:012d}-{uuid.uuid4().hex}"
        self._last(batch.select(*self._rows(()).columns)).write.parquet(f"{self.folder}/{name}")
        return self._commit(lambda m: None if m.batches.get(writer, -1) >= number else Manifest(0, (*m.folders, name), m.batches | {writer: number}))

    def compact(self, parts: int | None = None) -> bool:
        """One file for each of `parts` ranges of keys, with the last row of each key, in place of the folders that are listed
        now; folders that are added meanwhile stay."""
        seen = self.manifest().folders
        if len(seen) < 2:
            return False
        name = f"data/compact-{uuid.uuid4().hex}"
        n = parts or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self._last(self._rows(seen)).repartitionByRange(n, *self.keys).sortWithinPartitions(*self.keys).write.parquet(f"{self.folder}/{name}")
        return self._commit(lambda m: Manifest(0, (name, *(f for f in m.folders if f not in seen)), m.batches) if set(seen) <= set(m.folders) else None)

    def clean(self) -> int:
        """Delete the folders that the newest manifest doesn't list, and older manifests. Only while no one writes or reads."""
        fs, now, gone = self._fs(), self.manifest(), 0
        if fs.exists(self._path("data")):
            for x in fs.listStatus(self._path("data")):
                if f"data/{x.getPath().getName()}" not in now.folders:
                    gone += bool(fs.delete(x.getPath(), True))
        for version in self._versions():
            if version < now.version:
                fs.delete(self._path(f"manifest/{version:012d}.json"), False)
        return gone

    def feed(self, rows: DataFrame, checkpoint: str, writer: str = "stream", compact_every: int = 50) -> StreamingQuery:
        """Merge a stream's batches as they come, and compact after every `compact_every` of them."""

        def add(batch: DataFrame, number: int) -> None:
            self.merge(batch, number, writer)
            if number % compact_every == compact_every - 1:
                self.compact()

        return rows.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
