"""Time bins, sessions and last choices over streams of frames, with watermarks and checkpoints.

`run_available` drives a query over what is there now and returns what it wrote: append mode to Parquet; given a lasting
folder, a run goes on from the checkpoint of the one before. `run_updates` returns every group's last state instead, so that no group has to be
closed by a watermark."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from shotlens.plans.tracks import BinRules, quality
from shotlens.session import shared_dir

#: Milliseconds of event time after which the memory of a silent key is dropped.
SILENCE_MS = 7 * 86_400_000
#: Groups that the keys of a stream in order are dealt to; the state of a group is read and written as a whole.
GROUPS = 1024


def read_events(spark: SparkSession, path: str, files_per_trigger: int = 16) -> DataFrame:
    """A stream of a Parquet table's files (`path`: the table, a file or a folder of files)."""
    schema = spark.read.parquet(path).schema
    folder, name = path.rstrip("/").rsplit("/", 1)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", "*.parquet").parquet(path) if not name.endswith(".parquet") or _is_folder(spark, path) else spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def live_bins(frames: DataFrame, keys: Sequence[str], at: str, width: str, late: str | None, valid: str, confidence: str, rules: BinRules = BinRules()) -> DataFrame:
    """Tumbling windows of a stream: counts, mean confidence of valid frames and the quality label. With `late` None no
    frame is ever late."""
    g = (frames if late is None else frames.withWatermark(at, late)).groupBy(*keys, F.window(at, width).alias("w"))
    out = g.agg(F.count("*").alias("n_frames_total"), F.count_if(valid).alias("n_frames_valid"), F.avg(F.when(F.col(valid), F.col(confidence))).alias("confidence_mean"))
    share = F.col("n_frames_valid") / F.col("n_frames_total")
    return out.select(*keys, F.col("w.start").alias("bin_start"), "n_frames_total", "n_frames_valid", "confidence_mean", quality(F.col("n_frames_valid"), share, F.col("confidence_mean"), F.lit(0), F.lit(0.0), rules).alias("gaze_quality"))


def live_sessions(frames: DataFrame, keys: Sequence[str], at: str, gap: str, late: str) -> DataFrame:
    """Runs of frames without a longer gap: the live form of a gap-tolerant track."""
    return frames.withWatermark(at, late).groupBy(*keys, F.session_window(at, gap).alias("w")).agg(F.count("*").alias("track_len")).select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "track_len")


def in_order(rows: DataFrame, key: str, at: str, value: str, late: str, name: str, step: Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]], groups: int = GROUPS) -> DataFrame:
    """Each key's rows in the order of their times, in whatever batches they come: `key`, `at` and `name` (text).

    A row waits in state until the watermark, `late` behind the latest time, has passed it. Keys share the state of one of
    `groups` groups, so that a call serves many keys; null keys have one of their own. `step` is given the rows that are now
    due, by key and time (equal times: by value, nulls first), after those that it kept before: where a key begins, values,
    and whether a row was sent. It says which rows to send, with what text, and which to keep. A key without rows for
    SILENCE_MS is forgotten; what it kept unsent is then sent with its own value."""

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        parts = [pa.ipc.open_stream(state.get[0]).read_pandas()] if state.exists else []
        parts += [pd.DataFrame({"key": x[key], "us": x["__us"], "value": x["__value"], "sent": False}) for x in batches]
        held, mark = pd.concat(parts, ignore_index=True), state.getCurrentWatermarkMs()
        code = pd.factorize(held["key"], use_na_sentinel=False)[0]
        order = np.lexsort((pd.factorize(held["value"], sort=True)[0], held["us"].to_numpy(), code))
        held, code = held.take(order), code[order]
        due = held["us"].to_numpy() <= mark * 1000
        now, of = held[due], code[due]
        begins = np.diff(of, prepend=-1) != 0
        value = now["value"].to_numpy(object)
        value[pd.isna(value)] = None
        send, text, keep = step(begins, value, now["sent"].to_numpy(bool))
        sent, us = now["sent"].to_numpy(bool) | send, now["us"].to_numpy()
        # a key's time: of its first row that waits, else when it will have been silent for long enough
        waits = np.full(code.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(waits, code[~due], held["us"].to_numpy()[~due] // 1000 + 1)
        last = np.full(len(waits), np.iinfo(np.int64).min)
        np.maximum.at(last, of, us)
        silent = last // 1000 + SILENCE_MS
        gone = ((waits == np.iinfo(np.int64).max) & (silent <= mark))[of]
        rest = keep & gone & ~sent
        text = np.concatenate([text[send], value[rest]])
        yield pd.DataFrame({key: pd.concat([now["key"][send], now["key"][rest]]).to_numpy(), "__us": np.concatenate([us[send], us[rest]]), name: text})
        keep &= ~gone
        if keep.any() or not due.all():
            left = pa.RecordBatch.from_pandas(pd.concat([now.assign(sent=sent)[keep], held[~due]]), preserve_index=False)
            to = pa.BufferOutputStream()
            with pa.ipc.new_stream(to, left.schema) as stream:
                stream.write_batch(left)
            state.update((to.getvalue().to_pybytes(),))
            times = np.where(waits < np.iinfo(np.int64).max, waits, silent)[np.unique(np.concatenate([of[keep], code[~due]]))]
            state.setTimeoutTimestamp(max(mark + 1, int(times.min())))
        elif state.exists:
            state.remove()

    kind = rows.schema[key].dataType.simpleString()
    timed = rows.select(key, at, F.col(value).cast("string").alias("__value")).withWatermark(at, late).withColumn("__us", F.unix_micros(at))
    group = F.when(F.col(key).isNull(), -1).otherwise(F.pmod(F.xxhash64(key), F.lit(groups)))
    got = timed.withColumn("__group", group).groupBy("__group").applyInPandasWithState(run, f"`{key}` {kind}, __us long, `{name}` string", "kept binary", "append", "EventTimeTimeout")
    return got.select(key, F.timestamp_micros("__us").alias(at), name)


def live_last_choice(rows: DataFrame, key: str, at: str, choice: str, late: str) -> DataFrame:
    """Each row with the last non-null choice before it in its stream."""

    def step(begins: np.ndarray, value: np.ndarray, sent: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = np.arange(len(value))
        first, ends = np.maximum.accumulate(np.where(begins, n, 0)), np.append(begins[1:], True)[: len(n)]
        given = np.maximum.accumulate(np.where(np.not_equal(value, None), n, -1))  # the last place with a choice
        before = np.concatenate([[-1], given[:-1]]).astype(int)[: len(n)]
        text = np.full(len(n), None, object)
        known = before >= first
        text[known] = value[before[known]]
        keep = ends.copy()
        at_end = given[ends]
        keep[at_end[at_end >= first[ends]]] = True
        return ~sent, text, keep

    return in_order(rows, key, at, choice, late, "previous", step)


def live_smoothing(rows: DataFrame, key: str, at: str, choice: str, late: str) -> DataFrame:
    """Each row's choice; a missing one between two equal ones takes their value. A row is sent when the row after it is
    due, the last one of a key when the key has been silent for SILENCE_MS."""

    def step(begins: np.ndarray, value: np.ndarray, sent: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ends = np.append(begins[1:], True)[: len(value)]
        before, after = np.concatenate([[None], value[:-1]])[: len(value)], np.append(value[1:], None)[: len(value)]
        fills = ~begins & ~ends & np.equal(value, None) & np.not_equal(before, None) & np.equal(before, after)
        return ~sent & ~ends, np.where(fills, before, value), ends | np.append(ends[1:], False)[: len(value)]

    return in_order(rows, key, at, choice, late, "smoothed", step)


def run_available(spark: SparkSession, stream: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """Process what is there, in as many batches as it takes, and read the result. With a `folder` that outlives the
    application a later run goes on where the last one ended; without one each run is new."""
    to = f"{folder.rstrip('/')}/{name}" if folder else shared_dir(spark, name)
    q = stream.writeStream.format("parquet").option("path", to).option("checkpointLocation", f"{to}-checkpoint").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(to)


def run_to_end(spark: SparkSession, path: str, build: Callable[[DataFrame], DataFrame], closing: DataFrame, name: str, files_per_trigger: int = 16) -> DataFrame:
    """Process a finished table (a folder of Parquet files) to its end and read the result: what still waits for a later
    row is let go by the rows of `closing` (of the table's columns, far later), which follow as a second run from the first
    one's checkpoint."""
    to, schema = shared_dir(spark, name), spark.read.parquet(path).schema
    closing.select(*schema.names).write.parquet(f"{to}-closing")
    for folder in (path, f"{to}-closing"):
        above, own = folder.rstrip("/").rsplit("/", 1)
        source = f"{above}/{{{own}}}"  # a pattern: for plain paths the file source wants the files of all runs under one
        run_available(spark, build(spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(source)), "sent", to)
    return spark.read.parquet(f"{to}/sent")


def run_updates(spark: SparkSession, stream: DataFrame, keys: Sequence[str], name: str, folder: str | None = None) -> DataFrame:
    """Process what is there, in as many batches as it takes, and read the last state of each group: every batch writes the
    groups that it changed to a folder of its own, which a repeated batch overwrites. `folder` is as in run_available."""
    to = f"{folder.rstrip('/')}/{name}" if folder else shared_dir(spark, name)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{to}/batch={number}")

    q = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{to}-checkpoint").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema)
    rows = spark.read.schema(f"{kinds}, batch long").parquet(to)
    rest = [c for c in stream.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("x")).select(*keys, "x.*").select(*stream.columns)
