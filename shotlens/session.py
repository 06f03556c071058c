"""Session settings, shared working folders and shipping of the package to executors."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
import zipfile
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Lets sides that are dealt by some of a join's keys alone meet without an exchange.
CO_PARTITION = "spark.sql.requireAllClusterKeysForCoPartition"
#: What the engine's own sessions set; a session made elsewhere is used as it is.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",  # folds over arrays cost much for few bytes: use all cores
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    CO_PARTITION: "false",
}

_shipped: set[str] = set()
_lock = threading.Lock()


def build_session(app: str = "shotlens", master: str | None = None, **more: str) -> SparkSession:
    """A session with SETTINGS; `more` are further settings with "__" for ".". On a cluster leave master unset."""
    builder = SparkSession.builder.appName(app).config(map=SETTINGS | {k.replace("__", "."): v for k, v in more.items()})
    return (builder.master(master) if master else builder).getOrCreate()


def ship(spark: SparkSession) -> None:
    """Give this package to the executors' Python once for each application, so that functions import by name there."""
    sc = spark.sparkContext
    with _lock:
        if sc.applicationId in _shipped:
            return
        root = Path(__file__).resolve().parent
        to = Path(tempfile.mkdtemp(prefix="shotlens-")) / f"{root.name}.zip"  # Spark's file server sends it on
        with zipfile.ZipFile(to, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, f"{root.name}/{p.relative_to(root)}")
        sc.addPyFile(str(to))
        _shipped.add(sc.applicationId)


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder name under spark.checkpoint.dir, the folder that driver and executors share; deleted when the
    application ends. Only where that setting is unset and the master is local a temporary folder takes its place."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or os.environ.get("SHOTLENS_SHARED_DIR")
    if not base:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = os.environ["SHOTLENS_SHARED_DIR"] = tempfile.mkdtemp(prefix="shotlens-shared-")
    path = sc._jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/shotlens-{uuid.uuid4().hex}/{name}")
    fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
    fs.mkdirs(path.getParent())
    fs.deleteOnExit(path.getParent())
    return fs.makeQualified(path).toString()


def materialise(spark: SparkSession, df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write a table to the shared folder and read it again: cuts the lineage, outlives any executor."""
    to = shared_dir(spark, name)
    df.write.parquet(to, compression=compression)
    return spark.read.schema(df.schema).parquet(to)


def bucketed(spark: SparkSession, df: DataFrame, name: str, keys: Sequence[str], parts: int | None = None) -> DataFrame:
    """As materialise, in buckets by `keys`, sorted by them in each: joins and groups by these columns (or these and more,
    under CO_PARTITION) of tables with as many buckets need no exchange. The table is known to this session's catalog alone."""
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"shotlens_{name}_{uuid.uuid4().hex}".replace("-", "_")
    rows = df.repartition(n, *keys)  # one file a bucket
    rows.write.bucketBy(n, *keys).sortBy(*keys).option("path", shared_dir(spark, name)).format("parquet").saveAsTable(table)
    return spark.table(table)
