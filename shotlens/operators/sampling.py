"""Reproducible samples: the order is that of a hash of the key, so that no task's order or number matters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_order(seed: int, *cols: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(c).cast("string") for c in cols)))


def bucket_sample(df: DataFrame, buckets: dict[str, tuple[Column, int]], key: str, seed: int, name: str = "sample_bucket") -> DataFrame:
    """Up to n rows of each bucket (name: condition, n); a row may be in several buckets. sample_rank counts within one."""
    hits = F.filter(F.array(*(F.when(cond, F.struct(F.lit(i).alias("no"), F.lit(b).alias("bucket"), F.lit(n).alias("most"))) for i, (b, (cond, n)) in enumerate(buckets.items()))), lambda x: x.isNotNull())
    rows = df.withColumn("__b", F.explode(hits)).withColumn(name, F.col("__b.bucket"))
    rank = F.row_number().over(Window.partitionBy(name).orderBy(hash_order(seed, key), key))
    most = max((n for _, n in buckets.values()), default=0)  # a literal limit is pushed below the shuffle
    return rows.withColumn("sample_rank", rank).where((F.col("sample_rank") <= most) & (F.col("sample_rank") <= F.col("__b.most"))).drop("__b")


def quotas(df: DataFrame, key: str, parts: Sequence[tuple[str, Column, int]], priority: Column, order: str) -> tuple[DataFrame, DataFrame]:
    """Rows for each part (subtype, condition, n) in turn, by falling priority and then `order`, each key once; and the
    shortfall of each part. A part's rows exclude those that earlier parts took."""
    chosen = None
    for k, (subtype, cond, n) in enumerate(parts):
        pool = df.where(F.coalesce(cond, F.lit(False)))
        if chosen is not None:
            pool = pool.join(chosen.select(key), key, "left_anti")
        taken = pool.withColumns({"__p": priority}).orderBy(F.desc("__p"), order).limit(n).drop("__p").withColumns({"sample_subtype": F.lit(subtype), "part_no": F.lit(k)})
        chosen = taken if chosen is None else chosen.unionByName(taken)
    counts = chosen.groupBy("part_no").agg(F.count("*").alias("n"))
    wanted = df.sparkSession.createDataFrame([(k, s, n) for k, (s, _, n) in enumerate(parts)], "part_no int, sample_subtype string, quota int")
    shortfall = wanted.join(counts, "part_no", "left").select("sample_subtype", F.greatest(F.lit(0), F.col("quota") - F.coalesce("n", F.lit(0)).cast("int")).alias("shortfall"))
    return chosen, shortfall
