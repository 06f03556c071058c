"""Shots of sequences as a manifest, and the filters that later stages share."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shotlens.functions.numeric import safe_float
from shotlens.functions.text import padded
from shotlens.functions.timecode import duration

#: Stage types that later stages take when nothing is said.
DEFAULT_STAGES = ("single_speaking", "two_person_dialogue_simple")


def stage_type(num_cast: Column, text: Column) -> Column:
    n, said = safe_float(num_cast).cast("int"), F.trim(F.coalesce(text, F.lit(""))) != ""
    return F.when((n <= 1) & said, "single_speaking").when((n == 2) & said, "two_person_dialogue_simple").when(n >= 3, "multi_person").otherwise("unknown")


def manifest(packages: DataFrame, status: str = "pending") -> DataFrame:
    """A row per shot of each package (sequence_id, shots[])."""
    s = packages.select("sequence_id", F.explode("shots").alias("s")).select("sequence_id", "s.*")
    have = lambda c, d: F.col(c) if c in s.columns else d
    idx = F.coalesce(safe_float(F.col("shot_idx"), -1.0).cast("long"), F.lit(-1).cast("long"))
    start, end = safe_float(F.col("shot_start_time")), safe_float(F.col("shot_end_time"))
    return s.withColumns({
        "shot_idx": idx, "shot_id": F.coalesce(F.nullif(have("shot_id", F.lit(None).cast("string")), F.lit("")), padded("shot_", 4, idx)), "duration": duration(start, end),
        "stage_type": stage_type(F.col("num_cast"), F.col("subtitle_text")), "process_status": F.lit(status), "note": F.lit(""),
    })


def stage_filter(df: DataFrame, include: str | Sequence[str] | None = None) -> DataFrame:
    """None: DEFAULT_STAGES; "all": every row; else the listed types ("a,b" or a sequence)."""
    if include == "all":
        return df
    wanted = DEFAULT_STAGES if include is None else [x.strip() for x in include.split(",") if x.strip()] if isinstance(include, str) else list(include)
    return df.where(F.col("stage_type").isin(*wanted))


def stage_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("stage_type").agg(F.count("*").alias("n"))


def select_rows(df: DataFrame, allowed: Mapping[str, Sequence | None], least: Mapping[str, float] | None = None, order: str | None = None, head: int | None = None) -> DataFrame:
    """Rows whose columns have allowed values (None: any) and reach least values; the first `head` by `order`."""
    for c, values in allowed.items():
        if values is not None:
            df = df.where(F.col(c).isin(list(values)))
    for c, x in (least or {}).items():
        df = df.where(safe_float(F.col(c), float("-inf")) >= x)
    return df if head is None else df.orderBy(order).limit(head)


def allowed_only(df: DataFrame, allowed: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(allowed.select(*keys).distinct(), list(keys), "left_semi")


def missing_keys(wanted: DataFrame, there: DataFrame, keys: Sequence[str]) -> DataFrame:
    return wanted.select(*keys).distinct().join(there.select(*keys).distinct(), list(keys), "left_anti")


def must_match(df: DataFrame, there: DataFrame, keys: Sequence[str], most: int = 5) -> None:
    """Raise ValueError with the first `most` keys that `there` doesn't have."""
    gone = missing_keys(df, there, keys).orderBy(*keys).limit(most).collect()
    if gone:
        raise ValueError("no match for " + ", ".join("/".join(str(r[k]) for k in keys) for r in gone))
