"""Writers: fixed columns, nested cells as JSON in CSV, previews, summaries, append-only caches, one-file exports."""

from __future__ import annotations

import html
import json
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MODES = {"overwrite": "overwrite", "skip": "ignore", "fail": "errorifexists", "append": "append"}


def flat(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """The columns in order (missing ones null, others dropped), with arrays, maps and structs as JSON text."""
    names = columns or df.columns
    out = []
    for c in names:
        if c not in df.columns:
            out.append(F.lit(None).cast("string").alias(c))
        elif isinstance(df.schema[c].dataType, T.ArrayType | T.MapType | T.StructType):
            out.append(F.to_json(c).alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)


def write_csv(df: DataFrame, path: str, columns: Sequence[str] | None = None, mode: str = "fail", order: Sequence[str] = (), bom: bool = False) -> None:
    """A folder of CSV parts; with `order` sorted by ranges, so that the parts' names follow the order; with `bom` each
    part begins with a byte-order mark, as spreadsheets want it."""
    out = flat(df.orderBy(*order) if order else df, columns)
    if bom:
        out = out.withColumnRenamed(out.columns[0], "\ufeff" + out.columns[0])
    out.write.mode(MODES[mode]).csv(path, header=True, quote='"', escape='"', emptyValue="")


def write_jsonl(df: DataFrame, path: str, columns: Sequence[str] | None = None, mode: str = "fail") -> None:
    (df.select(*columns) if columns else df).write.mode(MODES[mode]).option("ignoreNullFields", "false").json(path)


def write_parquet(df: DataFrame, path: str, mode: str = "fail", by: Sequence[str] = ()) -> None:
    """Partitioned by movie or date columns: later filters on them prune files."""
    w = df.write.mode(MODES[mode])
    (w.partitionBy(*by) if by else w).parquet(path)


def append_cache(df: DataFrame, path: str) -> None:
    """Answers with their keys; a reader takes the last of a key."""
    df.write.mode("append").json(path)


def preview(df: DataFrame, order: Sequence[str], n: int = 25) -> DataFrame:
    return df.orderBy(*order).limit(n)


def summary_json(row: DataFrame) -> str:
    """One-row summaries as indented JSON text (made on the driver; the row is all that is collected)."""
    first = row.limit(1).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j")).head()
    return json.dumps(json.loads(first["j"]) if first else {}, ensure_ascii=False, indent=2)


def report_html(title: str, sections: dict[str, DataFrame], most: int = 500) -> str:
    """A page with a table for each section (summaries, calibration, samples), `most` rows of each at most: a report's size
    is its feature."""
    cell = lambda x, tag="td": f"<{tag}>{html.escape('' if x is None else str(x))}</{tag}>"
    body = ""
    for name, df in sections.items():
        rows = df.limit(most).collect()
        body += f"<h2>{html.escape(name)}</h2><table><tr>" + "".join(cell(c, "th") for c in df.columns) + "</tr>" + "".join("<tr>" + "".join(map(cell, r)) + "</tr>" for r in rows) + "</table>"
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1>{body}</body></html>"


def audit_html(samples: DataFrame, columns: Sequence[str], title: str, most: int = 500) -> str:
    """A page with a table of audit samples."""
    return report_html(title, {"Samples": samples.select(*columns)}, most)


def write_gallery(protos: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A gallery's vectors as Parquet and an index of everything else as CSV."""
    vectors = [f.name for f in protos.schema if isinstance(f.dataType, T.ArrayType)]
    write_parquet(protos, f"{path.rstrip('/')}/vectors", mode)
    write_csv(protos.drop(*vectors), f"{path.rstrip('/')}/index", mode=mode)


def write_tasks(tasks: DataFrame, path: str, column: str, mode: str = "overwrite") -> None:
    """One text (a prompt, a raw answer, a timeline as JSON) of each task, in a folder for its sequence and character."""
    text = F.to_json(column) if not isinstance(tasks.schema[column].dataType, T.StringType) else F.col(column)
    rows = tasks.select("sequence_id", F.col("main_char"), F.coalesce(text, F.lit("")).alias("value"))
    rows.write.mode(MODES[mode]).partitionBy("sequence_id", "main_char").option("lineSep", "\n").text(path)
