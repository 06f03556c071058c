"""URL filters: a trie over reversed host labels and then path segments, longest match first between allow and block."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shotlens.llm.common import column_list, map_arrow, prepared, table

#: Rules that are broadcast as a trie at most; more go through a join (see judge_urls).
MAX_BROADCAST_RULES = 200_000


@dataclass(frozen=True)
class Rule:
    """`host` fits itself and its subdomains, if the URL's path starts with `path`."""

    verdict: str
    host: str
    path: str = "/"

    @property
    def text(self) -> str:
        return self.host + self.path


#: Fixed values of the query's contract.
QUERY_RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)


class Trie:
    """Nested dicts: reversed host labels, then the whole segments of a rule's path; at the end, the beginnings of the
    segment that follows, each with its rule. A walk of a URL meets every rule that fits it, and no other."""

    def __init__(self, rules: Iterable[Rule]):
        self.hosts: dict = {}
        for r in rules:
            node = self.hosts
            for label in reversed(r.host.split(".")):
                node = node.setdefault(label, {})
            node = node.setdefault(None, {})
            *whole, last = r.path.split("/")
            for segment in whole:
                node = node.setdefault(segment, {})
            node.setdefault(None, {})[last] = r

    def match(self, host: str, path: str) -> Rule | None:
        """The rule that fits with the longest text; of equally long ones that with the longer host."""
        best, size = None, (-1, -1)
        segments, node = None, self.hosts
        for label in reversed(host.split(".")):
            node = node.get(label)
            if node is None:
                break
            paths = node.get(None)
            if paths is None:
                continue
            if segments is None:
                segments = path.split("/")
            for segment in segments:
                for start, rule in paths.get(None, {}).items():
                    if segment.startswith(start) and (n := (len(rule.text), len(rule.host))) > size:
                        best, size = rule, n
                paths = paths.get(segment)
                if paths is None:
                    break
        return best


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null and for a URL without "://"."""
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def judge_urls(spark: SparkSession, pages: DataFrame, rules: Iterable[Rule], default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """`id_col`, host, path, rule and verdict of every row.

    Up to MAX_BROADCAST_RULES rules are broadcast as a trie; a longer list becomes a table that is joined with each
    URL's few (host suffix, path) keys, which is the same search over the trie's levels. Where two rules have the same
    host and path, block wins. A null id stays null; a null or odd URL has an empty host and path, which no rule with
    a host fits; repeated rows are judged each; an empty table gives an empty table; further columns are not read.
    A URL that no rule fits gets `default` and a null rule.
    """
    prepared(spark)
    by_text: dict[tuple[str, str], Rule] = {}
    for r in rules:
        if r.verdict not in ("allow", "block"):
            raise ValueError(f"verdict {r.verdict!r}")
        if r.verdict == "block" or (r.host, r.path) not in by_text:
            by_text[r.host, r.path] = r
    host, path = split_url(F.col(url_col))
    parts = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    if len(by_text) > MAX_BROADCAST_RULES:
        return _judge_by_join(spark, parts, list(by_text.values()), default, id_col)
    trie = spark.sparkContext.broadcast(Trie(by_text.values()))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = trie.value.match
        for b in batches:
            found = [match(h, p) for h, p in zip(column_list(b, "host"), column_list(b, "path"), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array([r and r.text for r in found], pa.string()), pa.array([r.verdict if r else default for r in found], pa.string())],
                names=[*b.schema.names, "rule", "verdict"],
            )

    kind = pages.schema[id_col].dataType.simpleString()
    return map_arrow(parts, judge, f"`{id_col}` {kind}, host string, path string, rule string, verdict string")


def _judge_by_join(spark: SparkSession, parts: DataFrame, rules: list[Rule], default: str, id_col: str) -> DataFrame:
    """Rules as a table: every (host suffix, whole path segments) key of a URL is looked up by an equi-join."""
    listed = spark.createDataFrame([(r.host, r.path[: r.path.rfind("/") + 1], r.path.rpartition("/")[2], r.text, r.verdict) for r in rules], "rule_host string, rule_whole string, rule_last string, rule string, verdict string")
    labels, segments = F.split("host", r"\.", -1), F.split("path", "/", -1)
    keyed = parts.withColumn("row_key", F.monotonically_increasing_id())
    keys = (
        keyed.select("row_key", "path", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).alias("rule_host"))
        .select("row_key", "rule_host", "path", F.explode(F.transform(F.sequence(F.lit(0), F.size(segments) - 1), lambda i: F.struct(F.concat(F.array_join(F.slice(segments, 1, i), "/"), F.when(i > 0, "/").otherwise("")).alias("whole"), F.element_at(segments, i + 1).alias("next")))).alias("k"))
        .select("row_key", "rule_host", F.col("k.whole").alias("rule_whole"), F.col("k.next").alias("next"))
    )
    best = (
        keys.join(listed, ["rule_host", "rule_whole"]).where(F.col("next").startswith(F.col("rule_last")))
        .groupBy("row_key").agg(F.max_by(F.struct("rule", "verdict"), F.struct(F.length("rule"), F.length("rule_host"))).alias("best"))
    )
    return keyed.join(best, "row_key", "left").select(id_col, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(spark, table(spark, sf_dir, "pages"), QUERY_RULES)


OP9_SQL = """
WITH u AS (
  SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
), r(verdict, rhost, rpath) AS (
  VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), m AS (
  SELECT p.page_id, p.host, p.path, rhost || rpath AS rule, verdict, length(rhost || rpath) AS n
  FROM p JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
), b AS (SELECT page_id, host, path, max_by(rule, n) AS rule, max_by(verdict, n) AS verdict FROM m GROUP BY ALL)
SELECT p.page_id, p.host, p.path, b.rule, coalesce(b.verdict, 'allow') AS verdict
FROM p LEFT JOIN b ON p.page_id IS NOT DISTINCT FROM b.page_id AND p.host = b.host AND p.path = b.path
"""
