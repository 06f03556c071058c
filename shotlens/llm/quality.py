"""Quality rules with limits that the corpus itself sets, for each language and source.

Every document gets the words, symbols, repeated lines and repeated words that quality rules look at. Their distribution in
each group is kept in a mergeable quantile sketch: counts in log-linear cells (whole numbers up to 2^BITS one by one, above that 2^(BITS-1) cells
to each doubling), so that sketches of any parts add up to that of the whole and a quantile is right within
2^-(BITS-1) of its value. From the quartiles come limits, and a join brings each document to those of its group.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shotlens.llm.common import BATCH_BYTES, batch_of, column_bytes, map_arrow, pieces, prepared, table
from shotlens.operators.places import small
from shotlens.session import materialise

#: The characters that count as symbols, words of a window, fewest words, most repeated words in a hundred.
SYMBOLS, WINDOW, LEAST_WORDS, MOST_REPEATED = b"#*$%&|<>", 8, 20, 30
#: Whole numbers up to 2^BITS have cells of their own.
BITS = 7
#: Weight of the whole corpus in each group's sketch, in documents, but never more than the group's own: what is usual in a
#: small group stays within its limits, and large groups hardly feel it.
PRIOR = 50


@dataclass(frozen=True)
class Rule:
    """A measure in thousandths, how far beyond the quartiles it may lie (in spreads), the least spread, and its sides."""

    name: str
    least_spread: int
    low: bool = False
    reach: int = 3


RULES = (Rule("word_length", 700, low=True), Rule("symbols", 40), Rule("dup_lines", 40), Rule("repeat_words", 100))


def repeated_words(ids: np.ndarray, n: int = WINDOW) -> int:
    """Words in windows of n (a power of two) that are found twice or more, by doubling: the number of a window of 2k words
    is that of the pair of its halves' numbers, so that equal numbers mean equal windows."""
    if len(ids) < n:
        return 0
    rank, width = ids.astype(np.int64), 1
    while width < n:
        top = int(rank.max()) + 1
        rank = np.unique(rank[:-width] * top + rank[width:], return_inverse=True)[1]
        width *= 2
    hit = np.bincount(rank)[rank] > 1
    ends = np.zeros(len(ids) + 1, np.int32)
    starts = np.flatnonzero(hit)
    np.add.at(ends, starts, 1)
    np.add.at(ends, starts + n, -1)
    return int((np.cumsum(ends[:-1]) > 0).sum())


def measures(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a whole text."""
    no: dict[bytes, int] = {}
    numbers, chars = [], 0
    for piece in pieces(text, BATCH_BYTES):
        words = piece.split()  # bytes: at 0x20 and 0x09 to 0x0D only
        for w in set(words).difference(no):
            no[w] = len(no)
        numbers.append(np.fromiter(map(no.__getitem__, words), np.int32, len(words)))
        raw = np.frombuffer(piece, np.uint8)
        chars += int(((raw & 0xC0) != 0x80).sum() - ((raw == 32) | ((raw >= 9) & (raw <= 13))).sum())
    ids = np.concatenate(numbers) if numbers else np.empty(0, np.int32)
    seen, repeats = set(), 0
    for line in text.split(b"\n"):
        if line.strip():
            repeats += line in seen
            seen.add(line)
    repeated = repeated_words(ids) if len(no) < len(ids) else 0  # words that are all different can't repeat
    return len(ids), chars, sum(text.count(c) for c in SYMBOLS), repeats, repeated


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measured(spark: SparkSession, docs: DataFrame, id_col: str, text_col: str, by: tuple[str, ...]) -> DataFrame:
    """The id, the columns of `by` as text, and MEASURES of every row."""
    prepared(spark)
    rows = docs.select(F.col(id_col).alias("id"), *(F.col(c).cast("string").alias(f"by_{i}") for i, c in enumerate(by)), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kept = [f for f in rows.schema if f.name != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.array([measures(t) for t in column_bytes(b, "text")], np.int64).reshape(-1, len(MEASURES))
            cols = {n: b.column(i) for i, n in enumerate(b.schema.names) if n != "text"}
            yield batch_of(**cols, **{n: pa.array(found[:, k]) for k, n in enumerate(MEASURES)})

    return map_arrow(rows, run, ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in kept), *(f"{n} long" for n in MEASURES)]))


def cell(value: Column) -> Column:
    """The least value of the sketch's cell that holds a whole number from 0 on."""
    drop = F.greatest(F.length(F.bin(value)) - BITS, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, drop), drop)


def thousandths() -> dict[str, Column]:
    share = lambda c: F.floor(1000 * F.col(c) / F.greatest(F.col("n_words"), F.lit(1))).cast("long")
    return {"word_length": share("word_chars"), "symbols": share("n_symbols"), "dup_lines": share("n_dup_lines"), "repeat_words": share("n_repeat_words")}


def sketches(rows: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """by, rule, cell and n: a group's sketch of each measure. They are merged by adding n (and by leaving out columns of `by`)."""
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("rule"), cell(v).alias("cell")) for k, v in thousandths().items())))
    return rows.select(*by, each.alias("x")).groupBy(*by, "x.rule", "x.cell").agg(F.count("*").alias("n"))


def limits(spark: SparkSession, sketch: DataFrame, by: tuple[str, ...], rules: tuple[Rule, ...] = RULES, prior: int = PRIOR) -> DataFrame:
    """by and, for each rule, <rule>_low and <rule>_high: reach spreads beyond the quartiles of the group's sketch, into
    which the whole corpus's is merged with the weight of `prior` documents, or of the group's own if these are fewer. A spread is what lies between the quartiles."""
    whole = sketch.groupBy("rule", "cell").agg(F.sum("n").alias("all"))
    whole = materialise(spark, whole.withColumn("total", F.sum("all").over(Window.partitionBy("rule"))), "whole-sketch")
    groups = sketch.groupBy(*by, "rule").agg(F.least(F.sum("n"), F.lit(prior)).alias("prior"))
    # a group's merged weight of a cell: n * total + prior * all, whole numbers of up to 38 digits
    big = lambda c: F.col(c).cast("decimal(19,0)")
    own = sketch.join(F.broadcast(whole.select("rule", "total").distinct()), "rule").select(*by, "rule", "cell", (big("n") * big("total")).alias("w"))  # a row for each rule
    from_all = groups.join(F.broadcast(whole), "rule").select(*by, "rule", "cell", (big("all") * big("prior")).alias("w"))  # cells of four measures: some thousand rows
    merged = own.unionByName(from_all).groupBy(*by, "rule", "cell").agg(F.sum("w").alias("w"))
    of = Window.partitionBy(*by, "rule")
    upto = merged.select("*", F.sum("w").over(of.orderBy("cell")).alias("upto"), F.sum("w").over(of).alias("sum"))
    quartile = lambda k: F.min(F.when(F.col("upto") * 4 >= F.col("sum") * k, F.col("cell")))
    found = upto.groupBy(*by, "rule").agg(quartile(1).alias("q1"), quartile(3).alias("q3"))
    rule = lambda f: F.create_map(*(F.lit(x) for r in rules for x in (r.name, f(r))))[F.col("rule")]
    spread = F.greatest(F.col("q3") - F.col("q1"), rule(lambda r: r.least_spread)) * rule(lambda r: r.reach)
    ends = found.select(*by, "rule", F.when(rule(lambda r: r.low), F.col("q1") - spread).alias("low"), (F.col("q3") + spread).alias("high"))
    pick = lambda r, c: F.max(F.when(F.col("rule") == r.name, F.col(c))).alias(f"{r.name}_{c}")
    return ends.groupBy(*by).agg(*(pick(r, c) for r in rules for c in ("low", "high")))


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def filter_quality(spark: SparkSession, docs: DataFrame, by: tuple[str, ...] = ("lang", "source"), id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES, prior: int = PRIOR) -> DataFrame:
    """For each row the id, MEASURES, base_failed, kept, and the rules that it broke (`broken`).

    Limits come from all documents that pass the base rules, by their group. Null texts count as empty, have no words and
    fail; null groups are a group of their own; repeated rows and null ids are judged each; a group without a passing row
    has no limits and nothing to judge; an empty table gives an empty table; other columns are not read. A text of n words
    takes about 60 n bytes in its task, besides its different words."""
    names = tuple(f"by_{i}" for i in range(len(by)))
    rows = materialise(spark, measured(spark, docs, id_col, text_col, by).withColumn("base_failed", base_failed()), "measures")
    # one text for a group, so that null groups join like others
    key = F.to_json(F.array(*(F.coalesce(F.concat(F.lit("="), F.col(n)), F.lit("")) for n in names)))
    rows = rows.withColumn("grp", key)
    sketch = materialise(spark, sketches(rows.where("NOT base_failed"), ("grp",)), "sketches")
    ends = small(spark, limits(spark, sketch, ("grp",), rules, prior), "limits")
    value = thousandths()
    out = rows.join(ends, "grp", "left")
    broken = [F.when((value[r.name] > F.col(f"{r.name}_high")) | F.coalesce(value[r.name] < F.col(f"{r.name}_low"), F.lit(False)), F.lit(r.name)) for r in rules]
    out = out.withColumn("broken", F.when(F.col("base_failed"), F.array().cast("array<string>")).otherwise(F.array_compact(F.array(*broken))))
    return out.select(F.col("id").alias(id_col), *MEASURES, "base_failed", (~F.col("base_failed") & (F.size("broken") == 0)).alias("kept"), "broken")


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_quality(spark, table(spark, sf_dir, "documents")).select("doc_id", *MEASURES, "base_failed", "kept")


_WORD = r"[^\x20\x09-\x0D]"
_RULES = ", ".join(f"('{r.name}', {r.least_spread}, {r.reach}, {str(r.low).lower()})" for r in RULES)
OP12_SQL = rf"""
WITH t AS (SELECT row_number() OVER () AS u, doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORD}+') AS w FROM documents),
win AS (SELECT u, unnest(range(1, len(w) - {WINDOW - 2})) AS i, unnest(list_transform(range(1, len(w) - {WINDOW - 2}), lambda i: array_to_string(w[i:i + {WINDOW - 1}], ' '))) AS x FROM t WHERE len(w) >= {WINDOW}),
twice AS (SELECT u, i FROM win QUALIFY count(*) OVER (PARTITION BY u, x) > 1),
rep AS (SELECT u, count(DISTINCT i + k) AS n FROM twice, range({WINDOW}) r(k) GROUP BY u),
lines AS (SELECT u, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '{_WORD}')) AS l FROM t),
m AS (SELECT u, doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, CAST(length(regexp_replace(text, '[^{SYMBOLS.decode()}]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed FROM t JOIN lines USING (u) LEFT JOIN rep USING (u)),
v AS (SELECT u, lang, source, base_failed, r.rule, CAST(1000 * r.x // greatest(n_words, 1) AS BIGINT) AS v FROM m, LATERAL (VALUES ('word_length', word_chars), ('symbols', n_symbols), ('dup_lines', n_dup_lines), ('repeat_words', n_repeat_words)) r(rule, x)),
sk AS (SELECT lang, source, rule, (v >> greatest(length(bin(v)) - {BITS}, 0)) << greatest(length(bin(v)) - {BITS}, 0) AS cell, count(*) AS n FROM v WHERE NOT base_failed GROUP BY ALL),
alls AS (SELECT rule, cell, sum(n) AS a, sum(sum(n)) OVER (PARTITION BY rule) AS total FROM sk GROUP BY rule, cell),
merged AS (SELECT g.lang, g.source, a.rule, a.cell, coalesce(sk.n, 0) * a.total + least(g.own, {PRIOR}) * a.a AS w FROM (SELECT lang, source, rule, sum(n) AS own FROM sk GROUP BY ALL) g JOIN alls a ON a.rule = g.rule LEFT JOIN sk ON sk.lang IS NOT DISTINCT FROM g.lang AND sk.source IS NOT DISTINCT FROM g.source AND sk.rule = a.rule AND sk.cell = a.cell),
upto AS (SELECT *, sum(w) OVER (PARTITION BY lang, source, rule ORDER BY cell) AS upto, sum(w) OVER (PARTITION BY lang, source, rule) AS total FROM merged),
q AS (SELECT lang, source, rule, min(cell) FILTER (WHERE 4 * upto >= total) AS q1, min(cell) FILTER (WHERE 4 * upto >= 3 * total) AS q3 FROM upto GROUP BY ALL),
ends AS (SELECT q.*, q1 - reach * greatest(q3 - q1, least_spread) AS low, q3 + reach * greatest(q3 - q1, least_spread) AS high, has_low FROM q JOIN (VALUES {_RULES}) x(rule, least_spread, reach, has_low) USING (rule)),
bad AS (SELECT DISTINCT u FROM v JOIN ends e ON e.lang IS NOT DISTINCT FROM v.lang AND e.source IS NOT DISTINCT FROM v.source AND e.rule = v.rule WHERE v > high OR has_low AND v < low)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND u NOT IN (SELECT u FROM bad) AS kept FROM m
"""
