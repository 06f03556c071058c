"""Importance resampling towards a target: documents whose n-grams are more usual in the target than in the corpus are
likelier to be drawn.

Words become a table of positions, in which a window puts the following words beside each; the runs of one to three words
are hashed into buckets, counts of buckets in corpus and target give each bucket's gain, and the gains are joined to the
positions and summed for each document. Gumbel noise by a hash of the id makes the highest scores a draw without
replacement.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shotlens.llm.common import CRC_TABLE, crc_sql, prepared, table
from shotlens.operators.places import placed, small
from shotlens.session import materialise

ORDERS, BUCKETS, SEED, LEAST_WORDS, PERCENT = 3, 10_000, 42, 20, 5
#: Fixed value: what words are made of, A-Z before they are lower-cased.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lowered(word: Column) -> Column:
    """A-Z in lower case, other letters as they are."""
    return F.when(F.octet_length(word) == F.char_length(word), F.lower(word)).otherwise(F.translate(word, CAPITALS, CAPITALS.lower()))


def position_table(spark: SparkSession, texts: DataFrame, orders: int = ORDERS, buckets: int = BUCKETS) -> DataFrame:
    """A row for each word (one for a text without words): uid, id, and b0, b1, ... the buckets of the runs of 1, 2, ...
    `orders` words that begin there (null beyond the text's end).

    Texts are dealt by uid before they are taken apart, so that the window over a text's words needs no shuffle."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    words = texts.repartition(n, "uid").select("uid", "id", F.posexplode_outer(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("pos", "raw"))
    words = words.select("uid", "id", "pos", lowered(F.col("raw")).alias("w0"))
    after = Window.partitionBy("uid").orderBy("pos")
    ahead = words.select("uid", "id", "w0", *(F.lead("w0", k).over(after).alias(f"w{k}") for k in range(1, orders)))
    run = lambda k: F.concat_ws(" ", *(f"w{i}" for i in range(k + 1)))
    bucket = lambda k: F.when(F.col(f"w{k}").isNotNull(), F.pmod(F.crc32(run(k).cast("binary")), F.lit(buckets)).cast("int"))
    return ahead.select("uid", "id", *(bucket(k).alias(f"b{k}") for k in range(orders)))


def bucket_counts(positions: DataFrame, orders: int = ORDERS) -> DataFrame:
    return positions.select(F.explode(F.array(*(f"b{k}" for k in range(orders)))).alias("bucket")).where("bucket IS NOT NULL").groupBy("bucket").agg(F.count("*").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket and gain of every bucket, from the tables (bucket, n): at most `buckets` rows."""
    every = corpus.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    both = every.join(corpus.select("bucket", F.col("n").alias("s")), "bucket", "left").join(target.select("bucket", F.col("n").alias("t")), "bucket", "left").na.fill(0)
    sums = corpus.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("all_s")).crossJoin(target.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("all_t")))  # one row
    d = {c: F.col(c).cast("double") for c in ("s", "t", "all_s", "all_t")}
    ratio = ((d["t"] + 1) * (d["all_s"] + float(buckets))) / ((d["s"] + 1) * (d["all_t"] + float(buckets)))
    return both.crossJoin(F.broadcast(sums)).select("bucket", F.floor(1000 * F.ln(ratio)).cast("long").alias("gain"))


def noise(id_col: str, seed: int = SEED) -> Column:
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0))).cast("long")


def resample(spark: SparkSession, docs: DataFrame, target: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", orders: int = ORDERS, buckets: int = BUCKETS, seed: int = SEED, least_words: int = LEAST_WORDS) -> DataFrame:
    """For each row the id, n_features, weight, score and rank (from 1; null for those that are not drawn).

    Null, empty and wordless texts have no features and weight 0; null ids take their noise from an empty id and come first
    among equal scores; repeated rows are drawn each, by their own place; without documents the result is empty, without
    target texts every t is 0; columns beside the id and the text are not read. Long texts are rows of the position table,
    which sorts on disk where it must."""
    prepared(spark)
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias("text")
    rows = docs.select(F.col(id_col).alias("id"), text(text_col), F.monotonically_increasing_id().alias("uid"))
    positions = materialise(spark, position_table(spark, rows, orders, buckets), "positions")
    wanted = position_table(spark, target.select(F.lit(0).alias("id"), text(target_text), F.monotonically_increasing_id().alias("uid")), orders, buckets)
    gain = small(spark, gains(materialise(spark, bucket_counts(positions, orders), "corpus-counts"), materialise(spark, bucket_counts(wanted, orders), "target-counts"), buckets), "gains")
    for k in range(orders):
        positions = positions.join(gain.select(F.col("bucket").alias(f"b{k}"), F.col("gain").alias(f"g{k}")), f"b{k}", "left")
    every = range(orders)
    weight = F.coalesce(F.sum(sum((F.coalesce(f"g{k}", F.lit(0)) for k in every), F.lit(0))), F.lit(0))
    found = positions.groupBy("uid", "id").agg(F.count("b0").alias("n_words"), sum((F.count(f"b{k}") for k in every), F.lit(0)).alias("n_features"), weight.alias("weight"))
    found = found.select("id", "n_features", "weight", (F.col("weight") + noise("id", seed)).alias("score"), (F.col("n_words") >= least_words).alias("fit"), F.lit("").alias("all"))
    found = materialise(spark, found, "scores")
    drawn = found.where("fit").count() * percent // 100
    ranked = placed(spark, found, ["all"], [F.desc("fit"), F.desc("score"), "id"], "ranks")
    rank = F.when(F.col("fit") & (F.col("place") < drawn), F.col("place") + 1)
    return ranked.select(F.col("id").alias(id_col), "n_features", "weight", "score", rank.alias("rank"))


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP13_SQL = rf"""
WITH crc AS ({CRC_TABLE}), d AS (SELECT row_number() OVER () AS u, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{CAPITALS}', '{CAPITALS.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT regexp_extract_all(translate(coalesce(text, ''), '{CAPITALS}', '{CAPITALS.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
df AS (SELECT u, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS f FROM d, range(1, {ORDERS + 1}) r(k) WHERE len(w) >= k),
bf AS (SELECT unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS f FROM b, range(1, {ORDERS + 1}) r(k) WHERE len(w) >= k),
h AS (SELECT f, {crc_sql("f")} % {BUCKETS} AS bucket FROM (SELECT f FROM df UNION SELECT f FROM bf), crc),
s AS (SELECT bucket, count(*) AS s FROM df JOIN h USING (f) GROUP BY bucket), t AS (SELECT bucket, count(*) AS t FROM bf JOIN h USING (f) GROUP BY bucket),
g AS (SELECT r.bucket, CAST(floor(1000 * ln(((coalesce(t, 0) + 1) * ((SELECT count(*) FROM df) + {BUCKETS}))::DOUBLE / ((coalesce(s, 0) + 1) * ((SELECT count(*) FROM bf) + {BUCKETS}))::DOUBLE)) AS BIGINT) AS gain FROM range({BUCKETS}) r(bucket) LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)),
w AS (SELECT u, CAST(count(*) AS BIGINT) AS n_features, CAST(sum(gain) AS BIGINT) AS weight FROM df JOIN h USING (f) JOIN g USING (bucket) GROUP BY u),
x AS (SELECT u, doc_id, len(w) >= {LEAST_WORDS} AS fit, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, CAST('0x' || substr(sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h FROM d LEFT JOIN w USING (u)),
y AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM x),
z AS (SELECT *, row_number() OVER (ORDER BY fit DESC, score DESC, doc_id NULLS FIRST) AS place, count(*) FILTER (WHERE fit) OVER () AS n FROM y)
SELECT doc_id, n_features, weight, score, CASE WHEN fit AND place <= {PERCENT} * n // 100 THEN place END AS rank FROM z
"""
