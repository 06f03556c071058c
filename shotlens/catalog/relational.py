"""Joins, lookups, ranking, sets and ordered operators on the star tables and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shotlens.catalog.views import V_FRAME, V_SHOT, frames, shots, table
from shotlens.functions.timecode import bin_index, frame_to_sec, sec_to_frame
from shotlens.operators.asof import asof_join, nearest_join
from shotlens.operators.nonoverlap import non_overlapping
from shotlens.operators.ranking import argmax_first_seen, keep_first, keep_last, top_k
from shotlens.operators.windows import adjacent_values, change_count, consecutive_windows, neighbour_union, smooth_isolated, timeline
from shotlens.plans.candidates import sequence_score
from shotlens.plans.identity import speaker_choice
from shotlens.plans.manifest import allowed_only, missing_keys

Q: dict = {}


def query(name: str, sql: str | None):
    def add(f):
        Q[name] = (f, sql)
        return f

    return add


@query("frame_round", f"WITH {V_FRAME} SELECT event_id, CAST(round_even(t * 24.0, 0) AS BIGINT) AS frame, round(CAST(round_even(t * 24.0, 0) AS BIGINT) / 24.0, 6) AS seconds FROM v_frame")
def frame_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir).withColumn("frame", sec_to_frame(F.col("t"), F.lit(24.0)))
    return f.select("event_id", "frame", F.round(frame_to_sec(F.col("frame"), F.lit(24.0)), 6).alias("seconds"))


def _asof_sql(forward: bool) -> str:
    cmp, agg = (">", "min_by") if forward else ("<", "max_by")
    gap = "v.t - p.t" if forward else "p.t - v.t"
    return f"""WITH {V_FRAME}, p AS (SELECT * FROM v_frame WHERE kind = 'purchase'), v AS (SELECT * FROM v_frame WHERE kind = 'view'),
m AS (SELECT p.event_id, {agg}(v.event_id, v.t) AS hit, min({gap}) AS gap FROM p JOIN v ON v.stream = p.stream AND v.t {cmp} p.t GROUP BY p.event_id)
SELECT p.event_id, CASE WHEN gap <= 200000 THEN hit END AS other_id, CAST(round(CASE WHEN gap <= 200000 THEN gap END * 1e6) AS BIGINT) AS gap_us FROM p LEFT JOIN m USING (event_id)"""


def _asof(spark: SparkSession, sf_dir: str, forward: bool) -> DataFrame:
    f = frames(spark, sf_dir).select("stream", "event_id", "t", "kind")
    p, v = f.where("kind = 'purchase'").drop("kind"), f.where("kind = 'view'").drop("kind")
    return asof_join(p, v, ["stream"], "t", "t", {"event_id": "other_id"}, 200_000.0, forward, ["event_id"]).select("event_id", "other_id", F.round(F.col("gap") * 1e6).cast("long").alias("gap_us"))


@query("asof_prev", _asof_sql(False))
def asof_prev(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _asof(spark, sf_dir, False)


@query("asof_next", _asof_sql(True))
def asof_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _asof(spark, sf_dir, True)


@query("nearest_time", f"""WITH {V_FRAME}, e AS (SELECT * FROM v_frame WHERE kind = 'error'), c AS (SELECT * FROM v_frame WHERE kind = 'click')
SELECT e.event_id, min_by(c.event_id, abs(c.t - e.t)) AS click_id FROM e LEFT JOIN c USING (stream) GROUP BY e.event_id""")
def nearest_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir).select("stream", "event_id", "t", "kind")
    return nearest_join(f.where("kind = 'error'").drop("kind"), f.where("kind = 'click'").drop("kind"), ["stream"], "t", "t", {"event_id": "click_id"}, ["event_id"]).select("event_id", "click_id")


# Epoch seconds, whole ones, so that many rows share a place: there the click of the least id at the same place counts.
@query("nearest_epoch", f"""WITH {V_FRAME}, a AS (SELECT stream, event_id, kind, 1.7e9 + floor(t / 3600) * 3600 AS t FROM v_frame), e AS (SELECT * FROM a WHERE kind = 'error'), c AS (SELECT * FROM a WHERE kind = 'click')
SELECT e.event_id, min_by(c.event_id, {{'d': abs(c.t - e.t), 'later': CAST(c.t >= e.t AS INT), 'id': c.event_id}}) AS click_id, min(abs(c.t - e.t)) AS gap FROM e LEFT JOIN c USING (stream) GROUP BY e.event_id""")
def nearest_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir).select("stream", "event_id", (1.7e9 + F.floor(F.col("t") / 3600) * 3600).alias("t"), "kind")
    return nearest_join(f.where("kind = 'error'").drop("kind"), f.where("kind = 'click'").drop("kind"), ["stream"], "t", "t", {"event_id": "click_id"}, ["event_id"]).select("event_id", "click_id", "gap")


@query("semi_allowed", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F')")
def semi_allowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return allowed_only(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), o, ["l_orderkey"])


@query("anti_unseen", "SELECT DISTINCT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_unseen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return missing_keys(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ["doc_id"])


@query("wide_left_join", """
SELECT l_orderkey, l_linenumber, coalesce(nullif(o_orderstatus, 'O'), l_linestatus, '') AS status, coalesce(c_name, '') AS customer, coalesce(nc.n_name, 'unknown') AS nation, coalesce(p_brand, '') AS brand, coalesce(s_name, '') AS supplier, coalesce(ns.n_name, 'unknown') AS supplier_nation
FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation nc ON nc.n_nationkey = c_nationkey
LEFT JOIN part ON p_partkey = l_partkey LEFT JOIN supplier ON s_suppkey = l_suppkey LEFT JOIN nation ns ON ns.n_nationkey = s_nationkey""")
def wide_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    nation = t("nation").select("n_nationkey", "n_name")
    j = (
        t("lineitem").select("l_orderkey", "l_linenumber", "l_linestatus", "l_partkey", "l_suppkey")
        .join(t("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus", "o_custkey"), "l_orderkey", "left")
        .join(t("customer").select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_nationkey"), "o_custkey", "left")
        .join(nation.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("cn")), "c_nationkey", "left")
        .join(t("part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey", "left")
        .join(t("supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name", "s_nationkey"), "l_suppkey", "left")
        .join(nation.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("sn")), "s_nationkey", "left")
    )
    return j.select("l_orderkey", "l_linenumber", F.coalesce(F.nullif("o_orderstatus", F.lit("O")), "l_linestatus", F.lit("")).alias("status"), F.coalesce("c_name", F.lit("")).alias("customer"), F.coalesce("cn", F.lit("unknown")).alias("nation"), F.coalesce("p_brand", F.lit("")).alias("brand"), F.coalesce("s_name", F.lit("")).alias("supplier"), F.coalesce("sn", F.lit("unknown")).alias("supplier_nation"))


@query("dedupe_last", """
SELECT user_id, event_type, max_by(event_id, event_id) AS last_id, max_by(value, event_id) AS last_value, min_by(value, event_id) AS first_value FROM events GROUP BY ALL""")
def dedupe_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value")
    last = keep_last(e.withColumn("ord", F.col("event_id")), ["user_id", "event_type"], "ord").select("user_id", "event_type", F.col("event_id").alias("last_id"), F.col("value").alias("last_value"))
    first = keep_first(e.withColumn("ord", F.col("event_id")), ["user_id", "event_type"], "ord").select("user_id", "event_type", F.col("value").alias("first_value"))
    return last.join(first, ["user_id", "event_type"])


@query("window_candidates", f"""WITH {V_SHOT}, w AS (SELECT a.conv_id, a.shot_idx AS lo, b.shot_idx AS hi, b.end_sec - a.start_sec AS total FROM v_shot a JOIN v_shot b ON a.conv_id = b.conv_id AND b.shot_idx BETWEEN a.shot_idx + 2 AND a.shot_idx + 9),
f AS (SELECT w.conv_id, lo, hi, total, list(s.voice ORDER BY s.shot_idx) AS voices, count(DISTINCT s.voice) AS speakers, max(s.dur) AS longest, string_agg(s.role, '|' ORDER BY s.shot_idx) AS roles FROM w JOIN v_shot s ON s.conv_id = w.conv_id AND s.shot_idx BETWEEN lo AND hi GROUP BY ALL)
SELECT conv_id, lo, hi, CAST(total AS DOUBLE) AS total, CAST(speakers AS INT) AS speakers, CAST(len(list_filter(range(1, len(voices)), lambda i: voices[i] <> voices[i + 1])) AS INT) AS changes, CAST(longest AS BIGINT) AS longest, roles FROM f WHERE total BETWEEN 300 AND 6000""")
def window_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = shots(spark, sf_dir).withColumn("voice_text", F.col("voice").cast("string"))
    w = consecutive_windows(s, ["conv_id"], "shot_idx", ["voice_text", "dur", "start_sec", "end_sec", "role"], 3, 10)
    first, last = F.col("shots")[0], F.element_at("shots", -1)
    total = (last["end_sec"] - first["start_sec"]).cast("double")
    return w.where(total.between(300, 6000)).select("conv_id", first["shot_idx"].alias("lo"), last["shot_idx"].alias("hi"), total.alias("total"), F.size(F.array_distinct("shots.voice_text")).alias("speakers"), change_count(F.col("shots.voice_text")).cast("int").alias("changes"), F.array_max("shots.dur").cast("long").alias("longest"), F.array_join("shots.role", "|").alias("roles"))


_SCORED = f"""{V_SHOT}, w AS (SELECT a.conv_id, a.shot_idx AS lo, b.shot_idx AS hi, CAST(b.end_sec - a.start_sec AS DOUBLE) / 100 AS total FROM v_shot a JOIN v_shot b ON a.conv_id = b.conv_id AND b.shot_idx BETWEEN a.shot_idx + 2 AND a.shot_idx + 9),
f AS (SELECT w.conv_id, lo, hi, total, list(s.voice ORDER BY s.shot_idx) AS voices, count(DISTINCT s.voice) AS speakers, hi - lo + 1 AS n FROM w JOIN v_shot s ON s.conv_id = w.conv_id AND s.shot_idx BETWEEN lo AND hi GROUP BY ALL),
g AS (SELECT *, len(list_filter(range(1, len(voices)), lambda i: voices[i] <> voices[i + 1])) AS changes FROM f),
r AS (SELECT conv_id, lo, hi, changes, n, 2 * least(changes, 5) + 0.8 * least(n, 12) + 1.5 * least(speakers, 4) + 3 * CASE WHEN total < 8 THEN total / 8 WHEN total > 18 THEN greatest(0, 1 - (total - 18) / 18) ELSE 1 END + 4 * 0.5 + 0.75 * least(speakers, 4) + 0.7 * 1.25 + 2 - 0 AS score FROM g)"""


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = shots(spark, sf_dir).withColumn("voice_text", F.col("voice").cast("string"))
    w = consecutive_windows(s, ["conv_id"], "shot_idx", ["voice_text", "start_sec", "end_sec"], 3, 10)
    first, last = F.col("shots")[0], F.element_at("shots", -1)
    w = w.select("conv_id", first["shot_idx"].alias("lo"), last["shot_idx"].alias("hi"), (last["end_sec"] - first["start_sec"]).cast("double").alias("total"), F.size(F.array_distinct("shots.voice_text")).alias("speakers"), change_count(F.col("shots.voice_text")).alias("changes"), F.size("shots").alias("n"))
    return w.withColumn("score", sequence_score(F.col("total") / 100, F.col("changes"), F.col("n"), F.col("speakers"), F.lit(0.5), F.col("speakers"), F.lit(1.25), F.lit(2), F.lit(0), F.lit(0)))


@query("window_score", f"WITH {_SCORED} SELECT conv_id, lo, hi, round_even(score, 4) AS score FROM r")
def window_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("conv_id", "lo", "hi", "score")


@query("greedy_nonoverlap", f"""WITH RECURSIVE {_SCORED}, o AS (SELECT conv_id, lo, hi, row_number() OVER (PARTITION BY conv_id ORDER BY round(score, 4) DESC, changes DESC, n, lo, hi) AS i FROM r),
t(conv_id, i, taken) AS (SELECT conv_id, 0::BIGINT, []::STRUCT(lo BIGINT, hi BIGINT)[] FROM (SELECT DISTINCT conv_id FROM o)
  UNION ALL SELECT t.conv_id, o.i, CASE WHEN len(list_filter(t.taken, lambda x: x.lo <= o.hi AND o.lo <= x.hi)) > 0 THEN t.taken ELSE list_append(t.taken, {{'lo': o.lo, 'hi': o.hi}}) END FROM t JOIN o ON o.conv_id = t.conv_id AND o.i = t.i + 1),
l AS (SELECT conv_id, max_by(taken, i) AS taken FROM t GROUP BY conv_id)
SELECT conv_id, x.lo AS lo, x.hi AS hi FROM (SELECT conv_id, unnest(taken) AS x FROM l)""")
def greedy_nonoverlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _scored(spark, sf_dir).select("conv_id", "lo", "hi", "score", "changes", "n")
    return non_overlapping(s, ["conv_id"], [-F.col("score"), -F.col("changes"), F.col("n"), F.col("lo"), F.col("hi")], "lo", "hi").select("conv_id", "lo", "hi")


@query("neighbour_union", f"""WITH {V_SHOT}, n AS (SELECT conv_id, shot_idx, coalesce([lag(voice) OVER w], []) AS a, coalesce([lead(voice) OVER w], []) AS b FROM v_shot WINDOW w AS (PARTITION BY conv_id ORDER BY shot_idx))
SELECT conv_id, shot_idx, list_sort(list_distinct(list_filter(list_concat(a, b), lambda x: x IS NOT NULL))) AS near FROM n""")
def neighbour_union_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = shots(spark, sf_dir).select("conv_id", "shot_idx", F.array("voice").alias("labels"))
    return neighbour_union(s, ["conv_id"], ["shot_idx"], "labels", "near").select("conv_id", "shot_idx", F.sort_array("near").alias("near"))


@query("lag_lead_smooth", f"""WITH {V_FRAME}, s AS (SELECT stream, event_id, t, CASE WHEN kind = 'error' THEN 'unknown' WHEN kind = 'signup' THEN 'ambiguous' ELSE 'assigned' END AS status, k % 2 AS target, conf FROM v_frame),
n AS (SELECT *, lag(status) OVER w AS ps, lead(status) OVER w AS ns, lag(target) OVER w AS pt, lead(target) OVER w AS nt, lag(conf) OVER w AS pc, lead(conf) OVER w AS nc FROM s WINDOW w AS (PARTITION BY stream ORDER BY t, event_id)),
h AS (SELECT *, coalesce(status IN ('unknown', 'ambiguous') AND ps = 'assigned' AND ns = 'assigned' AND pt = nt, false) AS hit FROM n)
SELECT event_id, CASE WHEN hit THEN 'assigned' ELSE status END AS status, CASE WHEN hit THEN pt ELSE target END AS target, round(CASE WHEN hit THEN least(pc, nc) * 0.9 ELSE conf END, 5) AS conf, CAST(hit AS INT) AS smoothing_applied FROM h""")
def lag_lead_smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir).select("stream", "event_id", "t", F.when(F.col("kind") == "error", "unknown").when(F.col("kind") == "signup", "ambiguous").otherwise("assigned").alias("status"), (F.col("k") % 2).alias("target"), "conf")
    return smooth_isolated(f, ["stream"], ["t", "event_id"], "status", ["target"], ["target"], "conf").select("event_id", "status", "target", F.round("conf", 5).alias("conf"), "smoothing_applied")


@query("adjacent_target", f"""WITH {V_FRAME}, s AS (SELECT stream % 10 AS seq, CAST(stream AS VARCHAR) AS shot, k % 3 AS track, event_id, kind FROM v_frame),
n AS (SELECT *, lag(track) OVER w AS pt, lag(kind) OVER w AS pk, lead(track) OVER w AS nt, lead(kind) OVER w AS nk FROM s WINDOW w AS (PARTITION BY seq ORDER BY shot, track, event_id))
SELECT event_id, CASE WHEN pt = track THEN pk ELSE '' END AS prev_target, CASE WHEN nt = track THEN nk ELSE '' END AS next_target FROM n""")
def adjacent_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir).select((F.col("stream") % 10).alias("seq"), F.col("stream").cast("string").alias("shot"), (F.col("k") % 3).alias("track"), "event_id", "kind")
    return adjacent_values(f, ["seq"], ["shot", "track", "event_id"], ["track"], "kind", "prev_target", "next_target").select("event_id", "prev_target", "next_target")


@query("timeline_cumsum", f"""WITH {V_SHOT}, b AS (SELECT conv_id, CAST(min(start_sec) AS DOUBLE) AS s, CAST(max(end_sec) AS DOUBLE) AS e FROM v_shot GROUP BY conv_id),
r AS (SELECT v.conv_id, shot_idx, s, e, CAST(voice AS DOUBLE) AS r, sum(voice) OVER (PARTITION BY v.conv_id) AS total, sum(voice) OVER (PARTITION BY v.conv_id ORDER BY shot_idx) AS upto, lead(shot_idx) OVER (PARTITION BY v.conv_id ORDER BY shot_idx) IS NULL AS last FROM v_shot v JOIN b USING (conv_id))
SELECT conv_id, shot_idx, round(s + (e - s) * ((upto - r) / total), 3) AS t0, round(CASE WHEN last THEN e ELSE s + (e - s) * (upto / total) END, 3) AS t1 FROM r WHERE total > 0""")
def timeline_cumsum(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = shots(spark, sf_dir)
    b = s.groupBy("conv_id").agg(F.min("start_sec").cast("double").alias("s"), F.max("end_sec").cast("double").alias("e"))
    out = timeline(s.join(b, "conv_id"), ["conv_id"], ["shot_idx"], "voice", "s", "e", None)
    return out.select("conv_id", "shot_idx", F.round("t0", 3).alias("t0"), F.round("t1", 3).alias("t1"))


@query("topk_per_group", "SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice, rank FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey, l_quantity) AS rank FROM lineitem) WHERE rank <= 5")
def topk_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice", "l_partkey", "l_quantity")
    return top_k(x, ["l_suppkey"], [F.desc("l_extendedprice"), "l_orderkey", "l_linenumber", "l_partkey", "l_quantity"], 5).select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice", F.col("rank").cast("long").alias("rank"))


@query("first_k_distinct", """
WITH f AS (SELECT user_id, event_type, min(event_id) AS i FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY i) AS n FROM f)
SELECT user_id, list(event_type ORDER BY i) FILTER (WHERE n <= 3) AS first_types, string_agg(event_type, ' / ' ORDER BY i) AS all_types FROM r GROUP BY user_id""")
def first_k_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shotlens.functions.text import first_distinct, unique_join

    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("event_id", "event_type"))), lambda x: x["event_type"]).alias("types"))
    return e.select("user_id", first_distinct(F.col("types"), 3).alias("first_types"), unique_join(F.col("types"), " / ").alias("all_types"))


@query("cooccurrence_argmax", """
WITH w AS (SELECT p_brand AS norm, l_suppkey AS pid, CASE WHEN l_linenumber = 1 THEN 3 ELSE 1 END AS w, l_orderkey * 10 + l_linenumber AS ord FROM lineitem JOIN part ON p_partkey = l_partkey),
s AS (SELECT norm, pid, CAST(sum(w) AS BIGINT) AS n, min(ord) AS first FROM w GROUP BY ALL), t AS (SELECT *, sum(n) OVER (PARTITION BY norm) AS total, row_number() OVER (PARTITION BY norm ORDER BY n DESC, first) AS r FROM s)
SELECT norm, pid, n, CAST(total AS BIGINT) AS total, round(least(0.85, 0.45 + 0.08 * n + 0.20 * (n / total)), 6) AS confidence FROM t WHERE r = 1""")
def cooccurrence_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_linenumber", "l_orderkey").join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("norm")), "l_partkey")
    x = x.select("norm", F.col("l_suppkey").alias("pid"), F.when(F.col("l_linenumber") == 1, 3).otherwise(1).alias("w"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"))
    best = argmax_first_seen(x, ["norm"], "pid", F.col("w"), "ord")
    none = spark.createDataFrame([], "norm string, pid long")
    conf = speaker_choice(best, none).select("norm", F.round("confidence", 6).alias("confidence"))
    return best.select("norm", "pid", "n", "total").join(conf, "norm")


@query("union_mismatched", """
SELECT c_custkey AS key, c_name AS name, c_nationkey AS nation, c_acctbal AS balance, c_mktsegment AS segment FROM customer UNION ALL SELECT s_suppkey, s_name, s_nationkey, s_acctbal, NULL FROM supplier""")
def union_mismatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shotlens.operators.sets import union_all

    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance"))
    return union_all(c, s)


@query("set_algebra", """
WITH t AS (SELECT user_id, list_sort(list(DISTINCT event_type) FILTER (WHERE event_id % 3 = 0)) AS a, list_sort(list(DISTINCT event_type) FILTER (WHERE event_id % 7 = 0)) AS b, count(DISTINCT (event_type, event_id % 5)) AS pairs FROM events GROUP BY user_id),
c AS (SELECT user_id, coalesce(a, []) AS a, coalesce(b, []) AS b, pairs FROM t)
SELECT user_id, list_sort(list_intersect(a, b)) AS both, list_sort(list_filter(a, lambda x: NOT list_contains(b, x))) AS only_a, list_sort(list_distinct(list_concat(a, b))) AS either, list_has_any(a, b) AS overlap, pairs FROM c""")
def set_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shotlens.operators.sets import distinct_pairs, set_columns

    e = table(spark, sf_dir, "events")
    t = e.groupBy("user_id").agg(F.collect_set(F.when(F.col("event_id") % 3 == 0, F.col("event_type"))).alias("a"), F.collect_set(F.when(F.col("event_id") % 7 == 0, F.col("event_type"))).alias("b"), distinct_pairs("event_type", F.col("event_id") % 5).alias("pairs"))
    return t.select("user_id", *set_columns("a", "b"), "pairs")


@query("time_bins_index", f"WITH {V_FRAME} SELECT event_id, CAST(floor(t / 3600) AS BIGINT) AS hour_bin FROM v_frame")
def time_bins_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames(spark, sf_dir).select("event_id", bin_index(F.col("t"), 3600).alias("hour_bin"))
