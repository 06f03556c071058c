"""Shots, script lines, text functions and alignment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shotlens.catalog.views import V_LINE, V_SHOT, lines, shots, table
from shotlens.functions import text as T
from shotlens.functions import timecode as C
from shotlens.functions.jsonish import parse_cell, parse_list, stable_key
from shotlens.functions.numeric import direction_bucket, finite_float, safe_float
from shotlens.functions.tables import register
from shotlens.operators.alignment import align
from shotlens.operators.interval import collect_range, overlay
from shotlens.operators.similarity import token_score, tokens
from shotlens.operators.states import action_chunks, speeches
from shotlens.operators.windows import anchor_range
from shotlens.plans.context import repair_rows
from shotlens.plans.manifest import stage_type
from shotlens.plans.shots import flatten_stories

Q: dict = {}


def query(name: str, sql: str | None):
    def add(f):
        Q[name] = (f, sql)
        return f

    return add


@query("scan_flatten_nested", f"""WITH {V_SHOT}
SELECT conv_id AS movie_id, shot_idx, 'shot_' || CASE WHEN shot_idx < 10000 THEN lpad(CAST(shot_idx AS VARCHAR), 4, '0') ELSE CAST(shot_idx AS VARCHAR) END AS shot_id,
       role AS story_id, CAST(start_sec AS DOUBLE) AS shot_start_time, CAST(end_sec AS DOUBLE) AS shot_end_time, trim(text) AS subtitle_text, 1 AS utterances
FROM v_shot""")  # fmt: skip
def scan_flatten_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = shots(spark, sf_dir)
    item = F.struct(F.col("shot_idx").alias("shot"), F.array("start_sec", "end_sec").cast("array<double>").alias("duration"), F.array("text").alias("sentences"))
    stories = s.groupBy("conv_id", "role").agg(F.collect_list(item).alias("subtitle")).select(F.col("conv_id").alias("movie_id"), F.struct(F.col("role").alias("id"), F.lit("").alias("description"), "subtitle").alias("story"))
    docs = stories.groupBy("movie_id").agg(F.collect_list("story").alias("story"))
    flat = flatten_stories(docs)
    return flat.select("movie_id", F.col("shot_idx"), "shot_id", "story_id", "shot_start_time", "shot_end_time", T.join_nonblank(F.col("subtitle_sentences"), " | ").alias("subtitle_text"), T.utterance_count(F.col("subtitle_sentences"), F.lit("")).alias("utterances"))


@query("shot_cast_lookup", """
SELECT n_nationkey AS shot_idx, coalesce(list_sort(list(DISTINCT coalesce(c_name, CAST(o_custkey AS VARCHAR))) FILTER (WHERE o_custkey IS NOT NULL)), []) AS cast_names,
       CAST(count(DISTINCT o_custkey) AS INT) AS num_cast
FROM nation LEFT JOIN (SELECT c_nationkey, c_name, o_custkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'P') x ON c_nationkey = n_nationkey GROUP BY n_nationkey""")
def shot_cast_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shotlens.plans.shots import cast_names

    people = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("pid"), F.col("c_name").alias("name"), "c_nationkey")
    seen = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("pid")).join(people.select("pid", F.col("c_nationkey").alias("shot_idx")), "pid")
    names = cast_names(seen, people.select("pid", "name"), ["shot_idx"])
    out = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("shot_idx")).join(names, "shot_idx", "left")
    return out.select("shot_idx", F.coalesce("cast_names", F.array().cast("array<string>")).alias("cast_names"), F.coalesce("num_cast", F.lit(0)).alias("num_cast"))


@query("shot_level_summary", f"""WITH {V_SHOT}
SELECT count(*) AS n_rows, count(DISTINCT conv_id) AS n_movies, count(DISTINCT shot_idx) AS n_shot_idx, count(*) FILTER (WHERE text IS NULL) AS n_null_text, count(*) FILTER (WHERE trim(text) = '') AS n_empty_text,
       min(start_sec) AS first_start, max(end_sec) AS last_end, count(*) - count(DISTINCT (conv_id, shot_idx)) AS n_duplicates FROM v_shot""")
def shot_level_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shotlens.plans.shots import shot_summary

    return shot_summary(shots(spark, sf_dir), ["conv_id", "shot_idx"], "conv_id", "shot_idx", "text", "start_sec", "end_sec")


@query("alias_map", """
WITH p AS (SELECT p_partkey AS pid, upper(p_name) AS alias FROM part),
a AS (SELECT trim(regexp_replace(alias, '[^A-Z0-9]+', ' ', 'g')) AS norm, pid, 1 AS prio FROM p),
t AS (SELECT unnest(string_split(norm, ' ')) AS norm, pid, 0 AS prio FROM a)
SELECT norm, CASE WHEN max(prio) = 1 THEN max(pid) FILTER (WHERE prio = 1) ELSE min(pid) END AS pid FROM (SELECT * FROM a UNION ALL SELECT * FROM t WHERE length(norm) > 2) WHERE norm <> '' GROUP BY norm""")
def alias_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shotlens.plans.identity import alias_table

    cast = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("pid"), F.col("p_partkey").alias("input_ord"), F.array("p_name").alias("aliases"))
    return alias_table(cast)


@query("manifest_rows", f"""WITH {V_SHOT}, n AS (SELECT conv_id, count(DISTINCT voice) AS num_cast FROM v_shot GROUP BY conv_id)
SELECT conv_id AS sequence_id, 'shot_' || lpad(CAST(shot_idx AS VARCHAR), 4, '0') AS shot_id, shot_idx, CAST(end_sec - start_sec AS DOUBLE) AS duration,
       CASE WHEN num_cast <= 1 AND trim(text) <> '' THEN 'single_speaking' WHEN num_cast = 2 AND trim(text) <> '' THEN 'two_person_dialogue_simple' WHEN num_cast >= 3 THEN 'multi_person' ELSE 'unknown' END AS stage_type, 'pending' AS process_status
FROM v_shot JOIN n USING (conv_id)""")
def manifest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shotlens.plans.manifest import manifest

    s = shots(spark, sf_dir)
    cast = s.groupBy("conv_id").agg(F.count_distinct("voice").alias("num_cast"))
    item = F.struct("shot_idx", F.col("start_sec").cast("double").alias("shot_start_time"), F.col("end_sec").cast("double").alias("shot_end_time"), F.col("text").alias("subtitle_text"), "num_cast")
    packages = s.join(cast, "conv_id").groupBy(F.col("conv_id").alias("sequence_id")).agg(F.collect_list(item).alias("shots"))
    return manifest(packages).select("sequence_id", "shot_id", "shot_idx", "duration", "stage_type", "process_status")


@query("shot_track_filter", """
SELECT event_id, user_id, event_type FROM events WHERE event_type IN ('view', 'click') AND user_id IN (1, 2, 3, 5, 8, 13, 21, 34) AND value >= 1.0 ORDER BY event_id LIMIT 40""")
def shot_track_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shotlens.plans.manifest import select_rows

    e = table(spark, sf_dir, "events")
    return select_rows(e, {"event_type": ["view", "click"], "user_id": [1, 2, 3, 5, 8, 13, 21, 34]}, {"value": 1.0}, order="event_id", head=40).select("event_id", "user_id", "event_type")


_PAIRS = f"""{V_SHOT}, n AS (SELECT conv_id, shot_idx, trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9]', ' ', 'g'), ' +', ' ', 'g')) AS norm FROM v_shot),
w AS (SELECT conv_id, shot_idx, list_filter(string_split(norm, ' '), lambda x: x <> '') AS ws FROM n),
p AS (SELECT a.conv_id, a.shot_idx, a.ws AS x, b.ws AS y FROM w a JOIN w b ON a.conv_id = b.conv_id AND b.shot_idx = a.shot_idx + 1),
o AS (SELECT conv_id, shot_idx, CAST(len(list_intersect(list_distinct(x), list_distinct(y))) AS DOUBLE) AS k, len(list_distinct(x)) AS dx, len(list_distinct(y)) AS dy, len(x) AS nx, len(y) AS ny FROM p),
s AS (SELECT conv_id, shot_idx, CASE WHEN k > 0 THEN 0.50 * (k / dx) + 0.35 * (2 * (k / dx) * (k / dy) / ((k / dx) + (k / dy))) + 0.15 * (CAST(least(nx, ny) AS DOUBLE) / greatest(nx, ny)) ELSE 0 END AS score FROM o)"""


def _pair_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = shots(spark, sf_dir)
    norm = F.trim(F.regexp_replace(F.regexp_replace(F.lower("text"), "[^a-z0-9]", " "), " +", " "))
    w = s.select("conv_id", "shot_idx", tokens(norm).alias("x")).withColumn("y", F.lead("x").over(Window.partitionBy("conv_id").orderBy("shot_idx"))).where("y IS NOT NULL")
    return w.select("conv_id", "shot_idx", token_score(F.col("x"), F.col("y"))["score"].alias("score"))


@query("token_span_score", f"WITH {_PAIRS} SELECT conv_id, shot_idx, round(score, 4) AS score FROM s")
def token_span_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pair_scores(spark, sf_dir).select("conv_id", "shot_idx", F.round("score", 4).alias("score"))


@query("match_summary", f"WITH {_PAIRS} SELECT count(*) AS n_steps, count(*) FILTER (WHERE score >= 0.10) AS n_confident, round(avg(score) FILTER (WHERE score >= 0.10), 4) AS mean_confident FROM s")
def match_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shotlens.plans.context import match_summary as summary

    return summary(_pair_scores(spark, sf_dir), "score", 0.10)


@query("stage_type_case", f"""WITH {V_SHOT}, n AS (SELECT conv_id, count(DISTINCT voice) AS num_cast, max(trim(text)) AS t FROM v_shot GROUP BY conv_id)
SELECT CASE WHEN num_cast <= 1 AND t <> '' THEN 'single_speaking' WHEN num_cast = 2 AND t <> '' THEN 'two_person_dialogue_simple' WHEN num_cast >= 3 THEN 'multi_person' ELSE 'unknown' END AS stage_type, count(*) AS n FROM n GROUP BY 1""")
def stage_type_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = shots(spark, sf_dir).groupBy("conv_id").agg(F.count_distinct("voice").alias("num_cast"), F.max(F.trim("text")).alias("t"))
    return n.groupBy(stage_type(F.col("num_cast"), F.col("t")).alias("stage_type")).agg(F.count("*").alias("n"))


@query("repair_candidates", f"WITH {V_SHOT} SELECT conv_id, shot_idx, text AS subtitle_text, 'unmatched_or_low_confidence' AS repair_reason FROM v_shot s WHERE NOT EXISTS (SELECT 1 FROM v_shot m WHERE m.conv_id = s.conv_id AND m.shot_idx = s.shot_idx AND m.voice = 0)")
def repair_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = shots(spark, sf_dir).withColumn("match_source", F.when(F.col("voice") == 0, "raw_dp").otherwise("")).withColumn("subtitle_text", F.col("text"))
    return repair_rows(s).select("conv_id", "shot_idx", "subtitle_text", "repair_reason")


@query("text_normalize", """
SELECT doc_id, trim(regexp_replace(regexp_replace(replace(replace(lower(text), '...', ' '), '--', ' '), '[^a-z0-9'' ]', ' ', 'g'), ' +', ' ', 'g')) AS norm
FROM (SELECT doc_id, regexp_replace(regexp_replace(text, '\\[[^\\]]*\\]', ' ', 'g'), ':', ';', 'g') AS text FROM documents)""")
def text_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.normalize_for_match(F.replace("text", F.lit(":"), F.lit(";"))).alias("norm"))


@query("line_classify", None)
def line_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of each line class in documents, indented and capitalised so that all classes occur (no SQL twin: RE2 has no
    Unicode word boundary; tests hold the classes against hand-made lines)."""
    parts = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "part"))
    pad = F.expr("repeat(' ', cast(doc_id % 12 as int))")
    line = F.concat(pad, F.when(F.col("i") % 3 == 2, F.upper("part")).otherwise(F.col("part")))
    return parts.groupBy(T.line_class(line).alias("kind")).agg(F.count("*").alias("n"))


@query("dialogue_segments", f"""WITH {V_LINE},
g AS (SELECT *, sum(CAST(kind = 'S' AS INT)) OVER (PARTITION BY doc_id ORDER BY line_no) AS g FROM v_line),
o AS (SELECT *, sum(CAST(kind IN ('O', 'B') AS INT)) OVER (PARTITION BY doc_id, g ORDER BY line_no) AS o FROM g WHERE g > 0),
s AS (SELECT doc_id, g, min(line_no) FILTER (WHERE kind = 'D' AND o = 0) AS start_line, coalesce(min(line_no) FILTER (WHERE kind IN ('O', 'B')) - 1, max(line_no)) AS end_line,
  string_agg(trim(line), ' ' ORDER BY line_no) FILTER (WHERE kind = 'D' AND o = 0) AS dialogue FROM o GROUP BY doc_id, g)
SELECT doc_id, CAST(start_line AS BIGINT) AS start_line, CAST(end_line AS BIGINT) AS end_line, md5(dialogue) AS dialogue_md5, row_number() OVER (PARTITION BY doc_id ORDER BY start_line) - 1 AS segment_idx FROM s WHERE start_line IS NOT NULL""")
def dialogue_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = speeches(lines(spark, sf_dir), ["doc_id"])
    return s.select("doc_id", F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"), F.md5("dialogue").alias("dialogue_md5"), F.col("segment_idx").cast("long").alias("segment_idx"))


@query("other_chunks", f"""WITH {V_LINE},
g AS (SELECT *, sum(CAST(kind IN ('S', 'N', 'B') AS INT)) OVER (PARTITION BY doc_id ORDER BY line_no) AS g FROM v_line),
x AS (SELECT *, max(CAST(kind = 'S' AS INT)) OVER (PARTITION BY doc_id, g) AS sp, sum(CAST(kind = 'O' AS INT)) OVER (PARTITION BY doc_id, g ORDER BY line_no) AS o FROM g),
c AS (SELECT doc_id, g, min(line_no) AS start_line, max(line_no) AS end_line, string_agg(trim(line), chr(10) ORDER BY line_no) AS t FROM x WHERE kind IN ('D', 'O') AND (sp = 0 OR o > 0) GROUP BY doc_id, g)
SELECT doc_id, CAST(start_line AS BIGINT) AS start_line, CAST(end_line AS BIGINT) AS end_line, md5(t) AS other_md5, row_number() OVER (PARTITION BY doc_id ORDER BY start_line) - 1 AS other_idx FROM c""")
def other_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = action_chunks(lines(spark, sf_dir), ["doc_id"])
    return c.select("doc_id", F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"), F.md5("other_text").alias("other_md5"), F.col("other_idx").cast("long").alias("other_idx"))


def _lines_view(spark: SparkSession, sf_dir: str) -> str:
    register(spark)
    lines(spark, sf_dir).createOrReplaceTempView("shotlens_lines")
    return "shotlens_lines"


# The two parsers as table functions, against the same SQL.
@query("speech_function", Q["dialogue_segments"][1])
def speech_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(f"SELECT doc_id, start_line, end_line, md5(dialogue) AS dialogue_md5, segment_idx FROM speeches(TABLE({_lines_view(spark, sf_dir)}), 'doc_id')")


@query("chunk_function", Q["other_chunks"][1])
def chunk_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(f"SELECT doc_id, start_line, end_line, md5(other_text) AS other_md5, other_idx FROM action_chunks(TABLE({_lines_view(spark, sf_dir)}), 'doc_id')")


# Labels before what is said, and notes in it; ASCII only, where both engines have the same word boundaries.
_SAID = "regexp_replace(CASE turn % 3 WHEN 0 THEN upper(role) || ': ' || text WHEN 1 THEN '[aside] MRS O''NEIL-' || upper(role) || ' II:' || text || ' Ends a: B -- so...' ELSE text || ' A: x' END, '[^\\x00-\\x7F]', ' ', 'g')"


@query("name_labels", f"""
SELECT conv_id, turn, trim(regexp_replace(regexp_replace(replace(replace(lower(regexp_replace(regexp_replace({_SAID}, '\\[[^\\]]*\\]', ' ', 'g'), '\\b[A-Z][A-Z''\\-\\s]{{1,25}}:\\s*', ' ', 'g')), '...', ' '), '--', ' '), '[^a-z0-9\\s'']', ' ', 'g'), '\\s+', ' ', 'g')) AS norm FROM conversations""")
def name_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, label, text = F.col("turn") % 3, F.upper("role"), F.col("text")
    said = F.when(k == 0, F.concat(label, F.lit(": "), text)).when(k == 1, F.concat(F.lit("[aside] MRS O'NEIL-"), label, F.lit(" II:"), text, F.lit(" Ends a: B -- so..."))).otherwise(F.concat(text, F.lit(" A: x")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.normalize_for_match(F.regexp_replace(said, r"[^\x00-\x7F]", " ")).alias("norm"))


_ACTS = ("The camera pans as she looks down.", "He TURNS TO the door, then walks out; close-up of his eyes.", "MCU: they back away and sit. WIDE SHOT", "nobody overlooks the angled track")
_CUED = "regexp_replace(text, '[^\\x00-\\x7F]', ' ', 'g') || CASE doc_id % 5 " + " ".join(f"WHEN {i} THEN chr(10) || '{a}'" for i, a in enumerate(_ACTS)) + " ELSE '' END"
_CUES = ", ".join(f"CAST(len(regexp_extract_all(t, '(?i)\\b(?:{'|'.join(words)})\\b')) AS BIGINT) AS {name}" for name, words in (("camera", T.CAMERA_CUES), ("gaze", T.GAZE_CUES), ("movement", T.MOVEMENT_CUES)))


# The cue lists that the engine itself uses, in whole documents with some lines of action.
@query("visual_cues", f"""WITH d AS (SELECT doc_id, {_CUED} AS t FROM documents), c AS (SELECT doc_id, t, {_CUES} FROM d)
SELECT doc_id, camera, gaze, movement, round_even(least(10, camera + gaze * 1.5 + movement * 0.75 + least(length(t) / 240.0, 2)), 3) AS score FROM c""")
def visual_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    act = F.lit("")
    for i, a in enumerate(_ACTS):
        act = F.when(F.col("doc_id") % 5 == i, F.lit("\n" + a)).otherwise(act)
    d = table(spark, sf_dir, "documents").select("doc_id", T.visual_cues(F.concat(F.regexp_replace("text", r"[^\x00-\x7F]", " "), act)).alias("c"))
    return d.select("doc_id", F.col("c.camera_cue_count").cast("long").alias("camera"), F.col("c.gaze_verb_count").cast("long").alias("gaze"), F.col("c.movement_cue_count").cast("long").alias("movement"), F.col("c.visual_action_score").alias("score"))


@query("cue_counts", """
WITH d AS (SELECT doc_id, ' ' || regexp_replace(lower(text), '[^a-z]+', '  ', 'g') || ' ' AS t FROM documents)
SELECT doc_id, len(regexp_extract_all(t, ' (sees?|eyes?|looks?|turns? to) ')) AS gaze, len(regexp_extract_all(t, ' (enters?|exits?|runs?|sits?|stands?) ')) AS movement, substr(t, 1, 347) AS head FROM d""")
def cue_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit(" "), F.regexp_replace(F.lower("text"), "[^a-z]+", "  "), F.lit(" ")).alias("t"))
    return d.select("doc_id", T.cue_count(F.col("t"), ("sees?", "eyes?", "looks?", "turns? to")).cast("long").alias("gaze"), T.cue_count(F.col("t"), ("enters?", "exits?", "runs?", "sits?", "stands?")).cast("long").alias("movement"), F.substring("t", 1, 347).alias("head"))


@query("speaker_slug", """
SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_name || ' (V.O.)' ELSE p_name END AS raw, p_name AS speaker, upper(p_name) AS target, trim(regexp_replace(upper(p_name || '/' || p_type), '[^A-Z0-9]+', ' ', 'g')) AS name_norm, regexp_replace(upper(p_name || p_brand), '[^A-Z0-9]', '', 'g') AS label,
       regexp_replace(p_name, '[^A-Za-z0-9_-]+', '_', 'g') AS slug FROM part""")
def speaker_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").withColumn("raw", F.when(F.col("p_partkey") % 2 == 0, F.concat("p_name", F.lit(" (V.O.)"))).otherwise(F.col("p_name")))
    return p.select("p_partkey", "raw", T.clean_speaker_name(F.col("raw")).alias("speaker"), T.target_name(F.col("p_name")).alias("target"), T.normalize_name(F.concat_ws("/", "p_name", "p_type")).alias("name_norm"), T.normalize_label(F.concat("p_name", "p_brand")).alias("label"), T.slug(F.col("p_name")).alias("slug"))


@query("jsonish_parse", """
SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN [p_name, p_brand] WHEN 1 THEN [p_name] WHEN 2 THEN [p_name, p_type] WHEN 3 THEN [p_name] ELSE [] END AS items, CASE WHEN p_partkey % 5 = 2 THEN [p_name, p_type] ELSE [p_brand] END AS cells FROM part""")
def jsonish_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey") % 5
    raw = F.when(k == 0, F.to_json(F.array("p_name", "p_brand"))).when(k == 1, F.concat(F.lit("['"), "p_name", F.lit("']"))).when(k == 2, F.concat("p_name", F.lit(" | "), "p_type")).when(k == 3, F.col("p_name")).otherwise(F.lit("  "))
    cell = F.when(k == 2, F.concat("p_name", F.lit("||"), "p_type")).otherwise(F.to_json(F.array("p_brand", F.lit(" "))))
    return p.select("p_partkey", parse_list(raw).alias("items"), parse_cell(cell).alias("cells"))


@query("hms_format", f"""WITH {V_SHOT}
SELECT conv_id, shot_idx, printf('%02d:%02d:%02d.000', CAST(start_sec // 3600 AS INT), CAST((start_sec // 60) % 60 AS INT), CAST(start_sec % 60 AS INT)) AS start_hms, CAST(start_sec AS DOUBLE) AS back, CAST(greatest(0, end_sec - start_sec) AS DOUBLE) AS duration FROM v_shot""")
def hms_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = shots(spark, sf_dir).withColumn("start_hms", C.sec_to_hms(F.col("start_sec")))
    return s.select("conv_id", "shot_idx", "start_hms", C.hms_to_sec(F.col("start_hms")).alias("back"), C.duration(F.col("start_sec"), F.col("end_sec")).alias("duration"))


@query("safe_numeric", """
WITH m AS (SELECT event_id, CASE WHEN event_id % 4 = 0 THEN event_type WHEN event_id % 4 = 1 THEN 'nan' WHEN event_id % 4 = 2 THEN CAST(value / 1000 AS VARCHAR) ELSE CAST(json_extract(props, '$.k') AS VARCHAR) END AS raw FROM events),
n AS (SELECT event_id, TRY_CAST(raw AS DOUBLE) AS x FROM m)
SELECT event_id, CASE WHEN x IS NULL OR isnan(x) THEN -1 ELSE x END AS safe, CASE WHEN x IS NULL OR isnan(x) OR isinf(x) THEN NULL ELSE x END AS finite,
       CASE WHEN x IS NULL OR isnan(x) THEN 'unknown' WHEN x < -0.2 THEN 'left' WHEN x > 0.2 THEN 'right' ELSE 'center' END AS bucket FROM n""")
def safe_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 4
    e = table(spark, sf_dir, "events").select("event_id", F.when(k == 0, F.col("event_type")).when(k == 1, "nan").when(k == 2, (F.col("value") / 1000).cast("string")).otherwise(F.get_json_object("props", "$.k")).alias("raw"))
    return e.select("event_id", safe_float(F.col("raw"), -1.0).alias("safe"), finite_float(F.col("raw")).alias("finite"), direction_bucket(F.col("raw"), 0.2).alias("bucket"))


@query("span_alignment", None)
def span_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns against the same turns without every third (no SQL twin: a two-dimensional recurrence; tests use brute force)."""
    s = shots(spark, sf_dir)
    return align(s.select("conv_id", "shot_idx", "text"), s.where("shot_idx % 3 <> 2").select("conv_id", "shot_idx", "text"), ["conv_id"], "shot_idx", "text", "text")


@query("context_overlay", f"""WITH {V_SHOT}, r AS (SELECT conv_id, shot_idx AS lo, shot_idx + 1 AS hi, text AS dialogue FROM v_shot WHERE shot_idx % 3 = 0)
SELECT s.conv_id, s.shot_idx, r.lo AS block_start, r.dialogue, CASE WHEN r.lo IS NULL THEN '' ELSE 'raw_dp' END AS match_source FROM v_shot s LEFT JOIN r ON r.conv_id = s.conv_id AND s.shot_idx BETWEEN r.lo AND r.hi""")
def context_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = shots(spark, sf_dir)
    steps = s.where("shot_idx % 3 = 0").select("conv_id", F.col("shot_idx").alias("lo"), (F.col("shot_idx") + 1).alias("hi"), F.col("shot_idx").alias("block_start"), F.col("text").alias("dialogue"))
    out = overlay(s.select("conv_id", "shot_idx"), steps, ["conv_id"], "shot_idx", "lo", "hi", ["block_start", "dialogue"], "block_start")
    return out.withColumn("match_source", F.when(F.col("block_start").isNull(), "").otherwise("raw_dp"))


@query("range_collect", f"""WITH {V_SHOT}, q AS (SELECT conv_id, shot_idx AS lo, shot_idx + 2 AS hi FROM v_shot WHERE shot_idx % 2 = 0)
SELECT q.conv_id, q.lo, q.hi, list(s.shot_idx ORDER BY s.shot_idx) AS shots, list(s.role ORDER BY s.shot_idx) AS roles FROM q JOIN v_shot s ON s.conv_id = q.conv_id AND s.shot_idx BETWEEN q.lo AND q.hi GROUP BY ALL""")
def range_collect(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = shots(spark, sf_dir)
    ranges = s.where("shot_idx % 2 = 0").select("conv_id", F.col("shot_idx").alias("lo"), (F.col("shot_idx") + 2).alias("hi"))
    out = collect_range(ranges, s.select("conv_id", "shot_idx", "role"), ["conv_id"], "shot_idx", "lo", "hi", ["role"], "found")
    return out.select("conv_id", "lo", "hi", F.col("found.shot_idx").alias("shots"), F.col("found.role").alias("roles"))


@query("anchor_range", f"""WITH {V_SHOT}, a AS (SELECT conv_id, shot_idx, CASE WHEN shot_idx % 4 = 1 AND conv_id % 3 <> 0 THEN shot_idx * 2 END AS anchor, CAST(40 AS BIGINT) AS n FROM v_shot),
w AS (SELECT *, last_value(anchor IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY shot_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b,
  first_value(anchor IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY shot_idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS f, count(anchor) OVER (PARTITION BY conv_id) AS c,
  row_number() OVER (PARTITION BY conv_id ORDER BY shot_idx) - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS m FROM a)
SELECT conv_id, shot_idx, CAST(greatest(0, CASE WHEN c = 0 THEN round_even(i / greatest(m - 1, 1) * (n - 1), 0) - 8 WHEN b IS NOT NULL THEN b - 8 WHEN f IS NOT NULL THEN f - 8 ELSE 0 END) AS BIGINT) AS range_low,
  CAST(least(n - 1, CASE WHEN c = 0 THEN round_even(i / greatest(m - 1, 1) * (n - 1), 0) + 8 WHEN b IS NOT NULL AND f IS NOT NULL AND b <= f THEN f + 8 WHEN b IS NOT NULL THEN b + 8 WHEN f IS NOT NULL THEN f + 8 ELSE 16 END) AS BIGINT) AS range_high FROM w""")
def anchor_range_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = shots(spark, sf_dir).select("conv_id", "shot_idx", F.when((F.col("shot_idx") % 4 == 1) & (F.col("conv_id") % 3 != 0), F.col("shot_idx") * 2).alias("anchor"), F.lit(40).cast("long").alias("n"))
    return anchor_range(s, ["conv_id"], "shot_idx", "anchor", "n").select("conv_id", "shot_idx", "range_low", "range_high")


@query("llm_tasks", f"""WITH {V_SHOT}, t AS (SELECT conv_id, role, string_agg(CAST(shot_idx AS VARCHAR), ',' ORDER BY shot_idx) AS shots FROM v_shot GROUP BY ALL),
k AS (SELECT conv_id, role, sha256(CAST(length(CAST(conv_id AS VARCHAR)) AS VARCHAR) || ':' || conv_id || '|' || length(role) || ':' || role || '|' || length(shots) || ':' || shots) AS cache_key FROM t)
SELECT conv_id, role, cache_key FROM k WHERE conv_id % 5 <> 0""")
def llm_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shotlens.plans.llm import cache_misses

    s = shots(spark, sf_dir).groupBy("conv_id", "role").agg(F.array_join(F.transform(F.sort_array(F.collect_list("shot_idx")), lambda x: x.cast("string")), ",").alias("shots"))
    tasks = s.select("conv_id", "role", stable_key(F.col("conv_id"), F.col("role"), F.col("shots")).alias("cache_key"))
    cached = tasks.where("conv_id % 5 = 0").select("cache_key")
    return cache_misses(tasks, cached)


@query("llm_apply", f"""WITH {V_SHOT}
SELECT conv_id, shot_idx, CASE WHEN ok THEN role ELSE '' END AS speaker, CASE WHEN ok THEN 'llm_local_fill' ELSE '' END AS match_source, CASE WHEN ok THEN round(conf / 100.0, 4) ELSE 0.0 END AS match_score
FROM (SELECT *, CAST(dur % 101 AS DOUBLE) AS conf, voice = 1 AND dur % 101 >= 60 AS ok FROM v_shot)""")
def llm_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shotlens.plans.llm import apply_answers

    s = shots(spark, sf_dir)
    rows = s.select("conv_id", "shot_idx", F.lit("").alias("match_source"), F.lit(0.0).alias("match_score"), F.lit("").alias("speaker"), F.col("text").alias("subtitle_text"))
    answers = s.select("conv_id", "shot_idx", (F.col("voice") == 1).alias("match"), F.col("shot_idx").alias("segment_idx"), (F.col("dur") % 101).cast("double").alias("confidence"))
    dialogue = s.select("conv_id", F.col("shot_idx").alias("segment_idx"), F.col("role").alias("speaker"), F.col("text").alias("dialogue"))
    return apply_answers(rows, answers, dialogue, ["conv_id"], "shot_idx", 0.60).select("conv_id", "shot_idx", "speaker", "match_source", "match_score")


@query("llm_validate", """
WITH e AS (SELECT event_id, user_id, event_type, CAST(json_extract(props, '$.k') AS INT) AS k FROM events)
SELECT user_id, CAST(sum(CASE WHEN k % 5 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS bad_shot, CAST(sum(CASE WHEN k - 20 <= 0 THEN 1 ELSE 0 END) AS BIGINT) AS bad_ratio, CAST(sum(CASE WHEN event_type NOT IN ('view', 'click') THEN 1 ELSE 0 END) AS BIGINT) AS bad_intent FROM e GROUP BY user_id""")
def llm_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shotlens.plans.llm import ANSWER, parse_answer, warnings

    k = F.get_json_object("props", "$.k").cast("int")
    event = F.struct(F.when(k % 5 == 0, "nowhere").otherwise(F.concat(F.lit("s"), k.cast("string"))).alias("shot_id"), (k - 20).cast("string").alias("duration_ratio"), F.col("event_type").alias("gaze_intent"))
    answers = table(spark, sf_dir, "events").groupBy("user_id").agg(F.concat(F.lit("```json\n"), F.to_json(F.struct(F.sort_array(F.collect_list(event)).alias("events"))), F.lit("\n```")).alias("answer"))
    parsed = answers.select("user_id", parse_answer(F.col("answer")).alias("p"))
    valid = F.transform(F.sequence(F.lit(0), F.lit(99)), lambda i: F.concat(F.lit("s"), i.cast("string")))
    w = parsed.select("user_id", warnings(F.col("p.events"), valid, ["view", "click"]).alias("w"))
    n = lambda part: F.size(F.filter("w", lambda x: F.contains(x, F.lit(part)))).cast("long")
    assert ANSWER
    return w.select("user_id", n("invalid shot_id").alias("bad_shot"), n("non-positive").alias("bad_ratio"), n("unknown gaze_intent").alias("bad_intent"))


