"""Boxes, tracks, bins, identities, targets and reports."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shotlens.catalog.views import V_BOX, V_FRAME, V_SHOT, boxes, frames, shots, table
from shotlens.functions.angles import bin_angle
from shotlens.functions.geometry import body_score, box, centre_distance, cosine, dot, iou, unit
from shotlens.functions.numeric import direction_bucket
from shotlens.operators.folds import greedy_pairs
from shotlens.operators.gallery import nearest_two
from shotlens.operators.interval import contained
from shotlens.operators.places import tasks_for
from shotlens.operators.sampling import bucket_sample, quotas
from shotlens.operators.similarity import best_match, mean_unit
from shotlens.operators.tracking import TrackRules, track_boxes
from shotlens.plans import qa, targets, tracks
from shotlens.plans.identity import cascade
from shotlens.runners import run_gaze
from shotlens.session import materialise

Q: dict = {}


def query(name: str, sql: str | None):
    def add(f):
        Q[name] = (f, sql)
        return f

    return add


_IOU = "greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1))"


@query("box_iou_self_join", f"""WITH {V_FRAME}, {V_BOX}
SELECT a.event_id AS a_id, b.event_id AS b_id, round({_IOU} / (7200 - {_IOU}), 6) AS iou, round(sqrt((a.x1 - b.x1) ** 2 + (a.y1 - b.y1) ** 2) / sqrt(640.0 ** 2 + 360.0 ** 2), 6) AS centre
FROM v_box a JOIN v_box b ON a.shot = b.shot AND b.frame = a.frame + 1""")
def box_iou_self_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = boxes(spark, sf_dir).select("shot", "frame", "event_id", box(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")).alias("b"))
    a = v.select("shot", (F.col("frame") + 1).alias("frame"), F.col("event_id").alias("a_id"), F.col("b").alias("a"))
    j = a.join(v.select("shot", "frame", F.col("event_id").alias("b_id"), "b"), ["shot", "frame"])
    return j.select("a_id", "b_id", F.round(iou(F.col("a"), F.col("b")), 6).alias("iou"), F.round(centre_distance(F.col("a"), F.col("b"), F.lit(640), F.lit(360)), 6).alias("centre"))


_BODY = """b AS (SELECT shot, frame, event_id, x1, y1, x2, y2, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy FROM v_box WHERE det = 0),
o AS (SELECT shot, frame, event_id AS body_id, x1 - 50 AS x1, y1 - 20 AS y1, x2 + 50 AS x2, y2 + 180 AS y2 FROM v_box WHERE det = 1),
s AS (SELECT b.shot, b.frame, b.event_id AS face_id, o.body_id, least(1, greatest(0, 0.45 * CAST(cx BETWEEN o.x1 AND o.x2 AND cy BETWEEN o.y1 AND o.y2 AS INT) + 0.20 * CAST(cx BETWEEN o.x1 AND o.x2 AND cy BETWEEN o.y1 AND o.y1 + (o.y2 - o.y1) * 0.62 AS INT)
  + 0.20 * greatest(0, least(b.x2, o.x2) - greatest(b.x1, o.x1)) / 60 + 0.15 * greatest(0, 1 - 0.5 * abs(cx - (o.x1 + o.x2) / 2) / ((o.x2 - o.x1) / 2) - 0.5 * abs(cy - (o.y1 + (o.y2 - o.y1) * 0.25)) / ((o.y2 - o.y1) * 0.35)))) AS score
  FROM b JOIN o ON b.shot = o.shot AND o.frame BETWEEN b.frame AND b.frame + 1)"""


def _body(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = boxes(spark, sf_dir)
    face = v.where("det = 0").select("shot", "frame", F.col("event_id").alias("face_id"), box(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")).alias("face"), F.explode(F.array(F.col("frame"), F.col("frame") + 1)).alias("body_frame"))
    body = v.where("det = 1").select("shot", F.col("frame").alias("body_frame"), F.col("event_id").alias("body_id"), box(F.col("x1") - 50, F.col("y1") - 20, F.col("x2") + 50, F.col("y2") + 180).alias("body"))
    return face.join(body, ["shot", "body_frame"]).select("shot", "frame", "face_id", "body_id", body_score(F.col("face"), F.col("body")).alias("score"))


@query("body_match_score", f"WITH {V_FRAME}, {V_BOX}, {_BODY} SELECT face_id, body_id, round(score, 5) AS score FROM s")
def body_match_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _body(spark, sf_dir).select("face_id", "body_id", F.round("score", 5).alias("score"))


@query("greedy_bipartite", f"""WITH RECURSIVE {V_FRAME}, {V_BOX}, {_BODY}, z AS (SELECT shot, face_id, body_id, row_number() OVER (PARTITION BY shot ORDER BY round(score, 6) DESC, face_id, body_id) AS i FROM s WHERE score >= 0.4),
t(shot, i, faces, bodies) AS (SELECT shot, 0::BIGINT, []::BIGINT[], []::BIGINT[] FROM (SELECT DISTINCT shot FROM z)
  UNION ALL SELECT t.shot, z.i, CASE WHEN list_contains(t.faces, z.face_id) OR list_contains(t.bodies, z.body_id) THEN t.faces ELSE list_append(t.faces, z.face_id) END, CASE WHEN list_contains(t.faces, z.face_id) OR list_contains(t.bodies, z.body_id) THEN t.bodies ELSE list_append(t.bodies, z.body_id) END
  FROM t JOIN z ON z.shot = t.shot AND z.i = t.i + 1), l AS (SELECT shot, max_by(faces, i) AS faces, max_by(bodies, i) AS bodies FROM t GROUP BY shot)
SELECT unnest(faces) AS face_id, unnest(bodies) AS body_id FROM l""")
def greedy_bipartite(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _body(spark, sf_dir).where("score >= 0.4").withColumn("score", F.round("score", 6))
    return greedy_pairs(pairs, ["shot"], [-F.col("score"), F.col("face_id"), F.col("body_id")], "face_id", "body_id").select("face_id", "body_id")


@query("cosine_top2_margin", """
WITH g AS (SELECT label, min_by(embedding, vec_id) AS gv, min(vec_id) AS proto FROM embeddings GROUP BY label),
s AS (SELECT e.vec_id, g.label, g.proto, list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(g.gv AS DOUBLE[])) AS score FROM embeddings e, g),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, proto DESC) AS i FROM s)
SELECT vec_id, round(max(score) FILTER (WHERE i = 1), 4) AS top_score, round(max(score) FILTER (WHERE i = 2), 4) AS second_score, CASE WHEN max(score) FILTER (WHERE i = 1) >= 0.2 AND max(score) FILTER (WHERE i = 1) - max(score) FILTER (WHERE i = 2) >= 0.05 THEN max(label) FILTER (WHERE i = 1) END AS label FROM r GROUP BY vec_id""")
def cosine_top2_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    g = e.groupBy("label").agg(F.min("vec_id").alias("proto"), F.min_by("embedding", "vec_id").alias("embedding"))
    m = best_match(e.select("vec_id", "embedding"), g, "vec_id", "embedding", "proto", "label", 0.2, 0.05)
    return m.select("vec_id", F.round("top_score", 4).alias("top_score"), F.round("second_score", 4).alias("second_score"), "label")


# Every vector against a quarter of the table, less one label that differs from vector to vector.
@query("gallery_search", """
WITH g AS (SELECT label, vec_id AS proto, embedding AS gv FROM embeddings WHERE vec_id % 4 = 0),
s AS (SELECT e.vec_id, g.label, g.proto, list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(g.gv AS DOUBLE[])) AS score FROM embeddings e JOIN g ON g.label <> e.label % 3),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, proto DESC) AS i FROM s)
SELECT vec_id, round(max(score) FILTER (WHERE i = 1), 4) AS top_score, round(max(score) FILTER (WHERE i = 2), 4) AS second_score, CASE WHEN max(score) FILTER (WHERE i = 1) >= 0.2 AND max(score) FILTER (WHERE i = 1) - max(score) FILTER (WHERE i = 2) >= 0.001 THEN max(label) FILTER (WHERE i = 1) END AS label FROM r GROUP BY vec_id""")
def gallery_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two nearest of a gallery by pivots and rings; each vector may match some labels only."""
    e = table(spark, sf_dir, "embeddings").withColumn("label", F.col("label").cast("string"))
    g = e.where("vec_id % 4 = 0").select(F.col("vec_id").alias("proto"), "label", "embedding")
    labels = g.agg(F.sort_array(F.collect_set("label")).alias("every"))  # one row
    q = e.crossJoin(F.broadcast(labels)).select("vec_id", "embedding", F.filter("every", lambda x: x != (F.col("label").cast("int") % 3).cast("string")).alias("may"))
    m = nearest_two(q, g, "vec_id", "embedding", "proto", "label", 0.2, 0.001, allow="may")
    return m.select("vec_id", F.round("top_score", 4).alias("top_score"), F.round("second_score", 4).alias("second_score"), F.col("label").cast("int").alias("label"))


@query("centroid_renorm", """
WITH u AS (SELECT label, vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])))) AS v, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS r FROM embeddings),
d AS (SELECT label, i, avg(v[i]) AS m FROM u, unnest(range(1, 65)) t(i) WHERE r <= 8 GROUP BY ALL), n AS (SELECT label, sqrt(sum(m * m)) AS n FROM d GROUP BY label)
SELECT label, round(sum(CASE WHEN i <= 3 THEN m / n ELSE 0 END), 5) AS head_sum, round(sum((m / n) * (m / n)), 5) AS norm2, 8 AS crop_count FROM d JOIN n USING (label) GROUP BY label""")
def centroid_renorm(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = mean_unit(table(spark, sf_dir, "embeddings"), ["label"], "embedding", ["vec_id"], 8)
    v = F.col("embedding")
    return c.select("label", F.round(v[0] + v[1] + v[2], 5).alias("head_sum"), F.round(dot(v, v), 5).alias("norm2"), F.col("crop_count").cast("int").alias("crop_count"))


@query("time_containment", f"""WITH {V_FRAME}, b AS (SELECT DISTINCT stream, CAST(floor(t / 86400) AS BIGINT) AS d FROM v_frame WHERE kind = 'purchase'), r AS (SELECT stream, d * 86400 AS lo, d * 86400 + 43200 AS hi FROM b)
SELECT r.stream, CAST(r.lo AS DOUBLE) AS lo, count(*) AS n, CAST(sum(k) AS BIGINT) AS k_sum FROM r JOIN v_frame f ON f.stream = r.stream AND f.t >= r.lo AND f.t < r.hi GROUP BY ALL""")
def time_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir).select("stream", "t", "k", "kind")
    r = f.where("kind = 'purchase'").select("stream", (F.floor(F.col("t") / 86400) * 86400).cast("double").alias("lo")).distinct().withColumn("hi", F.col("lo") + 43200)
    return contained(f.drop("kind"), r, ["stream"], "t", "lo", "hi", 86400).groupBy("stream", "lo").agg(F.count("*").alias("n"), F.sum("k").alias("k_sum"))


_BIN = f"""{V_FRAME}, b AS (SELECT stream, CAST(floor(t / 432000) AS BIGINT) AS bin_idx, success = 1 AS v, k % 10 <> 0 AS p, conf, gaze_x, pose_y, k FROM v_frame),
a AS (SELECT stream, bin_idx, count(*) AS n_frames_total, count(*) FILTER (WHERE v) AS n_frames_valid, count(*) FILTER (WHERE p) AS n_pose, avg(conf) FILTER (WHERE v) AS c, median(conf) FILTER (WHERE v) AS m, avg(gaze_x) FILTER (WHERE v) AS gx, stddev_pop(gaze_x) FILTER (WHERE v) AS gs, avg(pose_y) FILTER (WHERE p) AS py, avg(k / 50.0) AS au12, avg(CAST(k % 2 AS DOUBLE)) AS au45 FROM b GROUP BY ALL)"""


def _frames_for_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir)
    pose = F.when(F.col("k") % 10 != 0, F.col("pose_y"))
    return f.select("stream", "event_id", "t", "success", F.col("conf").alias("confidence"), F.col("gaze_x").alias("gaze_angle_x"), pose.alias("pose_Ry"), (F.col("k") / 50.0).alias("AU12_r"), (F.col("k") % 2).cast("double").alias("AU45_c"))


def _bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.time_bins(_frames_for_bins(spark, sf_dir), ["stream"], F.col("t"), tracks.BinRules(width=432_000, digits=7), au_r=["AU12"], au_c=["AU45"], pose=["pose_Ry"], gaze=["gaze_angle_x"], order=["event_id"])


_QUALITY = "CASE WHEN n_frames_valid >= 5 AND n_frames_valid / n_frames_total >= 0.5 AND c >= 0.80 THEN 'gaze_reliable' WHEN n_pose >= 5 AND n_pose / n_frames_total >= 0.5 THEN 'pose_fallback' ELSE 'unknown' END"
_BIN_SQL = f"WITH {_BIN} SELECT stream, bin_idx, n_frames_total, n_frames_valid, round(n_frames_valid / n_frames_total, 7) AS valid_ratio, round(c, 7) AS confidence_mean, round(m, 7) AS confidence_median, round(gx, 7) AS gaze_angle_x_mean, round(gs, 7) AS gaze_angle_x_std, round(py, 7) AS pose_Ry_mean, {_QUALITY} AS gaze_quality FROM a"
_BIN_COLUMNS = ("stream", "bin_idx", "n_frames_total", "n_frames_valid", "valid_ratio", "confidence_mean", "confidence_median", "gaze_angle_x_mean", "gaze_angle_x_std", "pose_Ry_mean", "gaze_quality")


@query("timebin_quality", _BIN_SQL)
def timebin_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bins(spark, sf_dir).select(*_BIN_COLUMNS)


@query("expression_case", f"""WITH {_BIN} SELECT stream, bin_idx, CASE WHEN au12 >= 1.0 THEN 'smile' WHEN au45 >= 0.5 THEN 'blink_or_eyes_closed' ELSE 'neutral_or_unknown' END AS expression_proxy FROM a""")
def expression_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bins(spark, sf_dir).select("stream", "bin_idx", "expression_proxy")


# A seventh of the frames has no time, and some of these no number either: they count by number, at 30 frames a second.
@query("bins_without_times", f"""WITH {V_FRAME}, n AS (SELECT stream, conf, success, CASE WHEN k % 7 <> 0 THEN t WHEN k % 14 = 0 THEN floor(t * 30) / 30 ELSE 0 END + 100 AS sec FROM v_frame)
SELECT stream, CAST(floor(sec / 86400) AS BIGINT) AS bin_idx, count(*) AS n_frames_total, count(*) FILTER (WHERE success = 1) AS n_frames_valid, round(avg(conf) FILTER (WHERE success = 1), 6) AS confidence_mean FROM n GROUP BY ALL""")
def bins_without_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir).select("stream", "success", F.col("conf").alias("confidence"), F.when(F.col("k") % 7 != 0, F.col("t")).alias("timestamp"), F.when(F.col("k") % 2 == 0, F.floor(F.col("t") * 30)).alias("frame"), F.lit(100.0).alias("crop_start_sec"))
    out = tracks.time_bins(f, ["stream"], tracks.shot_time(f), tracks.BinRules(width=86_400), pose=[], gaze=[])
    return out.select("stream", "bin_idx", "n_frames_total", "n_frames_valid", "confidence_mean")


@query("crop_envelope", f"""WITH {V_FRAME}, {V_BOX}, e AS (SELECT shot, det, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2, count(*) AS track_len FROM v_box GROUP BY ALL),
s AS (SELECT *, CAST(round_even(least(greatest(x2 - x1, y2 - y1) * 1.5, 640, 360), 0) AS BIGINT) AS s0 FROM e), c AS (SELECT *, greatest(2, s0 - s0 % 2) AS side FROM s),
p AS (SELECT *, CAST(round_even(greatest(0, least((x1 + x2) / 2 - side / 2.0, 640 - side)), 0) AS BIGINT) AS px, CAST(round_even(greatest(0, least((y1 + y2) / 2 - side / 2.0, 360 - side)), 0) AS BIGINT) AS py FROM c)
SELECT shot, det, track_len, px - px % 2 AS crop_x, py - py % 2 AS crop_y, side AS crop_w, side AS crop_h FROM p""")
def crop_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The crop of every whole track."""
    return tracks.crop_envelope(boxes(spark, sf_dir), ["shot", "det"], F.lit(640), F.lit(360), 0.25).select("shot", "det", "track_len", "crop_x", "crop_y", "crop_w", "crop_h")


@query("greedy_tracker", None)
def greedy_tracker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks of boxes (no SQL twin: a greedy recurrence over frames; tests use hand-made boxes and brute force)."""
    return track_boxes(boxes(spark, sf_dir), ["shot"], "frame", ["x1", "y1", "x2", "y2"], "conf", "event_id", 640, 360, TrackRules(least_length=2)).select("shot", "frame", "event_id", "local_track_id", "track_len", F.round("track_conf", 6).alias("track_conf"))


@query("live_tracker", None)
def live_tracker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tracks of greedy_tracker from a stream of files (no SQL twin: a test holds it against greedy_tracker)."""
    from shotlens.session import shared_dir
    from shotlens.streaming.live import run_to_end
    from shotlens.streaming.tracks import finished_tracks, keyed_state, live_tracks

    b = boxes(spark, sf_dir).withColumn("at", F.timestamp_seconds(F.col("frame") + 1_704_067_200)).select("shot", "at", "frame", "event_id", "x1", "y1", "x2", "y2", "conf")
    source = shared_dir(spark, "boxes")
    b.repartition(8, F.floor(F.col("frame") / 8)).write.parquet(source)  # files in no order of time
    closing = spark.range(1).select(F.lit(-1).cast("long").alias("shot"), F.timestamp_seconds(F.lit(1_904_067_200)).alias("at"), F.lit(10**9).alias("frame"), F.col("id").alias("event_id"), *(F.lit(0.0).alias(c) for c in ("x1", "y1", "x2", "y2", "conf")))
    follow = lambda rows: live_tracks(rows, "shot", "at", "frame", ["x1", "y1", "x2", "y2"], "conf", "event_id", 640, 360, 1000, "30 days", TrackRules(least_length=2))
    with keyed_state(spark):
        sent = run_to_end(spark, source, follow, closing, "live-tracks", files_per_trigger=3)
    out = finished_tracks(sent, "shot", 2)
    return out.select("shot", F.col("frame").cast("int").alias("frame"), F.col("box_id").alias("event_id"), "local_track_id", "track_len", F.round("track_conf", 6).alias("track_conf"))


@query("identity_cascade", """
WITH t AS (SELECT vec_id, label, vec_id % 4 AS shot, 'trk_' || lpad(CAST(vec_id AS VARCHAR), 5, '0') AS local_track_id FROM embeddings),
b AS (SELECT vec_id, 'nm' || label AS pid, round(0.55 + (vec_id % 40) / 100.0, 2) AS score FROM t WHERE vec_id % 3 = 0), g AS (SELECT vec_id, 'nm' || (label + 1) AS pid, round(least(0.95, 0.6 + (vec_id % 50) / 100.0), 2) AS conf FROM t WHERE vec_id % 5 = 0)
SELECT t.vec_id, coalesce(b.pid, g.pid, '') AS cast_pid, round(coalesce(b.score, g.conf, 0), 6) AS identity_confidence, CASE WHEN b.pid IS NOT NULL THEN 'movienet_body_bbox' WHEN g.pid IS NOT NULL THEN 'sface_gallery' ELSE '' END AS identity_source,
  CASE WHEN coalesce(b.pid, g.pid) IS NOT NULL THEN 'linked_pid' ELSE 'unknown' END AS identity_status, CASE WHEN coalesce(b.pid, g.pid) IS NOT NULL THEN 'pid:' || coalesce(b.pid, g.pid) ELSE 'local:' || t.shot || ':' || local_track_id END AS global_person_id
FROM t LEFT JOIN b USING (vec_id) LEFT JOIN g USING (vec_id)""")
def identity_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "embeddings").select("vec_id", "label", (F.col("vec_id") % 4).cast("string").alias("shot_id"), F.concat(F.lit("trk_"), F.lpad(F.col("vec_id").cast("string"), 5, "0")).alias("local_track_id"))
    b = t.where("vec_id % 3 = 0").select("shot_id", "local_track_id", F.concat(F.lit("nm"), "label").alias("pid"), F.round(0.55 + F.col("vec_id") % 40 / 100.0, 2).alias("score"))
    g = t.where("vec_id % 5 = 0").select("shot_id", "local_track_id", F.concat(F.lit("nm"), (F.col("label") + 1).cast("string")).alias("cast_pid"), F.round(F.least(F.lit(0.95), 0.6 + F.col("vec_id") % 50 / 100.0), 2).alias("confidence"))
    s = t.select("shot_id").distinct().withColumn("speakers", F.array(F.lit("A"), F.lit("B")))
    speakers = spark.createDataFrame([], "norm string, pid string, confidence double")
    cast = spark.createDataFrame([], "pid string, cast_name string, character_name string")
    return cascade(t, b, g, s, speakers, cast).select("vec_id", "cast_pid", "identity_confidence", "identity_source", "identity_status", "global_person_id")


def _stage(spark: SparkSession, sf_dir: str):
    """Bins, tracks, identities and shots made of conversations: two tracks a shot, one bin a track. The shots, which all
    four tables come from, and the bins are written once."""
    s = shots(spark, sf_dir)
    seq = s.groupBy("conv_id").agg(F.sort_array(F.collect_set(F.concat(F.lit("P"), F.col("voice").cast("string")))).alias("active_speakers"))
    sh = s.join(seq, "conv_id").select(F.col("conv_id").cast("string").alias("sequence_id"), F.concat_ws("_", F.lit("s"), "conv_id", "shot_idx").alias("shot_id"), "shot_idx", F.when(F.col("dur") % 2 == 0, "single_speaking").otherwise("two_person_dialogue_simple").alias("stage_type"), F.array(F.concat(F.lit("P"), F.col("voice").cast("string"))).alias("aligned_speakers"), "active_speakers", "dur", "voice")
    sh = materialise(spark, sh, "shots")
    t = sh.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("k")).withColumn("local_track_id", F.concat(F.lit("trk_00"), F.col("k").cast("string")))
    tr = t.select("shot_id", "local_track_id", F.lit(0.1).alias("timestamp_sec"), (F.col("dur") * 7 * (F.col("k") + 1) % 100).cast("double").alias("bbox_cx"), F.lit(0.9).alias("track_conf"))
    ident = t.select("shot_id", "local_track_id", F.when((F.col("dur") + F.col("k")) % 3 == 0, F.concat(F.lit("P"), F.col("voice").cast("string"))).otherwise("").alias("cast_pid"), F.lit("").alias("character_name"), F.lit("").alias("cast_name"), F.when((F.col("dur") + F.col("k")) % 3 == 0, 0.8).when((F.col("dur") + F.col("k")) % 3 == 1, 0.5).otherwise(0.0).alias("identity_confidence"), F.lit(0.9).alias("track_conf"), F.lit("unknown").alias("identity_status"))
    ident = ident.withColumn("global_person_id", F.concat_ws(":", F.lit("g"), "shot_id", "local_track_id"))
    bins = t.select("sequence_id", "shot_id", "shot_idx", "local_track_id", F.lit(0).cast("long").alias("bin_idx"), F.lit(0.0).alias("bin_start_sec"), F.lit(0.5).alias("bin_end_sec"), F.when(F.col("dur") % 5 == 0, "unknown").when(F.col("dur") % 5 == 1, "pose_fallback").otherwise("gaze_reliable").alias("gaze_quality"), ((F.col("dur") % 11 - 5) / 10.0).alias("gaze_angle_x_mean"), ((F.col("dur") % 7 - 3) / 10.0).alias("gaze_angle_y_mean"), ((F.col("dur") % 13 - 6) / 10.0).alias("pose_Ry_mean"), F.lit(1.0).alias("valid_ratio"), F.lit(0.9).alias("confidence_mean"))
    return materialise(spark, bins, "bins"), tr, ident, sh  # read from files its constants are columns, by which rows can be dealt


_STAGE = f"""{V_SHOT}, q AS (SELECT conv_id, list_sort(list(DISTINCT 'P' || voice)) AS act FROM v_shot GROUP BY conv_id),
sh AS (SELECT v.*, act, 'P' || voice AS spk, 's_' || v.conv_id || '_' || shot_idx AS shot_id, CASE WHEN dur % 2 = 0 THEN 'single_speaking' ELSE 'two_person_dialogue_simple' END AS stage FROM v_shot v JOIN q USING (conv_id)),
tr AS (SELECT sh.*, k, 'trk_00' || k AS trk, CAST(dur * 7 * (k + 1) % 100 AS DOUBLE) AS cx, CASE WHEN (dur + k) % 3 = 0 THEN spk ELSE '' END AS pid, CASE WHEN (dur + k) % 3 = 0 THEN 0.8 WHEN (dur + k) % 3 = 1 THEN 0.5 ELSE 0.0 END AS conf,
  CASE WHEN dur % 5 = 0 THEN 'unknown' WHEN dur % 5 = 1 THEN 'pose_fallback' ELSE 'gaze_reliable' END AS qual, CASE WHEN dur % 11 - 5 < -2 THEN 'left' WHEN dur % 11 - 5 > 2 THEN 'right' ELSE 'center' END AS gz, dur % 7 - 3 > 2 AS down, CASE WHEN (dur % 13 - 6) / 10.0 < -0.25 THEN 'left' WHEN (dur % 13 - 6) / 10.0 > 0.25 THEN 'right' ELSE 'center' END AS ps FROM sh, unnest([0, 1]) u(k)),
lab AS (SELECT shot_id, list(DISTINCT pid) FILTER (WHERE conf >= 0.6 AND pid <> '') AS labels FROM tr GROUP BY shot_id),
rv AS (SELECT sh.shot_id, list_concat(coalesce(lag(labels) OVER w, []), coalesce(lead(labels) OVER w, [])) AS rev FROM sh JOIN lab USING (shot_id) WINDOW w AS (PARTITION BY conv_id ORDER BY shot_idx)),
c0 AS (SELECT a.*, b.trk AS cid, 'onscreen_local_track' AS ctype, b.conf AS cconf, CASE WHEN b.cx - a.cx < -1 THEN 'left' WHEN b.cx - a.cx > 1 THEN 'right' ELSE 'center' END AS side FROM tr a JOIN tr b ON a.shot_id = b.shot_id AND a.trk <> b.trk
  UNION ALL SELECT tr.*, spk, 'current_speaker', 0.0, 'offscreen' FROM tr UNION ALL SELECT tr.*, unnest(act), 'offscreen_participant', 0.0, 'offscreen' FROM tr
  UNION ALL SELECT tr.*, 'down_self_or_think', 'down_self_or_think', 0.0, 'self' FROM tr UNION ALL SELECT tr.*, 'offscreen_place_or_away', 'offscreen_place_or_away', 0.0, 'offscreen' FROM tr UNION ALL SELECT tr.*, 'unknown', 'unknown', 0.0, 'unknown' FROM tr),
c1 AS (SELECT c0.*, rev, stage = 'single_speaking' AS alone,
  CASE WHEN ctype = 'onscreen_local_track' THEN (CASE WHEN gz = 'center' OR side = 'center' THEN 0.05 WHEN gz = side THEN 0.45 ELSE -0.30 END) + (CASE WHEN stage = 'two_person_dialogue_simple' AND gz <> 'center' AND gz = side THEN 0.15 ELSE 0 END) + (CASE WHEN ps = 'center' OR side = 'center' THEN 0.03 WHEN ps = side THEN 0.25 ELSE -0.15 END) + (CASE WHEN cconf >= 0.6 THEN 0.08 WHEN cconf > 0 THEN -0.04 ELSE 0 END)
       WHEN ctype = 'current_speaker' THEN 0.35 + (CASE WHEN gz <> 'center' THEN 0.10 ELSE 0 END) - (CASE WHEN stage = 'single_speaking' AND pid = cid THEN 0.22 ELSE 0 END)
       WHEN ctype = 'offscreen_participant' THEN 0.20 + (CASE WHEN gz <> 'center' THEN 0.10 ELSE 0 END) + (CASE WHEN stage = 'single_speaking' AND cid <> spk THEN 0.25 ELSE 0 END) + (CASE WHEN list_contains(rev, cid) THEN 0.18 ELSE 0 END) + 0.05
       WHEN ctype = 'down_self_or_think' THEN 0.05 + (CASE WHEN down THEN 0.25 ELSE 0 END) WHEN ctype = 'offscreen_place_or_away' THEN 0.05 + (CASE WHEN gz <> 'center' OR ps <> 'center' THEN 0.20 ELSE 0 END) ELSE 0 END
  + CASE qual WHEN 'gaze_reliable' THEN 0.15 WHEN 'pose_fallback' THEN 0.05 ELSE 0 END - CASE WHEN ctype = 'unknown' THEN 0 WHEN qual = 'pose_fallback' THEN 0.05 WHEN qual = 'unknown' THEN 0.5 ELSE 0 END AS raw FROM c0 JOIN rv USING (shot_id)),
c AS (SELECT *, round(least(1, greatest(0, raw)), 6) AS total FROM c1)"""


@query("target_candidates", f"WITH {_STAGE} SELECT shot_id, trk AS local_track_id, ctype AS candidate_type, cid AS candidate_id, side AS candidate_side FROM c")
def target_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    stage = _stage(spark, sf_dir)
    return targets.candidates(*stage, parts=tasks_for(stage[0])).select("shot_id", "local_track_id", "candidate_type", "candidate_id", "candidate_side")


@query("target_score", f"WITH {_STAGE} SELECT shot_id, trk AS local_track_id, ctype AS candidate_type, cid AS candidate_id, round(total, 4) AS total_score FROM c")
def target_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    stage = _stage(spark, sf_dir)
    return targets.candidates(*stage, parts=tasks_for(stage[0])).select("shot_id", "local_track_id", "candidate_type", "candidate_id", F.round("total_score", 4).alias("total_score"))


_ASSIGN = f"""{_STAGE}, r AS (SELECT *, CASE ctype WHEN 'onscreen_local_track' THEN 5 WHEN 'current_speaker' THEN 4 WHEN 'offscreen_participant' THEN 3 WHEN 'offscreen_place_or_away' THEN 2 WHEN 'down_self_or_think' THEN 1 ELSE 0 END AS prio,
  CASE WHEN list_contains(act, cid) THEN 2 WHEN cid = spk THEN 1 ELSE 0 END AS live, CAST(ctype NOT IN ('offscreen_place_or_away', 'down_self_or_think') AS INT) AS spec FROM c WHERE ctype <> 'unknown'),
n AS (SELECT *, row_number() OVER (PARTITION BY shot_id, trk ORDER BY total DESC, prio DESC, cid DESC) AS i FROM r),
t AS (SELECT shot_id, trk, max(conv_id) AS conv_id, max(shot_idx) AS shot_idx, max(qual) AS qual, max(total) FILTER (WHERE i = 1) AS top, max(total) FILTER (WHERE i = 2) AS second, max(cid) FILTER (WHERE i = 1) AS top_id, max(ctype) FILTER (WHERE i = 1) AS top_type FROM n GROUP BY ALL),
e AS (SELECT n.shot_id, n.trk, n.cid, n.ctype, n.total, row_number() OVER (PARTITION BY n.shot_id, n.trk ORDER BY live DESC, cconf DESC, spec DESC, prio DESC) AS j, live, cconf, spec, prio FROM n JOIN t ON n.shot_id = t.shot_id AND n.trk = t.trk WHERE round(top - total, 6) < 0.15),
w AS (SELECT a.shot_id, a.trk, a.cid, a.ctype, a.total, b.j IS NULL OR (a.live, a.cconf, a.spec, a.prio) > (b.live, b.cconf, b.spec, b.prio) AS strict FROM e a LEFT JOIN e b ON a.shot_id = b.shot_id AND a.trk = b.trk AND b.j = 2 WHERE a.j = 1),
z AS (SELECT t.*, CASE WHEN qual = 'unknown' THEN 'gaze_quality_unknown' WHEN top < 0.55 THEN 'low_score' WHEN round(top - second, 6) < 0.15 AND NOT strict THEN 'low_margin' ELSE 'assigned' END AS reason, CASE WHEN round(top - second, 6) < 0.15 THEN w.cid ELSE top_id END AS pick, CASE WHEN round(top - second, 6) < 0.15 THEN w.ctype ELSE top_type END AS pick_type, CASE WHEN round(top - second, 6) < 0.15 THEN w.total ELSE top END AS pick_score FROM t JOIN w USING (shot_id, trk)),
o AS (SELECT conv_id, shot_id, shot_idx, trk, reason, CASE reason WHEN 'assigned' THEN pick WHEN 'low_margin' THEN top_id ELSE 'unknown' END AS target_id, CASE reason WHEN 'assigned' THEN pick_type WHEN 'low_margin' THEN 'ambiguous' ELSE 'unknown' END AS target_type, CASE reason WHEN 'assigned' THEN pick_score WHEN 'low_margin' THEN top ELSE 0 END AS conf,
  CASE reason WHEN 'assigned' THEN 'assigned' WHEN 'low_margin' THEN 'ambiguous' WHEN 'low_score' THEN 'rejected' ELSE 'unknown' END AS status FROM z)"""


@query("target_assign", f"WITH {_ASSIGN} SELECT shot_id, trk AS local_track_id, target_type, target_id, status AS proxy_status, reason AS failure_reason, round(conf, 4) AS proxy_confidence FROM o")
def target_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    bins, tr, ident, sh = _stage(spark, sf_dir)
    n = tasks_for(bins)
    c = materialise(spark, targets.candidates(bins, tr, ident, sh, parts=n), "candidates")  # the fold and the join around it both read them
    a = targets.assignments(bins, c, ident, sh, parts=n)
    return a.select("shot_id", "local_track_id", "target_type", "target_id", "proxy_status", "failure_reason", F.round("proxy_confidence", 4).alias("proxy_confidence"))


@query("final_table", f"""WITH {_ASSIGN}, k AS (SELECT shot_id, trk, count(*) AS n, CAST(max(CAST(ctype IN ('current_speaker', 'offscreen_participant') AS INT)) AS INT) AS off FROM c GROUP BY ALL)
SELECT o.shot_id, o.trk AS subject_local_track_id, tr.stage AS stage_type, 'g:' || o.shot_id || ':' || o.trk AS subject_global_person_id, round(tr.conf, 4) AS identity_confidence, 'unknown' AS identity_status, k.n AS candidate_count, k.off AS has_offscreen_person_candidate, o.target_id, o.status AS proxy_status, gz AS gaze_direction_bucket
FROM o JOIN tr ON tr.shot_id = o.shot_id AND tr.trk = o.trk JOIN k ON k.shot_id = o.shot_id AND k.trk = o.trk""")
def final_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    bins, tr, ident, sh = _stage(spark, sf_dir)
    n = tasks_for(bins)
    c = materialise(spark, targets.candidates(bins, tr, ident, sh, parts=n), "candidates")
    f = targets.final_table(bins, ident, targets.assignments(bins, c, ident, sh, parts=n), sh, tr, c, n)
    return f.select("shot_id", "subject_local_track_id", "stage_type", "subject_global_person_id", F.round("identity_confidence", 4).alias("identity_confidence"), "identity_status", "candidate_count", "has_offscreen_person_candidate", "target_id", "proxy_status", "gaze_direction_bucket")


@query("histogram_sets", """
WITH x AS (SELECT user_id % 3 AS grp, 'event_type' AS metric, event_type AS value FROM events UNION ALL SELECT user_id % 3, 'hour', CAST(CAST(date_part('hour', ts) AS INT) AS VARCHAR) FROM events)
SELECT metric, value, grp, count(*) AS n, CAST(GROUPING(grp) AS INT) AS overall FROM x GROUP BY GROUPING SETS ((metric, value), (metric, value, grp))""")
def histogram_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 3).alias("grp0"), "event_type", F.hour("ts").alias("hour"))
    return targets.histograms(e, "grp0", ["event_type", "hour"]).select("metric", "value", "grp", "n", F.col("overall").cast("int").alias("overall"))


@query("failure_summary", """
SELECT l_returnflag, l_linestatus, count(*) AS row_count, round(avg(l_quantity), 3) AS mean_l_quantity, round(avg(l_discount), 5) AS mean_l_discount, round(avg(l_tax), 5) AS mean_l_tax, round(avg(l_extendedprice), 2) AS mean_l_extendedprice FROM lineitem GROUP BY ALL""")
def failure_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = qa.group_summary(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], ["l_quantity", "l_discount", "l_tax", "l_extendedprice"], 9)
    return s.select("l_returnflag", "l_linestatus", "row_count", F.round("mean_l_quantity", 3).alias("mean_l_quantity"), F.round("mean_l_discount", 5).alias("mean_l_discount"), F.round("mean_l_tax", 5).alias("mean_l_tax"), F.round("mean_l_extendedprice", 2).alias("mean_l_extendedprice"))


_STATUS = "SELECT CASE event_type WHEN 'view' THEN 'assigned' WHEN 'click' THEN 'unknown' WHEN 'error' THEN '' ELSE 'rejected' END AS status, CASE WHEN event_id % 4 = 0 THEN 'low_margin' WHEN event_id % 4 = 1 THEN 'low_score' ELSE 'assigned' END AS reason, event_id FROM events"


@query("full_compare", f"""WITH e AS ({_STATUS}), s AS (SELECT CASE WHEN status <> '' THEN status WHEN reason = 'low_margin' THEN 'ambiguous' WHEN reason = 'low_score' THEN 'rejected' ELSE 'assigned' END AS s, reason, event_id % 2 AS h FROM e),
m AS (SELECT s AS metric, h FROM s UNION ALL SELECT reason, h FROM s WHERE reason <> 'assigned'), l(metric) AS (VALUES ('assigned'), ('unknown'), ('ambiguous'), ('rejected'), ('low_score'), ('low_margin'))
SELECT l.metric, count(*) FILTER (WHERE h = 0) AS before, count(*) FILTER (WHERE h = 1) AS after, count(*) FILTER (WHERE h = 1) - count(*) FILTER (WHERE h = 0) AS delta FROM l LEFT JOIN m USING (metric) GROUP BY l.metric""")
def full_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, m = F.col("event_type"), F.col("event_id") % 4
    e = table(spark, sf_dir, "events").select("event_id", F.when(k == "view", "assigned").when(k == "click", "unknown").when(k == "error", "").otherwise("rejected").alias("proxy_status"), F.when(m == 0, "low_margin").when(m == 1, "low_score").otherwise("assigned").alias("failure_reason"))
    return qa.compare(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"))


@query("stratified_sample", """
WITH b AS (SELECT doc_id, source, 'long' AS sample_bucket, 30 AS most FROM documents WHERE n_chars > 4000 UNION ALL SELECT doc_id, source, 'english', 20 FROM documents WHERE lang = 'en')
SELECT doc_id, sample_bucket, sample_rank FROM (SELECT *, row_number() OVER (PARTITION BY sample_bucket ORDER BY md5('13|' || CAST(doc_id AS VARCHAR)), doc_id) AS sample_rank FROM b) WHERE sample_rank <= most""")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang")
    s = bucket_sample(d, {"long": (F.col("n_chars") > 4000, 30), "english": (F.col("lang") == "en", 20)}, "doc_id", 13)
    return s.select("doc_id", "sample_bucket", F.col("sample_rank").cast("long").alias("sample_rank"))


@query("quota_topup", """
WITH r AS (SELECT l.doc_id, l.quality, l.toxic, d.n_chars % 17 AS p FROM labels l JOIN documents d USING (doc_id)), a AS (SELECT doc_id, 'toxic' AS sample_subtype FROM r WHERE toxic = 1 ORDER BY p DESC, doc_id LIMIT 10),
b AS (SELECT doc_id, 'poor' FROM r WHERE quality = 0 AND doc_id NOT IN (SELECT doc_id FROM a) ORDER BY p DESC, doc_id LIMIT 5), c AS (SELECT doc_id, 'any' FROM r WHERE doc_id NOT IN (SELECT doc_id FROM a UNION ALL SELECT doc_id FROM b) ORDER BY p DESC, doc_id LIMIT 5)
SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c""")
def quota_topup(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") % 17).alias("p")), "doc_id")
    chosen, _ = quotas(r, "doc_id", [("toxic", F.col("toxic") == 1, 10), ("poor", F.col("quality") == 0, 5), ("any", F.lit(True), 5)], F.col("p"), "doc_id")
    return chosen.select("doc_id", "sample_subtype")


@query("label_precision", """
SELECT lang, count(*) AS reviewed_count, count(*) FILTER (WHERE quality = 1) AS correct_count, count(*) FILTER (WHERE quality = 0 AND toxic = 1) AS wrong_target_count, round(count(*) FILTER (WHERE quality = 1) / count(*), 6) AS precision, count(*) FILTER (WHERE quality = 1) / count(*) >= 0.8 AS sft_ready
FROM labels JOIN documents USING (doc_id) GROUP BY lang""")
def label_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    r = r.withColumn("human_label", F.when(F.col("quality") == 1, "correct").when(F.col("toxic") == 1, "wrong_target").otherwise("unsure"))
    return qa.label_precision(r, ["lang"], bucket=None).select("lang", "reviewed_count", "correct_count", "wrong_target_count", "precision", "sft_ready")


_HUMAN = "CASE WHEN k % 6 = 0 THEN 'left' WHEN k % 6 = 1 THEN 'right' WHEN k % 6 = 2 THEN 'center' WHEN k % 6 = 3 THEN 'bad_track' WHEN k % 6 = 4 THEN 'unclear' ELSE '' END"


@query("direction_calibration", f"""WITH {V_FRAME}, d AS (SELECT kind, {_HUMAN} AS human, CASE WHEN gaze_x < -0.2 THEN 'left' WHEN gaze_x > 0.2 THEN 'right' ELSE 'center' END AS g, CASE WHEN pose_y < -0.25 THEN 'left' WHEN pose_y > 0.25 THEN 'right' ELSE 'center' END AS p FROM v_frame),
r AS (SELECT *, human IN ('left', 'right', 'center') AS j FROM d WHERE human <> '')
SELECT kind, count(*) AS reviewed_count, count(*) FILTER (WHERE human = 'bad_track') AS bad_track_count, round(count(*) FILTER (WHERE j AND g = human) / nullif(count(*) FILTER (WHERE j), 0), 6) AS gaze_lr_accuracy, round(count(*) FILTER (WHERE j AND p = human) / nullif(count(*) FILTER (WHERE j), 0), 6) AS pose_lr_accuracy,
  count(*) FILTER (WHERE g IN ('left', 'right') AND p IN ('left', 'right') AND g <> p) AS gaze_pose_conflict_count, count(*) FILTER (WHERE human = 'center' AND g = 'center') AS gaze_center_agreement, count(*) FILTER (WHERE j AND g <> human) > count(*) FILTER (WHERE j AND g = human) AS likely_gaze_sign_flipped FROM r GROUP BY kind""")
def direction_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k") % 6
    f = frames(spark, sf_dir).select("kind", F.when(k == 0, "left").when(k == 1, "right").when(k == 2, "center").when(k == 3, "bad_track").when(k == 4, "unclear").otherwise("").alias("human"), direction_bucket(F.col("gaze_x"), 0.20).alias("g"), direction_bucket(F.col("pose_y"), 0.25).alias("p"))
    return qa.calibration(f, "human", "g", "p", ["kind"]).select("kind", "reviewed_count", "bad_track_count", "gaze_lr_accuracy", "pose_lr_accuracy", "gaze_pose_conflict_count", "gaze_center_agreement", "likely_gaze_sign_flipped")


@query("evidence_compare", """
WITH s AS (SELECT vec_id AS id, label FROM embeddings), j AS (SELECT s.id, s.label, l.quality, l.toxic FROM s LEFT JOIN labels l ON l.doc_id = s.id)
SELECT label, count(*) AS samples, count(quality) AS reviewed, count(*) FILTER (WHERE quality = 1) AS agree, count(*) FILTER (WHERE quality IS NULL) AS missing, greatest(0, 30 - count(quality)) AS shortfall FROM j GROUP BY label""")
def evidence_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    four = lambda n: [(F.col(n) % k).alias(c) for k, c in ((2, "movie_id"), (3, "sequence_id"), (5, "shot_id"))]
    s = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("bin_idx"), *four("vec_id"), "label")
    e = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("bin_idx"), *four("doc_id"), "quality")
    rows = qa.evidence_rows(s, e, ["movie_id", "sequence_id", "shot_id", "bin_idx"])
    return qa.evidence_summary(rows, ["label"], "quality", F.col("quality") == 1, 30)


@query("unit_cosine", "SELECT a.vec_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 5) AS cos FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def unit_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", unit(F.col("embedding")).alias("u"))
    j = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("u").alias("w")), "vec_id")
    return j.select("vec_id", F.round(cosine(F.col("u"), F.col("w")), 5).alias("cos"))


# A vector's 64 numbers as logits of 64 bins of 4 degrees; once as a column expression, and once by a model in batches.
@query("bin_angles", """
WITH v AS (SELECT vec_id, unnest(range(0, 64)) AS i, unnest(list_transform(CAST(embedding AS DOUBLE[]), lambda x: 20 * x)) AS x FROM embeddings), e AS (SELECT vec_id, sum(exp(x) * i) / sum(exp(x)) AS bin FROM v GROUP BY vec_id)
SELECT vec_id, round(radians(bin * 4 - 128), 6) AS yaw, round(radians(bin * 4 - 128), 6) AS batched FROM e""")
def bin_angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: 20 * x.cast("double")).alias("logits"))
    both = run_gaze(e.withColumn("yaw", bin_angle(F.col("logits"), 4.0, -128.0)), lambda: lambda x: [np.array(x.tolist(), float)], "logits", ("batched",), None, 4.0, -128.0)
    return both.select("vec_id", F.round("yaw", 6).alias("yaw"), F.round("batched", 6).alias("batched"))


@query("stream_timebin", f"""WITH {V_FRAME} SELECT stream, epoch_us(TIMESTAMP '2024-01-01 00:00:00') // 1000000 + CAST(floor(t / 86400) AS BIGINT) * 86400 AS bin_start_s, count(*) AS n_frames_total, count(*) FILTER (WHERE success = 1) AS n_frames_valid, round(avg(conf) FILTER (WHERE success = 1), 4) AS confidence_mean
FROM v_frame GROUP BY ALL""")
def stream_timebin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bins of the whole event stream: the last state of each, in whatever order the files come."""
    from shotlens.streaming.live import live_bins, read_events, run_updates

    k = F.get_json_object("props", "$.k").cast("int")
    e = read_events(spark, f"{sf_dir}/events.parquet").select(F.col("user_id").alias("stream"), F.col("ts").cast("timestamp").alias("at"), (F.col("event_type") != "error").alias("valid"), ((150 + k) / 250.0).alias("conf"))
    out = run_updates(spark, live_bins(e, ["stream"], "at", "1 day", None, "valid", "conf"), ["stream", "bin_start"], "stream-bins")
    return out.select("stream", F.unix_timestamp("bin_start").alias("bin_start_s"), "n_frames_total", "n_frames_valid", F.round("confidence_mean", 4).alias("confidence_mean"))
