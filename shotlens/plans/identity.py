"""Who a face track is: cast aliases, speakers seen with cast, body boxes, a gallery of vectors, and the cascade of them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shotlens.functions.geometry import body_score, box, scale_box
from shotlens.functions.text import global_person_id, normalize_name, padded
from shotlens.operators.folds import greedy_pairs
from shotlens.operators.ranking import argmax_first_seen, keep_first
from shotlens.operators.similarity import best_match, mean_unit


@dataclass(frozen=True)
class IdentityRules:
    least_body: float = 0.55
    threshold: float = 0.62
    margin: float = 0.08
    least_track: float = 0.60
    single_speaker: float = 0.58
    alias: float = 0.88
    gallery_cap: float = 0.95


def alias_table(cast: DataFrame) -> DataFrame:
    """norm -> pid of cast rows (pid, input_ord, aliases): a whole alias (the last row that has it) goes before a token of
    one of over two letters (the first row that has it)."""
    norms = cast.select("pid", "input_ord", F.explode("aliases").alias("a")).select("pid", "input_ord", normalize_name(F.col("a")).alias("norm")).where("norm <> ''")
    tokens = norms.select("pid", "input_ord", F.explode(F.split("norm", " ")).alias("norm")).where("length(norm) > 2")
    both = norms.withColumn("whole", F.lit(1)).unionByName(tokens.withColumn("whole", F.lit(0)))
    return both.groupBy("norm").agg(F.max_by("pid", F.struct("whole", F.when(F.col("whole") == 1, F.col("input_ord")).otherwise(-F.col("input_ord")))).alias("pid"))


def canonical_pids(df: DataFrame, column: str, names: DataFrame) -> DataFrame:
    """A name becomes its pid (names: norm, pid); pids ("nm...") and "others" stay, unknown names too."""
    known = F.trim(F.coalesce(F.col(column), F.lit("")))
    n = names.select(F.col("norm").alias("__norm"), F.col("pid").cast("string").alias("__pid")).dropDuplicates(["__norm"])
    out = df.withColumn("__norm", normalize_name(known)).join(n, "__norm", "left")
    return out.withColumn(column, F.when(known.startswith("nm") | (known == "others") | (known == ""), known).otherwise(F.coalesce("__pid", known))).drop("__norm", "__pid")


def speaker_pids(shots: DataFrame, aliases: DataFrame, rules: IdentityRules = IdentityRules()) -> DataFrame:
    """norm -> pid, confidence, source. shots: shot_ord, speakers[], pids[]. A shot with one speaker and one pid counts 3, any
    other pair 1; confidence is the capped formula; an alias of the cast is worth 0.88, and wins over what is less."""
    pairs = shots.select("shot_ord", F.when((F.size("speakers") == 1) & (F.size("pids") == 1), 3).otherwise(1).alias("w"), F.explode("speakers").alias("s"), "pids").select("shot_ord", "w", normalize_name(F.col("s")).alias("norm"), F.explode("pids").alias("pid"))
    seen = argmax_first_seen(pairs.where("norm <> '' AND pid <> ''"), ["norm"], "pid", F.col("w"), "shot_ord")
    return speaker_choice(seen, aliases, rules)


def speaker_choice(seen: DataFrame, aliases: DataFrame, rules: IdentityRules = IdentityRules()) -> DataFrame:
    conf = F.least(F.lit(0.85), 0.45 + 0.08 * F.col("n") + 0.20 * (F.col("n") / F.col("total")))
    a = aliases.select("norm", F.col("pid").alias("__a"))
    out = seen.withColumn("__c", conf).join(a, "norm", "full")
    use_seen = F.col("__a").isNull() | (F.col("__c") > rules.alias)
    return out.select("norm", F.when(use_seen, F.col("pid")).otherwise(F.col("__a")).alias("pid"), F.when(use_seen, F.col("__c")).otherwise(F.lit(rules.alias)).alias("confidence"), F.when(use_seen, "speaker_cast_cooccurrence").otherwise("meta_cast_alias").alias("source"))


def body_matches(tracks: DataFrame, bodies: DataFrame, sizes: DataFrame, rules: IdentityRules = IdentityRules()) -> DataFrame:
    """shot_id, local_track_id, annotation_id, pid, score: faces and bodies of a shot, paired greedily by score.

    tracks: shot_id, local_track_id and mean x1..y2; bodies: shot_id, annotation_id, pid, x1..y2, src_w, src_h; sizes:
    shot_id, frame_width, frame_height (first seen). Annotation ids are unique, so that shots are independent."""
    first = sizes.dropDuplicates(["shot_id"]) if "input_ord" not in sizes.columns else keep_first(sizes, ["shot_id"], "input_ord")
    t = tracks.select("shot_id", "local_track_id", box(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")).alias("face"))
    b = bodies.join(first, "shot_id").select("shot_id", "annotation_id", "pid", scale_box(box(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")), F.col("src_w"), F.col("src_h"), F.col("frame_width"), F.col("frame_height")).alias("body")).where("body IS NOT NULL")
    pairs = t.join(b, "shot_id").select("shot_id", "local_track_id", "annotation_id", "pid", body_score(F.col("face"), F.col("body")).alias("score")).where(F.col("score") >= rules.least_body)
    return greedy_pairs(pairs, ["shot_id"], [-F.col("score"), F.col("local_track_id"), F.col("annotation_id")], "local_track_id", "annotation_id")


def gallery(tracks: DataFrame, shots: DataFrame, rules: IdentityRules = IdentityRules()) -> DataFrame:
    """Prototypes from shots with one speaker, one pid and one track of enough confidence. tracks: shot_id, local_track_id,
    track_conf, embedding; shots: shot_id, stage_type, speakers[], pids[]."""
    alone = tracks.groupBy("shot_id").agg(F.count_distinct("local_track_id").alias("__n")).where("__n = 1")
    good = shots.where("stage_type = 'single_speaking' AND size(speakers) = 1 AND size(pids) = 1").select("shot_id", F.col("pids")[0].alias("cast_pid"))
    rows = tracks.where((F.col("track_conf") >= rules.least_track) & (F.size("embedding") > 0)).join(alone, "shot_id").join(good, "shot_id")
    return rows.select(F.concat(F.lit("proto_"), F.col("shot_id"), F.lit("_"), F.col("local_track_id")).alias("prototype_id"), "cast_pid", global_person_id(F.col("cast_pid"), F.col("shot_id"), F.col("local_track_id")).alias("global_person_id"), F.col("shot_id").alias("source_shot_id"), F.col("local_track_id").alias("source_local_track_id"), F.col("track_conf").alias("quality_score"), "embedding")


def gallery_matches(tracks: DataFrame, shots: DataFrame, protos: DataFrame, rules: IdentityRules = IdentityRules()) -> DataFrame:
    q = tracks.where(F.size("embedding") > 0).join(shots.select("shot_id", "pids"), "shot_id").withColumn("__k", F.concat_ws("|", "shot_id", "local_track_id"))
    hit = best_match(q, protos, "__k", "embedding", "prototype_id", "cast_pid", rules.threshold, rules.margin, allow="pids").where("cast_pid IS NOT NULL")
    return hit.join(q.select("__k", "shot_id", "local_track_id"), "__k").select("shot_id", "local_track_id", "cast_pid", F.least(F.lit(rules.gallery_cap), F.greatest(F.lit(0.0), F.col("top_score"))).alias("confidence"))


def track_vectors(crops: DataFrame, k: int = 8) -> DataFrame:
    """The renormalised mean of a track's k most confident crops (shot_id, local_track_id, det_conf, frame, embedding)."""
    return mean_unit(crops, ["shot_id", "local_track_id"], "embedding", [F.desc("det_conf"), "frame"], k)


def cascade(tracks: DataFrame, body: DataFrame, matched: DataFrame, shots: DataFrame, speakers: DataFrame, cast: DataFrame, rules: IdentityRules = IdentityRules()) -> DataFrame:
    """One identity per track: body box, else gallery, else the single speaker of a shot with a single track, else none.

    tracks: shot_id, local_track_id (one row each); body and matched: shot_id, local_track_id, pid / cast_pid and score /
    confidence; shots: shot_id, speakers[]; speakers: norm, pid, confidence; cast: pid, cast_name, character_name."""
    key = ["shot_id", "local_track_id"]
    alone = tracks.groupBy("shot_id").agg(F.count_distinct("local_track_id").alias("__tracks"))
    out = tracks.join(body.select(*key, F.col("pid").alias("__bp"), F.col("score").alias("__bs")), key, "left").join(matched.select(*key, F.col("cast_pid").alias("__gp"), F.col("confidence").alias("__gc")), key, "left")
    out = out.join(alone, "shot_id").join(shots.select("shot_id", "speakers"), "shot_id", "left").withColumn("norm", F.when((F.size("speakers") == 1) & (F.col("__tracks") == 1), normalize_name(F.col("speakers")[0])))
    out = out.join(speakers.select("norm", F.col("pid").alias("__sp"), F.col("confidence").alias("__sc")), "norm", "left")
    has_body, has_gallery, has_speaker = F.col("__bs").isNotNull(), F.col("__gp").isNotNull(), F.col("__sp").isNotNull()
    pick = lambda a, b, c, d: F.when(has_body, a).when(has_gallery, b).when(has_speaker, c).otherwise(d)
    pid = pick(F.coalesce("__bp", F.lit("")), F.col("__gp"), F.col("__sp"), F.lit(""))
    out = out.withColumns({"cast_pid": pid, "identity_confidence": F.bround(pick(F.col("__bs"), F.col("__gc"), F.least(F.lit(rules.single_speaker), F.col("__sc")), F.lit(0.0)), 6), "identity_source": pick(F.lit("movienet_body_bbox"), F.lit("sface_gallery"), F.lit("single_speaker_single_track"), F.lit(""))})
    linked = F.when(F.col("identity_source") == "", "unknown").when(F.col("cast_pid").isin("", "others"), F.when(F.col("identity_source") == "sface_gallery", "unknown").otherwise("linked_other")).otherwise("linked_pid")
    out = out.withColumns({"identity_status": linked, "global_person_id": global_person_id(F.col("cast_pid"), F.col("shot_id"), F.col("local_track_id"))})
    out = out.join(cast.select(F.col("pid").alias("cast_pid"), "cast_name", "character_name").dropDuplicates(["cast_pid"]), "cast_pid", "left").withColumns({c: F.coalesce(c, F.lit("")) for c in ("cast_name", "character_name")})
    return out.drop("__bp", "__bs", "__gp", "__gc", "__tracks", "__sp", "__sc", "norm", "speakers")


def bodies_of(annotations: DataFrame) -> DataFrame:
    """Body boxes of annotation documents (movie_id, cast[]{id, shot_idx, pid, resolution[2], body.bbox[4]})."""
    c = annotations.select("movie_id", F.explode("cast").alias("c")).where("c.body.bbox IS NOT NULL AND size(c.body.bbox) = 4 AND size(c.resolution) = 2")
    idx = F.col("c.shot_idx").cast("string")
    at = lambda i: F.col("c.body.bbox")[i].cast("double")
    return c.select("movie_id", F.when(idx.rlike("^[0-9]+$"), padded("shot_", 4, idx.try_cast("long"))).otherwise(idx).alias("shot_id"), F.col("c.id").cast("string").alias("annotation_id"), F.coalesce("c.pid", F.lit("")).alias("pid"), at(0).alias("x1"), at(1).alias("y1"), at(2).alias("x2"), at(3).alias("y2"), F.col("c.resolution")[0].cast("double").alias("src_w"), F.col("c.resolution")[1].cast("double").alias("src_h"))
