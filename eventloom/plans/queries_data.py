"""Queries over data quality, lookups, reports and parsers, each with the same rows in DuckDB."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventloom.functions import parse
from eventloom.functions.intervals import frame_to_time, inclusive_end, time_to_frame
from eventloom.operators import dataset, lookups, quality, sampling
from eventloom.plans.fixtures import view
from eventloom.plans.registry import query


def _rules(table: str, key: str, *rules: tuple[str, str, str]) -> str:
    """The violations of rules (field, message, condition) as one SQL union."""
    return " UNION ALL ".join(f"SELECT {key} AS source, '{f}' AS field, '{m}' AS message FROM {table} WHERE {c}" for f, m, c in rules)


_UNIQUE = "SELECT {0} AS source, '{0}' AS field, 'is not unique' AS message FROM {1} GROUP BY {0} HAVING count(*) > 1"
_POSITIVE = [(c, "is not positive", f"{c} <= 0") for c in ("duration_s", "fps", "width", "height")]


@query(" " + _rules("fx_registry", "clip_id", ("s3_key", "is empty", "s3_key = ''"), ("split", "is not a split", "split NOT IN ('train', 'val', 'test')"), *_POSITIVE, ("n_person_tracks", "is negative", "n_person_tracks < 0"),
       ("active_start_s", "only one end is set", "(active_start_s IS NULL) <> (active_end_s IS NULL)"), ("active_start_s", "is out of range", "active_start_s < 0 OR active_start_s >= active_end_s OR active_end_s > duration_s")) + " UNION ALL " + _UNIQUE.format("clip_id", "fx_registry"))
def check_clips(spark, sf):
    return quality.check_clips(view(spark, sf, "fx_registry"))


_CLIPS = ", c AS (SELECT clip_id, max(duration_s) duration_s FROM fx_registry GROUP BY clip_id)"
_ON_CLIP = [("type", "is not an event type", "type NOT IN ('pickup', 'putdown')"), ("t_start", "is negative", "t_start < 0"), ("t_end", "is not after t_start", "t_start >= t_end"), ("t_end", "is after the clip", "t_end > duration_s")]
_LOST = " UNION ALL SELECT {0}, 'clip_id', 'is unknown' FROM {1} WHERE clip_id NOT IN (SELECT clip_id FROM c)"


def _clips(spark, sf):
    return view(spark, sf, "fx_registry").groupBy("clip_id").agg(F.max("duration_s").alias("duration_s"))


@query(_CLIPS + ", e AS (SELECT event_id, clip_id, CASE WHEN hard_case THEN 'restocking' ELSE type END AS type, t_start - 25 t_start, CASE WHEN t_start % 70 = 0 THEN t_start - 25 ELSE t_end - 25 END t_end, confidence, CASE WHEN hard_case THEN ' ' ELSE 'a' END annotator FROM fx_gt), j AS (SELECT e.*, duration_s FROM e LEFT JOIN c ON c.clip_id = e.clip_id) "
       + _rules("j", "event_id", *_ON_CLIP, ("annotator", "is empty", "trim(annotator) = ''")) + _LOST.format("event_id", "e"))
def check_events(spark, sf):
    s = F.col("t_start") - 25
    e = view(spark, sf, "fx_gt").withColumns({"type": F.when(F.col("hard_case"), "restocking").otherwise(F.col("type")), "annotator": F.when(F.col("hard_case"), " ").otherwise("a"), "t_start": s, "t_end": F.when(F.col("t_start") % 70 == 0, s).otherwise(F.col("t_end") - 25)})
    return quality.check_events(e, _clips(spark, sf))


@query(_CLIPS + ", p AS (SELECT pred_id, clip_id, type, t_start, t_end, score * 1.1 - 0.05 score, CASE WHEN score < 0.01 THEN '' ELSE model END model FROM fx_pred), j AS (SELECT p.*, duration_s FROM p LEFT JOIN c ON c.clip_id = p.clip_id) "
       + _rules("j", "pred_id", *_ON_CLIP, ("score", "is not in 0..1", "score < 0 OR score > 1"), ("model", "is empty", "model = ''")) + _LOST.format("pred_id", "p"))
def check_predictions(spark, sf):
    p = view(spark, sf, "fx_pred").withColumns({"score": F.col("score") * 1.1 - 0.05, "model": F.when(F.col("score") < 0.01, "").otherwise(F.col("model"))})
    return quality.check_predictions(p, _clips(spark, sf))


_REVIEWED = """, c AS (SELECT clip_id, max(duration_s) d FROM fx_registry GROUP BY clip_id), r0 AS (SELECT r.*, lower(trim(label)) AS type, round(source_start_s + start_s, 3) t_start, round(source_start_s + end_s, 3) t_end, d FROM fx_review r LEFT JOIN c ON c.clip_id = r.clip_id WHERE vlm_status = 'success' AND review_status = 'complete'),
 r1 AS (SELECT *, CASE WHEN type NOT IN ('pickup', 'putdown') THEN 'label' WHEN t_start >= t_end THEN 'interval' WHEN d IS NOT NULL AND t_start < 0 THEN 'negative start' WHEN d IS NOT NULL AND t_end > d + 0.1 THEN 'beyond the clip' END AS error FROM r0),
 r2 AS (SELECT *, unnest(range(0, greatest(item_count, 1))) item FROM r1 WHERE error IS NULL),
 r3 AS (SELECT * REPLACE (CASE WHEN lower(trim(confidence)) IN ('high', 'med', 'low') THEN lower(trim(confidence)) ELSE 'med' END AS confidence), concat('evt_', substr(md5(concat(clip_id, ':', type, ':', printf('%.3f', t_start), ':', item)), 1, 12)) event_id FROM r2),
 r4 AS (SELECT *, row_number() OVER w n, first_value(candidate_id) OVER w kept_candidate FROM r3 WINDOW w AS (PARTITION BY event_id ORDER BY candidate_id, pos, item)) """


def _reviewed(spark, sf):
    return quality.reviewed_events(view(spark, sf, "fx_review"), _clips(spark, sf))


@query(_REVIEWED + "SELECT event_id, clip_id, type, t_start, t_end, hard_case, confidence, notes FROM r4 WHERE n = 1")
def reviewed_events(spark, sf):
    return _reviewed(spark, sf)[0]


@query(_REVIEWED + "SELECT candidate_id AS source, pos, error AS message FROM r1 WHERE error IS NOT NULL")
def review_errors(spark, sf):
    return _reviewed(spark, sf)[1]


@query(_REVIEWED + "SELECT event_id, kept_candidate, candidate_id skipped_candidate, clip_id, t_start, t_end, type FROM r4 WHERE n > 1")
def review_audit(spark, sf):
    return _reviewed(spark, sf)[2]


@query(_CLIPS + ", e AS (SELECT CASE WHEN hard_case THEN concat('dup_', clip_id) ELSE event_id END event_id, concat(clip_id, CASE WHEN hard_case THEN 'x' ELSE '' END) clip_id, t_start, CASE WHEN hard_case THEN t_start ELSE t_end END t_end FROM fx_gt), j AS (SELECT e.*, duration_s FROM e LEFT JOIN c ON c.clip_id = e.clip_id) "
       + _rules("j", "event_id", ("t_end", "is not after t_start", "t_start >= t_end"), ("t_end", "is after the clip", "duration_s > 0 AND t_end > duration_s + 0.1")) + " UNION ALL " + _UNIQUE.format("event_id", "e")
       + " UNION ALL SELECT DISTINCT clip_id, 'clip_id', 'is unknown' FROM e WHERE clip_id NOT IN (SELECT clip_id FROM c)")
def check_final(spark, sf):
    hard = F.col("hard_case")
    e = view(spark, sf, "fx_gt").withColumns({"event_id": F.when(hard, F.concat(F.lit("dup_"), "clip_id")).otherwise(F.col("event_id")), "t_end": F.when(hard, F.col("t_start")).otherwise(F.col("t_end")), "clip_id": F.when(hard, F.concat("clip_id", F.lit("x"))).otherwise(F.col("clip_id"))})
    return quality.check_final(e, _clips(spark, sf))


@query(", o AS (SELECT clip_id, event_id, t_start, type, hash_pos, lag(t_start) OVER w ls, lag(type) OVER w lt, lag(event_id) OVER w li FROM (SELECT *, CAST(substr(event_id, 5) AS BIGINT) * 7919 % 10007 hash_pos FROM fx_gt) WINDOW w AS (PARTITION BY clip_id ORDER BY hash_pos, event_id)) SELECT clip_id, event_id FROM o WHERE ls > t_start OR (ls = t_start AND (lt > type OR (lt = type AND li > event_id)))")
def check_order(spark, sf):
    e = view(spark, sf, "fx_gt").withColumn("at", F.struct((F.substring("event_id", 5, 20).cast("long") * 7919 % 10007).alias("p"), "event_id"))
    return quality.check_order(e, "at").select("clip_id", F.col("at.event_id").alias("event_id"))


@query(", m AS (SELECT CASE WHEN hard_case THEN '' ELSE candidate_id END candidate_id, clip_id, CASE WHEN pos = 1 THEN NULL ELSE source_start_s END source_start_s, source_start_s + 9 - pos * 7 source_end_s, CASE WHEN item_count > 1 THEN 'v.mp4' END candidate_video, CASE WHEN item_count = 1 THEN 'k.mp4' ELSE ' ' END candidate_key FROM fx_review) "
       + _rules("m", "candidate_id", ("candidate_id", "is missing or empty", "candidate_id = ''"), ("source_start_s", "is missing or empty", "source_start_s IS NULL"), ("candidate_video", "is missing or empty", "candidate_video IS NULL AND trim(candidate_key) = ''"), ("source_start_s", "is not before source_end_s", "coalesce(source_start_s, 0) >= source_end_s")))
def check_candidate_metadata(spark, sf):
    r, s = view(spark, sf, "fx_review"), F.col("source_start_s")
    m = r.select(F.when(F.col("hard_case"), "").otherwise(F.col("candidate_id")).alias("candidate_id"), "clip_id", F.when(F.col("pos") != 1, s).alias("source_start_s"), (s + 9 - F.col("pos") * 7).alias("source_end_s"), F.when(F.col("item_count") > 1, "v.mp4").alias("candidate_video"), F.when(F.col("item_count") == 1, "k.mp4").otherwise(" ").alias("candidate_key"))
    return quality.check_candidate_metadata(m)


_RANGE = [(k, m, c.format(k)) for k in ("raw", "window") for m, c in (("is out of range", "{0}_start_s < 0 OR {0}_start_s > {0}_end_s OR {0}_end_s > duration_s + 1e-6"), ("is empty", "{0}_start_s >= {0}_end_s"))]


@query(_CLIPS + ", k AS (SELECT candidate_id, clip_id, raw_start_s - 30 raw_start_s, CASE WHEN raw_start_s % 70 = 0 THEN raw_start_s - 31 ELSE raw_end_s - 30 END raw_end_s, window_start_s - 30 window_start_s, window_end_s - 33 window_end_s FROM fx_candidates), j AS (SELECT k.*, duration_s FROM k LEFT JOIN c ON c.clip_id = k.clip_id) "
       + _rules("j", "candidate_id", *_RANGE, ("window", "does not hold the raw interval", "window_start_s > raw_start_s OR window_end_s < raw_end_s")))
def check_candidates(spark, sf):
    s = F.col("raw_start_s")
    k = view(spark, sf, "fx_candidates").withColumns({"raw_start_s": s - 30, "raw_end_s": F.when(s % 70 == 0, s - 31).otherwise(F.col("raw_end_s") - 30), "window_start_s": F.col("window_start_s") - 30, "window_end_s": F.col("window_end_s") - 33})
    return quality.check_candidates(k, _clips(spark, sf))


@query(", r AS (SELECT candidate_id, start_s - pos * 0.5 s, end_s + item_count * 0.5 - pos * 0.7 e, source_start_s + pos * 0.2 o, source_start_s a, source_start_s + 2.5 b FROM fx_review), f AS (SELECT candidate_id, CASE WHEN s < -0.1 THEN 'negative start' WHEN e > b - a + 0.1 THEN 'end beyond the candidate' WHEN o + s < a - 0.1 THEN 'start before the source' WHEN o + e > b + 0.1 THEN 'end beyond the source' WHEN e <= s THEN 'empty' END AS error FROM r) SELECT * FROM f WHERE error IS NOT NULL")
def check_relative_times(spark, sf):
    c, pos = F.col, F.col("pos")
    error = quality.relative_time_error(c("start_s") - pos * 0.5, c("end_s") + c("item_count") * 0.5 - pos * 0.7, c("source_start_s") + pos * 0.2, c("source_start_s"), c("source_start_s") + 2.5)
    return view(spark, sf, "fx_review").select("candidate_id", error.alias("error")).filter("error is not null")


_POLYGONS = ", p AS (SELECT concat('region_', CAST(user_id % 5000 AS VARCHAR)) region_id, x1, y1, x2, y2, sample_index FROM (SELECT *, CAST(substr(clip_id, 6) AS BIGINT) user_id FROM fx_boxes)) "


@query(_POLYGONS + "SELECT region_id AS source, 'polygon' AS field, 'leaves the frame' AS message FROM p WHERE x2 >= 1150 OR y2 >= 1300 UNION ALL SELECT region_id, 'polygon', 'has no area' FROM p WHERE sample_index % 7 = 0 UNION ALL SELECT region_id, 'polygon', 'has under 3 points' FROM p WHERE sample_index % 7 = 1 UNION ALL SELECT region_id, 'region_id', 'is not unique' FROM p GROUP BY region_id HAVING count(*) > 1")
def check_regions(spark, sf):
    at = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    line, few = F.array(at("x1", "y1"), at("x2", "y2"), at("x1", "y1")), F.array(at("x1", "y1"), at("x2", "y2"))
    shape = F.when(F.col("sample_index") % 7 == 0, line).when(F.col("sample_index") % 7 == 1, few).otherwise(F.array(at("x1", "y1"), at("x2", "y1"), at("x2", "y2")))
    regions = view(spark, sf, "fx_boxes").select(F.concat(F.lit("region_"), (F.substring("clip_id", 6, 20).cast("long") % 5000).cast("string")).alias("region_id"), shape.alias("polygon"))
    return quality.check_regions(regions, 1150, 1300)


@query(" SELECT s3_key AS key, size_bytes AS size FROM fx_registry WHERE lower(regexp_extract(s3_key, '\\.([^./]+)$', 1)) IN ('mp4', 'mov', 'avi', 'mkv') AND NOT starts_with(s3_key, 'store_0/') AND size_bytes >= 20000")
def filter_media(spark, sf):
    return lookups.filter_media(view(spark, sf, "fx_registry").select(F.col("s3_key").alias("key"), F.col("size_bytes").alias("size")), ("store_0/",), 20000)


@query(" SELECT clip_id, regexp_replace(regexp_replace(regexp_replace(s3_key, '\\.[^./]+$', ''), '/', '_', 'g'), '^clip_', '') AS name, CASE c_custkey % 4 WHEN 0 THEN concat('s3://b/', s3_key) WHEN 1 THEN concat('/v/', string_split(s3_key, '/')[-1]) WHEN 2 THEN NULL ELSE s3_key END AS url FROM fx_registry")
def clip_references(spark, sf):
    mode = F.element_at(F.array(*map(F.lit, ("s3_storage", "local", "presigned", "s3_key"))), (F.col("c_custkey") % 4 + 1).cast("int"))
    return view(spark, sf, "fx_registry").select("clip_id", lookups.normal_clip_id(F.col("s3_key")).alias("name"), lookups.media_url(F.col("s3_key"), mode, "b", "/v/").alias("url"))


@query(" SELECT crop_id FROM fx_features WHERE split IN ('val', 'test') AND clip_id IN (SELECT clip_id FROM fx_registry)")
def select_scope(spark, sf):
    return lookups.select_scope(view(spark, sf, "fx_features"), view(spark, sf, "fx_registry"), ("val", "test")).select("crop_id")


_RESOLVED = ", k AS (SELECT candidate_id, clip_id, CASE WHEN raw_start_s % 110 = 0 THEN '' ELSE actor_id END actor_id, hand_side, region_id FROM fx_candidates), z AS (SELECT candidate_id, CASE WHEN actor_id = '' THEN 'missing_identity_fields' WHEN clip_id NOT IN (SELECT clip_id FROM fx_registry WHERE duration_s > 0) THEN 'missing_source_video' WHEN clip_id NOT IN (SELECT clip_id FROM fx_pose) THEN 'missing_pose_observations' WHEN region_id NOT IN ('region_0', 'region_1') THEN 'missing_shelf_region' END skip_reason FROM k) "


def _resolved(spark, sf):
    k = view(spark, sf, "fx_candidates").withColumn("actor_id", F.when(F.col("raw_start_s") % 110 == 0, "").otherwise(F.col("actor_id")))
    regions = view(spark, sf, "fx_candidates").filter("region_id <> 'region_2'").select("region_id")
    return lookups.resolve_inputs(k, view(spark, sf, "fx_registry").filter("duration_s > 0"), view(spark, sf, "fx_pose"), regions)


@query(_RESOLVED + "SELECT * FROM z")
def resolve_inputs(spark, sf):
    return _resolved(spark, sf)


@query(_RESOLVED + "SELECT coalesce(skip_reason, 'processed') AS outcome, count(*) n FROM z GROUP BY 1")
def skip_counts(spark, sf):
    return lookups.skip_counts(_resolved(spark, sf))


@query(", k AS (SELECT candidate_id, CASE WHEN raw_start_s % 20 = 0 THEN '' ELSE actor_id END actor_id, CASE WHEN raw_start_s % 30 = 0 THEN NULL ELSE hand_side END hand_side, region_id FROM fx_candidates), r AS (SELECT candidate_id, concat('a', review_status) actor_id, arg_min(CASE WHEN hard_case THEN '' ELSE 'right' END, source_start_s + pos) hand_side FROM fx_review GROUP BY ALL) SELECT k.candidate_id, coalesce(nullif(k.actor_id, ''), r.actor_id, k.actor_id) actor_id, coalesce(nullif(k.hand_side, ''), nullif(r.hand_side, ''), k.hand_side) hand_side, k.region_id FROM k LEFT JOIN r ON r.candidate_id = k.candidate_id")
def enrich_candidates(spark, sf):
    k, s = view(spark, sf, "fx_candidates"), F.col("raw_start_s")
    k = k.select("candidate_id", F.when(s % 20 == 0, "").otherwise(F.col("actor_id")).alias("actor_id"), F.when(s % 30 != 0, F.col("hand_side")).alias("hand_side"), "region_id")
    r = view(spark, sf, "fx_review").select("candidate_id", F.concat(F.lit("a"), "review_status").alias("actor_id"), F.when(F.col("hard_case"), "").otherwise("right").alias("hand_side"), F.lit("").alias("region_id"), (F.col("source_start_s") + F.col("pos")).alias("at"))
    return lookups.enrich_candidates(k, r, "at")


@query(", n AS (SELECT candidate_id, count(*) n FROM fx_review WHERE vlm_status = 'success' GROUP BY candidate_id) SELECT r.candidate_id, CASE WHEN r.candidate_id NOT IN (SELECT candidate_id FROM fx_candidates) OR review_status <> 'complete' THEN 'excluded' WHEN n > 0 THEN 'positive' ELSE 'negative' END AS outcome, coalesce(n, 0) n_events FROM fx_review r LEFT JOIN n ON n.candidate_id = r.candidate_id")
def resolve_examples(spark, sf):
    r = view(spark, sf, "fx_review")
    return lookups.resolve_examples(r.select("candidate_id", "review_status"), view(spark, sf, "fx_candidates"), r.filter("vlm_status = 'success'"))


@query(", c AS (SELECT clip_id, s3_key, duration_s, fps FROM fx_clips WHERE substr(clip_id, -1) <> '7'), u AS (SELECT clip_id, max(t_end) duration_s FROM fx_gt GROUP BY clip_id) SELECT coalesce(c.clip_id, u.clip_id) clip_id, s3_key, CASE WHEN u.clip_id IS NOT NULL THEN u.duration_s ELSE c.duration_s END duration_s, fps FROM c FULL JOIN u ON u.clip_id = c.clip_id")
def update_clips(spark, sf):
    clips = view(spark, sf, "fx_clips").filter("substr(clip_id, -1) <> '7'").select("clip_id", "s3_key", "duration_s", "fps")
    return lookups.update_clips(clips, view(spark, sf, "fx_gt").groupBy("clip_id").agg(F.max("t_end").alias("duration_s")), ("duration_s",))


@query(", t AS (SELECT file_name task_id, CASE WHEN downloaded AND uploaded THEN concat('s3://b/', file_name) WHEN generated THEN '' ELSE file_name END video FROM fx_ledger) SELECT task_id, CASE WHEN video = '' THEN 'missing' WHEN starts_with(video, 's3://') THEN 'wrong form' ELSE 'not found' END AS problem FROM t WHERE video NOT IN (SELECT file_name FROM fx_listing)")
def check_media(spark, sf):
    video = F.when(F.col("downloaded") & F.col("uploaded"), F.concat(F.lit("s3://b/"), "file_name")).when(F.col("generated"), "").otherwise(F.col("file_name"))
    t = view(spark, sf, "fx_ledger").select(F.col("file_name").alias("task_id"), video.alias("video"))
    return lookups.check_media(t, view(spark, sf, "fx_listing").withColumnRenamed("file_name", "key"), "s3_key")


@query(", a AS (SELECT clip_id, count(*) n, max(track_key) k FROM fx_obs GROUP BY clip_id), b AS (SELECT clip_id, count(*) n, max(track_key) k FROM fx_obs WHERE confidence > 0.02 GROUP BY clip_id) SELECT coalesce(a.clip_id, b.clip_id) clip_id, a.n n_a, a.k k_a, b.n n_b, b.k k_b, a.n IS DISTINCT FROM b.n OR a.k IS DISTINCT FROM b.k AS changed FROM a FULL JOIN b ON b.clip_id = a.clip_id")
def compare_runs(spark, sf):
    run = lambda o: o.groupBy("clip_id").agg(F.count("*").alias("n"), F.max("track_key").alias("k"))
    obs = view(spark, sf, "fx_obs")
    return lookups.compare_runs(run(obs), run(obs.filter("confidence > 0.02")), ("n", "k"))


@query(", a AS (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY t_start, t_end, type) n FROM fx_gt), b AS (SELECT clip_id, type, t_start + 0.02 t_start, CASE WHEN hard_case THEN t_end + 1 ELSE t_end END t_end, row_number() OVER (PARTITION BY clip_id ORDER BY t_start + 0.02, CASE WHEN hard_case THEN t_end + 1 ELSE t_end END, type) n FROM fx_gt WHERE confidence <> 'low' OR t_start % 50 <> 0) SELECT coalesce(a.clip_id, b.clip_id) clip_id, bool_and(coalesce(a.type = b.type AND abs(a.t_start - b.t_start) <= 0.05 AND abs(a.t_end - b.t_end) <= 0.05, false)) AS same FROM a FULL JOIN b ON a.clip_id = b.clip_id AND a.n = b.n GROUP BY 1")
def round_trip(spark, sf):
    g = view(spark, sf, "fx_gt")
    out = g.filter("confidence <> 'low' or t_start % 50 <> 0").withColumns({"t_start": F.col("t_start") + 0.02, "t_end": F.when(F.col("hard_case"), F.col("t_end") + 1).otherwise(F.col("t_end"))})
    return lookups.round_trip(g, out, ["clip_id"], 0.05)


@query(" SELECT DISTINCT clip_id FROM fx_gt WHERE clip_id IN (SELECT clip_id FROM fx_features WHERE split = 'train')")
def selected_in_training(spark, sf):
    return lookups.selected_in_training(view(spark, sf, "fx_gt"), view(spark, sf, "fx_features"))


@query(", s AS (SELECT clip_id, split FROM fx_features UNION SELECT clip_id, split FROM fx_clips) SELECT a.split split_a, b.split split_b, count(*) n FROM s a JOIN s b ON a.clip_id = b.clip_id AND a.split < b.split GROUP BY ALL")
def split_overlap(spark, sf):
    return lookups.split_overlap(view(spark, sf, "fx_features").select("clip_id", "split").unionByName(view(spark, sf, "fx_clips").select("clip_id", "split")))


@query(" SELECT pred_id, clip_id, score, NULL::VARCHAR notes FROM fx_pred UNION ALL SELECT event_id, clip_id, NULL, confidence FROM fx_gt")
def union_predictions(spark, sf):
    return lookups.union_predictions(view(spark, sf, "fx_pred").select("pred_id", "clip_id", "score"), view(spark, sf, "fx_gt").select(F.col("event_id").alias("pred_id"), "clip_id", F.col("confidence").alias("notes")))


@query(" SELECT file_name FROM fx_listing WHERE file_name NOT IN (SELECT file_name FROM fx_ledger) ORDER BY file_name LIMIT 10 OFFSET 5")
def next_batch(spark, sf):
    return lookups.next_batch(view(spark, sf, "fx_listing"), view(spark, sf, "fx_ledger"), "file_name", 5, 10)


@query(", n AS (SELECT candidate_id, row_number() OVER (ORDER BY candidate_id) - 1 n FROM fx_candidates) SELECT candidate_id, unnest(CASE WHEN n < 30 THEN ['ann', 'bob', 'cy'] ELSE [['ann', 'bob', 'cy'][CAST((n - 30) % 3 + 1 AS INT)]] END) annotator FROM n")
def assign_reviewers(spark, sf):
    return lookups.assign_reviewers(view(spark, sf, "fx_candidates"), "candidate_id", ["ann", "bob", "cy"], 30)


@query()
def pilot_select(spark, sf):
    return lookups.pilot_select(view(spark, sf, "fx_candidates"), "candidate_id", ["actor_id", "region_id"], 60)


@query(", m AS (SELECT clip_id, min(CASE WHEN source_start_s > 0 THEN source_start_s END) s, max(CASE WHEN source_start_s + end_s > 0 THEN source_start_s + end_s END) e FROM fx_review GROUP BY clip_id) SELECT clip_id, CASE WHEN e IS NOT NULL THEN round(s, 3) END active_start_s, CASE WHEN s IS NOT NULL THEN round(e, 3) END active_end_s, coalesce(round(e + 1, 3), 0) duration_s FROM m")
def clip_metadata(spark, sf):
    return lookups.clip_metadata(view(spark, sf, "fx_review").withColumn("source_end_s", F.col("source_start_s") + F.col("end_s")))


@query(" SELECT count(*) indexed_count, count(*) FILTER (WHERE NOT decode_ok) failures, count(duplicate_of) duplicate_candidates, CAST(sum(size_bytes) AS BIGINT) total_source_bytes FROM fx_registry")
def registry_summary(spark, sf):
    return lookups.registry_summary(view(spark, sf, "fx_registry"))


@query(" SELECT 'events' AS measure, count(*) n FROM fx_gt UNION ALL SELECT concat('type=', type), count(*) FROM fx_gt GROUP BY 1 UNION ALL SELECT concat('confidence=', confidence), count(*) FROM fx_gt GROUP BY 1 UNION ALL SELECT CASE WHEN hard_case THEN 'hard' ELSE 'easy' END, count(*) FROM fx_gt GROUP BY 1 UNION ALL SELECT 'clips', count(DISTINCT clip_id) FROM fx_gt")
def truth_summary(spark, sf):
    return lookups.truth_summary(view(spark, sf, "fx_gt"))


@query(" SELECT count(*) n, count(*) FILTER (WHERE type = 'pickup') pickup, count(*) FILTER (WHERE type = 'putdown') putdown, round(avg(score), 9) mean_confidence, count(*) FILTER (WHERE score < 0.4) low, count(*) FILTER (WHERE score >= 0.4 AND score < 0.7) medium, count(*) FILTER (WHERE score >= 0.7) high FROM fx_pred")
def inference_summary(spark, sf):
    return lookups.inference_summary(view(spark, sf, "fx_pred")).withColumn("mean_confidence", F.round("mean_confidence", 9))


_RUNS = ", s AS (SELECT file_name AS source, CASE WHEN uploaded THEN 'completed' WHEN generated THEN 'failed' WHEN downloaded THEN 'skipped' ELSE 'pending' END AS status, length(source_etag) n_candidates FROM fx_ledger) "


@query(_RUNS + "SELECT count(*) requested, count(*) FILTER (WHERE status <> 'skipped') AS selected, count(*) FILTER (WHERE status = 'completed') completed, count(*) FILTER (WHERE status = 'failed') failed, count(*) FILTER (WHERE status = 'skipped') skipped, CAST(sum(n_candidates) AS BIGINT) total_candidates, (SELECT string_agg(source, ',' ORDER BY source) FROM (SELECT source FROM s WHERE status = 'failed' ORDER BY source LIMIT 20)) failed_sources FROM s")
def run_report(spark, sf):
    status = F.when(F.col("uploaded"), "completed").when(F.col("generated"), "failed").when(F.col("downloaded"), "skipped").otherwise("pending")
    return lookups.run_report(view(spark, sf, "fx_ledger").select(F.col("file_name").alias("source"), status.alias("status"), F.length("source_etag").alias("n_candidates")))


@query(", a AS (SELECT concat('f_', CAST(l_partkey AS VARCHAR)) file_name, CASE WHEN l_linenumber % 3 = 0 THEN 'failed' ELSE 'ok' END status FROM lineitem) SELECT file_name, count(*) FILTER (WHERE status = 'failed') failures, count(*) FILTER (WHERE status = 'failed') >= 3 AS skip FROM a GROUP BY file_name".replace(", a AS", "WITH a AS"))
def retry_counts(spark, sf):
    a = spark.read.parquet(f"{sf}/lineitem.parquet").select(F.concat(F.lit("f_"), F.col("l_partkey").cast("string")).alias("file_name"), F.when(F.col("l_linenumber") % 3 == 0, "failed").otherwise("ok").alias("status"))
    return lookups.retry_counts(a)


_LABELLED = ", z AS (SELECT label y, CASE vec_id % 5 WHEN 0 THEN 'pickup' WHEN 1 THEN 'uncertain' ELSE label END h FROM fx_features)"


def _labelled(spark, sf):
    return view(spark, sf, "fx_features").withColumn("h", F.expr("case vec_id % 5 when 0 then 'pickup' when 1 then 'uncertain' else label end"))


@query(_LABELLED + ", t AS (SELECT y, count(*) n, count(*) FILTER (WHERE y = h) tp FROM z GROUP BY y), p AS (SELECT h, count(*) np FROM z GROUP BY h), r AS (SELECT coalesce(tp / CAST(np AS DOUBLE), 0) p, tp / CAST(n AS DOUBLE) r FROM t LEFT JOIN p ON y = h), f AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END f FROM r) SELECT (SELECT count(*) FROM z) n, round((SELECT avg(CASE WHEN y = h THEN 1e0 ELSE 0 END) FROM z), 9) accuracy, round((SELECT avg(CASE WHEN h = 'uncertain' THEN 1e0 ELSE 0 END) FROM z), 9) uncertain_share, round(avg(r), 9) balanced_accuracy, round(avg(p), 9) macro_precision, round(avg(r), 9) macro_recall, round(avg(f), 9) macro_f1 FROM f")
def report_summary(spark, sf):
    out = dataset.report_summary(_labelled(spark, sf), "label", "h")
    return out.select("n", *[F.round(c, 9).alias(c) for c in out.columns if c != "n"])


@query(_LABELLED + " SELECT y AS truth, h AS predicted, count(*) n FROM z GROUP BY ALL")
def confusion_counts(spark, sf):
    return dataset.confusion_counts(_labelled(spark, sf), "label", "h")


@query(", c AS (SELECT type, count(*) n FROM fx_gt GROUP BY type) SELECT event_id, round((SELECT sum(n) FROM c) / CAST((SELECT count(*) FROM c) * n AS DOUBLE) * CASE WHEN confidence = 'low' THEN 0.5e0 ELSE 1e0 END, 9) AS weight FROM fx_gt g JOIN c ON c.type = g.type")
def row_weights(spark, sf):
    return dataset.row_weights(view(spark, sf, "fx_gt"), "type").select("event_id", F.round("weight", 9).alias("weight"))


@query(" SELECT l_orderkey, l_linenumber, coalesce(lower(trim(flag)) IN ('true', '1', 'yes', 'y'), false) AS truthy, coalesce(try_cast(nullif(trim(amount), '') AS DOUBLE), 7e0) AS amount, CASE WHEN try_cast(items AS DOUBLE) >= 1 AND try_cast(items AS DOUBLE) = floor(try_cast(items AS DOUBLE)) THEN CAST(try_cast(items AS DOUBLE) AS INT) END AS items, CASE WHEN contains(rate, '/') THEN CASE WHEN try_cast(split_part(rate, '/', 2) AS DOUBLE) <> 0 THEN try_cast(split_part(rate, '/', 1) AS DOUBLE) / try_cast(split_part(rate, '/', 2) AS DOUBLE) END ELSE try_cast(rate AS DOUBLE) END AS fps, coalesce(nullif(regexp_extract(name, 'S(\\d{8})', 1), ''), name) AS day FROM fx_text")
def lenient_parsers(spark, sf):
    c = F.col
    return view(spark, sf, "fx_text").select("l_orderkey", "l_linenumber", parse.truthy(c("flag")).alias("truthy"), parse.number(c("amount"), 7.0).alias("amount"), parse.item_count(c("items")).alias("items"), parse.frame_rate(c("rate")).alias("fps"), sampling.recording_day(c("name")).alias("day"))


@query(", b AS (SELECT *, greatest(p_background, p_pickup, p_putdown) best, p_background + p_pickup + p_putdown - greatest(p_background, p_pickup, p_putdown) - least(p_background, p_pickup, p_putdown) nxt FROM fx_window_scores) SELECT clip_id, k, CASE WHEN best < 0.5 OR best - nxt < 0.1 THEN 'uncertain' WHEN p_background = best THEN 'background' WHEN p_pickup = best THEN 'pickup' ELSE 'putdown' END AS state FROM b WHERE abs(best - nxt - 0.1) > 1e-9")
def uncertainty_gate(spark, sf):
    p = [F.col(f"p_{c}") for c in ("background", "pickup", "putdown")]
    lead = F.sort_array(F.array(*p), False)
    return view(spark, sf, "fx_window_scores").filter(F.abs(lead[0] - lead[1] - 0.1) > 1e-9).select("clip_id", "k", parse.gated(["background", "pickup", "putdown"], p, 0.5, 0.1).alias("state"))


@query(" SELECT event_id, CAST(trunc(t_end * 20e0) AS INT) frame, CAST(trunc(t_end * 20e0) AS INT) / 20e0 AS t, (CAST(trunc(t_end * 20e0) AS INT) + 1) / 20e0 AS end_s FROM fx_gt")
def frame_times(spark, sf):
    frame = time_to_frame(F.col("t_end"), 20.0)
    return view(spark, sf, "fx_gt").select("event_id", frame.alias("frame"), frame_to_time(frame, 20.0).alias("t"), inclusive_end(frame, 20.0).alias("end_s"))
