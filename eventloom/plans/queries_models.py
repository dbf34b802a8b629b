"""Queries over evidence, state classifiers and model responses, each with the same rows in DuckDB where SQL can express it."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventloom.operators import annotations, evidence, models, pipelines, responses
from eventloom.plans.fixtures import REGIONS, edges_sql, view
from eventloom.plans.registry import query
from eventloom.streaming.state_machine import KEY


@query(f""", h AS (SELECT sample_index i, clip_id, actor_id, hand_side, concat('region_', sample_index % 4) region_id, t_h + 0.1e0 ts, wrist_confidence c FROM fx_pose),
 n AS (SELECT h.*, p.wrist_x x, p.wrist_y y, p.wrist_confidence wc, row_number() OVER (PARTITION BY i ORDER BY abs(p.t_h - ts), p.t_h) rn FROM h LEFT JOIN (SELECT * FROM fx_pose WHERE sample_index % 5 <> 0) p ON p.clip_id = h.clip_id AND p.actor_id = h.actor_id AND p.hand_side = h.hand_side AND abs(p.t_h - ts) <= 24),
 d AS (SELECT i, x, y, ax, ay, cx, cy, greatest(0e0, least(1e0, ((x - ax) * (cx - ax) + (y - ay) * (cy - ay)) / ((cx - ax) * (cx - ax) + (cy - ay) * (cy - ay)))) t FROM n JOIN {edges_sql()} USING (region_id) WHERE rn = 1 AND x IS NOT NULL),
 s AS (SELECT i, min(sqrt((x - ax - t * (cx - ax)) * (x - ax - t * (cx - ax)) + (y - ay - t * (cy - ay)) * (y - ay - t * (cy - ay)))) dist, count(*) FILTER (WHERE (ay > y) <> (cy > y) AND x < (cx - ax) * (y - ay) / CASE WHEN cy <> ay THEN cy - ay ELSE 1e-30 END + ax) % 2 = 1 odd FROM d GROUP BY i)
 SELECT concat('cand_', i) candidate_id, clip_id, actor_id, hand_side, region_id, ts timestamp_s, x wrist_x, y wrist_y, coalesce(odd OR dist <= 1e-9, false) inside_region, round(CASE WHEN odd OR dist <= 1e-9 THEN 0 ELSE dist END, 6) distance_px, coalesce(wc, 0.5e0) trajectory_confidence,
 CASE WHEN i % 3 <> 0 THEN c ELSE 0 END hand_empty, CASE WHEN i % 3 <> 0 THEN 1 - c ELSE 0 END hand_carrying, 0e0 hand_uncertain, CASE WHEN i % 3 <> 1 THEN c ELSE 0 END shelf_removed, CASE WHEN i % 3 <> 1 THEN 1 - c ELSE 0 END shelf_placed, 0e0 shelf_unchanged, 0e0 shelf_uncertain FROM n LEFT JOIN s USING (i) WHERE rn = 1""")
def build_observations(spark, sf):
    p = view(spark, sf, "fx_pose")
    c, zero = F.col("wrist_confidence"), F.lit(0.0)
    i = F.col("sample_index").cast("string")
    rows = p.select("sample_index", F.concat(F.lit("cand_"), i).alias("candidate_id"), "clip_id", "actor_id", "hand_side", F.concat(F.lit("region_"), (F.col("sample_index") % 4).cast("string")).alias("region_id"), (F.col("t_h") + 0.1).alias("timestamp_s"), c.alias("a"), (1 - c).alias("b"))
    hand = rows.filter("sample_index % 3 <> 0").withColumns(dict(zip(evidence.HAND, (F.col("a"), F.col("b"), zero), strict=True)))
    shelf = rows.filter("sample_index % 3 <> 1").withColumns(dict(zip(evidence.SHELF, (F.col("a"), F.col("b"), zero, zero), strict=True)))
    out = evidence.build_observations(hand, shelf, p.filter("sample_index % 5 <> 0"), REGIONS, tolerance=24.0)
    return out.withColumn("distance_px", F.round("distance_px", 6))


# rows 0.1 s apart; the 16th of each 20 is the last inside, and a third of these have an event 0.1 s before
@query(""", o AS (SELECT *, CAST(round(timestamp_s * 10) AS INT) k, lead(timestamp_s) OVER (PARTITION BY clip_id ORDER BY timestamp_s) nx FROM fx_sm_obs),
 e AS (SELECT clip_id, actor_id, hand_side, region_id, 'pickup' AS type, timestamp_s - 0.5e0 t_start, timestamp_s transfer_s, timestamp_s + 0.5e0 t_end, 0.8e0 confidence FROM o WHERE k % 60 = 14)
 SELECT * FROM e UNION ALL SELECT clip_id, actor_id, hand_side, region_id, CASE WHEN k % 40 < 20 THEN 'pickup' ELSE 'putdown' END, timestamp_s - 0.15e0, timestamp_s, nx, 0.35e0 FROM o WHERE k % 20 = 15 AND nx IS NOT NULL AND k % 60 <> 15 AND clip_id IN (SELECT clip_id FROM e)""")
def grace_window(spark, sf):
    obs = view(spark, sf, "fx_sm_obs")
    t = F.col("timestamp_s")
    events = obs.filter(F.round(t * 10).cast("int") % 60 == 14).select(*KEY, F.lit("pickup").alias("type"), (t - 0.5).alias("t_start"), t.alias("transfer_s"), (t + 0.5).alias("t_end"), F.lit(0.8).alias("confidence"))
    return evidence.grace_window(events, obs, KEY, 0.2)


@query(" SELECT concat('pred_', substr(sha256(concat_ws(':', clip_id, type, printf('%.4f', t_start), printf('%.4f', t_end))), 1, 12)) pred_id, clip_id, type, t_start, t_end, score, 'machine' AS model FROM fx_pred")
def events_to_predictions(spark, sf):
    return evidence.events_to_predictions(view(spark, sf, "fx_pred").withColumnRenamed("score", "confidence"), "machine")


@query()
def classified_states(spark, sf):
    rows = view(spark, sf, "fx_vectors")
    model = models.train_state_classifier(rows.filter("split = 'train'"), ["pickup", "putdown", "negative"])
    return models.predict_state(model, rows).drop("embedding")


_READ = ", r AS (SELECT *, CASE l_orderkey % 5 WHEN 0 THEN 9 WHEN 1 THEN 1 ELSE 12 END last, l_orderkey % 11 = 0 cut, l_orderkey % 11 <> 0 AND l_orderkey % 13 = 0 listed FROM fx_responses)"
_WRONG = [("label", "is not an event type", "l_orderkey % 4 = 3"), ("end_frame", "is before start_frame", "last < l_linenumber"), ("end_frame", "is outside the frames", "frame_count > 0 AND (last >= frame_count OR l_linenumber >= frame_count)"), ("hard_case", "is not a boolean", "l_orderkey % 6 = 0")]


@query(_READ + " SELECT response_id, 0 AS item, CASE WHEN l_orderkey % 4 = 1 THEN 'putdown' ELSE 'pickup' END AS label, CAST(l_linenumber AS BIGINT) start_frame, CAST(last AS BIGINT) end_frame, CAST(1 AS BIGINT) AS item_count, 'med' confidence, true hard_case, '' notes FROM r WHERE NOT cut AND NOT listed AND NOT (" + " OR ".join(f"({c})" for *_, c in _WRONG) + ")")
def model_events(spark, sf):
    return responses.model_events(view(spark, sf, "fx_responses", "l_orderkey"))[0]


@query(_READ + " SELECT field, message, count(*) n FROM (SELECT 'content' field, 'is not JSON' message FROM r WHERE cut UNION ALL SELECT 'content', 'is not an object' FROM r WHERE listed" + "".join(f" UNION ALL SELECT '{f}', '{m}' FROM r WHERE NOT cut AND NOT listed AND ({c})" for f, m, c in _WRONG) + ") GROUP BY 1, 2")
def model_response_errors(spark, sf):
    return responses.model_events(view(spark, sf, "fx_responses", "l_orderkey"))[1].groupBy("field", "message").agg(F.count("*").alias("n"))


_REGION = ", r AS (SELECT *, o_orderkey % 100 + 20 AS last, CASE o_orderkey % 4 WHEN 0 THEN 'pickup' WHEN 1 THEN 'putdown' WHEN 2 THEN 'ignore' ELSE 'grab' END AS label, o_orderkey % 4 < 2 AND o_orderkey % 3 = 0 AS no_count, o_orderkey % 7 = 0 AS unseen FROM fx_export)"
_GOOD = "label <> 'grab' AND NOT no_count AND NOT unseen AND NOT cut"


@query(_REGION + f""", g AS (SELECT *, concat('group_', substr(sha256(concat(clip_id, ':r', o_orderkey)), 1, 12)) event_group_id FROM r WHERE {_GOOD} AND label <> 'ignore')
 SELECT concat('evt_', substr(md5(concat_ws(':', clip_id, label, event_group_id, n)), 1, 12)) event_id, clip_id, label AS type, (last - 10) / 20e0 t_start, last / 20e0 t_end, o_orderkey % 5 = 0 AS hard_case, 'ann' AS annotator, 'high' AS confidence, NULL::VARCHAR AS notes, event_group_id FROM g, (VALUES (0), (1)) v(n) WHERE n <= o_orderkey % 3 - 1""")
def annotated_events(spark, sf):
    return annotations.convert_export(annotations.read_export(view(spark, sf, "fx_export", "o_orderkey"))[0])[0]


@query(_REGION + f" SELECT concat('ign_', substr(md5(concat(clip_id, ':ignore:r', o_orderkey)), 1, 12)) ignore_id, clip_id, (last - 10) / 20e0 t_start, last / 20e0 t_end, 'ACTION_OCCLUDED' AS reason, 'ann' AS annotator, NULL::VARCHAR AS notes FROM r WHERE {_GOOD} AND label = 'ignore'")
def annotated_ignores(spark, sf):
    return annotations.convert_export(annotations.read_export(view(spark, sf, "fx_export", "o_orderkey"))[0])[1]


@query(_REGION + """ SELECT field, message, count(*) n FROM (SELECT 'export' AS field, 'is not an array of objects' AS message FROM r WHERE cut UNION ALL SELECT 'label', 'is unknown' FROM r WHERE NOT cut AND label = 'grab'
 UNION ALL SELECT 'item_count', 'is required' FROM r WHERE NOT cut AND no_count UNION ALL SELECT 'complete_active_span_reviewed', 'is not confirmed' FROM r WHERE NOT cut AND unseen) GROUP BY 1, 2""")
def annotation_errors(spark, sf):
    tasks, errors = annotations.read_export(view(spark, sf, "fx_export", "o_orderkey"))
    return errors.unionByName(annotations.convert_export(tasks)[2]).groupBy("field", "message").agg(F.count("*").alias("n"))


def _track_inputs(spark, sf):
    """Candidates, poses, features and labels that replay the rows of fx_sm_obs: one candidate a clip, a row each 0.1 s."""
    at = F.round(F.col("timestamp_s") * 10).cast("int")
    rows = view(spark, sf, "fx_sm_obs").withColumns({"k": at, "t": at / F.lit(10.0), "candidate_id": F.concat("clip_id", F.lit("/0"))})
    who = ["candidate_id", *KEY]
    candidates = rows.groupBy(*who).agg(F.lit(0.0).alias("raw_start_s"), F.max("t").alias("raw_end_s"), F.lit(0.0).alias("window_start_s"), F.max("t").alias("window_end_s"))
    x = F.when(F.col("inside_region"), 300.0).otherwise(500.0 + F.col("distance_px"))
    poses = rows.select("clip_id", "actor_id", "hand_side", F.col("t").alias("t_h"), x.alias("wrist_x"), F.lit(300.0).alias("wrist_y"), F.lit(0.8).alias("wrist_confidence"))
    hand = F.when(F.col("hand_empty") > 0.5, "empty").otherwise("carrying")
    shelf = F.when(F.col("shelf_removed") > 0.5, "removed").when(F.col("shelf_placed") > 0.5, "placed").otherwise("no_change")
    near = lambda state, names: F.array(*[F.when(state == n, 1.0).otherwise(0.0) + (F.col("k") % 7) * 0.01 for n in names])
    of = lambda kind, state, names: rows.select("candidate_id", F.col("t").alias("timestamp_s"), F.lit(kind).alias("crop_type"), near(state, names).alias("embedding"), state.alias("state"))
    return candidates, poses, of("hand", hand, ["empty", "carrying"]), of("shelf", shelf, ["removed", "placed", "no_change"])


@query(
    """, n AS (SELECT clip_id, CAST(floor((count(*) + 8) / 20) AS BIGINT) AS n FROM fx_sm_obs GROUP BY clip_id)
 SELECT clip_id, n AS n_events, CAST(ceil(n / 2) AS BIGINT) AS n_pickup FROM n WHERE n > 0"""
)
def track_a_predictions(spark, sf):
    candidates, poses, hand, shelf = _track_inputs(spark, sf)
    fitted = [models.train_state_classifier(rows, names) for rows, names in ((hand, ["empty", "carrying"]), (shelf, ["removed", "placed", "no_change"]))]
    clips = view(spark, sf, "fx_clips").select("clip_id", "duration_s").unionByName(candidates.select("clip_id", F.lit(1e6).alias("duration_s")))
    found = pipelines.track_a(candidates, clips, poses, REGIONS, hand.unionByName(shelf).drop("state"), *fitted)
    return found.predictions.groupBy("clip_id").agg(F.count("*").alias("n_events"), F.count_if(F.col("type") == "pickup").alias("n_pickup"))


def scaled_crops():
    """An encoder of the crops' places, for tests."""
    return lambda rows: rows[["geometry_x", "geometry_y", "timestamp_s"]].to_numpy() / 1000


@query()
def feature_dataset(spark, sf):
    def folded(name, *times):
        """A view with its times, in seconds of a long video, folded into the 700 hours of the poses."""
        df = view(spark, sf, name)
        back = F.floor(F.col(times[0]) / 700) * 700
        return df.withColumns({t: F.col(t) - back for t in times})

    k = folded("fx_candidates", "raw_start_s", "raw_end_s")
    k = k.withColumns({"window_start_s": F.greatest(F.lit(0.0), F.col("raw_start_s") - 40), "window_end_s": F.col("raw_end_s") + 40})
    ignores, events = folded("fx_ignore", "t_start", "t_end"), folded("fx_gt", "t_start", "t_end")
    records, _ = pipelines.feature_dataset(k, view(spark, sf, "fx_clips"), ignores, view(spark, sf, "fx_pose"), REGIONS, events, scaled_crops, tolerance=24.0)
    return records.drop("created_at", "batch_id")
