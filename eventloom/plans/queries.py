"""Registered queries over the driver tables, each with the same rows in DuckDB."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventloom.functions.intervals import bounded_context, midpoint_distance, tiou
from eventloom.operators import dataset, decode, evaluate, intervals, precision, sampling, trajectories, windows
from eventloom.plans import queries_data, queries_events, queries_models, queries_sources, queries_windows  # noqa: F401
from eventloom.plans.fixtures import REGIONS, edges_sql, view
from eventloom.plans.registry import ORACLES, QUERIES, query
from eventloom.sources import tables
from eventloom.streaming.state_machine import interaction_events

_ISLANDS = """, w AS (SELECT clip_id, greatest(0e0, t_h - 0.5e0) lo, least(720e0, t_h + 0.5e0) hi FROM fx_obs),
 b AS (SELECT *, CASE WHEN max(hi) OVER p IS NULL OR lo > max(hi) OVER p + 6 THEN 1 ELSE 0 END br FROM w WHERE lo < hi WINDOW p AS (PARTITION BY clip_id ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 i AS (SELECT *, sum(br) OVER (PARTITION BY clip_id ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) isl FROM b),
 spans AS (SELECT clip_id, concat(clip_id, ':active:', lpad(CAST(isl - 1 AS VARCHAR), 3, '0')) active_span_id, min(lo) t_start, max(hi) t_end, 0 n_person_tracks FROM i GROUP BY clip_id, isl) """


@query(_ISLANDS + "SELECT * FROM spans")
def active_spans(spark, sf):
    return intervals.active_spans(view(spark, sf, "fx_obs"))


@query(_ISLANDS + "SELECT clip_id, count(*) n_spans, min(t_start) active_start_s, max(t_end) active_end_s, sum(t_end - t_start) active_s FROM spans GROUP BY clip_id")
def clip_summary(spark, sf):
    spans = intervals.active_spans(view(spark, sf, "fx_obs"))
    return spans.groupBy("clip_id").agg(F.count("*").alias("n_spans"), F.min("t_start").alias("active_start_s"), F.max("t_end").alias("active_end_s"), F.sum(F.col("t_end") - F.col("t_start")).alias("active_s"))


@query(_ISLANDS + "SELECT o.clip_id, o.sample_index FROM fx_obs o WHERE EXISTS (SELECT 1 FROM spans s WHERE s.clip_id = o.clip_id AND o.t_h BETWEEN s.t_start AND s.t_end AND s.t_end - s.t_start > 24)")
def frames_in_spans(spark, sf):
    obs = view(spark, sf, "fx_obs")
    spans = intervals.active_spans(obs).filter("t_end - t_start > 24")
    return intervals.overlap_filter(obs, spans, "clip_id", "t_h", "t_h", "t_start", "t_end", keep=True, closed=True).select("clip_id", "sample_index")


@query(""", g AS (SELECT *, t_h - lag(t_h) OVER w gap FROM fx_obs WINDOW w AS (PARTITION BY clip_id, track_key ORDER BY t_h, sample_index)),
 r AS (SELECT *, sum(CASE WHEN gap > 48 THEN 1 ELSE 0 END) OVER (PARTITION BY clip_id, track_key ORDER BY t_h, sample_index ROWS UNBOUNDED PRECEDING) run FROM g),
 a AS (SELECT clip_id, track_key, CAST(run AS BIGINT) run, min(t_h) first_seen, max(t_h) last_seen, count(*) n_observations, coalesce(max(gap) FILTER (WHERE gap <= 48), 0) max_gap, min(confidence) least FROM r GROUP BY ALL)
 SELECT clip_id, track_key, run, first_seen, last_seen, n_observations, max_gap, bool_or(n_observations >= 2 AND last_seen - first_seen >= 10 AND least >= 0.2) OVER (PARTITION BY clip_id, track_key) is_stable FROM a""")
def track_summaries(spark, sf):
    return dataset.track_summaries(view(spark, sf, "fx_obs"), 48.0, 2, 10.0, 0.2)


_STABLE = """, sg AS (SELECT *, t_h - lag(t_h) OVER w gap FROM fx_obs WINDOW w AS (PARTITION BY clip_id, track_key ORDER BY t_h, sample_index)),
 sr AS (SELECT *, sum(CASE WHEN gap > 48 THEN 1 ELSE 0 END) OVER (PARTITION BY clip_id, track_key ORDER BY t_h, sample_index ROWS UNBOUNDED PRECEDING) run FROM sg),
 sa AS (SELECT clip_id, track_key, run FROM sr GROUP BY ALL HAVING count(*) >= 2 AND max(t_h) - min(t_h) >= 10 AND min(confidence) >= 0.2),
 stable AS (SELECT * FROM fx_obs o WHERE EXISTS (SELECT 1 FROM sa WHERE sa.clip_id = o.clip_id AND sa.track_key = o.track_key))"""
_STABLE_ISLANDS = _STABLE + _ISLANDS.replace("FROM fx_obs", "FROM stable")


def _stable_obs(spark, sf):
    return dataset.with_stability(view(spark, sf, "fx_obs"), 48.0, 2, 10.0, 0.2)


@query(_STABLE_ISLANDS + "SELECT * FROM spans")
def stable_active_spans(spark, sf):
    return intervals.active_spans(_stable_obs(spark, sf))


@query(_STABLE_ISLANDS + """, e AS (SELECT clip_id, count(*) n, min(t_start) lo, max(t_end) hi, sum(t_end - t_start) s FROM spans GROUP BY clip_id),
 k AS (SELECT clip_id, count(DISTINCT track_key) n FROM stable GROUP BY clip_id), c AS (SELECT clip_id FROM fx_clips UNION SELECT clip_id FROM fx_obs)
 SELECT c.clip_id, coalesce(k.n, 0) n_person_tracks, e.n IS NOT NULL has_person, coalesce(e.n, 0) n_spans, e.lo active_start_s, e.hi active_end_s, coalesce(e.s, 0) active_s FROM c LEFT JOIN k ON k.clip_id = c.clip_id LEFT JOIN e ON e.clip_id = c.clip_id""")
def stable_clip_summary(spark, sf):
    obs = _stable_obs(spark, sf)
    return intervals.clip_summary(view(spark, sf, "fx_clips"), obs, intervals.active_spans(obs))


@query(_STABLE_ISLANDS + "SELECT o.clip_id, o.sample_index FROM fx_obs o WHERE EXISTS (SELECT 1 FROM spans s WHERE s.clip_id = o.clip_id AND o.t_h BETWEEN s.t_start AND s.t_end AND s.t_end - s.t_start > 24)")
def frames_in_stable_spans(spark, sf):
    obs = _stable_obs(spark, sf)
    spans = intervals.active_spans(obs).filter("t_end - t_start > 24")
    return intervals.overlap_filter(obs, spans, "clip_id", "t_h", "t_h", "t_start", "t_end", keep=True, closed=True).select("clip_id", "sample_index")


@query(" SELECT g.event_id, g.clip_id, g.type FROM fx_gt g WHERE NOT EXISTS (SELECT 1 FROM fx_ignore i WHERE i.clip_id = g.clip_id AND g.t_start < i.t_end AND i.t_start < g.t_end)")
def drop_ignored(spark, sf):
    return intervals.drop_ignored(view(spark, sf, "fx_gt"), view(spark, sf, "fx_ignore")).select("event_id", "clip_id", "type")


@query(" SELECT c.candidate_id FROM fx_candidates c WHERE NOT EXISTS (SELECT 1 FROM fx_ignore i WHERE i.clip_id = c.clip_id AND c.raw_start_s < i.t_end AND i.t_start < c.raw_end_s)")
def candidates_not_ignored(spark, sf):
    return intervals.drop_ignored(view(spark, sf, "fx_candidates"), view(spark, sf, "fx_ignore"), "raw_start_s", "raw_end_s").select("candidate_id")


@query(" SELECT c.candidate_id, (raw_start_s + raw_end_s) / 2 center FROM fx_candidates c WHERE NOT EXISTS (SELECT 1 FROM fx_ignore i WHERE i.clip_id = c.clip_id AND (raw_start_s + raw_end_s) / 2 BETWEEN i.t_start AND i.t_end)")
def center_not_ignored(spark, sf):
    c = view(spark, sf, "fx_candidates").withColumn("center", (F.col("raw_start_s") + F.col("raw_end_s")) / 2)
    return intervals.center_not_ignored(c, view(spark, sf, "fx_ignore"), "center").select("candidate_id", "center")


@query(""", p AS (SELECT candidate_id, event_id, type, (least(raw_end_s, t_end) - greatest(raw_start_s, t_start)) / (raw_end_s - raw_start_s) r, t_start FROM fx_candidates c JOIN fx_gt g ON c.clip_id = g.clip_id AND raw_start_s < t_end AND t_start < raw_end_s),
 q AS (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY r DESC, t_start, event_id) n FROM p)
 SELECT c.candidate_id, CASE WHEN r >= 0.5 THEN type ELSE 'negative' END AS label, CASE WHEN r >= 0.5 THEN event_id END event_id FROM fx_candidates c LEFT JOIN q ON c.candidate_id = q.candidate_id AND n = 1""")
def assign_label(spark, sf):
    return intervals.assign_label(view(spark, sf, "fx_candidates"), view(spark, sf, "fx_gt"))


@query(""", p AS (SELECT candidate_id, event_id, (least(raw_end_s, t_end) - greatest(raw_start_s, t_start)) / (t_end - t_start) r FROM fx_candidates c JOIN fx_gt g ON c.clip_id = g.clip_id AND raw_start_s < t_end AND t_start < raw_end_s)
 SELECT candidate_id, string_agg(event_id, ',' ORDER BY r DESC, event_id) event_ids, count(*) n_events FROM p WHERE r >= 0.1 GROUP BY candidate_id""")
def match_events_to_candidate(spark, sf):
    matched = intervals.match_events_to_candidate(view(spark, sf, "fx_candidates"), view(spark, sf, "fx_gt"))
    return matched.withColumn("event_ids", F.array_join("event_ids", ","))


@query(""", p AS (SELECT event_id, candidate_id, t_start <= raw_end_s AND raw_start_s <= t_end raw, row_number() OVER (PARTITION BY event_id ORDER BY window_start_s, window_end_s, candidate_id) n FROM fx_gt g JOIN fx_candidates c ON c.clip_id = g.clip_id AND t_start <= window_end_s AND window_start_s <= t_end)
 SELECT g.event_id, candidate_id IS NOT NULL covered, coalesce(raw, false) raw_covered, candidate_id FROM fx_gt g LEFT JOIN p ON g.event_id = p.event_id AND n = 1""")
def proposal_recall(spark, sf):
    return intervals.proposal_recall(view(spark, sf, "fx_gt"), view(spark, sf, "fx_candidates"))


@query(""", q AS (SELECT clip_id, sample_index + 0 qi, t_h + 0.7e0 qt FROM fx_obs),
 p AS (SELECT q.clip_id, qi, qt, t_h, wrist_x, row_number() OVER (PARTITION BY q.clip_id, qi ORDER BY abs(t_h - qt), t_h, wrist_x) n FROM q JOIN fx_pose o ON o.clip_id = q.clip_id AND abs(t_h - qt) <= 6)
 SELECT q.clip_id, q.qi, q.qt, p.t_h observed_at, p.wrist_x FROM q LEFT JOIN p ON p.clip_id = q.clip_id AND p.qi = q.qi AND n = 1""")
def nearest_observation(spark, sf):
    q = view(spark, sf, "fx_obs").select("clip_id", F.col("sample_index").alias("qi"), (F.col("t_h") + 0.7).alias("qt"))
    return intervals.nearest_observation(q, view(spark, sf, "fx_pose"), "clip_id", "qt", "t_h", 6.0, ["wrist_x"])


@query(f""", d AS (SELECT sample_index, clip_id, region_id, wrist_x x, wrist_y y, ax, ay, cx, cy, greatest(0e0, least(1e0, ((wrist_x - ax) * (cx - ax) + (wrist_y - ay) * (cy - ay)) / ((cx - ax) * (cx - ax) + (cy - ay) * (cy - ay)))) t FROM fx_pose, {edges_sql()}),
 s AS (SELECT sample_index, clip_id, region_id, min(sqrt((x - ax - t * (cx - ax)) * (x - ax - t * (cx - ax)) + (y - ay - t * (cy - ay)) * (y - ay - t * (cy - ay)))) dist, count(*) FILTER (WHERE (ay > y) <> (cy > y) AND x < (cx - ax) * (y - ay) / CASE WHEN cy <> ay THEN cy - ay ELSE 1e-30 END + ax) % 2 = 1 odd FROM d GROUP BY ALL)
 SELECT sample_index, clip_id, region_id, odd OR dist <= 1e-9 AS inside, round(CASE WHEN odd OR dist <= 1e-9 THEN 0 ELSE dist END, 6) AS distance FROM s""")
def pose_region(spark, sf):
    return trajectories.pose_regions(view(spark, sf, "fx_pose"), REGIONS).select("sample_index", "clip_id", "region_id", "inside", F.round("distance", 6).alias("distance"))


@query(" SELECT g.event_id, p.pred_id, greatest(0e0, least(g.t_end, p.t_end) - greatest(g.t_start, p.t_start)) / ((g.t_end - g.t_start) + (p.t_end - p.t_start) - greatest(0e0, least(g.t_end, p.t_end) - greatest(g.t_start, p.t_start))) tiou, abs((g.t_start + g.t_end) / 2 - (p.t_start + p.t_end) / 2) midpoint FROM fx_gt g JOIN fx_pred p ON substr(g.event_id, 5) = substr(p.pred_id, 6)")
def interval_scores(spark, sf):
    g = view(spark, sf, "fx_gt").select("event_id", F.col("t_start").alias("s"), F.col("t_end").alias("e"), F.expr("substr(event_id, 5)").alias("n"))
    p = view(spark, sf, "fx_pred").withColumn("n", F.expr("substr(pred_id, 6)"))
    c = [F.col(x) for x in ("s", "e", "t_start", "t_end")]
    return g.join(p, "n").select("event_id", "pred_id", tiou(*c).alias("tiou"), midpoint_distance(*c).alias("midpoint"))


@query(""", b AS (SELECT candidate_id, raw_start_s rs, raw_end_s re, least(2e0, greatest(raw_start_s, 0e0)) db, least(2e0, greatest(2000000e0 - raw_end_s, 0e0)) da, greatest(0e0, 6e0 - (raw_end_s - raw_start_s)) budget FROM fx_candidates),
 f AS (SELECT *, CASE WHEN da + db <= budget THEN db ELSE least(db, CASE WHEN da + db > 0 THEN budget * db / (da + db) ELSE 0 END) END fst FROM b)
 SELECT candidate_id, rs - fst AS window_start_s, re + CASE WHEN da + db <= budget THEN da ELSE least(da, budget - fst) END AS window_end_s FROM f""")
def context_windows(spark, sf):
    s, e = bounded_context(F.col("raw_start_s"), F.col("raw_end_s"), 2.0, 2.0, F.lit(2000000.0), 6.0)
    return view(spark, sf, "fx_candidates").select("candidate_id", s.alias("window_start_s"), e.alias("window_end_s"))


_SLIDING = """, v AS (SELECT candidate_id, clip_id, window_start_s s, window_end_s e, CAST(floor((window_end_s - window_start_s - 2.5e0) / 0.5e0 + 1e-9) AS INT) n FROM fx_candidates),
 sw AS (SELECT candidate_id, clip_id, i k, s + i * 0.5e0 ws, s + i * 0.5e0 + 2.5e0 we FROM (SELECT *, unnest(range(0, n + 1)) i FROM v WHERE e - s > 2.5e0)
 UNION ALL SELECT candidate_id, clip_id, n + 1, e - 2.5e0, e FROM v WHERE e - s > 2.5e0 AND s + n * 0.5e0 + 2.5e0 < e - 0.1e0
 UNION ALL SELECT candidate_id, clip_id, 0, greatest(s, (s + e) / 2 - 1.25e0), least(e, (s + e) / 2 + 1.25e0) FROM v WHERE e - s <= 2.5e0) """


@query(_SLIDING + "SELECT candidate_id, CAST(k AS INT) k, ws window_start_s, we window_end_s FROM sw")
def sliding_windows(spark, sf):
    c = view(spark, sf, "fx_candidates").select("candidate_id", F.posexplode(windows.sliding_windows(F.col("window_start_s"), F.col("window_end_s"))).alias("k", "w"))
    return c.select("candidate_id", "k", F.col("w.s").alias("window_start_s"), F.col("w.e").alias("window_end_s"))


@query(_SLIDING + """, h AS (SELECT candidate_id, k, type, row_number() OVER (PARTITION BY candidate_id, k ORDER BY t_start, event_id) n FROM sw JOIN fx_gt g ON g.clip_id = sw.clip_id AND (ws + we) / 2 BETWEEN t_start AND t_end)
 SELECT sw.candidate_id, CAST(sw.k AS INT) k, (ws + we) / 2 center, coalesce(type, 'background') AS label FROM sw LEFT JOIN h ON h.candidate_id = sw.candidate_id AND h.k = sw.k AND n = 1""")
def window_manifest(spark, sf):
    return windows.window_manifest(view(spark, sf, "fx_candidates"), view(spark, sf, "fx_gt")).select("candidate_id", "k", "center", "label")


@query(" SELECT candidate_id, unnest(list_transform(range(0, CAST(floor((raw_end_s - raw_start_s) * 2 + 1e-9) AS INT) + 1), lambda i: raw_start_s + i / 2e0)) AS t FROM fx_candidates")
def sample_times(spark, sf):
    return view(spark, sf, "fx_candidates").select("candidate_id", F.explode(windows.sample_times(F.col("raw_start_s"), F.col("raw_end_s"), 2.0)).alias("t"))


@query(""", s AS (SELECT clip_id, k, avg(p_background) OVER w p_background, avg(p_pickup) OVER w p_pickup, avg(p_putdown) OVER w p_putdown FROM fx_window_scores WINDOW w AS (PARTITION BY clip_id ORDER BY k ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING))
 SELECT clip_id, k, round(p_background, 9) p_background, round(p_pickup, 9) p_pickup, round(p_putdown, 9) p_putdown, CASE WHEN p_background >= p_pickup AND p_background >= p_putdown THEN 'background' WHEN p_pickup >= p_putdown THEN 'pickup' ELSE 'putdown' END AS label FROM s""")
def smooth_scores(spark, sf):
    out = decode.smooth_scores(view(spark, sf, "fx_window_scores"), 3)
    return out.withColumns({f"p_{c}": F.round(f"p_{c}", 9) for c in decode.CLASSES})


@query(""", n AS (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY k) rn FROM fx_window_scores),
 u AS (SELECT clip_id, k, rn, window_start_s, window_end_s, 'pickup' AS type, p_pickup p FROM n UNION ALL SELECT clip_id, k, rn, window_start_s, window_end_s, 'putdown', p_putdown FROM n UNION ALL SELECT clip_id, k, rn, window_start_s, window_end_s, 'background', p_background FROM n),
 f AS (SELECT *, rn - row_number() OVER (PARTITION BY clip_id, type ORDER BY k) run FROM u WHERE p > 0.4e0)
 SELECT clip_id, min(window_start_s) t_start, max(window_end_s) t_end, max(p) peak, round(avg(p), 9) AS mean, count(*) n_windows, type FROM f GROUP BY clip_id, type, run""")
def threshold_regions(spark, sf):
    scores = view(spark, sf, "fx_window_scores")
    parts = [decode.threshold_regions(scores, c, 0.4) for c in decode.CLASSES]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).withColumn("mean", F.round("mean", 9))


@query(
    queries_events.ITEMS
    + queries_events.MERGED.format(gap=400, rows="items")
    + """SELECT clip_id, type, t_start, t_end, score, pred_ids, items,
   CASE WHEN items > 1 THEN concat('l2_', substr(md5(concat_ws('|', clip_id, type, printf('%.3f', t_start), printf('%.3f', t_end))), 1, 12)) ELSE '' END AS group_id FROM merged"""
)
def merge_window_predictions(spark, sf):
    merged = decode.merge_window_predictions(queries_events.with_items(spark, sf), 400.0)
    return merged.withColumns({"pred_ids": F.array_join("pred_ids", ","), "items": F.col("items").cast("long")})


_MATCH = """, x AS (SELECT g.clip_id, g.type, event_id, pred_id, p.type AS predicted, score, greatest(0e0, least(g.t_end, p.t_end) - greatest(g.t_start, p.t_start)) / ((g.t_end - g.t_start) + (p.t_end - p.t_start) - greatest(0e0, least(g.t_end, p.t_end) - greatest(g.t_start, p.t_start))) q FROM fx_gt g JOIN fx_pred p ON g.clip_id = p.clip_id AND g.t_start < p.t_end AND p.t_start < g.t_end),
 m AS (SELECT * FROM x WHERE q >= 0.5 AND type = predicted) """
_STATUS = _MATCH + """, st AS (SELECT CASE WHEN pred_id IS NULL THEN 'fn' ELSE 'tp' END status, g.clip_id, g.type, g.event_id, pred_id FROM fx_gt g LEFT JOIN m ON g.event_id = m.event_id
 UNION ALL SELECT 'fp', clip_id, type, NULL, pred_id FROM fx_pred p WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.pred_id = p.pred_id)) """
_RATES = "CASE WHEN tp + fp > 0 THEN tp / CAST(tp + fp AS DOUBLE) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / CAST(tp + fn AS DOUBLE) ELSE 0 END AS recall"


@query(_STATUS + "SELECT * FROM st")
def evaluate_class_aware(spark, sf):
    return evaluate.class_aware(view(spark, sf, "fx_gt"), view(spark, sf, "fx_pred"))


@query(_STATUS + f", c AS (SELECT type, count(*) FILTER (WHERE status = 'tp') tp, count(*) FILTER (WHERE status = 'fp') fp, count(*) FILTER (WHERE status = 'fn') fn FROM st GROUP BY type), r AS (SELECT *, {_RATES} FROM c) SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END f1 FROM r")
def metrics_by_type(spark, sf):
    return evaluate.metrics_by_type(evaluate.class_aware(view(spark, sf, "fx_gt"), view(spark, sf, "fx_pred")))


@query(_MATCH + f""", h AS (SELECT unnest([0.3e0, 0.5e0, 0.7e0]) threshold), c AS (SELECT threshold, (SELECT count(*) FROM x WHERE q >= threshold AND type = predicted) tp, (SELECT count(*) FROM fx_pred) np, (SELECT count(*) FROM fx_gt) ng FROM h),
 d AS (SELECT threshold, tp, np - tp fp, ng - tp fn FROM c), r AS (SELECT *, {_RATES} FROM d) SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END f1 FROM r""")
def metrics_at_thresholds(spark, sf):
    return evaluate.metrics_at(view(spark, sf, "fx_gt"), view(spark, sf, "fx_pred"), [0.3, 0.5, 0.7])


@query(_MATCH + "SELECT t.type, count(*) FILTER (WHERE predicted = 'pickup') pickup, count(*) FILTER (WHERE predicted = 'putdown') putdown FROM (SELECT unnest(['pickup', 'putdown']) AS type) t LEFT JOIN (SELECT * FROM x WHERE q >= 0.5) x ON x.type = t.type GROUP BY t.type")
def evaluate_confusion(spark, sf):
    return evaluate.confusion(view(spark, sf, "fx_gt"), view(spark, sf, "fx_pred"))


@query(_STATUS + """, e AS (SELECT g.*, status FROM fx_gt g JOIN st ON st.event_id = g.event_id), s AS (SELECT concat('confidence=', confidence) AS slice, status FROM e UNION ALL SELECT CASE WHEN hard_case THEN 'hard' ELSE 'easy' END, status FROM e UNION ALL SELECT CASE WHEN t_end - t_start < 2 THEN 'short' ELSE 'long' END, status FROM e)
 SELECT slice, count(*) n_events, avg(CASE WHEN status = 'tp' THEN 1e0 ELSE 0 END) AS recall FROM s GROUP BY slice""")
def slice_recall(spark, sf):
    gt = view(spark, sf, "fx_gt")
    return evaluate.slice_recall(gt, evaluate.class_aware(gt, view(spark, sf, "fx_pred")), short=2.0)


@query(_STATUS + "SELECT status, pred_id, event_id, clip_id FROM st WHERE status <> 'tp'")
def failure_gallery(spark, sf):
    return evaluate.class_aware(view(spark, sf, "fx_gt"), view(spark, sf, "fx_pred")).filter("status <> 'tp'").select("status", "pred_id", "event_id", "clip_id")


@query(" SELECT clip_id, CAST(floor((count(*) + 8) / 20) AS BIGINT) n_events FROM fx_sm_obs GROUP BY clip_id HAVING floor((count(*) + 8) / 20) > 0")
def interaction_state_machine(spark, sf):
    return interaction_events(view(spark, sf, "fx_sm_obs")).groupBy("clip_id").agg(F.count("*").alias("n_events"))


@query("""  SELECT crop_id, CASE WHEN crop_type <> 'hand' THEN NULL WHEN (label = 'pickup' AND sample_position = 'pre') OR (label = 'putdown' AND sample_position = 'post') THEN 'empty' WHEN (label = 'pickup' AND sample_position = 'post') OR (label = 'putdown' AND sample_position = 'pre') THEN 'carrying' END AS hand,
 CASE WHEN crop_type = 'shelf' AND sample_position = 'post' THEN CASE label WHEN 'pickup' THEN 'removed' WHEN 'putdown' THEN 'placed' ELSE 'no_change' END END AS shelf FROM fx_features""")
def state_labels(spark, sf):
    c = [F.col(x) for x in ("label", "sample_position", "crop_type")]
    return view(spark, sf, "fx_features").select("crop_id", dataset.hand_state(*c).alias("hand"), dataset.shelf_state(*c).alias("shelf"))


@query(" SELECT 'label' AS dimension, label AS value, count(*) n FROM fx_features GROUP BY label UNION ALL SELECT 'split', split, count(*) FROM fx_features GROUP BY split UNION ALL SELECT 'crop_type', crop_type, count(*) FROM fx_features GROUP BY crop_type UNION ALL SELECT 'all', 'all', count(*) FROM fx_features")
def dataset_stats(spark, sf):
    return dataset.dataset_stats(view(spark, sf, "fx_features"))


@query(" SELECT coalesce(batch_id, 'unknown') AS batch_id, count(*) n FROM fx_features GROUP BY 1")
def list_batches(spark, sf):
    return dataset.list_batches(view(spark, sf, "fx_features"))


@query(", c AS (SELECT label, count(*) n FROM fx_features GROUP BY label) SELECT label, n, (SELECT sum(n) FROM c) / CAST((SELECT count(*) FROM c) * n AS DOUBLE) AS weight FROM c")
def class_weights(spark, sf):
    return dataset.class_weights(view(spark, sf, "fx_features"))


@query(""", z AS (SELECT label y, CASE vec_id % 5 WHEN 0 THEN 'pickup' WHEN 1 THEN 'uncertain' ELSE label END h FROM fx_features), t AS (SELECT y, count(*) support, count(*) FILTER (WHERE y = h) tp FROM z GROUP BY y), p AS (SELECT h, count(*) np FROM z GROUP BY h),
 r AS (SELECT y AS class, support, CASE WHEN coalesce(np, 0) > 0 THEN tp / CAST(np AS DOUBLE) ELSE 0 END AS precision, tp / CAST(support AS DOUBLE) AS recall FROM t LEFT JOIN p ON y = h) SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END f1 FROM r""")
def classification_report(spark, sf):
    rows = view(spark, sf, "fx_features").withColumn("h", F.expr("case vec_id % 5 when 0 then 'pickup' when 1 then 'uncertain' else label end"))
    return dataset.classification_report(rows, "label", "h")


@query(" SELECT clip_id, count(DISTINCT split) n_splits, string_agg(DISTINCT split, ',' ORDER BY split) splits FROM (SELECT clip_id, split FROM fx_features UNION ALL SELECT clip_id, split FROM fx_clips) GROUP BY clip_id HAVING count(DISTINCT split) > 1")
def split_leakage(spark, sf):
    both = view(spark, sf, "fx_features").select("clip_id", "split").unionByName(view(spark, sf, "fx_clips").select("clip_id", "split"))
    return dataset.split_leakage(both).withColumn("splits", F.array_join("splits", ","))


@query(" SELECT file_name, downloaded, generated, uploaded, source_etag, source_size_bytes FROM fx_ledger UNION ALL SELECT file_name, false, false, false, etag, size FROM fx_listing WHERE file_name NOT IN (SELECT file_name FROM fx_ledger)")
def ledger_sync(spark, sf):
    return dataset.ledger_sync(view(spark, sf, "fx_ledger"), view(spark, sf, "fx_listing"))


@query(" SELECT coalesce(a.file_name, b.file_name) AS file_name, CASE WHEN etag IS NULL THEN 'missing' WHEN source_etag IS NULL THEN 'adopted' WHEN source_etag <> etag OR source_size_bytes <> size THEN 'changed' ELSE 'unchanged' END AS outcome FROM fx_ledger a FULL JOIN fx_listing b ON a.file_name = b.file_name")
def ledger_reconcile(spark, sf):
    return dataset.ledger_reconcile(view(spark, sf, "fx_ledger"), view(spark, sf, "fx_listing"))


@query(" SELECT count(*) FILTER (WHERE downloaded) AS downloaded, count(*) FILTER (WHERE generated) AS generated, count(*) FILTER (WHERE uploaded) AS uploaded, count(*) AS total FROM fx_ledger")
def ledger_counts(spark, sf):
    return dataset.ledger_counts(view(spark, sf, "fx_ledger"))


@query(" SELECT file_name FROM fx_ledger WHERE downloaded AND NOT generated ORDER BY file_name LIMIT 20")
def select_ready(spark, sf):
    return dataset.select_ready(view(spark, sf, "fx_ledger"), "generation", 20)


@query(", r AS (SELECT *, row_number() OVER w rn, last_value(file_name) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) lst FROM (SELECT file_name, size FROM fx_listing) WINDOW w AS (PARTITION BY size ORDER BY file_name)) SELECT file_name, size, CASE WHEN lst <> file_name THEN lst END AS duplicate_of FROM r WHERE rn = 1")
def duplicate_sources(spark, sf):
    return dataset.duplicate_sources(view(spark, sf, "fx_listing").select("file_name", "size"), ["size"], "file_name")


@query(" SELECT clip_id, replace(s3_key, 'videos/', '/data/videos/') AS path, CAST((length(s3_key) - length(replace(s3_key, 'videos/', ''))) / 7 AS INT) AS n_rewritten FROM fx_clips")
def rewrite_paths(spark, sf):
    path, n = dataset.rewritten("s3_key", "videos/", "/data/videos/")
    return view(spark, sf, "fx_clips").select("clip_id", path.alias("path"), n.alias("n_rewritten"))


@query(" SELECT pred_id, concat('p_', substr(sha256(concat_ws('|', clip_id, type, CAST(CAST(round(t_start * 1000) AS BIGINT) AS VARCHAR), CAST(CAST(round(t_end * 1000) AS BIGINT) AS VARCHAR))), 1, 16)) AS stable_id FROM fx_pred")
def prediction_ids(spark, sf):
    return view(spark, sf, "fx_pred").select("pred_id", dataset.stable_id("p_", 16, "clip_id", "type", dataset.milliseconds("t_start"), dataset.milliseconds("t_end")).alias("stable_id"))


@query(" SELECT clip_id, bool_or(src = 'gt') AS in_gt, bool_or(src = 'pred') AS in_pred FROM (SELECT clip_id, 'gt' src FROM fx_gt UNION ALL SELECT clip_id, 'pred' FROM fx_pred) GROUP BY clip_id")
def clip_universe(spark, sf):
    return dataset.clip_universe(view(spark, sf, "fx_gt"), view(spark, sf, "fx_pred"))


_POSE = """, o AS (SELECT *, wrist_x < 700 AS inside FROM fx_pose) """
_TRACK = ["clip_id", "actor_id"]


def _pose(spark, sf):
    return view(spark, sf, "fx_pose").withColumn("inside", F.col("wrist_x") < 700)


@query(_POSE + """, l AS (SELECT *, lag(inside) OVER w li, lag(t_h) OVER w lt, lag(wrist_x) OVER w x1, lag(wrist_y) OVER w y1, lag(wrist_x, 2) OVER w x2, lag(wrist_y, 2) OVER w y2, lag(wrist_x, 4) OVER w x4, lag(wrist_y, 4) OVER w y4 FROM o WINDOW w AS (PARTITION BY clip_id, actor_id ORDER BY t_h, sample_index)),
 e AS (SELECT *, inside AND NOT coalesce(li, false) entered, sqrt((x2 - x4) * (x2 - x4) + (y2 - y4) * (y2 - y4)) m1, sqrt((wrist_x - x2) * (wrist_x - x2) + (wrist_y - y2) * (wrist_y - y2)) m2 FROM l),
 g AS (SELECT *, max(CASE WHEN entered THEN t_h END) OVER (PARTITION BY clip_id, actor_id ORDER BY t_h, sample_index ROWS UNBOUNDED PRECEDING) entry FROM e)
 SELECT sample_index, clip_id, entered, CASE WHEN inside THEN t_h - entry ELSE 0 END AS dwell_s, round(CASE WHEN t_h > lt THEN sqrt((wrist_x - x1) * (wrist_x - x1) + (wrist_y - y1) * (wrist_y - y1)) / (t_h - lt) ELSE 0 END, 6) AS speed, coalesce(m1 > 1e-9 AND m2 > 1e-9 AND ((x2 - x4) * (wrist_x - x2) + (y2 - y4) * (wrist_y - y2)) / CASE WHEN m1 * m2 > 0 THEN m1 * m2 END < -0.5, false) AS reversal FROM g""")
def region_measurements(spark, sf):
    return trajectories.region_measurements(_pose(spark, sf), _TRACK).select("sample_index", "clip_id", "entered", "dwell_s", F.round("speed", 6).alias("speed"), "reversal")


@query(""", d AS (SELECT clip_id, actor_id, t_h - lag(t_h) OVER (PARTITION BY clip_id, actor_id ORDER BY t_h) x FROM fx_pose), s AS (SELECT clip_id, actor_id, list(x ORDER BY x) FILTER (WHERE x > 0) xs FROM d GROUP BY ALL)
 SELECT clip_id, actor_id, greatest(0.75e0, least(40e0, 1.5e0 * xs[len(xs) // 2 + 1])) AS gap FROM s""")
def cadence_gap(spark, sf):
    return trajectories.cadence_gap(view(spark, sf, "fx_pose"), _TRACK, most=40.0)


@query(_POSE + """, c AS (SELECT clip_id, actor_id, t_h, bool_or(inside AND wrist_confidence >= 0.1) ok, max(wrist_confidence) confidence FROM o GROUP BY ALL),
 a AS (SELECT *, lag(t_h) OVER w bt, lag(ok) OVER w bok FROM c WINDOW w AS (PARTITION BY clip_id, actor_id ORDER BY t_h)),
 b AS (SELECT *, sum(CASE WHEN t_h - bt > 60 THEN 1 ELSE 0 END) OVER (PARTITION BY clip_id, actor_id ORDER BY t_h ROWS UNBOUNDED PRECEDING) st FROM a),
 q AS (SELECT *, lag(t_h) OVER w lt, lag(st) OVER w ls FROM b WHERE ok WINDOW w AS (PARTITION BY clip_id, actor_id ORDER BY t_h)),
 i AS (SELECT *, sum(CASE WHEN lt IS NULL OR ls <> st OR (NOT bok AND bt - lt > 8) THEN 1 ELSE 0 END) OVER (PARTITION BY clip_id, actor_id ORDER BY t_h ROWS UNBOUNDED PRECEDING) isl FROM q)
 SELECT clip_id, actor_id, min(t_h) t_start, max(t_h) t_end, count(*) n_rows, round(avg(confidence), 9) mean_confidence FROM i GROUP BY clip_id, actor_id, isl HAVING max(t_h) - min(t_h) >= 2""")
def raw_interactions(spark, sf):
    obs = _pose(spark, sf).withColumnRenamed("wrist_confidence", "confidence")
    return trajectories.raw_interactions(obs, _TRACK, max_gap=60.0, tolerance=8.0, min_duration=2.0).withColumn("mean_confidence", F.round("mean_confidence", 9))


@query(""", o AS (SELECT *, wrist_x < 300 AND wrist_y < 300 AS inside, abs(wrist_x - 150) + abs(wrist_y - 150) AS distance FROM fx_pose), l AS (SELECT *, lag(inside) OVER (PARTITION BY clip_id, actor_id ORDER BY t_h, sample_index) li FROM o)
 SELECT clip_id, actor_id, coalesce(min(t_h) FILTER (WHERE inside AND NOT li), min(t_h) FILTER (WHERE inside), first(t_h ORDER BY distance, t_h)) AS contact_s FROM l GROUP BY clip_id, actor_id""")
def contact_time(spark, sf):
    x, y = F.col("wrist_x"), F.col("wrist_y")
    obs = view(spark, sf, "fx_pose").withColumns({"inside": (x < 300) & (y < 300), "distance": F.abs(x - 150) + F.abs(y - 150)})
    return trajectories.contact_time(obs, _TRACK)


@query(_MATCH + """, h AS (SELECT p.*, p.pred_id IN (SELECT pred_id FROM m) hit FROM fx_pred p), r AS (SELECT *, row_number() OVER w rk, sum(CASE WHEN hit THEN 1 ELSE 0 END) OVER (w ROWS UNBOUNDED PRECEDING) tp FROM h WINDOW w AS (PARTITION BY type ORDER BY score DESC, t_start, t_end, clip_id, pred_id)),
 e AS (SELECT *, max(tp / CAST(rk AS DOUBLE)) OVER (PARTITION BY type ORDER BY rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) env FROM r), s AS (SELECT type, count(*) n_pred, sum(env) FILTER (WHERE hit) area FROM e GROUP BY type)
 SELECT s.type, n_gt, n_pred, round(area / n_gt, 9) AS ap FROM s JOIN (SELECT type, count(*) n_gt FROM fx_gt GROUP BY type) g ON g.type = s.type""")
def average_precision(spark, sf):
    return precision.average_precision(view(spark, sf, "fx_gt"), view(spark, sf, "fx_pred")).withColumn("ap", F.round("ap", 9))


@query(""", b AS (SELECT crop_id, list_reduce(list_prepend(0, list_transform(string_split(sha256(concat('42:', crop_id)), ''), lambda c: instr('0123456789abcdef', c) - 1)), lambda a, d: (a * 16 + d) % 10000) AS bucket FROM fx_features WHERE label = 'negative'),
 r AS (SELECT *, row_number() OVER (ORDER BY bucket, crop_id) n, count(*) OVER () c FROM b) SELECT crop_id, CAST(bucket AS BIGINT) AS bucket FROM r WHERE n <= greatest(1, ceil(0.1 * c))""")
def qa_sample(spark, sf):
    return sampling.qa_sample(view(spark, sf, "fx_features").filter("label = 'negative'").select("crop_id"), "crop_id", 0.1)


@query(""", o AS (SELECT sample_index, clip_id, CAST(CAST(floor(t_h / 24) AS BIGINT) AS VARCHAR) AS day FROM fx_obs), d AS (SELECT day, row_number() OVER (ORDER BY sha256(concat('42:', day))) r, count(*) OVER () n FROM (SELECT DISTINCT day FROM o))
 SELECT sample_index, clip_id, o.day, CASE WHEN r <= greatest(1, round_even(n * 0.7, 0)) THEN 'train' WHEN r <= greatest(1, round_even(n * 0.7, 0)) + round_even(n * 0.15, 0) THEN 'val' ELSE 'test' END AS split FROM o JOIN d ON o.day = d.day""")
def split_by_day(spark, sf):
    obs = view(spark, sf, "fx_obs").select("sample_index", "clip_id", F.floor(F.col("t_h") / 24).cast("string").alias("day"))
    return sampling.split_by_day(obs, "day")


@query(" SELECT crop_id, label FROM fx_features WHERE vec_id % 3 = 0 UNION ALL SELECT crop_id, label FROM fx_features WHERE vec_id % 3 <> 0 AND label <> 'negative'")
def append_manifest(spark, sf):
    f = view(spark, sf, "fx_features")
    old = f.filter("vec_id % 3 = 0").select("crop_id", "label")
    return old.unionByName(tables.append_unseen(f.filter("vec_id % 3 = 0 or label <> 'negative'").select("crop_id", "label"), old))


@query(" SELECT crop_id FROM fx_features WHERE split = 'train' AND label IN ('pickup', 'putdown') AND clip_id IN (SELECT clip_id FROM fx_clips)")
def filter_manifest(spark, sf):
    return tables.filter_manifest(view(spark, sf, "fx_features"), view(spark, sf, "fx_clips"), split="train", label=["pickup", "putdown"]).select("crop_id")


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
