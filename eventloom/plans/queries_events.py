"""Queries over candidates, windows, decoding and metrics, each with the same rows in DuckDB where SQL can express it."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventloom.functions.geometry import expand_polygon
from eventloom.operators import candidates, dataset, decode, evaluate, lookups, precision, windows
from eventloom.plans.fixtures import view
from eventloom.plans.registry import query


@query(" SELECT sample_index FROM fx_obs WHERE confidence >= 0.3")
def filter_observations(spark, sf):
    return candidates.filter_observations(view(spark, sf, "fx_obs"), 0.3).select("sample_index")


_GENERATED = """, o AS (SELECT *, max(end_s) OVER (PARTITION BY clip_id, actor_id, hand_side, region_id ORDER BY start_s, end_s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) pm FROM fx_raw),
 i AS (SELECT *, sum(CASE WHEN pm IS NULL OR start_s - pm > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY clip_id, actor_id, hand_side, region_id ORDER BY start_s, end_s) g FROM o),
 m AS (SELECT clip_id, actor_id, hand_side, region_id, g, greatest(0e0, min(start_s)) lo, least(400e0, max(end_s)) hi, count(*) n, min(mean_distance) d, max(mean_confidence) c, sum(end_s - start_s) w FROM i GROUP BY ALL HAVING least(400e0, max(end_s)) > greatest(0e0, min(start_s))),
 b AS (SELECT *, least(2e0, lo) db, least(2e0, greatest(0e0, 400e0 - hi)) da, greatest(0e0, 6e0 - (hi - lo)) budget FROM m),
 f AS (SELECT *, CASE WHEN da + db <= budget THEN db ELSE least(db, CASE WHEN da + db > 0 THEN budget * db / (da + db) ELSE 0 END) END fst FROM b)
 SELECT concat('cand_', substr(sha256(concat_ws(chr(31), clip_id, actor_id, hand_side, region_id, CAST(CAST(round_even(lo * 1000000, 0) AS BIGINT) AS VARCHAR), CAST(CAST(round_even(hi * 1000000, 0) AS BIGINT) AS VARCHAR))), 1, 12)) candidate_id, clip_id, actor_id, region_id,
 round(lo, 4) raw_start_s, round(hi, 4) raw_end_s, round_even((lo - fst) * 10000, 0) / 10000 window_start_s, round_even((hi + CASE WHEN da + db <= budget THEN da ELSE least(da, budget - fst) END) * 10000, 0) / 10000 window_end_s, n n_raw_interactions, d min_region_distance, c max_wrist_confidence, w total_dwell_duration_s FROM f"""


@query(_GENERATED)
def generate_candidates(spark, sf):
    clips = view(spark, sf, "fx_clips").withColumn("duration_s", F.lit(400.0))
    return candidates.generate_candidates(view(spark, sf, "fx_raw"), clips, cap=6.0).drop("hand_side", "proposal_score")


_TRAIL = """, k AS (SELECT candidate_id, clip_id, CASE WHEN raw_start_s % 30 = 0 THEN concat(actor_id, ':x') ELSE actor_id END actor_id, hand_side, window_start_s % 700 ws, window_start_s % 700 + 24 we FROM fx_candidates),
 n AS (SELECT candidate_id, k.actor_id ka, p.* FROM k JOIN fx_pose p ON p.clip_id = k.clip_id AND p.hand_side = k.hand_side AND t_h BETWEEN ws AND we)
 SELECT candidate_id, sample_index, t_h FROM n WHERE ka = actor_id OR (contains(ka, ':') AND candidate_id NOT IN (SELECT candidate_id FROM n WHERE ka = actor_id))"""


@query(_TRAIL)
def trajectory_for_candidate(spark, sf):
    s = F.col("window_start_s") % 700
    k = view(spark, sf, "fx_candidates").withColumns({"actor_id": F.when(F.col("raw_start_s") % 30 == 0, F.concat("actor_id", F.lit(":x"))).otherwise(F.col("actor_id")), "window_end_s": s + 24, "window_start_s": s})
    return candidates.trajectory_for_candidate(k, view(spark, sf, "fx_pose")).select("candidate_id", "sample_index", "t_h")


@query(", n AS (SELECT o.sample_index, b.person_id actor, abs(b.t_h - o.t_h - 0.7e0) gap, b.t_h t, x1, y1 FROM fx_obs o JOIN fx_boxes b ON b.clip_id = o.clip_id AND abs(b.t_h - (o.t_h + 0.7e0)) <= 5), r AS (SELECT *, row_number() OVER (PARTITION BY sample_index, actor ORDER BY gap, t, x1, y1) rn FROM (SELECT o.sample_index, b.person_id actor, abs(b.t_h - (o.t_h + 0.7e0)) gap, b.t_h t, x1, y1 FROM fx_obs o JOIN fx_boxes b ON b.clip_id = o.clip_id AND abs(b.t_h - (o.t_h + 0.7e0)) <= 5)) SELECT sample_index, actor, t, x1, y1 FROM r WHERE rn = 1")
def nearest_people(spark, sf):
    poses = view(spark, sf, "fx_obs").select("clip_id", "sample_index", (F.col("t_h") + 0.7).alias("t_h"))
    return candidates.nearest_people(poses, view(spark, sf, "fx_boxes"), "sample_index", 5.0).select("sample_index", "actor", "t", "x1", "y1")


@query()
def associate_actors(spark, sf):
    b = view(spark, sf, "fx_boxes")
    poses = b.select("clip_id", "sample_index", "frame", "t_h", "actor_id", (F.col("x1") + 20).alias("px1"), "y1", "x2", "y2").withColumnsRenamed({"y1": "py1", "x2": "px2", "y2": "py2"})
    return candidates.associate_actors(poses, b, gap=6.0, least=0.15).select("sample_index", "actor_id", F.round("association", 6).alias("association"))


@query(""", s AS (SELECT sample_index, CAST(x1 AS INT) x, CAST(y1 AS INT) y, CASE WHEN frame = 0 THEN 224 ELSE greatest(64, least(CAST(trunc((y2 - y1 + frame * 300) * 0.4e0) AS INT), 448)) END z FROM fx_boxes),
 a AS (SELECT sample_index, z, greatest(least(greatest(x - z // 2, 0), 1100 - z), 0) px, greatest(least(greatest(y - z // 2, 0), 400 - z), 0) py FROM s) SELECT sample_index, px x, py y, least(px + z, 1100) - px width, least(py + z, 400) - py height FROM a""")
def crop_squares(spark, sf):
    height = F.when(F.col("frame") > 0, F.col("y2") - F.col("y1") + F.col("frame") * 300)
    return view(spark, sf, "fx_boxes").select("sample_index", candidates.crop_square(F.col("x1"), F.col("y1"), height, 1100, 400).alias("c")).select("sample_index", "c.*")


@query(""", k AS (SELECT candidate_id, clip_id, actor_id, region_id, window_start_s % 700 ws, window_start_s % 700 + 40 we FROM fx_candidates), u AS (SELECT candidate_id, region_id, min(x1) x1, min(y1) y1, max(x2) x2, max(y2) y2 FROM k JOIN fx_boxes b ON b.clip_id = k.clip_id AND b.actor_id = k.actor_id AND t_h BETWEEN ws AND we GROUP BY ALL),
 v AS (SELECT candidate_id, CASE WHEN region_id = 'region_0' THEN least(x1, 100e0) ELSE x1 END x1, CASE WHEN region_id = 'region_0' THEN least(y1, 100e0) ELSE y1 END y1, CASE WHEN region_id = 'region_0' THEN greatest(x2, 500e0) ELSE x2 END x2, CASE WHEN region_id = 'region_0' THEN greatest(y2, 500e0) ELSE y2 END y2 FROM u)
 SELECT candidate_id, greatest(0, CAST(trunc(x1 - (x2 - x1) * 0.15e0) AS INT)) x1, greatest(0, CAST(trunc(y1 - (y2 - y1) * 0.15e0) AS INT)) y1, least(1000, CAST(trunc(x2 + (x2 - x1) * 0.15e0) AS INT)) x2, least(1200, CAST(trunc(y2 + (y2 - y1) * 0.15e0) AS INT)) y2 FROM v""")
def crop_boxes(spark, sf):
    s = F.col("window_start_s") % 700
    k = view(spark, sf, "fx_candidates").select("candidate_id", "clip_id", "actor_id", "region_id", s.alias("window_start_s"), (s + 40).alias("window_end_s"))
    poses = view(spark, sf, "fx_boxes").withColumnsRenamed({c: f"p{c}" for c in ("x1", "y1", "x2", "y2")})
    bounds = spark.createDataFrame([("region_0", 100.0, 100.0, 500.0, 500.0)], "region_id string, rx1 double, ry1 double, rx2 double, ry2 double")
    return candidates.crop_boxes(k, poses, bounds, 1000, 1200)


@query(", e AS (SELECT sample_index, 200 / CAST(1 AS DOUBLE) w, x1, y1, x2, y2, (x1 + x2 + x2) / 3 cx, (y1 + y1 + y2) / 3 cy FROM fx_boxes), d AS (SELECT *, sqrt((x2 - cx) * (x2 - cx) + (y2 - cy) * (y2 - cy)) r FROM e) SELECT sample_index, round(greatest(0e0, least(1099e0, cx + (x2 - cx) * ((r + 25) / r))), 6) x, round(greatest(0e0, least(1299e0, cy + (y2 - cy) * ((r + 25) / r))), 6) y FROM d")
def expand_polygons(spark, sf):
    at = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    moved = expand_polygon(F.array(at("x1", "y1"), at("x2", "y1"), at("x2", "y2")), 25.0, 1100.0, 1300.0)
    return view(spark, sf, "fx_boxes").select("sample_index", F.get(moved, F.lit(2)).alias("p")).select("sample_index", F.round("p.x", 6).alias("x"), F.round("p.y", 6).alias("y"))


@query()
def span_windows(spark, sf):
    s = view(spark, sf, "fx_gt").select("event_id", "t_start", (F.col("t_start") + (F.col("t_end") - F.col("t_start")) * 9).alias("t_end"))
    return s.select("event_id", F.posexplode(windows.span_windows(F.col("t_start"), F.col("t_end"))).alias("k", "w")).select("event_id", "k", F.col("w.s").alias("window_start_s"), F.col("w.e").alias("window_end_s"))


@query(""", c AS (SELECT candidate_id, raw_start_s a, raw_end_s + 2 b, CASE WHEN raw_start_s % 30 = 0 THEN raw_start_s WHEN raw_start_s % 40 = 0 THEN raw_end_s + 2 ELSE raw_start_s + 0.75 END x FROM fx_candidates), g AS (SELECT candidate_id, a p, x q, 0 o FROM c UNION ALL SELECT candidate_id, x, b, 1 FROM c),
 m AS (SELECT candidate_id, p, q, CAST(ceil((q - p) / 1e0) AS INT) n FROM g WHERE q - p > 1), t AS (SELECT candidate_id, p + i * ((q - p) / n) AS t, 'mid' AS position FROM (SELECT *, unnest(range(1, n)) i FROM m))
 SELECT * FROM t UNION ALL SELECT candidate_id, a, 'pre' FROM c UNION ALL SELECT candidate_id, x, 'contact' FROM c WHERE x > a + 1e-6 UNION ALL SELECT candidate_id, b, 'post' FROM c WHERE abs(x - b) > 1e-6""")
def adaptive_times(spark, sf):
    a, b = F.col("raw_start_s"), F.col("raw_end_s") + 2
    contact = F.when(a % 30 == 0, a).when(a % 40 == 0, b).otherwise(a + 0.75)
    return view(spark, sf, "fx_candidates").select("candidate_id", F.explode(windows.adaptive_times(a, b, contact)).alias("p")).select("candidate_id", "p.t", "p.position")


@query(" SELECT event_id, CAST(unnest(list_distinct(list_transform(range(0, CAST(ceil((t_end - t_start) * 20 / 2.5e0) AS INT) + 1), lambda i: CASE WHEN CAST(round_even(i * 2.5e0, 0) AS BIGINT) < (t_end - t_start) * 20 THEN CAST(round_even(i * 2.5e0, 0) AS BIGINT) ELSE 0 END))) AS BIGINT) AS frame FROM fx_gt")
def sampled_frames(spark, sf):
    total = (F.col("t_end") - F.col("t_start")) * 20
    return view(spark, sf, "fx_gt").select("event_id", F.explode(windows.frames_at_rate(total, 20.0, 8.0)).alias("frame"))


@query(" SELECT event_id, unnest(list_transform(range(0, 5), lambda i: CAST(floor(CAST(trunc(t_start * 20) AS INT) + i * ((greatest(CAST(trunc(t_end * 20) AS INT), CAST(trunc(t_start * 20) AS INT) + 1) - 1 - CAST(trunc(t_start * 20) AS INT)) / 4e0)) AS INT))) AS frame FROM fx_gt")
def spaced_frames(spark, sf):
    return view(spark, sf, "fx_gt").select("event_id", F.explode(windows.frames_between(F.col("t_start"), F.col("t_end"), 5, 20.0)).alias("frame"))


_REFINED = """, x AS (SELECT pred_id, t_start s0, t_end e0, t_start + score * 3 - 0.5 tr, t_start + 0.25 ws, t_end - 0.75 we, 5e0 ca, 300000e0 cb FROM fx_pred),
 y AS (SELECT *, least(greatest(s0, ca, ws - 0.5), tr) s1, greatest(least(e0, we + 0.5, cb), tr) e1 FROM x), z AS (SELECT *, CASE WHEN e1 - s1 < 0.1 THEN (s1 + e1) / 2 - 0.05 ELSE s1 END s2, CASE WHEN e1 - s1 < 0.1 THEN (s1 + e1) / 2 + 0.05 ELSE e1 END e2 FROM y),
 v AS (SELECT *, greatest(s2, ca) s3, least(e2, cb) e3 FROM z) SELECT pred_id, round(CASE WHEN s3 >= e3 THEN tr - 0.05 ELSE s3 END, 3) t_start, round(CASE WHEN s3 >= e3 THEN tr + 0.05 ELSE e3 END, 3) t_end FROM v"""


@query(_REFINED)
def refine_boundaries(spark, sf):
    s, e = F.col("t_start"), F.col("t_end")
    a, b = decode.refine_boundaries(s, e, s + F.col("score") * 3 - 0.5, (s + 0.25, e - 0.75), (F.lit(5.0), F.lit(300000.0)))
    return view(spark, sf, "fx_pred").select("pred_id", F.round(a, 3).alias("t_start"), F.round(b, 3).alias("t_end"))


def _crowded(spark, sf):
    p = view(spark, sf, "fx_pred_dense")
    back = F.floor(F.col("t_start") / 24) * 24
    p = p.withColumns({"t_start": F.col("t_start") - back, "t_end": F.col("t_end") - back})
    return p.withColumn("transfer_s", (F.col("t_start") + F.col("t_end")) / 2)


# the greedy rule row by row: r walks the ranks of a (clip, type) and carries the list of kept rows
_NMS = """ /* recursive */, c AS (
   SELECT pred_id, clip_id, type, score, t_start - floor(t_start / 24) * 24 AS s, t_end - floor(t_start / 24) * 24 AS e FROM fx_pred_dense),
 n AS (
   SELECT *, {'p': pred_id, 's': s, 'e': e} AS v, row_number() OVER (PARTITION BY clip_id, type ORDER BY score DESC, s, pred_id) AS rn FROM c),
 r AS (
   SELECT clip_id, type, rn, pred_id, s, e, score, CAST(NULL AS VARCHAR) AS killer, [v] AS kept FROM n WHERE rn = 1
   UNION ALL
   SELECT clip_id, type, rn, pred_id, s, e, score, killer, CASE WHEN killer IS NULL THEN list_append(kept, v) ELSE kept END FROM (
     SELECT n.*, r.kept, list_filter(r.kept, lambda k: least(k.e, n.e) > greatest(k.s, n.s)
       AND (least(k.e, n.e) - greatest(k.s, n.s)) / ((k.e - k.s) + (n.e - n.s) - (least(k.e, n.e) - greatest(k.s, n.s))) >= 0.5
       AND abs((k.s + k.e) / 2 - (n.s + n.e) / 2) <= 0.5)[1].p AS killer
     FROM r JOIN n ON n.clip_id = r.clip_id AND n.type = r.type AND n.rn = r.rn + 1)) """


@query(_NMS + "SELECT pred_id, clip_id, type, s AS t_start, e AS t_end, score FROM r WHERE killer IS NULL")
def temporal_nms(spark, sf):
    return decode.temporal_nms(_crowded(spark, sf))[0].select("pred_id", "clip_id", "type", "t_start", "t_end", "score")


@query(_NMS + "SELECT pred_id AS dropped, killer AS kept FROM r WHERE killer IS NOT NULL")
def nms_audit(spark, sf):
    return decode.temporal_nms(_crowded(spark, sf))[1]


@query()
def decode_events(spark, sf):
    out = decode.decode_events(view(spark, sf, "fx_window_scores"))
    return out.withColumns({c: F.round(c, 9) for c in ("peak", "mean")})


_PAIRS = """, x AS (SELECT g.clip_id, g.type, event_id, pred_id, p.type AS predicted, score, g.t_start gs, g.t_end ge, p.t_start ps, p.t_end pe, greatest(0e0, least(g.t_end, p.t_end) - greatest(g.t_start, p.t_start)) / ((g.t_end - g.t_start) + (p.t_end - p.t_start) - greatest(0e0, least(g.t_end, p.t_end) - greatest(g.t_start, p.t_start))) q,
 abs((g.t_start + g.t_end) / 2 - (p.t_start + p.t_end) / 2) d FROM fx_gt g JOIN fx_pred p ON g.clip_id = p.clip_id AND g.type = p.type AND abs((g.t_start + g.t_end) / 2 - (p.t_start + p.t_end) / 2) <= 4) """
_OUT = """, st AS (SELECT CASE WHEN pred_id IS NULL THEN 'fn' ELSE 'tp' END status, g.clip_id, g.type, g.event_id, pred_id FROM {0} g LEFT JOIN m ON g.event_id = m.event_id
 UNION ALL SELECT 'fp', clip_id, type, NULL, pred_id FROM {1} p WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.pred_id = p.pred_id)) SELECT * FROM st"""
_IGNORED = ", gi AS (SELECT * FROM fx_gt g WHERE NOT EXISTS (SELECT 1 FROM fx_ignore i WHERE i.clip_id = g.clip_id AND g.t_start < i.t_end AND i.t_start < g.t_end)), pi AS (SELECT * FROM fx_pred g WHERE NOT EXISTS (SELECT 1 FROM fx_ignore i WHERE i.clip_id = g.clip_id AND g.t_start < i.t_end AND i.t_start < g.t_end)), m AS (SELECT x.* FROM x JOIN gi ON gi.event_id = x.event_id JOIN pi ON pi.pred_id = x.pred_id WHERE q >= 0.5)"


@query(_PAIRS + ", m AS (SELECT * FROM x WHERE q >= 0.5)" + _OUT.format("fx_gt", "fx_pred"))
def evaluate_ranked(spark, sf):
    return evaluate.class_aware(view(spark, sf, "fx_gt"), view(spark, sf, "fx_pred"), matcher="ranked")


@query(_PAIRS + ", m AS (SELECT * FROM x WHERE d <= 1)" + _OUT.format("fx_gt", "fx_pred"))
def evaluate_midpoint(spark, sf):
    return evaluate.class_aware(view(spark, sf, "fx_gt"), view(spark, sf, "fx_pred"), 1.0, criterion="midpoint")


@query(_PAIRS + _IGNORED + _OUT.format("gi", "pi"))
def evaluate_without_ignored(spark, sf):
    return evaluate.class_aware(view(spark, sf, "fx_gt"), view(spark, sf, "fx_pred"), ignores=view(spark, sf, "fx_ignore"))


_N = "(SELECT count(*) FROM fx_gt) ng, (SELECT count(*) FROM fx_pred) np"
_CELLS = "[('tp', tp), ('fp', np - tp), ('fn', ng - tp), ('precision', tp / np), ('recall', tp / ng), ('f1', 2 * tp / (np + ng))]"


@query(_PAIRS + f""", h AS (SELECT 'tiou@0.3' AS name, CAST(count(*) FILTER (WHERE q >= 0.3) AS DOUBLE) tp, {_N} FROM x UNION ALL SELECT 'tiou@0.5', count(*) FILTER (WHERE q >= 0.5), {_N} FROM x UNION ALL SELECT 'midpoint@1.0s', count(*) FILTER (WHERE d <= 1), {_N} FROM x),
 c AS (SELECT name, unnest({_CELLS}) AS u FROM h), n AS (SELECT sum(d) d FROM (SELECT clip_id, 1 d FROM fx_gt UNION ALL SELECT clip_id, -1 FROM fx_pred) GROUP BY clip_id),
 r AS (SELECT concat(name, ' ', u[1]) AS metric, CAST(u[2] AS DOUBLE) AS value FROM c UNION ALL SELECT 'start_mae_s', avg(abs(gs - ps)) FROM x WHERE d <= 1 UNION ALL SELECT 'end_mae_s', avg(abs(ge - pe)) FROM x WHERE d <= 1
 UNION ALL SELECT 'fp_per_hour', (np - tp) / ((SELECT sum(duration_s) FROM fx_clips) / 3600) FROM h WHERE name = 'tiou@0.5' UNION ALL SELECT 'event_count_error_per_clip', sum(abs(d)) FROM n UNION ALL SELECT 'event_count_error_absolute', abs(sum(d)) FROM n UNION ALL SELECT 'multi_item_recall', NULL UNION ALL SELECT 'multi_item_support', 0) SELECT metric, round(value, 9) AS value FROM r""".replace(f"unnest({_CELLS}) AS u", "unnest([{'m': 'tp', 'v': tp}, {'m': 'fp', 'v': np - tp}, {'m': 'fn', 'v': ng - tp}, {'m': 'precision', 'v': tp / np}, {'m': 'recall', 'v': tp / ng}, {'m': 'f1', 'v': 2 * tp / (np + ng)}]) AS u").replace("u[1]", "u.m").replace("u[2]", "u.v"))
def metric_bundle(spark, sf):
    out = evaluate.metric_bundle(view(spark, sf, "fx_gt"), view(spark, sf, "fx_pred"), view(spark, sf, "fx_clips"))
    return out.withColumn("value", F.round("value", 9))


@query(""", k AS (SELECT unnest([0.3e0, 0.5e0, 0.7e0]) threshold), x AS (SELECT pred_id, greatest(0e0, least(g.t_end, p.t_end) - greatest(g.t_start, p.t_start)) / ((g.t_end - g.t_start) + (p.t_end - p.t_start) - greatest(0e0, least(g.t_end, p.t_end) - greatest(g.t_start, p.t_start))) q FROM fx_gt g JOIN fx_pred p ON g.clip_id = p.clip_id AND g.type = p.type AND g.t_start < p.t_end AND p.t_start < g.t_end),
 h AS (SELECT threshold, p.*, EXISTS (SELECT 1 FROM x WHERE x.pred_id = p.pred_id AND q >= threshold) hit FROM fx_pred p, k), r AS (SELECT *, row_number() OVER w rk, sum(CASE WHEN hit THEN 1 ELSE 0 END) OVER (w ROWS UNBOUNDED PRECEDING) tp FROM h WINDOW w AS (PARTITION BY threshold, type ORDER BY score DESC, t_start, t_end, clip_id, pred_id)),
 e AS (SELECT *, max(tp / CAST(rk AS DOUBLE)) OVER (PARTITION BY threshold, type ORDER BY rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) env FROM r), s AS (SELECT threshold, type, sum(env) FILTER (WHERE hit) area FROM e GROUP BY ALL)
 SELECT threshold, round(avg(coalesce(area, 0) / n), 9) AS map FROM s JOIN (SELECT type, count(*) n FROM fx_gt GROUP BY type) g ON g.type = s.type GROUP BY threshold""")
def mean_precision(spark, sf):
    return precision.mean_precision(view(spark, sf, "fx_gt"), view(spark, sf, "fx_pred")).withColumn("map", F.round("map", 9))


@query(", e AS (SELECT *, CAST(t_start AS BIGINT) // 20 % 5 s FROM fx_gt), u AS (SELECT event_id, count(*) OVER (PARTITION BY clip_id, type, confidence, s) n FROM e) SELECT event_id FROM u WHERE n > 1")
def multi_item_events(spark, sf):
    s = F.floor(F.col("t_start") / 20) % 5
    e = view(spark, sf, "fx_gt").withColumns({"t_start": s.cast("double"), "event_group_id": F.when(F.col("confidence") != "med", F.concat_ws("/", "confidence", s.cast("string"))), "t_end": s + 1.0})
    return evaluate.multi_item_events(e).select("event_id")


# groups: the next row starts before the running end or after the previous row's end by at most the gap; pieces: the union of a group's intervals
MERGED = """, o AS (
   SELECT *, t_start < max(t_end) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
     OR (t_start - lag(t_end) OVER w > 0 AND t_start - lag(t_end) OVER w <= {gap}) AS go
   FROM {rows} WHERE type <> 'no_event' WINDOW w AS (PARTITION BY clip_id, type ORDER BY t_start, t_end, pred_id)),
 g AS (
   SELECT *, sum(CASE WHEN go THEN 0 ELSE 1 END) OVER (PARTITION BY clip_id, type ORDER BY t_start, t_end, pred_id ROWS UNBOUNDED PRECEDING) AS gr FROM o),
 e AS (
   SELECT *, max(t_end) OVER (PARTITION BY clip_id, type, gr ORDER BY t_start, t_end, pred_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS so_far FROM g),
 q AS (
   SELECT *, sum(CASE WHEN so_far IS NULL OR t_start > so_far THEN 1 ELSE 0 END)
     OVER (PARTITION BY clip_id, type, gr ORDER BY t_start, t_end, pred_id ROWS UNBOUNDED PRECEDING) AS piece FROM e),
 whole AS (
   SELECT clip_id, type, gr, max(score) AS score, string_agg(pred_id, ',' ORDER BY pred_id) AS pred_ids, max(items) AS items FROM g GROUP BY clip_id, type, gr),
 pieces AS (SELECT clip_id, type, gr, piece, min(t_start) AS t_start, max(t_end) AS t_end FROM q GROUP BY clip_id, type, gr, piece),
 merged AS (SELECT p.clip_id, p.type, p.t_start, p.t_end, w.score, w.pred_ids, w.items FROM pieces p JOIN whole w USING (clip_id, type, gr)) """
ITEMS = ", items AS (SELECT *, greatest(1, CAST(score * 100 AS BIGINT) % 3) AS items FROM fx_pred)"


def with_items(spark, sf):
    items = F.greatest(F.lit(1), (F.bround(F.col("score") * 100).cast("long") % 3).cast("int"))
    return view(spark, sf, "fx_pred").withColumn("items", items)


@query(
    ITEMS
    + MERGED.format(gap=1, rows="items")
    + """, m AS (
   SELECT DISTINCT g.event_id, g.type FROM fx_gt g JOIN merged p ON p.clip_id = g.clip_id AND p.type = g.type AND g.t_start < p.t_end AND p.t_start < g.t_end
   WHERE (least(g.t_end, p.t_end) - greatest(g.t_start, p.t_start))
     / ((g.t_end - g.t_start) + (p.t_end - p.t_start) - (least(g.t_end, p.t_end) - greatest(g.t_start, p.t_start))) >= 0.5),
 k AS (
   SELECT t.type, (SELECT count(*) FROM m WHERE m.type = t.type) AS tp, (SELECT CAST(sum(items) AS BIGINT) FROM merged p WHERE p.type = t.type) AS np,
     (SELECT count(*) FROM fx_gt g WHERE g.type = t.type) AS ng FROM (SELECT unnest(['pickup', 'putdown']) AS type) t)
 SELECT type, tp, np - tp AS fp, ng - tp AS fn, round(tp / np, 4) AS precision, round(tp / ng, 4) AS recall, round(2 * tp / (np + ng), 4) AS f1 FROM k"""
)
def evaluate_merged(spark, sf):
    return evaluate.evaluate_merged(with_items(spark, sf), view(spark, sf, "fx_gt"))


_OVERLAP = "(least(g.t_end, p.t_end) - greatest(g.t_start, p.t_start))"
_ACCEPTED = f""", a AS (
   SELECT g.event_id, p.pred_id, g.clip_id, g.type, p.type AS pred_type, g.t_start, g.t_end FROM fx_gt g JOIN fx_pred p ON g.clip_id = p.clip_id AND g.t_start < p.t_end AND p.t_start < g.t_end
   WHERE {_OVERLAP} / ((g.t_end - g.t_start) + (p.t_end - p.t_start) - {_OVERLAP}) >= 0.5)"""


@query(
    _ACCEPTED
    + """, own AS (SELECT * FROM a WHERE type = pred_type)
 SELECT 'false_negative' AS category, clip_id, type, NULL AS pred_type, event_id, NULL AS pred_id, t_start, t_end, CAST(NULL AS DOUBLE) AS score
   FROM fx_gt WHERE event_id NOT IN (SELECT event_id FROM own)
 UNION ALL SELECT 'false_positive', clip_id, NULL, type, NULL, pred_id, t_start, t_end, score FROM fx_pred WHERE pred_id NOT IN (SELECT pred_id FROM own)
 UNION ALL SELECT 'type_confusion', clip_id, type, pred_type, event_id, pred_id, t_start, t_end, NULL FROM a WHERE type <> pred_type"""
)
def gallery_with_confusions(spark, sf):
    return evaluate.gallery(view(spark, sf, "fx_gt"), view(spark, sf, "fx_pred"))


_PEOPLE = """, tg AS (SELECT *, t_h - lag(t_h) OVER (PARTITION BY clip_id, track_key ORDER BY t_h, sample_index) AS gap FROM fx_obs),
 tr AS (SELECT *, sum(CASE WHEN gap > 48 THEN 1 ELSE 0 END) OVER (PARTITION BY clip_id, track_key ORDER BY t_h, sample_index ROWS UNBOUNDED PRECEDING) AS run FROM tg),
 tracks AS (SELECT clip_id, track_key, run, min(t_h) AS a, max(t_h) AS b FROM tr GROUP BY ALL),
 ev AS (SELECT event_id, clip_id, t_start % 700 AS s, t_start % 700 + (t_end - t_start) AS e FROM fx_gt),
 points AS (
   SELECT event_id, clip_id, s AS t FROM ev
   UNION SELECT event_id, ev.clip_id, a FROM ev JOIN tracks ON tracks.clip_id = ev.clip_id AND a BETWEEN s AND e),
 live AS (SELECT event_id, t, count(*) AS n FROM points JOIN tracks ON tracks.clip_id = points.clip_id AND t BETWEEN a AND b GROUP BY ALL),
 people AS (SELECT event_id, coalesce(max(n), 0) AS n_person FROM ev LEFT JOIN live USING (event_id) GROUP BY event_id)"""


def _people(spark, sf):
    tracks = dataset.track_summaries(view(spark, sf, "fx_obs"), 48.0, 2, 10.0, 0.2)
    s = F.col("t_start") % 700
    moved = view(spark, sf, "fx_gt").select("event_id", "clip_id", s.alias("t_start"), (s + (F.col("t_end") - F.col("t_start"))).alias("t_end"))
    return evaluate.people_at(moved, tracks).select("event_id", "n_person")


@query(_PEOPLE + " SELECT event_id, n_person FROM people")
def people_at_events(spark, sf):
    return _people(spark, sf)


@query(
    _ACCEPTED
    + _PEOPLE
    + """, z AS (
   SELECT g.*, n_person, g.event_id IN (SELECT event_id FROM a WHERE type = pred_type) AS hit FROM fx_gt g JOIN people USING (event_id)),
 y AS (
   SELECT CASE WHEN confidence IN ('high', 'med') THEN 'high_med_only' ELSE 'low_confidence' END AS slice, hit FROM z
   UNION ALL SELECT 'hard_cases', hit FROM z WHERE hard_case
   UNION ALL SELECT CASE WHEN t_end - t_start < 2 THEN 'short_events' ELSE 'long_events' END, hit FROM z
   UNION ALL SELECT 'multiple_person', hit FROM z WHERE n_person > 1)
 SELECT slice, count(*) FILTER (WHERE hit) AS tp, count(*) FILTER (WHERE NOT hit) AS fn, count(*) AS support, avg(CASE WHEN hit THEN 1e0 ELSE 0 END) AS recall FROM y GROUP BY slice"""
)
def slice_metrics(spark, sf):
    gt = view(spark, sf, "fx_gt").join(_people(spark, sf), "event_id")
    return evaluate.slice_metrics(gt, view(spark, sf, "fx_pred"), short=2.0)


@query(", f AS (SELECT unnest(['false_positive', 'false_negative']) AS category) SELECT category, CASE WHEN category = 'false_positive' THEN (SELECT count(*) FROM fx_pred) - tp ELSE (SELECT count(*) FROM fx_gt) - tp END n FROM f, (SELECT count(*) tp FROM fx_gt g JOIN fx_pred p ON g.clip_id = p.clip_id AND g.type = p.type AND g.t_start < p.t_end AND p.t_start < g.t_end AND greatest(0e0, least(g.t_end, p.t_end) - greatest(g.t_start, p.t_start)) / ((g.t_end - g.t_start) + (p.t_end - p.t_start) - greatest(0e0, least(g.t_end, p.t_end) - greatest(g.t_start, p.t_start))) >= 0.5)")
def failure_categories(spark, sf):
    gt, pred = view(spark, sf, "fx_gt"), view(spark, sf, "fx_pred")
    return lookups.failure_categories(evaluate.class_aware(gt, pred).filter("status <> 'tp'"), gt, pred)
