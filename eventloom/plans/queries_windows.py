"""Queries over proposals, windows, frames, reviews and ledgers, each with the same rows in DuckDB."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventloom.operators import dataset, intervals, lookups, quality, trajectories, windows
from eventloom.plans.fixtures import REGIONS, view
from eventloom.plans.registry import query

_KEYED = "SELECT *, CAST(substr(event_id, 5) AS BIGINT) AS k FROM fx_gt"


@query(
    f""", e AS (
   SELECT event_id, clip_id, t_start, t_end, CASE WHEN k % 5 <> 0 THEN concat('actor_', k % 3) END AS actor_id, CASE WHEN k % 7 <> 0 THEN concat('region_', k % 4) END AS region_id FROM ({_KEYED})),
 p AS (
   SELECT e.event_id, c.candidate_id, c.window_start_s AS a, c.window_end_s AS b, c.region_id AS region, e.actor_id IS NULL OR c.actor_id = e.actor_id AS actor_ok,
     e.region_id IS NULL OR c.region_id = e.region_id AS region_ok, t_start <= raw_end_s AND raw_start_s <= t_end AS raw, t_start <= window_end_s AND window_start_s <= t_end AS padded
   FROM e JOIN fx_candidates c ON c.clip_id = e.clip_id),
 f AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY a, b, candidate_id) AS n FROM p WHERE actor_ok AND region_ok AND (raw OR padded)),
 l AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY a DESC, b DESC, candidate_id DESC) AS n FROM p),
 o AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY a DESC, b DESC, candidate_id DESC) AS n FROM p WHERE actor_ok)
 SELECT e.event_id, f.event_id IS NOT NULL AS covered, CASE WHEN f.raw THEN 'raw' WHEN f.padded THEN 'padded' END AS method, f.candidate_id,
   f.event_id IS NOT NULL OR coalesce(l.actor_ok, false) AS actor_match, CASE WHEN f.event_id IS NOT NULL THEN true ELSE o.region_ok END AS region_match
 FROM e LEFT JOIN f ON f.event_id = e.event_id AND f.n = 1 LEFT JOIN l ON l.event_id = e.event_id AND l.n = 1 LEFT JOIN o ON o.event_id = e.event_id AND o.n = 1"""
)
def proposal_matches(spark, sf):
    k = F.substring("event_id", 5, 20).cast("long")
    of = lambda name, n: F.concat(F.lit(name), (k % n).cast("string"))
    events = view(spark, sf, "fx_gt").withColumns({"actor_id": F.when(k % 5 != 0, of("actor_", 3)), "region_id": F.when(k % 7 != 0, of("region_", 4))})
    return intervals.proposal_matches(events, view(spark, sf, "fx_candidates"), actors=True, regions=True)


_POINTS = ", ".join(f"('{r}', {i}, {len(p)}, {x}e0, {y}e0)" for r, p in REGIONS.items() for i, (x, y) in enumerate(p))
_EXPANDED = f""", v AS (SELECT * FROM (VALUES {_POINTS}) t(region_id, i, n, x, y)),
 m AS (SELECT region_id, sum(x) / count(*) AS mx, sum(y) / count(*) AS my FROM v GROUP BY region_id),
 g AS (SELECT v.*, mx, my, sqrt((x - mx) * (x - mx) + (y - my) * (y - my)) AS r FROM v JOIN m USING (region_id)),
 w AS (SELECT region_id, i, n, greatest(0e0, least(979.5e0, mx + (x - mx) * ((r + 60) / r))) AS x, greatest(0e0, least(939.5e0, my + (y - my) * ((r + 60) / r))) AS y FROM g),
 edge AS (SELECT a.region_id, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_ FROM w a JOIN w b ON b.region_id = a.region_id AND b.i = (a.i + 1) % a.n)"""


@query(
    _EXPANDED
    + """, s AS (
   SELECT sample_index, clip_id, region_id, count(*) FILTER (WHERE (ay > wrist_y) <> (by_ > wrist_y)
     AND wrist_x < (bx - ax) * (wrist_y - ay) / CASE WHEN by_ <> ay THEN by_ - ay ELSE 1e-30 END + ax) % 2 = 1 AS odd FROM fx_pose, edge GROUP BY ALL)
 SELECT sample_index, clip_id, region_id, odd AS inside_expanded FROM s WHERE sample_index % 3 <> 0"""
)
def pose_region_expanded(spark, sf):
    poses = view(spark, sf, "fx_pose").filter("sample_index % 3 <> 0")
    return trajectories.pose_regions(poses, REGIONS, margin=60.0, frame=(980.5, 940.5)).select("sample_index", "clip_id", "region_id", "inside_expanded")


@query(
    """, r AS (
   SELECT v.candidate_id, coalesce(c.clip_id, v.clip_id) AS clip_id, review_status = 'complete' AS reviewed, vlm_status = 'success' AS file, item_count, trim(label) AS label, raw_start_s AS a, raw_end_s AS b
   FROM fx_review v LEFT JOIN fx_candidates c USING (candidate_id)),
 o AS (SELECT *, CASE WHEN NOT reviewed THEN 'excluded_unreviewed' WHEN a IS NULL OR NOT file THEN 'excluded_no_match' WHEN item_count = 0 THEN 'negative' ELSE 'positive' END AS outcome FROM r),
 p AS (
   SELECT candidate_id, event_id, (least(b, t_end) - greatest(a, t_start)) / (t_end - t_start) AS q FROM o JOIN fx_gt g ON g.clip_id = o.clip_id AND a < t_end AND t_start < b WHERE outcome = 'positive'),
 i AS (SELECT candidate_id, string_agg(event_id, ',' ORDER BY q DESC, event_id) AS ids FROM p WHERE q >= 0.1 GROUP BY candidate_id)
 SELECT o.candidate_id, clip_id, outcome, CASE outcome WHEN 'positive' THEN label WHEN 'negative' THEN 'negative' END AS label, coalesce(ids, '') AS event_ids FROM o LEFT JOIN i ON i.candidate_id = o.candidate_id"""
)
def reviewed_examples(spark, sf):
    known = view(spark, sf, "fx_candidates").select("candidate_id", F.col("clip_id").alias("own"), F.col("raw_start_s").alias("source_start_s"), F.col("raw_end_s").alias("source_end_s"))
    v = view(spark, sf, "fx_review")
    reviews = v.join(known, "candidate_id", "left").select("candidate_id", F.coalesce("own", "clip_id").alias("clip_id"), (F.col("review_status") == "complete").alias("reviewed"))
    none = F.array().cast("array<string>")
    files = v.filter("vlm_status = 'success'").select("candidate_id", F.when(F.col("item_count") > 0, F.array(F.trim("label"))).otherwise(none).alias("labels"))
    return lookups.reviewed_examples(reviews, known, files, view(spark, sf, "fx_gt")).withColumn("event_ids", F.array_join("event_ids", ","))


_WINDOWS = """, c AS (SELECT candidate_id, clip_id, window_start_s AS s, CASE WHEN raw_start_s % 30 = 0 THEN window_start_s + 0.3e0 WHEN raw_start_s % 40 = 0 THEN window_start_s + 2 ELSE window_end_s END AS e FROM fx_candidates),
 v AS (SELECT *, CAST(floor((e - s - 2.5e0) / 0.5e0 + 1e-9) AS INT) AS n FROM c WHERE e - s >= 0.5e0),
 sw AS (
   SELECT candidate_id, clip_id, i AS k, s + i * 0.5e0 AS a, s + i * 0.5e0 + 2.5e0 AS b FROM (SELECT *, unnest(range(0, n + 1)) AS i FROM v WHERE e - s > 2.5e0)
   UNION ALL SELECT candidate_id, clip_id, n + 1, e - 2.5e0, e FROM v WHERE e - s > 2.5e0 AND s + n * 0.5e0 + 2.5e0 < e - 0.1e0
   UNION ALL SELECT candidate_id, clip_id, 0, greatest(s, (s + e) / 2 - 1.25e0), least(e, (s + e) / 2 + 1.25e0) FROM v WHERE e - s <= 2.5e0)"""


def _cut_windows(spark, sf):
    s = F.col("raw_start_s")
    end = F.when(s % 30 == 0, F.col("window_start_s") + 0.3).when(s % 40 == 0, F.col("window_start_s") + 2).otherwise(F.col("window_end_s"))
    return view(spark, sf, "fx_candidates").withColumn("window_end_s", end)


@query(_WINDOWS + " SELECT candidate_id, clip_id, CAST(k AS INT) AS k, a AS window_start_s, b AS window_end_s, (a + b) / 2 AS center FROM sw")
def inference_windows(spark, sf):
    return windows.inference_windows(_cut_windows(spark, sf))


@query(
    _WINDOWS
    + """, x AS (SELECT *, (a + b) / 2 AS m FROM sw),
 y AS (SELECT * FROM x WHERE NOT EXISTS (SELECT 1 FROM fx_ignore i WHERE i.clip_id = x.clip_id AND m BETWEEN i.t_start AND i.t_end)),
 h AS (
   SELECT candidate_id, k, type, event_id, confidence, row_number() OVER (PARTITION BY candidate_id, k ORDER BY t_start, event_id) AS n FROM y JOIN fx_gt g ON g.clip_id = y.clip_id AND m BETWEEN t_start AND t_end),
 z AS (SELECT *, row_number() OVER (ORDER BY candidate_id, k) - 1 AS n FROM y)
 SELECT concat('b1_', lpad(CAST(z.n AS VARCHAR), 6, '0')) AS sample_id, z.candidate_id, z.clip_id, CAST(z.k AS INT) AS k, a AS window_start_s, b AS window_end_s, coalesce(h.type, 'background') AS label, h.event_id,
   h.confidence AS event_confidence, CASE h.confidence WHEN 'low' THEN 0.5e0 ELSE 1e0 END AS weight, c.split
 FROM z LEFT JOIN h ON h.candidate_id = z.candidate_id AND h.k = z.k AND h.n = 1 LEFT JOIN fx_clips c ON c.clip_id = z.clip_id"""
)
def window_samples(spark, sf):
    return windows.window_samples(_cut_windows(spark, sf), view(spark, sf, "fx_gt"), view(spark, sf, "fx_ignore"), view(spark, sf, "fx_clips"))


_RANGES = f""", r AS (SELECT clip_id, k % 500 - 20 AS start_frame, k % 500 - 20 + k % 37 AS end_frame FROM ({_KEYED})), o AS (SELECT clip_id, sample_index % 500 AS frame, sample_index FROM fx_obs)"""


def _ranges(spark, sf):
    k = F.substring("event_id", 5, 20).cast("long")
    r = view(spark, sf, "fx_gt").select("clip_id", (k % 500 - 20).alias("start_frame"), (k % 500 - 20 + k % 37).alias("end_frame"))
    return r, view(spark, sf, "fx_obs").select("clip_id", (F.col("sample_index") % 500).alias("frame"), "sample_index")


@query(_RANGES + " SELECT clip_id, frame, sample_index FROM o WHERE EXISTS (SELECT 1 FROM r WHERE r.clip_id = o.clip_id AND frame >= start_frame AND frame < end_frame)")
def frames_in_ranges(spark, sf):
    r, o = _ranges(spark, sf)
    return intervals.frames_in_ranges(o, r)


@query(
    _RANGES
    + """, t AS (SELECT r.clip_id, least(greatest(start_frame, 0), 470) AS a, least(greatest(least(greatest(start_frame, 0), 470), end_frame), 470) AS b FROM r JOIN fx_clips c ON c.clip_id = r.clip_id)
 SELECT clip_id, unnest(range(a, b, 2)) AS frame FROM t UNION SELECT clip_id, b - 1 FROM t WHERE b > a
 UNION SELECT o.clip_id, frame FROM o JOIN t ON t.clip_id = o.clip_id AND frame >= a AND frame < b"""
)
def preview_frames(spark, sf):
    r, o = _ranges(spark, sf)
    clips = view(spark, sf, "fx_clips").select("clip_id", "fps", F.lit(470).alias("total_frames"))
    return windows.preview_frames(r, o, clips, 8.0)


@query(
    """, n AS (SELECT *, row_number() OVER (ORDER BY event_id) - 1 AS position FROM fx_gt),
 l AS (SELECT position, event_id, row(clip_id, t_start, type, event_id) AS key, lag(row(clip_id, t_start, type, event_id)) OVER (ORDER BY position) AS before FROM n)
 SELECT position, event_id FROM l WHERE before > key ORDER BY position LIMIT 1"""
)
def check_global_order(spark, sf):
    return quality.check_global_order(lookups.numbered(view(spark, sf, "fx_gt"), "event_id"), "n")


@query(
    """ SELECT 'label' AS dimension, label AS value, count(*) AS n FROM fx_features GROUP BY label UNION ALL SELECT 'split', split, count(*) FROM fx_features GROUP BY split
 UNION ALL SELECT 'crop_type', crop_type, count(*) FROM fx_features GROUP BY crop_type UNION ALL SELECT 'all', 'all', count(*) FROM fx_features
 UNION ALL SELECT 'batches', 'distinct', count(DISTINCT batch_id) FROM fx_features"""
)
def manifest_stats(spark, sf):
    return dataset.manifest_stats(view(spark, sf, "fx_features"))


@query(
    """ SELECT concat('f_', substr(clip_id, 6)) AS file_name, false AS downloaded, n % 3 = 0 AS generated, n % 3 = 0 AS uploaded FROM (SELECT clip_id, CAST(substr(clip_id, 6) AS BIGINT) AS n FROM fx_clips) WHERE n % 10 <> 0"""
)
def legacy_ledger(spark, sf):
    n = F.substring("clip_id", 6, 20).cast("long")
    name = F.when(n % 10 == 0, " ").otherwise(F.concat(F.lit(" f_"), F.substring("clip_id", 6, 20)))
    rows = view(spark, sf, "fx_clips").select(name.alias("file_name"), F.when(n % 3 == 0, " Yes").when(n % 3 == 1, "false").alias("processed"))
    return dataset.read_ledger(rows).select("file_name", "downloaded", "generated", "uploaded")


_RECONCILED = """, a AS (
   SELECT file_name, downloaded, generated, uploaded, source_etag, source_size_bytes, n % 3 = 0 AS placed, n % 5 <> 1 AS there, n
   FROM (SELECT *, CAST(replace(replace(file_name, 'f_', ''), '.mp4', '') AS BIGINT) AS n FROM fx_ledger)),
 j AS (
   SELECT a.*, CASE WHEN there THEN source_size_bytes END AS disk, etag, size,
     CASE WHEN downloaded AND NOT there THEN 'file is missing' WHEN downloaded AND etag <> source_etag THEN 'source has another etag' WHEN downloaded AND size <> source_size_bytes THEN 'source has another size' END AS warning
   FROM a LEFT JOIN fx_listing l ON l.file_name = a.file_name),
 k AS (SELECT *, NOT downloaded AND placed AND coalesce(disk = size, false) AS adopted FROM j)"""


def _reconciled(spark, sf):
    n = F.regexp_replace("file_name", "f_|.mp4", "").cast("long")
    ledger = view(spark, sf, "fx_ledger").withColumns({"local_source_path": F.when(n % 3 == 0, F.concat(F.lit("/data/"), "file_name")).otherwise(""), "last_error": F.lit("")})
    disk = ledger.filter(n % 5 != 1).select("file_name", F.col("source_size_bytes").alias("size"))
    return dataset.reconcile(ledger, disk, view(spark, sf, "fx_listing"))


@query(
    _RECONCILED
    + """ SELECT file_name, CASE WHEN adopted THEN true WHEN warning IS NOT NULL THEN false ELSE downloaded END AS downloaded, generated, uploaded,
   CASE WHEN adopted THEN coalesce(etag, source_etag) ELSE source_etag END AS source_etag, CASE WHEN adopted THEN size ELSE source_size_bytes END AS source_size_bytes,
   CASE WHEN warning LIKE 'source%' THEN 'source_changed' ELSE '' END AS last_error FROM k"""
)
def reconciled_ledger(spark, sf):
    return _reconciled(spark, sf)[0].drop("local_source_path")


@query(_RECONCILED + " SELECT file_name, warning FROM k WHERE warning IS NOT NULL")
def ledger_warnings(spark, sf):
    return _reconciled(spark, sf)[1]
