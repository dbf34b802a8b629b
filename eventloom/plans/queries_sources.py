"""Queries over metadata files, manifests and audits, each with the same rows in DuckDB."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventloom.operators import decode
from eventloom.plans.fixtures import view
from eventloom.plans.registry import query
from eventloom.sources import audit, manifest, metadata

_TIMES = "CAST(k % 7 AS DOUBLE)"


@query(
    f""" SELECT path, 0 AS position, concat('c', k - k % 20) AS candidate_id, clip AS clip_id, 'bk' AS source_bucket, {_TIMES} AS source_start_s, 9e0 AS source_end_s
   FROM fx_metadata m WHERE k % 10 = 0 AND (k % 20 = 0 OR NOT EXISTS (SELECT 1 FROM fx_metadata o WHERE o.k = m.k - 10))
 UNION ALL SELECT path, 1, concat('c', k, '_b'), 'own', 'bk', 1.5, 3 FROM fx_metadata WHERE k % 10 = 0
 UNION ALL SELECT path, 0, concat('f', k), 'own', NULL, NULL, NULL FROM fx_metadata WHERE k % 10 = 2
 UNION ALL SELECT path, 0, concat('f', k), 'own', NULL, 2, NULL FROM fx_metadata WHERE k % 10 = 3
 UNION ALL SELECT path, 0, concat('t', k), clip, 'bk', 4, {_TIMES} FROM fx_metadata WHERE k % 10 = 8 AND k % 7 > 4"""
)
def candidate_metadata(spark, sf):
    found = metadata.parse_candidate_metadata(view(spark, sf, "fx_metadata", "o_orderkey").select("path", "value"))
    return found.candidates.select("path", "position", "candidate_id", "clip_id", "source_bucket", "source_start_s", "source_end_s")


@query(
    """ SELECT path, CAST(NULL AS INT) AS position, CASE k % 10 WHEN 4 THEN 'malformed JSON' WHEN 5 THEN 'candidates is no list' WHEN 6 THEN 'missing source_video_id' ELSE 'unexpected content' END AS problem
   FROM fx_metadata WHERE k % 10 IN (4, 5, 6, 9)
 UNION ALL SELECT path, 0, 'missing source_end_s' FROM fx_metadata WHERE k % 10 = 7
 UNION ALL SELECT path, 1, 'no JSON object' FROM fx_metadata WHERE k % 10 = 7
 UNION ALL SELECT path, 0, 'start is not before end' FROM fx_metadata WHERE k % 10 = 8 AND k % 7 <= 4
 UNION ALL SELECT path, 0, 'duplicate candidate_id' FROM fx_metadata m WHERE k % 20 = 10 AND EXISTS (SELECT 1 FROM fx_metadata o WHERE o.k = m.k - 10)"""
)
def candidate_metadata_errors(spark, sf):
    return metadata.parse_candidate_metadata(view(spark, sf, "fx_metadata", "o_orderkey").select("path", "value")).errors.select("path", "position", "problem")


@query(
    """ SELECT count(*) AS source_files_scanned, count(*) FILTER (WHERE k % 10 = 1) AS zero_candidate_sources, count(*) FILTER (WHERE k % 10 IN (4, 5, 6, 9)) AS files_with_errors FROM fx_metadata"""
)
def candidate_metadata_stats(spark, sf):
    return metadata.parse_candidate_metadata(view(spark, sf, "fx_metadata", "o_orderkey").select("path", "value")).stats


@query(""" SELECT crop_id, clip_id, label, split, 'b1' AS batch_id, epoch_us(TIMESTAMP '2024-05-01 00:00:00') AS created_us FROM fx_features""")
def manifest_rows(spark, sf):
    records = view(spark, sf, "fx_features").drop("batch_id")
    return manifest.stamped(records, "b1", "2024-05-01T00:00:00Z").select("crop_id", "clip_id", "label", "split", "batch_id", F.unix_micros("created_at").alias("created_us"))


@query(
    """, d AS (SELECT pred_id, concat(clip_id, '/', substr(pred_id, 6, 1)) AS candidate_id, clip_id, score FROM fx_pred)
 SELECT clip_id, count(*) AS n_events, string_agg(pred_id, ',' ORDER BY pred_id) AS pred_ids, count(DISTINCT candidate_id) AS n_diagnostics FROM d GROUP BY clip_id"""
)
def nested_audit(spark, sf):
    preds = view(spark, sf, "fx_pred").withColumn("candidate_id", F.concat_ws("/", "clip_id", F.substring("pred_id", 6, 1))).withColumn("transfer_s", (F.col("t_start") + F.col("t_end")) / 2)
    dropped = decode.temporal_nms(preds)[1]
    seen = preds.groupBy("clip_id", "candidate_id").agg(F.count("*").alias("n_events"))
    diagnostics = seen.select("clip_id", "candidate_id", F.lit(False).alias("skipped"), F.lit(None).cast("string").alias("skip_reason"), F.lit(0).cast("long").alias("n_samples"), "n_events")
    nested = audit.nested_audit(preds, audit.suppressions(preds, dropped), diagnostics)
    return nested.select("clip_id", F.size("events").cast("long").alias("n_events"), F.array_join(F.transform("events", lambda e: e["pred_id"]), ",").alias("pred_ids"), F.size("diagnostics").cast("long").alias("n_diagnostics"))
