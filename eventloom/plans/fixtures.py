"""Input views over the driver tables, in SQL that Spark and DuckDB both run."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings")
_HOURS = "({US} - 1704067200000000) / 3.6e9"
VIEWS = {
    "fx_clips": "select concat('clip_', cast(c_custkey as string)) clip_id, concat('videos/clip_', cast(c_custkey as string), '.mp4') s3_key, cast(2000000 as double) duration_s, cast(20 as double) fps, case when c_custkey % 10 < 7 then 'train' when c_custkey % 10 = 7 then 'val' else 'test' end split from {customer}",
    "fx_obs": f"select concat('clip_', cast(user_id as string)) clip_id, event_id sample_index, event_type track_key, {_HOURS} t_h, cast((event_id * 37) % 1000 as double)/1000.0 confidence from {{events}}",
    "fx_pose": f"select concat('clip_', cast(user_id as string)) clip_id, event_id sample_index, {_HOURS} t_h, concat('actor_', cast(event_id % 3 as string)) actor_id, case when event_id % 2 = 0 then 'left' else 'right' end hand_side, cast((event_id * 7919) % 1000 as double) wrist_x, cast((event_id * 104729) % 1000 as double) wrist_y, cast((event_id * 53) % 1000 as double)/1000.0 wrist_confidence from {{events}}",
    "fx_gt": "select concat('evt_', cast(o_orderkey as string)) event_id, concat('clip_', cast(o_custkey as string)) clip_id, case when o_orderkey % 2 = 0 then 'pickup' else 'putdown' end type, cast(o_orderkey * 10 as double) t_start, cast(o_orderkey * 10 as double) + 1.0e0 + cast(o_orderkey % 7 as double)*0.5e0 t_end, (o_orderkey % 11) = 0 hard_case, case when substring(o_orderpriority,1,1) in ('1','2') then 'high' when substring(o_orderpriority,1,1) = '3' then 'med' else 'low' end confidence from {orders}",
    "fx_pred": "select concat('pred_', cast(o_orderkey as string)) pred_id, concat('clip_', cast(o_custkey as string)) clip_id, case when (o_orderkey % 2 = 0) <> (o_orderkey % 13 = 0) then 'pickup' else 'putdown' end type, cast(o_orderkey * 10 as double) + cast((o_orderkey*31) % 9 as double)*0.25e0 t_start, cast(o_orderkey * 10 as double) + cast((o_orderkey*31) % 9 as double)*0.25e0 + 1.0e0 + cast(o_orderkey % 7 as double)*0.5e0 t_end, cast((o_orderkey*53) % 1000 as double)/1000.0e0 score, 'm1' model from {orders} where o_orderkey % 5 <> 0",
    "fx_ignore": "select concat('ign_', cast(o_orderkey as string)) ignore_id, concat('clip_', cast(o_custkey as string)) clip_id, cast(o_orderkey * 10 as double) + 1.0e0 t_start, cast(o_orderkey * 10 as double) + 6.0e0 t_end, 'ACTION_OCCLUDED' reason from {orders} where o_orderkey % 17 = 0",
    "fx_candidates": "select concat('cand_', cast(o_orderkey as string)) candidate_id, concat('clip_', cast(o_custkey as string)) clip_id, concat('actor_', cast(o_orderkey % 3 as string)) actor_id, case when o_orderkey % 2 = 0 then 'left' else 'right' end hand_side, concat('region_', cast(o_orderkey % 3 as string)) region_id, cast(o_orderkey * 10 as double) + cast(o_orderkey % 5 as double)*0.5e0 raw_start_s, cast(o_orderkey * 10 as double) + cast(o_orderkey % 5 as double)*0.5e0 + 2.0e0 + cast(o_orderkey % 3 as double) raw_end_s, greatest(0.0e0, cast(o_orderkey * 10 as double) + cast(o_orderkey % 5 as double)*0.5e0 - 2.0e0) window_start_s, cast(o_orderkey * 10 as double) + cast(o_orderkey % 5 as double)*0.5e0 + 4.0e0 + cast(o_orderkey % 3 as double) window_end_s from {orders} where o_orderkey % 4 <> 0",
    "fx_window_scores": "select clip_id, k, k*0.5e0 window_start_s, k*0.5e0 + 2.5e0 window_end_s, a/(a+b+c) p_background, b/(a+b+c) p_pickup, c/(a+b+c) p_putdown from (select concat('clip_', cast(user_id as string)) clip_id, row_number() over (partition by user_id order by event_id) - 1 k, cast((event_id*31) % 100 + 1 as double) a, cast((event_id*57) % 100 + 1 as double) b, cast((event_id*83) % 100 + 1 as double) c from {events}) z",
    "fx_features": "select concat('crop_', cast(vec_id as string)) crop_id, concat('clip_', cast(vec_id % 50 as string)) clip_id, case when vec_id % 2 = 0 then 'hand' else 'shelf' end crop_type, case vec_id % 4 when 0 then 'pre' when 1 then 'post' when 2 then 'post' else 'mid' end sample_position, case label % 3 when 0 then 'pickup' when 1 then 'putdown' else 'negative' end label, case when vec_id % 50 < 35 then 'train' when vec_id % 50 < 43 then 'val' else 'test' end split, case when vec_id % 6 = 0 then null else concat('batch_', cast(vec_id % 6 as string)) end batch_id, vec_id from {embeddings}",
    "fx_ledger": "select concat('f_', cast(p_partkey as string), '.mp4') file_name, p_partkey % 2 = 0 downloaded, p_partkey % 4 = 0 generated, p_partkey % 8 = 0 uploaded, cast(p_partkey as string) source_etag, cast(p_size as string) source_size_bytes from {part} where p_partkey % 9 <> 0",
    "fx_listing": "select concat('f_', cast(p_partkey as string), '.mp4') file_name, cast(case when p_partkey % 7 = 0 then -p_partkey else p_partkey end as string) etag, cast(p_size as string) size from {part} where p_partkey % 10 <> 0",
    "fx_sm_obs": "select clip_id, 'actor_0' actor_id, 'right' hand_side, 'region_0' region_id, k*0.1e0 timestamp_s, (k % 20) between 4 and 15 inside_region, case when (k % 20) between 4 and 15 then 0.0e0 when k % 20 in (2,3) then 30.0e0 else 100.0e0 end distance_px, 0.8e0 trajectory_confidence, case when ((k % 20) < 9) = (k % 40 < 20) then 0.9e0 else 0.05e0 end hand_empty, case when ((k % 20) < 9) = (k % 40 < 20) then 0.05e0 else 0.9e0 end hand_carrying, 0.05e0 hand_uncertain, case when k % 20 >= 9 and k % 40 < 20 then 0.8e0 else 0.1e0 end shelf_removed, case when k % 20 >= 9 and k % 40 >= 20 then 0.8e0 else 0.1e0 end shelf_placed, 0.05e0 shelf_uncertain from (select concat('clip_', cast(user_id as string)) clip_id, row_number() over (partition by user_id order by event_id) - 1 k from {events}) z",
    "fx_pred_dense": "select concat('pred_', cast(o_orderkey as string)) pred_id, concat('clip_', cast(o_custkey as string)) clip_id, case when (o_orderkey % 2 = 0) <> (o_orderkey % 13 = 0) then 'pickup' else 'putdown' end type, cast((o_orderkey * 37) % 3600 as double) + cast((o_orderkey*31) % 9 as double)*0.25e0 t_start, cast((o_orderkey * 37) % 3600 as double) + cast((o_orderkey*31) % 9 as double)*0.25e0 + 1.0e0 + cast(o_orderkey % 7 as double)*0.5e0 t_end, cast((o_orderkey*53) % 1000 as double)/1000.0e0 score, 'm1' model from {orders} where o_orderkey % 5 <> 0",
    "fx_gt_dense": "select concat('evt_', cast(o_orderkey as string)) event_id, concat('clip_', cast(o_custkey as string)) clip_id, case when o_orderkey % 2 = 0 then 'pickup' else 'putdown' end type, cast((o_orderkey * 37) % 3600 as double) t_start, cast((o_orderkey * 37) % 3600 as double) + 1.0e0 + cast(o_orderkey % 7 as double)*0.5e0 t_end from {orders}",
    "fx_review": "select concat('cand_', cast(o_orderkey as string)) candidate_id, cast(o_orderkey % 3 as int) pos, concat('clip_', cast((o_orderkey - o_orderkey % 2) % 40 + 1 as string)) clip_id, case when o_orderkey % 10 = 0 then 'pending' else 'complete' end review_status, case when o_orderkey % 7 = 0 then 'failed' else 'success' end vlm_status, cast((o_orderkey - o_orderkey % 2) * 10 as double) source_start_s, case (o_orderkey - o_orderkey % 2) % 12 when 0 then ' Pickup' when 4 then 'restocking' when 6 then 'pickup' else 'putdown' end label, 0.5e0 start_s, case when o_orderkey % 13 = 0 then 0.25e0 else 1.5e0 end end_s, cast(o_orderkey % 4 as int) item_count, case o_orderkey % 3 when 0 then 'Medium' when 1 then 'HIGH' else 'bad' end confidence, o_orderkey % 11 = 0 hard_case, o_orderpriority notes from {orders}",
    "fx_registry": "select case when c_custkey % 37 = 0 then 'clip_1' else concat('clip_', cast(c_custkey as string)) end clip_id, case when c_custkey % 31 = 0 then '' else concat('store_', cast(c_custkey % 3 as string), '/clip_', cast(c_custkey as string), case when c_custkey % 5 = 0 then '.TXT' else '.Mp4' end) end s3_key, case when c_custkey % 29 = 0 then 0e0 else 300000e0 end duration_s, case when c_custkey % 43 = 0 then -1e0 else 20e0 end fps, 3840 width, 2160 height, case when c_custkey % 41 = 0 then -1 else 2 end n_person_tracks, case when c_custkey % 23 = 0 then 'dev' when c_custkey % 10 < 7 then 'train' else 'test' end split, case when c_custkey % 4 = 0 then null else cast(c_custkey % 50 as double) end active_start_s, case when c_custkey % 8 = 0 then null when c_custkey % 4 = 0 then 9e0 else 25e0 end active_end_s, c_custkey % 19 <> 0 decode_ok, case when c_custkey % 17 = 0 then 'clip_2' end duplicate_of, c_custkey * 1000 size_bytes, c_custkey from {customer}",
    "fx_boxes": "select concat('clip_', cast(user_id as string)) clip_id, event_id sample_index, cast(event_id % 5 as bigint) frame, ({US} - 1704067200000000) / 3.6e9 t_h, concat('actor_', cast(event_id % 3 as string)) actor_id, concat('person_', cast(event_id % 4 as string)) person_id, cast((event_id * 7919) % 1000 as double) x1, cast((event_id * 104729) % 1000 as double) y1, cast((event_id * 7919) % 1000 + 200 as double) x2, cast((event_id * 104729) % 1000 + 400 as double) y2 from {events}",
    "fx_raw": "select concat('clip_', cast(o_custkey as string)) clip_id, concat('actor_', cast(o_orderkey % 2 as string)) actor_id, 'left' hand_side, concat('region_', cast(o_orderkey % 2 as string)) region_id, cast(o_orderkey % 500 as double) + cast(o_orderkey % 4 as double) * 0.25e0 start_s, cast(o_orderkey % 500 as double) + cast(o_orderkey % 4 as double) * 0.25e0 + cast(o_orderkey % 9 as double) * 0.5e0 end_s, cast((o_orderkey * 53) % 1000 as double) / 1000e0 mean_confidence, cast((o_orderkey * 31) % 100 as double) / 4e0 mean_distance from {orders}",
    "fx_text": "select l_orderkey, l_linenumber, case l_orderkey % 5 when 0 then ' TRUE ' when 1 then 'no' when 2 then '1' when 3 then '' else null end flag, case l_orderkey % 4 when 0 then '0.0' when 1 then ' ' when 2 then 'x' else cast(l_linenumber as string) end amount, case l_orderkey % 6 when 0 then '2.0' when 1 then '2.5' when 2 then '0' when 3 then '-1' else '3' end items, case l_orderkey % 5 when 0 then '30000/1001' when 1 then '25/0' when 2 then '20' when 3 then 'x/y' else null end rate, case l_orderkey % 3 when 0 then concat('S2024', lpad(cast(l_linenumber as string), 2, '0'), '15_x') else concat('clip_', cast(l_linenumber as string)) end name from {lineitem}",
    "fx_vectors": "select vec_id, case label % 3 when 0 then 'pickup' when 1 then 'putdown' else 'negative' end state, case when vec_id % 50 < 35 then 'train' else 'test' end split, embedding from {embeddings}",
    # chr(123) and chr(125) are the braces of JSON, which the view text keeps for table names
    "fx_responses": "select response_id, l_orderkey, l_linenumber, frame_count, case when l_orderkey % 11 = 0 then substr(body, 1, 20) when l_orderkey % 13 = 0 then concat('[', body, ']') when l_linenumber % 3 = 0 then concat('```json', chr(10), body, chr(10), '```') else body end content from (select concat(cast(l_orderkey as string), '-', cast(l_linenumber as string)) response_id, l_orderkey, l_linenumber, case when l_orderkey % 2 = 0 then 11 else 0 end frame_count, concat(chr(123), '\"events\": [', chr(123), '\"label\": \"', case l_orderkey % 4 when 1 then ' PutDown ' when 3 then 'grab' else 'pickup' end, '\", \"start_frame\": ', cast(l_linenumber as string), ', \"end_frame\": ', case l_orderkey % 5 when 0 then '\"9\"' when 1 then '1' else '12.7' end, ', \"confidence\": \"medium\", \"hard_case\": ', case when l_orderkey % 6 = 0 then '\"yes\"' else 'true' end, chr(125), ']', chr(125)) body from {lineitem}) z",
    "fx_export": "select source, o_orderkey, clip_id, o_orderkey % 17 = 0 cut, case when o_orderkey % 17 = 0 then substr(body, 1, 30) else body end value from (select cast(o_orderkey as string) source, o_orderkey, concat('clip_', cast(o_custkey as string)) clip_id, concat('[', chr(123), '\"id\": ', cast(o_orderkey as string), ', \"data\": ', chr(123), '\"clip_id\": \"clip_', cast(o_custkey as string), '\", \"fps\": 20', chr(125), ', \"annotations\": [', chr(123), '\"id\": 1, \"who\": \"ann\", \"state\": [', case when o_orderkey % 7 = 0 then '' else concat(chr(123), '\"name\": \"complete_active_span_reviewed\", \"value\": true', chr(125)) end, '], \"result\": [', chr(123), '\"id\": \"r', cast(o_orderkey as string), '\", \"type\": \"timelinelabels\", \"value\": ', chr(123), '\"timelinelabels\": [\"', case o_orderkey % 4 when 0 then 'pickup' when 1 then 'putdown' when 2 then 'ignore' else 'grab' end, '\"], \"ranges\": [', chr(123), '\"start\": ', cast(o_orderkey % 100 + 10 as string), ', \"end\": ', cast(o_orderkey % 100 + 20 as string), chr(125), '], \"confidence\": \"high\", \"hard_case\": \"', case when o_orderkey % 5 = 0 then 'true' else 'false' end, '\"', case when o_orderkey % 4 < 2 and o_orderkey % 3 > 0 then concat(', \"item_count\": ', cast(o_orderkey % 3 as string)) else '' end, chr(125), chr(125), ']', chr(125), ']', chr(125), ']') body from {orders}) z",
    # one JSON file an order: sources with two candidates (one id shared by two files), empty ones, arrays, single candidates and each kind of fault
    "fx_metadata": (
        "select concat('m/', lpad(cast(o_orderkey as string), 9, '0'), '.json') path, o_orderkey k, concat('clip_', cast(o_custkey as string)) clip, case o_orderkey % 10"
        " when 0 then concat(chr(123), head, ', \"candidates\": [', chr(123), '\"candidate_id\": \"c', cast(o_orderkey - o_orderkey % 20 as string), '\", \"candidate_key\": \"x\", \"source_start_s\": ', cast(o_orderkey % 7 as string), ', \"source_end_s\": 9', chr(125), ', ',"
        " chr(123), '\"candidate_id\": \"c', cast(o_orderkey as string), '_b\", \"candidate_key\": \"y\", \"clip_id\": \"own\", \"source_start_s\": \"1.5\", \"source_end_s\": 3', chr(125), ']', chr(125))"
        " when 1 then concat(chr(123), head, ', \"candidates\": []', chr(125))"
        " when 2 then concat('[', chr(123), '\"candidate_id\": \"f', cast(o_orderkey as string), '\", \"clip_id\": \"own\"', chr(125), ', 5]')"
        " when 3 then concat(chr(123), '\"candidate_id\": \"f', cast(o_orderkey as string), '\", \"clip_id\": \"own\", \"source_start_s\": 2', chr(125))"
        " when 4 then concat(chr(123), '\"candidates\": [')"
        " when 5 then concat(chr(123), head, ', \"candidates\": \"none\"', chr(125))"
        " when 6 then concat(chr(123), '\"candidates\": [', chr(123), '\"candidate_id\": \"z\"', chr(125), ']', chr(125))"
        " when 7 then concat(chr(123), head, ', \"candidates\": [', chr(123), '\"candidate_id\": \"n', cast(o_orderkey as string), '\", \"candidate_key\": \"x\", \"source_start_s\": 1', chr(125), ', 7]', chr(125))"
        " when 8 then concat(chr(123), head, ', \"candidates\": [', chr(123), '\"candidate_id\": \"t', cast(o_orderkey as string), '\", \"candidate_key\": \"x\", \"source_start_s\": 4, \"source_end_s\": ', cast(o_orderkey % 7 as string), chr(125), ']', chr(125))"
        " else '42' end value from (select *, concat('\"source_video_id\": \"clip_', cast(o_custkey as string), '\", \"source_bucket\": \"bk\"') head from {orders}) z"
    ),
}
REGIONS = {"region_0": [(100.0, 100.0), (500.0, 100.0), (500.0, 500.0), (100.0, 500.0)], "region_1": [(400.0, 400.0), (900.0, 450.0), (650.0, 900.0)], "region_2": [(50.0, 600.0), (300.0, 650.0), (200.0, 700.0), (320.0, 900.0), (60.0, 950.0)]}


def view(spark: SparkSession, sf_dir: str, name: str, by: str | None = None) -> DataFrame:
    """A view, lazily, over the Parquet tables in sf_dir; with `by`, a key of its only table, the rows are first dealt over all cores."""
    sql = VIEWS[name].replace("{US}", "unix_micros(cast(ts as timestamp))")
    of = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    return spark.sql(sql, **{t: of(t) if by is None else spread(of(t), by) for t in re.findall(r"\{(\w+)\}", sql)})


def spread(rows: DataFrame, by: str) -> DataFrame:
    """rows over all cores by a key: the driver's tables are few row groups, which as few tasks read, and parsing JSON costs far more than moving the columns that it is made of.

    A hash needs no order of the rows to be repeatable, which dealing in turns does.
    """
    return rows.repartition(8 * rows.sparkSession.sparkContext.defaultParallelism, by)


def regions(spark: SparkSession) -> DataFrame:
    """(region_id, polygon): a configuration table of three polygons."""
    rows = [(r, [{"x": x, "y": y} for x, y in p]) for r, p in REGIONS.items()]
    return spark.createDataFrame(rows, "region_id string, polygon array<struct<x:double,y:double>>")


def duck(name: str) -> str:
    """The view as a DuckDB subquery."""
    sql = VIEWS[name].replace("{US}", "epoch_us(ts)")
    return "(" + re.sub(r"\{(\w+)\}", r"\1", sql) + ")"


def with_views(sql: str) -> str:
    """sql with every fx_ name in it defined by WITH; RECURSIVE where a comment in sql says so."""
    names = dict.fromkeys(re.findall(r"\bfx_\w+", sql))
    return ("WITH RECURSIVE " if "/* recursive */" in sql else "WITH ") + ", ".join(f"{n} AS {duck(n)}" for n in names) + sql if names else sql


def edges_sql() -> str:
    """The edges of REGIONS as a SQL table."""
    rows = [(r, *p[i], *p[(i + 1) % len(p)]) for r, p in REGIONS.items() for i in range(len(p))]
    return "(VALUES " + ", ".join(f"('{r}', {a}e0, {b}e0, {c}e0, {d}e0)" for r, a, b, c, d in rows) + ") e(region_id, ax, ay, cx, cy)"
