import datetime

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from eventloom.operators import evidence, models, pipelines
from eventloom.plans import queries_models
from eventloom.plans.fixtures import REGIONS
from eventloom.sources.manifest import MANIFEST
from eventloom.streaming import retry
from tests.conftest import SF

CAND = "candidate_id string, clip_id string, actor_id string, hand_side string, region_id string, raw_start_s double, raw_end_s double, window_start_s double, window_end_s double"


def test_track_a_counts_what_it_skips(spark):
    candidates, poses, hand, shelf = queries_models._track_inputs(spark, SF)
    one = candidates.orderBy(F.desc("raw_end_s"), "clip_id").limit(2).cache()
    first, second = one.collect()
    odd = [("no_actor", first["clip_id"], "", "right", "region_0", 0.0, 1.0, 0.0, 1.0), ("no_video", "clip_x", "actor_0", "right", "region_0", 0.0, 1.0, 0.0, 1.0), ("no_pose", first["clip_id"], "actor_7", "right", "region_0", 0.0, 1.0, 0.0, 1.0), ("no_region", first["clip_id"], "actor_0", "right", "region_9", 0.0, 1.0, 0.0, 1.0)]
    # a second candidate over the same rows as the first: their observations are one stream, and no event is found twice
    again = one.filter(F.col("clip_id") == first["clip_id"]).withColumn("candidate_id", F.concat("candidate_id", F.lit("+")))
    every = one.select(*candidates.columns).unionByName(again).unionByName(spark.createDataFrame(odd, CAND).select(*candidates.columns))
    features = hand.unionByName(shelf).drop("state")
    features = features.unionByName(features.withColumn("candidate_id", F.concat("candidate_id", F.lit("+"))))
    fitted = [models.train_state_classifier(rows, names) for rows, names in ((hand, ["empty", "carrying"]), (shelf, ["removed", "placed", "no_change"]))]
    clips = one.select("clip_id", F.lit(1e6).alias("duration_s"))
    found = pipelines.track_a(every, clips, poses, REGIONS, features, *fitted)
    want = {c["clip_id"]: int((round(c["raw_end_s"] * 10) + 1 + 8) // 20) for c in (first, second)}
    preds = found.predictions.collect()
    assert {c: sum(p["clip_id"] == c for p in preds) for c in want} == want and min(want.values()) > 0
    assert len({p["pred_id"] for p in preds}) == len(preds) and all(p["candidate_ids"] for p in preds)
    s = found.summary
    assert (s["candidates"], s["missing_identity_fields"], s["missing_source_video"], s["missing_pose_observations"], s["missing_shelf_region"]) == (7, 1, 1, 1, 1)
    assert s["predictions"] == len(preds) == s["pickup"] + s["putdown"] == s["low"] + s["medium"] + s["high"]
    notes = {r["candidate_id"]: (r["skip_reason"], r["n_samples"]) for r in found.diagnostics.collect()}
    assert notes["no_pose"] == ("missing_pose_observations", 0) and notes[first["candidate_id"]] == (None, round(first["raw_end_s"] * 10) + 1)


class Counted:
    """Says how often it was made: the first entry of each embedding."""

    made = 0

    def __init__(self):
        Counted.made += 1

    def __call__(self, rows):
        return [[float(Counted.made), float(len(rows)), x] for x in rows["geometry_x"]]


def test_feature_dataset_of_a_small_clip(spark):
    candidates = [("c1", "v", "a", "left", "region_0", 1.0, 3.0, 0.0, 4.0), ("c2", "v", "a", "left", "region_0", 8.0, 9.0, 7.0, 10.0), ("c3", "v", "b", "left", "region_0", 1.0, 3.0, 0.0, 4.0), ("c4", "w", "a", "left", "region_0", 1.0, 3.0, 0.0, 4.0)]
    poses = [("v", "a", "left", t / 2, 50.0 if t < 4 else 300.0, 300.0, 0.9, t) for t in range(0, 9)]
    k = spark.createDataFrame(candidates, CAND)
    p = spark.createDataFrame(poses, "clip_id string, actor_id string, hand_side string, t_h double, wrist_x double, wrist_y double, wrist_confidence double, sample_index int")
    clips = spark.createDataFrame([("v", "train"), ("w", None)], "clip_id string, split string")
    ignores = spark.createDataFrame([("v", 8.5, 9.5)], "clip_id string, t_start double, t_end double")
    events = spark.createDataFrame([("e1", "v", "pickup", 1.5, 3.0, "med", True)], "event_id string, clip_id string, type string, t_start double, t_end double, confidence string, hard_case boolean")
    records, counts = pipelines.feature_dataset(k, clips, ignores, p, REGIONS, events, Counted, tolerance=0.2, most=1.0, frame=(1000, 1000), batch=3)
    rows = sorted(records.collect(), key=lambda r: (r["timestamp_s"], r["crop_type"]))
    assert records.schema == MANIFEST
    # contact at 2 s: pre 1, contact 2, post 3, each with a hand and a shelf crop
    assert [(r["timestamp_s"], r["sample_position"], r["crop_type"]) for r in rows] == [(t, n, c) for t, n in ((1.0, "pre"), (2.0, "contact"), (3.0, "post")) for c in ("hand", "shelf")]
    assert {(r["candidate_id"], r["label"], r["event_id"], r["split"], r["confidence"], r["hard_case"]) for r in rows} == {("c1", "pickup", "e1", "train", "med", True)}
    assert [(r["geometry_x"], r["geometry_y"]) for r in rows[:4]] == [(0, 188), (188, 188), (188, 188), (188, 188)]
    assert len({r["crop_id"] for r in rows}) == 6 and all(r["embedding"][1] <= 3 and r["embedding"][2] == r["geometry_x"] for r in rows)
    assert (counts["candidates"], counts["ignored"], counts["missing_pose_observations"], counts["missing_split"], counts["label=pickup"], counts["split=train"]) == (4, 1, 1, 1, 6, 6)


def test_encoder_is_made_once_a_task(spark):
    crops = spark.range(0, 1000, 1, 1).selectExpr("cast(id as int) geometry_x", "'a' crop_type")
    rows = pipelines.encoded(crops, Counted, batch=64).collect()
    assert len({r["embedding"][0] for r in rows}) == 1 and max(r["embedding"][1] for r in rows) == 64 and [r["geometry_x"] for r in rows] == [int(r["embedding"][2]) for r in rows]


def test_encoder_sees_its_columns_in_calls_of_a_batch_and_answers_once_an_arrow_batch(spark):
    calls = []

    def make():
        def encode(rows):
            calls.append((len(rows), list(rows.columns)))
            return [[x, x + 1] for x in rows["geometry_x"]]

        return encode

    part = lambda n: pa.StructArray.from_arrays([pa.array(range(n), pa.int32())], ["geometry_x"])
    out = list(pipelines.embeddings(iter([part(100), part(0), part(5)]), make, 64))
    assert [len(x) for x in out] == [100, 0, 5] and out[0].to_pylist()[99] == [99.0, 100.0]
    assert calls == [(64, ["geometry_x"]), (36, ["geometry_x"]), (5, ["geometry_x"])]
    crops = spark.range(0, 10, 1, 1).selectExpr("cast(id as int) geometry_x", "'a' label")
    rows = pipelines.encoded(crops, lambda: lambda rows: [[float(len(rows.columns)), x] for x in rows["geometry_x"]], 4, ["geometry_x"]).collect()
    assert [(r["label"], r["embedding"]) for r in rows] == [("a", [1.0, float(r["geometry_x"])]) for r in rows] and len(rows) == 10


def test_failed_keys_come_back_after_a_pause_and_are_given_up(spark, tmp_path):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        schema = "file_name string, attempt int, status string"
        put = lambda n, rows: spark.createDataFrame(rows, schema).coalesce(1).write.json(str(tmp_path / "in" / n))
        put("0", [("a", 1, "failed"), ("b", 1, "failed"), ("b", 2, "failed"), ("b", 3, "failed"), ("c", 1, "failed"), ("c", 2, "done"), ("d", 1, "done")])
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).json(str(tmp_path / "in"))
        offers = retry.retry_offers(stream, most=3, pause_s=1.0)
        q = offers.writeStream.format("memory").queryName("offers").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(processingTime="500 milliseconds").start()
        begun = datetime.datetime.now()
        retry.run_until_idle(q, idle_s=20.0, longest_s=120.0)
        assert not q.isActive and (datetime.datetime.now() - begun).total_seconds() < 115
        assert sorted(map(tuple, spark.table("offers").collect())) == [("a", "retry", 1), ("b", "skip", 3)]
    finally:
        spark.conf.unset(name)
