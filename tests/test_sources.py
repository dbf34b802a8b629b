import json
import os

import pytest
from pyspark.sql import functions as F

from eventloom.sources import audit, inventory, manifest, metadata


def test_metadata_folders_of_all_layouts(spark, tmp_path):
    put = lambda name, value: (tmp_path / name).write_text(value if isinstance(value, str) else json.dumps(value))
    (tmp_path / "deep" / "er").mkdir(parents=True)
    ok = {"candidate_id": "a", "candidate_key": "k", "source_start_s": 0, "source_end_s": 1.5, "extra": {"n": [1]}}
    put("1.json", {"source_video_id": "v1", "source_bucket": "b", "source_key": "", "candidates": [ok, {**ok, "candidate_id": "b", "clip_id": None}, {**ok, "candidate_id": "c", "source_bucket": "mine"}]})
    put("deep/2.json", {"source_video_id": "v2", "candidates": [ok, {**ok, "candidate_id": ""}, {**ok, "candidate_id": "d", "candidate_key": None}, 3, {"candidate_id": "e", "candidate_key": "k"}, {**ok, "candidate_id": "f", "source_start_s": -1}, {**ok, "candidate_id": "g", "source_end_s": "x"}, {**ok, "candidate_id": "h", "source_start_s": 2}]})
    put("deep/er/3.json", [{"candidate_id": "a", "clip_id": "own"}, 1, "x", {"candidate_id": "a"}])
    put("4.json", {"candidate_id": "flat"})
    put("5.json", {"source_video_id": "v5", "candidates": []})
    put("6.json", "{")
    put("7.json", {"candidates": [ok], "source_video_id": ""})
    put("8.json", {"candidates": None, "source_video_id": "v8"})
    put("9.json", "null")
    put("readme.txt", "no JSON")
    found = metadata.read_candidate_metadata(spark, str(tmp_path))
    name = F.substring_index("path", "/", -1)
    rows = [tuple(r) for r in found.candidates.select(name, "position", "candidate_id", "clip_id", "source_bucket", "source_key", "source_start_s", "source_end_s").orderBy("path", "position").collect()]
    assert sorted(rows, key=repr) == sorted(
        [
            ("1.json", 0, "a", "v1", "b", None, 0.0, 1.5), ("1.json", 1, "b", None, "b", None, 0.0, 1.5), ("1.json", 2, "c", "v1", "mine", None, 0.0, 1.5),
            ("3.json", 0, "a", "own", None, None, None, None), ("3.json", 3, "a", None, None, None, None, None), ("4.json", 0, "flat", None, None, None, None, None),
        ],
        key=repr,
    )
    errors = sorted(((r[0], -1 if r[1] is None else r[1], r[2]) for r in found.errors.select(name, "position", "problem").collect()))
    assert errors == [
        ("2.json", 0, "duplicate candidate_id"), ("2.json", 1, "missing candidate_id"), ("2.json", 2, "missing candidate_key"), ("2.json", 3, "no JSON object"),
        ("2.json", 4, "missing source_end_s"), ("2.json", 4, "missing source_start_s"), ("2.json", 5, "negative time"), ("2.json", 6, "times are no numbers"), ("2.json", 7, "start is not before end"),
        ("6.json", -1, "malformed JSON"), ("7.json", -1, "missing source_video_id"), ("8.json", -1, "candidates is no list"), ("9.json", -1, "unexpected content"),
    ]
    assert tuple(found.stats.first()) == (9, 1, 4)
    assert json.loads(found.candidates.filter("candidate_id = 'b'").first()["record"])["extra"] == {"n": [1]}


@pytest.fixture
def objects(tmp_path):
    for key, n in (("top.mp4", 1), ("a/x.mp4", 2), ("a/deep/y.MOV", 3), ("ab/z.txt", 4), ("b/only.mp4", 5), ("b/c/d/e.mp4", 6)):
        at = tmp_path / "store" / key
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_bytes(b"x" * n)
    (tmp_path / "store" / "empty").mkdir()
    return str(tmp_path / "store")


def test_inventory_lists_levels_in_partitions(spark, objects):
    inventory.register(spark)
    read = lambda **o: spark.read.format("object_inventory").options(path=objects, **o).load()
    every = read()
    assert {r["key"]: r["size"] for r in every.collect()} == {"top.mp4": 1, "a/x.mp4": 2, "a/deep/y.MOV": 3, "ab/z.txt": 4, "b/only.mp4": 5, "b/c/d/e.mp4": 6}
    assert every.rdd.getNumPartitions() == 5 and every.filter("etag is null or last_modified is null").count() == 0
    assert {r["key"] for r in read(prefix="b/").collect()} == {"only.mp4", "c/d/e.mp4"}
    assert {r["key"] for r in read(prefix="a").collect()} == {"a/x.mp4", "a/deep/y.MOV", "ab/z.txt"}
    assert read(prefix="none/").count() == 0
    with pytest.raises(Exception, match="path"):
        spark.read.format("object_inventory").load().count()


def test_inventory_takes_the_prefix_from_the_filter(spark, objects):
    listed = []

    def lister(root, prefix):
        listed.append(prefix)
        yield from inventory.list_folder(root, prefix)

    reader = inventory.InventoryReader(objects, "", lister).fixed()
    kept = list(reader.pushFilters([inventory.StringStartsWith(("key",), "b/c"), inventory.EqualTo(("size",), 6)]))
    got = [row for p in reader.partitions() for row in reader.read(p)]
    assert len(kept) == 2 and [r[0] for r in got] == ["b/c/d/e.mp4"] and not any(p.startswith("a") for p in listed)
    inventory.register(spark)
    rows = spark.read.format("object_inventory").option("path", objects).load().filter(F.col("key").startswith("a/") & (F.col("size") > 2)).collect()
    assert [r["key"] for r in rows] == ["a/deep/y.MOV"]


def test_manifest_batches_replace_themselves_and_prune(spark, tmp_path):
    path = str(tmp_path / "manifest")
    rows = lambda *r: spark.createDataFrame([(c, s, i) for c, s, i in r], "crop_id string, split string, geometry_x long")
    manifest.save_manifest(rows(("a", "train", 1), ("b", "val", 2)), path, "one", "2024-05-01T00:00:00Z")
    manifest.save_manifest(rows(("c", "train", 3)), path, "two")
    manifest.save_manifest(rows(("a", "train", 9), ("d", "train", 4)), path, "one")  # the batch again: its val rows stay, its train rows are replaced
    held = lambda: sorted((r["crop_id"], r["split"], r["batch_id"], r["geometry_x"]) for r in manifest.load_manifest(spark, path).collect())
    assert held() == [("a", "train", "one", 9), ("b", "val", "one", 2), ("c", "train", "two", 3), ("d", "train", "one", 4)]
    assert manifest.append_manifest(rows(("a", "test", 0), ("e", "test", 5), ("e", "test", 6)), path, None) == 6
    assert [r["geometry_x"] for r in manifest.load_manifest(spark, path).filter("split = 'test' and batch_id is null").orderBy("geometry_x").collect()] == [5, 6]
    loaded = manifest.load_manifest(spark, path)
    assert loaded.schema == manifest.MANIFEST and loaded.filter("created_at is null").count() == 0
    plan = loaded.filter("split = 'train' and batch_id = 'one' and crop_id = 'a'").select("crop_id")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(split" in plan and "EqualTo(crop_id,a)" in plan and "ReadSchema: struct<crop_id:string>" in plan


def test_nested_audit_reads_back_equal(spark, tmp_path):
    events = spark.createDataFrame([("c1", "k1", "p1", "pickup", 0.0, 0.5, 1.0, 0.9), ("c1", "k2", "p2", "pickup", 0.1, 0.6, 1.1, 0.8), ("c1", "k3", "p3", "pickup", 0.0, 0.4, 1.2, 0.7), (None, "k9", "p9", "putdown", 5.0, 5.5, 6.0, 0.6)], "clip_id string, candidate_id string, pred_id string, type string, t_start double, transfer_s double, t_end double, score double")
    dropped = audit.suppressions(events, spark.createDataFrame([("p2", "p1"), ("p3", "p1")], "dropped string, kept string"))
    notes = spark.createDataFrame([("c1", "k1", False, None, 4, 1), ("c2", "k7", True, "missing_pose_observations", 0, 0)], "clip_id string, candidate_id string, skipped boolean, skip_reason string, n_samples long, n_events long")
    nested = audit.nested_audit(events, dropped, notes)
    audit.write_audit(nested, str(tmp_path / "audit"))
    back = audit.read_audit(spark, str(tmp_path / "audit"))
    assert back.schema.simpleString() == nested.schema.simpleString() and sorted(map(repr, back.collect())) == sorted(map(repr, nested.collect()))
    one = {r["clip_id"]: r for r in back.collect()}["c1"]
    s = one["suppressions"][0]
    assert (s["kept"], s["dropped"], s["dropped_scores"]) == ("p1", ["p2", "p3"], [0.8, 0.7]) and len(one["events"]) == 3
    assert abs(s["max_tiou"] - 1.0 / 1.2) < 1e-12 and abs(s["max_transfer_s"] - 0.1) < 1e-12
    assert one["diagnostics"][0]["skip_reason"] is None and len(back.filter("clip_id is null").first()["events"]) == 1
    many = audit.nested_audit(events, dropped, notes, most=1)
    assert many.filter("clip_id = 'c1'").count() > 1 and many.select(F.explode("events")).count() == 4
    assert os.path.exists(tmp_path / "audit" / "_SUCCESS") and audit.nested_audit(events.limit(0), dropped.limit(0), notes.limit(0)).count() == 0
