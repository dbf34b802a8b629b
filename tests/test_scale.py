"""Plans and forms that keep their cost in proportion to the input."""

import random
import re

import pytest
from pyspark.sql import functions as F

from eventloom.operators import intervals, lookups, precision, responses, windows
from eventloom.plans.fixtures import view
from eventloom.sources import metadata
from tests.conftest import SF


def plan(df):
    return df._jdf.queryExecution().toString()


def test_growing_sides_are_not_broadcast(spark):
    rows = spark.createDataFrame([(f"k{i}", "c", float(i), float(i + 3)) for i in range(20)], "key string, clip_id string, s double, e double")
    pairs = intervals.overlap_join(rows, rows.select("clip_id", F.col("s").alias("rs"), F.col("e").alias("re")), ["clip_id"], "s", "e", "rs", "re")
    near = intervals.nearest_observation(rows.select("clip_id", "s"), rows.select("clip_id", "e", "key"), "clip_id", "s", "e", 2.0, ["key"])
    for df in (pairs, near, lookups.numbered(rows, "key", 3)):
        assert "BroadcastHashJoin" not in plan(df)
    assert sorted((r["key"], r["n"]) for r in lookups.numbered(rows, "key", 3).collect()) == [(k, i) for i, k in enumerate(sorted(f"k{i}" for i in range(20)))]


def test_nearest_shuffles_the_left_side_once_and_equals_a_loop(spark):
    rng = random.Random(3)
    left = [("ab"[i % 2], rng.randrange(200) / 4) for i in range(60)]
    right = [("ab"[i % 2], rng.randrange(200) / 4, rng.randrange(5)) for i in range(60)]
    a, b = spark.createDataFrame(left, "k string, t double"), spark.createDataFrame(right, "k string, u double, v int")
    near = intervals.nearest_observation(a, b, "k", "t", "u", 0.5, ["v"])
    # one exchange a side; the left one was grouped by all its columns before and after the join
    assert len(re.findall(r"Exchange hashpartitioning", plan(near.select("*")).split("== Physical Plan ==")[1])) == 2
    best = lambda k, t: min(((abs(u - t), u, v) for rk, u, v in right if rk == k and abs(u - t) <= 0.5), default=(None, None, None))[1:]
    assert sorted(map(repr, map(tuple, near.collect()))) == sorted(repr((k, t, *best(k, t))) for k, t in left)


def test_labels_bring_more_columns_of_their_event(spark):
    c = spark.createDataFrame([("c1", "v", 0.0, 2.0), ("c2", "v", 9.0, 11.0), ("c3", "w", 0.0, 2.0)], "candidate_id string, clip_id string, raw_start_s double, raw_end_s double")
    e = spark.createDataFrame([("e1", "v", "pickup", 0.0, 1.5, "med"), ("e2", "v", "putdown", 1.5, 2.0, "high"), ("e3", "v", "pickup", 10.5, 12.0, "low")], "event_id string, clip_id string, type string, t_start double, t_end double, confidence string")
    found = intervals.assign_label(c, e, values=["confidence"])
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, [("c1", "pickup", "e1", "med"), ("c2", "negative", None, None), ("c3", "negative", None, None)]))


def test_envelope_reads_each_row_once_and_equals_a_loop(spark):
    rng = random.Random(5)
    gt = [(f"e{i}", "c", "pickup", 10.0 * i, 10.0 * i + 4) for i in range(60)]
    pred = [(f"p{i}", "c", "pickup", t := 10.0 * i + rng.choice((0, 3)), t + 4, rng.randint(0, 3) / 4000) for i in range(80)]
    out = precision.average_precision(spark.createDataFrame(gt, "event_id string, clip_id string, type string, t_start double, t_end double"), spark.createDataFrame(pred, "pred_id string, clip_id string, type string, t_start double, t_end double, score double"))
    assert "unboundedfollowing" not in plan(out).lower()
    hits = [int(p[3] % 10 == 0 and p[3] < 600) for p in sorted(pred, key=lambda p: (-p[5], p[3], p[4], p[1], p[0]))]
    curve = [sum(hits[: i + 1]) / (i + 1) for i in range(len(hits))]
    want = sum(max(curve[i:]) for i, h in enumerate(hits) if h) / 60
    assert out.first()["ap"] == pytest.approx(want, abs=1e-12)


def test_json_is_parsed_once_into_a_stored_table(spark):
    files = spark.createDataFrame([("a", '[{"candidate_id": "x", "clip_id": "c"}]'), ("b", "{")], "path string, value string")
    found = metadata.parse_candidate_metadata(files)
    answers = spark.createDataFrame([("r", '{"events": []}', 0), ("s", "{", 0), ("t", '{"events": [5]}', 0)], "response_id string, content string, frame_count int")
    events, errors = responses.model_events(answers)
    for df in (*found, events, errors):
        assert "parse_json" not in plan(df).lower()
    assert [tuple(r) for r in found.errors.select("path", "problem").collect()] == [("b", "malformed JSON")]
    assert sorted((r["source"], r["message"]) for r in errors.collect()) == [("s", "is not JSON"), ("t", "is not an object")]
    assert found.stats.first()[0] == 2


def test_views_are_dealt_by_a_key(spark):
    df = view(spark, SF, "fx_export", "o_orderkey")
    assert "RepartitionByExpression [o_orderkey" in plan(df) and df.rdd.getNumPartitions() == 8 * spark.sparkContext.defaultParallelism


def test_windows_meet_events_in_runs_and_equal_a_loop(spark):
    rng = random.Random(9)
    spans = [(f"k{i}", "c", s := rng.randint(0, 400) / 4, s + rng.choice((1.0, 3.3, 20.0, 200.0))) for i in range(12)]
    events = [(f"e{i}", "c", rng.choice(("pickup", "putdown")), s := rng.randint(0, 1200) / 4, s + rng.randint(0, 20) / 4) for i in range(60)]
    out = windows.window_manifest(spark.createDataFrame(spans, "candidate_id string, clip_id string, window_start_s double, window_end_s double"), spark.createDataFrame(events, "event_id string, clip_id string, type string, t_start double, t_end double"))
    assert out.columns == ["candidate_id", "k", "clip_id", "window_start_s", "window_end_s", "center", "label"]
    got = out.collect()
    for key, _, s, e in spans:
        mine = sorted((r for r in got if r["candidate_id"] == key), key=lambda r: r["k"])
        assert [r["k"] for r in mine] == list(range(len(mine))) and len(mine) >= int((e - s - 2.5) / 0.5) + 1
        assert mine[-1]["window_end_s"] == pytest.approx(e, abs=0.1) and mine[0]["window_start_s"] == pytest.approx(s)
    for r in got:
        held = sorted((t, name, kind) for name, _, kind, t, u in events if t <= r["center"] <= u)
        assert r["label"] == (held[0][2] if held else "background")
    assert "hashpartitioning(candidate_id" in plan(out) and not re.search(r"hashpartitioning\(candidate_id#\d+, k#", plan(out))


def test_interval_filter_asks_once_a_level(spark):
    rows = spark.createDataFrame([(i, "c", float(i * 7), float(i * 7 + n)) for i, n in enumerate((3, 60, 200, 1, 59, 5000) * 8)], "i long, clip_id string, t_start double, t_end double")
    ignores = [(20.0, 25.0), (59.5, 61.0), (119.0, 120.0), (299.0, 330.0)]
    out = intervals.drop_ignored(rows, spark.createDataFrame([("c", *x) for x in ignores], "clip_id string, t_start double, t_end double"))
    assert plan(out).split("== Physical Plan ==")[1].count("LeftAnti") == 7
    assert {r["i"] for r in out.collect()} == {r["i"] for r in rows.collect() if not any(r["t_start"] < b and a < r["t_end"] for a, b in ignores)}


def test_key_ranges_follow_the_order_of_keys(spark):
    rng = random.Random(4)
    keys = [f"k_{rng.randrange(10**6)}" for _ in range(3000)] + ["é", None]
    df = spark.createDataFrame([(k,) for k in keys], "key string")
    got = df.select("key", lookups.key_ranges(df, "key", 200).alias("b")).collect()
    b = [r["b"] for r in sorted(got, key=lambda r: (r["key"] is None, (r["key"] or "").encode()))]
    assert b == sorted(b) and set(b) == set(range(16)) and max(map(b.count, set(b))) < 600
    assert {r[0] for r in df.select(lookups.key_ranges(df, "key")).collect()} == {0}


def test_samples_are_taken_out_of_stored_runs_and_equal_a_loop(spark):
    rng = random.Random(11)
    spans = [(f"k{i}", rng.choice("cd"), s := rng.randint(0, 2400) / 4, s + rng.choice((0.3, 1.0, 2.5, 3.3, 20.0, 200.0))) for i in range(40)]
    spans += [("k0", "c", 50.0, 54.0), ("k5", "e", 7.0, 70.7), ("k7", None, 3.0, 9.0), (None, "c", 100.0, 103.0), (None, "d", 59.0, 63.0)]
    events = [(f"e{i}", rng.choice("cd"), rng.choice(("pickup", "putdown", "other")), s := rng.randint(0, 3200) / 4, s + rng.randint(0, 20) / 4, rng.choice(("low", "med", "high"))) for i in range(120)]
    events += [("far", "c", "pickup", 300.0, 9000.0, "low"), ("back", "c", "pickup", 60.0, 50.0, "low"), ("none", "d", "pickup", None, 50.0, "low")]
    ignores = [(rng.choice("cd"), s := rng.randint(0, 3200) / 4, s + rng.choice((0.0, 3.0))) for _ in range(40)] + [("d", 500.0, 30000.0)]
    out = windows.window_samples(
        spark.createDataFrame(spans, "candidate_id string, clip_id string, window_start_s double, window_end_s double"),
        spark.createDataFrame(events, "event_id string, clip_id string, type string, t_start double, t_end double, confidence string"),
        spark.createDataFrame(ignores, "clip_id string, t_start double, t_end double"),
        spark.createDataFrame([("c", "train"), ("d", "val")], "clip_id string, split string"),
    )
    want = []
    for key, clip, s, e in spans:
        n = int((e - s - 2.5) / 0.5 + 1e-9) if e - s > 2.5 else 0
        cut = [(s + i * 0.5, s + i * 0.5 + 2.5) for i in range(n + 1)] if e - s > 2.5 else [(max(s, (s + e) / 2 - 1.25), min(e, (s + e) / 2 + 1.25))]
        if e - s > 2.5 and s + n * 0.5 + 2.5 < e - 0.1:
            cut.append((e - 2.5, e))
        for k, (a, b) in enumerate(cut if e - s >= 0.5 else []):
            m = (a + b) / 2
            if not any(c == clip and x <= m <= y for c, x, y in ignores):
                held = [(t, name, kind, sure) for name, c, kind, t, u, sure in events if c == clip and kind != "other" and t is not None and t <= m <= u]
                want.append((key, k, clip, a, b, held))
    labels = {}
    for key, k, *_, held in want:
        labels.setdefault((key, k), []).extend(held if key is not None else [])
    got = out.collect()
    assert sorted(r["sample_id"] for r in got) == [f"b1_{i:06d}" for i in range(len(want))]
    first = lambda key, k: min(labels[key, k], default=(None, None, "background", None))
    split = {"c": "train", "d": "val"}
    rows = [(key, k, clip, a, b, *(f := first(key, k))[2:0:-1], f[3], 0.5 if f[3] == "low" else 1.0, split.get(clip)) for key, k, clip, a, b, _ in want]
    names = ("candidate_id", "k", "clip_id", "window_start_s", "window_end_s", "label", "event_id", "event_confidence", "weight", "split")
    assert sorted(map(repr, rows)) == sorted(repr(tuple(r[c] for c in names)) for r in got)
    assert "far" in {r["event_id"] for r in got} and len(want) > 500
    order = [(r["candidate_id"] is None, r["candidate_id"] or "", r["k"]) for r in sorted(got, key=lambda r: r["sample_id"])]
    assert order == sorted(order)
    # candidates of ids of their own: what is left to do after the stored runs has no exchange
    one = windows.window_samples(*[spark.createDataFrame(rows, kind) for rows, kind in ((spans[:9], "candidate_id string, clip_id string, window_start_s double, window_end_s double"), (events, "event_id string, clip_id string, type string, t_start double, t_end double, confidence string"), (ignores, "clip_id string, t_start double, t_end double"), ([("c", "train")], "clip_id string, split string"))], split="train")
    assert "Exchange" not in plan(one).split("== Physical Plan ==")[1] and {r["clip_id"] for r in one.collect()} == {"c"}
