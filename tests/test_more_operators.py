"""Operators that SQL cannot express, against loops; hot keys; whole tables without an oracle."""

import collections
import itertools
import random

import pytest
from pyspark.sql import functions as F

from eventloom.operators import candidates, decode, evaluate, intervals, lookups, windows
from eventloom.plans import queries as q
from tests.conftest import SF


@pytest.mark.parametrize("name", sorted(set(q.queries()) - set(q.oracle_sql())))
def test_query_without_oracle_runs(spark, name):
    assert q.queries()[name](spark, SF).count() > 0


def span_loop(start, end, duration=10.0, step=5.0, least=2.0, cap=50):
    out, t = [], start
    if end - start < least:
        return out
    while True:
        stop = min(t + duration, end)
        if stop - t < least:
            if out and out[-1][1] - (out[-1][0] + least) > 0:
                t = out.pop()[0]
                out.append((t, t + least))
                t += least
                continue
            return out
        if len(out) >= cap:
            return out
        out.append((t, stop))
        if t + step >= end:
            return out
        t += step


def test_span_windows_equal_a_loop(spark):
    ends = [x / 4 for x in range(0, 1400)]
    df = spark.createDataFrame([(3.0, 3.0 + e) for e in ends], "s double, e double")
    got = {r["e"]: [(w["s"], w["e"]) for w in r["w"]] for r in df.select("e", windows.span_windows(F.col("s"), F.col("e")).alias("w")).collect()}
    assert got == {3.0 + e: span_loop(3.0, 3.0 + e) for e in ends}


def iou(a, b):
    shared = max(0.0, min(a[1], b[1]) - max(a[0], b[0]))
    union = a[1] - a[0] + b[1] - b[0] - shared
    return shared / union if union > 0 else 0.0


def test_nms_and_audit_equal_a_loop(spark):
    rng = random.Random(3)
    rows = [(f"c{rng.randint(0, 2)}", "pickup", f"p{i}", s := rng.randint(0, 80) / 4, s + rng.randint(1, 12) / 4, s + rng.random(), rng.randint(0, 50) / 50) for i in range(200)]
    kept, audit = decode.temporal_nms(spark.createDataFrame(rows, "clip_id string, type string, pred_id string, t_start double, t_end double, transfer_s double, score double"))
    want, lost = [], {}
    for r in sorted(rows, key=lambda r: (-r[6], r[3], r[2])):
        by = next((k for k in want if k[0] == r[0] and iou(k[3:5], r[3:5]) >= 0.5 and abs(k[5] - r[5]) <= 0.5), None)
        if by:
            lost[r[2]] = by[2]
        else:
            want.append(r)
    assert {r["pred_id"] for r in kept.collect()} == {r[2] for r in want}
    assert {r["dropped"]: r["kept"] for r in audit.collect()} == lost


def test_merge_of_regions_folds_the_mean(spark):
    rows = [("c", "pickup", 0.0, 1.0, 0.9, 0.8), ("c", "pickup", 1.5, 2.0, 0.7, 0.4), ("c", "pickup", 2.5, 3.0, 0.5, 0.2), ("c", "pickup", 9.0, 9.1, 1.0, 1.0), ("c", "putdown", 0.5, 1.0, 0.6, 0.6)]
    out = decode.merge_same_type_regions(spark.createDataFrame(rows, "clip_id string, type string, t_start double, t_end double, peak double, mean double")).collect()
    assert sorted((r["type"], r["t_start"], r["t_end"], r["peak"], round(r["mean"], 9)) for r in out) == [("pickup", 0.0, 3.0, 0.9, 0.4), ("putdown", 0.5, 1.0, 0.6, 0.6)]


def test_actors_are_assigned_one_to_one(spark):
    poses = [("a", "c", 0, 1.0, "left", 0.0, 0.0, 10.0, 10.0, "?"), ("b", "c", 0, 1.0, "right", 0.0, 0.0, 10.0, 10.0, "?"), ("d", "c", 0, 1.0, "left", 2.0, 0.0, 12.0, 10.0, "?"), ("e", "c", 1, 9.0, "left", 0.0, 0.0, 10.0, 10.0, "?")]
    people = [("c", "ann", 1.1, 0.0, 0.0, 10.0, 10.0), ("c", "bob", 0.8, 1.0, 0.0, 11.0, 10.0), ("c", "bob", 1.2, 1.0, 0.0, 11.0, 10.0)]
    p = spark.createDataFrame(poses, "pose_id string, clip_id string, frame long, t_h double, hand_side string, px1 double, py1 double, px2 double, py2 double, actor_id string")
    out = candidates.associate_actors(p, spark.createDataFrame(people, "clip_id string, person_id string, t_h double, x1 double, y1 double, x2 double, y2 double"))
    assert {r["pose_id"]: (r["actor_id"], r["association"] is None) for r in out.collect()} == {"a": ("ann", False), "b": ("ann", False), "d": ("bob", False), "e": ("?", True)}


def test_filters_of_hot_clips_equal_loops(spark):
    rng = random.Random(5)
    left = [(f"c{rng.randint(0, 1)}", i, s := rng.randint(0, 40000) / 4, s + rng.choice([0, 1, 59, 61, 300, 20000])) for i in range(400)] + [(None, 999, 1.0, 2.0)]
    right = [(f"c{rng.randint(0, 1)}", s := rng.randint(0, 40000) / 4, s + rng.choice([0, 0.25, 5, 90, 5000])) for _ in range(60)]
    a, b = spark.createDataFrame(left, "k string, i long, s double, e double"), spark.createDataFrame(right, "k string, rs double, re double")
    for closed in (False, True):
        hit = {i for k, i, s, e in left for rk, rs, re in right if k == rk and ((s <= re and rs <= e) if closed else (s < re and rs < e))}
        for keep in (True, False):
            got = [r["i"] for r in intervals.overlap_filter(a, b, "k", "s", "e", "rs", "re", keep, closed).collect()]
            assert sorted(got) == sorted(i for _, i, _, _ in left if (i in hit) == keep)
        pairs = {(r["i"], r["rs"], r["re"]) for r in intervals.overlap_join(a, b, ["k"], "s", "e", "rs", "re", closed).collect()}
        assert pairs == {(i, rs, re) for k, i, s, e in left for rk, rs, re in right if k == rk and ((s <= re and rs <= e) if closed else (s < re and rs < e))}


def test_nearest_keeps_equal_rows(spark):
    left = spark.createDataFrame([("c", 1.0), ("c", 1.0), ("c", 50.0), (None, 1.0)], "k string, t double")
    right = spark.createDataFrame([("c", 0.5, "a"), ("c", 1.5, "b")], "k string, u double, v string")
    out = intervals.nearest_observation(left, right, "k", "t", "u", 2.0, ["v"]).collect()
    assert sorted(map(repr, ((r["k"], r["t"], r["v"]) for r in out))) == sorted(map(repr, [("c", 1.0, "a"), ("c", 1.0, "a"), ("c", 50.0, None), (None, 1.0, None)]))


def best_match(accepted):
    events, preds = sorted({e for e, _ in accepted}), sorted({p for _, p in accepted})
    top = (0, 0.0)
    for k in range(min(len(events), len(preds)) + 1):
        for es in itertools.combinations(events, k):
            for ps in itertools.permutations(preds, k):
                if all((e, p) in accepted for e, p in zip(es, ps)):
                    top = max(top, (k, sum(accepted[e, p] for e, p in zip(es, ps))))
    return top


def test_dense_matching_equals_brute_force(spark):
    rng = random.Random(8)
    gt, pred = [], []
    for c in range(300):
        gt += [(f"e{c}_{i}", f"c{c}", "pickup", s := rng.randint(0, 12) / 4, s + rng.randint(2, 8) / 4) for i in range(rng.randint(0, 3))]
        pred += [(f"p{c}_{i}", f"c{c}", "pickup", s := rng.randint(0, 12) / 4, s + rng.randint(2, 8) / 4, rng.random()) for i in range(rng.randint(0, 3))]
    g = spark.createDataFrame(gt, "event_id string, clip_id string, type string, t_start double, t_end double")
    p = spark.createDataFrame(pred, "pred_id string, clip_id string, type string, t_start double, t_end double, score double")
    pairs = evaluate.accepted_pairs(g, p, ["clip_id", "type"], 0.3)
    got = collections.defaultdict(lambda: (0, 0.0))
    for r in evaluate.match_one_to_one(pairs, ["clip_id", "type"]).collect():
        n, s = got[r["clip_id"]]
        got[r["clip_id"]] = (n + 1, s + r["quality"])
    for c in range(300):
        accepted = {(e[0], x[0]): v for e in gt for x in pred if e[1] == x[1] == f"c{c}" and (v := iou(e[3:5], x[3:5])) >= 0.3}
        n, s = best_match(accepted)
        assert got[f"c{c}"][0] == n and abs(got[f"c{c}"][1] - s) < 1e-9
    ranked = {}
    for x in sorted(pred, key=lambda x: (-x[5], x[3], x[4], x[0])):
        free = [(-iou(e[3:5], x[3:5]), e[3], e[4], e[0]) for e in gt if e[1] == x[1] and e[0] not in ranked and iou(e[3:5], x[3:5]) >= 0.3]
        if free:
            ranked[min(free)[3]] = x[0]
    assert {r["event_id"]: r["pred_id"] for r in evaluate.match_ranked(pairs, ["clip_id", "type"]).collect()} == ranked


def test_other_types_are_refused(spark):
    g = spark.createDataFrame([("e", "c", "restocking", 0.0, 1.0)], "event_id string, clip_id string, type string, t_start double, t_end double")
    p = spark.createDataFrame([("p", "c", "pickup", 0.0, 1.0, 0.5)], "pred_id string, clip_id string, type string, t_start double, t_end double, score double")
    with pytest.raises(Exception, match="not an event type"):
        evaluate.class_aware(g, p).collect()


def test_pilot_takes_a_share_of_each_stratum(spark):
    rows = spark.createDataFrame([(f"k{i}", "a" if i % 10 else "b", None) for i in range(200)], "k string, s string, t string")
    got = [tuple(r) for r in lookups.pilot_select(rows, "k", ["t", "s"], 20).collect()]
    assert len(set(got)) == 20 and collections.Counter(s for _, s in got) == {"a": 18, "b": 2}
    assert sorted(got) == sorted(tuple(r) for r in lookups.pilot_select(rows.repartition(7), "k", ["t", "s"], 20).collect())


def test_nms_in_one_dense_clip_equals_a_loop(spark):
    rng = random.Random(7)
    rows = [("c", "pickup", f"p{i}", s := rng.randint(0, 60) / 4, s + rng.randint(0, 9) / 4, s + rng.randint(0, 4) / 4, rng.randint(0, 20) / 20) for i in range(2500)]
    kept, audit = decode.temporal_nms(spark.createDataFrame(rows, "clip_id string, type string, pred_id string, t_start double, t_end double, transfer_s double, score double"))
    want, lost = [], {}
    for r in sorted(rows, key=lambda r: (-r[6], r[3], r[2])):
        by = next((k for k in want if iou(k[3:5], r[3:5]) >= 0.5 and abs(k[5] - r[5]) <= 0.5), None)
        if by:
            lost[r[2]] = by[2]
        else:
            want.append(r)
    assert {r["pred_id"] for r in kept.collect()} == {r[2] for r in want}
    assert {r["dropped"]: r["kept"] for r in audit.collect()} == lost


def test_merged_windows_stay_apart_over_a_gap(spark):
    rows = [("c", "pickup", "a", 0.0, 1.0, 0.4, 1, "w1"), ("c", "pickup", "b", 1.3, 2.0, 0.9, 2, "w2"), ("c", "no_event", "x", 0.5, 1.5, 1.0, 9, "w3"), ("c", "pickup", "d", 2.0, 3.0, 0.5, 1, "w4"), ("c", "pickup", "e", 2.5, 3.5, 0.6, 1, "w4")]
    df = spark.createDataFrame(rows, "clip_id string, type string, pred_id string, t_start double, t_end double, score double, items int, window_id string")
    got = sorted((r["t_start"], r["t_end"], r["score"], r["items"], r["pred_ids"], r["window_ids"], r["group_id"] != "") for r in decode.merge_window_predictions(df, 0.5).collect())
    # a and b join over a positive gap but stay two intervals; d touches b exactly, which breaks
    assert got == [(0.0, 1.0, 0.9, 2, ["a", "b"], ["w1", "w2"], True), (1.3, 2.0, 0.9, 2, ["a", "b"], ["w1", "w2"], True), (2.0, 3.5, 0.6, 1, ["d", "e"], ["w4"], False)]


def test_components_of_a_long_chain_and_a_star(spark):
    from eventloom.operators.graphs import connected

    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(500, 600)] + [(5, 5)]
    got = {r["node"]: r["label"] for r in connected(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {i: 7 for i in [7, *range(500, 600)]} | {5: 5}


def test_people_sweep_equals_counting(spark):
    rng = random.Random(9)
    tracks = [(f"c{rng.randint(0, 2)}", float(s := rng.randint(0, 60)), float(s + rng.randint(0, 9))) for _ in range(120)] + [(None, 1.0, 2.0)]
    events = [(i, f"c{rng.randint(0, 3)}", float(s := rng.randint(0, 60)), float(s + rng.randint(0, 5))) for i in range(100)]
    out = evaluate.people_at(spark.createDataFrame(events, "event_id long, clip_id string, t_start double, t_end double"), spark.createDataFrame(tracks, "clip_id string, first_seen double, last_seen double"), bucket=7.0)

    def most(e):
        mine = [t for t in tracks if t[0] == e[1]]
        return max((sum(a <= x <= b for _, a, b in mine) for x in [e[2], *(a for _, a, _ in mine if e[2] <= a <= e[3])]), default=0)

    assert {r["event_id"]: r["n_person"] for r in out.collect()} == {e[0]: most(e) for e in events}


def test_gallery_of_contested_types(spark):
    g = spark.createDataFrame([("e1", "c", "pickup", 0.0, 2.0), ("e2", "c", "putdown", 0.2, 2.2), ("e3", "c", "pickup", 9.0, 9.5)], "event_id string, clip_id string, type string, t_start double, t_end double")
    p = spark.createDataFrame([("p1", "c", "putdown", 0.0, 2.0, 0.5), ("p2", "c", "pickup", 0.1, 2.1, 0.4), ("p3", "d", "pickup", 0.0, 1.0, 0.3)], "pred_id string, clip_id string, type string, t_start double, t_end double, score double")
    got = sorted((r["category"], r["event_id"] or "", r["pred_id"] or "") for r in evaluate.gallery(g, p).collect())
    # by type, e1-p2 and e2-p1 match; whatever the type, e1-p1 and e2-p2 are the better pairs
    assert got == [("false_negative", "e3", ""), ("false_positive", "", "p3"), ("type_confusion", "e1", "p1"), ("type_confusion", "e2", "p2")]


def test_canonical_order_puts_nulls_first(spark):
    rows = spark.createDataFrame([("b", 1.0, None), (None, 2.0, "x"), ("a", 3.0, "y"), ("a", 1.0, "z"), ("a", 1.0, None)], "clip_id string, t double, id string")
    assert [tuple(r) for r in candidates.canonical_order(rows, "clip_id", "t", "id").collect()] == [(None, 2.0, "x"), ("a", 1.0, None), ("a", 1.0, "z"), ("a", 3.0, "y"), ("b", 1.0, None)]


def test_stride_of_frames_and_listing_without_marks(spark):
    out = spark.createDataFrame([(7, 3), (0, 3), (1, 5)], "total int, step int").select(windows.frames_by_stride(F.col("total"), 3).alias("f")).collect()
    assert [r["f"] for r in out] == [[0, 3, 6], [], [0]]
    objects = spark.createDataFrame([("pre/a.mp4", 1), ("pre/b/", 0), ("other/c.mp4", 2)], "key string, size long")
    assert sorted(map(tuple, lookups.inventory(objects, "pre/").collect())) == [("a.mp4", 1), ("other/c.mp4", 2)]


def test_ledger_of_todays_header_keeps_the_last_row_of_a_name(spark):
    from eventloom.operators import dataset

    rows = spark.createDataFrame([("a", "true", "1", "no", " /d/a "), ("a", "true", "1", "yes", ""), (" ", "true", "", "", ""), ("b", "x", None, "", None)], "file_name string, downloaded string, generated string, uploaded string, local_source_path string")
    got = sorted(map(tuple, dataset.read_ledger(rows).select("file_name", "downloaded", "generated", "uploaded", "local_source_path", "last_error").collect()))
    assert got == [("a", True, True, True, "", ""), ("b", False, False, False, "", "")]


def test_polygons_expand_alike_in_columns_and_in_plain_points(spark):
    from eventloom.functions.geometry import expand_polygon, expanded_points

    points = [(10.0, 10.0), (90.0, 20.0), (50.0, 50.0), (50.0, 95.0), (50.0, 75.0)]
    points[2] = (sum(p[0] for p in points if p != points[2]) / 4, sum(p[1] for p in points if p != points[2]) / 4)  # a vertex at the mean
    df = spark.createDataFrame([([{"x": x, "y": y} for x, y in points],)], "p array<struct<x:double,y:double>>")
    got = df.select(expand_polygon(F.col("p"), 15.0, 100, 100).alias("q")).first()["q"]
    want = expanded_points(points, 15.0, 100, 100)
    assert all(abs(a["x"] - b[0]) < 1e-9 and abs(a["y"] - b[1]) < 1e-9 for a, b in zip(got, want, strict=True)) and want[2] == points[2] and max(y for _, y in want) == 99.0
