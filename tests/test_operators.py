import itertools
import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from eventloom.operators import dataset, decode, evaluate, intervals, precision, sampling, trajectories
from eventloom.operators.evaluate import solve
from eventloom.streaming.state_machine import Config, State, feed


def test_solver_equals_brute_force():
    rng = random.Random(7)
    for _ in range(400):
        n, m = rng.randint(1, 3), rng.randint(1, 4)
        s = np.array([[rng.choice([0, 0, rng.random()]) for _ in range(m)] for _ in range(n)])
        best = (0, 0.0)
        for k in range(min(n, m) + 1):
            for a in itertools.combinations(range(n), k):
                for b in itertools.permutations(range(m), k):
                    if all(s[i, j] > 0 for i, j in zip(a, b)):
                        best = max(best, (k, sum(s[i, j] for i, j in zip(a, b))))
        got = solve(s)
        assert len({i for i, _ in got}) == len({j for _, j in got}) == len(got) == best[0]
        assert abs(sum(s[i, j] for i, j in got) - best[1]) < 1e-9


def frames(spark, gt, pred):
    g = spark.createDataFrame([(f"e{i}", "c", t, float(a), float(b)) for i, (t, a, b) in enumerate(gt)], "event_id string, clip_id string, type string, t_start double, t_end double")
    p = spark.createDataFrame([(f"p{i}", "c", t, float(a), float(b), 0.9) for i, (t, a, b) in enumerate(pred)], "pred_id string, clip_id string, type string, t_start double, t_end double, score double")
    return g, p


def status(spark, gt, pred):
    return {r["status"]: r["n"] for r in evaluate.class_aware(*frames(spark, gt, pred)).groupBy("status").agg(F.count("*").alias("n")).collect()}


def test_matching_golden_cases(spark):
    assert status(spark, [("pickup", 1, 2)], [("putdown", 1, 2)]) == {"fn": 1, "fp": 1}
    assert status(spark, [("pickup", 1, 2)] * 2, [("pickup", 1, 2)]) == {"tp": 1, "fn": 1}
    assert status(spark, [("pickup", 1, 2), ("putdown", 2, 3)], [("pickup", 1, 2), ("putdown", 2, 3)]) == {"tp": 2}


def test_merge_touching_and_gap(spark):
    df = spark.createDataFrame([("c", 0.0, 1.0), ("c", 1.0, 2.0), ("c", 3.5, 4.0), ("d", 0.0, 1.0)], "k string, s double, e double")
    assert sorted((r["k"], r["s"], r["e"]) for r in intervals.merge_intervals(df, ["k"], "s", "e").collect()) == [("c", 0.0, 2.0), ("c", 3.5, 4.0), ("d", 0.0, 1.0)]
    assert intervals.merge_intervals(df, ["k"], "s", "e", 1.5).count() == 2


def observations(n, **change):
    for k in range(n):
        inside, empty, carry = 4 <= k <= 15, (0.9, 0.05)[k >= 9], (0.05, 0.9)[k >= 9]
        yield pd.Series({"timestamp_s": k * 0.1, "inside_region": inside, "distance_px": 0.0 if inside else 30.0 if k in (2, 3) else 100.0, "trajectory_confidence": 0.8, "hand_empty": empty, "hand_carrying": carry, "hand_uncertain": 0.05, "shelf_removed": 0.8 if k >= 9 else 0.1, "shelf_placed": 0.1, "shelf_uncertain": 0.05} | change)


def run(rows):
    s = State()
    return [e for r in rows if (e := feed(s, r, Config()))]


def test_state_machine_cycle():
    (e,) = run(observations(20))
    assert (e["type"], e["cycle"]) == ("pickup", 0)
    assert [round(e[k], 3) for k in ("t_start", "transfer_s", "t_end", "confidence")] == [0.2, 0.9, 1.1, 0.819]
    assert run(observations(20, shelf_removed=0.1)) == []
    assert run(observations(20, hand_carrying=0.1)) == []
    assert run(observations(9)) == []


def ap(spark, gt, pred):
    g, p = frames(spark, gt, [x[:3] for x in pred])
    scores = spark.createDataFrame([(f"p{i}", x[3]) for i, x in enumerate(pred)], "pred_id string, score double")
    return {r["type"]: r["ap"] for r in precision.average_precision(g, p.drop("score").join(scores, "pred_id")).collect()}


def test_average_precision_golden_cases(spark):
    one = [("pickup", 0, 10)]
    assert ap(spark, one, [("pickup", 0, 10, 0.9), ("pickup", 0, 10, 0.8)]) == {"pickup": 1.0}
    assert ap(spark, one, [("pickup", 50, 60, 0.9), ("pickup", 0, 10, 0.8), ("putdown", 0, 10, 0.5)]) == {"pickup": 0.5, "putdown": None}
    assert ap(spark, [*one, ("pickup", 1, 11)], [("pickup", 1, 11, 0.8), ("pickup", 0, 10, 0.9), ("pickup", 1, 11, 0.1)]) == {"pickup": 1.0}


def test_raw_interactions_equal_a_loop(spark):
    rng = random.Random(11)
    rows, want = [], []
    for k in range(60):
        t, last, start, missed = 0.0, None, None, False
        steps = []
        for _ in range(rng.randint(1, 25)):
            t += rng.choice([0.5, 1.0, 1.5, 4.0])
            steps.append((t, rng.random() < 0.6))
        for j, (t, ok) in enumerate(steps):
            rows.append((k, t, ok, 0.9))
            before = steps[j - 1][0] if j else None
            if start is not None and (t - before > 3 or (not ok and t - last > 1.0)):
                want.append((k, start, last))
                start = None
            if ok:
                start, last = (t if start is None else start), t
        if start is not None:
            want.append((k, start, last))
    df = spark.createDataFrame(rows, "k int, t_h double, inside boolean, confidence double")
    got = trajectories.raw_interactions(df, ["k"], max_gap=3.0, tolerance=1.0)
    assert sorted((r["k"], r["t_start"], r["t_end"]) for r in got.collect()) == sorted(want)


def test_spans_and_summaries_are_of_stable_tracks(spark):
    times = {("a", "x"): [10.0, 15.0, 23.0], ("a", "y"): [2.0, 40.0], ("b", "x"): [5.0], ("c", "x"): [730.0, 745.0]}
    rows = [(c, k, i, t, 0.1 if k == "y" else 0.9) for (c, k), ts in times.items() for i, t in enumerate(ts)]
    obs = dataset.with_stability(spark.createDataFrame(rows, "clip_id string, track_key string, sample_index int, t_h double, confidence double"), 48.0, 2, 10.0, 0.2)
    spans = intervals.active_spans(obs)
    assert [(r["clip_id"], r["t_start"], r["t_end"]) for r in spans.orderBy("clip_id", "t_start").collect()] == [("a", 9.5, 15.5), ("a", 22.5, 23.5)]
    clips = spark.createDataFrame([("a",), ("d",)], "clip_id string")
    got = {r["clip_id"]: tuple(r)[1:] for r in intervals.clip_summary(clips, obs, spans).collect()}
    assert got == {"a": (1, True, 2, 9.5, 23.5, 7.0), "b": (0, False, 0, None, None, 0.0), "c": (1, False, 0, None, None, 0.0), "d": (0, False, 0, None, None, 0.0)}


def test_qa_sample_ranks_only_the_cut_bucket(spark):
    rows = spark.range(3000).selectExpr("concat('n', id % 2900) k", "id")
    ranked = [tuple(r) for r in rows.select(sampling.hash_bucket(42, F.col("k")), "k").collect()]
    for rate, n in ((0.0, 1), (0.1, 300), (0.3337, 1002), (1.0, 3000)):
        out = sampling.qa_sample(rows, "k", rate)
        assert sorted((r["bucket"], r["k"]) for r in out.collect()) == sorted(ranked)[:n]
        assert "TakeOrdered" not in (plan := out._jdf.queryExecution().executedPlan().toString()) and "GlobalLimit" not in plan
    assert sampling.qa_sample(rows.limit(0), "k", 0.1).collect() == []
