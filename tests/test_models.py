"""State classifiers, batch models, responses and the grace window against loops and formulas."""

import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventloom.operators import evidence, models, responses
from eventloom.streaming.state_machine import KEY

CLASSES = ["carrying", "empty"]


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(300):
        y = int(rng.random() < 0.25)
        rows.append((i, (rng.normal(0, 1, 3) + y).tolist(), CLASSES[y]))
    return spark.createDataFrame([*rows, (900, None, "empty"), (901, [0.0, 0.0, 0.0], None)], "id long, embedding array<double>, state string").cache()


@pytest.fixture(scope="module")
def model(vectors):
    return models.train_state_classifier(vectors, CLASSES)


def test_classifier_stands_at_the_minimum_of_its_objective(vectors, model):
    pdf = vectors.dropna().toPandas()
    x, y = np.array(pdf["embedding"].tolist()), (pdf["state"] == "empty").to_numpy().astype(float)
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    lr = model.stages[-1]
    b = lr.coefficients.toArray()
    w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
    off = w * (1 / (1 + np.exp(-(z @ b + lr.intercept))) - y)
    assert np.abs(z.T @ off + b).max() < 0.02 and abs(off.sum()) < 0.02


def test_prediction_gate_and_missing_features(vectors, model):
    out = models.predict_state(model, vectors, least=0.7, margin=0.1).toPandas()
    assert len(out) == 301 and 900 not in set(out["id"])
    assert np.allclose(out["p_carrying"] + out["p_empty"], 1) and np.allclose(out["confidence"], out[["p_carrying", "p_empty"]].max(axis=1))
    want = np.where(out["confidence"] < 0.7, "uncertain", np.where(out["p_carrying"] >= out["p_empty"], "carrying", "empty"))
    assert (out["predicted"] == want).all()


def test_training_is_refused(vectors):
    for rows, classes in ((vectors.limit(0), CLASSES), (vectors.filter("state = 'empty'"), CLASSES), (vectors, ["empty"])):
        with pytest.raises(ValueError):
            models.train_state_classifier(rows, classes)


def test_model_artifact(spark, vectors, model, tmp_path):
    path = str(tmp_path / "m")
    models.save_model(spark, model, path, "enc", "1")
    again = models.load_model(spark, path, "enc", "1", 3, [*CLASSES, "other"])
    key = lambda m: models.predict_state(m, vectors).orderBy("id").collect()
    assert key(again) == key(model)
    for encoder, version, dim, classes in (("x", "1", 3, CLASSES), ("enc", "2", 3, CLASSES), ("enc", "1", 4, CLASSES), ("enc", "1", 3, ["empty"])):
        with pytest.raises(ValueError):
            models.load_model(spark, path, encoder, version, dim, classes)


def test_score_windows(spark):
    def make():
        return lambda x: np.stack([x.sum(axis=1), x.max(axis=1)], axis=1)

    rows = spark.createDataFrame([(1, [1.0, 2.0]), (2, [5.0, -1.0])], "id long, v array<float>")
    out = models.score_windows(rows, make, "v", 2, ["a", "b"]).orderBy("id").collect()
    assert [(r.id, r.p_a, r.p_b) for r in out] == [(1, 3.0, 2.0), (2, 4.0, 5.0)]


def test_grace_window_equals_a_loop(spark):
    rng = random.Random(5)
    obs, events = [], []
    for clip in ("a", "b", "c"):
        t = 0.0
        for _ in range(400):
            t += rng.choice([0.05, 0.06, 0.1, 0.3])
            obs.append((clip, "x", "left", "r", t, rng.random() < 0.5, rng.choice([0.1, 0.9]), rng.choice([0.1, 0.9]), rng.choice([0.1, 0.9]), rng.choice([0.1, 0.9])))
            if clip != "c" and rng.random() < 0.05:
                events.append((clip, "x", "left", "r", "pickup", t - 1, t + 0.02, t + 1, 0.9))
    keys = ", ".join(f"{k} string" for k in KEY)
    o = spark.createDataFrame(obs, keys + ", timestamp_s double, inside_region boolean, hand_empty double, hand_carrying double, shelf_removed double, shelf_placed double")
    e = spark.createDataFrame(events, keys + ", type string, t_start double, transfer_s double, t_end double, confidence double")
    times, want = collections.defaultdict(list), collections.Counter()
    for r in events:
        times[r[0]].append(r[6])
        want[r[0], r[4], r[6], r[7]] += 1
    for now, after in zip(obs, obs[1:]):
        label = "pickup" if now[7] > 0.55 and now[8] > 0.5 else "putdown" if now[6] > 0.55 and now[9] > 0.5 else None
        if now[0] == after[0] and times[now[0]] and now[5] and not after[5] and label and after[4] - now[4] <= 0.2 and all(abs(now[4] - t) >= 0.15 for t in times[now[0]]):
            times[now[0]].append(now[4])
            want[now[0], label, now[4], after[4]] += 1
    got = evidence.grace_window(e, o, KEY, 0.2)
    assert collections.Counter((r.clip_id, r.type, r.transfer_s, r.t_end) for r in got.collect()) == want and sum(want.values()) > len(events) + 10
    assert evidence.grace_window(e, o, KEY, 0.0).count() == len(events)
    assert evidence.grace_window(e.limit(0), o, KEY, 0.2).count() == 0


def test_responses(spark):
    ok = '{"events": [{"label": "PICKUP", "start_frame": "1", "end_frame": 2.9, "item_count": 2, "notes": " n "}], "reasoning": "why"}'
    rows = {
        "ok": ok, "fence": "```json\n" + ok + "\n```  ", "bare fence": "```\n" + ok, "none": '{"events": []}',
        "null": None, "blank": " ", "array": "[1]", "events": '{"events": 3}', "no events": "{}", "reason": '{"events": [], "reasoning": 1}',
        "item": '{"events": [1]}', "bool": '{"events": [{"label": "pickup", "start_frame": true, "end_frame": 2}]}', "missing": '{"events": [{"label": "pickup", "start_frame": 1}]}',
        "count": '{"events": [{"label": "pickup", "start_frame": 1, "end_frame": 2, "item_count": 0}]}', "negative": '{"events": [{"label": "pickup", "start_frame": -1, "end_frame": 2}]}',
    }
    df = spark.createDataFrame([(k, v, 10) for k, v in rows.items()], "response_id string, content string, frame_count int")
    events, errors = responses.model_events(df)
    assert sorted((r.response_id, r.label, r.start_frame, r.end_frame, r.item_count, r.confidence, r.hard_case, r.notes) for r in events.collect()) == [(k, "pickup", 1, 2, 2, "med", False, "n") for k in ("bare fence", "fence", "ok")]
    got = sorted((r.source, r.field) for r in errors.collect())
    assert got == sorted([("null", "content"), ("blank", "content"), ("array", "content"), ("events", "events"), ("no events", "events"), ("reason", "reasoning"), ("item", "events"), ("bool", "start_frame"), ("missing", "end_frame"), ("count", "item_count"), ("negative", "start_frame")])
    assert responses.model_events(df.limit(0))[0].count() == 0


def test_observations_of_an_unknown_region_or_without_a_pose(spark):
    keys = "candidate_id string, clip_id string, actor_id string, hand_side string, region_id string, timestamp_s double"
    hand = spark.createDataFrame([("c", "v", "a", "left", "r", 1.0, 0.2, 0.7, 0.1), ("c", "v", "a", "left", None, 9.0, 0.2, 0.7, 0.1)], keys + ", hand_empty double, hand_carrying double, hand_uncertain double")
    shelf = hand.limit(0).withColumns({c: F.lit(0.0) for c in evidence.SHELF})
    poses = spark.createDataFrame([("v", "a", "left", 1.2, 5.0, 5.0, 0.9)], "clip_id string, actor_id string, hand_side string, t_h double, wrist_x double, wrist_y double, wrist_confidence double")
    out = evidence.build_observations(hand, shelf, poses, {"r": [(0.0, 0.0), (9.0, 0.0), (9.0, 9.0)]}).orderBy("timestamp_s").collect()
    assert [(r.inside_region, r.distance_px, r.trajectory_confidence, r.shelf_placed) for r in out] == [(True, 0.0, 0.9, 0.0), (False, None, 0.5, 0.0)]
