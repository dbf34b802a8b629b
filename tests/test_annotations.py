"""Annotation exports of both layouts, by hand."""

import json

from eventloom.operators import annotations

REVIEW = [{"name": "complete_active_span_reviewed", "value": {"selected": ["true"]}}]


def timeline(region, label, start, end, **more):
    return {"id": region, "from_name": "labels", "type": "timelinelabels", "value": {"timelinelabels": [label], "ranges": [{"start": start, "end": end}], **more}}


def choice(region, name, **value):
    return {"id": region, "from_name": name, "type": "choices", "value": value}


def task(name, results, fps=10.0, **annotation):
    return {"id": 7, "task": {"id": name, "data": {"clip_id": "other", "fps": fps}, "meta": {"clip_id": "v1"}}, "annotations": [{"id": 1, "who": "ann", "state": REVIEW, "result": results, **annotation}]}


def read(spark, *texts):
    return annotations.read_export(spark.createDataFrame([(f"f{i}", t) for i, t in enumerate(texts)], "source string, value string"))


def test_both_layouts(spark):
    legacy = {"id": 3, "data": {"clip_id": "v2"}, "annotations": [{"id": 5, "completed_by": {"email": "e@x.y"}, "state": REVIEW, "result": [{"id": "q", "value": {"start": 4.0, "end": 6.5, "labels": ["putdown"], "confidence": "high", "hard_case": "true", "item_count": 1}}]}]}
    real = task("a", [timeline("p", "pickup", 10, 25), choice("p", "confidence", choices=["medium"]), choice("p", "item_count", number=2.0), choice("p", "notes", text=["x", "y"]), timeline("g", "ignore", 30, 50), choice("g", "ignore_reason", choices=["ACTION_OUT_OF_FRAME"])])
    tasks, errors = read(spark, json.dumps([real]), json.dumps([legacy]))
    assert errors.count() == 0 and sorted((r.task_id, r.clip_id, r.fps) for r in tasks.collect()) == [("3", "v2", 0.0), ("a", "v1", 10.0)]
    events, ignores, wrong = annotations.convert_export(tasks)
    assert wrong.collect() == []
    got = sorted((r.clip_id, r.type, r.t_start, r.t_end, r.hard_case, r.annotator, r.confidence, r.notes) for r in events.collect())
    assert got == [("v1", "pickup", 1.0, 2.5, False, "ann", "med", "x\ny")] * 2 + [("v2", "putdown", 4.0, 6.5, True, "e@x.y", "high", None)]
    rows = events.collect()
    assert len({r.event_id for r in rows}) == 3 and len({r.event_group_id for r in rows}) == 2
    assert [(r.clip_id, r.t_start, r.t_end, r.reason) for r in ignores.collect()] == [("v1", 3.0, 5.0, "ACTION_OUT_OF_FRAME")]


def test_what_is_wrong(spark):
    two = timeline("two", "pickup", 1, 2, item_count=1)
    two["value"]["timelinelabels"].append("putdown")
    results = [two, timeline("unknown", "grab", 1, 2), timeline("half", "pickup", 1.5, 2, item_count=1), timeline("order", "pickup", 5, 5, item_count=1), timeline("none", "pickup", 1, 2), timeline("zero", "pickup", 1, 2, item_count=0), timeline("forbidden", "ignore", 1, 2, item_count=1), timeline("reason", "ignore", 1, 2, reason="x"), timeline("fine", "pickup", 1, 2, item_count="1")]
    tasks, _ = read(spark, json.dumps([task("a", results), task("b", [timeline("unseen", "pickup", 1, 2, item_count=1)], state=[]), task("c", [timeline("gone", "pickup", 1, 2)], was_cancelled=True), task("d", [timeline("no rate", "pickup", 1, 2, item_count=1)], fps=0)]))
    events, ignores, wrong = annotations.convert_export(tasks)
    want = [("two", "label"), ("unknown", "label"), ("half", "start_frame"), ("order", "end_frame"), ("none", "item_count"), ("zero", "item_count"), ("forbidden", "item_count"), ("reason", "reason"), ("unseen", annotations.REVIEWED), ("no rate", "fps")]
    assert sorted((r.source, r.field) for r in wrong.collect()) == sorted(want)
    assert events.count() == 1 and ignores.count() == 0


def test_unreadable_exports(spark):
    tasks, errors = read(spark, "", None, "{}", "[1]", "[]", json.dumps([{"id": 1}]), json.dumps([{"id": 2, "annotations": []}]))
    assert sorted((r.source, r.field) for r in errors.collect()) == [("1", "annotations"), ("2", "clip_id"), ("f0", "export"), ("f1", "export"), ("f2", "export"), ("f3", "export")]
    assert [r.task_id for r in tasks.collect()] == ["2"]
    assert annotations.expand_annotations(tasks).count() == 0
