import datetime

import pytest

from eventloom.sources import tables
from eventloom.streaming import observations


def streamed(spark, tmp_path, parts, build, schema):
    """Rows of build(stream) after each part was one micro-batch."""
    for i, part in enumerate(parts):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = build(stream).writeStream.format("memory").queryName("out").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table("out")


@pytest.fixture
def timed(spark):
    rows = [(c, i, datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC) + datetime.timedelta(hours=h)) for i, (c, h) in enumerate([("a", 0), ("a", 1), ("a", 12), ("b", 2), ("b", 2), ("a", 90), ("b", 90)])]
    return spark.createDataFrame(rows, "clip_id string, event_id int, event_time timestamp")


def test_streamed_spans_close_behind_the_watermark(spark, tmp_path, timed):
    got = streamed(spark, tmp_path, [timed.filter("event_id < 5"), timed.filter("event_id >= 5")], observations.active_spans, timed.schema)
    assert sorted((r["clip_id"], r["t_start"].hour, r["t_end"].hour, r["n"]) for r in got.collect()) == [("a", 0, 1, 2), ("a", 12, 12, 1), ("b", 2, 2, 2)]


def test_streamed_window_counts(spark, tmp_path, timed):
    got = streamed(spark, tmp_path, [timed.filter("event_id < 5"), timed.filter("event_id >= 5")], lambda s: observations.window_counts(s, "1 day", "1 day"), timed.schema)
    assert sorted((r["clip_id"], r["t_start"].day, r["n"]) for r in got.collect()) == [("a", 1, 3), ("b", 1, 2)]


def test_streamed_first_rows(spark, tmp_path, timed):
    got = streamed(spark, tmp_path, [timed, timed], observations.first_rows, timed.schema)
    assert sorted(r["event_id"] for r in got.collect()) == list(range(7))


def test_canonical_csv_round_trip(spark, tmp_path):
    (tmp_path / "in.csv").write_text("id,begin,score\ne1, 0.0 ,\ne2,,x\ne3,2.5,0.25\n")
    schema = spark.createDataFrame([], "event_id string, t_start double, score double, note string").schema
    got = tables.read_canonical(spark, str(tmp_path / "in.csv"), schema, {"id": "event_id", "begin": "t_start"}, {"score": 1.0, "t_start": 9.0})
    assert sorted(map(tuple, got.collect())) == [("e1", 0.0, 1.0, None), ("e2", 9.0, 1.0, None), ("e3", 2.5, 0.25, None)]
    tables.write_canonical(got, str(tmp_path / "out"), ["event_id", "note", "t_start"])
    again = tables.read_canonical(spark, str(tmp_path / "out"), schema)
    assert again.columns == ["event_id", "t_start", "score", "note"] and again.filter("note is not null").count() == 0
    assert tables.with_schema(spark.createDataFrame([], "event_id string, other int"), schema).schema == schema
