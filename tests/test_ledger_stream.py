import random

import pytest
from pyspark.sql import functions as F

from eventloom.plans.fixtures import view
from eventloom.streaming import ledger as L
from eventloom.streaming.state_machine import interaction_events, stream_interactions
from tests.conftest import SF

NAMES = [c.split()[0] for c in L.CHANGE.split(", ")]


def change(name, action, step, etag=None, size=None, error=None):
    return (name, action, step, etag, size, error)


BATCHES = [
    [change("a", "discovered", 1), change("b", "discovered", 1), change("a", "downloaded", 3, "e1", "10"), change("b", "generated", 4), change("c", "failed", 5, error="x" * 600), change(None, "downloaded", 1), change("a", "dance", 9)],
    [change("a", "uploaded", 6), change("a", "generated", 7), change("b", "downloaded", 8, "e2", "20"), change("c", "downloaded", 9, "e3", "30")],
    [change("a", "discovered", 10), change("a", "uploaded", 11), change("b", "failed", 12, error="net"), change("b", "generated", 13), change("c", "generated", 14), change("c", "failed", 15, error="late"), change("c", "downloaded", 16, "e4", "31")],
]


def loop(batches):
    """The ledger with a plain loop over the steps of each file."""
    state, rejected = {}, []
    for batch in batches:
        for c in sorted((c for c in batch if c[0] is not None), key=lambda c: c[2]):
            name, action, _, etag, size, error = c
            if action not in ("discovered", "failed", *L.FLAGS):
                rejected.append(c)
                continue
            s = state.setdefault(name, {"downloaded": False, "generated": False, "uploaded": False, "source_etag": None, "source_size_bytes": None, "last_error": ""})
            if action == "failed":
                s["last_error"] = error[:500]
            elif action != "discovered":
                i = L.FLAGS.index(action)
                if i and not s[L.FLAGS[i - 1]]:
                    rejected.append(c)
                    continue
                s[action], s["last_error"] = True, ""
                if action == "downloaded":
                    s["source_etag"], s["source_size_bytes"] = etag, size
        rejected += [c for c in batch if c[0] is None]
    return state, rejected


def held(ledger):
    rows = ledger.read().drop("batch").collect()
    assert len({r["file_name"] for r in rows}) == len(rows)
    return {r["file_name"]: {k: v for k, v in r.asDict().items() if k != "file_name"} for r in rows}


def test_replayed_batches_change_nothing(spark, tmp_path):
    ledger = L.Ledger(spark, str(tmp_path / "ledger"), snapshot_every=2)
    frames = [spark.createDataFrame(b, L.CHANGE) for b in BATCHES]
    assert ledger.read().count() == 0 and ledger.rejected().count() == 0
    for n in (0, 1, 1, 2, 0, 1, 2, 2):  # every batch again, also after later ones
        ledger.apply(frames[n], n)
    want, rejected = loop(BATCHES)
    assert held(ledger) == want
    assert sorted(map(repr, (tuple(r)[:6] for r in ledger.rejected().collect()))) == sorted(map(repr, rejected))


def test_killed_between_write_and_commit(spark, tmp_path):
    for i, b in enumerate(BATCHES):
        spark.createDataFrame(b, L.CHANGE).coalesce(1).write.mode("append").json(str(tmp_path / "in" / f"{i}"))
    stream = lambda: spark.readStream.schema(L.CHANGE).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).json(str(tmp_path / "in"))
    ledger = L.Ledger(spark, str(tmp_path / "ledger"))
    died = []

    def dies_once(df, batch):
        """Writes the delta and is killed before the batch is committed; in batch 2, before the delta is finished."""
        if batch == 1 and "after" not in died:
            ledger.apply(df, batch)
            died.append("after")
            raise RuntimeError("killed after the write")
        if batch == 2 and "during" not in died:
            part = tmp_path / "ledger" / "delta" / "2"
            part.mkdir(parents=True)
            (part / "part-00000.parquet").write_bytes(b"half a file")
            died.append("during")
            raise RuntimeError("killed during the write")
        ledger.apply(df, batch)

    for _ in range(2):
        with pytest.raises(Exception, match="killed"):
            L.ledger_stream(stream(), str(tmp_path / "ledger"), str(tmp_path / "ck"), dies_once).awaitTermination()
        held(ledger)  # readable at any time
    L.ledger_stream(stream(), str(tmp_path / "ledger"), str(tmp_path / "ck"), dies_once).awaitTermination()
    assert died == ["after", "during"]
    order = [[tuple(r[c] for c in NAMES) for r in spark.read.schema(L.CHANGE).json(str(f)).collect()] for f in sorted(p for p in (tmp_path / "in").iterdir())]
    assert held(ledger) == loop(order)[0]
    # nothing new: no batch, no change
    L.ledger_stream(stream(), str(tmp_path / "ledger"), str(tmp_path / "ck")).awaitTermination()
    assert held(ledger) == loop(order)[0]


def test_random_changes_equal_the_loop(spark, tmp_path):
    rng = random.Random(3)
    steps = iter(range(10_000))
    batches = [[change(rng.choice("abcdef"), rng.choice(["discovered", "failed", *L.FLAGS, *L.FLAGS]), next(steps), f"e{i}", str(i), f"error {i}") for i in range(25)] for _ in range(3)]
    ledger = L.Ledger(spark, str(tmp_path / "ledger"), snapshot_every=2)
    for n, b in enumerate(batches):
        ledger.apply(spark.createDataFrame(rng.sample(b, len(b)), L.CHANGE), n)
    want, rejected = loop(batches)
    assert held(ledger) == want and ledger.rejected().count() == len(rejected)


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(name)


def streamed(spark, tmp_path, parts, name):
    for i, part in enumerate(parts):
        part.coalesce(1).write.parquet(str(tmp_path / "in" / f"{i}"))
    stream = spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    q = stream_interactions(stream, idle_s=30.0).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(300)
    kept = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    return spark.table(name).collect(), kept


def test_shuffled_and_late_rows(spark, tmp_path, rocks):
    obs = view(spark, SF, "fx_sm_obs").filter("clip_id in (select clip_id from values ('clip_1'), ('clip_2'), ('clip_3') as t(clip_id))")
    obs = obs.withColumn("event_time", F.timestamp_millis((F.col("timestamp_s") * 1000).cast("long") + 1_700_000_000_000)).cache()
    top = obs.agg(F.max("timestamp_s")).first()[0]
    # micro-batches of a third each, whose rows are dealt up to 6 s ahead of or behind their time, and one that moves the watermark on
    jitter = F.pmod(F.xxhash64("clip_id", "timestamp_s"), F.lit(12)) - 6
    thirds = [obs.filter(F.floor((F.col("timestamp_s") + jitter) / top * 3).between(lo, hi)) for lo, hi in ((-99, 0), (1, 1), (2, 99))]
    end = obs.limit(1).withColumns({"clip_id": F.lit("end"), "timestamp_s": F.lit(top + 1000), "event_time": F.timestamp_millis(F.lit(1_700_000_000_000 + int((top + 1000) * 1000)))})
    late = obs.filter("clip_id = 'clip_1'").limit(3)
    rows, kept = streamed(spark, tmp_path, [*thirds, end, late.withColumn("timestamp_s", F.col("timestamp_s") + 0.01), end], "shuffled")
    want = sorted(map(repr, (tuple(r) for r in interaction_events(obs).collect())))
    assert want and sorted(map(repr, (tuple(r)[:-1] for r in rows if r["type"] != "late"))) == want
    assert [(r["clip_id"], r["n_late"]) for r in rows if r["type"] == "late"] == [("clip_1", 3)]
    assert kept[-1] < max(kept)  # idle keys lost their state
