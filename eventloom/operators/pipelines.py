"""The two pipelines users run, composed of the other operators: from candidates to predictions, and from candidates to labelled features.

Each stage that several others read is stored once. Counts of what was skipped come from observed metrics of those writes, not from passes of their own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from eventloom.operators import decode, evidence, intervals, lookups, models
from eventloom.operators.candidates import crop_square, trajectory_for_candidate
from eventloom.operators.dataset import stable_id
from eventloom.operators.trajectories import contact_time, pose_regions
from eventloom.operators.windows import adaptive_times, sample_times
from eventloom.sources.manifest import MANIFEST
from eventloom.sources.shared import stored
from eventloom.sources.tables import with_schema
from eventloom.streaming.state_machine import KEY, Config, interaction_events

#: Why a candidate is left out, in the order in which the reasons are looked for.
REASONS = ("ignored", "missing_identity_fields", "missing_source_video", "missing_split", "missing_pose_observations", "missing_shelf_region")


def observed(df: DataFrame, name: str, metrics: dict[str, Column]) -> tuple[DataFrame, dict]:
    """df stored, and the metrics of its rows, from the same pass."""
    seen = Observation(name)
    out = stored(df.observe(seen, *[c.alias(k) for k, c in metrics.items()]), name)
    return out, dict(seen.get)


def resolved(candidates: DataFrame, clips: DataFrame, trajectory: DataFrame, polygons: dict, ignores: DataFrame | None, split: bool) -> tuple[DataFrame, dict]:
    """candidates with skip_reason, the first of REASONS that applies or null, and split where it is asked for; with counts by reason."""
    there = lambda df, key, name: df.select(key).distinct().withColumn(name, F.lit(True))
    videos = clips.groupBy("clip_id").agg(F.lit(True).alias("__video"), *[F.first("split").alias("__split")] * split)
    rows = candidates.join(videos, "clip_id", "left").join(there(trajectory, "candidate_id", "__pose"), "candidate_id", "left")
    if ignores is not None:
        clear = intervals.drop_ignored(candidates, ignores, "raw_start_s", "raw_end_s").select("candidate_id", F.lit(True).alias("__clear"))
        rows = rows.join(clear, "candidate_id", "left")
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    tests = {
        "ignored": F.col("__clear").isNull() if ignores is not None else F.lit(False),
        "missing_identity_fields": blank("clip_id") | blank("actor_id"),
        "missing_source_video": F.col("__video").isNull(),
        "missing_split": blank("__split") if split else F.lit(False),
        "missing_pose_observations": F.col("__pose").isNull(),
        "missing_shelf_region": ~F.coalesce(F.col("region_id").isin(*polygons), F.lit(False)),
    }
    reason = F.coalesce(*[F.when(tests[r], F.lit(r)) for r in REASONS])
    rows = rows.select(*candidates.columns, *[F.col("__split").alias("split")] * split, reason.alias("skip_reason"))
    counts = {"candidates": F.count(F.lit(1))} | {r: F.count_if(F.col("skip_reason") == r) for r in REASONS}
    return observed(rows, "resolved", counts)


@dataclass(frozen=True)
class TrackConfig:
    fps: float = 10.0
    tolerance_s: float = 0.3
    grace_s: float = 0.0
    extension_s: float = 0.5
    least_s: float = 0.1
    nms_keys: tuple[str, ...] = ("clip_id", "type")
    tiou: float = 0.5
    transfer_s: float = 0.5
    machine: Config = field(default_factory=Config)
    model: str = "track_a"


@dataclass
class Tracked:
    """predictions with candidate_ids; events before suppression; audit (dropped, kept); diagnostics per candidate; summary counts."""

    predictions: DataFrame
    events: DataFrame
    audit: DataFrame
    diagnostics: DataFrame
    summary: dict


def state_evidence(model: PipelineModel, rows: DataFrame, names: dict[str, str], unsure: str) -> DataFrame:
    """STREAM, timestamp_s and the classes' probabilities under new names (0 for a class that the model lacks), with unsure 1 where the prediction is uncertain."""
    scored = models.predict_state(model, rows)
    p = [(F.col(f"p_{c}") if f"p_{c}" in scored.columns else F.lit(0.0)).cast("double").alias(n) for c, n in names.items()]
    return scored.select(*evidence.STREAM, "timestamp_s", *p, (F.col("predicted") == "uncertain").cast("double").alias(unsure))


def track_a(candidates: DataFrame, clips: DataFrame, poses: DataFrame, polygons: dict, features: DataFrame, hand: PipelineModel, shelf: PipelineModel, config: TrackConfig | None = None, time: str = "t_h") -> Tracked:
    """Predictions of candidates (candidate_id, KEY, raw_ and window_ times) in clips (clip_id, duration_s) with poses.

    Samples at fps in a candidate's window that have a pose of its trajectory within the tolerance take their embeddings from features (candidate_id, timestamp_s,
    crop_type hand or shelf, embedding); two classifiers turn these into evidence, which feeds the state machine of each stream. Its events, with those
    of the grace window, are held to their candidate's bounds, suppressed against each other and named. Of rows of a stream at one time, from overlapping candidates,
    the one of the smallest candidate_id counts.
    """
    c = config or TrackConfig()
    trajectory = stored(trajectory_for_candidate(candidates, poses, time), "trajectory")
    known, skipped = resolved(candidates, clips, trajectory, polygons, None, False)
    live = known.filter("skip_reason is null").drop("skip_reason")
    times = live.select(*evidence.STREAM, F.explode(sample_times(F.col("window_start_s"), F.col("window_end_s"), c.fps)).alias("timestamp_s"))
    near = intervals.nearest_observation(times, trajectory, "candidate_id", "timestamp_s", time, c.tolerance_s, ["wrist_x"])
    samples = near.filter("observed_at is not null").select(*times.columns)
    crops = samples.hint("merge").join(features.select("candidate_id", "timestamp_s", "crop_type", "embedding").hint("merge"), ["candidate_id", "timestamp_s"])
    crops, counts = observed(crops, "crops", {"hand_evidence": F.count_if(F.col("crop_type") == "hand"), "shelf_evidence": F.count_if(F.col("crop_type") == "shelf")})
    held = state_evidence(hand, crops.filter("crop_type = 'hand'"), {"empty": "hand_empty", "carrying": "hand_carrying"}, "hand_uncertain")
    kept = state_evidence(shelf, crops.filter("crop_type = 'shelf'"), {"removed": "shelf_removed", "placed": "shelf_placed", "no_change": "shelf_unchanged"}, "shelf_uncertain")
    seen = evidence.build_observations(held, kept, poses, polygons, time, c.tolerance_s)
    values = [x for x in seen.columns if x not in (*KEY, "timestamp_s", "candidate_id")]
    one = seen.groupBy(*KEY, "timestamp_s").agg(F.min("candidate_id").alias("candidate_id"), F.min_by(F.struct(*values), "candidate_id").alias("v"))
    obs = stored(one.select(*KEY, "timestamp_s", "candidate_id", *[f"v.{x}" for x in values]), "observations")
    found = evidence.grace_window(stored(interaction_events(obs, c.machine), "machine"), obs, list(KEY), c.grace_s)
    # an event ends at the row that completed it
    owned = found.join(obs.select(*KEY, F.col("timestamp_s").alias("t_end"), "candidate_id"), [*KEY, "t_end"])
    bounds = live.select("candidate_id", "raw_start_s", "raw_end_s").join(live.select("candidate_id", "clip_id"), "candidate_id").join(clips.select("clip_id", "duration_s").dropDuplicates(["clip_id"]), "clip_id", "left").drop("clip_id")
    placed = owned.join(bounds, "candidate_id")
    s, e = decode.refine_boundaries(F.col("t_start"), F.col("t_end"), F.col("transfer_s"), (F.col("raw_start_s"), F.col("raw_end_s")), (F.lit(0.0), F.coalesce("duration_s", F.lit(float("inf")))), c.extension_s, c.least_s)
    name = stable_id("event_", 16, *KEY, F.format_string("%.6f", "transfer_s"), F.format_string("%.6f", "t_end"))
    events = placed.select(name.alias("pred_id"), "candidate_id", *KEY, "type", s.alias("t_start"), "transfer_s", e.alias("t_end"), F.col("confidence").alias("score"))
    events, n_raw = observed(events, "events", {"raw_events": F.count(F.lit(1))})
    final, audit = decode.temporal_nms(events, c.nms_keys, c.tiou, c.transfer_s)
    by = events.select(F.col("pred_id").alias("dropped"), F.col("candidate_id").alias("__c")).join(audit, "dropped").groupBy(F.col("kept").alias("pred_id")).agg(F.collect_set("__c").alias("__more"))
    merged = final.join(by, "pred_id", "left").withColumn("candidate_ids", F.array_sort(F.array_union(F.array("candidate_id"), F.coalesce("__more", F.array().cast("array<string>")))))
    named = evidence.events_to_predictions(merged.withColumn("confidence", F.col("score")), c.model)
    keep = merged.select("clip_id", "type", "t_start", "t_end", "candidate_ids", F.col("score").alias("__s"))
    preds = named.join(keep, (named["clip_id"] == keep["clip_id"]) & (named["type"] == keep["type"]) & (named["t_start"] == keep["t_start"]) & (named["t_end"] == keep["t_end"]) & (named["score"] == keep["__s"])).select(*[named[x] for x in named.columns], "candidate_ids").dropDuplicates(["pred_id", "candidate_ids"])
    score = F.col("score")
    metrics = {
        "predictions": F.count(F.lit(1)), "pickup": F.count_if(F.col("type") == "pickup"), "putdown": F.count_if(F.col("type") == "putdown"), "mean_confidence": F.avg("score"),
        "low": F.count_if(score < 0.4), "medium": F.count_if((score >= 0.4) & (score < 0.7)), "high": F.count_if(score >= 0.7),
    }
    preds, last = observed(preds, "predictions", metrics)
    per = lambda df, n: df.groupBy("candidate_id").agg(F.count("*").alias(n))
    diagnostics = known.select("candidate_id", "clip_id", F.col("skip_reason").isNotNull().alias("skipped"), "skip_reason").join(per(crops.select("candidate_id", "timestamp_s").distinct(), "n_samples"), "candidate_id", "left").join(per(final, "n_events"), "candidate_id", "left").fillna(0, ["n_samples", "n_events"])
    return Tracked(preds, events, audit, diagnostics, {**skipped, **counts, **n_raw, **last})


#: From crop rows (candidate_id, crop_type, timestamp_s, geometry_...) to an array (rows, dimension); made once per Python worker.
Encoder = Callable[[pd.DataFrame], np.ndarray]


def embeddings(parts: Iterator[pa.Array], make_encoder: Callable[[], Encoder], batch: int) -> Iterator[pa.Array]:
    """Embeddings of arrays of crops: one array for each that came in, in which the encoder is called for at most `batch` crops at a time."""
    encode = None
    for part in parts:
        encode = encode or make_encoder()
        rows = pa.RecordBatch.from_struct_array(part).to_pandas()
        found = [np.asarray(encode(rows.iloc[at : at + batch]), np.float32) for at in range(0, len(rows), batch)]
        ends = np.cumsum(np.concatenate([[0], *[np.full(len(v), v.shape[1]) for v in found]]))
        flat = np.concatenate([v.ravel() for v in found] or [np.zeros(0, np.float32)])
        yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))


def encoded(crops: DataFrame, make_encoder: Callable[[], Encoder], batch: int = 256, columns: list[str] | None = None) -> DataFrame:
    """crops with embedding by a user's encoder, in calls of at most `batch` rows; the encoder is made once for all calls of a task and sees `columns` (all by default).

    Only these go to Python, in Arrow batches of Spark's size, and only embeddings come back.
    """

    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return embeddings(parts, make_encoder, batch)

    return crops.withColumn("embedding", F.arrow_udf(run, "array<float>")(F.struct(*(columns or crops.columns))))


def feature_dataset(
    candidates: DataFrame, clips: DataFrame, ignores: DataFrame, poses: DataFrame, polygons: dict, events: DataFrame, make_encoder: Callable[[], Encoder], encoder: tuple[str, str] = ("encoder", "1"),
    tolerance: float = 0.2, most: float = 1.0, frame: tuple[int, int] = (1920, 1080), batch: int = 256, time: str = "t_h",
) -> tuple[DataFrame, dict]:
    """(records in the columns of MANIFEST, counts): labelled hand and shelf crops of candidates, with embeddings.

    Candidates outside ignores, in clips (clip_id, split) with a video and a split, with poses and a polygon are sampled around their contact time; a sample with a pose of the trajectory
    within the tolerance gives a crop around the wrist and one around the middle of the polygon's bounds. The label is that of the best-overlapping event. counts: candidates by skip reason, records by label.
    """
    trajectory = stored(trajectory_for_candidate(candidates, poses, time), "trajectory")
    known, skipped = resolved(candidates, clips, trajectory, polygons, ignores, True)
    live = known.filter("skip_reason is null").drop("skip_reason")
    near_own = pose_regions(trajectory.join(live.select("candidate_id", F.col("region_id").alias("__own")), "candidate_id"), polygons).filter("__own = region_id")
    contact = contact_time(near_own, ["candidate_id"], time)
    labels = intervals.assign_label(live, events, values=[c for c in ("confidence", "hard_case") if c in events.columns])
    # labels belong to candidates: they come before the samples, which are many
    own = ["candidate_id", "clip_id", "actor_id", "hand_side", "region_id", "split"]
    more = [c for c in labels.columns if c != "candidate_id"]
    points = live.join(contact, "candidate_id").join(labels, "candidate_id").select(*own, *more, F.explode(adaptive_times(F.col("raw_start_s"), F.col("raw_end_s"), F.col("contact_s"), most)).alias("p"))
    points = points.select(*own, *more, F.col("p.t").alias("timestamp_s"), F.col("p.position").alias("sample_position"))
    near = intervals.nearest_observation(points, trajectory, "candidate_id", "timestamp_s", time, tolerance, ["wrist_x", "wrist_y"]).filter("observed_at is not null")
    middle = {r: (sum(f(x for x, _ in p) for f in (min, max)) / 2, sum(f(y for _, y in p) for f in (min, max)) / 2) for r, p in polygons.items()}
    centre = [F.coalesce(*[F.when(F.col("region_id") == r, F.lit(float(m[i]))) for r, m in middle.items()]) for i in (0, 1)]
    # one square a row, after the explode: inside it two, each with its middle repeated, made the largest generated method of the query
    around = lambda kind, x, y: F.struct(F.lit(kind).alias("crop_type"), x.alias("x"), y.alias("y"))
    near = near.withColumn("__at", F.format_string("%.6f", "timestamp_s"))
    crops = near.select(*points.columns, "__at", F.explode(F.array(around("hand", F.col("wrist_x"), F.col("wrist_y")), around("shelf", *centre))).alias("__c"))
    crops = crops.withColumn("__g", crop_square(F.col("__c.x"), F.col("__c.y"), F.lit(None).cast("double"), *frame))
    crops = crops.select(*points.columns, "__at", "__c.crop_type", *[F.col(f"__g.{g}").alias(f"geometry_{g}") for g in ("x", "y", "width", "height")])
    name = stable_id("crop_", 16, "candidate_id", "crop_type", "__at")
    seen = [c for c in crops.columns if c not in (*more, "__at")]
    rows = encoded(crops, make_encoder, batch, seen).withColumns({"crop_id": name, "encoder_name": F.lit(encoder[0]), "encoder_version": F.lit(encoder[1])})
    counts = {"records": F.count(F.lit(1))} | {f"label={x}": F.count_if(F.col("label") == x) for x in ("pickup", "putdown", "negative")} | {f"split={x}": F.count_if(F.col("split") == x) for x in ("train", "val", "test")}
    records, stats = observed(with_schema(rows, MANIFEST), "features", counts)
    return records, {**skipped, **stats}
