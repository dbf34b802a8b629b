"""Candidates from interactions, and what belongs to a candidate: trajectories, actors, crop boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.functions.intervals import bbox_iou, bounded_context

KEY = ["clip_id", "actor_id", "hand_side", "region_id"]


def filter_observations(obs: DataFrame, least: float, track: str = "track_key") -> DataFrame:
    """Stable rows of a track with a confidence of `least` or more; a null or NaN is none."""
    c = F.col("confidence")
    kept = (c >= least) & ~F.isnan(c) & F.col(track).isNotNull()
    return obs.filter(kept & F.col("is_stable") if "is_stable" in obs.columns else kept)


def canonical_order(rows: DataFrame, *columns: str) -> DataFrame:
    """Rows in one order, nulls as empty strings; for sinks only."""
    kinds = dict(rows.dtypes)
    return rows.orderBy(*[F.coalesce(F.col(c), F.lit("")) if kinds[c] == "string" else F.col(c) for c in columns])


def generate_candidates(raw: DataFrame, clips: DataFrame, merge_gap: float = 1.0, before: float = 2.0, after: float = 2.0, cap: float = 10.0) -> DataFrame:
    """Raw interactions (KEY, start_s, end_s, mean_confidence, mean_distance) of a stream merged across gaps of merge_gap or less, with a padded window.

    Clips need a positive finite duration_s: one without raises an error when the row is computed.
    """
    by = Window.partitionBy(*KEY).orderBy("start_s", "end_s")
    so_far = F.max("end_s").over(by.rowsBetween(Window.unboundedPreceding, -1))
    rows = raw.withColumn("__new", F.when(so_far.isNull() | (F.col("start_s") - so_far > merge_gap), 1).otherwise(0)).withColumn("__g", F.sum("__new").over(by))
    g = rows.groupBy(*KEY, "__g").agg(
        F.min("start_s").alias("lo"), F.max("end_s").alias("hi"), F.count("*").alias("n_raw_interactions"), F.min("mean_distance").alias("distance"),
        F.max("mean_confidence").alias("proposal_score"), F.sum(F.col("end_s") - F.col("start_s")).alias("dwell"),
    )
    g = g.join(clips.select("clip_id", "duration_s"), "clip_id", "left")
    d = F.when((F.col("duration_s") > 0) & (F.col("duration_s") < float("inf")), F.col("duration_s")).otherwise(F.raise_error(F.concat(F.lit("no positive duration for clip "), "clip_id")).cast("double"))
    g = g.withColumns({"lo": F.greatest(F.lit(0.0), "lo"), "hi": F.least(d, F.col("hi"))}).filter("hi > lo")
    s, e = bounded_context(F.col("lo"), F.col("hi"), before, after, F.col("duration_s"), cap)
    us = lambda c: F.bround(F.col(c) * 1_000_000).cast("long").cast("string")
    cid = F.concat(F.lit("cand_"), F.substring(F.sha2(F.concat_ws("\x1f", *KEY, us("lo"), us("hi")), 256), 1, 12))
    four = lambda c, name: F.bround(c, 4).alias(name)
    return g.select(
        cid.alias("candidate_id"), *KEY, four(F.col("lo"), "raw_start_s"), four(F.col("hi"), "raw_end_s"), four(s, "window_start_s"), four(e, "window_end_s"),
        "n_raw_interactions", four(F.col("distance"), "min_region_distance"), four(F.col("proposal_score"), "max_wrist_confidence"), four(F.col("dwell"), "total_dwell_duration_s"), "proposal_score",
    )


def trajectory_for_candidate(candidates: DataFrame, poses: DataFrame, time: str = "t_h", bucket: float = 60.0) -> DataFrame:
    """(candidate_id, poses' columns): poses of the candidate's clip, actor and hand in its closed window.

    A candidate without any, whose actor id has a colon, takes the poses of its clip and hand instead.
    """
    cells = F.explode(F.sequence(F.floor(F.col("window_start_s") / bucket), F.floor(F.col("window_end_s") / bucket)))
    c = candidates.select("candidate_id", "clip_id", F.col("actor_id").alias("__actor"), "hand_side", "window_start_s", "window_end_s", cells.alias("__cell"))
    p = poses.withColumn("__cell", F.floor(F.col(time) / bucket))
    near = c.hint("merge").join(p.hint("merge"), ["clip_id", "hand_side", "__cell"]).filter(F.col(time).between(F.col("window_start_s"), F.col("window_end_s")))
    own = F.col("__actor") == F.col("actor_id")
    exact = near.filter(own)
    late = near.filter(F.col("__actor").contains(":")).join(exact.select("candidate_id").distinct(), "candidate_id", "left_anti")
    return exact.select("candidate_id", *poses.columns).unionByName(late.select("candidate_id", *poses.columns))


def nearest_people(poses: DataFrame, people: DataFrame, pose_key: str, gap: float, time: str = "t_h") -> DataFrame:
    """(pose_key, actor, person columns): per pose and actor of its clip the nearest observation within gap, the earliest on ties.

    people: clip_id, person_id, the time column and x1, y1, x2, y2. Cells of width gap are an extra equality key.
    """
    cell = F.explode(F.array(*[F.floor(F.col(time) / gap) + d for d in (-1, 0, 1)]))
    seen = people.select("clip_id", F.col("person_id").alias("actor"), F.col(time).alias("__t"), "x1", "y1", "x2", "y2", cell.alias("__cell"))
    rows = poses.withColumn("__cell", F.floor(F.col(time) / gap)).join(seen, ["clip_id", "__cell"])
    away = F.abs(F.col("__t") - F.col(time))
    best = F.min(F.struct(away.alias("gap"), F.col("__t").alias("t"), "x1", "y1", "x2", "y2"))
    return rows.filter(away <= gap).groupBy(pose_key, "actor").agg(best.alias("b")).select(pose_key, "actor", "b.*")


def associate_actors(poses: DataFrame, people: DataFrame, gap: float = 0.5, least: float = 0.15, time: str = "t_h") -> DataFrame:
    """poses with actor_id, and association (the IoU, null where none): per frame, detections and actors are paired one to one, best IoU first.

    poses: pose_id, clip_id, frame, the time, px1, py1, px2, py2 (the detection's box), actor_id. Rows of one detection (same frame, time and box) move together.
    The fold runs over the pairs of one frame.
    """
    box = ["px1", "py1", "px2", "py2"]
    milli = [F.round(F.col(c) * 1000).cast("long").alias(f"__{c}") for c in box]
    d = poses.select("clip_id", "frame", time, *box, *milli).dropDuplicates(["clip_id", "frame", time, *[f"__{c}" for c in box]])
    d = d.withColumn("det", F.concat_ws(":", "clip_id", F.col("frame").cast("string"), F.round(F.col(time) * 1e6).cast("long").cast("string"), *[F.col(f"__{c}").cast("string") for c in box]))
    near = nearest_people(d, people, "det", gap, time).join(d.select("det", "clip_id", "frame", *box), "det")
    iou = bbox_iou([F.col(c) for c in box], [F.col(c) for c in ("x1", "y1", "x2", "y2")])
    pairs = near.withColumn("iou", iou).filter(F.col("iou") >= least)
    ranked = pairs.groupBy("clip_id", "frame").agg(F.array_sort(F.collect_list(F.struct((-F.col("iou")).alias("o"), "gap", "actor", "px1", "py1", "det"))).alias("a"))
    none = F.expr("cast(array() as array<struct<det:string,actor:string,iou:double>>)")
    take = F.aggregate("a", none, lambda acc, p: F.when(F.exists(acc, lambda k: (k["det"] == p["det"]) | (k["actor"] == p["actor"])), acc).otherwise(F.array_append(acc, F.struct(p["det"].alias("det"), p["actor"].alias("actor"), (-p["o"]).alias("iou")))))
    chosen = ranked.select(F.explode(take).alias("k")).select(F.col("k.det").alias("det"), F.col("k.actor").alias("__actor"), F.col("k.iou").alias("association"))
    mine = F.concat_ws(":", "clip_id", F.col("frame").cast("string"), F.round(F.col(time) * 1e6).cast("long").cast("string"), *[F.round(F.col(c) * 1000).cast("long").cast("string") for c in box])
    return poses.withColumn("det", mine).join(chosen, "det", "left").withColumn("actor_id", F.coalesce("__actor", "actor_id")).select(*poses.columns, "association")


def crop_square(x: Column, y: Column, height: Column, frame_w: int, frame_h: int, ratio: float = 0.4, least: int = 64, most: int = 448, default: int = 224) -> Column:
    """(x, y, width, height) of a square around a wrist, sized by the person's box height, shifted into the frame and cut to it."""
    size = F.when(height.isNull(), default).otherwise(F.greatest(F.lit(least), F.least((height * ratio).cast("int"), F.lit(most))))

    def side(at: Column, limit: int) -> tuple[Column, Column]:
        a = F.greatest(at.cast("int") - F.floor(size / 2).cast("int"), F.lit(0))
        a = F.greatest(F.least(a, F.lit(limit) - size), F.lit(0))
        return a, F.least(a + size, F.lit(limit)) - a

    (x1, w), (y1, h) = side(x, frame_w), side(y, frame_h)
    return F.struct(x1.alias("x"), y1.alias("y"), w.alias("width"), h.alias("height"))


def crop_boxes(windows: DataFrame, poses: DataFrame, bounds: DataFrame, frame_w: int, frame_h: int, margin: float = 0.15, time: str = "t_h", bucket: float = 60.0) -> DataFrame:
    """(candidate_id, x1, y1, x2, y2): union of the person boxes (px1...) of a window's clip and actor and of its region's bounds (rx1...), widened and clamped."""
    cells = F.explode(F.sequence(F.floor(F.col("window_start_s") / bucket), F.floor(F.col("window_end_s") / bucket)))
    p = poses.select("clip_id", "actor_id", F.col(time).alias("__t"), "px1", "py1", "px2", "py2", F.floor(F.col(time) / bucket).alias("__cell"))
    hit = windows.withColumn("__cell", cells).join(p, ["clip_id", "actor_id", "__cell"]).filter("__t between window_start_s and window_end_s")
    u = hit.groupBy("candidate_id", "region_id").agg(*[f(c).alias(c) for f, c in ((F.min, "px1"), (F.min, "py1"), (F.max, "px2"), (F.max, "py2"))]).join(bounds, "region_id", "left")
    x1, y1, x2, y2 = F.least("px1", "rx1"), F.least("py1", "ry1"), F.greatest("px2", "rx2"), F.greatest("py2", "ry2")
    w, h = (x2 - x1) * margin, (y2 - y1) * margin
    low = lambda c: F.greatest(F.lit(0), c.cast("int"))
    return u.select("candidate_id", low(x1 - w).alias("x1"), low(y1 - h).alias("y1"), F.least(F.lit(frame_w), (x2 + w).cast("int")).alias("x2"), F.least(F.lit(frame_h), (y2 + h).cast("int")).alias("y2"))
