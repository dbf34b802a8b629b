"""From classifier evidence to state-machine observations, and from its events to predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventloom.operators.intervals import nearest_observation
from eventloom.operators.trajectories import pose_regions

HAND = ["hand_empty", "hand_carrying", "hand_uncertain"]
SHELF = ["shelf_removed", "shelf_placed", "shelf_unchanged", "shelf_uncertain"]
STREAM = ["candidate_id", "clip_id", "actor_id", "hand_side", "region_id"]


def build_observations(hand: DataFrame, shelf: DataFrame, poses: DataFrame, polygons: dict[str, list[tuple[float, float]]], time: str = "t_h", tolerance: float = 0.3) -> DataFrame:
    """One row per stream and timestamp of either side, with the nearest pose of its actor and hand.

    hand and shelf hold at most one row per stream and timestamp_s; timestamps meet by equality, rows with a null key never. A missing side has probabilities 0.
    Without a pose within tolerance, wrist and distance are null, inside_region is false and trajectory_confidence is 0.5;
    a region without polygon has a wrist, but no distance.
    """
    both = hand.select(*STREAM, "timestamp_s", *HAND).join(shelf.select(*STREAM, "timestamp_s", *SHELF), [*STREAM, "timestamp_s"], "full_outer").fillna(0.0, [*HAND, *SHELF])
    who = F.struct("clip_id", "actor_id", "hand_side")
    near = nearest_observation(both.withColumn("who", who), poses.withColumn("who", who), "who", "timestamp_s", time, tolerance, ["wrist_x", "wrist_y", "wrist_confidence"]).drop("who", "observed_at")
    known = F.col("region_id").isin(*polygons)
    # every row is set against each of the configured polygons, in columns, and keeps its own
    own = pose_regions(near.filter(known).withColumnRenamed("region_id", "__own"), polygons).filter(F.col("__own") == F.col("region_id")).drop("__own")
    rest = near.filter(~F.coalesce(known, F.lit(False))).withColumns({"inside": F.lit(False), "distance": F.lit(None).cast("double")})
    seen = F.col("wrist_x").isNotNull() & F.col("wrist_y").isNotNull()
    return own.unionByName(rest).select(*STREAM, "timestamp_s", "wrist_x", "wrist_y", (seen & F.col("inside")).alias("inside_region"), F.when(seen, F.col("distance")).alias("distance_px"), F.coalesce("wrist_confidence", F.lit(0.5)).alias("trajectory_confidence"), *HAND, *SHELF)


def grace_window(events: DataFrame, obs: DataFrame, keys: list[str], grace: float, apart: float = 0.15) -> DataFrame:
    """events with those recovered that a too brief withdrawal lost: (keys, type, t_start, transfer_s, t_end, confidence).

    An inside row with evidence of a transfer whose next row, at most grace later, is outside becomes an event, unless an event or an earlier
    recovered one lies less than apart from it. Only streams with an event are visited. obs has at most one row per stream and timestamp_s.
    """
    columns = [*keys, "type", "t_start", "transfer_s", "t_end", "confidence"]
    if grace <= 0:
        return events.select(columns)
    t, by = F.col("timestamp_s"), Window.partitionBy(*keys).orderBy("timestamp_s")
    after = obs.withColumns({"__next": F.lead("timestamp_s").over(by), "__inside": F.lead("inside_region").over(by)})
    label = F.when((F.col("hand_carrying") > 0.55) & (F.col("shelf_removed") > 0.5), "pickup").when((F.col("hand_empty") > 0.55) & (F.col("shelf_placed") > 0.5), "putdown")
    lost = after.filter(F.col("inside_region") & ~F.col("__inside") & (F.col("__next") - t <= grace)).withColumn("type", label).filter("type is not null")
    lost = lost.select(*keys, "type", "timestamp_s", "__next").join(events.select(*keys).distinct(), keys, "left_semi")
    cell = lambda c: F.floor(c / apart)
    taken = events.select(*keys, F.col("transfer_s").alias("__t"), F.explode(F.array(*[cell(F.col("transfer_s")) + d for d in (-1, 0, 1)])).alias("__cell"))
    a, b = lost.withColumn("__cell", cell(t)).alias("a"), taken.alias("b")
    met = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in [*keys, "__cell"]]
    lost = a.join(b, [*met, F.abs(F.col("a.timestamp_s") - F.col("b.__t")) < apart], "left_anti").drop("__cell")
    # rows nearer than apart to each other form chains; in each, the first stays, then whatever is apart from the last that stayed
    far = F.coalesce(t - F.lag("timestamp_s").over(by) >= apart, F.lit(True)).cast("int")
    chains = lost.withColumn("__far", far).withColumn("__chain", F.sum("__far").over(by)).groupBy(*keys, "__chain").agg(F.array_sort(F.collect_list(F.struct("timestamp_s", "__next", "type"))).alias("a"))
    rest = F.slice("a", F.lit(2), F.size("a"))
    kept = F.aggregate(rest, F.slice("a", 1, 1), lambda acc, x: F.when(x["timestamp_s"] - F.element_at(acc, -1)["timestamp_s"] >= apart, F.concat(acc, F.array(x))).otherwise(acc))
    found = chains.select(*keys, F.explode(kept).alias("v")).select(*keys, "v.type", (F.col("v.timestamp_s") - apart).alias("t_start"), F.col("v.timestamp_s").alias("transfer_s"), F.col("v.__next").alias("t_end"), F.lit(0.35).alias("confidence"))
    return events.select(columns).unionByName(found)


def events_to_predictions(events: DataFrame, model: str) -> DataFrame:
    """Canonical predictions; an id depends on clip, type and the times to four digits, so that equal events share it."""
    name = F.concat_ws(":", "clip_id", "type", F.format_string("%.4f", "t_start"), F.format_string("%.4f", "t_end"))
    return events.select(F.concat(F.lit("pred_"), F.substring(F.sha2(name, 256), 1, 12)).alias("pred_id"), "clip_id", "type", "t_start", "t_end", F.col("confidence").alias("score"), F.lit(model).alias("model"))
