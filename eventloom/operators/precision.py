"""Average precision of ranked predictions.

Ranks run over all predictions of a type. They are counted in two levels, score buckets and rows inside a bucket, so that no
task orders a whole type; only the buckets' totals, a table of fixed size, are broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventloom.operators.evaluate import accepted_pairs, contested
from eventloom.sources.shared import stored

#: Score buckets per type.
BUCKETS = 1000


def ranked_hits(gt: DataFrame, pred: DataFrame, threshold: float) -> DataFrame:
    """(pred_id) of hits: per (clip, type), best score first, each takes the free event of highest IoU, the last on ties."""
    return hits_of(accepted_pairs(gt, pred, ["clip_id", "type"], threshold))


def hits_of(pairs: DataFrame) -> DataFrame:
    """ranked_hits() of accepted pairs; the fold runs over one connected component of them."""
    sure, placed = contested(pairs)
    if placed is None:
        return sure.select("pred_id")
    rest = placed.groupBy("label", "pred_id").agg((-F.max("score")).alias("o"), F.min("p_start").alias("s"), F.min("p_end").alias("e"), F.collect_list(F.struct("quality", "t_start", "t_end", "event_id")).alias("events"))
    blocks = rest.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("o", "s", "e", "pred_id", "events"))).alias("ranked"))
    kind = {c: dict(pairs.dtypes)[c] for c in ("event_id", "pred_id")}
    none = F.expr(f"named_struct('used', cast(array() as array<{kind['event_id']}>), 'hits', cast(array() as array<{kind['pred_id']}>))")

    def take(acc, p):
        best = F.array_max(F.filter(p["events"], lambda e: ~F.array_contains(acc["used"], e["event_id"])))
        return F.when(best.isNull(), acc).otherwise(F.struct(F.concat(acc["used"], F.array(best["event_id"])).alias("used"), F.concat(acc["hits"], F.array(p["pred_id"])).alias("hits")))

    folded = blocks.select(F.explode(F.aggregate("ranked", none, take)["hits"]).alias("pred_id"))
    return sure.select("pred_id").unionByName(folded)


def average_precision(gt: DataFrame, pred: DataFrame, threshold: float = 0.5, pairs: DataFrame | None = None) -> DataFrame:
    """(type, n_gt, n_pred, ap), all-points interpolation: ap is null without events, 0 without predictions. pairs: accepted ones, if they are there already."""
    hits = (ranked_hits(gt, pred, threshold) if pairs is None else hits_of(pairs)).withColumn("hit", F.lit(1))
    rows = pred.select("type", "clip_id", "pred_id", "score", "t_start", "t_end").join(hits, "pred_id", "left").fillna(0, ["hit"])
    rows = rows.withColumn("bucket", F.floor(F.coalesce("score", F.lit(0.0)) * BUCKETS))
    totals = rows.groupBy("type", "bucket").agg(F.count("*").alias("n"), F.sum("hit").alias("h"))
    earlier = Window.partitionBy("type").orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("type", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n0"), F.coalesce(F.sum("h").over(earlier), F.lit(0)).alias("h0"))
    inner = Window.partitionBy("type", "bucket").orderBy(F.desc("score"), "t_start", "t_end", "clip_id", "pred_id")
    curve = rows.join(F.broadcast(base), ["type", "bucket"])
    rank, found = F.col("n0") + F.row_number().over(inner), F.col("h0") + F.sum("hit").over(inner.rowsBetween(Window.unboundedPreceding, 0))
    curve = curve.withColumn("precision", found / rank)
    later = Window.partitionBy("type").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    tops = curve.groupBy("type", "bucket").agg(F.max("precision").alias("top")).select("type", "bucket", F.max("top").over(later).alias("beyond"))
    # the order is total, so that the rows from here to the bucket's end are those up to here in the reverse order, where a running maximum reads each row once
    back = Window.partitionBy("type", "bucket").orderBy("score", F.desc("t_start"), F.desc("t_end"), F.desc("clip_id"), F.desc("pred_id"))
    envelope = F.greatest(F.max("precision").over(back.rowsBetween(Window.unboundedPreceding, 0)), F.coalesce("beyond", F.lit(0.0)))
    area = curve.join(F.broadcast(tops), ["type", "bucket"]).withColumn("envelope", envelope).groupBy("type").agg(F.sum(F.when(F.col("hit") == 1, F.col("envelope")).otherwise(0.0)).alias("area"), F.count("*").alias("n_pred"))
    out = gt.groupBy("type").agg(F.count("*").alias("n_gt")).join(area, "type", "full_outer").fillna(0, ["n_gt", "n_pred", "area"])
    return out.select("type", "n_gt", "n_pred", F.when(F.col("n_gt") > 0, F.col("area") / F.col("n_gt")).alias("ap"))


def mean_precision(gt: DataFrame, pred: DataFrame, thresholds: tuple[float, ...] = (0.3, 0.5, 0.7)) -> DataFrame:
    """(threshold, map): the mean over types with events; null where none has."""
    pairs = stored(accepted_pairs(gt, pred, ["clip_id", "type"], min(thresholds)), "pairs")
    parts = [average_precision(gt, pred, t, pairs.filter(F.col("quality") >= t)).withColumn("threshold", F.lit(t)) for t in thresholds]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("threshold").agg(F.avg("ap").alias("map"))
