"""Window scores to events: smoothing, runs above a threshold, merging across windows."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.functions.intervals import tiou
from eventloom.sources.shared import dropped, stored

CLASSES = ("background", "pickup", "putdown")


def smooth_scores(scores: DataFrame, size: int = 3, key: str = "clip_id", order: str = "k") -> DataFrame:
    """Centred moving average of the class probabilities (an even size grows by one) and the first best class."""
    half = (size + (size % 2 == 0)) // 2
    w = Window.partitionBy(key).orderBy(order).rowsBetween(-half, half)
    out = scores.select(key, order, *[F.avg(f"p_{c}").over(w).alias(f"p_{c}") for c in CLASSES])
    best = F.greatest(*[F.col(f"p_{c}") for c in CLASSES])
    label = F.coalesce(*[F.when(F.col(f"p_{c}") == best, F.lit(c)) for c in CLASSES])
    return out.withColumn("label", label)


def threshold_regions(scores: DataFrame, label: str, threshold: float, key: str = "clip_id", order: str = "k", start: str = "window_start_s", end: str = "window_end_s") -> DataFrame:
    """Maximal runs of windows whose score for label is above threshold, with peak and mean."""
    by = Window.partitionBy(key).orderBy(order)
    p = F.col(f"p_{label}")
    rows = scores.withColumn("__n", F.row_number().over(by)).filter(p > threshold)
    rows = rows.withColumn("__run", F.col("__n") - F.row_number().over(by))
    out = rows.groupBy(key, "__run").agg(F.min(start).alias("t_start"), F.max(end).alias("t_end"), F.max(p).alias("peak"), F.avg(p).alias("mean"), F.count("*").alias("n_windows"))
    return out.drop("__run").withColumn("type", F.lit(label))


def merge_window_predictions(rows: DataFrame, threshold: float = 1.0) -> DataFrame:
    """Same-type predictions (clip_id, type, t_start, t_end, score, pred_id, optional items and window_id) of a clip across windows; no_event rows are left out.

    A group goes on while the next row starts before the running end, or after the previous row's end by a positive gap of at most threshold (an exact touch
    breaks). The union of its intervals, of which there may be several, are its predictions: all have the group's largest score and items, its
    pred_ids, its window_ids where there are any, and a group_id of their own where items > 1, else an empty one.
    """
    order = ["t_start", "t_end", "pred_id"]
    by = Window.partitionBy("clip_id", "type").orderBy(*order)
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    gap = F.col("t_start") - F.lag("t_end").over(by)
    goes_on = (F.col("t_start") < F.max("t_end").over(before)) | ((gap > 0) & (gap <= threshold))
    rows = rows.filter("type <> 'no_event'").withColumn("__new", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)).withColumn("__g", F.sum("__new").over(by))
    inside = Window.partitionBy("clip_id", "type", "__g").orderBy(*order)
    top = F.max("t_end").over(inside.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("__cut", F.when(top.isNull() | (F.col("t_start") > top), 1).otherwise(0)).withColumn("__piece", F.sum("__cut").over(inside))
    ids = [c for c in ("pred_id", "window_id") if c in rows.columns]
    pieces = rows.groupBy("clip_id", "type", "__g", "__piece").agg(F.min("t_start").alias("t_start"), F.max("t_end").alias("t_end"), F.max("score").alias("score"), *[F.collect_set(c).alias(f"{c}s") for c in ids], *[F.max("items").alias("items")] * ("items" in rows.columns))
    whole = Window.partitionBy("clip_id", "type", "__g")
    out = {"score": F.max("score").over(whole)} | {f"{c}s": F.array_sort(F.array_distinct(F.flatten(F.collect_list(f"{c}s").over(whole)))) for c in ids}
    if "items" in rows.columns:
        out["items"] = F.max("items").over(whole)
    merged = pieces.withColumns(out)
    name = F.concat(F.lit("l2_"), F.substring(F.md5(F.concat_ws("|", "clip_id", "type", F.format_string("%.3f", "t_start"), F.format_string("%.3f", "t_end"))), 1, 12))
    if "items" in rows.columns:
        merged = merged.withColumn("group_id", F.when(F.col("items") > 1, name).otherwise(""))
    return merged.drop("__g", "__piece")


def merge_same_type_regions(regions: DataFrame, gap: float = 0.75, least: float = 0.3, key: str = "clip_id") -> DataFrame:
    """Regions (key, type, t_start, t_end, peak, mean) of one type that lie at most gap apart become one; its mean is folded pairwise in order. Shorter than least: left out."""
    by = Window.partitionBy(key, "type").orderBy("t_start", "t_end")
    so_far = F.max("t_end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    rows = regions.withColumn("__g", F.sum(F.when(so_far.isNull() | (F.col("t_start") - so_far > gap), 1).otherwise(0)).over(by))
    found = rows.groupBy(key, "type", "__g").agg(F.min("t_start").alias("t_start"), F.max("t_end").alias("t_end"), F.max("peak").alias("peak"), F.array_sort(F.collect_list(F.struct("t_start", "t_end", "mean"))).alias("a"))
    mean = F.aggregate(F.slice("a", 2, F.greatest(F.size("a"), F.lit(1))), F.get("a", F.lit(0))["mean"], lambda m, x: (m + x["mean"]) / 2)
    return found.withColumn("mean", mean).filter(F.col("t_end") - F.col("t_start") >= least).drop("__g", "a")


def refine_boundaries(start: Column, end: Column, transfer: Column, window: tuple[Column, Column], clip: tuple[Column, Column], extension: float = 0.5, least: float = 0.1) -> tuple[Column, Column]:
    """Event bounds held to the candidate window (give or take extension) and the clip, around the transfer, at least `least` long, to 4 digits."""
    s = F.least(F.greatest(start, clip[0], window[0] - extension), transfer)
    e = F.greatest(F.least(end, window[1] + extension, clip[1]), transfer)
    middle, tight = (s + e) / 2, e - s < least
    s, e = F.when(tight, middle - least / 2).otherwise(s), F.when(tight, middle + least / 2).otherwise(e)
    s, e = F.greatest(s, clip[0]), F.least(e, clip[1])
    broken = s >= e
    return F.bround(F.when(broken, transfer - least / 2).otherwise(s), 4), F.bround(F.when(broken, transfer + least / 2).otherwise(e), 4)


def temporal_nms(preds: DataFrame, keys: tuple[str, ...] = ("clip_id", "type"), threshold: float = 0.5, transfer: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """(kept, audit) of predictions (keys, pred_id, t_start, t_end, transfer_s, score): best score first, one is dropped if a kept one of its keys overlaps it by
    an IoU of threshold with a transfer at most `transfer` away. The audit (dropped, kept) names the first such kept one.

    Greedy suppression by parallel rounds, whatever the density: a row without a live rival ranked before it is kept, the rows that it suppresses leave, and so
    on. Rivals come from one join on keys and a cell of the transfer time; equal intervals meet it as one row. pred_id is unique; threshold and transfer are positive.
    """
    rank = F.struct((-F.col("score")).alias("s"), "t_start", "pred_id")
    row = preds.filter("t_end > t_start").select(*keys, "t_start", "t_end", "transfer_s", rank.alias("rank"))  # others overlap nothing
    # of rows with equal times the best is kept or dropped, and all others are dropped, by whatever drops it or by it
    same = [*keys, "t_start", "t_end", "transfer_s"]
    best = row.groupBy(*same).agg(F.min("rank").alias("rank"))
    cell = F.floor(F.col("transfer_s") / transfer)
    a = best.withColumn("cell", cell)
    b = best.select(*keys, *[F.col(c).alias(f"x_{c}") for c in ("t_start", "t_end", "transfer_s", "rank")], F.explode(F.array(*[cell + d for d in (-1, 0, 1)])).alias("cell"))
    shared = tiou(F.col("t_start"), F.col("t_end"), F.col("x_t_start"), F.col("x_t_end")) >= threshold
    rivals = a.join(b, [*keys, "cell"]).filter((F.col("rank") < F.col("x_rank")) & shared & (F.abs(F.col("transfer_s") - F.col("x_transfer_s")) <= transfer))
    rivals = stored(rivals.select(F.col("rank").alias("k"), F.col("x_rank").alias("x")), "rivals")
    live, lost, kept = rivals, [], []
    while not live.isEmpty():
        free = live.select("k").join(live.select(F.col("x").alias("k")), "k", "left_anti").distinct()
        now = stored(free, "kept")
        gone = stored(live.join(now, "k", "left_semi").select("x").distinct(), "lost")
        kept.append(now)
        lost.append(gone)
        rest = live.join(now, "k", "left_anti").join(gone, "x", "left_anti").join(gone.select(F.col("x").alias("k")), "k", "left_anti").select("k", "x")
        rest = stored(rest, "rivals")
        if live is not rivals:
            dropped(live)
        live = rest
    empty = rivals.select("k").limit(0)
    fallen = functools.reduce(DataFrame.union, [g.select("x") for g in lost], empty).withColumnRenamed("k", "x")
    # rows of a dropped rival are never kept, so that whoever drops a row stands in its pairs and fell to no one
    first = rivals.join(fallen, "x", "left_semi").join(fallen.select(F.col("x").alias("k")), "k", "left_anti").groupBy("x").agg(F.min("k").alias("k"))
    judged = row.join(best.select(*same, F.col("rank").alias("top")), same).join(first.select(F.col("x").alias("top"), "k"), "top", "left")
    audit = judged.filter((F.col("rank") != F.col("top")) | F.col("k").isNotNull()).select(F.col("rank.pred_id").alias("dropped"), F.coalesce("k", "top").getField("pred_id").alias("kept"))
    audit = stored(audit, "audit")
    dropped(*kept, *lost)
    return preds.join(audit.select(F.col("dropped").alias("pred_id")), "pred_id", "left_anti").select(*preds.columns), audit


def decode_events(scores: DataFrame, threshold: float = 0.4, size: int = 3, gap: float = 0.75, least: float = 0.3) -> DataFrame:
    """Window scores (clip_id, k, window_start_s, window_end_s, p_...) to events: smoothed, cut into regions above threshold per type, merged."""
    smooth = smooth_scores(scores, size).drop("label").join(scores.select("clip_id", "k", "window_start_s", "window_end_s"), ["clip_id", "k"])
    regions = threshold_regions(smooth, "pickup", threshold).unionByName(threshold_regions(smooth, "putdown", threshold))
    return merge_same_type_regions(regions.drop("n_windows"), gap, least)
