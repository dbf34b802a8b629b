"""Detection metrics: one-to-one matching of events and predictions, counts and rates.

Accepted pairs come from one bucketed interval join and are stored. Pairs whose both ends have no other accepted pair match natively;
the rest is solved per connected component in a grouped map by augmenting paths, count first.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventloom.functions.intervals import midpoint_distance, tiou
from eventloom.operators.decode import merge_window_predictions
from eventloom.operators.graphs import connected
from eventloom.operators.intervals import drop_ignored, overlap_join
from eventloom.operators.windows import expand_items
from eventloom.sources.shared import stored

TYPES = ("pickup", "putdown")


def accepted_pairs(gt: DataFrame, pred: DataFrame, on: list[str], threshold: float, criterion: str = "tiou") -> DataFrame:
    """(on..., event_id, pred_id, quality) with a temporal IoU of threshold or more, or (midpoint) with midpoints at most threshold seconds apart, quality 1 / (1 + distance)."""
    if criterion == "midpoint":
        mid = (F.col("t_start") + F.col("t_end")) / 2
        e = gt.select(*on, "event_id", "t_start", "t_end", mid.alias("__m"))
        p = pred.select(*on, "pred_id", F.col("t_start").alias("p_start"), F.col("t_end").alias("p_end"), "score", (mid - threshold).alias("__lo"), (mid + threshold).alias("__hi"))
        d = midpoint_distance(F.col("t_start"), F.col("t_end"), F.col("p_start"), F.col("p_end"))
        pairs = overlap_join(e, p, on, "__m", "__m", "__lo", "__hi", closed=True).filter(d <= threshold)
        return pairs.withColumn("quality", 1 / (1 + d)).drop("__m", "__lo", "__hi")
    p = pred.select(*on, "pred_id", F.col("t_start").alias("p_start"), F.col("t_end").alias("p_end"), "score")
    e = gt.select(*on, "event_id", "t_start", "t_end")
    pairs = overlap_join(e, p, on, "t_start", "t_end", "p_start", "p_end")
    q = tiou(F.col("t_start"), F.col("t_end"), F.col("p_start"), F.col("p_end"))
    return pairs.withColumn("quality", q).filter(F.col("quality") >= threshold)


def solve(scores: np.ndarray) -> list[tuple[int, int]]:
    """Rows to columns where scores > 0: most pairs first, then the largest total (Hungarian method on a square matrix)."""
    n = max(scores.shape)
    bonus = min(scores.shape) + 1.0
    cost = np.zeros((n + 1, n + 1))
    cost[1 : scores.shape[0] + 1, 1 : scores.shape[1] + 1] = -np.where(scores > 0, scores + bonus, 0)
    u, v, p, way = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1, int), np.zeros(n + 1, int)
    for i in range(1, n + 1):
        p[0], j0 = i, 0
        least, used = np.full(n + 1, np.inf), np.zeros(n + 1, bool)
        while True:
            used[j0] = True
            i0 = p[j0]
            cur = cost[i0] - u[i0] - v
            better = ~used & (cur < least)
            better[0] = False
            least[better], way[better] = cur[better], j0
            free = np.where(used, np.inf, least)
            free[0] = np.inf
            j1 = int(free.argmin())
            delta = free[j1]
            u[p[used]] += delta
            v[used] -= delta
            least[~used] -= delta
            j0 = j1
            if p[j0] == 0:
                break
        while j0:
            p[j0] = p[way[j0]]
            j0 = way[j0]
    return [(p[j] - 1, j - 1) for j in range(1, n + 1) if p[j] <= scores.shape[0] and j <= scores.shape[1] and scores[p[j] - 1, j - 1] > 0]


#: Pairs that one call of the solver's grouped map takes on, in components of any size.
SOLVED_TOGETHER = 20_000


def contested(pairs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Accepted pairs, stored once, as (pairs whose ends have no other, the rest with the label of their connected component, or None where there is no rest)."""
    alone = (F.count("*").over(Window.partitionBy("event_id")) == 1) & (F.count("*").over(Window.partitionBy("pred_id")) == 1)
    marked = stored(pairs.withColumn("alone", alone), "pairs")
    rest = marked.filter("not alone").drop("alone")
    if rest.isEmpty():
        return marked.drop("alone"), None
    # ids of both sides in one space of nodes
    node = lambda side, c: F.concat(F.lit(f"{side}:"), F.col(c).cast("string"))
    parts = connected(rest.select(node("e", "event_id").alias("u"), node("p", "pred_id").alias("v")))
    return marked.filter("alone").drop("alone"), rest.withColumn("node", node("e", "event_id")).join(parts, "node").drop("node")


def match_one_to_one(pairs: DataFrame, on: list[str]) -> DataFrame:
    """(on..., event_id, pred_id, quality): a largest one-to-one subset of accepted pairs, best total quality among those.

    Pairs without rivals need no solver. The rest splits into connected components, each solved on its own; many small ones share a call.
    """
    cols = [*on, "event_id", "pred_id", "quality"]
    sure, placed = contested(pairs.select(*cols))
    if placed is None:
        return sure

    def solved(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values(["label", "quality"], ascending=[True, False], kind="stable").reset_index(drop=True)
        q = np.maximum(df["quality"].to_numpy(), 1e-12)
        (part, parts), (e, _), (p, _) = (pd.factorize(df[c]) for c in ("label", "event_id", "pred_id"))
        several = np.ones(len(parts), bool)
        for side in (e, p):  # components with one event or one prediction give their best pair
            several &= np.bincount(part[~pd.DataFrame({"l": part, "s": side}).duplicated().to_numpy()], minlength=len(parts)) > 1
        first = np.append(np.flatnonzero(np.diff(part, prepend=-1)), len(part))
        chosen = first[:-1][~several].tolist()
        for k in np.flatnonzero(several):
            at = np.arange(first[k], first[k + 1])
            (rows, i), (columns, j) = (np.unique(side[at], return_inverse=True) for side in (e, p))
            m, place = np.zeros((len(rows), len(columns))), np.zeros((len(rows), len(columns)), np.int64)
            m[i, j], place[i, j] = q[at], at
            chosen.extend(int(place[x]) for x in solve(m))
        return df.iloc[chosen][cols]

    group = F.pmod(F.xxhash64("label"), F.lit(max(1, placed.count() // SOLVED_TOGETHER)))
    return sure.unionByName(placed.groupBy(group.alias("group")).applyInPandas(solved, sure.schema))


def class_aware(gt: DataFrame, pred: DataFrame, threshold: float = 0.5, on: tuple[str, ...] = ("clip_id", "type"), criterion: str = "tiou", matcher: str = "best", ignores: DataFrame | None = None) -> DataFrame:
    """(status, clip_id, type, event_id, pred_id): tp pairs, fn events, fp predictions. Rows that overlap ignores are left out first; other types raise an error.

    matcher: best (most pairs, then best quality) or ranked (best score first, each takes the free event of highest quality, the first on ties).
    """
    keys = list(on)
    gt, pred = (checked(x if ignores is None else drop_ignored(x, ignores)) for x in (gt, pred))
    pairs = accepted_pairs(gt, pred, keys, threshold, criterion)
    hits = match_ranked(pairs, keys) if matcher == "ranked" else match_one_to_one(pairs, keys).select("event_id", "pred_id")
    e = gt.select("clip_id", "type", "event_id").join(hits, "event_id", "left")
    found = e.select(F.when(F.col("pred_id").isNull(), "fn").otherwise("tp").alias("status"), "clip_id", "type", "event_id", "pred_id")
    lost = pred.select("clip_id", "type", "pred_id").join(hits, "pred_id", "left_anti").select(F.lit("fp").alias("status"), "clip_id", "type", F.lit(None).cast("string").alias("event_id"), "pred_id")
    return found.unionByName(lost)


def checked(rows: DataFrame) -> DataFrame:
    """rows, with an error for any type that is none of TYPES."""
    wrong = F.raise_error(F.concat(F.lit("not an event type: "), F.coalesce(F.col("type"), F.lit("null")))).cast("string")
    return rows.withColumn("type", F.when(F.col("type").isin(*TYPES), F.col("type")).otherwise(wrong))


def match_ranked(pairs: DataFrame, on: list[str]) -> DataFrame:
    """(event_id, pred_id): predictions by falling score (then start, end, id) each take the free event of highest quality, the first by (start, end, id) on ties.

    Pairs without rivals match natively; the fold runs in the JVM over the predictions of one connected component.
    """
    sure, placed = contested(pairs)
    if placed is None:
        return sure.select("event_id", "pred_id")
    events = F.array_sort(F.collect_list(F.struct((-F.col("quality")).alias("q"), "t_start", "t_end", "event_id")))
    rest = placed.groupBy("label", "pred_id").agg((-F.max("score")).alias("o"), F.min("p_start").alias("s"), F.min("p_end").alias("e"), events.alias("events"))
    ranked = rest.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("o", "s", "e", "pred_id", "events"))).alias("a"))
    none = F.expr("cast(array() as array<struct<event_id:string,pred_id:string>>)")

    def take(acc, p):
        free = F.get(F.filter(p["events"], lambda e: ~F.exists(acc, lambda k: k["event_id"] == e["event_id"])), F.lit(0))
        return F.when(free.isNull(), acc).otherwise(F.array_append(acc, F.struct(free["event_id"].alias("event_id"), p["pred_id"].alias("pred_id"))))

    folded = ranked.select(F.explode(F.aggregate("a", none, take)).alias("k")).select("k.event_id", "k.pred_id")
    return sure.select("event_id", "pred_id").unionByName(folded)


def rates(tp, fp, fn) -> dict:
    """precision, recall and f1 of count columns; 0 where a denominator is 0."""
    p = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0)
    r = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(0.0)
    return {"precision": p, "recall": r, "f1": F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)}


def metrics_by_type(matches: DataFrame) -> DataFrame:
    """tp, fp, fn and rates per type."""
    c = matches.groupBy("type").agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("tp", "fp", "fn")])
    return c.withColumns(rates(F.col("tp"), F.col("fp"), F.col("fn")))


def metrics_at(gt: DataFrame, pred: DataFrame, thresholds: list[float]) -> DataFrame:
    """Rates at several IoU thresholds from one pair join: the threshold becomes part of the block key."""
    pairs = accepted_pairs(gt, pred, ["clip_id", "type"], min(thresholds))
    each = pairs.withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds)))).filter("quality >= threshold")
    keyed = each.withColumns({c: F.concat_ws("@", c, "threshold") for c in ("event_id", "pred_id")})
    tp = match_one_to_one(keyed, ["clip_id", "type", "threshold"]).groupBy("threshold").agg(F.count("*").alias("tp"))
    n = gt.agg(F.count("*").alias("n_gt")).crossJoin(pred.agg(F.count("*").alias("n_pred")))  # two single rows
    all_ = n.select("n_gt", "n_pred", F.explode(F.array(*map(F.lit, thresholds))).alias("threshold")).join(tp, "threshold", "left").fillna(0, ["tp"])
    all_ = all_.select("threshold", "tp", (F.col("n_pred") - F.col("tp")).alias("fp"), (F.col("n_gt") - F.col("tp")).alias("fn"))
    return all_.withColumns(rates(F.col("tp"), F.col("fp"), F.col("fn")))


def confusion(gt: DataFrame, pred: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Class-agnostic matching per clip, counted by (type, predicted type)."""
    hits = match_one_to_one(accepted_pairs(gt, pred, ["clip_id"], threshold), ["clip_id"])
    typed = hits.join(gt.select("event_id", "type"), "event_id").join(pred.select("pred_id", F.col("type").alias("predicted")), "pred_id")
    counts = typed.groupBy("type").pivot("predicted", list(TYPES)).count()
    every = gt.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, TYPES))).alias("type"))
    return every.join(counts, "type", "left").fillna(0)


def metric_bundle(gt: DataFrame, pred: DataFrame, clips: DataFrame, ignores: DataFrame | None = None, thresholds: tuple[float, ...] = (0.3, 0.5), tolerance: float = 1.0) -> DataFrame:
    """(metric, value) rows: rates at each IoU threshold and by midpoint, start and end errors of the midpoint matches, false positives an hour,
    event count errors, recall of multi-item events. Values of empty sides are null or 0, as in rates()."""
    if ignores is not None:
        gt, pred = drop_ignored(gt, ignores), drop_ignored(pred, ignores)
    base = 0.5 if 0.5 in thresholds else min(thresholds)
    at = metrics_at(gt, pred, list(thresholds)).withColumn("name", F.concat(F.lit("tiou@"), F.col("threshold").cast("string")))
    close = class_aware(gt, pred, tolerance, criterion="midpoint")
    counts = close.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("tp", "fp", "fn")]).withColumns(rates(F.col("tp"), F.col("fp"), F.col("fn")))
    both = at.select("name", "tp", "fp", "fn", "precision", "recall", "f1").unionByName(counts.withColumn("name", F.lit(f"midpoint@{tolerance}s")))
    each = [F.struct(F.concat_ws(" ", "name", F.lit(c)).alias("metric"), F.col(c).cast("double").alias("value")) for c in ("tp", "fp", "fn", "precision", "recall", "f1")]
    out = both.select(F.explode(F.array(*each)).alias("m")).select("m.*")

    def rows(df: DataFrame, **values) -> DataFrame:
        cells = [F.struct(F.lit(k).alias("metric"), v.cast("double").alias("value")) for k, v in values.items()]
        return df.select(F.explode(F.array(*cells)).alias("m")).select("m.*")

    matched = close.filter("status = 'tp'").select("event_id", "pred_id").join(gt.select("event_id", "t_start", "t_end"), "event_id").join(pred.select("pred_id", F.col("t_start").alias("ps"), F.col("t_end").alias("pe")), "pred_id")
    errors = matched.agg(F.avg(F.abs(F.col("t_start") - F.col("ps"))).alias("s"), F.avg(F.abs(F.col("t_end") - F.col("pe"))).alias("e"))
    seconds = clips.agg(F.sum("duration_s").alias("seconds"))
    hours = at.filter(F.col("threshold") == base).select("fp").crossJoin(seconds)  # two single rows
    n = gt.select("clip_id", F.lit(1).alias("d")).unionByName(pred.select("clip_id", F.lit(-1).alias("d"))).groupBy("clip_id").agg(F.sum("d").alias("d"))
    several = multi_item_events(gt)
    found = several.select("event_id").join(class_aware(several, pred, base).filter("status = 'tp'").select("event_id", F.lit(1).alias("hit")), "event_id", "left")
    multi = found.agg(F.count("*").alias("n"), F.count("hit").alias("h"))
    out = out.unionByName(rows(errors, start_mae_s=F.col("s"), end_mae_s=F.col("e"))).unionByName(rows(hours, fp_per_hour=F.when(F.col("seconds") > 0, F.col("fp") / (F.col("seconds") / 3600))))
    out = out.unionByName(rows(n.agg(F.sum(F.abs("d")).alias("c"), F.abs(F.sum("d")).alias("a")), event_count_error_per_clip=F.coalesce("c", F.lit(0)), event_count_error_absolute=F.coalesce("a", F.lit(0))))
    return out.unionByName(rows(multi, multi_item_recall=F.when(F.col("n") > 0, F.col("h") / F.col("n")), multi_item_support=F.col("n")))


def multi_item_events(events: DataFrame, group: str = "event_group_id", overlap: float | None = None) -> DataFrame:
    """Events that share a group id, or without one clip, type and times to 6 digits, with another event; with overlap, instead, all of which another event
    of clip and type has an IoU of overlap or more (a cluster of linked events has at least two members exactly then)."""
    if overlap is not None:
        other = events.select("clip_id", "type", F.col("event_id").alias("other_id"), F.col("t_start").alias("os"), F.col("t_end").alias("oe"))
        pairs = overlap_join(events.select("clip_id", "type", "event_id", "t_start", "t_end"), other, ["clip_id", "type"], "t_start", "t_end", "os", "oe").filter("event_id <> other_id")
        linked = pairs.filter(tiou(F.col("t_start"), F.col("t_end"), F.col("os"), F.col("oe")) >= overlap)
        return events.join(linked.select("event_id").distinct(), "event_id", "left_semi").select(*events.columns)
    own = F.coalesce(F.col(group), F.lit("")) if group in events.columns else F.lit("")
    same = [F.when(own == "", F.round(c, 6)) for c in ("t_start", "t_end")]
    n = F.count("*").over(Window.partitionBy("clip_id", "type", own, *same))
    return events.withColumn("__n", n).filter("__n > 1").drop("__n")


def evaluate_merged(responses: DataFrame, gt: DataFrame, gap: float = 1.0, threshold: float = 0.5) -> DataFrame:
    """Rates (to 4 digits) per type of window responses (clip_id, type, t_start, t_end, score, pred_id, items): merged across windows, one prediction per item, matched."""
    merged = merge_window_predictions(responses, gap)
    # pieces of a group share its pred_ids, so that their start is part of the name
    preds = merged.withColumn("pred_id", F.concat_ws("@", F.array_join("pred_ids", "+"), F.col("t_start").cast("string"))).drop("pred_ids", "window_ids", "group_id")
    preds = stored(expand_items(preds, "items", "pred_id") if "items" in responses.columns else preds, "merged")
    found = metrics_by_type(class_aware(gt, preds, threshold))
    every = gt.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, TYPES))).alias("type"))
    return every.join(found, "type", "left").fillna(0).select("type", "tp", "fp", "fn", *[F.round(c, 4).alias(c) for c in ("precision", "recall", "f1")])


def gallery(gt: DataFrame, pred: DataFrame, threshold: float = 0.5, ignores: DataFrame | None = None) -> DataFrame:
    """(category, clip_id, type, pred_type, event_id, pred_id, t_start, t_end, score) for review: false_positive and false_negative of the class-aware matching, and
    type_confusion, pairs of different types in a matching per clip whatever the type. Both come from one pair join."""
    gt, pred = (checked(x if ignores is None else drop_ignored(x, ignores)) for x in (gt, pred))
    e, p = gt.withColumnRenamed("type", "e_type"), pred.withColumnRenamed("type", "p_type")
    pairs = accepted_pairs(gt, pred, ["clip_id"], threshold).join(e.select("event_id", "e_type"), "event_id").join(p.select("pred_id", "p_type"), "pred_id")
    pairs = stored(pairs.select("clip_id", "e_type", "p_type", "event_id", "pred_id", "quality"), "pairs")
    own = match_one_to_one(pairs.filter("e_type = p_type").withColumnRenamed("e_type", "type"), ["clip_id", "type"]).select("event_id", "pred_id")
    any_type = match_one_to_one(pairs, ["clip_id", "e_type", "p_type"]).filter("e_type <> p_type")
    none = lambda kind: F.lit(None).cast(kind)
    ids = dict(gt.dtypes)["event_id"], dict(pred.dtypes)["pred_id"]
    missed = gt.join(own, "event_id", "left_anti").select(
        F.lit("false_negative").alias("category"), "clip_id", "type", none("string").alias("pred_type"), "event_id", none(ids[1]).alias("pred_id"), "t_start", "t_end", none("double").alias("score")
    )
    wrong = pred.join(own, "pred_id", "left_anti").select(
        F.lit("false_positive").alias("category"), "clip_id", none("string").alias("type"), F.col("type").alias("pred_type"), none(ids[0]).alias("event_id"), "pred_id", "t_start", "t_end", "score"
    )
    mixed = any_type.join(gt.select("event_id", "t_start", "t_end"), "event_id").select(
        F.lit("type_confusion").alias("category"), "clip_id", F.col("e_type").alias("type"), F.col("p_type").alias("pred_type"), "event_id", "pred_id", "t_start", "t_end", none("double").alias("score")
    )
    return missed.unionByName(wrong).unionByName(mixed)


def people_at(events: DataFrame, tracks: DataFrame, first: str = "first_seen", last: str = "last_seen", bucket: float = 600.0) -> DataFrame:
    """events with n_person: how many tracks (clip_id, first, last; closed) are live at once at most during each.

    A sweep: +1 at each start, -1 at each end, starts first; its running sum is the level until the next change. The sum runs inside time buckets of
    a clip and begins with what the earlier buckets add up to, so that no clip is summed in one task.
    """
    ends = F.array(F.struct(F.col(first).alias("t"), F.lit(1).alias("d")), F.struct(F.col(last).alias("t"), F.lit(-1).alias("d")))
    steps = tracks.filter(f"{first} <= {last}").select("clip_id", F.explode(ends).alias("s")).select("clip_id", "s.t", "s.d").withColumn("b", F.floor(F.col("t") / bucket))
    sums = steps.groupBy("clip_id", "b").agg(F.sum("d").alias("n"), F.min("t").alias("from"))
    buckets = Window.partitionBy("clip_id").orderBy("b")
    base = sums.select("clip_id", "b", F.coalesce(F.sum("n").over(buckets.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"), F.lead("from").over(buckets).alias("after"))
    by = Window.partitionBy("clip_id", "b").orderBy("t", F.desc("d"))
    level = F.col("base") + F.sum("d").over(by.rowsBetween(Window.unboundedPreceding, 0))
    segments = steps.join(base, ["clip_id", "b"]).select("clip_id", F.col("t").alias("__s"), F.coalesce(F.lead("t").over(by), "after", "t").alias("__e"), level.alias("__n")).filter("__n > 0")
    met = overlap_join(events.select("clip_id", "event_id", "t_start", "t_end"), segments, ["clip_id"], "t_start", "t_end", "__s", "__e", closed=True)
    most = met.groupBy("event_id").agg(F.max("__n").alias("n_person"))
    return events.join(most, "event_id", "left").fillna(0, ["n_person"]).select(*events.columns, "n_person")


def slice_metrics(gt: DataFrame, pred: DataFrame, short: float = 1.0, threshold: float = 0.5, ignores: DataFrame | None = None) -> DataFrame:
    """(slice, tp, fn, support, recall): each slice's events are matched on their own against all predictions, by one pair join.

    Slices: short_events and long_events; with a column confidence, high_med_only and low_confidence; with hard_case, hard_cases; with n_person, multiple_person. Empty ones have no row.
    """
    gt, pred = (checked(x if ignores is None else drop_ignored(x, ignores)) for x in (gt, pred))
    length, names = F.col("t_end") - F.col("t_start"), []
    if "confidence" in gt.columns:
        names.append(F.when(F.coalesce("confidence", F.lit("high")).isin("high", "med"), "high_med_only").when(F.col("confidence") == "low", "low_confidence"))
    if "hard_case" in gt.columns:
        names.append(F.when(F.col("hard_case"), "hard_cases"))
    if "n_person" in gt.columns:
        names.append(F.when(F.col("n_person") > 1, "multiple_person"))
    names.append(F.when(length < short, "short_events").otherwise("long_events"))
    sliced = gt.select("event_id", "clip_id", "type", "t_start", "t_end", F.explode(F.array_compact(F.array(*names))).alias("slice"))
    pairs = accepted_pairs(gt, pred, ["clip_id", "type"], threshold).select("clip_id", "type", "event_id", "pred_id", "quality").join(sliced.select("event_id", "slice"), "event_id")
    keyed = pairs.withColumns({c: F.concat_ws("@", c, "slice") for c in ("event_id", "pred_id")})
    tp = match_one_to_one(keyed, ["clip_id", "type", "slice"]).groupBy("slice").agg(F.count("*").alias("tp"))
    out = sliced.groupBy("slice").agg(F.count("*").alias("support")).join(tp, "slice", "left").fillna(0, ["tp"])
    return out.select("slice", "tp", (F.col("support") - F.col("tp")).alias("fn"), "support", (F.col("tp") / F.col("support")).alias("recall"))


def slice_recall(gt: DataFrame, matches: DataFrame, short: float = 1.0) -> DataFrame:
    """Recall by confidence, difficulty and length of the events."""
    e = gt.join(matches.filter("status <> 'fp'").select("event_id", "status"), "event_id")
    names = F.array(F.concat(F.lit("confidence="), "confidence"), F.when(F.col("hard_case"), "hard").otherwise("easy"), F.when(F.col("t_end") - F.col("t_start") < short, "short").otherwise("long"))
    return e.select(F.explode(names).alias("slice"), "status").groupBy("slice").agg(F.count("*").alias("n_events"), F.avg((F.col("status") == "tp").cast("double")).alias("recall"))
