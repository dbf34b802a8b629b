"""Joins and merges of intervals that share an equality key.

Interval joins, also semi and anti joins, add a time bucket to the key, so a clip with many intervals is not compared pair by pair and a hot clip spreads over
tasks. Inner joins: both sides are repeated for each bucket they touch, and a pair counts in the bucket of its later start only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.functions.intervals import overlap_seconds, overlaps


#: How many buckets an interval may touch.
REACH = 64


def overlap_join(left: DataFrame, right: DataFrame, on: list[str], ls: str, le: str, rs: str, re: str, closed: bool = False, bucket: float = 60.0) -> DataFrame:
    """Inner join where the intervals overlap; right's columns other than the key must have names of their own.

    One equality join on (key, kind, cell). Intervals of up to REACH buckets meet each other in cells of a bucket (kind 0); pairs with a longer one meet in
    cells REACH x REACH times as wide (kind 1: left is long, kind 2: only right is), so that no interval is repeated without bound.
    """
    wide = bucket * REACH * REACH

    def cells(df: DataFrame, s: str, e: str, short: tuple[int, ...], far: tuple[int, ...]) -> DataFrame:
        top = F.greatest(F.col(s), F.col(e))

        def at(kind: int) -> Column:
            width = bucket if kind == 0 else wide
            return F.transform(F.sequence(F.floor(F.col(s) / width), F.floor(top / width)), lambda c: F.struct(F.lit(kind).alias("kind"), c.alias("cell")))

        several = lambda kinds: F.concat(*map(at, kinds)) if len(kinds) > 1 else at(kinds[0])
        return df.withColumn("__c", F.explode(F.when(F.col(e) - F.col(s) > REACH * bucket, several(far)).otherwise(several(short))))

    a, b = cells(left, ls, le, (0, 2), (1,)), cells(right, rs, re, (0, 1), (1, 2))
    first = F.greatest(F.col(ls), F.col(rs)) / F.when(F.col("__c.kind") == 0, bucket).otherwise(wide)
    hit = overlaps(F.col(ls), F.col(le), F.col(rs), F.col(re), closed) & (F.floor(first) == F.col("__c.cell"))
    # never broadcast: sizes estimated from files know nothing of the cells
    return a.hint("merge").join(b.hint("merge"), [*on, "__c"]).filter(hit).drop("__c")


def overlap_filter(left: DataFrame, right: DataFrame, on: str, ls: str, le: str, rs: str, re: str, keep: bool, closed: bool = False, bucket: float = 60.0) -> DataFrame:
    """Semi (keep) or anti join on the key and an overlap; left rows are neither repeated nor named.

    Right's intervals are merged first, so that those of a key are disjoint. A left row asks, by its length, in cells of a bucket, of REACH or of REACH x REACH
    buckets, where it touches two at most. Right is repeated over the cells it touches and the one before, so that one semi or anti join, in the cell of the
    row's start, meets all; a right interval that touches more than REACH cells of a level, and left rows beyond all levels, are compared by key alone.
    """
    r = merge_intervals(right.select(F.col(on).alias("__k"), F.col(rs).alias("__s"), F.col(re).alias("__e")).filter(F.col("__s") <= F.col("__e")), ["__k"], "__s", "__e", touching=closed).select("__k", "__s", "__e")
    hit = (F.col(on) == F.col("__k")) & overlaps(F.col(ls), F.col(le), F.col("__s"), F.col("__e"), closed)

    def union(parts: list[DataFrame]) -> DataFrame:
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def met(rows: DataFrame, tests: list) -> DataFrame:
        """With keep, rows that pass any test (each keeps its own and hands on the rest); else those that pass none."""
        found = []
        for others, condition in tests:
            if keep:
                found.append(rows.join(others, condition, "left_semi"))
            rows = rows.join(others, condition, "left_anti")
        return union(found) if keep else rows

    if ls == le:  # points touch one cell of a bucket
        widths, before = [bucket], 0
    else:
        widths, before = [bucket, bucket * REACH, bucket * REACH * REACH], 1
    length, parts, under = F.coalesce(F.col(le) - F.col(ls), F.lit(0.0)), [], None
    for width in widths:
        far = F.col("__e") - F.col("__s") > REACH * width
        cells = r.filter(~far).withColumn("__cell", F.explode(F.sequence(F.floor(F.col("__s") / width) - before, F.floor(F.col("__e") / width))))
        mine = left if ls == le else left.filter((length <= width) if under is None else ((length > under) & (length <= width)))
        parts.append(met(mine, [(r.filter(far), hit), (cells, hit & (F.floor(F.col(ls) / width) == F.col("__cell")))]))
        under = width
    if ls != le:
        parts.append(met(left.filter(length > under), [(r, hit)]))
    return union(parts)


def drop_ignored(items: DataFrame, ignores: DataFrame, start: str = "t_start", end: str = "t_end") -> DataFrame:
    """Rows that overlap no ignore interval of their clip by a positive length."""
    return overlap_filter(items, ignores, "clip_id", start, end, "t_start", "t_end", keep=False)


def center_not_ignored(items: DataFrame, ignores: DataFrame, center: str) -> DataFrame:
    """Rows whose centre lies in no closed ignore interval."""
    return overlap_filter(items, ignores, "clip_id", center, center, "t_start", "t_end", keep=False, closed=True)


def merge_intervals(df: DataFrame, keys: list[str], start: str, end: str, gap: float = 0.0, touching: bool = True) -> DataFrame:
    """Gaps and islands: an interval joins the island while it starts within gap of the running end (inclusive, or exclusive without touching)."""
    order = Window.partitionBy(*keys).orderBy(start, end)
    so_far = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.withColumn("__new", F.when(so_far.isNull() | ((F.col(start) > so_far + gap) if touching else (F.col(start) >= so_far + gap)), 1).otherwise(0))
    islands = marked.withColumn("__island", F.sum("__new").over(order))
    return islands.groupBy(*keys, "__island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n_merged")).withColumn("island", F.col("__island") - 1).drop("__island")


def active_spans(obs: DataFrame, time: str = "t_h", radius: float = 0.5, gap: float = 6.0, length: float = 720.0) -> DataFrame:
    """Observations widened by radius, clamped to the clip, merged and numbered. Where obs has is_stable, only stable ones count."""
    if "is_stable" in obs.columns:
        obs = obs.filter("is_stable")
    lo, hi = F.greatest(F.lit(0.0), F.col(time) - radius), F.least(F.lit(length), F.col(time) + radius)
    spread = obs.select("clip_id", lo.alias("t_start"), hi.alias("t_end")).filter("t_start < t_end")
    spans = merge_intervals(spread, ["clip_id"], "t_start", "t_end", gap)
    return spans.select("clip_id", F.concat_ws(":", "clip_id", F.lit("active"), F.format_string("%03d", F.col("island"))).alias("active_span_id"), "t_start", "t_end", F.lit(0).alias("n_person_tracks"))


def clip_summary(clips: DataFrame, obs: DataFrame, spans: DataFrame) -> DataFrame:
    """One row per clip, also without spans: distinct stable tracks of obs (clip_id, track_key, is_stable), and the spans' extent."""
    tracks = obs.filter("is_stable").groupBy("clip_id").agg(F.count_distinct("track_key").alias("n_person_tracks"))
    extent = spans.groupBy("clip_id").agg(F.count("*").alias("n_spans"), F.min("t_start").alias("active_start_s"), F.max("t_end").alias("active_end_s"), F.sum(F.col("t_end") - F.col("t_start")).alias("active_s"))
    every = clips.select("clip_id").union(obs.select("clip_id")).distinct()
    out = every.join(tracks, "clip_id", "left").join(extent, "clip_id", "left")
    return out.select("clip_id", F.coalesce("n_person_tracks", F.lit(0)).alias("n_person_tracks"), F.col("n_spans").isNotNull().alias("has_person"), F.coalesce("n_spans", F.lit(0)).alias("n_spans"), "active_start_s", "active_end_s", F.coalesce("active_s", F.lit(0.0)).alias("active_s"))


def assign_label(candidates: DataFrame, events: DataFrame, ratio: float = 0.5, values: list[str] | None = None) -> DataFrame:
    """Best-overlapping event per candidate, overlap as a share of the candidate; negative below ratio. Ties: (t_start, event_id). values: more columns of that event."""
    values = values or []
    pairs = overlap_join(candidates.select("candidate_id", "clip_id", "raw_start_s", "raw_end_s"), events.select("clip_id", "event_id", "type", "t_start", "t_end", *values), ["clip_id"], "raw_start_s", "raw_end_s", "t_start", "t_end")
    share = overlap_seconds(F.col("raw_start_s"), F.col("raw_end_s"), F.col("t_start"), F.col("t_end")) / (F.col("raw_end_s") - F.col("raw_start_s"))
    best = pairs.withColumn("ratio", share).groupBy("candidate_id").agg(F.max("ratio").alias("ratio"), F.min_by(F.struct("event_id", "type", *values), F.struct(-F.col("ratio"), "t_start", "event_id", *values)).alias("best"))
    ok = F.col("ratio") >= ratio
    out = candidates.select("candidate_id").join(best, "candidate_id", "left")
    return out.select("candidate_id", F.when(ok, F.col("best.type")).otherwise("negative").alias("label"), *[F.when(ok, F.col(f"best.{c}")).alias(c) for c in ("event_id", *values)])


def proposal_recall(events: DataFrame, candidates: DataFrame) -> DataFrame:
    """Per event: the first candidate, in canonical order, whose padded window it touches; raw or padded coverage."""
    c = candidates.select("clip_id", "candidate_id", "raw_start_s", "raw_end_s", "window_start_s", "window_end_s")
    pairs = overlap_join(events.select("clip_id", "event_id", "t_start", "t_end"), c, ["clip_id"], "t_start", "t_end", "window_start_s", "window_end_s", closed=True)
    raw = overlaps(F.col("t_start"), F.col("t_end"), F.col("raw_start_s"), F.col("raw_end_s"), closed=True)
    first = pairs.withColumn("raw", raw).groupBy("event_id").agg(F.min_by(F.struct("candidate_id", "raw"), F.struct("window_start_s", "window_end_s", "candidate_id")).alias("c"))
    out = events.select("event_id").join(first, "event_id", "left")
    return out.select("event_id", F.col("c").isNotNull().alias("covered"), F.coalesce(F.col("c.raw"), F.lit(False)).alias("raw_covered"), F.col("c.candidate_id").alias("candidate_id"))


def proposal_matches(events: DataFrame, candidates: DataFrame, actors: bool = False, regions: bool = False) -> DataFrame:
    """(event_id, covered, method, candidate_id, actor_match, region_match): proposal_recall() with candidates held to the event's actor_id and region_id, where it has one.

    The first candidate in canonical order that fits and touches the event covers it, by its raw interval or else the padded one. Without one, actor_match says whether the clip's last candidate had the actor
    (false in a clip without any), and region_match whether the last with the actor had the region (null if none had). Both are null where they are not asked for.
    """
    canon = F.struct("window_start_s", "window_end_s", "candidate_id")
    c = candidates.select("clip_id", "candidate_id", F.col("actor_id").alias("__actor"), F.col("region_id").alias("__region"), "raw_start_s", "raw_end_s", "window_start_s", "window_end_s")
    lo, hi = F.least("raw_start_s", "window_start_s"), F.greatest("raw_end_s", "window_end_s")
    e = events.select("clip_id", "event_id", "actor_id", "region_id", "t_start", "t_end")
    pairs = overlap_join(e, c.withColumns({"__lo": lo, "__hi": hi}), ["clip_id"], "t_start", "t_end", "__lo", "__hi", closed=True)
    touch = {n: overlaps(F.col("t_start"), F.col("t_end"), F.col(f"{p}_start_s"), F.col(f"{p}_end_s"), closed=True) for n, p in (("raw", "raw"), ("padded", "window"))}
    fits = F.lit(True)
    for on, mine, its in ((actors, "actor_id", "__actor"), (regions, "region_id", "__region")):
        if on:
            fits &= F.col(mine).isNull() | F.coalesce(F.col(its) == F.col(mine), F.lit(False))
    method = F.when(touch["raw"], "raw").when(touch["padded"], "padded")
    first = pairs.withColumn("method", method).filter(fits & F.col("method").isNotNull()).groupBy("event_id").agg(F.min_by(F.struct("candidate_id", "method"), canon).alias("c"))
    # what the last candidate of the clip, and the last one with the event's actor, would have said
    last = c.groupBy("clip_id").agg(F.max_by(F.struct("__actor", "__region"), canon).alias("any"))
    own = c.groupBy("clip_id", F.col("__actor").alias("actor_id")).agg(F.max_by(F.struct("__region"), canon).alias("own"))
    out = e.join(first, "event_id", "left").join(last, "clip_id", "left").join(own, ["clip_id", "actor_id"], "left")
    hit, same = F.col("c").isNotNull(), lambda a, b: F.coalesce(a == b, F.lit(False))
    whose = F.when(F.col("actor_id").isNull() | F.lit(not actors), F.col("any.__region")).otherwise(F.col("own.__region"))
    seen = F.when(F.col("actor_id").isNull() | F.lit(not actors), F.col("any").isNotNull()).otherwise(F.col("own").isNotNull())
    actor = F.when(hit, True).otherwise(F.col("any").isNotNull() & (F.col("actor_id").isNull() | same(F.col("any.__actor"), F.col("actor_id"))))
    region = F.when(hit, True).when(seen, F.col("region_id").isNull() | same(whose, F.col("region_id")))
    none = F.lit(None).cast("boolean")
    return out.select("event_id", hit.alias("covered"), F.col("c.method").alias("method"), F.col("c.candidate_id").alias("candidate_id"), (actor if actors else none).alias("actor_match"), (region if regions else none).alias("region_match"))


def frames_in_ranges(frames: DataFrame, ranges: DataFrame, frame: str = "frame") -> DataFrame:
    """Rows whose frame number lies in a half-open range (clip_id, start_frame, end_frame) of their clip."""
    closed = ranges.filter("start_frame < end_frame").select("clip_id", F.col("start_frame").alias("__first"), (F.col("end_frame") - 1).alias("__last"))
    return overlap_filter(frames, closed, "clip_id", frame, frame, "__first", "__last", keep=True, closed=True, bucket=1000.0)


def nearest_observation(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, tolerance: float, values: list[str]) -> DataFrame:
    """Two-sided as-of join within tolerance; ties go to the earliest observation.

    Cells of width tolerance are an extra equality key: a partner lies in the same or a neighbouring cell. What lies in and next to a cell is one row,
    so that a left row meets one row, is shuffled once and never grouped; that row holds the observations of one key in three tolerances.
    """
    # any bound on the distance lets the right side be repeated three times instead of comparing all pairs of a clip
    near = right.select(F.col(key), F.struct(F.col(right_time).alias("t"), F.struct(*values).alias("v")).alias("__p"), F.explode(F.array(*[F.floor(F.col(right_time) / tolerance) + d for d in (-1, 0, 1)])).alias("__cell"))
    near = near.groupBy(key, "__cell").agg(F.collect_list("__p").alias("__near"))
    gap = lambda p: F.abs(p["t"] - F.col(left_time))
    within = F.transform(F.filter("__near", lambda p: gap(p) <= tolerance), lambda p: F.struct(gap(p).alias("gap"), p["t"].alias("t"), p["v"].alias("v")))
    rows = left.withColumn("__cell", F.floor(F.col(left_time) / tolerance)).hint("merge").join(near.hint("merge"), [key, "__cell"], "left")
    # exploded, the nearest one is computed once a row: as a plain column it would be repeated in a filter and in each column taken from it
    rows = rows.withColumn("__b", F.explode(F.array(F.array_min(within))))
    return rows.select(*left.columns, F.col("__b.t").alias("observed_at"), *[F.col(f"__b.v.{v}").alias(v) for v in values])


def match_events_to_candidate(candidates: DataFrame, events: DataFrame, ratio: float = 0.1) -> DataFrame:
    """(candidate_id, event_ids, n_events): events whose own length overlaps the candidate by ratio or more, the best first (ties by id)."""
    pairs = overlap_join(candidates.select("candidate_id", "clip_id", "raw_start_s", "raw_end_s"), events.select("clip_id", "event_id", "t_start", "t_end"), ["clip_id"], "raw_start_s", "raw_end_s", "t_start", "t_end")
    share = overlap_seconds(F.col("raw_start_s"), F.col("raw_end_s"), F.col("t_start"), F.col("t_end")) / (F.col("t_end") - F.col("t_start"))
    pairs = pairs.withColumn("r", share).filter(F.col("r") >= ratio)
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("r")).alias("r"), "event_id")))
    return pairs.groupBy("candidate_id").agg(F.transform(ranked, lambda x: x["event_id"]).alias("event_ids"), F.count("*").alias("n_events"))
