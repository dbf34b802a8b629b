"""Data-quality rules: each check returns (source, field, message) rows, or splits a table into clean rows and errors.

A rule is a column that is true where a row breaks it; a null condition counts as kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TYPES = ("pickup", "putdown")
CONFIDENCES = ("high", "med", "low")
SPLITS = ("train", "val", "test")


def blank(c: str) -> Column:
    return F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == ""


def violations(df: DataFrame, source: str, rules: dict[tuple[str, str], Column]) -> DataFrame:
    """(source, field, message) for each broken rule of {(field, message): condition}, from one scan."""
    # an outer explode: for an inner one Spark infers a filter on the array's size and evaluates all rules twice
    found = [F.when(F.coalesce(broken, F.lit(False)), F.struct(F.lit(f).alias("field"), F.lit(m).alias("message"))) for (f, m), broken in rules.items()]
    return df.select(F.col(source).cast("string").alias("source"), F.explode_outer(F.array_compact(F.array(*found))).alias("v")).filter("v is not null").select("source", "v.field", "v.message")


def repeated(df: DataFrame, key: str) -> DataFrame:
    """One violation per key that more than one row has."""
    return df.groupBy(key).count().filter("count > 1").select(F.col(key).cast("string").alias("source"), F.lit(key).alias("field"), F.lit("is not unique").alias("message"))


def unknown(df: DataFrame, key: str, source: str, known: DataFrame) -> DataFrame:
    """Rows whose key the known table lacks."""
    return df.join(known.select(key), key, "left_anti").select(F.col(source).cast("string").alias("source"), F.lit(key).alias("field"), F.lit("is unknown").alias("message"))


def check_clips(clips: DataFrame) -> DataFrame:
    a, b = F.col("active_start_s"), F.col("active_end_s")
    rules = {("clip_id", "is empty"): blank("clip_id"), ("s3_key", "is empty"): blank("s3_key"), ("split", "is not a split"): ~F.coalesce(F.col("split"), F.lit("")).isin(*SPLITS)}
    rules |= {(c, "is not positive"): F.col(c).isNull() | (F.col(c) <= 0) for c in ("duration_s", "fps", "width", "height")}
    rules |= {("n_person_tracks", "is negative"): F.col("n_person_tracks") < 0, ("active_start_s", "only one end is set"): a.isNull() != b.isNull()}
    rules |= {("active_start_s", "is out of range"): (a < 0) | (a >= b) | (b > F.col("duration_s"))}
    return violations(clips, "clip_id", rules).unionByName(repeated(clips, "clip_id"))


def _on_clip(rows: DataFrame, key: str, clips: DataFrame, rules: dict) -> DataFrame:
    s, e = F.col("t_start"), F.col("t_end")
    rules = {("type", "is not an event type"): ~F.coalesce(F.col("type"), F.lit("")).isin(*TYPES), ("t_start", "is negative"): s < 0, ("t_end", "is not after t_start"): s >= e, ("t_end", "is after the clip"): e > F.col("duration_s")} | rules
    with_length = rows.join(clips.select("clip_id", "duration_s"), "clip_id", "left")
    return violations(with_length, key, rules).unionByName(repeated(rows, key)).unionByName(unknown(rows, "clip_id", key, clips))


def check_events(events: DataFrame, clips: DataFrame) -> DataFrame:
    return _on_clip(events, "event_id", clips, {("confidence", "is not a level"): ~F.coalesce(F.col("confidence"), F.lit("")).isin(*CONFIDENCES), ("annotator", "is empty"): blank("annotator")})


def check_predictions(preds: DataFrame, clips: DataFrame) -> DataFrame:
    p = F.col("score")
    return _on_clip(preds, "pred_id", clips, {("score", "is not in 0..1"): p.isNull() | F.isnan(p) | (p < 0) | (p > 1), ("model", "is empty"): blank("model")})


def normal_confidence(c: Column) -> Column:
    """high, med or low; medium is med, and so is what is none of them."""
    x = F.lower(F.trim(c))
    return F.when(x == "medium", "med").when(x.isin(*CONFIDENCES), x).otherwise("med")


def event_id(clip: Column, label: Column, start: Column, item: Column) -> Column:
    return F.concat(F.lit("evt_"), F.substring(F.md5(F.concat_ws(":", clip, label, F.format_string("%.3f", start), item.cast("string"))), 1, 12))


def reviewed_events(rows: DataFrame, clips: DataFrame, slack: float = 0.1) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(events, errors, audit) of candidate events, one per row: candidate_id, pos, clip_id, review_status, vlm_status, source_start_s, label, start_s, end_s, item_count, ...

    Only complete reviews with a successful model result count. Times become source times, every item its own event; of equal
    event ids the first (candidate_id, pos, item) stays and each later one has an audit row. The end may lie slack beyond the clip.
    """
    rows = rows.filter("vlm_status = 'success' and review_status = 'complete'").join(clips.select("clip_id", "duration_s"), "clip_id", "left")
    rows = rows.withColumns({"type": F.lower(F.trim(F.coalesce("label", F.lit("")))), "t_start": F.round(F.col("source_start_s") + F.col("start_s"), 3), "t_end": F.round(F.col("source_start_s") + F.col("end_s"), 3)})
    known = F.col("duration_s").isNotNull()
    error = F.when(~F.col("type").isin(*TYPES), "label").when(F.col("t_start") >= F.col("t_end"), "interval").when(known & (F.col("t_start") < 0), "negative start").when(known & (F.col("t_end") > F.col("duration_s") + slack), "beyond the clip")
    rows = rows.withColumn("error", error)
    errors = rows.filter("error is not null").select(F.col("candidate_id").alias("source"), "pos", F.col("error").alias("message"))
    good = rows.filter("error is null").withColumn("item", F.explode(F.sequence(F.lit(0), F.greatest(F.coalesce("item_count", F.lit(1)), F.lit(1)).cast("int") - 1)))
    good = good.withColumns({"event_id": event_id(F.col("clip_id"), F.col("type"), F.col("t_start"), F.col("item")), "confidence": normal_confidence(F.col("confidence"))})
    by = Window.partitionBy("event_id").orderBy("candidate_id", "pos", "item")
    ranked = good.withColumns({"n": F.row_number().over(by), "kept_candidate": F.first("candidate_id").over(by)})
    events = ranked.filter("n = 1").select("event_id", "clip_id", "type", "t_start", "t_end", "hard_case", "confidence", "notes")
    audit = ranked.filter("n > 1").select("event_id", "kept_candidate", F.col("candidate_id").alias("skipped_candidate"), "clip_id", "t_start", "t_end", "type")
    return events, errors, audit


def check_final(events: DataFrame, clips: DataFrame, slack: float = 0.1) -> DataFrame:
    """Repeated ids, intervals, ends beyond the clip, clips that are missing."""
    late = (F.col("duration_s") > 0) & (F.col("t_end") > F.col("duration_s") + slack)
    rows = events.join(clips.select("clip_id", "duration_s"), "clip_id", "left")
    found = violations(rows, "event_id", {("t_end", "is not after t_start"): F.col("t_start") >= F.col("t_end"), ("t_end", "is after the clip"): late})
    lost = events.select("clip_id").distinct().join(clips.select("clip_id"), "clip_id", "left_anti").select(F.col("clip_id").alias("source"), F.lit("clip_id").alias("field"), F.lit("is unknown").alias("message"))
    return found.unionByName(repeated(events, "event_id")).unionByName(lost)


def check_order(events: DataFrame, position: str) -> DataFrame:
    """(clip_id, position) of rows that come before their predecessor in (t_start, type, event_id), by clip."""
    key = F.struct("t_start", "type", "event_id")
    before = F.lag(key).over(Window.partitionBy("clip_id").orderBy(position))
    return events.withColumn("__bad", before > key).filter("__bad").select("clip_id", position)


def check_global_order(events: DataFrame, position: str) -> DataFrame:
    """(position, event_id), at most one row: the first of all rows that comes before its predecessor in (clip_id, t_start, type, event_id).

    position numbers the rows without gaps; rows meet their predecessor by it, so that no task orders them all.
    """
    key = F.struct("clip_id", "t_start", "type", "event_id")
    rows = events.select(F.col(position).alias("position"), key.alias("key"))
    pairs = rows.join(rows.select((F.col("position") + 1).alias("position"), F.col("key").alias("before")), "position").filter("before > key")
    first = pairs.agg(F.min(F.struct("position", F.col("key.event_id").alias("event_id"))).alias("f")).filter("f is not null")
    return first.select("f.position", "f.event_id")


def check_candidate_metadata(rows: DataFrame) -> DataFrame:
    rules = {(c, "is missing or empty"): blank(c) for c in ("candidate_id", "clip_id", "source_start_s", "source_end_s")}
    s, e = (F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in ("source_start_s", "source_end_s"))
    return violations(rows, "candidate_id", rules | {("candidate_video", "is missing or empty"): blank("candidate_video") & blank("candidate_key"), ("source_start_s", "is not before source_end_s"): s >= e})


def check_candidates(rows: DataFrame, clips: DataFrame, slack: float = 1e-6) -> DataFrame:
    """Raw and padded intervals lie in the clip, are not empty, and the padded one holds the raw one."""
    c = {x: F.col(x) for x in ("raw_start_s", "raw_end_s", "window_start_s", "window_end_s")}
    end = F.col("duration_s") + slack
    rules = {}
    for kind in ("raw", "window"):
        s, e = c[f"{kind}_start_s"], c[f"{kind}_end_s"]
        rules |= {(kind, "is out of range"): (s < 0) | (s > e) | (e > end), (kind, "is empty"): s >= e}
    rules |= {("window", "does not hold the raw interval"): (c["window_start_s"] > c["raw_start_s"]) | (c["window_end_s"] < c["raw_end_s"])}
    return violations(rows.join(clips.select("clip_id", "duration_s"), "clip_id", "left"), "candidate_id", rules)


def relative_time_error(start: Column, end: Column, offset: Column, source_start: Column, source_end: Column, slack: float = 0.1) -> Column:
    """The first fault of candidate-relative times, null where there is none."""
    negative = F.when(start < -slack, "negative start")
    return F.coalesce(negative, F.when(end > source_end - source_start + slack, "end beyond the candidate"), F.when(offset + start < source_start - slack, "start before the source"), F.when(offset + end > source_end + slack, "end beyond the source"), F.when(end <= start, "empty"))


def collinear(polygon: Column) -> Column:
    """Whether all points lie on the line through the first two (cross products within 1e-6)."""
    p = lambda i: F.get(polygon, F.lit(i))
    dx, dy = p(1)["x"] - p(0)["x"], p(1)["y"] - p(0)["y"]
    return F.forall(polygon, lambda q: F.abs(dx * (q["y"] - p(0)["y"]) - dy * (q["x"] - p(0)["x"])) <= 1e-6)


def check_regions(regions: DataFrame, width: int, height: int, key: str = "region_id") -> DataFrame:
    """At least three points, all inside the frame, not on one line; ids are unique."""
    outside = F.exists("polygon", lambda q: (q["x"] < 0) | (q["x"] >= width) | (q["y"] < 0) | (q["y"] >= height))
    rules = {("polygon", "has under 3 points"): F.size("polygon") < 3, ("polygon", "leaves the frame"): outside, ("polygon", "has no area"): (F.size("polygon") >= 3) & collinear(F.col("polygon"))}
    return violations(regions, key, rules).unionByName(repeated(regions, key))
