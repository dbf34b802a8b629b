"""Lookups, selections and reports around candidates, clips and runs: equality joins and single aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.operators.intervals import match_events_to_candidate

VIDEO = ("mp4", "mov", "avi", "mkv")


def filter_media(listing: DataFrame, excluded: tuple[str, ...] = (), min_size: int = 0, extensions: tuple[str, ...] = VIDEO) -> DataFrame:
    """Objects (key, size) with a video's extension, outside the excluded prefixes, of min_size bytes or more."""
    kept = F.lower(F.regexp_extract("key", r"\.([^./]+)$", 1)).isin(*extensions) & (F.col("size") >= min_size)
    for prefix in excluded:
        kept &= ~F.col("key").startswith(prefix)
    return listing.filter(kept)


def inventory(objects: DataFrame, prefix: str = "") -> DataFrame:
    """Listed objects without directory marks; keys become relative to prefix."""
    return objects.filter(~F.col("key").endswith("/")).withColumn("key", F.when(F.col("key").startswith(prefix), F.substring("key", len(prefix) + 1, 1 << 30)).otherwise(F.col("key")))


def normal_clip_id(c: Column) -> Column:
    """Without a leading clip_, folders joined to the stem by an underscore, no extension."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"\.[^./]+$", ""), "/", "_"), "^clip_", "")


def media_url(raw: Column, mode: Column, bucket: str, folder: str) -> Column:
    """s3_key: as it is; s3_storage: with bucket; local: file name in folder; presigned: as it is if http(s), else null."""
    s3 = F.when(raw.startswith("s3://"), raw).otherwise(F.concat(F.lit(f"s3://{bucket}/"), raw))
    local = F.concat(F.lit(folder.rstrip("/") + "/"), F.element_at(F.split(raw, "/"), -1))
    return F.when(mode == "s3_storage", s3).when(mode == "local", local).when(mode == "presigned", F.when(raw.rlike("^https?://"), raw)).otherwise(raw)


def select_scope(rows: DataFrame, clips: DataFrame | None = None, splits: tuple[str, ...] = (), split: str = "split") -> DataFrame:
    """Rows of the given splits whose clip the table of clips has."""
    if splits:
        rows = rows.filter(F.col(split).isin(*splits))
    return rows if clips is None else rows.join(clips.select("clip_id").distinct(), "clip_id", "left_semi").select(*rows.columns)


def resolve_inputs(candidates: DataFrame, videos: DataFrame, poses: DataFrame, regions: DataFrame) -> DataFrame:
    """(candidate_id, skip_reason): the first of identity, video, poses, region that is missing; null where all are there."""
    there = lambda df, key, name: df.select(key).distinct().withColumn(name, F.lit(True))
    rows = candidates.join(there(videos, "clip_id", "video"), "clip_id", "left").join(there(poses, "clip_id", "pose"), "clip_id", "left").join(there(regions, "region_id", "region"), "region_id", "left")
    empty = [F.coalesce(F.col(c), F.lit("")) == "" for c in ("actor_id", "hand_side", "region_id")]
    reason = F.when(empty[0] | empty[1] | empty[2], "missing_identity_fields").when(F.col("video").isNull(), "missing_source_video").when(F.col("pose").isNull(), "missing_pose_observations").when(F.col("region").isNull(), "missing_shelf_region")
    return rows.select("candidate_id", reason.alias("skip_reason"))


def skip_counts(resolved: DataFrame) -> DataFrame:
    return resolved.groupBy(F.coalesce("skip_reason", F.lit("processed")).alias("outcome")).agg(F.count("*").alias("n"))


def enrich_candidates(candidates: DataFrame, records: DataFrame, order: str, fields: tuple[str, ...] = ("actor_id", "hand_side", "region_id")) -> DataFrame:
    """Blank fields are filled from the candidate's first record, in the order of a column."""
    first = records.filter("coalesce(candidate_id, '') <> ''").groupBy("candidate_id").agg(F.min_by(F.struct(*fields), order).alias("__r"))
    filled = {f: F.coalesce(F.nullif(F.col(f), F.lit("")), F.nullif(F.col(f"__r.{f}"), F.lit("")), F.col(f)) for f in fields}
    return candidates.join(first, "candidate_id", "left").withColumns(filled).select(*candidates.columns)


def resolve_examples(reviews: DataFrame, metadata: DataFrame, events: DataFrame) -> DataFrame:
    """(candidate_id, outcome): positive with events, negative without, excluded where the review is unfinished or metadata is missing."""
    n = events.groupBy("candidate_id").agg(F.count("*").alias("n_events"))
    rows = reviews.join(metadata.select("candidate_id", F.lit(True).alias("known")), "candidate_id", "left").join(n, "candidate_id", "left")
    outcome = F.when(F.col("known").isNull(), "excluded").when(F.col("review_status") != "complete", "excluded").when(F.col("n_events") > 0, "positive").otherwise("negative")
    return rows.select("candidate_id", outcome.alias("outcome"), F.coalesce("n_events", F.lit(0)).alias("n_events"))


def reviewed_examples(reviews: DataFrame, metadata: DataFrame, reviewed: DataFrame, events: DataFrame, ratio: float = 0.1) -> DataFrame:
    """(candidate_id, clip_id, outcome, label, event_ids): what each review (candidate_id, clip_id, reviewed) says of its candidate.

    excluded_unreviewed, or excluded_no_match without metadata (candidate_id, source_start_s, source_end_s) or without a reviewed file (candidate_id, labels array); else negative without
    labels, or positive with the first label, and the clip's events that overlap the candidate by ratio of their own length, the best first.
    """
    rows = reviews.join(metadata.select("candidate_id", "source_start_s", "source_end_s"), "candidate_id", "left").join(reviewed.select("candidate_id", "labels"), "candidate_id", "left")
    first = F.get("labels", F.lit(0))
    outcome = F.when(~F.coalesce("reviewed", F.lit(False)), "excluded_unreviewed").when(F.col("source_start_s").isNull() | F.col("labels").isNull(), "excluded_no_match").when(first.isNull(), "negative").otherwise("positive")
    rows = rows.withColumn("outcome", outcome)
    spans = rows.filter("outcome = 'positive'").select("candidate_id", "clip_id", F.col("source_start_s").alias("raw_start_s"), F.col("source_end_s").alias("raw_end_s"))
    met = match_events_to_candidate(spans, events, ratio).select("candidate_id", "event_ids")
    out = rows.join(met, "candidate_id", "left")
    label = F.when(F.col("outcome") == "positive", first).when(F.col("outcome") == "negative", "negative")
    return out.select("candidate_id", "clip_id", "outcome", label.alias("label"), F.coalesce("event_ids", F.array().cast("array<string>")).alias("event_ids"))


def update_clips(clips: DataFrame, updates: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """clips with the columns of matching updates; clips that only updates has become rows with nothing else."""
    u = updates.select("clip_id", F.lit(True).alias("__new"), *[F.col(c).alias(f"__{c}") for c in columns])
    both = clips.join(u, "clip_id", "full_outer")
    return both.select(*[F.when(F.col("__new"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in clips.columns])


def check_media(tasks: DataFrame, listing: DataFrame, mode: str) -> DataFrame:
    """(task_id, problem) of references of the wrong form for mode, or that the listing lacks."""
    form = {"s3_storage": F.col("video").startswith("s3://"), "presigned": F.col("video").rlike("^https?://")}.get(mode, ~F.col("video").rlike("^[a-z0-9]+://"))
    found = tasks.join(listing.select(F.col("key").alias("video"), F.lit(True).alias("there")), "video", "left")
    problem = F.when(F.coalesce(F.col("video"), F.lit("")) == "", "missing").when(~form, "wrong form").when(F.col("there").isNull(), "not found")
    return found.withColumn("problem", problem).filter("problem is not null").select("task_id", "problem")


def compare_runs(a: DataFrame, b: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """Per clip of either run: the fields of both, and whether any differs."""
    x = a.select("clip_id", *[F.col(f).alias(f"{f}_a") for f in fields])
    both = x.join(b.select("clip_id", *[F.col(f).alias(f"{f}_b") for f in fields]), "clip_id", "full_outer")
    changed = F.lit(False)
    for f in fields:
        changed |= ~F.col(f"{f}_a").eqNullSafe(F.col(f"{f}_b"))
    return both.withColumn("changed", changed)


def round_trip(original: DataFrame, exported: DataFrame, keys: list[str], tolerance: float) -> DataFrame:
    """(keys..., same): events of both sides, paired in the order of their start, have equal types and times within tolerance."""
    by = Window.partitionBy(*keys).orderBy("t_start", "t_end", "type")
    side = lambda df, p: df.select(*keys, F.row_number().over(by).alias("__n"), *[F.col(c).alias(f"{p}_{c}") for c in ("type", "t_start", "t_end")])
    both = side(original, "a").join(side(exported, "b"), [*keys, "__n"], "full_outer")
    close = lambda c: F.abs(F.col(f"a_{c}") - F.col(f"b_{c}")) <= tolerance
    return both.groupBy(*keys).agg(F.bool_and(F.coalesce((F.col("a_type") == F.col("b_type")) & close("t_start") & close("t_end"), F.lit(False))).alias("same"))


def selected_in_training(selected: DataFrame, records: DataFrame) -> DataFrame:
    """Clips that are selected for evaluation and in a training split."""
    return selected.select("clip_id").distinct().join(records.filter("split = 'train'").select("clip_id"), "clip_id", "left_semi")


def split_overlap(records: DataFrame) -> DataFrame:
    """(split_a, split_b, n): how many clips each two splits share."""
    s = records.select("clip_id", "split").distinct()
    pairs = s.withColumnRenamed("split", "split_a").join(s.withColumnRenamed("split", "split_b"), "clip_id").filter("split_a < split_b")
    return pairs.groupBy("split_a", "split_b").agg(F.count("*").alias("n"))


def union_predictions(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def next_batch(available: DataFrame, existing: DataFrame, key: str, offset: int, count: int) -> DataFrame:
    """The next count keys, in order, that don't exist yet."""
    return available.join(existing.select(key), key, "left_anti").select(key).orderBy(key).offset(offset).limit(count)


def assign_reviewers(tasks: DataFrame, key: str, annotators: list[str], overlap: int) -> DataFrame:
    """(key, annotator): the first `overlap` keys go to all annotators, the rest in turn to one each. Ordered in ranges of keys, not in one task."""
    rows = numbered(tasks.select(key).distinct(), key)
    one = F.element_at(F.array(*map(F.lit, annotators)), ((F.col("n") - overlap) % len(annotators) + 1).cast("int"))
    return rows.select(key, F.explode(F.when(F.col("n") < overlap, F.array(*map(F.lit, annotators))).otherwise(F.array(one))).alias("annotator"))


def numbered(rows: DataFrame, key: str, prefix: int = 9) -> DataFrame:
    """rows with n, their place from 0 in the order of a string key: places inside a prefix bucket plus the sizes of earlier buckets."""
    rows = rows.withColumn("__b", F.substring(key, 1, prefix))
    sizes = rows.groupBy("__b").agg(F.count("*").alias("__c"))
    earlier = sizes.select("__b", F.coalesce(F.sum("__c").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    inner = F.row_number().over(Window.partitionBy("__b").orderBy(key)) - 1
    # both sides grow with the input; sizes estimated from files know nothing of exploded rows, and a side taken for a small one would go through the driver
    return rows.hint("merge").join(earlier.hint("merge"), "__b").withColumn("n", inner + F.col("__before")).drop("__b", "__before")


def key_ranges(rows: DataFrame, key: str, each: int = 1 << 17) -> Column:
    """The range, from 0, that a string key lies in: ranges follow the keys' order and hold about `each` rows, 1,024 ranges at most; nulls are in the last.

    Limits are taken from a hashed part of the keys, so that ranges differ a little in size; which order the ranges give does not depend on them.
    """
    n = rows.count()
    depth = min(10, max(0, -(-n // each) - 1).bit_length())
    if not depth:
        return F.lit(0)
    part = rows.select(key).filter(F.pmod(F.xxhash64(key), F.lit(max(1, n >> (depth + 4)))) == 0).distinct()
    keys = sorted((r[0] for r in part.collect() if r[0] is not None), key=str.encode)
    limits = [keys[len(keys) * i >> depth] for i in range(1, 1 << depth)] if keys else [""] * ((1 << depth) - 1)
    # a binary search: limits in the order of a heap, one step a level
    tree = [limits[((2 * (i - (1 << (d := (i + 1).bit_length() - 1)) + 1) + 1) << (depth - 1 - d)) - 1] for i in range(len(limits))]
    found = F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.lit(0), lambda at, _: at * 2 + 1 + (F.col(key) >= F.get(F.array(*map(F.lit, tree)), at)).cast("int"))
    last = (1 << depth) - 1
    return F.coalesce(found - last, F.lit(last))


def pilot_select(rows: DataFrame, key: str, strata: list[str], limit: int, seed: int = 42) -> DataFrame:
    """(key, stratum): `limit` keys, stratified by the first field that every row has; each stratum gets its share (at least 1), the rest is filled in hash order."""
    filled = rows.agg(*[F.min((F.coalesce(F.col(f).cast("string"), F.lit("")) != "").cast("int")).alias(f) for f in strata]).first()
    field = next((f for f in strata if filled[f]), None)
    rows = rows.select(key, (F.col(field).cast("string") if field else F.lit("all")).alias("stratum"))
    draw = F.xxhash64(F.col(key), F.lit(seed))
    size = F.count("*").over(Window.partitionBy("stratum"))
    ranked = rows.withColumns({"__r": F.row_number().over(Window.partitionBy("stratum").orderBy(draw, key)), "__size": size, "__draw": draw})
    n = rows.count()
    quota = F.greatest(F.lit(1), F.floor(F.col("__size") * limit / max(1, n)))
    return ranked.withColumn("__late", F.col("__r") > quota).orderBy("__late", "__draw", key).limit(limit).select(key, "stratum")


def clip_metadata(candidates: DataFrame) -> DataFrame:
    """Per clip: first positive start, last positive end, and a length of one second more where none is known."""
    s, e = F.min(F.when(F.col("source_start_s") > 0, F.col("source_start_s"))), F.max(F.when(F.col("source_end_s") > 0, F.col("source_end_s")))
    both = candidates.groupBy("clip_id").agg(s.alias("s"), e.alias("e"))
    ok = F.col("s").isNotNull() & F.col("e").isNotNull()
    return both.select("clip_id", F.round(F.when(ok, F.col("s")), 3).alias("active_start_s"), F.round(F.when(ok, F.col("e")), 3).alias("active_end_s"), F.coalesce(F.round(F.col("e") + 1.0, 3), F.lit(0.0)).alias("duration_s"))


def registry_summary(clips: DataFrame) -> DataFrame:
    return clips.agg(F.count("*").alias("indexed_count"), F.count_if(~F.col("decode_ok")).alias("failures"), F.count_if(F.col("duplicate_of").isNotNull()).alias("duplicate_candidates"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("total_source_bytes"))


def truth_summary(events: DataFrame) -> DataFrame:
    """Counts of events by type, confidence and difficulty, and of clips, as (measure, n)."""
    names = F.array(F.lit("events"), F.concat(F.lit("type="), "type"), F.concat(F.lit("confidence="), "confidence"), F.when(F.col("hard_case"), "hard").otherwise("easy"))
    counts = events.select(F.explode(names).alias("measure")).groupBy("measure").agg(F.count("*").alias("n"))
    return counts.unionByName(events.agg(F.count_distinct("clip_id").alias("n")).select(F.lit("clips").alias("measure"), "n"))


def inference_summary(preds: DataFrame) -> DataFrame:
    """One row: counts by type, mean confidence, and how many are low (< 0.4), medium (< 0.7) and high."""
    s = F.col("score")
    return preds.agg(F.count("*").alias("n"), F.count_if(F.col("type") == "pickup").alias("pickup"), F.count_if(F.col("type") == "putdown").alias("putdown"), F.avg("score").alias("mean_confidence"), F.count_if(s < 0.4).alias("low"), F.count_if((s >= 0.4) & (s < 0.7)).alias("medium"), F.count_if(s >= 0.7).alias("high"))


def run_report(sources: DataFrame, shown: int = 20) -> DataFrame:
    """One row of counts over (source, status, n_candidates), with the first `shown` failed sources."""
    failed = F.slice(F.array_sort(F.collect_set(F.when((F.col("status") == "failed") & F.col("__show"), F.col("source")))), 1, shown)
    few = sources.filter("status = 'failed'").select("source").orderBy("source").limit(shown).withColumn("__show", F.lit(True))
    rows = sources.join(F.broadcast(few), "source", "left")
    return rows.agg(F.count("*").alias("requested"), F.count_if(F.col("status") != "skipped").alias("selected"), *[F.count_if(F.col("status") == x).alias(x) for x in ("completed", "failed", "skipped")], F.coalesce(F.sum("n_candidates"), F.lit(0)).alias("total_candidates"), F.array_join(failed, ",").alias("failed_sources"))


def failure_categories(gallery: DataFrame, n_gt: DataFrame, n_pred: DataFrame) -> DataFrame:
    """(category, n) of a failure gallery (status fp, fn or type_confusion); one row of its own where a side is empty."""
    sizes = n_gt.agg(F.count("*").alias("g")).crossJoin(n_pred.agg(F.count("*").alias("p")))  # two single rows
    name = F.when(F.col("status") == "fp", "false_positive").when(F.col("status") == "fn", "false_negative").otherwise("type_confusion")
    counts = gallery.groupBy(name.alias("category")).agg(F.count("*").alias("n")).crossJoin(F.broadcast(sizes)).filter("g > 0 and p > 0").select("category", "n")
    one = sizes.filter("(g = 0) <> (p = 0)").select(F.when(F.col("p") == 0, "no_predictions").otherwise("no_ground_truth").alias("category"), F.greatest("g", "p").alias("n"))
    return counts.unionByName(one)


def retry_counts(attempts: DataFrame, most: int = 3) -> DataFrame:
    """(file_name, failures, skip): keys that failed `most` times or more are skipped from then on."""
    return attempts.groupBy("file_name").agg(F.count_if(F.col("status") == "failed").alias("failures")).withColumn("skip", F.col("failures") >= most)
