"""Annotation exports: JSON arrays of tasks to regions, to what is wrong with them, and to events and ignore intervals."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.operators.quality import violations
from eventloom.sources.shared import stored

#: Where a text says yes, labels, reasons.
YES = r'(^|[:\[,])\s*(true|"\s*(true|1|yes|confirmed)\s*")\s*([,\]}]|$)'
LABELS = ("pickup", "putdown", "ignore")
REASONS = ("ACTION_OCCLUDED", "ACTION_OUT_OF_FRAME")
REVIEWED = "complete_active_span_reviewed"


def _at(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, path, kind)


def _first(*texts: Column) -> Column:
    """The first text that is neither null nor empty."""
    return F.coalesce(*[F.nullif(t, F.lit("")) for t in texts])


def fields(v: Column, *names: str) -> Column:
    """The fields of an object as variants, in one walk over it; null for anything else."""
    return F.try_variant_get(v, "$", "struct<" + ",".join(f"{n}:variant" for n in names) + ">")


#: What is read of a task, wherever it stands.
CONTEXT = ("clip_id", "fps", "annotator", REVIEWED)


def _context(name: str) -> Column:
    """A field of a task with_context(): metadata, then data, then the task, then the item; the nested task's metadata first."""
    places = ("__task_meta", "__meta", "__data_meta", "__task_data_meta", "__data", "__task_data", "__task", "__item")
    return _first(*[_at(F.col(f"{p}.{name}"), "$") for p in places])


def with_context(rows: DataFrame, item: str) -> DataFrame:
    """rows with the objects in which an item's context may stand, each walked once."""
    inner = lambda *more: (*CONTEXT, *more)
    rows = rows.withColumn("__item", fields(F.col(item), *inner("id", "task", "meta", "data", "annotations")))
    rows = rows.withColumns({"__task": fields(F.col("__item.task"), *inner("id", "meta", "data")), "__data": fields(F.col("__item.data"), *inner("meta")), "__meta": fields(F.col("__item.meta"), *CONTEXT)})
    return rows.withColumns({"__task_data": fields(F.col("__task.data"), *inner("meta")), "__task_meta": fields(F.col("__task.meta"), *CONTEXT), "__data_meta": fields(F.col("__data.meta"), *CONTEXT)}).withColumn("__task_data_meta", fields(F.col("__task_data.meta"), *CONTEXT))


def _yes(v: Column) -> Column:
    """Whether a JSON value is true or says so, at any depth; null is no."""
    return F.coalesce(F.rlike(F.lower(F.to_json(v)), F.lit(YES)), F.lit(False))


def read_export(texts: DataFrame, source: str = "source", text: str = "value") -> tuple[DataFrame, DataFrame]:
    """(tasks, errors) of one JSON array per row: source, item (place, from 0), task_id, clip_id, fps, annotator, reviewed and its annotations, an array of variants, stored once.

    source is unique. A text that is no array of objects gives one error and no task; a task without clip_id or annotations gives an error and, in the first case, a row.
    An empty text in a metadata field counts as missing. fps is 0 where it is missing or no number.
    """
    v = texts.select(F.col(source).cast("string").alias("source"), F.try_parse_json(F.col(text)).alias("__v"))
    listed = v.withColumn("__a", _at(F.col("__v"), "$", "array<variant>"))
    flat = F.forall("__a", lambda x: fields(x, "id").isNotNull())
    read = listed.withColumn("__ok", F.coalesce(flat, F.lit(False))).drop("__v")
    wrong = violations(read, "source", {("export", "is not an array of objects"): ~F.col("__ok")})
    items = read.select("source", F.posexplode_outer(F.when(F.col("__ok"), F.col("__a"))).alias("item", "task")).filter("item is not null")
    task_id = F.coalesce(_first(_at(F.col("__task.id"), "$"), _at(F.col("__item.id"), "$")), F.concat(F.lit("item_"), F.col("item").cast("string")))
    said = F.coalesce(F.rlike(F.lower(F.trim(_context(REVIEWED))), F.lit("^(true|1|yes|confirmed)$")), F.lit(False))
    tasks = with_context(items, "task").select("source", "item", task_id.alias("task_id"), F.coalesce(_context("clip_id"), F.lit("")).alias("clip_id"), F.coalesce(_context("fps").try_cast("double"), F.lit(0.0)).alias("fps"), _context("annotator").alias("annotator"), said.alias("reviewed"), _at(F.col("__item.annotations"), "$", "array<variant>").alias("annotations"))
    tasks = stored(tasks, "tasks")
    annotated = F.col("annotations").isNotNull()
    errors = wrong.unionByName(violations(tasks, "task_id", {("annotations", "is not an array"): ~annotated, ("clip_id", "is empty"): annotated & (F.col("clip_id") == "")}))
    return tasks.filter(annotated), errors


def expand_annotations(tasks: DataFrame) -> DataFrame:
    """One row per temporal region of every annotation that was not cancelled, with the attributes that other results of its region id give.

    An attribute that several results give is the last one's; values inside the region's own result fill the rest. A region without id is its place's own.
    One shuffle, by annotation and region.
    """
    each = tasks.select("source", "item", "task_id", "clip_id", "fps", "annotator", "reviewed", F.posexplode_outer("annotations").alias("place", "__n")).filter("place is not null")
    each = each.withColumn("n", fields(F.col("__n"), "id", "completed_by", "who", "state", "result", "was_cancelled")).withColumn("by", fields(F.col("n.completed_by"), "email", "username", "id"))
    by = F.col("n.completed_by")
    scalar = F.when(~F.coalesce(F.rlike(F.schema_of_variant(by), F.lit("^(OBJECT|ARRAY)")), F.lit(True)), by.try_cast("string"))
    annotator = _first(*[_at(F.col(f"by.{f}"), "$") for f in ("email", "username", "id")], scalar, _at(F.col("n.who"), "$"), F.col("annotator"))
    none = F.expr("cast(array() as array<variant>)")
    said = F.exists(F.coalesce(_at(F.col("n.state"), "$", "array<variant>"), none), lambda s: (_at(s, "$.name") == REVIEWED) & _yes(_at(s, "$.value", "variant")))
    chosen = F.exists(F.coalesce(_at(F.col("n.result"), "$", "array<variant>"), none), lambda r: (_at(r, "$.from_name") == REVIEWED) & reduce(lambda a, k: a | _yes(_at(r, f"$.value.{k}", "variant")), ("choices", "choice", "checkboxes"), _yes(_at(r, "$.value.value", "variant"))))
    kept = each.filter(~F.coalesce(_at(F.col("n.was_cancelled"), "$", "boolean"), F.lit(False)))
    rows = kept.select("source", "item", "task_id", "clip_id", "fps", "place", F.coalesce(_first(_at(F.col("n.id"), "$")), F.lit("unknown_ann")).alias("annotation_id"), F.coalesce(annotator, F.lit("")).alias("annotator"),
                       (F.coalesce(said, F.lit(False)) | F.coalesce(chosen, F.lit(False)) | F.col("reviewed")).alias("confirmed"), F.posexplode_outer(_at(F.col("n.result"), "$", "array<variant>")).alias("pos", "__r")).filter("pos is not null")
    inside = ("choices", "checkboxes", "choice", "text", "number", "item_count", "reason", "timelinelabels", "ranges", "labels", "start", "end", "from_name_start", "to_name_end", "confidence", "hard_case", "review_status", "notes")
    rows = rows.withColumn("r", fields(F.col("__r"), "id", "from_name", "type", "value")).withColumn("v", fields(F.col("r.value"), *inside)).drop("__r")
    pos = F.col("pos")

    def value(path: str, kind: str = "string") -> Column:
        """A path inside a result's value: its first name is a column, the rest is walked."""
        head, rest = re.match(r"(\w+)(.*)", path).groups()
        return F.col(f"v.{head}") if kind == "variant" and not rest else _at(F.col(f"v.{head}"), f"${rest}", kind)

    selected = _first(value("choices[0]"), value("checkboxes[0]"), value("choice"))
    note = F.coalesce(F.array_join(value("text", "array<string>"), "\n"), value("text"))
    own = {"confidence": selected, "hard_case": selected, "item_count": _first(value("number"), value("item_count")), "reason": _first(selected, value("reason")), "review_status": selected, "notes": note}
    names = {f: F.col("__from").isin("ignore_reason", "reason") if f == "reason" else F.col("__from") == f for f in own}
    rows = rows.withColumns({"__from": _at(F.col("r.from_name"), "$"), "region_id": F.coalesce(_first(_at(F.col("r.id"), "$")), F.concat(F.lit("region_"), pos.cast("string")))})
    w = Window.partitionBy("source", "item", "place", "region_id")
    rows = rows.withColumns({f"__{f}": F.max_by(F.when(names[f], c), F.when(names[f] & c.isNotNull(), pos)).over(w) for f, c in own.items()})
    real = (F.lower(_at(F.col("r.type"), "$")) == "timelinelabels") | value("timelinelabels", "variant").isNotNull() | value("ranges", "variant").isNotNull()
    old = value("labels", "variant").isNotNull() & reduce(lambda a, k: a | value(k, "variant").isNotNull(), ("end", "from_name_start", "to_name_end"), value("start", "variant").isNotNull())
    rows = rows.withColumn("timeline", F.coalesce(real, F.lit(False))).filter(F.col("timeline") | F.coalesce(old, F.lit(False)))
    line = F.col("timeline")
    labels = F.when(line, value("timelinelabels", "array<string>")).otherwise(value("labels", "array<string>"))
    frame = lambda path, legacy: F.when(line, value(path)).otherwise(value(legacy)).try_cast("double")
    return rows.select("source", "item", "task_id", "clip_id", "fps", "annotation_id", "annotator", "confirmed", "region_id", "timeline", F.coalesce(F.size(labels), F.lit(-1)).alias("n_labels"), F.get(labels, F.lit(0)).alias("label"), F.when(line, F.coalesce(F.size(value("ranges", "array<variant>")), F.lit(-1))).otherwise(1).alias("n_ranges"),
                       frame("ranges[0].start", "from_name_start").alias("start_frame"), frame("ranges[0].end", "to_name_end").alias("end_frame"), F.when(~line, value("start").try_cast("double")).alias("start_s"), F.when(~line, value("end").try_cast("double")).alias("end_s"),
                       *[F.coalesce(F.col(f"__{f}"), value(f)).alias(f) for f in own])


def check_regions(regions: DataFrame) -> DataFrame:
    """(source, field, message) of regions of expand_annotations; source is the region's id."""
    line, s, e, n = F.col("timeline"), F.col("start_frame"), F.col("end_frame"), F.trim("item_count").try_cast("double")
    framed = line | (s.isNotNull() & e.isNotNull())
    event = F.col("label").isin("pickup", "putdown")
    one = (F.col("n_labels") == 1) & (F.col("n_ranges") == 1)
    bad = lambda f: framed & (f.isNull() | (f != F.floor(f)) | (f < 0))
    level = F.coalesce(F.nullif(F.trim("confidence"), F.lit("")), F.lit("med"))
    rules = {("label", "is not exactly one"): F.col("n_labels") != 1, ("ranges", "is not exactly one"): F.col("n_ranges") != 1, ("label", "is unknown"): (F.col("n_labels") == 1) & ~F.coalesce(F.col("label"), F.lit("")).isin(*LABELS),
             ("start_frame", "is not a whole number"): one & bad(s), ("end_frame", "is not a whole number"): one & bad(e), ("end_frame", "is not after start_frame"): framed & (e <= s), ("fps", "is missing"): framed & (F.col("fps") <= 0),
             ("start_s", "is missing"): ~framed & (F.col("start_s").isNull() | F.col("end_s").isNull()), ("end_s", "is not after start_s"): ~framed & (F.col("end_s") <= F.col("start_s")),
             ("item_count", "is required"): event & F.col("item_count").isNull(), ("item_count", "is not a whole number of 1 or more"): event & F.col("item_count").isNotNull() & (n.isNull() | (n != F.floor(n)) | (n < 1)), ("item_count", "is forbidden"): (F.col("label") == "ignore") & F.col("item_count").isNotNull(),
             ("confidence", "is not a level"): ~level.isin("high", "med", "medium", "low"), ("reason", "is unknown"): (F.col("label") == "ignore") & ~F.coalesce(F.col("reason"), F.lit(REASONS[0])).isin(*REASONS), (REVIEWED, "is not confirmed"): ~F.col("confirmed")}
    return violations(regions, "region_id", rules)


def convert_export(tasks: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(events, ignores, errors): regions without an error become events, one per item, or ignore intervals.

    A region is known by its id within its annotation and task; two of one id in an annotation stand or fall together.
    """
    key = ["source", "item", "annotation_id", "region_id"]
    regions = stored(expand_annotations(tasks).withColumn("__key", F.to_json(F.struct(*key))), "regions")
    found = check_regions(regions.withColumn("region_id", F.col("__key")))
    good = regions.join(found.select(F.col("source").alias("__key")).distinct(), "__key", "left_anti").filter("clip_id <> ''")
    at = lambda f, s: F.coalesce(F.col(f) / F.when(F.col("fps") > 0, F.col("fps")), F.col(s))
    good = good.withColumns({"t_start": at("start_frame", "start_s"), "t_end": at("end_frame", "end_s")})
    sha = lambda *c: F.substring(F.sha2(F.concat_ws(":", *c), 256), 1, 12)
    group = F.concat(F.lit("group_"), sha("clip_id", "region_id"))
    items = good.filter(F.col("label") != "ignore").withColumn("event_group_id", group).withColumn("n", F.explode(F.sequence(F.lit(0), F.trim("item_count").cast("double").cast("int") - 1)))
    level = F.coalesce(F.nullif(F.trim("confidence"), F.lit("")), F.lit("med"))
    events = items.select(F.concat(F.lit("evt_"), F.substring(F.md5(F.concat_ws(":", "clip_id", "label", "event_group_id", F.col("n").cast("string"))), 1, 12)).alias("event_id"), "clip_id", F.col("label").alias("type"), "t_start", "t_end", F.coalesce(F.lower(F.trim("hard_case")) == "true", F.lit(False)).alias("hard_case"),
                          F.nullif("annotator", F.lit("")).alias("annotator"), F.when(level == "medium", "med").otherwise(level).alias("confidence"), "notes", "event_group_id")
    ignore_id = F.concat(F.lit("ign_"), F.substring(F.md5(F.concat_ws(":", "clip_id", F.lit("ignore"), "region_id")), 1, 12))
    ignores = good.filter("label = 'ignore'").select(ignore_id.alias("ignore_id"), "clip_id", "t_start", "t_end", F.coalesce("reason", F.lit(REASONS[0])).alias("reason"), F.nullif("annotator", F.lit("")).alias("annotator"), "notes")
    errors = found.select(F.get_json_object("source", "$.region_id").alias("source"), "field", "message")
    return events, ignores, errors
