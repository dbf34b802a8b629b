"""Model responses: JSON texts, perhaps in a code fence, to events and to what is wrong with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.operators.annotations import fields
from eventloom.operators.quality import violations
from eventloom.sources.shared import stored


def strip_fence(text: Column) -> Column:
    """The text without surrounding blanks and without one code fence."""
    t = F.trim(F.regexp_replace(text, r"^\s+|\s+$", ""))
    inner = F.regexp_replace(F.regexp_replace(t, r"^```[^\n]*\n?", ""), r"(^|\n)[ \t]*```[^\n]*$", "")
    return F.when(F.startswith(t, F.lit("```")), F.regexp_replace(inner, r"^\s+|\s+$", "")).otherwise(t)


def _kind(v: Column) -> Column:
    """The JSON kind of a variant: OBJECT, ARRAY, STRING, BOOLEAN, VOID or a number's type; null for null."""
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


def _whole(v: Column) -> Column:
    """Whole numbers as numbers or texts, fractions cut off, else null; booleans are not numbers."""
    text = F.try_variant_get(v, "$", "string")
    kind = _kind(v)
    return F.when(kind == "BOOLEAN", None).when(kind == "STRING", F.when(F.rlike(text, F.lit(r"^\s*[+-]?\d+\s*$")), F.trim(text).try_cast("bigint"))).otherwise(F.try_variant_get(v, "$", "double").try_cast("bigint"))


def _word(v: Column, default: str) -> Column:
    return F.lower(F.trim(F.coalesce(F.try_variant_get(v, "$", "string"), F.lit(default))))


def model_events(responses: DataFrame, key: str = "response_id", text: str = "content", frames: str = "frame_count") -> tuple[DataFrame, DataFrame]:
    """(events, errors) of (key, text, frames) rows with unique keys; a response with any error gives no event.

    Events: key, item (place in the array, from 0), label, start_frame, end_frame, item_count, confidence, hard_case, notes. Errors: source, field, message.
    Null and blank texts, and texts that are no JSON object with an array of events, are errors; frames null or 0 means that there is no bound.
    """
    v = responses.select(key, frames, F.try_parse_json(strip_fence(F.col(text))).alias("__v"))
    v = v.withColumn("__j", fields(F.col("__v"), "events", "reasoning")).withColumn("__a", F.try_variant_get(F.col("__j.events"), "$", "array<variant>"))
    j, reason = F.col("__j"), F.col("__j.reasoning")
    whole = {("content", "is not JSON"): F.col("__v").isNull(), ("content", "is not an object"): F.col("__v").isNotNull() & j.isNull()}
    whole |= {("events", "is not an array"): j.isNotNull() & F.col("__a").isNull(), ("reasoning", "is not a text"): reason.isNotNull() & (_kind(reason) != "STRING")}
    one = v.select(key, frames, *[c.alias(f"__w{i}") for i, c in enumerate(whole.values())], F.posexplode_outer("__a").alias("item", "__e"))
    one = one.withColumn("e", fields(F.col("__e"), "label", "start_frame", "end_frame", "item_count", "confidence", "hard_case", "notes"))
    given, hard = F.col("e.item_count").isNotNull(), F.col("e.hard_case")
    level = _word(F.col("e.confidence"), "med")
    rows = one.select(
        key, "item", frames, *[f"__w{i}" for i in range(len(whole))], F.col("e").isNotNull().alias("__object"), _word(F.col("e.label"), "").alias("label"), _whole(F.col("e.start_frame")).alias("start_frame"), _whole(F.col("e.end_frame")).alias("end_frame"),
        F.when(given, _whole(F.col("e.item_count"))).otherwise(1).alias("item_count"), F.when(level == "medium", "med").otherwise(level).alias("confidence"),
        F.when(hard.isNull(), False).otherwise(F.when(_kind(hard) == "BOOLEAN", F.try_variant_get(hard, "$", "boolean"))).alias("hard_case"), F.trim(F.coalesce(F.try_variant_get(F.col("e.notes"), "$", "string"), F.lit(""))).alias("notes"),
    )
    # parsed and walked once: what is wrong with a response and its items are plain columns from here on; a response without items has one row, without item
    read = stored(rows.withColumn("__count", F.col("item_count").isNull()), "items")
    checked, rows = read.filter("coalesce(item, 0) = 0"), read.filter("item is not null")
    o, s, t, n = F.col("__object"), F.col("start_frame"), F.col("end_frame"), F.col(frames)
    rules = {("events", "is not an object"): ~o, ("label", "is not an event type"): o & ~F.col("label").isin("pickup", "putdown"), ("start_frame", "is not a whole number"): o & s.isNull(), ("end_frame", "is not a whole number"): o & t.isNull(), ("item_count", "is not a whole number"): o & F.col("__count"),
             ("start_frame", "is negative"): s < 0, ("end_frame", "is before start_frame"): t < s, ("end_frame", "is outside the frames"): (n > 0) & ((s >= n) | (t >= n)), ("item_count", "is under 1"): F.col("item_count") < 1,
             ("confidence", "is not a level"): o & ~F.col("confidence").isin("high", "med", "low"), ("hard_case", "is not a boolean"): o & F.col("hard_case").isNull()}
    errors = violations(checked, key, {k: F.col(f"__w{i}") for i, k in enumerate(whole)}).unionByName(violations(rows, key, rules))
    bad = errors.select(F.col("source").alias(key)).distinct()
    good = rows.withColumn("__key", F.col(key).cast("string")).join(bad.withColumnRenamed(key, "__key"), "__key", "left_anti")
    return good.select(key, "item", "label", "start_frame", "end_frame", "item_count", "confidence", "hard_case", "notes"), errors
