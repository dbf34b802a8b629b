"""Candidate metadata from folders of JSON files."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.sources.shared import stored

#: What is read of a candidate, as text; numbers are typed once a record has passed.
FIELDS = ("candidate_id", "candidate_key", "clip_id", "source_bucket", "source_key", "source_start_s", "source_end_s", "actor_id", "hand_side", "region_id")


class Metadata(NamedTuple):
    """candidates: path, position, FIELDS with typed times, record (JSON). errors: path, position, candidate_id, problem. stats: one row."""

    candidates: DataFrame
    errors: DataFrame
    stats: DataFrame


def _text(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "string")


def _empty(v: Column, path: str) -> Column:
    """Missing, null, '', 0 or false."""
    return F.coalesce(_text(v, path), F.lit("")).isin("", "0", "false", "null")


def parse_candidate_metadata(files: DataFrame) -> Metadata:
    """Metadata of whole JSON files (path, value), in three layouts told apart by the kind of the top value.

    An object with `candidates` is a source: its candidates take clip_id (from source_video_id), source_bucket and source_key from it where they have none of their
    own; each needs candidate_id, candidate_key and times with 0 <= start < end. Any other object is a candidate, an array a list of them (what is no object in it is passed over). Of candidates
    of sources with one id the first by (path, position) stays. Faulty files and records become errors; sources without candidates are counted. A NaN is no time.
    The texts are parsed once, into a stored table.
    """
    parsed = files.select("path", F.try_parse_json("value").alias("v"))
    kind = F.when(F.col("v").isNull(), "malformed").otherwise(F.substring_index(F.schema_of_variant("v"), "<", 1))
    listed = F.try_variant_get("v", "$.candidates", "variant")
    parsed = parsed.withColumns({"kind": kind, "nested": listed})
    nested = F.when(F.col("nested").isNotNull(), F.substring_index(F.schema_of_variant("nested"), "<", 1))
    parsed = parsed.withColumn("nested_kind", nested)
    source = (F.col("kind") == "OBJECT") & F.col("nested").isNotNull()
    items = F.when(source & (F.col("nested_kind") == "ARRAY"), F.try_variant_get("nested", "$", "array<variant>")).when(F.col("kind") == "ARRAY", F.try_variant_get("v", "$", "array<variant>")).when(F.col("kind") == "OBJECT", F.array("v"))
    parsed = parsed.withColumns({"is_source": source, "items": items, "n_items": F.size(items)})
    problem = (
        F.when(F.col("kind") == "malformed", "malformed JSON").when(~F.col("kind").isin("ARRAY", "OBJECT"), "unexpected content").when(source & (F.col("nested_kind") != "ARRAY"), "candidates is no list")
        .when(source & (F.col("n_items") > 0) & _empty(F.col("v"), "$.source_video_id"), "missing source_video_id")
    )
    parsed = parsed.withColumn("problem", problem)
    parent = F.when(F.col("is_source"), F.named_struct(F.lit("id"), _text(F.col("v"), "$.source_video_id"), F.lit("bucket"), F.nullif(_text(F.col("v"), "$.source_bucket"), F.lit("")), F.lit("key"), F.nullif(_text(F.col("v"), "$.source_key"), F.lit(""))))
    none = F.col("is_source") & (F.col("nested_kind") == "ARRAY") & (F.col("n_items") == 0)
    rows = parsed.select("path", "is_source", "problem", none.alias("none"), parent.alias("parent"), F.posexplode_outer(F.when(F.col("problem").isNull(), F.col("items"))).alias("position", "item"))
    whole = F.substring_index(F.schema_of_variant("item"), "<", 1) == "OBJECT"
    rows = rows.withColumns({"object": whole, "record": F.to_json("item")})
    # one pass over a record's text gives all fields
    rows = rows.withColumn("c", F.from_json("record", ", ".join(f"{f} string" for f in FIELDS)))
    rows = rows.withColumn("own_clip", F.try_variant_get("item", "$.clip_id", "variant").isNotNull()).drop("item")
    s, e = (F.col(f"c.source_{x}_s").try_cast("double") for x in ("start", "end"))
    absent = lambda f: F.coalesce(F.col(f"c.{f}"), F.lit("")) == ""
    missing = [F.when(F.col(f"c.source_{x}_s").isNull(), f"missing source_{x}_s") for x in ("start", "end")]
    no_number = s.isNull() | e.isNull() | F.isnan(s) | F.isnan(e)
    times = F.when(no_number, "times are no numbers").when((s < 0) | (e < 0), "negative time").when(s >= e, "start is not before end")
    late = F.array_compact(F.when(missing[0].isNull() & missing[1].isNull(), F.array(times)).otherwise(F.array(*missing)))
    first = F.when(~F.col("object"), "no JSON object").when(absent("candidate_id"), "missing candidate_id").when(absent("candidate_key"), "missing candidate_key")
    wrong = F.when(~F.col("is_source"), F.array().cast("array<string>")).when(first.isNotNull(), F.array(first)).otherwise(late)
    read = stored(rows.withColumn("wrong", wrong), "metadata")
    files = read.filter("coalesce(position, 0) = 0")  # a file without items has one row, without position
    of_files = files.filter("problem is not null").select("path", F.lit(None).cast("int").alias("position"), F.lit(None).cast("string").alias("candidate_id"), "problem")
    rows = read.filter("position is not null and (is_source or object)")
    faulty = rows.filter(F.size("wrong") > 0).select("path", "position", F.col("c.candidate_id").alias("candidate_id"), F.explode("wrong").alias("problem"))
    fine = rows.filter(F.size("wrong") == 0)
    place = F.struct("path", "position")
    kept = fine.filter("is_source").groupBy(F.col("c.candidate_id").alias("id")).agg(F.min(place).alias("first"))
    met = fine.join(kept, F.col("is_source") & (F.col("c.candidate_id") == F.col("id")), "left").withColumn("again", F.coalesce(F.col("first") != place, F.lit(False)))
    twice = met.filter("again").select("path", "position", F.col("c.candidate_id").alias("candidate_id"), F.lit("duplicate candidate_id").alias("problem"))
    own = {f: F.col(f"c.{f}") for f in FIELDS}
    own |= {"clip_id": F.when(F.col("own_clip"), own["clip_id"]).otherwise(F.col("parent.id")), "source_start_s": s, "source_end_s": e}
    own |= {f"source_{x}": F.coalesce(own[f"source_{x}"], F.col(f"parent.{x}")) for x in ("bucket", "key")}
    candidates = met.filter("not again").select("path", "position", *[own[f].alias(f) for f in FIELDS], "record")
    stats = files.agg(F.count("*").alias("source_files_scanned"), F.count_if("none").alias("zero_candidate_sources"), F.count_if(F.col("problem").isNotNull()).alias("files_with_errors"))
    return Metadata(candidates, of_files.unionByName(faulty).unionByName(twice), stats)


def read_candidate_metadata(spark: SparkSession, folder: str) -> Metadata:
    """parse_candidate_metadata() of all .json files under a folder, however deep. A file is read whole, by one task."""
    files = spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").load(folder)
    return parse_candidate_metadata(files.select(F.col("_metadata.file_path").alias("path"), "value"))
