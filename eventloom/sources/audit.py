"""Nested audits: what happened to a clip's candidates, as JSON records of arrays."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from eventloom.sources.tables import struct_of

EVENT = "pred_id string, candidate_id string, type string, t_start double, transfer_s double, t_end double, score double"
SUPPRESSION = "kept string, kept_score double, dropped array<string>, dropped_scores array<double>, max_tiou double, max_transfer_s double"
DIAGNOSTIC = "candidate_id string, skipped boolean, skip_reason string, n_samples long, n_events long"
_PARTS = {"events": EVENT, "suppressions": SUPPRESSION, "diagnostics": DIAGNOSTIC}
AUDIT = StructType([*struct_of("clip_id string, part int"), *[StructField(name, ArrayType(struct_of(columns))) for name, columns in _PARTS.items()]])


def suppressions(events: DataFrame, audit: DataFrame) -> DataFrame:
    """(clip_id, candidate_id, SUPPRESSION): per kept prediction those that it dropped, best first; audit has (dropped, kept)."""
    side = lambda p: events.select(F.col("pred_id").alias(p), *[F.col(c).alias(f"{p}_{c}") for c in ("clip_id", "candidate_id", "t_start", "t_end", "transfer_s", "score")])
    both = audit.join(side("kept"), "kept").join(side("dropped"), "dropped")
    shared = F.greatest(F.lit(0.0), F.least("kept_t_end", "dropped_t_end") - F.greatest("kept_t_start", "dropped_t_start"))
    span = F.greatest("kept_t_end", "dropped_t_end") - F.least("kept_t_start", "dropped_t_start")
    rows = both.withColumns({"tiou": F.when(span > 0, shared / span).otherwise(0.0), "away": F.abs(F.col("kept_transfer_s") - F.col("dropped_transfer_s"))})
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("dropped_score")).alias("o"), "dropped")))
    out = rows.groupBy("kept").agg(F.first("kept_clip_id").alias("clip_id"), F.first("kept_candidate_id").alias("candidate_id"), F.first("kept_score").alias("kept_score"), ranked.alias("r"), F.max("tiou").alias("max_tiou"), F.max("away").alias("max_transfer_s"))
    return out.select("clip_id", "candidate_id", "kept", "kept_score", F.transform("r", lambda x: x["dropped"]).alias("dropped"), F.transform("r", lambda x: -x["o"]).alias("dropped_scores"), "max_tiou", "max_transfer_s")


def nested_audit(events: DataFrame, dropped: DataFrame, diagnostics: DataFrame, most: int = 10_000) -> DataFrame:
    """AUDIT rows of events, suppressions() and diagnostics, each with clip_id and candidate_id. A clip has one record, or several parts of about `most` candidates each."""
    whole = dict(zip(_PARTS, (events, dropped, diagnostics), strict=True))
    parts = None
    for name, df in whole.items():
        entry = F.struct(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in AUDIT[name].dataType.elementType])
        row = df.select("clip_id", "candidate_id", *[(entry if n == name else F.lit(None).cast(AUDIT[n].dataType.elementType)).alias(n) for n in whole])
        parts = row if parts is None else parts.unionByName(row)
    n = parts.groupBy("clip_id").agg(F.ceil(F.count("*") / most).alias("n"))
    placed = parts.join(n, parts["clip_id"].eqNullSafe(n["clip_id"])).drop(n["clip_id"])
    placed = placed.withColumn("part", F.pmod(F.xxhash64(F.coalesce("candidate_id", F.lit(""))), F.col("n")).cast("int"))
    return placed.groupBy("clip_id", "part").agg(*[F.array_sort(F.collect_list(c)).alias(c) for c in whole]).select(*AUDIT.names)


def write_audit(audit: DataFrame, path: str) -> None:
    audit.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(AUDIT).json(path)
