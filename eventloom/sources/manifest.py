"""Feature manifests: a Parquet table by split and batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.sources.tables import append_unseen, struct_of, with_schema

MANIFEST = struct_of(
    "crop_id string, clip_id string, candidate_id string, timestamp_s double, sample_position string, crop_type string, geometry_x int, geometry_y int, geometry_width int, "
    "geometry_height int, embedding array<float>, encoder_name string, encoder_version string, label string, actor_id string, hand_side string, region_id string, "
    "confidence string, hard_case boolean, event_id string, created_at timestamp, split string, batch_id string"
)


def stamped(records: DataFrame, batch_id: str | None, created_at=None) -> DataFrame:
    """records in the columns of MANIFEST, with their batch and, where they have none, the time of writing."""
    at = F.current_timestamp() if created_at is None else F.lit(created_at)
    own = F.coalesce(F.col("created_at"), at) if "created_at" in records.columns else at
    return with_schema(records.withColumns({"created_at": own.cast("timestamp"), "batch_id": F.lit(batch_id).cast("string")}), MANIFEST)


def save_manifest(records: DataFrame, path: str, batch_id: str | None = None, created_at=None) -> None:
    """Writes a batch into the manifest at path. Where the batch was there before, the splits written now replace its own; other batches stay."""
    rows = stamped(records, batch_id, created_at)
    rows.write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("split", "batch_id").parquet(path)


def append_manifest(records: DataFrame, path: str, batch_id: str | None = None, created_at=None) -> int:
    """Adds what the manifest lacks by crop_id (repeats inside records stay), and returns how many rows it then has. path must be a manifest."""
    old = load_manifest(records.sparkSession, path)
    stamped(append_unseen(records, old), batch_id, created_at).write.mode("append").partitionBy("split", "batch_id").parquet(path)
    return load_manifest(records.sparkSession, path).count()


def load_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The manifest; filters on split and batch_id prune folders, those on columns are pushed to the files."""
    return spark.read.schema(MANIFEST).parquet(path)
