"""Typed tables from CSV, manifests in Parquet, and outputs with a fixed schema."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, DoubleType, FloatType, IntegerType, LongType, StringType, StructField, StructType, TimestampType

_PLAIN: dict[str, DataType] = {"string": StringType(), "double": DoubleType(), "float": FloatType(), "int": IntegerType(), "long": LongType(), "boolean": BooleanType(), "timestamp": TimestampType()}


def struct_of(columns: str) -> StructType:
    """A schema from "name type, ..." of plain types and arrays of them; unlike StructType.fromDDL it needs no session."""
    kind = lambda t: ArrayType(_PLAIN[t[6:-1]]) if t.startswith("array<") else _PLAIN[t]
    return StructType([StructField(name, kind(t)) for name, t in (c.split() for c in columns.split(","))])


def with_schema(df: DataFrame, schema: StructType) -> DataFrame:
    """The columns of schema, in its order and types; missing ones are null, others are left out."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def read_canonical(spark: SparkSession, path: str, schema: StructType, columns: dict[str, str] | None = None, defaults: dict | None = None) -> DataFrame:
    """CSV with a header as typed rows: columns maps names in the file to names of schema.

    Blank or unreadable values become the default of their column, or null; 0.0 stays 0.0.
    """
    raw = spark.read.option("header", True).csv(path).withColumnsRenamed(columns or {})

    def value(f):
        got = F.nullif(F.trim(F.col(f.name)), F.lit("")) if f.name in raw.columns else F.lit(None).cast("string")
        typed = got.try_cast(f.dataType)
        return (F.coalesce(typed, F.lit(defaults[f.name]).cast(f.dataType)) if defaults and f.name in defaults else typed).alias(f.name)

    return raw.select(*map(value, schema))


def write_canonical(df: DataFrame, path: str, columns: Sequence[str]) -> None:
    """CSV with exactly these columns, nulls as empty strings."""
    df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns]).write.option("header", True).option("emptyValue", "").csv(path)


def append_unseen(new: DataFrame, old: DataFrame, key: str = "crop_id") -> DataFrame:
    """Rows of new whose key old lacks; repeats inside new stay, null keys are unseen."""
    return new.join(old.select(key), key, "left_anti").select(*new.columns)


def filter_manifest(manifest: DataFrame, clips: DataFrame | None = None, **equal) -> DataFrame:
    """Rows whose columns equal the given values (a list: any of them) and, with clips, whose clip_id it has."""
    for name, value in equal.items():
        manifest = manifest.filter(F.col(name).isin(value) if isinstance(value, list) else F.col(name) == value)
    return manifest if clips is None else manifest.join(clips.select("clip_id"), "clip_id", "left_semi").select(*manifest.columns)
