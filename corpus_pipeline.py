"""Corpus pipeline: quality rules, near-dedup, personal data, source mixing, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and reread as the next
stage's docs. All but the last return the columns of docs, which needs doc_id, text and source; others, such as lang and n_chars, may be missing
or more. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.llm import bpe, line_rules, minmax, mixing, pii
from eventloom.llm.common import written

#: Not one SQL statement: two stages are models or hashing.
ORACLE_SQL = None


def _with_text(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """rows in the columns of docs; n_chars, where docs has it, follows the text."""
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return rows.select(*docs.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the rules keep, without the lines that fail. Null and empty texts go."""
    judged = line_rules.quality(docs)
    # a filter on the verdict would be pushed below and judge every text twice; an array of one or no text is judged once
    verdict = F.filter(F.array(F.struct("kept", "cleaned")), lambda x: x["kept"])
    return _with_text(judged.select(*[c for c in docs.columns if c != "text"], F.explode(verdict).alias("__v")).withColumn("text", F.col("__v.cleaned")), docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays, the one with the smallest id; rows without an id or without words stay."""
    gone = minmax.near_duplicates(docs.select("doc_id", "text")).filter("not kept").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span of personal data becomes its kind in brackets. Null texts stay null."""
    return _with_text(pii.redact(docs), docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: rows are repeated or left out. A null source is a source of its own."""
    mixed = mixing.mix_sources(docs).filter("copies > 0")
    return mixed.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(*docs.columns)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids) of every row; a null text has no ids."""
    return bpe.encode(docs).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [("quality rules", quality_rules), ("near-dedup", near_dedup), ("personal data", personal_data), ("source mixing", mix), ("byte-level BPE", byte_bpe)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
