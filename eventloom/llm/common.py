"""What several operators share: written intermediate tables, shard counts, connected components."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The separators of words, for Spark's regular expressions.
SPLIT = r"[\x20\x09-\x0D]+"


_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local master, as in tests, may leave it unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = "/tmp/checkpoints"
    return named.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: lineage ends there and survives lost executors. remove_written() deletes it."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def remove_written(spark: SparkSession, *tables: DataFrame) -> None:
    """Deletes these tables of written(), or all that this process has written; what is read from them must be done."""
    for path in [t.written_to for t in tables] or list(_written):
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        _written.remove(path)


def integer_id(df: DataFrame, column: str) -> str:
    """The type of an id column, which must be an integer type: results depend on the order of ids."""
    kind = dict(df.select(column).dtypes)[column]
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise ValueError(f"{column} must be an integer column, not {kind}")
    return kind


def words_of(text: Column) -> Column:
    """The array of words of a text; null gives an empty one."""
    return F.filter(F.coalesce(F.split(text, SPLIT), F.array().cast("array<string>")), lambda w: w != "")


def text_total(docs: DataFrame, text: str) -> int:
    """Bytes of text in all rows (one narrow scan)."""
    return docs.agg(F.sum(F.octet_length(text)).alias("n")).first()["n"] or 0


def pieces(total: int, each: int) -> int:
    """How many blocks or shards of about `each` bytes hold `total` bytes."""
    return max(1, -(-total // each))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (u, v), both long: (node, label), label the smallest node reached.

    Each round hooks every node to its smallest neighbour, halves the paths by pointer jumping and
    contracts the edges; rounds grow as the logarithm of the longest chain. Hot nodes only meet
    partial aggregates and joins that adaptive execution can split. All state stays in written tables.
    """
    spark = edges.sparkSession
    edges = written(edges.filter("u <> v").distinct(), "edges")
    labels = written(edges.select(F.col("u").alias("node")).union(edges.select("v")).distinct().withColumn("label", F.col("node")), "labels")
    while not edges.isEmpty():
        both = edges.union(edges.select("v", "u"))
        hook = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("p"), F.lit(True).alias("moved")), "hooks")
        while True:
            up = hook.select(F.col("u").alias("p"), F.col("p").alias("pp"))
            jumped = written(hook.select("u", "p").join(up, "p", "left").select("u", F.coalesce("pp", "p").alias("p"), (F.coalesce("pp", "p") != F.col("p")).alias("moved")), "hooks")
            remove_written(spark, hook)
            hook = jumped
            if hook.filter("moved").isEmpty():
                break
        new_labels = written(labels.join(hook.select(F.col("u").alias("label"), "p"), "label", "left").select("node", F.coalesce("p", "label").alias("label")), "labels")
        new_edges = written(
            edges.join(hook.select("u", F.col("p").alias("a")), "u").join(hook.select(F.col("u").alias("v"), F.col("p").alias("b")), "v").filter("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct(), "edges"
        )
        remove_written(spark, hook, labels, edges)
        labels, edges = new_labels, new_edges
    remove_written(spark, edges)
    return labels
