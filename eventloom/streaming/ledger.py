"""A processing ledger kept by a stream: which files were downloaded, generated and uploaded.

The ledger is a folder of numbered deltas, one per micro-batch, with the new state of the files that the batch touched, and of snapshots. A batch reads what
stood before its own number and writes its own delta, so that repeating it, whole or after a kill, changes nothing. A delta counts once its write is committed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

FLAGS = ("downloaded", "generated", "uploaded")
STATE = "file_name string, downloaded boolean, generated boolean, uploaded boolean, source_etag string, source_size_bytes string, last_error string, batch long"
#: An attempt: action is discovered, failed or one of FLAGS; step orders the attempts on a file, whatever batch they come in.
CHANGE = "file_name string, action string, step long, source_etag string, source_size_bytes string, error string"


def transitions(old: DataFrame, changes: DataFrame, batch: int) -> tuple[DataFrame, DataFrame]:
    """(state of the files that changes touch, rejected changes) from the ledger before them.

    A flag is set at the first step of its action after the step that set the flag before it; earlier ones are rejected, as are unknown
    actions and null names. Discovery adds a file and keeps flags. A failure leaves an error until a later step succeeds. Only partial aggregates and joins by file.
    """
    known = F.col("action").isin("discovered", "failed", *FLAGS) & F.col("file_name").isNotNull()
    rows = changes.filter(known)
    touched = rows.groupBy("file_name").agg(
        F.min(F.when(F.col("action") == "downloaded", F.col("step"))).alias("first"),
        F.max_by(F.struct("source_etag", "source_size_bytes"), F.when(F.col("action") == "downloaded", F.col("step"))).alias("source"),
        F.max(F.when(F.col("action") == "failed", F.struct("step", F.substring(F.coalesce("error", F.lit("")), 1, 500).alias("error")))).alias("failed"),
    )
    now = touched.join(old.select("file_name", F.struct(*[c for c in old.columns if c != "file_name"]).alias("old")), "file_name", "left")
    # a flag that stood before holds from any step on
    before = F.lit(-(1 << 62)).cast("long")
    at = {"downloaded": F.when(F.col("old.downloaded"), before).otherwise(F.col("first"))}
    now = now.withColumn("at_downloaded", at["downloaded"])
    for flag, needs in zip(FLAGS[1:], FLAGS, strict=False):
        steps = rows.filter(F.col("action") == flag).join(now.select("file_name", F.col(f"at_{needs}").alias("needs")), "file_name").filter("step > needs")
        now = now.join(steps.groupBy("file_name").agg(F.min("step").alias("mine")), "file_name", "left")
        now = now.withColumn(f"at_{flag}", F.when(F.col(f"old.{flag}"), before).otherwise(F.col("mine"))).drop("mine")
    needed = F.when(F.col("action") == "generated", F.col("at_downloaded")).when(F.col("action") == "uploaded", F.col("at_generated")).otherwise(F.col("step") - 1)
    judged = rows.join(now.select("file_name", "at_downloaded", "at_generated"), "file_name")
    accepted = judged.filter(F.col("action").isin(*FLAGS) & (F.col("step") > needed)).groupBy("file_name").agg(F.max("step").alias("last"))
    rejected = judged.filter(F.coalesce(F.col("step") <= needed, F.lit(True))).select(*changes.columns).unionByName(changes.filter(~F.coalesce(known, F.lit(False))))
    state = now.join(accepted, "file_name", "left")
    cleared = F.col("last").isNotNull() & (F.col("failed").isNull() | (F.col("last") > F.col("failed.step")))
    error = F.when(cleared, "").otherwise(F.coalesce("failed.error", "old.last_error", F.lit("")))
    source = [F.coalesce(F.when(F.col("source").isNotNull(), F.col(f"source.{c}")), F.col(f"old.{c}")).alias(c) for c in ("source_etag", "source_size_bytes")]
    state = state.select("file_name", *[F.col(f"at_{f}").isNotNull().alias(f) for f in FLAGS], *source, error.alias("last_error"), F.lit(batch).cast("long").alias("batch"))
    return state, rejected.withColumn("batch", F.lit(batch).cast("long"))


class Ledger:
    """The ledger in a folder that all executors share. One stream, or one caller with rising batch numbers, writes it."""

    def __init__(self, spark: SparkSession, path: str, snapshot_every: int = 20):
        self.spark, self.path, self.snapshot_every = spark, path.rstrip("/"), snapshot_every

    def _committed(self, kind: str) -> list[int]:
        """Numbers of finished writes: those with a success mark."""
        glob = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}/*/_SUCCESS")
        found = glob.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(glob)
        return sorted(int(f.getPath().getParent().getName()) for f in found or [])

    def read(self, before: int | None = None) -> DataFrame:
        """One row per file, after all batches or those under `before`."""
        usable = lambda kind: [n for n in self._committed(kind) if before is None or n < before]
        base = usable("snapshot")[-1:]
        parts = [f"{self.path}/snapshot/{n}" for n in base] + [f"{self.path}/delta/{n}" for n in usable("delta") if not base or n > base[0]]
        if not parts:
            return self.spark.createDataFrame([], STATE)
        fields = [c.split()[0] for c in STATE.split(", ")]
        rows = self.spark.read.schema(STATE).parquet(*parts).groupBy("file_name").agg(F.max_by(F.struct(*fields[1:]), "batch").alias("s"))
        return rows.select("file_name", "s.*")

    def rejected(self) -> DataFrame:
        """Changes that were not allowed, with their batch."""
        parts = [f"{self.path}/rejected/{n}" for n in self._committed("rejected")]
        schema = f"{CHANGE}, batch long"
        return self.spark.read.schema(schema).parquet(*parts) if parts else self.spark.createDataFrame([], schema)

    def apply(self, changes: DataFrame, batch: int) -> None:
        """Writes the delta of one batch. A repeated batch writes the same delta again."""
        state, rejected = transitions(self.read(before=batch), changes.select(*[c.split()[0] for c in CHANGE.split(", ")]), batch)
        rejected.write.mode("overwrite").parquet(f"{self.path}/rejected/{batch}")
        state.write.mode("overwrite").parquet(f"{self.path}/delta/{batch}")
        if (batch + 1) % self.snapshot_every == 0:
            self.read(before=batch + 1).write.mode("overwrite").parquet(f"{self.path}/snapshot/{batch}")


def ledger_stream(changes: DataFrame, path: str, checkpoint: str, apply: Callable[[DataFrame, int], None] | None = None, **trigger) -> StreamingQuery:
    """A running query that keeps the ledger at path up to date with a stream of changes; checkpoint belongs to that ledger alone."""
    ledger = Ledger(changes.sparkSession, path)
    writer = changes.writeStream.foreachBatch(apply or ledger.apply).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
