"""Deterministic samples and splits by seeded hashes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_bucket(seed: int, key: Column, buckets: int = 10000) -> Column:
    """SHA-256 of `seed:key` as a number, modulo buckets."""
    digest = F.sha2(F.concat_ws(":", F.lit(str(seed)), key), 256)
    digits = F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: F.conv(F.substring(digest, i, F.lit(1)), 16, 10).cast("long"))
    return F.aggregate(digits, F.lit(0).cast("long"), lambda a, d: (a * 16 + d) % buckets)


def qa_sample(negatives: DataFrame, key: str, rate: float, seed: int = 42) -> DataFrame:
    """ceil(rate x n) rows, at least one, in the order of their hash. Buckets below the cut are kept whole, only the cut bucket is ranked."""
    rows = negatives.withColumn("bucket", hash_bucket(seed, F.col(key)))
    # at most 10,000 counts; no row but those of the cut bucket is sorted
    sizes = sorted((r["bucket"], r["count"]) for r in rows.groupBy("bucket").count().collect())
    take = max(1, math.ceil(rate * sum(n for _, n in sizes)))
    for cut, n in sizes:
        if n >= take:
            break
        take -= n
    else:
        return rows
    whole = rows.filter(F.col("bucket") < cut)
    cut = rows.filter(F.col("bucket") == cut).withColumn("__r", F.row_number().over(Window.partitionBy("bucket").orderBy(key))).filter(F.col("__r") <= take)
    return whole.unionByName(cut.select(*whole.columns))


def recording_day(clip: Column) -> Column:
    """The eight digits after an S, else the whole id."""
    return F.coalesce(F.nullif(F.regexp_extract(clip, r"S(\d{8})", 1), F.lit("")), clip)


def split_by_day(rows: DataFrame, day: str, seed: int = 42, train: float = 0.7, val: float = 0.15) -> DataFrame:
    """rows with split: whole days go to train (at least one), val or test, in the order of a seeded hash. The window orders days, not rows."""
    days = rows.select(day).distinct()
    every = Window.partitionBy()
    ranked = days.withColumns({"__r": F.row_number().over(Window.partitionBy().orderBy(F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(day).cast("string")), 256))), "__n": F.count("*").over(every)})
    n_train = F.greatest(F.lit(1), F.bround(F.col("__n") * train))
    n_val = F.bround(F.col("__n") * val)
    chosen = ranked.select(day, F.when(F.col("__r") <= n_train, "train").when(F.col("__r") <= n_train + n_val, "val").otherwise("test").alias("split"))
    return rows.join(chosen, day, "left")
