"""Connected components of pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.sources.shared import dropped, stored


def connected(edges: DataFrame) -> DataFrame:
    """(node, label) of the components of edges (u, v), in a stored table; the label is the smallest node of the component.

    Each round every node takes the smallest label among its own and its neighbours', then the label of that label, so that rounds grow as
    the logarithm of the longest path. Hot nodes meet partial aggregates only.
    """
    both = stored(edges.select("u", "v").union(edges.select("v", "u")).distinct(), "edges")
    labels = stored(both.groupBy("u").agg(F.least("u", F.min("v")).alias("label")).withColumnRenamed("u", "node").withColumn("moved", F.lit(True)), "labels")
    while not labels.filter("moved").isEmpty():
        near = both.join(labels.select(F.col("node").alias("v"), "label"), "v").groupBy(F.col("u").alias("node")).agg(F.min("label").alias("near"))
        hooked = labels.select("node", "label").join(near, "node", "left").select("node", "label", F.least("label", "near").alias("new"))
        up = labels.select(F.col("node").alias("new"), F.col("label").alias("up"))
        jumped = hooked.join(up, "new", "left").select("node", F.least("new", "up").alias("next"), "label")
        moved = stored(jumped.select("node", F.col("next").alias("label"), (F.col("next") < F.col("label")).alias("moved")), "labels")
        dropped(labels)
        labels = moved
    dropped(both)
    return labels.select("node", "label")
