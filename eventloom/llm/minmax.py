"""Near-duplicate documents by min-max hashing.

Each distinct set of word shingles is hashed once per permutation and keeps both the minimum and the
maximum of every permutation, so `perms` evaluations give 2 x perms signature entries. Bands of `band`
entries, drawn across permutations, are bucket keys: with the defaults (63 evaluations, 25 bands of 5) a
pair at Jaccard 0.85 shares no bucket with a chance of about 4e-7, and two linked families are lost only if
all their links are.

From there everything is exact. Documents with the same set are one node. Nodes that share a bucket are
tied to the bucket's smallest node (a star, never all pairs); the components of these ties are families.
A family is cut into chunks of bounded size by hash, and every two chunks meet in one tile, where shared shingles are
counted exactly on the full sets; a tile returns a spanning forest of its links, at most a row per node,
so no link between different texts is lost and rows stay linear. Components of the forests are the classes.

Words are runs without white space, A-Z lower-cased; a text of 1 to k-1 words is one shingle; a null or
empty text has no shingle and is a class of its own. Repeated rows are equal sets, and rows that share a doc_id
are one document in the result's links. Ids are integers; another type raises ValueError. A null doc_id ranks after all others: a class of such rows alone
has a null component_id and its rows are kept. Columns besides id and text stay out of the result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import components, integer_id, written
from eventloom.llm.words import U, Words, grams, mix, slices, span_hashes


def shingle_sets(column, k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    w = Words(column, lower=True)
    h = w.hashes()
    g = grams(h, k)
    first = w.first
    short = np.flatnonzero((w.count > 0) & (w.count < k))
    whole = dict(zip(short.tolist(), span_hashes(h, first[:-1][short], first[1:][short]), strict=True)) if len(short) else {}
    out = []
    for i, (a, n) in enumerate(zip(first[:-1].tolist(), w.count.tolist(), strict=True)):
        out.append(np.unique(g[a : a + n - k + 1]) if n >= k else np.array([whole[i]], U) if n else np.zeros(0, U))
    return out


def _multipliers(n: int, seed: int) -> np.ndarray:
    return mix((np.arange(n, dtype=U) + U(1)) * U(0xA24BAED4963EE407) + U(seed)) | U(1)


def signatures(flat: np.ndarray, first: np.ndarray, perms: int) -> np.ndarray:
    """2 x perms entries per set; first has where each (non-empty) set starts in flat."""
    out = np.empty((len(first), 2 * perms), U)
    for p, (a, b) in enumerate(zip(_multipliers(perms, 1), _multipliers(perms, 2), strict=True)):
        v = flat * a
        v ^= v >> U(32)
        v *= b
        out[:, 2 * p] = np.minimum.reduceat(v, first)
        out[:, 2 * p + 1] = np.maximum.reduceat(v, first)
    return out


def band_keys(sig: np.ndarray, band: int) -> np.ndarray:
    """Bucket keys, one column per band; entries of a band come from different permutations."""
    order = np.concatenate([np.arange(0, sig.shape[1], 2), np.arange(1, sig.shape[1], 2)])
    n = sig.shape[1] // band
    keys = np.empty((len(sig), n), U)
    for b in range(n):
        h = np.full(len(sig), U(b + 1))
        for c in order[b * band : (b + 1) * band].tolist():
            h = mix(h * U(0x9E3779B97F4A7C15) + sig[:, c])
        keys[:, b] = h
    return keys


def linked_forest(sets: list[np.ndarray], nodes: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) of a spanning forest of the links between rows in left and rows in right."""
    size = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)), size)
    order = np.argsort(flat, kind="stable")
    new = np.ones(len(flat), bool)
    new[1:] = flat[order][1:] != flat[order][:-1]
    at = np.flatnonzero(new)
    length = np.diff(np.append(at, len(flat)))
    name = np.empty(len(flat), np.int64)
    name[order] = np.cumsum(new) - 1
    posting = row[order]
    first = np.zeros(len(sets) + 1, np.int64)
    np.cumsum(size, out=first[1:])
    label = np.arange(len(sets))
    for x in left.tolist():
        s = name[first[x] : first[x + 1]]
        s = s[length[s] > 1]
        if not len(s):
            continue
        n = length[s]
        spots = np.repeat(at[s] - np.cumsum(n) + n, n) + np.arange(n.sum())
        shared = np.bincount(posting[spots], minlength=len(sets))
        y = np.flatnonzero(right & (100 * shared >= percent * (size + size[x] - shared)) & (shared > 0))
        merged = np.unique(np.append(label[y], label[x]))
        if len(merged) > 1:
            label[np.isin(label, merged)] = merged[0]
    own = label != np.arange(len(sets))
    return nodes[own], nodes[label[own]]


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80, perms: int = 63, band: int = 5, chunk: int = 300_000) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): classes of 100 x intersection >= percent x union, and the one row to keep.

    chunk: shingles of a chunk, about; a tile holds two. kept: doc_id = component_id, or the class has no id.
    """
    kind = integer_id(docs, doc_id)
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    # rows without an id get one of their own from the text, below all likely ids
    rows = rows.select("id", F.coalesce("id", F.xxhash64("text").bitwiseOR(F.lit(-(1 << 63)))).alias("key"), "text")

    def sign(batches):
        for b in slices(batches, "text", 2 << 20):
            sets = shingle_sets(b.column(2), k)
            n = np.array([len(s) for s in sets], np.int64)
            full = np.flatnonzero(n)
            k1, k2 = np.zeros(len(n), U), np.zeros(len(n), U)
            keys = np.zeros((0, 2 * perms // band), U)
            if len(full):
                flat = np.concatenate([sets[i] for i in full.tolist()])
                first = np.zeros(len(full), np.int64)
                np.cumsum(n[full][:-1], out=first[1:])
                k1[full] = np.add.reduceat(flat, first)
                k2[full] = np.add.reduceat(mix(flat + U(1)), first)
                keys = band_keys(signatures(flat, first, perms), band)
            off = np.zeros(len(n) + 1, np.int32)
            np.cumsum(np.where(n > 0, keys.shape[1], 0), out=off[1:])
            bands = pa.ListArray.from_arrays(pa.array(off), pa.array(keys.ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), bands], ["id", "key", "n", "k1", "k2", "bands"])

    signed = written(rows.mapInArrow(sign, "id long, key long, n long, k1 long, k2 long, bands array<long>"), "minmax")
    one = ["k1", "k2", "n"]
    nodes = written(signed.filter("n > 0").groupBy(*one).agg(F.min("key").alias("node"), F.min("id").alias("least")), "nodes")
    member = signed.filter("n > 0").join(nodes, one).filter("key = node").dropDuplicates(["node", *one])
    buckets = written(member.select("node", F.explode("bands").alias("bucket")), "buckets")
    hubs = buckets.groupBy("bucket").agg(F.min("node").alias("u"), F.max("node").alias("top")).filter("u < top").select("bucket", "u")
    family = components(buckets.join(hubs, "bucket").select("u", F.col("node").alias("v")))
    family = family.select("node", F.col("label").alias("family"))
    total = family.join(nodes.select("node", "n"), "node").groupBy("family").agg(F.sum("n").alias("total"))
    family = family.join(total.select("family", F.ceil(F.col("total") / chunk).alias("chunks")), "family")
    texts = rows.join(family.withColumnRenamed("node", "key"), "key").select("key", "family", "chunks", "text")
    texts = texts.withColumn("mine", F.pmod(F.xxhash64("key"), "chunks"))
    tiles = texts.select("key", "family", "mine", "text", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("other"))
    tiles = tiles.select("key", "family", "mine", "text", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"))

    def tile(table: pa.Table) -> pa.Table:
        nodes_ = table.column("key").to_numpy()
        mine, i, j = (table.column(c).to_numpy() for c in ("mine", "i", "j"))
        u, v = linked_forest(shingle_sets(table.column("text"), k), nodes_, np.flatnonzero(mine == i), mine == j, percent)
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    links = tiles.groupBy("family", "i", "j").applyInArrow(tile, "u long, v long")
    label = components(links)
    labelled = nodes.join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = labelled.groupBy("label").agg(F.min("least").alias("component_id"))
    classes = labelled.join(least, "label").select(*one, "component_id")
    out = signed.select("id", *one).join(classes, one, "left")
    own = F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component_id"))
    out = out.select(F.col("id").cast(kind).alias(doc_id), F.col("n").alias("n_shingles"), own.cast(kind).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(doc_id) == F.col("component_id"), F.col("component_id").isNull()))


def op5_minmax_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), percent=85)


