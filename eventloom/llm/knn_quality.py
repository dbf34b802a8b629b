"""Quality scores by nearest-neighbour voting in a latent-semantic space.

A text becomes two counted vectors, both over the whole text: trigrams of 16 byte classes (letters by case,
digits, blanks, line ends, single marks, symbol groups, other bytes) and words hashed to `buckets`; each is log-damped and set to
length 1. A bounded sample of labelled rows (`sample` per label, those with the smallest id hashes, never held-out ones)
gives idf weights, a truncated singular value decomposition and the labelled vectors. The projection and the vectors
are broadcast: (features + 2 x sample) x `rank` floats, whatever the input's size. Every document is projected, exact
cosines to all labelled vectors come from one blocked matrix product, and the `k` nearest vote with weight
cosine^`power`, each label's votes divided by its share among the sample so that the sample's balance does not decide.

score is in 0..1, higher where label 1 is likelier. Null and empty texts have a zero vector and get the
neutral score 0.5, as has every text when no labels are given. Only the text enters the score. Repeated rows score alike.
Columns besides id and text stay out of the result. Labelled ids that documents lack are ignored, null labels and ids with both labels too. Of
equally near labelled rows at the k-th place those of the smallest ids vote.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.words import U, Words, slices, text_bytes

CLASSES = 16
_CLASS = np.full(256, 14, np.uint8)
for _i, _set in enumerate(["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\x0b\x0c\r", "\n", ".", ",;:", "!?", "#", "*$", "%&", "|", "\"'()[]{}", "<>=-_~/\\+@"]):
    _CLASS[np.frombuffer(_set.encode(), np.uint8)] = _i
_CLASS[128:] = 15


def vectors(column, buckets: int) -> np.ndarray:
    """Counted features of each row, float32."""
    data, rows = text_bytes(column)
    n = len(rows) - 1
    row = np.repeat(np.arange(n), np.diff(rows))
    c = _CLASS[data].astype(np.int64)
    parts = []
    code = c[:-2] * CLASSES * CLASSES + c[1:-1] * CLASSES + c[2:] if len(c) > 2 else c[:0]
    same = row[:-2] == row[2:] if len(c) > 2 else np.zeros(0, bool)
    parts.append(np.bincount((row[:-2] * CLASSES**3 + code)[same] if len(c) > 2 else code, minlength=n * CLASSES**3).reshape(n, -1))
    w = Words(column, lower=True)
    parts.append(np.bincount(w.row_of_word() * buckets + (w.hashes() % U(buckets)).astype(np.int64), minlength=n * buckets).reshape(n, -1))
    out = []
    for p in parts:
        x = np.log1p(p.astype(np.float32))
        out.append(x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9))
    return np.concatenate(out, 1)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def rows_of(batches, column: str, rows: int = 1024):
    for b in slices(batches, column, 2 << 20):
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def fit(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, sample: int, rank: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(projection, labelled unit vectors, their labels); labels has only rows to learn from."""
    known = labels.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("y")).filter("id is not null and y in (0, 1)").groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("most")).filter("y = most").select("id", "y")
    chosen = [known.filter(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(sample) for y in (0, 1)]
    few = F.broadcast(chosen[0].union(chosen[1]))  # at most 2 x sample rows

    def run(batches):
        for b in rows_of(batches, "text"):
            x = vectors(b.column(2), buckets).astype(np.float16)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([r.tobytes() for r in x], pa.binary())], ["id", "y", "x"])

    found = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(few, "id").select("id", "y", "text")
    kind = dict(found.dtypes)["id"]
    got = sorted(((r["id"], r["y"], bytes(r["x"])) for r in found.mapInArrow(run, f"id {kind}, y int, x binary").collect()), key=lambda r: r[::2])
    width = CLASSES**3 + buckets
    if not got:
        return np.zeros((width, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0, np.int64)
    x = np.stack([np.frombuffer(r[2], np.float16) for r in got]).astype(np.float32)
    idf = np.log((1 + len(x)) / (1 + (x > 0).sum(0))).astype(np.float32) + 1
    x *= idf
    value, vector = np.linalg.eigh((x @ x.T).astype(np.float64))
    keep = np.argsort(-value)[: min(rank, len(x))]
    keep = keep[value[keep] > 1e-6 * value.max()]
    projection = (x.T @ (vector[:, keep] / np.sqrt(value[keep])).astype(np.float32)) * idf[:, None]
    return projection.astype(np.float32), unit(x / idf @ projection).astype(np.float32), np.array([r[1] for r in got])


def vote(z: np.ndarray, labelled: np.ndarray, y: np.ndarray, k: int, power: float) -> np.ndarray:
    """Scores of unit vectors z."""
    out = np.full(len(z), 0.5)
    if not len(y) or not len(z):
        return out
    near = z @ labelled.T
    k = min(k, len(y))
    top = np.argpartition(-near, k - 1, axis=1)[:, :k]
    last = np.take_along_axis(near, top, 1).min(1)
    for i in np.flatnonzero((near >= last[:, None]).sum(1) > k):  # ties at the last place go to the first labelled ids
        top[i] = np.argsort(-near[i], kind="stable")[:k]
    weight = np.maximum(np.take_along_axis(near, top, 1), 0).astype(np.float64) ** power
    share = np.array([max(1, (y == 0).sum()), max(1, (y == 1).sum())], np.float64)
    weight /= share[y[top]]
    total = weight.sum(1)
    full = total > 0
    out[full] = (weight * (y[top] == 1)).sum(1)[full] / total[full]
    return out


def quality_scores(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", threshold: float = 0.3, sample: int = 1200, rank: int = 48, buckets: int = 2048, k: int = 25, power: float = 8.0) -> DataFrame:
    """(doc_id, score, predicted) for every row of docs."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, doc_id, text, label, sample, rank, buckets))

    def run(batches):
        projection, labelled, y = model.value
        for b in rows_of(batches, "text"):
            score = np.round(vote(unit(vectors(b.column(1), buckets) @ projection), labelled, y, k, power), 6)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    kind = dict(docs.select(doc_id).dtypes)[doc_id]
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, score double, predicted int").withColumnRenamed("doc_id", doc_id)


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string")) % 5 == 0


def op3_knn_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~held_out())
    return quality_scores(docs, labels).withColumn("held_out", F.coalesce(held_out(), F.lit(False))).select("doc_id", "held_out", "score", "predicted")
