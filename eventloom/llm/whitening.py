"""Embedding whitening from an exact spectrum.

Entries become integers, x = floor(64 c) + 1000000. The scatter matrix n sum(x x') - S S' over the distinct vectors is summed exactly in
Spark (its size depends on the dimension alone), `exact_spectrum` gives its leading eigenvalues and eigenvectors, and a narrow pass
projects every row. Sums, products and deviations are translation-invariant and are taken of floor(64 c).

Left out: null and empty vectors, and those with an entry that is null, not finite, or of which 64 c lies beyond 2^53. Vectors of
different lengths raise ValueError. Repeated rows come back as often as they are and count once in the fit; rows with a null id come back.
Components with eigenvalue 0 do not exist, so a table of rank r has at most r; an empty table, or one distinct vector, has none.
A deviation that does not fit a long (from some 10^8 distinct vectors on) is null. Other columns, whatever their names, stay out.
"""

from __future__ import annotations

import math
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import remove_written, written
from eventloom.llm.exact_spectrum import leading_components

#: The largest |floor(64 c)|: integers that a double holds exactly.
LARGEST = 1 << 53


def matrix_of(column: pa.Array) -> np.ndarray:
    """A list column without nulls as a matrix of longs."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def exact_product(y: np.ndarray) -> np.ndarray:
    """y' y exactly, as Python integers. Blocks whose sums a double holds exactly use floating matrix products."""
    top = max(1, int(np.abs(y).max()))
    step = LARGEST // (top * top)
    if not step:
        y = y.astype(object)
        return y.T @ y
    out = np.zeros((y.shape[1], y.shape[1]), object)
    step = min(step, 8192)
    for at in range(0, len(y), step):
        block = y[at : at + step].astype(np.float64)
        out += (block.T @ block).astype(np.int64)
    return out


def partial_sums(batches):
    """(i, j, value) of one task: sums of products for i <= j, and plain sums with i = -1."""
    gram = total = None
    for batch in batches:
        y = matrix_of(batch.column(0))
        if len(y):
            gram = exact_product(y) + (0 if gram is None else gram)
            total = y.astype(object).sum(0) + (0 if total is None else total)
    if gram is not None:
        d = len(total)
        i, j = np.triu_indices(d)
        value = [Decimal(int(x)) for x in (*gram[i, j], *total)]
        index = (np.append(i, np.full(d, -1)), np.append(j, np.arange(d)))
        yield pa.RecordBatch.from_arrays([pa.array(index[0], pa.int32()), pa.array(index[1], pa.int32()), pa.array(value, pa.decimal128(38, 0))], ["i", "j", "value"])


class Whitening:
    """n, sums S and the projection of a fit; applied to batches of rows."""

    def __init__(self, n: int, total: np.ndarray, vectors: np.ndarray, values: list[tuple[int, int]], trace: int):
        self.n, self.total = n, total
        self.explained = [(m / trace) if q == 0 else m / (trace << q) for m, q in values]
        # e = m / 2^q / n^2; a square root of integers keeps every digit of a double
        roots = [math.isqrt((m << 256) >> (q - q % 2)) / (1 << 128) / 2 ** ((q % 2) / 2) / n for m, q in values]
        self.projection = vectors / np.array(roots) / n

    def centred(self, y: np.ndarray) -> np.ndarray:
        """n y - S, exactly; longs where they suffice."""
        most = int(np.abs(y).max()) * self.n + max(abs(int(x)) for x in self.total)
        if most * most * y.shape[1] >= 1 << 63:
            return y.astype(object) * self.n - self.total
        return y * self.n - self.total.astype(np.int64)

    def whiten(self, centred: np.ndarray) -> np.ndarray:
        return centred.astype(np.float64) @ self.projection


def moments(batches, fit: Whitening):
    """(i, j, value): sums of products of whitened values, and plain sums with i = -1."""
    gram = total = 0
    for batch in batches:
        y = matrix_of(batch.column(0))
        if len(y):
            w = fit.whiten(fit.centred(y))
            gram, total = gram + w.T @ w, total + w.sum(0)
    if not np.isscalar(total):
        k = len(total)
        i, j = np.triu_indices(k)
        index = (np.append(i, np.full(k, -1)), np.append(j, np.arange(k)))
        yield pa.RecordBatch.from_arrays([pa.array(index[0], pa.int32()), pa.array(index[1], pa.int32()), pa.array(np.append(gram[i, j], total))], ["i", "j", "value"])


def project(batches, fit: Whitening, error: float):
    k = len(fit.explained)
    for batch in batches:
        y = matrix_of(batch.column(1))
        if not len(y):
            continue
        centred = fit.centred(y)
        square = (centred * centred).sum(1)
        whole = [int(x) if int(x) < 1 << 63 else None for x in square] if centred.dtype == object else square
        rows = np.repeat(np.arange(len(y)), k)
        out = [
            batch.column(0).take(pa.array(rows)),
            pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(y))),
            pa.array(np.full(len(rows), fit.n, np.int64)),
            pa.array(whole, pa.int64()).take(pa.array(rows)),
            pa.array(fit.whiten(centred).ravel()),
            pa.array(np.tile(fit.explained, len(y))),
            pa.array(np.full(len(rows), error)),
        ]
        yield pa.RecordBatch.from_arrays(out, ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])


def whiten(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", components: int = 16) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): one row per kept row and component, the largest eigenvalue first.

    n: distinct vectors. deviation: sum over dimensions of (n x - S)^2. whitened: x - S / n on the component, over the root of its eigenvalue.
    explained: eigenvalue over trace. identity_error: largest entry of the fit list's whitened covariance minus the identity, measured on the values.
    """
    spark = rows.sparkSession
    scaled = F.transform(vector, lambda c: c.cast("double") * 64)
    fine = F.forall(scaled, lambda c: F.coalesce(F.abs(c) <= LARGEST, F.lit(False))) & (F.size(vector) > 0)
    kept = rows.filter(F.col(vector).isNotNull() & fine).select(F.col(vec_id).alias("id"), F.transform(scaled, lambda c: F.floor(c)).alias("y"))
    kind = rows.schema[vec_id].dataType.simpleString()
    names = "component int, n long, deviation long, whitened double, explained double, identity_error double"
    distinct = written(kept.select("y").distinct(), "vectors")
    size = distinct.agg(F.count("*").alias("n"), F.min(F.size("y")).alias("least"), F.max(F.size("y")).alias("d")).first()
    if size["n"] and size["least"] != size["d"]:
        raise ValueError(f"vectors of {size['least']} to {size['d']} entries")
    n, d = size["n"], size["d"]
    sums = distinct.mapInArrow(partial_sums, "i int, j int, value decimal(38,0)").groupBy("i", "j").agg(F.sum("value").alias("value")).collect()  # d (d + 3) / 2 rows
    scatter, total = np.zeros((d or 0, d or 0), object), np.zeros(d or 0, object)
    for r in sums:
        if r["i"] < 0:
            total[r["j"]] = int(r["value"])
    for r in sums:
        if r["i"] >= 0:
            i, j = r["i"], r["j"]
            scatter[i, j] = scatter[j, i] = n * int(r["value"]) - total[i] * total[j]
    trace = sum(int(scatter[i, i]) for i in range(len(scatter)))
    if not trace:
        remove_written(spark, distinct)
        return spark.createDataFrame([], f"id {kind}, {names}").withColumnRenamed("id", vec_id)
    vectors, values = leading_components(spark, scatter, components)
    fit = Whitening(n, total, vectors, values, trace)
    seen = distinct.mapInArrow(lambda b: moments(b, fit), "i int, j int, value double").groupBy("i", "j").agg(F.sum("value").alias("value")).collect()  # 152 rows for 16 components
    mean = {r["j"]: r["value"] / n for r in seen if r["i"] < 0}
    error = max(abs(r["value"] / n - mean[r["i"]] * mean[r["j"]] - (r["i"] == r["j"])) for r in seen if r["i"] >= 0)
    remove_written(spark, distinct)
    return kept.mapInArrow(lambda b: project(b, fit, error), f"id {kind}, {names}").withColumnRenamed("id", vec_id)


def op13_whitening(spark, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
