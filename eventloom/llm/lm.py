"""Stupid-backoff language-model scores, computed relationally.

N-gram counts of the whole corpus live in tables partitioned by the n-gram's hash; the n-grams of the documents
are joined to them and their scores are summed per document:

    S(w | context) = c(context w) / c(context)   if c(context w) > 0, else  alpha x S(w | shorter context)
    S(w)           = c(w) / N                    if c(w) > 0, else  1 / (N + 1)

Counts leave out the scored document's own occurrences (otherwise no n-gram would ever back off); copies
elsewhere count. A document's first words have shorter contexts. c(context) counts the context as an n-gram.

A row of the exploded table is a distinct n-gram of a block of documents with its count there: a frequent n-gram has one row a block,
however hot it is. The counts are their sums by key, which the exploded rows meet in the same partitioning (a window by key), and what
lives in several blocks comes back to them with its total (an n-gram without a row lives in its block alone, which knows its count).
Words and pairs come first: a longer n-gram that holds a word pair no other block has lives in its block alone and has no row.
Documents that have much in common, as those of a language, can share blocks: then fewer n-grams live in several.
N-grams are compared by hashes of 30 bits more than the number of words has, 64 at most: up to 2^34 words
one shares its hash with another with a chance of under 1e-8, at 2^44 words (about 100 TB) of 1e-5. Null and empty texts have no words, log score 0 and a null mean. Rows are scored one by
one; repeated rows are documents of their own (each counts for the others), columns besides id and text stay out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventloom.llm.common import integer_id, pieces
from eventloom.llm.words import U, Words, grams, slices

#: Rows of the exploded tables.
EXPLODED = "block long not null, key long not null, count long not null"
#: Partitions of an exchange at most; beyond, partitions grow and spill.
PARTITIONS = 100_000
#: Classes of documents that share blocks, at most.
CLASSES = 64


class Grams:
    """N-grams of a block for some orders: where each starts, its number among the block's distinct ones, and their keys."""

    def __init__(self, words: Words, hashes: np.ndarray, orders, bits: int, keep: np.ndarray | None = None):
        """keep: places where the n-grams of the one order asked for may start; all by default."""
        row = words.row_of_word()
        last = words.first[1:][row] if len(row) else np.zeros(0, np.int64)
        self.at, self.key, self.number, self.bits = {}, {}, {}, bits
        for n in orders:
            fits = np.arange(len(row)) + n <= last
            at = np.flatnonzero(fits if keep is None else fits & keep)
            key, number = np.unique(grams(hashes, n)[at] >> U(64 - bits), return_inverse=True)
            self.at[n], self.key[n], self.number[n] = at, key, number.astype(np.int32)

    def rows(self, block: int) -> pa.Table:
        """The distinct n-grams of all orders with their counts here."""
        key = np.concatenate([*self.key.values(), np.zeros(0, U)])
        count = np.concatenate([self.count(n) for n in self.key] or [np.zeros(0, np.int64)])
        return pa.table({"block": pa.array(np.full(len(key), block, np.int64)), "key": pa.array(key.view(np.int64)), "count": pa.array(count)})

    def count(self, n: int) -> np.ndarray:
        return np.bincount(self.number[n], minlength=len(self.key[n])).astype(np.int64)


class Totals:
    """Counts in the whole corpus of those n-grams of a block that other blocks have too."""

    def __init__(self, table: pa.Table):
        key = table.column("key").to_numpy().view(U)
        order = np.argsort(key)
        self.key, self.total = key[order], table.column("total").to_numpy()[order]

    def abroad(self, g: Grams, words: Words, n: int) -> np.ndarray:
        """For each word place, whether other blocks have the n-gram that starts there."""
        out = np.zeros(len(words.start), bool)
        if len(self.key) and len(g.key[n]):
            at = np.minimum(np.searchsorted(self.key, g.key[n]), len(self.key) - 1)
            out[g.at[n]] = (self.key[at] == g.key[n])[g.number[n]]
        return out

    def elsewhere(self, g: Grams, words: Words, n: int) -> np.ndarray:
        """For each word place, how often the n-gram that starts there occurs in other documents (0 where none starts)."""
        key, number, here = g.key[n], g.number[n], g.count(n)
        total, full = here, np.zeros(len(words.start), np.int64)
        if len(key):
            if len(self.key):
                at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
                total = np.where(self.key[at] == key, self.total[at], here)
            full[g.at[n]] = total[number] - 1
            several = np.flatnonzero(here[number] > 1)  # the others occur once in the block, so once in their document
            pair = words.row_of_word()[g.at[n][several]] * len(key) + number[several]
            _, inverse, own = np.unique(pair, return_inverse=True, return_counts=True)
            full[g.at[n][several]] -= own[inverse] - 1
        return full


def sizes(batches):
    """Bytes and words of slices of texts, by class."""
    for b in slices(batches, "text", 1 << 20):
        w, k = Words(b.column(1)), b.column(0).to_numpy()
        parts = [pa.array(np.bincount(k, x, CLASSES).astype(np.int64)) for x in (np.diff(w.rows), w.count)]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(CLASSES)), *parts], ["k", "b", "n"])


def explode_low(table: pa.Table, bits: int) -> pa.Table:
    """Words and word pairs of a block."""
    w = Words(table.column("text"))
    return Grams(w, w.hashes(), (1, 2), bits).rows(table.column("block")[0].as_py())


def possible(ok: np.ndarray, n: int) -> np.ndarray:
    """Places where an n-gram may occur elsewhere: all its word pairs do."""
    out = ok.copy()
    for j in range(1, n - 1):
        out[: len(ok) - j] &= ok[j:]
        out[max(0, len(ok) - j) :] = False
    return out


def explode_high(table: pa.Table, totals: pa.Table, order: int, bits: int) -> pa.Table:
    """Longer n-grams of a block, without those that hold a word pair no other block has: their count here is their total."""
    w = Words(table.column("text"))
    h = w.hashes()
    pairs = Totals(totals).abroad(Grams(w, h, (2,), bits), w, 2)
    parts = [Grams(w, h, (n,), bits, possible(pairs, n)).rows(table.column("block")[0].as_py()) for n in range(3, order + 1)]
    return pa.concat_tables(parts) if parts else Grams(w, h, (), bits).rows(0)


def score(table: pa.Table, totals: pa.Table, order: int, alpha: float, bits: int) -> pa.Table:
    w = Words(table.column("text"))
    h, n_words, row = w.hashes(), w.count, w.row_of_word()
    everything = int(table.column("n")[0].as_py() or 0)
    rest = (everything - n_words)[row]
    known_totals = Totals(totals)
    context = known_totals.elsewhere(Grams(w, h, (1,), bits), w, 1)
    value = np.where(context > 0, context / np.maximum(rest, 1), 1.0 / (rest + 1.0))
    place = np.arange(len(row)) - w.first[:-1][row]
    # from single words up: the longest context whose n-gram is known decides
    pairs = None
    for n in range(2, order + 1):
        whole = known_totals.elsewhere(Grams(w, h, (n,), bits, None if n == 2 else possible(pairs, n)), w, n)
        pairs = whole > 0 if n == 2 else pairs
        can = np.flatnonzero(place >= n - 1)
        start = can - (n - 1)
        value[can] = np.where(whole[start] > 0, whole[start] / np.maximum(context[start], 1), alpha * value[can])
        context = whole
    logs = np.bincount(row, np.log(value), minlength=len(n_words)) if len(row) else np.zeros(len(n_words))
    mean = pa.array(logs / np.maximum(n_words, 1), mask=n_words == 0)
    known = table.column("known").to_numpy(zero_copy_only=False)
    return pa.table({"id": pa.array(table.column("id").to_numpy(), mask=~known), "n_words": pa.array(n_words.astype(np.int64)), "log_score": pa.array(logs), "mean_log_score": mean})


def with_totals(exploded: DataFrame, shards: int) -> DataFrame:
    """(block, key, total) of the n-grams that several blocks have: exploded rows (block, key, count) with the sum of the counts of their key.

    The sum is a window by key, which reads and sorts the exchange by key once; a count table joined to the rows it came from reads it twice and sorts both sides.
    """
    total = F.sum("count").over(Window.partitionBy("key"))
    return exploded.repartition(shards, "key").withColumn("total", total).filter("count < total").select("block", "key", "total")


def stupid_backoff(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", order: int = 3, alpha: float = 0.4, block_bytes: int = 8 << 20, shard_bytes: int = 16 << 20, alike: str | None = None) -> DataFrame:
    """(doc_id, n_words, log_score, mean_log_score), natural logarithms; counts come from all of docs.

    block_bytes of text are exploded together, the count tables have a partition for each shard_bytes of text (PARTITIONS at most).
    alike: a column; documents with the same value share blocks (values in CLASSES classes by hash). It changes how many rows are exchanged, never a score.
    """
    kind = integer_id(docs, doc_id)
    group = F.pmod(F.xxhash64(F.col(alike)), F.lit(CLASSES)).cast("int") if alike else F.lit(0)
    sums = docs.select(group.alias("k"), F.col(text).alias("text")).mapInArrow(sizes, "k long, b long, n long").groupBy("k").agg(F.sum("b").alias("b"), F.sum("n").alias("n")).collect()
    total, n = sum(r["b"] for r in sums), sum(r["n"] for r in sums)
    bits = min(64, n.bit_length() + 30)
    each = np.ones(CLASSES, np.int64)  # blocks of each class, numbered one class after the other
    for r in sums:
        each[r["k"]] = pieces(r["b"], block_bytes)
    first = np.cumsum(each) - each
    shards = min(PARTITIONS, pieces(total, shard_bytes))
    spread = min(PARTITIONS, sum(pieces(r["b"], block_bytes) for r in sums if r["b"]) or 1)
    rows = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(0)).alias("id"), F.col(doc_id).isNotNull().alias("known"), F.col(text).alias("text"), F.lit(n).cast("long").alias("n"), group.alias("k"))
    of = lambda x: F.array(*map(F.lit, x.tolist()))[F.col("k")]
    rows = rows.withColumn("block", of(first) + F.pmod(F.when(F.col("known"), F.xxhash64("id")).otherwise(F.xxhash64("text")), of(each))).drop("k").repartition(spread, "block")
    low = with_totals(rows.groupBy("block").applyInArrow(lambda t: explode_low(t, bits), EXPLODED), shards).repartition(spread, "block")
    totals = low
    if order > 2:
        high = rows.groupBy("block").cogroup(low.groupBy("block")).applyInArrow(lambda t, a: explode_high(t, a, order, bits), EXPLODED)
        totals = low.unionByName(with_totals(high, shards).repartition(spread, "block"))
    out = rows.groupBy("block").cogroup(totals.groupBy("block")).applyInArrow(lambda t, a: score(t, a, order, alpha, bits), "id long, n_words long, log_score double, mean_log_score double")
    return out.withColumn("id", F.col("id").cast(kind)).withColumnRenamed("id", doc_id)


def op2_lm_scoring(spark, sf_dir: str) -> DataFrame:
    out = stupid_backoff(spark.read.parquet(f"{sf_dir}/documents.parquet"), alike="lang")
    return out.select("doc_id", "n_words", F.round("log_score", 3).alias("log_score"), F.round("mean_log_score", 6).alias("mean_log_score"))


#: The same rows in DuckDB.
ORACLE = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
t AS (SELECT doc_id, len(ws) AS n, unnest(ws) AS w3, unnest(range(1, len(ws) + 1)) AS i FROM w),
g AS (SELECT *, lag(w3) OVER d AS w2, lag(w3, 2) OVER d AS w1 FROM t WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
o1 AS (SELECT doc_id, w3, count(*) AS c FROM g GROUP BY ALL), a1 AS (SELECT w3, sum(c) AS c FROM o1 GROUP BY ALL),
o2 AS (SELECT doc_id, w2, w3, count(*) AS c FROM g WHERE i > 1 GROUP BY ALL), a2 AS (SELECT w2, w3, sum(c) AS c FROM o2 GROUP BY ALL),
o3 AS (SELECT doc_id, w1, w2, w3, count(*) AS c FROM g WHERE i > 2 GROUP BY ALL), a3 AS (SELECT w1, w2, w3, sum(c) AS c FROM o3 GROUP BY ALL),
l1 AS (SELECT doc_id, w3, a1.c - o1.c AS c FROM o1 JOIN a1 USING (w3)),
l2 AS (SELECT doc_id, w2, w3, a2.c - o2.c AS c FROM o2 JOIN a2 USING (w2, w3)),
l3 AS (SELECT doc_id, w1, w2, w3, a3.c - o3.c AS c FROM o3 JOIN a3 USING (w1, w2, w3)),
s AS (SELECT g.doc_id, (SELECT sum(len(ws)) FROM w) - g.n AS r, u.c AS c1, p.c AS h1, b.c AS c2, q.c AS h2, x.c AS c3
 FROM g JOIN l1 u ON g.doc_id = u.doc_id AND g.w3 = u.w3
 LEFT JOIN l1 p ON g.doc_id = p.doc_id AND g.w2 = p.w3
 LEFT JOIN l2 b ON g.doc_id = b.doc_id AND g.w2 = b.w2 AND g.w3 = b.w3
 LEFT JOIN l2 q ON g.doc_id = q.doc_id AND g.w1 = q.w2 AND g.w2 = q.w3
 LEFT JOIN l3 x ON g.doc_id = x.doc_id AND g.w1 = x.w1 AND g.w2 = x.w2 AND g.w3 = x.w3),
v1 AS (SELECT *, CASE WHEN c1 > 0 THEN CAST(c1 AS DOUBLE) / r ELSE 1.0::DOUBLE / (r + 1) END AS s1 FROM s),
v2 AS (SELECT *, CASE WHEN c2 IS NULL THEN s1 WHEN c2 > 0 THEN CAST(c2 AS DOUBLE) / h1 ELSE 0.4::DOUBLE * s1 END AS s2 FROM v1),
v3 AS (SELECT doc_id, CASE WHEN c3 IS NULL THEN s2 WHEN c3 > 0 THEN CAST(c3 AS DOUBLE) / h2 ELSE 0.4::DOUBLE * s2 END AS s3 FROM v2),
z AS (SELECT doc_id, sum(ln(s3)) AS l FROM v3 GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, round(coalesce(l, 0), 3) AS log_score, round(l / len(ws), 6) AS mean_log_score
FROM w LEFT JOIN z ON w.doc_id = z.doc_id
"""
