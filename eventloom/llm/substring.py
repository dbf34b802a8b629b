"""Substring dedup by an FM-index per shard.

A window is k (13) consecutive words of a document. Every word covered by a window whose word sequence
also starts in a document with a smaller id is removed; windows are judged on the input.

Documents are dealt into blocks of bounded size. A block cuts each document into runs: maximal stretches
of windows with the same minimizer (the smallest hash of `seed` consecutive words in a window), so equal
windows always fall into runs with equal minimizers, and a run goes to the one shard its minimizer names. The work
is linear in the input: no document is matched against every shard. Blocks first ask which of their minimizers occur in
other blocks; runs that share theirs with no other run are not sent. Equal runs of a block travel once, with the smallest
and largest id that hold them, so a passage shared by a third of all documents is sent at most once per block.

A shard drops runs whose minimizer nothing else shares, indexes the distinct rest (wavelet matrix over the BWT of word numbers,
smallest document of each range of equal windows; the suffix order is not kept) and streams the runs through backward search. Windows that match are
reported with the smallest id that holds them. Blocks get back what concerns their runs and mark words.

Words are compared by 64-bit hashes. Null and empty texts have no words. Documents with fewer than k words keep all.
Ids are integers; another type raises ValueError. A null id ranks after all others (several such rows do not remove each other's words). Repeated rows with
one id are judged alike. Columns besides id and text stay out of the result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import integer_id, pieces, text_total
from eventloom.llm.fm_index import FmIndex, shared_windows
from eventloom.llm.packing import narrow, pack, planes, shard_cuts, unpack, unplanes
from eventloom.llm.words import U, Words, grams, mix, span_hashes

LAST = np.iinfo(np.int64).max


def spread(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[i], first[i] + 1, ... for n[i] entries each."""
    total = np.cumsum(n)
    return np.repeat(first - total + n, n) + np.arange(total[-1] if len(total) else 0)


class Runs:
    """The runs of a block: start and end word, document row, and the number of the distinct run each one is."""

    def __init__(self, words: Words, k: int, seed: int):
        h = words.hashes()
        n = np.maximum(words.count - (k - 1), 0)
        at = spread(words.first[:-1], n)  # starts of all windows
        row = np.repeat(np.arange(len(n)), n)
        self.hashes = h
        if not len(at):
            self.start = self.end = self.row = self.number = np.zeros(0, np.int64)
            self.key, self.of, self.seed = np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, U)
            return
        least = window_minimum(grams(h, seed), k - seed + 1)[at]
        new = np.ones(len(at), bool)
        new[1:] = (least[1:] != least[:-1]) | (row[1:] != row[:-1])
        first = np.flatnonzero(new)
        self.start, self.row = at[first], row[first]
        self.end = at[np.append(first[1:], len(at)) - 1] + k
        self.key, self.of, self.number = np.unique(span_hashes(h, self.start, self.end), return_index=True, return_inverse=True)
        self.seed = mix(least[first][self.of])  # by distinct run


def window_minimum(g: np.ndarray, w: int) -> np.ndarray:
    """Minimum of w entries from each place on."""
    span, m = 1, g
    while span * 2 <= w:
        m = np.minimum(m[: len(m) - span], m[span:])
        span *= 2
    return np.minimum(m[: len(m) - (w - span)], m[w - span :]) if w > span else m


def send_seeds(table: pa.Table, k: int, seed: int, shards: int) -> pa.Table:
    """A block's distinct minimizers, one row per shard (a range of hashes)."""
    key = np.unique(Runs(Words(table.column("text")), k, seed).seed)
    cut = shard_cuts(key, shards)
    full = np.flatnonzero(np.diff(cut))
    block = table.column("block")[0].as_py()
    return pa.table({"shard": pa.array(full), "block": pa.array([block] * len(full), pa.int64()), "body": pa.array([pack(planes(key[cut[i] : cut[i + 1]])) for i in full], pa.binary())})


def shared_seeds(table: pa.Table) -> pa.Table:
    """A shard: answers each block which of its minimizers another block has too, one bit each."""
    keys = [unplanes(unpack(x.as_py())[0]) for x in table.column("body")]
    _, inverse, count = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
    shared = np.split(count[inverse] > 1, np.cumsum([len(k) for k in keys])[:-1])
    body = [pack(np.array([len(x)]), np.packbits(x)) for x in shared]
    return pa.table({"shard": table.column("shard"), "block": table.column("block"), "body": pa.array(body, pa.binary())})


def send(table: pa.Table, answers: pa.Table, k: int, seed: int, shards: int) -> pa.Table:
    """A block's distinct runs that may have a partner, one row per shard."""
    if not table.num_rows:
        return pa.table({"shard": pa.array([], pa.int64()), "block": pa.array([], pa.int64()), "body": pa.array([], pa.binary())})
    ids = table.column("id").to_numpy()
    runs = Runs(Words(table.column("text")), k, seed)
    n = len(runs.key)
    low, high = np.full(n, LAST), np.full(n, np.iinfo(np.int64).min)
    np.minimum.at(low, runs.number, ids[runs.row])
    np.maximum.at(high, runs.number, ids[runs.row])
    _, seed_of, count = np.unique(runs.seed, return_inverse=True, return_counts=True)
    bits = [unpack(x.as_py()) for _, x in sorted(zip(answers.column("shard").to_pylist(), answers.column("body"), strict=True), key=lambda p: p[0])]
    shared = np.concatenate([np.unpackbits(x, count=int(m[0])) for m, x in bits]).astype(bool) if bits else np.zeros(0, bool)
    live = np.flatnonzero(shared[seed_of] | (count[seed_of] > 1) | (low < high)) if n else np.zeros(0, np.int64)
    shard = (runs.seed % U(shards)).astype(np.int64)
    live = live[np.argsort(shard[live], kind="stable")]
    to, what = [], []
    for part in np.split(live, np.flatnonzero(np.diff(shard[live])) + 1) if len(live) else []:
        a, b = runs.start[runs.of[part]], runs.end[runs.of[part]]
        book, code = np.unique(runs.hashes[spread(a, b - a)], return_inverse=True)
        to.append(int(shard[part[0]]))
        what.append(pack(narrow(part), narrow(b - a), low[part], high[part], book, narrow(code)))
    block = table.column("block")[0].as_py()
    return pa.table({"shard": pa.array(to, pa.int64()), "block": pa.array([block] * len(to), pa.int64()), "body": pa.array(what, pa.binary())})


def search(table: pa.Table, k: int, seed: int) -> pa.Table:
    """A shard: indexes its runs and returns, per block, the windows of its runs that a smaller id holds."""
    blocks = table.column("block").to_pylist()
    bodies = table.column("body")
    parts = []
    for b in range(len(blocks)):
        name, size, low, high, book, code = unpack(bodies[b].as_py())
        size = size.astype(np.int64)
        parts.append((name, size, low, high, book[code], np.full(len(name), b)))
    name = np.concatenate([p[0].astype(np.int64) for p in parts])
    size, low, high, h, home = (np.concatenate([p[i] for p in parts]) for i in range(1, 6))
    del parts
    start = np.cumsum(size) - size
    # runs whose minimizer no other run has, and that one document holds, have no partner
    g = grams(h, seed)
    least = g[start]
    for j in range(1, k - seed + 1):
        np.minimum(least, g[start + j], out=least)
    _, inverse, count = np.unique(least, return_inverse=True, return_counts=True)
    live = np.flatnonzero((count[inverse] > 1) | (low < high))
    del g
    body = np.unique(span_hashes(h, start[live], start[live] + size[live]), return_index=True, return_inverse=True)
    of, number = live[body[1]], body[2]
    n = len(of)
    if not n:
        return pa.table({"block": pa.array([], pa.int64()), "body": pa.array([], pa.binary())})
    least_id, most_id = np.full(n, LAST), np.full(n, np.iinfo(np.int64).min)
    np.minimum.at(least_id, number, low[live])
    np.maximum.at(most_id, number, high[live])
    length = size[of]
    text = np.zeros(int((length + 1).sum()), np.int64)
    at = np.cumsum(length + 1) - length - 1
    text[spread(at, length)] = np.unique(h[spread(start[of], length)], return_inverse=True)[1] + 1
    del h
    index = FmIndex(text, k, np.repeat(least_id, length + 1))
    del text
    who, end, low_rank, _ = shared_windows(index, at, at + length, k)
    windows = length - k + 1
    first = np.cumsum(windows) - windows
    best = np.repeat(least_id, windows)
    place = first[who] + end - at[who] - (k - 1)
    best[place] = np.minimum(best[place], index.least_owner(low_rank))
    # only runs with a window that concerns one of their documents go back
    useful = np.minimum.reduceat(best, first)[number] < high[live]
    back, run = live[useful], number[useful]
    to, what = [], []
    for part in np.split(np.arange(len(back)), np.flatnonzero(np.diff(home[back])) + 1) if len(back) else []:
        r = run[part]
        to.append(blocks[home[back[part[0]]]])
        values, code = np.unique(best[spread(first[r], windows[r])], return_inverse=True)
        what.append(pack(narrow(name[back[part]]), narrow(windows[r]), values, narrow(code)))
    return pa.table({"block": pa.array(to, pa.int64()), "body": pa.array(what, pa.binary())})


def remove(table: pa.Table, answers: pa.Table, k: int, seed: int) -> pa.Table:
    """A block: marks the words of windows that a smaller id holds, and leaves them out."""
    ids = table.column("id").to_numpy()
    words = Words(table.column("text"))
    runs = Runs(words, k, seed)
    total = len(words.start)
    cover = np.zeros(total + 1, np.int32)
    got = [unpack(x.as_py()) for x in answers.column("body")] if answers.num_rows else []
    if got:
        name = np.concatenate([x[0].astype(np.int64) for x in got])
        windows = np.concatenate([x[1].astype(np.int64) for x in got])
        best = np.concatenate([x[2][x[3]] for x in got])
        answer = np.full(len(runs.key), -1)
        answer[name] = np.arange(len(name))
        first = np.cumsum(windows) - windows
        mine = np.flatnonzero(answer[runs.number] >= 0)
        a = answer[runs.number[mine]]
        n = windows[a]
        at, value = spread(runs.start[mine], n), best[spread(first[a], n)]
        hit = at[value < np.repeat(ids[runs.row[mine]], n)]
        np.add.at(cover, hit, 1)
        np.subtract.at(cover, hit + k, 1)
    gone = np.cumsum(cover[:-1]) > 0
    removed = np.add.reduceat(np.append(gone, False).astype(np.int64), np.minimum(words.first[:-1], total)) * (words.count > 0) if len(ids) else words.count
    known = table.column("known")
    return pa.table({"id": pa.array(ids, mask=~known.to_numpy(zero_copy_only=False)), "n_words": pa.array(words.count.astype(np.int64)), "n_removed": pa.array(removed), "kept_text": pa.array(words.join(~gone), pa.string())})


def substring_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 13, seed: int = 4, block_bytes: int = 4 << 20, shard_bytes: int = 16 << 20) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text), one row per document."""
    kind = integer_id(docs, doc_id)
    total = text_total(docs, text)
    blocks, shards = pieces(total, block_bytes), pieces(total, shard_bytes)
    rows = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(int(LAST))).alias("id"), F.col(doc_id).isNotNull().alias("known"), F.col(text).alias("text"))
    rows = rows.withColumn("block", F.pmod(F.when(F.col("known"), F.xxhash64("id")).otherwise(F.xxhash64("text")), F.lit(blocks)))
    message = "shard long, block long, body binary"
    seeds = rows.groupBy("block").applyInArrow(lambda t: send_seeds(t, k, seed, shards), message)
    shared = seeds.groupBy("shard").applyInArrow(shared_seeds, message)
    sent = rows.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(lambda t, a: send(t, a, k, seed, shards), message)
    answers = sent.groupBy("shard").applyInArrow(lambda t: search(t, k, seed), "block long, body binary")
    both = rows.groupBy("block").cogroup(answers.groupBy("block"))
    out = both.applyInArrow(lambda t, a: remove(t, a, k, seed), "id long, n_words long, n_removed long, kept_text string")
    return out.withColumn("id", F.col("id").cast(kind)).withColumnRenamed("id", doc_id)


def op1_substring_dedup(spark, sf_dir: str) -> DataFrame:
    out = substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept_text", "utf-8"), 256).alias("kept_sha256"))
