"""Byte-level BPE encoding and decoding on length-bucketed, padded numpy matrices.

A text is cut by a pattern; each piece is encoded on its own. A piece that is a token as a whole becomes
that token. All others start as single bytes, one row of a matrix each, in buckets of like length. Every
round looks up the rank of all neighbouring pairs in a hash table, merges the leftmost pair of the
smallest rank in every row and closes the gap; rows without a mergeable pair leave the matrix. Pieces are
encoded once per batch and kept in a bounded table of the worker. A piece of over LONG bytes would need as many rounds over as
long a row; it is merged in the same order from a heap of its pairs, so that time stays near linear in its length.

Decoding concatenates the bytes of the ids. Nulls are empty texts and give no ids; rows are encoded one
by one, so ties and repeated rows need no care. Extra columns stay out of the result. Special tokens
are never produced: their strings are ordinary text.
"""

from __future__ import annotations

import base64
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.words import slices

NONE = np.int32(1 << 30)  # the rank of what is no token
_EMPTY = np.int64(-1)
#: Bytes of the longest row of a matrix.
LONG = 1 << 12
#: Pieces of more characters do not stay in the table of a worker.
KEPT = 64


def default_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


class PairTable:
    """(left id, right id) -> id of the merged token, by open addressing with linear probing."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(len(keys) * 4).bit_length())
        self.keys = np.full(1 << self.bits, _EMPTY)
        self.values = np.full(1 << self.bits, NONE, np.int32)
        at, todo = self.slot(keys), np.arange(len(keys))
        while len(todo):
            free = self.keys[at[todo]] == _EMPTY
            self.keys[at[todo[free]]] = keys[todo[free]]  # of several claims to a slot, the last one holds
            done = self.keys[at[todo]] == keys[todo]
            self.values[at[todo[done]]] = values[todo[done]]
            todo = todo[~done]
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """left and right: flat ids, negative where there is none."""
        keys = (left.astype(np.int64) << 24) | right
        keys[(left < 0) | (right < 0)] = -2
        out, at = np.full(len(keys), NONE), self.slot(keys)
        found = self.keys[at]
        hit = found == keys
        out[hit] = self.values[at[hit]]
        todo = np.flatnonzero(~hit & (found != _EMPTY) & (keys >= 0))
        while len(todo):
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)
            found = self.keys[at[todo]]
            hit = found == keys[todo]
            out[todo[hit]] = self.values[at[todo[hit]]]
            todo = todo[~hit & (found != _EMPTY)]
        return out


class ByteBpe:
    """Ranks as in a rank file: a line has a token in base64 and its rank, which is its id."""

    def __init__(self, path: str, pattern: str, cached: int = 1 << 19, cells: int = 1 << 21):
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.find = regex.compile(pattern).findall
        self.token = {v: k for k, v in self.ranks.items()}
        self.byte = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        left, right, whole = [], [], []
        for t, r in self.ranks.items():
            for i in range(1, len(t)):
                a, b = self.ranks.get(t[:i]), self.ranks.get(t[i:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), whole.append(r)
        self.pairs = PairTable((np.array(left, np.int64) << 24) | np.array(right, np.int64), np.array(whole, np.int64))
        self.rank_of: dict[int, int] = {}
        self.kept: dict[str, bytes] = {}
        self.cached, self.cells = cached, cells

    def merge(self, rows: list[bytes]) -> list[bytes]:
        """Ids, as bytes, of pieces of like length: one padded matrix, one merge in each row a round."""
        size = np.array([len(r) for r in rows])
        ids = np.full((len(rows), size.max()), -1, np.int32)
        ids[np.arange(ids.shape[1]) < size[:, None]] = self.byte[np.frombuffer(b"".join(rows), np.uint8)]
        out: list = [None] * len(rows)
        who = np.arange(len(rows))
        rank = self.pairs.get(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(rows), -1)
        while True:
            at = rank.argmin(1)
            line = np.arange(len(who))
            best = rank[line, at]
            over = best == NONE
            if over.any():
                done = ids[over]
                ends = np.cumsum((done >= 0).sum(1)) * 4
                raw = done[done >= 0].tobytes()
                for i, x, y in zip(who[over].tolist(), [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                    out[i] = raw[x:y]
                ids, rank, who, at, best = (x[~over] for x in (ids, rank, who, at, best))
                line = np.arange(len(who))
                if not len(who):
                    return out
            ids[line, at] = best
            # close the gap: each row loses the cell after the merged one, and the rank of the merged pair
            keep = np.ones(ids.shape, bool)
            keep[line, at + 1] = False
            ids = ids[keep].reshape(len(who), -1)
            if ids.shape[1] == 1:
                rank = np.full((len(who), 1), NONE)
                continue
            keep = np.ones(rank.shape, bool)
            keep[line, at] = False
            rank = rank[keep].reshape(len(who), -1)
            # only the pairs on either side of the new token have another rank
            has = np.flatnonzero(at + 1 < ids.shape[1])
            rank[has, at[has]] = self.pairs.get(ids[has, at[has]], ids[has, at[has] + 1])
            has = np.flatnonzero(at > 0)
            rank[has, at[has] - 1] = self.pairs.get(ids[has, at[has] - 1], ids[has, at[has]])

    def merge_long(self, raw: bytes) -> bytes:
        """Ids, as bytes, of one piece: a heap of (rank, place) gives the leftmost pair of the smallest rank, stale entries are passed over."""
        if not self.rank_of:
            used = self.pairs.keys != _EMPTY
            self.rank_of = dict(zip(self.pairs.keys[used].tolist(), self.pairs.values[used].tolist(), strict=True))
        flat = self.byte[np.frombuffer(raw, np.uint8)]
        ranks = self.pairs.get(flat[:-1], flat[1:])
        rank, ids, n = [*ranks.tolist(), int(NONE)], flat.tolist(), len(raw)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r << 32) | i for i, r in enumerate(rank) if r != NONE]
        heapq.heapify(heap)

        def look(i: int) -> None:
            j = after[i]
            rank[i] = r = self.rank_of.get((ids[i] << 24) | ids[j], int(NONE)) if j < n else int(NONE)
            if r != NONE:
                heapq.heappush(heap, (r << 32) | i)

        while heap:
            top = heapq.heappop(heap)
            r, i = top >> 32, top & 0xFFFFFFFF
            if rank[i] != r:
                continue
            gone = after[i]
            ids[i], after[i], rank[gone], ids[gone] = r, after[gone], -1, -1
            if after[i] < n:
                before[after[i]] = i
            look(i)
            if before[i] >= 0:
                look(before[i])
        return np.array([x for x in ids if x >= 0], "<u4").tobytes()

    def learn(self, pieces: list[str]) -> None:
        """Encodes distinct pieces into self.kept."""
        buckets: dict[int, list[tuple[str, bytes]]] = {}
        for p in pieces:
            raw = p.encode()
            whole = self.ranks.get(raw)
            if whole is not None:
                self.kept[p] = whole.to_bytes(4, "little")
            elif len(raw) > LONG:
                self.kept[p] = self.merge_long(raw)
            else:
                buckets.setdefault((len(raw) - 1).bit_length(), []).append((p, raw))
        for bits, group in buckets.items():
            step = max(1, self.cells >> bits)
            for i in range(0, len(group), step):
                part = group[i : i + step]
                for (p, _), ids in zip(part, self.merge([r for _, r in part]), strict=True):
                    self.kept[p] = ids

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.kept) > self.cached:
            self.kept.clear()
        found = [self.find(t) for t in texts]
        new = set()
        for x in found:
            new.update(x)
        self.learn([p for p in new if p not in self.kept])
        get = self.kept.__getitem__
        out = [np.frombuffer(b"".join(map(get, x)), "<u4") for x in found]
        # in scripts without spaces a piece may be a whole text: these are encoded again rather than kept
        for p in new:
            if len(p) > KEPT:
                del self.kept[p]
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.token.__getitem__, ids.tolist()))


_coders: dict[tuple, ByteBpe] = {}


def coder(path: str, pattern: str) -> ByteBpe:
    """One coder per worker process and vocabulary."""
    if (path, pattern) not in _coders:
        _coders[path, pattern] = ByteBpe(path, pattern)
    return _coders[path, pattern]


def encode(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None, pattern: str | None = None, decoded: bool = False) -> DataFrame:
    """(doc_id, ids), ids array<int>; with decoded also the bytes that the ids stand for. path must be readable on executors."""
    own, cut = default_vocabulary() if path is None or pattern is None else (path, pattern)
    path, pattern = path or own, pattern or cut

    def run(batches):
        c = coder(path, pattern)
        for b in slices(batches, "text", 2 << 20):
            ids = c.encode([t or "" for t in b.column(1).to_pylist()])
            off = np.zeros(len(ids) + 1, np.int32)
            np.cumsum([len(x) for x in ids], out=off[1:])
            flat = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
            cols = [b.column(0), pa.ListArray.from_arrays(pa.array(off), pa.array(flat.astype(np.int32)))]
            if decoded:
                cols.append(pa.array([c.decode(x) for x in ids], pa.binary()))
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "ids", "decoded"][: len(cols)])

    kind = dict(docs.select(doc_id).dtypes)[doc_id]
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    out = rows.mapInArrow(run, f"doc_id {kind}, ids array<int>" + ", decoded binary" * decoded)
    return out.withColumnRenamed("doc_id", doc_id)


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256), by the same coder; ids stay in the worker."""
    import hashlib

    own, cut = default_vocabulary() if path is None or pattern is None else (path, pattern)
    path, pattern = path or own, pattern or cut

    def run(batches):
        c = coder(path, pattern)
        for b in slices(batches, "text", 2 << 20):
            ids = c.encode([t or "" for t in b.column(1).to_pylist()])
            cols = [b.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids], pa.string()), pa.array([hashlib.sha256(c.decode(x)).hexdigest() for x in ids], pa.string())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = dict(docs.select(doc_id).dtypes)[doc_id]
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("doc_id", doc_id)


def op7_byte_bpe(spark, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
