"""Phrase collocations by partitioned mining, level by level.

Texts fall into shards of bounded size. For phrases of 2, 3 and 4 words in turn, each shard is mined completely for those that grow from frequent
shorter ones and whose local count reaches the shard's share of the support: count / support >= bytes of the shard / bytes of all texts. A phrase below
that share in every shard is below the support, so the union of what shards report holds every frequent phrase of the level. All of that union is then counted
exactly over all texts, and the phrases of `support` or more, found exactly, are what the next level grows from. Single words are counted outright.
Where the share leaves a local support of 1 (at 15 shards or more it is under 2), every phrase of a shard is locally frequent; the union is then not written down, and
all that grow from frequent ones are counted. This is linear: measured on 0.1 GB, half a (hash, count) row a word for all levels together.

Phrases travel as 64-bit hashes of (lang, words). A union or level is known to tasks as a bit table of a bounded size (`most_bits`), 16 bits a phrase; a
phrase that meets a set bit by chance is counted as well, exactly, and dropped by the support. Shards send each distinct phrase once with its count, so
that a frequent phrase or a hot lang makes no long group.

Null texts have no words, a null lang is `und`. A lang without frequent phrases of 2 words has no rows; an empty table has none. Ids are not read. Repeated
rows count each time. Other columns, whatever their names, stay out.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventloom.llm.common import remove_written, text_total, written
from eventloom.llm.words import U, LOWER, Words, mix, slices, span_hashes, text_bytes

#: Words of the longest phrase.
MOST = 4
_BREAKS = np.zeros(256, bool)
_BREAKS[[*b".,;:!?", 10, 11, 12, 13]] = True
_WORDS = LOWER.copy()
_WORDS[_BREAKS] = 32


class Pieces:
    """The words of a text column by lang: hash with lang, words left in the piece (at most MOST), and the raw words."""

    def __init__(self, batch: pa.RecordBatch):
        data, rows = text_bytes(batch.column(0))
        n = len(rows) - 1
        raw = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(rows.astype(np.int64)), pa.py_buffer(_WORDS[data])])
        self.words = Words(raw)
        langs, at = text_bytes(batch.column(1).fill_null("und"))
        self.lang = mix(span_hashes(mix(langs.astype(U) + U(1)), at[:-1], at[1:])) if len(langs) else np.zeros(n, U)
        row = self.words.row_of_word()
        self.hash = mix(self.words.hashes() ^ self.lang[row])
        m = len(self.hash)
        breaks = np.zeros(len(data) + 1, np.int32)
        np.cumsum(_BREAKS[data], out=breaks[1:])
        piece = breaks[self.words.start]
        same = np.zeros(m, bool)  # the next word continues the piece
        same[:-1] = (piece[1:] == piece[:-1]) & (row[1:] == row[:-1])
        self.left = np.ones(m, np.uint8)
        for _ in range(MOST - 1):
            self.left[:-1] = np.where(same[:-1], np.minimum(self.left[1:] + 1, MOST), 1)


class Bits:
    """A bit per hash value modulo a power of two; a set bit may belong to another hash."""

    def __init__(self, packed: np.ndarray):
        self.packed = packed

    def has(self, key: np.ndarray) -> np.ndarray:
        out = np.zeros(len(key), bool)
        for i in range(0, len(key), 1 << 19):
            at = key[i : i + (1 << 19)] & U(len(self.packed) * 8 - 1)
            out[i : i + len(at)] = (self.packed[(at >> U(3)).astype(np.int64)] >> (at & U(7)).astype(np.uint8)) & 1 > 0
        return out


def grown(h: np.ndarray, left: np.ndarray, levels: list[Bits]):
    """(places, hashes) of phrases of 1, 2, ... len(levels) + 1 words: a longer one only where both shorter ones, from its first and second word on, are in their level."""
    at, key = np.arange(len(h), dtype=np.int32), h
    yield at, key
    for m, level in enumerate(levels, 1):
        good = level.has(key)
        at, key = at[good], key[good]
        kept = np.zeros(len(h) + 1, bool)
        kept[at] = True
        grows = kept[at + 1] & (left[at] > m)
        at, key = at[grows], key[grows]
        key = mix(key * U(0x9E3779B97F4A7C15) + h[at + m] + U(m + 1))
        yield at, key


def last(steps):
    """The last of an iterator's values; earlier ones are let go."""
    value = None
    for value in steps:
        pass
    return value


def shards(batches, limit: int):
    """(hashes, words left, bytes, {lang hash: words}) of about `limit` bytes of text; a longer text is a shard of its own."""
    held, size, langs = [], 0, {}

    def joined():
        h, left = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        return h, left

    for batch in slices(batches, "text", 1 << 20):
        p = Pieces(batch)
        held.append((p.hash, p.left))
        size += len(p.words.data)
        names, inverse = np.unique(p.lang, return_inverse=True)
        for name, n in zip(names.tolist(), np.bincount(inverse, p.words.count, len(names)).astype(np.int64).tolist(), strict=True):
            langs[name] = langs.get(name, 0) + n
        del p
        if size >= limit:
            yield *joined(), size, langs
            size, langs = 0, {}
    if held:
        yield *joined(), size, langs


def _rows(**columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c.view(np.int64) if c.dtype == U else c) for c in columns.values()], list(columns))


def mined(batches, levels, support: int, total: int, limit: int):
    """Hashes of the next level's phrases that are frequent in a shard of this task."""
    for h, left, size, _ in shards(batches, limit):
        least = max(1, -(-support * size // max(total, 1)))
        order = np.sort(last(grown(h, left, levels.value))[1])
        if least <= len(order):
            often = order[: len(order) - least + 1]
            yield _rows(hash=np.unique(often[often == order[least - 1 :]]))


def bits_of(hashes: DataFrame, n: int, most_bits: int, segments: int = 64) -> Bits:
    """The bits of n hashes: 16 bits for each, at least 2^16 and at most most_bits in all. Segments are made in tasks; the driver joins most_bits / 8 bytes."""
    size = min(max(1 << 16, 1 << (16 * max(n, 1) - 1).bit_length()), most_bits)
    each = size // segments

    def segment(key: tuple, table: pa.Table) -> pa.Table:
        bit = np.zeros(each, bool)
        bit[table.column("bit").to_numpy() % each] = True
        return pa.table({"segment": pa.array([key[0].as_py()], pa.int64()), "body": pa.array([np.packbits(bit, bitorder="little").tobytes()], pa.binary())})

    places = hashes.select(F.expr(f"hash & {size - 1}L").alias("bit")).distinct()
    made = places.withColumn("segment", F.expr(f"bit div {each}")).groupBy("segment").applyInArrow(segment, "segment long, body binary")
    packed = np.zeros(size // 8, np.uint8)
    for r in made.collect():
        packed[r["segment"] * each // 8 :][: each // 8] = np.frombuffer(r["body"], np.uint8)
    return Bits(packed)


def counted(batches, levels, union, limit: int):
    """(hash, words, count) of each shard's phrases of the next level, of those in the union if there is one. With single words, words 0 marks all
    words of a lang, whose hash is the lang's."""
    m = len(levels.value) + 1
    for h, left, _, langs in shards(batches, limit):
        if m == 1:
            yield _rows(hash=np.array(list(langs), U), words=np.zeros(len(langs), np.int32), count=np.array(list(langs.values()), np.int64))
        key = last(grown(h, left, levels.value))[1]
        if union is not None:
            key = key[union.value.has(key)]
        key, count = np.unique(key, return_counts=True)
        yield _rows(hash=key, words=np.full(len(key), m, np.int32), count=count.astype(np.int64))


def named(batches, levels, known: int = 1 << 20):
    """(hash, lang, phrase) of langs and of phrases in their level, each about once a task: up to `known` hashes are remembered."""
    seen = np.zeros(0, U)
    for batch in slices(batches, "text", 1 << 20):
        p = Pieces(batch)
        row = p.words.row_of_word()
        raw, start, end = p.words.data.tobytes(), p.words.start, p.words.end
        langs = batch.column(1).fill_null("und")
        out_hash, out_row, out_phrase = [], [], []
        _, first = np.unique(p.lang, return_index=True)
        out_hash.append(p.lang[first]), out_row.append(first), out_phrase.extend([""] * len(first))
        for m, (at, key) in enumerate(grown(p.hash, p.left, levels.value[:-1]), 1):
            good = levels.value[m - 1].has(key)
            key, one = np.unique(key[good], return_index=True)
            new = ~(seen[np.minimum(np.searchsorted(seen, key), len(seen) - 1)] == key) if len(seen) else np.ones(len(key), bool)
            key, at = key[new], at[good][one[new]]
            if len(seen) + len(key) <= known:
                seen = np.sort(np.concatenate([seen, key]))
            words = [[raw[a:b] for a, b in zip(start[at + i].tolist(), end[at + i].tolist(), strict=True)] for i in range(m)]
            out_hash.append(key), out_row.append(row[at]), out_phrase.extend(b" ".join(w).decode() for w in zip(*words, strict=True))
        columns = [pa.array(np.concatenate(out_hash).view(np.int64)), langs.take(pa.array(np.concatenate(out_row))), pa.array(out_phrase, pa.string())]
        yield pa.RecordBatch.from_arrays(columns, ["hash", "lang", "phrase"])


def frequent_phrases(docs: DataFrame, text: str = "text", lang: str = "lang", support: int = 30, shard_bytes: int = 16 << 20, most_bits: int = 1 << 28) -> DataFrame:
    """(lang, phrase, words, f), in a written table: phrases of 1 to 4 words that occur `support` times or more, and per lang a row of 0 words with all its words."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text"), F.coalesce(F.col(lang), F.lit("und")).alias("lang"))
    total = text_total(docs, text)
    levels: list[Bits] = []
    tables: list[DataFrame] = []
    for words in range(1, MOST + 1):
        sent = spark.sparkContext.broadcast(levels)
        union = None
        if words > 1 and support * shard_bytes >= 2 * total:  # a full shard's local support is 2 or more
            found = written(rows.mapInArrow(lambda b, sent=sent: mined(b, sent, support, total, shard_bytes), "hash long").distinct(), "union")
            union = spark.sparkContext.broadcast(bits_of(found, found.count(), most_bits))
            remove_written(spark, found)
        counts = rows.mapInArrow(lambda b, sent=sent, union=union: counted(b, sent, union, shard_bytes), "hash long, words int, count long")
        counts = counts.groupBy("hash", "words").agg(F.sum("count").alias("f"))
        frequent = written(counts.filter((F.col("f") >= support) | (F.col("words") == 0)), "frequent")
        levels = [*levels, bits_of(frequent.filter("words > 0"), frequent.count(), most_bits)]
        tables.append(frequent)
    sent = spark.sparkContext.broadcast(levels)
    every = functools.reduce(DataFrame.unionByName, tables)
    names = rows.mapInArrow(lambda b: named(b, sent), "hash long, lang string, phrase string").groupBy("hash").agg(F.min(F.struct("lang", "phrase")).alias("p"))
    out = written(every.join(names, "hash").select("p.lang", "p.phrase", "words", "f"), "phrases")
    remove_written(spark, *tables)
    return out


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", support: int = 30, top: int = 2000, cover: int = 80, **limits) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): phrases of 2 to 4 words by their weakest cut, the best `top` of each lang.

    A phrase that lies inside a longer frequent one of at least `cover` percent of its count is left out.
    """
    known = frequent_phrases(docs, text, lang, support, **limits)
    parts = known.filter("words > 0").select("lang", "phrase", "f")
    # one row per cut; both sides occur at least as often as the phrase, so that they are known too
    cuts = known.filter("words > 1").withColumn("w", F.split("phrase", " ")).select("lang", "phrase", F.col("f").alias("a"), "w", "words", F.explode(F.expr("sequence(1, words - 1)")).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.expr("slice(w, 1, k)"), " ").alias("left"), F.array_join(F.expr("slice(w, k + 1, words - k)"), " ").alias("right"))
    sided = cuts.join(parts.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"]).join(parts.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    score = F.expr("(cast(2000000 as decimal(7,0)) * cast(a as decimal(20,0))) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    scored = sided.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("c"))
    longer = known.filter("words > 2").withColumn("w", F.split("phrase", " "))
    inner = longer.select("lang", "f", F.explode(F.expr("flatten(transform(sequence(2, words - 1), m -> transform(sequence(1, words - m + 1), i -> array_join(slice(w, i, m), ' '))))")).alias("phrase"))
    most = inner.groupBy("lang", "phrase").agg(F.max("f").alias("most"))
    left = scored.join(most, ["lang", "phrase"], "left").filter(F.expr(f"most is null or cast(most as decimal(20,0)) * 100 < cast(a as decimal(20,0)) * {int(cover)}"))
    by = Window.partitionBy("lang").orderBy(F.desc("c.score"), F.desc("a"), "phrase")
    ranked = left.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= top)  # planned with a limit per group before the shuffle
    n = known.filter("words = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(n, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "c.l", "c.r", "n", "c.score")


def op11_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p),
g AS (
  SELECT lang, m, array_to_string(ws[i : i + m - 1], ' ') AS phrase
  FROM (SELECT lang, m, ws, unnest(range(1, CAST(len(ws) - m + 2 AS BIGINT))) AS i FROM w, (SELECT unnest([1, 2, 3, 4]) AS m) WHERE len(ws) >= m)),
n AS (SELECT lang, count(*) AS n FROM g WHERE m = 1 GROUP BY lang),
f AS (SELECT lang, m, phrase, count(*) AS f FROM g GROUP BY lang, m, phrase HAVING count(*) >= 30),
c AS (
  SELECT lang, phrase, f AS a, k, array_to_string(w[1 : k], ' ') AS lp, array_to_string(w[k + 1 :], ' ') AS rp
  FROM (SELECT *, string_split(phrase, ' ') AS w, unnest(range(1, CAST(m AS BIGINT))) AS k FROM f WHERE m > 1)),
s AS (
  SELECT c.*, x.f AS l, y.f AS r, CAST(CAST(2000000 AS HUGEINT) * a // (x.f + y.f) AS BIGINT) AS score
  FROM c JOIN f x ON x.lang = c.lang AND x.phrase = c.lp JOIN f y ON y.lang = c.lang AND y.phrase = c.rp),
b AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS o FROM s),
i AS (
  SELECT lang, array_to_string(w[j : j + q - 1], ' ') AS phrase, max(f) AS most
  FROM (SELECT *, unnest(range(1, CAST(m - q + 2 AS BIGINT))) AS j FROM (SELECT *, string_split(phrase, ' ') AS w, unnest(range(2, CAST(m AS BIGINT))) AS q FROM f WHERE m > 2))
  GROUP BY ALL),
k AS (SELECT b.* FROM b LEFT JOIN i ON i.lang = b.lang AND i.phrase = b.phrase WHERE o = 1 AND (most IS NULL OR 100 * most < 80 * a)),
z AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase COLLATE "C") AS rank FROM k)
SELECT z.lang, rank, phrase, a, l, r, n, score FROM z JOIN n ON n.lang = z.lang WHERE rank <= 2000
""".replace(' COLLATE "C"', "")
