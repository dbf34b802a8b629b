"""Mixing sources to target weights by systematic sampling. Native DataFrame functions.

A document's size is its number of words. Sources, by code point with null last, weigh 1, 2, 3,
repeating, and share 100 % of all sizes; a target stops at 3 times its source's size, and the excess is
reshared by weight. That fixed point is a water level: target = min(3 size, level x weight).

Within a source every document is expected `rate` = target / source size times. The documents are laid
out in strata (salt = doc_id modulo the strata count, so a hot source is spread over many tasks),
by size inside a stratum; the prefix sum of expected copies of the i-th document is i x rate, one offset
per source is added, and a document is emitted once per integer that its stretch crosses. Neighbours are alike in
size, so the words taken come near the target. The offset is pseudo-random: OFFSETS equally spaced ones begin at the MD5 of the source's
name. A small source has few outcomes in one order, so LAYOUTS orders (by size, and by hashes of the id) are laid out as well; the order and
offset whose words taken come nearest the target are used (the first of equals). Reruns agree. A target can still be missed where a few documents hold most of a source's words: no offset splits a document.

Null and empty texts have size 0, may be sampled and take nothing. A null source is a source of its own.
Ids are integers; another type raises ValueError. Null ids are spread over strata by size. Repeated rows count one by one (ties in (size, id) are
alike, so any order gives the same rows). Sources without words have target 0 and rate 0. Extra columns stay; those named like a
result are replaced. Per-source tables have a row per source and are ordered in one task: up to about 10^7 sources (100 bytes each).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventloom.llm.common import integer_id, words_of, written

CAP = 3
#: How many offsets are tried in how many orders of a source.
OFFSETS, LAYOUTS = 32, 8


def source_targets(sized: DataFrame, source: str = "source") -> DataFrame:
    """(__src, source_size, target, rate, start) of rows (source, size), one row per source; start is where its offsets begin."""
    s = sized.groupBy(F.col(source).alias("__src")).agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("__src").asc_nulls_last())
    s = s.withColumn("w", ((F.row_number().over(by_name) - 1) % 3 + 1).cast("long"))
    everything = Window.partitionBy()
    by_ratio = Window.orderBy(F.col("source_size") / F.col("w"), F.col("__src").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumns({"t": F.sum("source_size").over(everything), "wt": F.sum("w").over(everything), "sb": F.coalesce(F.sum("source_size").over(by_ratio), F.lit(0)), "wb": F.coalesce(F.sum("w").over(by_ratio), F.lit(0))})
    s = s.withColumn("free", (F.col("t") - CAP * F.col("sb")).cast("double") / (F.col("wt") - F.col("wb")))
    # the first source, by ratio, that its share does not overfill sets the level for itself and all after it; of equal ratios the first has the largest free
    s = s.withColumn("level", F.min(F.when(F.col("free") * F.col("w") <= CAP * F.col("source_size"), F.struct((F.col("source_size") / F.col("w")).alias("r"), (-F.col("free")).alias("f")))).over(everything)["f"] * -1)
    s = s.withColumn("target", F.least((CAP * F.col("source_size")).cast("double"), F.coalesce(F.col("level"), F.lit(0.0)) * F.col("w")))
    s = s.withColumn("rate", F.when(F.col("source_size") > 0, F.least(F.lit(float(CAP)), F.col("target") / F.col("source_size"))).otherwise(0.0))
    digest = F.substring(F.md5(F.coalesce(F.concat(F.lit("s:"), F.col("__src")), F.lit("null"))), 1, 6)
    return s.select("__src", "source_size", "target", "rate", (F.conv(digest, 16, 10).cast("double") / float(1 << 24)).alias("start"))


def copies(place, rate, offset):
    """How many integers the stretch of the place-th document crosses."""
    return F.least(F.floor(place * rate + offset) - F.floor((place - 1) * rate + offset), F.lit(CAP)).cast("long")


def mix_sized(rows: DataFrame, light: DataFrame, doc_id: str = "doc_id", source: str = "source", stratum: int = 2000) -> DataFrame:
    """rows (with a size) with source_size, target, copies and taken; light: the same (id, source, size) as a cheap table.

    Strata, targets and offsets come from light; only the last step carries all columns of rows. stratum: rows per stratum, about.
    """
    integer_id(rows, doc_id)
    strata = max(1, -(-light.count() // stratum))
    salt = F.pmod(F.coalesce(F.col(doc_id).cast("long"), F.xxhash64("size")), F.lit(strata)).cast("long")
    counts = light.groupBy(F.col(source).alias("__s"), salt.alias("__k")).agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    before = Window.partitionBy("__s").orderBy("__k").rowsBetween(Window.unboundedPreceding, -1)
    targets = source_targets(counts.select(F.col("__s").alias(source), "size"), source)
    counts = counts.select("__s", "__k", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"))
    small = written(targets.join(counts, F.col("__src").eqNullSafe(F.col("__s"))).drop("__s"), "strata")

    def order(layout):
        hashed = F.md5(F.concat_ws(":", layout, F.coalesce(F.col(doc_id).cast("string"), F.concat(F.lit("s"), F.col("size")))))
        return Window.partitionBy(source, "__salt").orderBy(F.when(layout == 0, "").otherwise(hashed), "size", F.col(doc_id).asc_nulls_last())

    def stratified(df: DataFrame) -> DataFrame:
        df = df.drop("source_size", "target", "rate", "start", "__src", "__k", "__before").withColumn("__salt", salt)
        return df.join(small, df[source].eqNullSafe(small["__src"]) & (df["__salt"] == small["__k"]))

    places = F.array(*[F.row_number().over(order(F.lit(n))) + F.col("__before") for n in range(LAYOUTS)])
    each = stratified(light.select(doc_id, source, "size")).withColumn("__places", places).withColumn("__o", F.explode(F.sequence(F.lit(0), F.lit(OFFSETS * LAYOUTS - 1))))
    place = F.get("__places", F.floor(F.col("__o") / OFFSETS).cast("int"))
    each = each.withColumn("__taken", copies(place, F.col("rate"), offset(F.col("start"), F.col("__o"))) * F.col("size"))
    summed = each.groupBy("__src", "target", "__o").agg(F.sum("__taken").alias("__taken"))
    best = summed.groupBy(F.col("__src").alias("__b")).agg(F.min_by("__o", F.struct(F.abs(F.col("__taken") - F.col("target")), "__o")).alias("__o"))
    best = written(best, "offsets")
    out = stratified(rows)
    out = out.join(best, out["__src"].eqNullSafe(best["__b"]))
    out = out.withColumn("__place", F.row_number().over(order(F.floor(F.col("__o") / OFFSETS).cast("int"))) + F.col("__before"))
    out = out.withColumn("copies", copies(F.col("__place"), F.col("rate"), offset(F.col("start"), F.col("__o")))).withColumn("taken", F.col("copies") * F.col("size"))
    return out.drop("__salt", "__k", "__before", "__place", "__src", "__b", "__o", "rate", "start")


def offset(start, number):
    """An equally spaced offset in 0..1; numbers go through all offsets of one order, then of the next."""
    x = start + (number % OFFSETS) / F.lit(float(OFFSETS))
    return x - F.floor(x)


def sized(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.withColumn("size", F.size(words_of(F.col(text))).cast("long"))


def mix_sources(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", stratum: int = 2000) -> DataFrame:
    """docs with size, source_size, target, copies and taken."""
    rows = sized(docs, text)
    return mix_sized(rows, written(rows.select(doc_id, source, "size"), "sizes"), doc_id, source, stratum)


def op10_mix_sources(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sizes = written(sized(docs).select("doc_id", "source", "size"), "sizes")
    return mix_sized(sizes, sizes).select("doc_id", "size", "source_size", "target", "taken")


#: The same rows in DuckDB.
ORACLE = r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
k AS (SELECT greatest(1, CAST(ceil(count(*) / 2000.0) AS BIGINT)) AS strata FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM s),
f AS (SELECT *, CAST((sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER b, 0)) AS DOUBLE) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS free FROM w
 WINDOW b AS (ORDER BY source_size / CAST(w AS DOUBLE), source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT coalesce(arg_min(free, source_size / CAST(w AS DOUBLE)) FILTER (WHERE free * w <= 3 * source_size), 0) AS level FROM f),
t AS (SELECT source, source_size, least(CAST(3 * source_size AS DOUBLE), level * w) AS target,
 CAST(('0x' || substr(md5(coalesce('s:' || source, 'null')), 1, 6)) AS BIGINT) / 16777216.0::DOUBLE AS off FROM f, l),
o AS (SELECT *, CASE WHEN source_size > 0 THEN least(3.0::DOUBLE, target / source_size) ELSE 0 END AS rate FROM t),
p AS (SELECT d.*, l, row_number() OVER (PARTITION BY source, l ORDER BY coalesce(((doc_id % strata) + strata) % strata, 0), CASE WHEN l = 0 THEN '' ELSE md5(concat(l, ':', coalesce(CAST(doc_id AS VARCHAR), 's' || size))) END, size, doc_id NULLS LAST) AS place FROM d, k, range(0, 8) y(l)),
z AS (SELECT p.doc_id, p.size, l, o.*, place FROM p JOIN o ON p.source IS NOT DISTINCT FROM o.source),
h AS (SELECT i, i / 32.0::DOUBLE AS step FROM range(0, 32) r(i)),
e AS (SELECT source, target, l, i, CAST(sum((floor(place * rate + (off + step - floor(off + step))) - floor((place - 1) * rate + (off + step - floor(off + step)))) * size) AS BIGINT) AS taken FROM z, h GROUP BY source, target, l, i),
b AS (SELECT source, min(l * 32 + i) AS c FROM (SELECT *, min(abs(taken - target)) OVER (PARTITION BY source) AS least FROM e) WHERE abs(taken - target) = least GROUP BY source),
f2 AS (SELECT z.*, off + (c % 32) / 32.0::DOUBLE AS x FROM z JOIN b ON z.source IS NOT DISTINCT FROM b.source AND z.l = b.c // 32)
SELECT doc_id, size, source_size, target, CAST(floor(place * rate + (x - floor(x))) - floor((place - 1) * rate + (x - floor(x))) AS BIGINT) * size AS taken FROM f2
"""
