"""Quality rules, line first. Native: DataFrame functions only.

Every line with a word is judged by three rules; a line that breaks one is removed:

* punctuation - it ends without closing punctuation of any of several scripts (quotes or brackets may follow), or runs of
  two or more symbols are at least half as many as its words;
* navigation - bars, guillemets and angle brackets are at least a third of its words;
* boilerplate - it names one of PHRASES, in whatever language the text is.

A document that keeps less than `min_kept` of its words' characters is rejected. The contract's base
rules (under 50 words; more than half of the words inside repeated 3-word windows) reject as well.

Null and empty texts have no words and are rejected by the base rule. Repeated rows are judged one by
one. Columns of the input that share a name with a result are replaced by the result. Windows are
compared by 64-bit hashes. Cost is one scan without a shuffle; n log n in the words of a text at worst.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import words_of
from eventloom.llm.words import SEPARATORS

SYMBOLS = "#*$%&|<>"
#: Marks that close a sentence, also full-width, Arabic, Urdu, Devanagari, Armenian, Ethiopic, Burmese, Khmer and Tibetan ones, and what may follow them.
MARKS = ".!?\u2026\u3002\uff01\uff1f\uff0e\uff61\u061f\u06d4\u0964\u0965\u0589\u1362\u104b\u17d4\u0f0d\u037e"
CLOSERS = "\"')]\xbb\u201d\u2019\u300d\u300f\uff09\u3011"
RUNS = r"[!?#*$%&|<>=_~-]{2,}"
BARS = "|<>\xab\xbb\u203a"
#: By language: English, German, French, Spanish. Lower case.
PHRASES = {
    "en": ("all rights reserved", "privacy policy", "terms of use", "terms of service", "cookie", "javascript", "click here", "subscribe now", "licensed under", "public license", "copyright (c)", "sign up for our newsletter"),
    "de": ("alle rechte vorbehalten", "datenschutz", "nutzungsbedingungen", "impressum", "hier klicken", "jetzt abonnieren", "newsletter abonnieren"),
    "fr": ("tous droits r\xe9serv\xe9s", "politique de confidentialit\xe9", "conditions d'utilisation", "mentions l\xe9gales", "cliquez ici", "abonnez-vous"),
    "es": ("todos los derechos reservados", "pol\xedtica de privacidad", "t\xe9rminos de uso", "aviso legal", "haga clic aqu\xed", "suscr\xedbete"),
}
BOILERPLATE = tuple(p for group in PHRASES.values() for p in group)


def let(value: Column, use) -> Column:
    """use(value), with value computed once per row."""
    return F.transform(F.array(value), use)[0]


def word_chars(text: Column) -> Column:
    return F.length(F.translate(text, SEPARATORS, ""))


def repeat_words(words: Column, k: int = 3) -> Column:
    """How many words lie in windows of k words that are found twice or more, the first find included."""

    def positions(h: Column) -> Column:
        def doubled(s: Column) -> Column:
            hit = F.transform(s, lambda x, i: F.when((F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"]), x["i"]))
            return F.sort_array(F.filter(hit, lambda x: x.isNotNull()))

        return let(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), doubled)

    def covered(p: Column) -> Column:
        return F.aggregate(F.transform(p, lambda x, j: F.least(F.lit(k), F.coalesce(F.get(p, j + 1) - x, F.lit(k)))), F.lit(0).cast("long"), lambda a, x: a + x)

    windows = let(words, lambda w: F.transform(F.slice(w, 1, F.greatest(F.size(w) - (k - 1), F.lit(0))), lambda x, i: F.xxhash64(x, *[F.get(w, i + j) for j in range(1, k)])))
    return let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(let(positions(h), covered)))


def line_fails(line: Column) -> Column:
    """Whether a line breaks the punctuation, navigation or boilerplate rule."""

    def noisy(n: Column) -> Column:
        return (2 * F.regexp_count(line, F.lit(RUNS)) >= n) | (3 * (F.length(line) - F.length(F.translate(line, BARS, ""))) >= n)

    boiler = let(F.lower(line), lambda x: reduce(or_, (F.contains(x, F.lit(p)) for p in BOILERPLATE)))
    # the last character before quotes, brackets and blanks closes the line
    last = F.right(F.rtrim(F.rtrim(line, F.lit(SEPARATORS)), F.lit(CLOSERS)), F.lit(1))
    return ~F.contains(F.lit(MARKS), last) | let(F.size(words_of(line)), noisy) | boiler


def quality(docs: DataFrame, text: str = "text", min_words: int = 50, max_repeat: int = 50, min_kept: float = 0.5) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept_chars, cleaned, kept.

    cleaned is the text without the lines that fail (lines without words stay); kept is the verdict.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.transform(F.split(t, "\n"), lambda x: F.struct(x.alias("line"), word_chars(x).cast("long").alias("chars")))
    out = docs.withColumns({
        "__lines": lines,
        "n_symbols": (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long"),
        "__counts": let(words_of(t), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeat_words(w).alias("r"))),
    })
    chars = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda a, y: a + y["chars"])
    texts = lambda x: F.transform(x, lambda y: y["line"])
    judged = let(F.col("__lines"), lambda x: F.struct(
        chars(x).alias("word_chars"), let(texts(F.filter(x, lambda y: y["chars"] > 0)), lambda s: F.size(s) - F.size(F.array_distinct(s))).cast("long").alias("n_dup_lines"),
        F.filter(x, lambda y: (y["chars"] == 0) | ~line_fails(y["line"])).alias("kept")))
    out = out.withColumn("__judged", judged).withColumns({"word_chars": F.col("__judged.word_chars"), "n_dup_lines": F.col("__judged.n_dup_lines"), "cleaned": F.array_join(texts(F.col("__judged.kept")), "\n"), "kept_chars": chars(F.col("__judged.kept"))})
    out = out.withColumns({"n_words": F.col("__counts.n"), "n_repeat_words": F.col("__counts.r")})
    out = out.withColumn("base_failed", (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat * F.col("n_words")))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("kept_chars") >= min_kept * F.col("word_chars"))).drop("__counts", "__lines", "__judged")


def op9_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return quality(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


#: CLOSED of a line, as a pattern: marks, then closers, then blanks.
CLOSED = rf"[{MARKS}][{CLOSERS.replace(']', chr(92) + ']')}]*[\x20\x09-\x0D]*\z"
_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
#: The same rows in DuckDB.
ORACLE = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, {_WORDS.format('text')} AS ws, string_split(text, chr(10)) AS lines FROM t),
g AS (SELECT *, CASE WHEN len(ws) >= 3 THEN list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) ELSE [] END AS g3,
 list_filter(lines, lambda l: len({_WORDS.format('l')}) > 0) AS spoken FROM w),
u AS (SELECT doc_id AS d, unnest(g3) AS s, unnest(range(1, len(g3) + 1)) AS i FROM g WHERE len(g3) > 0),
r AS (SELECT d, s FROM u GROUP BY d, s HAVING count(*) > 1),
p AS (SELECT d, i, lead(i) OVER (PARTITION BY d ORDER BY i) AS nx FROM u JOIN r USING (d, s)),
c AS (SELECT d, sum(least(3, coalesce(nx - i, 3))) AS n_repeat_words FROM p GROUP BY d),
k AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words,
 CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
 CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
 CAST(len(spoken) - len(list_distinct(spoken)) AS BIGINT) AS n_dup_lines,
 CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
 coalesce(list_sum(list_transform(list_filter(spoken, lambda l: NOT (
   NOT regexp_matches(l, '{CLOSED.replace("'", "''")}')
   OR 2 * len(regexp_extract_all(l, '{RUNS}')) >= len({_WORDS.format('l')})
   OR 3 * len(regexp_extract_all(l, '[{BARS}]')) >= len({_WORDS.format('l')})
   OR {' OR '.join(f"contains(lower(l), '{p.replace(chr(39), chr(39) * 2)}')" for p in BOILERPLATE)})),
   lambda l: length(regexp_replace(l, '[\x20\x09-\x0D]', '', 'g')))), 0) AS kept_chars
 FROM g LEFT JOIN c ON g.doc_id = c.d),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM k)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND kept_chars >= 0.5 * word_chars AS kept FROM b
"""
