"""Token counts of a unigram vocabulary: count-only Viterbi over Aho-Corasick matches.

Text is cut before each space; a space becomes the mark U+2581, and one is put before the text unless it
begins with one. Within a cut, an Aho-Corasick automaton enumerates all vocabulary pieces by their end; dynamic programming keeps, per
position, the best score and its piece count. Tie rules are those of the Unigram encoder of the public
`tokenizers` library: only a strictly better score replaces another, and candidates that end at a
position are met in order of their start. Work is linear in the text. A character that no one-character piece covers may be taken as
unknown, at the smallest score of the vocabulary less 10; neighbouring unknowns fuse into one, which is then
written as its bytes where the vocabulary has all of them.

Null and empty texts count 0. Counts of short cuts are kept in a table of the worker that is bounded in entries and in characters. Rows are
counted one by one; columns besides id and text stay out of the result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.words import slices

MARK = "▁"
UNKNOWN_PENALTY = 10.0


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def read_pieces(path: str) -> tuple[list[tuple[str, float]], int]:
    """Pieces with scores by id, and the id of the unknown piece."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(sp.id_to_piece(i), float(np.float64(sp.get_score(i)))) for i in range(sp.get_piece_size())], sp.unk_id()


#: Characters of the longest cut whose count is kept; in scripts without spaces a cut may be a whole text.
LONGEST_KEPT = 48


class UnigramCounter:
    def __init__(self, pieces: list[tuple[str, float]], unk: int, cached: int = 1 << 19):
        import ahocorasick

        self.find = ahocorasick.Automaton()
        for p, s in pieces:
            if p:
                self.find.add_word(p, (len(p), s))
        self.find.make_automaton()
        self.byte = all(f"<0x{i:02X}>" in {p for p, _ in pieces} for i in range(256))
        self.unknown = min(s for _, s in pieces) - UNKNOWN_PENALTY
        self.chars = {p for p, _ in pieces if len(p) == 1}
        self.kept: dict[str, int] = {}
        self.cached = cached

    def count(self, cut: str) -> int:
        """Pieces of one cut. State per position: score, pieces, whether the last one is unknown and where it began."""
        n = len(cut)
        if self.chars.issuperset(cut):  # no unknown can occur; matches come by end, then by start
            top, number = [0.0] + [-math.inf] * n, [0] * (n + 1)
            for last, (size, s) in self.find.iter(cut):
                a = last + 1 - size
                if top[a] + s > top[last + 1]:
                    top[last + 1] = top[a] + s
                    number[last + 1] = number[a] + 1
            return number[n]
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
        for last, (size, score) in self.find.iter(cut):
            ends[last + 1].append((last + 1 - size, score))
        single = [False] * n
        for i in range(n):
            single[i] = any(a == i for a, _ in ends[i + 1])
        score = [0.0] * (n + 1)
        back: list[tuple[int, bool]] = [(0, False)] * (n + 1)
        number = [0] * (n + 1)
        before = [-1] * (n + 1)  # pieces before the run of unknowns that ends here, -1 where none does
        size = [0] * (n + 1)  # bytes of that run
        for e in range(1, n + 1):
            best = None
            for a, s in sorted(ends[e]):
                if best is None or score[a] + s > best:
                    best, back[e] = score[a] + s, (a, False)
            if not single[e - 1] and (best is None or score[e - 1] + self.unknown > best):
                best, back[e] = score[e - 1] + self.unknown, (e - 1, True)
            score[e] = best
            a, strange = back[e]
            if not strange:
                number[e] = number[a] + 1
            else:
                before[e] = number[a] if before[a] < 0 else before[a]
                size[e] = size[a] + len(cut[a].encode())
                number[e] = before[e] + (size[e] if self.byte else 1)
        return number[n]

    def total(self, text: str) -> int:
        if not text:
            return 0
        text = text.replace(MARK, " ")  # a mark in the text cuts like a space
        head, *rest = (text if text[0] == " " else " " + text).split(" ")[1:]
        kept, n = self.kept, 0
        for cut in (head, *rest):
            c = kept.get(cut)
            if c is None:
                c = self.count(MARK + cut)
                if len(cut) <= LONGEST_KEPT:
                    if len(kept) >= self.cached:
                        kept.clear()
                    kept[cut] = c
            n += c
        return n


_counters: dict[str, UnigramCounter] = {}


def counter(path: str) -> UnigramCounter:
    if path not in _counters:
        _counters[path] = UnigramCounter(*read_pieces(path))
    return _counters[path]


def token_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens). path: a sentencepiece model whose pieces and scores are the vocabulary; readable on executors."""
    path = path or default_vocabulary()

    def run(batches):
        c = counter(path)
        for b in slices(batches, "text", 4 << 20):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([c.total(t or "") for t in b.column(1).to_pylist()], pa.int64())], ["doc_id", "n_tokens"])

    kind = dict(docs.select(doc_id).dtypes)[doc_id]
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long").withColumnRenamed("doc_id", doc_id)


def op8_token_counts(spark, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
