"""Long words, held-out spans, votes by brute force, targets of small sources, pipeline edges."""

import collections
import itertools
import time
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from eventloom.llm import bpe, chroma, common, knn_quality, line_rules, minmax, mixing, pii, substring, unigram
from eventloom.llm.words import Words
from tests.conftest import SF
from tests.llm.test_llm import SCHEMA, made

LONG = ["a" * 1_000_000 + " 1", "\U0001f600" * 400_000, "1" * 1_000_000, "a@" * 300_000, "x1" * 500_000]


@pytest.mark.parametrize("text", LONG)
def test_one_long_word_takes_seconds(text):
    began = time.time()
    pii.all_spans(text, np.ones((4, pii.FEATURES)), 4, 2.0)
    unigram.counter(unigram.default_vocabulary()).total(text)
    assert time.time() - began < 20


def test_pipeline_and_bpe_on_long_words(spark):
    rows = [(i, t + " word." * 60 if i else t, "en", "s", len(t), True, "x", 1) for i, t in enumerate(LONG[:3])]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert bpe.digests(docs).count() == 3 and pii.redact(docs).count() == 3 and line_rules.quality(docs).count() == 3


def test_long_pieces_merge_like_short_ones():
    import random

    c, rng = bpe.coder(*bpe.default_vocabulary()), random.Random(4)
    rows = ["".join(rng.choice(a) for _ in range(rng.randint(2, 60))).encode() for a in ("ab", "etaoin shr", "\xe9\U0001f600x", "the and ing", " \n#") for _ in range(150)]
    assert [c.merge_long(r) for r in rows] == [c.merge([r])[0] for r in rows]


def test_field_finds_held_out_forms():
    lead = lambda t: next(iter(pii.regions(t)), (0, 0))[0]
    labelled = [(t, lead(t), s) for t, s in pii.examples(1200)] + [x for t, _ in pii.examples(300, 5) if (x := pii.by_base(t, lead(t)))]
    w = pii.fit(labelled[:1200])
    tp = fp = fn = 0
    for t, spans in pii.examples(1500, seed=99):
        base = set(pii.base_spans(t))
        got = {s[:3] for s in pii.all_spans(t, w, 4, 2.0) if not s[3]}
        gold = set(spans) - base
        tp, fp, fn = tp + len(got & gold), fp + len(got - gold), fn + len(gold - got)
    assert tp / (tp + fp) > 0.97 and tp / (tp + fn) > 0.85


def test_segment_probabilities_equal_enumeration():
    rng = np.random.default_rng(3)
    for _ in range(60):
        n = int(rng.integers(1, 5))
        found = [(i, j, 0, 0) for i in range(n) for j in range(i + 1, min(i + 2, n) + 1)]
        score = rng.normal(size=(len(found), len(pii.KINDS)))
        total, mass = 0.0, np.zeros(score.shape)
        for k in range(n + 1):
            for pick in itertools.combinations(range(len(found)), k):
                if all(found[a][1] <= found[b][0] for a, b in zip(pick, pick[1:])):
                    for kinds in itertools.product(range(len(pii.KINDS)), repeat=k):
                        p = np.exp(sum(score[c, y] for c, y in zip(pick, kinds)))
                        total += p
                        for c, y in zip(pick, kinds):
                            mass[c, y] += p
        assert np.allclose(pii.gradient(n, found, score), mass / total)


def test_regions_are_runs_of_tokens():
    cut = lambda t: [t[a:b] for a, b in pii.regions(t)]
    assert cut("a b1 +2 (3) c  4 5\n6") == ["b1 +2 (3)", "4 5", "6"]
    assert cut("write me (at) x.org now (at)") == ["me (at) x.org", "now (at)"] and cut("") == cut("no one") == []


def test_votes_equal_brute_force():
    rng = np.random.default_rng(2)
    z, labelled = knn_quality.unit(rng.normal(size=(40, 6))), knn_quality.unit(np.round(rng.normal(size=(90, 6)), 0) + 0.5)
    labelled[60:] = labelled[:30]  # ties
    y = rng.integers(0, 2, 90)
    got = knn_quality.vote(z, labelled, y, 7, 4.0)
    share = [max(1, (y == c).sum()) for c in (0, 1)]
    near = z @ labelled.T
    for row, v in zip(near, got):
        votes = collections.Counter()
        for i in sorted(range(90), key=lambda i: (-row[i], i))[:7]:
            votes[int(y[i])] += max(row[i], 0) ** 4 / share[y[i]]
        assert abs(v - (votes[1] / sum(votes.values()) if sum(votes.values()) else 0.5)) < 1e-9


def test_labels_repeat_and_contradict(spark):
    docs = spark.createDataFrame([(i, "good words here. " * (i + 2) if i % 2 else "### ||| $$$ " * (i + 2), "en", "s", 1, True, "x", 1) for i in range(30)], SCHEMA)
    labels = [(i, i % 2) for i in range(20)]
    one = knn_quality.quality_scores(docs, spark.createDataFrame(labels + labels[:5] + [(25, 0), (25, 1), (None, 1), (99, 1), (3, None)], "doc_id long, quality int"))
    two = knn_quality.quality_scores(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    assert sorted(one.collect()) == sorted(two.collect())


def test_mix_is_near_every_target(spark):
    rows = mixing.op10_mix_sources(spark, SF.replace("0.001", "0.01")).join(spark.read.parquet(SF.replace("0.001", "0.01") + "/documents.parquet").select("doc_id", "source"), "doc_id").collect()
    taken, target = collections.Counter(), {}
    for r in rows:
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    assert all(abs(taken[s] - t) <= 0.05 * t for s, t in target.items())


def test_text_ids_are_refused_and_empty_tables_stay_empty(spark):
    text_ids = spark.createDataFrame([("a", "b c", "s")], "doc_id string, text string, source string")
    for f in (substring.substring_dedup, minmax.near_duplicates, mixing.mix_sources):
        with pytest.raises(ValueError):
            f(text_ids)
    nothing = spark.createDataFrame([], SCHEMA)
    assert minmax.near_duplicates(nothing).collect() == [] and unigram.token_counts(nothing).collect() == []
    assert mixing.mix_sources(nothing).collect() == []


def run_stages(spark, docs):
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.written(stage(spark, docs, SF), "stage")
        seen.append(docs)
    return seen, corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()


def test_pipeline_edges(spark):
    rows = made() + [(900 + i, "\n".join(" ".join(f"word{i}{j}{k}" for k in range(8)) + "." for j in range(20)) + "\nhome | about | news", None, None, None, None, None, None) for i in range(3)]
    docs = spark.createDataFrame(rows, SCHEMA)
    seen, out = run_stages(spark, docs)
    assert all(d.columns == docs.columns for d in seen) and {900, 901, 902} <= {r["doc_id"] for r in seen[0].collect()}
    assert all("home | about" not in r["text"] and (r["n_chars"] == len(r["text"])) for r in seen[0].collect())
    few = docs.select("doc_id", "text", "source")
    assert all(d.columns == few.columns for d in run_stages(spark, few)[0])
    seen, out = run_stages(spark, docs.limit(0))
    assert out == [] and all(d.columns == docs.columns for d in seen)
    common.remove_written(spark)


def test_counts_of_long_cuts_are_not_kept():
    c = unigram.UnigramCounter(*unigram.read_pieces(unigram.default_vocabulary()), cached=100)
    long = "字" * 3000
    want = c.count(unigram.MARK + long)
    assert c.total(long) == want == c.total(long) and not c.kept
    assert c.total(" ".join(f"w{i}" for i in range(1000))) > 1000 and len(c.kept) <= 100 and max(map(len, c.kept)) <= unigram.LONGEST_KEPT


def test_word_hashes_take_bounded_memory():
    """Besides the hashes themselves; a word longer than a run is hashed whole."""
    w = Words(pa.array(["ab cde " * 600_000, None, "x" * 50, "ab"]))
    tracemalloc.start()
    h = w.hashes()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 * len(h) + (64 << 20)
    assert len(set(h.tolist())) == 3 and h[0] == h[-1] and (w.hashes(7) == h).all()


def test_varying_bits_are_counted_over_all_recordings(spark):
    """Bit 7 is set in those recordings alone that a sample by hash would leave out."""
    out = common.F.pmod(common.F.xxhash64("class_id"), common.F.lit(2)) == 1
    one = spark.range(4400).select(common.F.col("id").alias("class_id")).withColumn("fp", common.F.array(common.F.when(out, 128).otherwise(0), common.F.lit(0)))
    assert chroma.varying_bits(one) == [7]
    assert chroma.varying_bits(one.limit(0)) == list(range(32))


@pytest.mark.parametrize("pending", [1, 40, 1 << 21])
def test_alike_windows_equal_all_pairs(pending):
    rng = np.random.default_rng(4)
    flat = rng.integers(0, 1 << 32, 60, dtype=np.uint32)
    near = [np.where(rng.random(60) < 0.5, flat ^ (np.uint32(1) << rng.integers(0, 32, 60).astype(np.uint32)), flat).astype(np.uint32) for _ in range(4)]
    q, d = chroma.Windows([flat, flat[:5], near[0]]), chroma.Windows([*near[1:], flat[10:30], flat[20:]])
    masks = chroma.landmark_masks(list(range(32)), 8, 12)
    turn = (q.key >> np.uint64(40)).astype(int) % chroma.TURNS
    want = set()
    for i, j in itertools.product(range(len(q.key)), range(len(d.key))):
        x, y = ([int(s[k]) for s in w.seen] for w, k in ((q, i), (d, j)))
        landmark = any(all((x[s] ^ y[s]) & int(m) == 0 for s, m in zip(chroma.STEPS, mask, strict=True)) for t, mask in enumerate(masks) if t % chroma.TURNS == turn[i])
        if x == y or (landmark and sum((a ^ b).bit_count() for a, b in zip(x, y, strict=True)) <= 12):
            want.add((i, j))
    a, b = chroma.alike_windows(q, d, masks, 12, pending)
    assert list(zip(a.tolist(), b.tolist(), strict=True)) == sorted(want) and len(want) > 60
