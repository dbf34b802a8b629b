import random
import re
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest

from eventloom.llm import collocations, exact_spectrum, licenses, whitening
from eventloom.llm.suffix_automaton import SuffixAutomaton
from tests.conftest import SF

DOCS = "doc_id long, text string, lang string, source string"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def phrase_rows(docs, support, top, cover):
    """Collocations with plain loops."""
    f, n = Counter(), Counter()
    for _, text, lang, _ in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(FOLD)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, 5):
                for i in range(len(w) - m + 1):
                    f[lang, tuple(w[i : i + m])] += 1
    f = {k: v for k, v in f.items() if v >= support}
    found = {}
    for (lang, w), a in f.items():
        if len(w) < 2:
            continue
        if any(100 * b >= cover * a for (g, v), b in f.items() if g == lang and len(v) > len(w) and any(v[i : i + len(w)] == w for i in range(len(v)))):
            continue
        score, k = min((2000000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k) for k in range(1, len(w)))
        found.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return sorted((g, i + 1, p.decode(), -a, left, right, n[g], -s) for g, rows in found.items() for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top]))


@pytest.mark.parametrize(("shard", "bits"), [(64 << 20, 1 << 29), (400, 1 << 16), (60, 1 << 16)])
def test_collocations_equal_loops(spark, shard, bits):
    rng = random.Random(4)
    docs = [(i, "".join(rng.choice(["new york ", "New York city ", "a b c d ", "a b ", "é ", "x\ty. ", "x y, ", "new\n", "b c: d\v"]) for _ in range(rng.randrange(1, 30))), rng.choice(["en", "fr", None, "und", ""]), None) for i in range(80)]
    docs += [(None, None, "en", None), (200, "", None, None), (201, " \t.\n", "de", "s"), (202, "only once here", "xx", "s")] + docs[:2]
    out = collocations.collocations(spark.createDataFrame(docs, DOCS).repartition(3), support=12, top=9, cover=80, shard_bytes=shard, most_bits=bits)
    got = sorted(tuple(r) for r in out.collect())
    assert got == phrase_rows(docs, 12, 9, 80)
    assert len(got) > 10


def test_collocations_of_nothing_and_clashing_columns(spark):
    assert collocations.collocations(spark.createDataFrame([], DOCS)).count() == 0
    assert collocations.collocations(spark.createDataFrame([(1, None, None, None), (2, "", "en", None)], DOCS)).count() == 0
    docs = spark.createDataFrame([("a b", None, 1, 2, 3)] * 40, "text string, lang string, hash int, words int, f int")
    assert [tuple(r) for r in collocations.collocations(docs).collect()] == [("und", 1, "a b", 40, 40, 40, 80, 1000000)]


def test_scores_beyond_64_bits(spark):
    big = 9_000_000_000_000_000_000
    row = spark.createDataFrame([(big, 1, 1)], "a long, l long, r long")
    got = row.selectExpr("(cast(2000000 as decimal(7,0)) * cast(a as decimal(20,0))) div (cast(9000000000000000000 as decimal(20,0)) + cast(r as decimal(20,0))) s").first()["s"]
    assert got == 2000000 * big // (big + 1)


def test_automaton_equals_substrings():
    rng = random.Random(1)
    for _ in range(60):
        seqs = [[rng.randrange(3) for _ in range(rng.randrange(1, 9))] for _ in range(3)]
        a = SuffixAutomaton(seqs, 3)
        subs = {tuple(q[i:j]) for q in seqs for i in range(len(q)) for j in range(i + 1, len(q) + 1)}
        t = np.array([rng.choice([-1, 0, 0, 1, 1, 2, 2]) for _ in range(60)])
        state, length = a.matching(t, 8, chunk=7)
        full = a.having_suffix(a.state_of(seqs[0]))
        for i in range(60):
            k = max(k for k in range(i + 2) if k == 0 or tuple(t[i - k + 1 : i + 1].tolist()) in subs)
            assert length[i] == k
            if k:
                w = t[i - k + 1 : i + 1].tolist()
                assert set(a.ends[state[i]]) == {(n, j + k - 1) for n, q in enumerate(seqs) for j in range(len(q)) if q[j : j + k] == w}
            assert (full[state[i]] and length[i] >= len(seqs[0])) == (i + 1 >= len(seqs[0]) and t[i - len(seqs[0]) + 1 : i + 1].tolist() == seqs[0])


def base_of(text):
    w = [x for x in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(FOLD)) if x]
    hits = [(i, label) for p, label in licenses.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    at = [i for i, _ in hits]
    return len(w), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in hits}))


def test_license_query_equals_plain_search(spark):
    want = {r["doc_id"]: base_of(r["text"]) for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()}
    got = licenses.op12_license_scans(spark, SF).collect()
    assert {r["doc_id"]: tuple(r)[1:6] for r in got} == want and len(got) == len(want)
    assert all(set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1 for r in got)


def test_license_edges_and_spans(spark):
    mit = next(t for label, t in licenses.TEMPLATES if label == "mit" and len(t) > 200).split()
    changed = " ".join(w if i % 15 else "other" for i, w in enumerate(mit))
    docs = [
        (1, None, None, None),
        (2, "", "en", None),
        (3, "The MIT  License, MIT\nlicense! ümit license apache-license General_Public.LICENSE", None, None),
        (4, "intro words " + changed + " the end", None, None),
        (4, "Licensed under CC BY-NC 4.0.", None, None),
        (None, "licensed under cc by", None, None),
        (6, "permission to use the software", None, None),
        (7, "mit license " * 3000 + "licensed under the " * 3000, None, None),
        (8, "mit " + "x" * 1_000_000 + " license", None, None),
    ]
    out = licenses.scan_licenses(spark.createDataFrame(docs, DOCS)).collect()
    assert [tuple(r)[:5] for r in out] == [(d[0], *base_of(d[1])[:4]) for d in docs]
    assert [",".join(r["base_labels"]) for r in out] == [base_of(d[1])[4] for d in docs]
    assert [r["labels"] for r in out[3:7]] == [["mit"], ["cc-by-nc"], [], []]
    span = out[3]["spans"][0]
    assert (span["first_word"], span["last_word"]) == (2 + 1, 1 + len(mit)) and span["share"] > 0.85
    assert licenses.scan_licenses(spark.createDataFrame([], DOCS)).count() == 0
    assert licenses.scan_licenses(spark.createDataFrame([("a", "MIT license", 5)], "doc_id string, text string, labels int")).first()["n_base"] == 1


def dense(rows):
    """Eigenvalues, falling, and whitened values by numpy, over the distinct integer vectors."""
    x = np.floor(64 * np.array(rows, float))
    u = np.unique(x, axis=0)
    e, v = np.linalg.eigh(np.cov(u.T, bias=True))
    return e[::-1], (x - u.mean(0)) @ v[:, ::-1] / np.sqrt(np.maximum(e[::-1], 1e-300)), ((len(u) * x - u.sum(0)) ** 2).sum(1)


def test_whitening_query_equals_numpy(spark):
    t = pq.read_table(f"{SF}/embeddings.parquet").to_pydict()
    e, w, dev = dense(t["embedding"])
    got = {(r["vec_id"], r["component"]): r for r in whitening.op13_whitening(spark, SF).collect()}
    assert len(got) == 16 * len(t["vec_id"])
    for i, k in enumerate(t["vec_id"]):
        assert [abs(got[k, c]["whitened"]) for c in range(1, 17)] == pytest.approx(np.abs(w[i, :16]), abs=1e-8)
        assert {got[k, c]["deviation"] for c in range(1, 17)} == {int(dev[i])}
    first = [got[t["vec_id"][0], c] for c in range(1, 17)]
    assert [r["explained"] for r in first] == pytest.approx(e[:16] / e.sum(), rel=1e-12)
    assert first[0]["identity_error"] < 1e-10


def test_whitening_edges(spark):
    kind = "vec_id int, embedding array<double>, id int, y int, n int"
    grid = [[float(a), float(b), 0.5, float(a + b)] for a in range(3) for b in range(3)]
    rows = [(i, v, 0, 0, 0) for i, v in enumerate(grid * 2)]
    bad = [None, [1.0, None, 2.0, 3.0], [float("nan")] * 4, [float("inf")] * 4, [], [1e300] * 4]
    out = whitening.whiten(spark.createDataFrame(rows + [(90 + i, v, 0, 0, 0) for i, v in enumerate(bad)] + [(None, grid[0], 0, 0, 0)], kind)).collect()
    assert len(out) == 19 * 2 and {r["n"] for r in out} == {9}  # rank 2: a constant and a sum are no components
    assert [r["explained"] for r in out[:2]] == [0.75, 0.25] and sum(r["vec_id"] is None for r in out) == 2
    same = whitening.whiten(spark.createDataFrame(rows[:9], kind).unionByName(spark.createDataFrame([rows[0]] * 50, kind)))
    assert {r["n"] for r in same.collect()} == {9}
    for few in ([], rows[:1] * 5):
        assert whitening.whiten(spark.createDataFrame(few, kind)).count() == 0
    with pytest.raises(ValueError):
        whitening.whiten(spark.createDataFrame([(1, [1.0], 0, 0, 0), (2, [1.0, 2.0], 0, 0, 0)], kind))


def test_whitening_equal_eigenvalues_and_large_entries(spark):
    cube = [(i, [float(a), float(b), float(c)]) for i, (a, b, c) in enumerate((a, b, c) for a in range(3) for b in range(3) for c in range(2))]
    out = whitening.whiten(spark.createDataFrame(cube, "vec_id int, embedding array<float>")).collect()
    assert len(out) == 54 and max(r["identity_error"] for r in out) < 1e-12
    far = [[3e12 * a, float(b)] for a, b in ((1, 2), (2, 3), (-5, 9), (7, 1))]
    out = whitening.whiten(spark.createDataFrame(list(enumerate(far)), "vec_id int, embedding array<double>")).collect()
    assert max(r["identity_error"] for r in out) < 1e-9 and len(out) == 8
    total = [sum(int(64 * v[j]) for v in far) for j in range(2)]
    big = [sum((4 * int(64 * v[j]) - total[j]) ** 2 for j in range(2)) for v in far]
    assert all(r["deviation"] is None and big[r["vec_id"]] >= 1 << 63 for r in out)


def test_characteristic_polynomial_and_roots(spark):
    rng = np.random.default_rng(2)
    b = rng.integers(-9, 10, (7, 5))
    m = (b @ b.T).astype(object)  # rank 5
    e = exact_spectrum.characteristic(spark, m)
    want, power = [1], np.eye(7, dtype=int).astype(object)
    for k in range(1, 8):  # Faddeev and LeVerrier
        power = m @ power
        want.append(-np.trace(power) // k)
        power = power + want[-1] * np.eye(7, dtype=int).astype(object)
    assert [(-1) ** k * c for k, c in enumerate(e)] == want
    roots = exact_spectrum.Roots(e)
    assert roots.rank == 5
    got = [x / (1 << q) for x, q, n in roots.largest(16) for _ in range(n)]
    assert got == pytest.approx(np.linalg.eigvalsh(m.astype(float))[::-1][:5], rel=1e-12)
