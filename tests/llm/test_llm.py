import base64
import collections
import hashlib
import math
import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from eventloom.llm import bpe, chroma, entry, fm_index, knn_quality, line_rules, lm, minmax, mixing, pii, substring, unigram
from tests.conftest import SF

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, id string, size int"
VOCAB = "the of a and one two three four five six seven eight nine ten red blue green".split()


def made(seed=3, n=60):
    """Documents with copies, near copies, nulls, empties, a long text, odd characters and columns with clashing names."""
    rng = random.Random(seed)
    texts = [" ".join(rng.choice(VOCAB) + str(rng.randint(0, 40)) for _ in range(rng.randint(1, 120))) for _ in range(n)]
    base = [f"w{i}" for i in range(160)]
    texts += [" ".join(base)] * 3
    for i in range(12):
        copy = list(base)
        for j in rng.sample(range(160), i):
            copy[j] = f"x{i}_{j}"
        texts.append(" ".join(copy))
    texts += [None, "", " \t\n ", "one", "One", "a b c d", "é 日本 🙂\x0bq\x0c", "z " * 30000, "+1 (017) 555-7713 me@x.example.org 10.0.0.256 10.0.0.25 4111 1111 1111 1111"]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    rows = [(i, t, "en", rng.choice(["s1", "s2", None]), len(t or ""), True, "x", 7) for i, t in zip(ids, texts, strict=True)]
    return rows + [rows[4], (None, None, None, None, None, None, None, None), (None, "one two three", None, "s2", None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(made(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return WORD.findall(t or "")


def test_substring_equals_brute_force(docs, nothing):
    rows = [r for r in made()]
    first = {}
    for i, t, *_ in rows:
        w, key = words(t), float("inf") if i is None else i
        for a in range(len(w) - 12):
            k = tuple(w[a : a + 13])
            first[k] = min(first.get(k, key), key)
    want = []
    for i, t, *_ in rows:
        w, key = words(t), float("inf") if i is None else i
        gone = [False] * len(w)
        for a in range(len(w) - 12):
            if first[tuple(w[a : a + 13])] < key:
                gone[a : a + 13] = [True] * 13
        want.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    for block in (4 << 20, 2000):
        got = [tuple(r) for r in substring.substring_dedup(docs, block_bytes=block, shard_bytes=3000).collect()]
        assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert substring.substring_dedup(nothing).collect() == []


@pytest.mark.parametrize("depth", [1, 2, 3, 5, 8, 13])
def test_fm_index_ranges_and_owners(depth):
    """Ranges of all patterns of `depth` symbols, and their smallest owners, against a plain search."""
    rng = random.Random(depth)
    runs = [[rng.randint(1, 2 + depth // 3) for _ in range(rng.randint(depth, 40))] for _ in range(12)]
    runs += [runs[0][:depth] * 3, runs[1], [7] * depth]
    text = np.array([x for r in runs for x in (*r, 0)], np.int64)
    owner = np.repeat([rng.randint(0, 99) for _ in runs], [len(r) + 1 for r in runs])
    holders = collections.defaultdict(list)
    for a in range(len(text) - depth + 1):
        if text[a : a + depth].all():
            holders[tuple(text[a : a + depth].tolist())].append(int(owner[a]))
    index = fm_index.FmIndex(text, depth, owner)
    for pattern, have in holders.items():
        low, high = np.array([0]), np.array([len(text)])
        for symbol in reversed(pattern):
            low, high = index.extend(np.array([symbol]), low, high)
        assert high[0] - low[0] == len(have)
        if len(have) > 1:
            assert index.least_owner(low)[0] == min(have)


def test_lm_blocks_do_not_change_scores(docs, nothing):
    one = sorted(map(repr, lm.stupid_backoff(docs).collect()))
    assert [r["n_words"] for r in lm.stupid_backoff(docs).filter("doc_id is null").orderBy("n_words").collect()] == [0, 3]
    two = lm.stupid_backoff(docs, block_bytes=3000, shard_bytes=2000).collect()
    assert sorted(map(repr, two)) == one
    assert lm.stupid_backoff(nothing).collect() == []


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_lm_equals_a_loop(spark, docs, order):
    """Nulls, empty texts, repeated rows and a long text of one word, against counts in dictionaries."""
    rows = made()
    counts = [collections.Counter(tuple(w[a : a + n]) for n in range(1, order + 1) for a in range(len(w) - n + 1)) for w in (words(t) for _, t, *_ in rows)]
    everywhere = sum(counts, collections.Counter())
    n_words = sum(len(words(t)) for _, t, *_ in rows)
    want = []
    for (i, t, *_), own in zip(rows, counts, strict=True):
        w, rest, log = words(t), n_words - len(words(t)), 0.0
        for at in range(len(w)):
            factor = 1.0
            for n in range(min(order, at + 1), 0, -1):
                gram = tuple(w[at - n + 1 : at + 1])
                c = everywhere[gram] - own[gram]
                if c:
                    value = factor * c / (rest if n == 1 else everywhere[gram[:-1]] - own[gram[:-1]])
                    break
                factor *= 0.4 if n > 1 else 1.0
            else:
                value = factor / (rest + 1)
            log += math.log(value)
        want.append((-1 if i is None else i, len(w), log, log / len(w) if w else None))
    got = [(-1 if r[0] is None else r[0], *r[1:]) for r in lm.stupid_backoff(docs, order=order, block_bytes=4000, shard_bytes=3000).collect()]
    assert len(got) == len(want)
    for a, b in zip(sorted(got, key=lambda r: r[:3]), sorted(want, key=lambda r: r[:3]), strict=True):
        assert a[:2] == b[:2] and (a[3] is None) == (b[3] is None) and (a[2], a[3] or 0) == pytest.approx((b[2], b[3] or 0), rel=1e-9)


def test_lm_blocks_of_a_class_keep_what_only_they_have(spark, docs):
    """Scores stay when documents with the same value share blocks; trigrams whose pairs live in one block have no row."""
    one, two = (sorted(map(repr, lm.stupid_backoff(docs, block_bytes=3000, shard_bytes=2000, alike=a).collect())) for a in (None, "source"))
    assert one == two
    table = pa.table({"text": ["a b c d", "a b c d", "x b c y"], "block": [5] * 3})
    w = lm.Words(table.column("text"))
    grams = lm.Grams(w, w.hashes(), (2,), 60)
    key = grams.key[2][grams.number[2][[1, 2]]]  # "b c" and "c d" are known in other blocks, "a b" is not
    totals = pa.table({"key": pa.array(key.view(np.int64)), "total": [9, 9]})
    got = lm.explode_high(table, totals, 3, 60)
    assert got.column("count").to_pylist() == [2] and got.column("block").to_pylist() == [5]


def components(rows, percent, k=5):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for i, t, *_ in rows:
        w = words((t or "").translate(low))
        sets.append(frozenset(tuple(w[a : a + k]) for a in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)]) if w else frozenset())
    label = list(range(len(rows)))
    for x in range(len(rows)):
        for y in range(x):
            same_id = rows[x][0] is not None and rows[x][0] == rows[y][0]
            if same_id or (sets[x] and 100 * len(sets[x] & sets[y]) >= percent * len(sets[x] | sets[y])):
                a, b = label[x], label[y]
                label = [min(a, b) if v in (a, b) else v for v in label]
    least = collections.defaultdict(list)
    for v, r in zip(label, rows):
        if r[0] is not None:
            least[v].append(r[0])
    return [(r[0], len(s), min(least[v], default=None)) for r, s, v in zip(rows, sets, label)]


@pytest.mark.parametrize("chunk", [300_000, 200])
def test_near_duplicates_equal_brute_force(docs, chunk):
    got = minmax.near_duplicates(docs, percent=85, chunk=chunk).collect()
    assert sorted(repr((r["doc_id"], r["n_shingles"], r["component_id"])) for r in got) == sorted(map(repr, components(made(), 85)))
    assert all(r["kept"] == (r["component_id"] is None or r["doc_id"] == r["component_id"]) for r in got)


def test_minmax_estimates_jaccard():
    rng = np.random.default_rng(1)
    a, b = (rng.integers(0, 1 << 63, 400, dtype=np.uint64) for _ in range(2))
    x, y = np.concatenate([a, b[:50]]), np.concatenate([a, b[50:100]])
    s = minmax.signatures(np.concatenate([x, y]), np.array([0, len(x)]), 400)
    assert abs((s[0] == s[1]).mean() - 400 / 500) < 0.05


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def passes(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    if kind == "card":
        return 14 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0
    return kind == "email" or 10 <= len(d) <= 15


def test_base_spans_equal_plain_patterns():
    rng = random.Random(5)
    parts = ["a@b.c", "@", ".", "1", "255", "4111111111111111", " ", "-", "+1", "(017)", "555-7713", "x", "10.0.0.1", "%", "\n", "é", "300.1.1.1", "0004", "@x@y.z"]
    for _ in range(4000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        want = sorted(((m.start(), list(PATTERNS).index(k), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, t) if passes(k, m.group())))
        assert [(s, pii.KINDS.index(k), e) for s, k, e in pii.base_spans(t)] == want, t


def test_best_segments_are_the_best():
    rng = random.Random(2)
    for _ in range(200):
        n = rng.randint(1, 5)
        found = [(i, j, 0, 0) for i in range(n) for j in range(i + 1, min(i + 3, n) + 1)]
        score = np.array([[rng.uniform(-2, 2) for _ in pii.KINDS] for _ in found])

        def best(at):
            return 0 if at == n else max([best(at + 1)] + [score[c].max() + best(j) for c, (i, j, _, _) in enumerate(found) if i == at])

        got = pii.best_segments(n, found, score, 0.0)
        assert abs(sum(score[c, k] for c, k in got) - best(0)) < 1e-9
        total = pii.gradient(n, found, score)
        assert (total <= 1 + 1e-9).all() and (total >= 0).all()


def test_field_adds_cards_that_stand_together(spark, docs, nothing):
    train = [(i, f"go 4111111111111111 and +1 (017) 555-77{i:02d} at a{i}@b.org or 10.0.{i}.7 now 2024 v1.{i}", "en", "s", 1, True, "x", 1) for i in range(60)]
    train.append((99, "two 4111111111111111 5500005555555559 cards", "en", "s", 1, True, "x", 1))
    got = {r["doc_id"]: r["spans"] for r in pii.find_spans(spark.createDataFrame(train, SCHEMA)).collect()}
    assert [(s["kind"], s["start"], s["end"], s["base"]) for s in got[99]] == [("card", 4, 20, False), ("card", 21, 37, False)]
    assert all(s["base"] for i in range(60) for s in got[i]) and all(len(got[i]) == 4 for i in range(60))
    assert pii.find_spans(docs).filter("spans is null").count() == 0 and pii.find_spans(nothing).collect() == []
    assert pii.redact(docs).columns == docs.columns and pii.redact(docs).count() == docs.count()


def test_bpe_equals_tiktoken_and_decodes(docs, nothing):
    import tiktoken

    path, pattern = bpe.default_vocabulary()
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    ref = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    got = [(r["doc_id"], list(r["ids"]), bytes(r["decoded"]).decode()) for r in bpe.encode(docs, decoded=True).collect()]
    assert sorted(map(repr, got)) == sorted(repr((i, ref.encode_ordinary(t or ""), t or "")) for i, t, *_ in made())
    assert bpe.encode(nothing).collect() == [] and bpe.digests(docs).count() == docs.count()


def test_byte_bpe_query_equals_tiktoken(spark):
    """The registered query over all documents: counts and both hashes; long pieces are not kept."""
    import tiktoken

    path, pattern = bpe.default_vocabulary()
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    ref = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    want = []
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        ids = ref.encode_ordinary(r["text"] or "")
        want.append((r["doc_id"], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest()))
    got = bpe.op7_byte_bpe(spark, SF).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(want)
    coder = bpe.ByteBpe(path, pattern)
    texts = ["日本語" * 3000, "z" * 65 + " short", "z" * 9000, "日本語" * 3000]
    for _ in range(2):
        assert [x.tolist() for x in coder.encode(texts)] == [ref.encode_ordinary(t) for t in texts]
        assert all(len(p) <= bpe.KEPT for p in coder.kept)


def test_token_counts_equal_unigram_library(docs):
    from tokenizers import Tokenizer, models, pre_tokenizers

    pieces, unk = unigram.read_pieces(unigram.default_vocabulary())
    ref = Tokenizer(models.Unigram(pieces, unk, True))
    ref.pre_tokenizer = pre_tokenizers.Metaspace(replacement=unigram.MARK, prepend_scheme="always", split=True)
    got = sorted(map(repr, (tuple(r) for r in unigram.token_counts(docs).collect())))
    assert got == sorted(repr((i, len(ref.encode(t or "").ids))) for i, t, *_ in made())
    rng, c = random.Random(4), unigram.counter(unigram.default_vocabulary())
    for alphabet in ("ab c", "▁ ab", "é🙂 a\n", "<0x>AB ", "日本ł q"):
        for _ in range(300):
            x = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 24)))
            assert c.total(x) == len(ref.encode(x).ids), x


def test_quality_rules_edges(docs, nothing):
    got = {r["doc_id"]: r for r in line_rules.quality(docs.filter("doc_id is not null")).collect()}
    for i, t, *_ in made():
        if i is not None:
            w = words(t)
            seen = collections.Counter(tuple(w[a : a + 3]) for a in range(len(w) - 2))
            hit = {a + j for a in range(len(w) - 2) if seen[tuple(w[a : a + 3])] > 1 for j in range(3)}
            assert (got[i]["n_words"], got[i]["n_repeat_words"], got[i]["word_chars"]) == (len(w), len(hit), sum(map(len, w)))
    assert line_rules.quality(docs).count() == docs.count() and line_rules.quality(nothing).collect() == []


def test_mixing_comes_near_targets(docs, nothing, spark):
    out = mixing.mix_sources(docs, stratum=5).collect()
    assert len(out) == docs.count() and all(0 <= r["taken"] <= 3 * r["size"] for r in out)
    assert mixing.mix_sources(nothing).collect() == []
    many = spark.createDataFrame([(i, "w " * (1 + i % 97), "en", f"s{i % 5}" if i % 3 else "s0", 1, True, "x", 1) for i in range(6000)], SCHEMA)
    per = collections.defaultdict(int)
    for r in (rows := mixing.mix_sources(many, stratum=500).collect()):
        per[r["source"]] += r["taken"]
    for r in rows:
        assert abs(per[r["source"]] - r["target"]) < 0.02 * r["target"] + 97


def test_mixing_level_of_equal_ratios(spark):
    sizes = {"A": 20, "B": 100, "C": 100, "D": 20}
    sized = spark.createDataFrame(list(sizes.items()), "source string, size long")
    got = {r["__src"]: r["target"] for r in mixing.source_targets(sized).collect()}
    level = 240 / 7  # no source is capped: weights 1, 2, 3, 1
    assert got == pytest.approx({"A": level, "B": 2 * level, "C": 3 * level, "D": level})
    capped = spark.createDataFrame([("A", 10), ("B", 500), ("C", 500), ("D", 10)], "source string, size long")
    assert {r["__src"]: r["target"] for r in mixing.source_targets(capped).collect()} == pytest.approx({"A": 30, "B": 384, "C": 576, "D": 30})


def test_chroma_aligns_shifted_copies(spark, nothing):
    rng = np.random.default_rng(3)
    tone = (128 + 50 * np.sin(np.cumsum(rng.choice([0.2, 0.35, 0.5, 0.8], 40).repeat(150))) + rng.normal(0, 1, 6000)).clip(0, 255).astype(np.uint8)
    other = (128 + 50 * np.sin(np.cumsum(rng.choice([0.25, 0.4, 0.6, 0.9], 40).repeat(150)))).clip(0, 255).astype(np.uint8)
    audio = [(50, tone.tobytes()), (3, tone.tobytes()), (4, tone[1600:].tobytes()), (5, other.tobytes()), (6, b""), (7, None), (8, b"x" * 100), (None, tone.tobytes()), (9, np.where(np.arange(6000) > 4500, other, tone).tobytes())]
    prints = chroma.fingerprint_table(spark.createDataFrame(audio, "doc_id long, audio binary"), audio="audio").cache()
    members, pairs = chroma.align(prints, chroma.F.col("doc_id") % 50 == 0)
    assert {r["doc_id"]: r["class_id"] for r in members.collect()} == {50: 3, 3: 3, None: 3, 4: 4, 5: 5, 6: None, 7: None, 8: None, 9: 9}
    assert [(r["query_class"], r["class_id"], r["offset"], r["bit_errors"]) for r in pairs.filter("class_id = 4").collect()] == [(3, 4, -50, 0)]
    fp = {r["doc_id"]: np.array(r["fp"], np.int32).view(np.uint32) for r in prints.collect()}
    _, loose = chroma.align(prints, chroma.F.col("doc_id") % 50 == 0, max_ber=1.0)
    (far,) = loose.filter("class_id = 9").collect()
    assert far["offset"] == 0 and far["bit_errors"] == np.bitwise_count(fp[3] ^ fp[9]).sum() > 0
    assert chroma.fingerprint_table(nothing).collect() == []


def brute_alignments(qs, ds, least=12, max_ber=0.1):
    """(query, recording) with their passing offsets, over all pairs and offsets."""
    out = {}
    for i, q in qs.items():
        for j, d in ds.items():
            for o in range(least - len(q), len(d) - least + 1) if i != j else ():
                a, b = q[max(0, -o) :], d[max(0, o) :]
                n = min(len(a), len(b))
                if n >= least and round((e := int(np.bitwise_count(a[:n] ^ b[:n]).sum())) / (32 * n), 6) <= max_ber:
                    out.setdefault((i, j), set()).add((o, n, e))
    return out


def test_chroma_finds_pairs_without_equal_integers(spark):
    rng = np.random.default_rng(11)

    def noise(n):
        return rng.integers(0, 1 << 32, n, dtype=np.uint32)

    a, frame, long = noise(40), noise(12), noise(1500)
    flip = np.uint32(1) << rng.integers(0, 32, 40).astype(np.uint32)
    fps = {50: a, 1: a ^ flip, 2: (a ^ flip)[20:], 3: np.append((a ^ flip)[28:], noise(30)), 100: np.concatenate([frame, noise(20), frame]), 4: np.append(frame, noise(25)), 150: long, 5: long[700:] ^ np.uint32(5), 6: noise(11), 7: noise(60), 8: np.append(noise(9), a[:12])}
    rows = [(k, [int(x) for x in v.view(np.int32)], k, len(v)) for k, v in fps.items()]
    prints = spark.createDataFrame(rows, "doc_id long, fp array<int>, k1 long, k2 long")
    want = brute_alignments({k: fps[k] for k in (50, 100, 150)}, fps)
    assert {(50, 1), (50, 2), (50, 3), (50, 8), (100, 4), (150, 5)} <= set(want)
    for side in (1 << 19, 30):
        got = {(r["query_class"], r["class_id"]): (r["offset"], r["overlap"], r["bit_errors"]) for r in chroma.align(prints, chroma.F.col("doc_id") % 50 == 0, side=side)[1].collect()}
        assert got.keys() == want.keys() and all(got[k] in want[k] for k in want)


def test_chroma_recall_against_all_offsets(spark):
    prints = chroma.fingerprint_table(spark.read.parquet(f"{SF}/documents.parquet")).cache()
    fp = {r["doc_id"]: np.array(r["fp"], np.int32).view(np.uint32) for r in prints.collect()}
    members, pairs = chroma.align(prints, chroma.F.col("doc_id") % 10 == 0)
    of = {r["doc_id"]: r["class_id"] for r in members.collect()}
    asked = {c for d, c in of.items() if d % 10 == 0 and c is not None}
    want = brute_alignments({c: fp[c] for c in asked}, {c: fp[c] for c in of.values() if c is not None})
    got = {(r["query_class"], r["class_id"]): (r["offset"], r["overlap"], r["bit_errors"]) for r in pairs.collect()}
    assert all(got[k] in want[k] for k in got) and len(got) >= 0.9 * len(want)
    rows = chroma.op4_chroma_alignment(spark, SF).collect()
    found = {(r["doc_id"], r["match_id"]): (r["offset"], r["overlap"], r["bit_errors"]) for r in rows if r["match_id"] is not None}
    fifty = {c for d, c in of.items() if d % 50 == 0}
    assert found == {k: v for k, v in got.items() if k[0] in fifty} and sum(r["match_id"] is None for r in rows) == len(of)


def test_chroma_candidates_do_not_wait():
    """Of 2.2 million candidates (a landmark without bits) only close pairs are kept, also close ones of several landmarks once."""
    rng = np.random.default_rng(7)
    q = rng.integers(0, 1 << 32, 1500, dtype=np.uint32)
    d = rng.integers(0, 1 << 32, 1500, dtype=np.uint32)
    d[100:200] = q[300:400] ^ np.uint32(3)
    a, b = chroma.Windows([q]), chroma.Windows([d])
    masks = np.zeros((4, len(chroma.STEPS)), np.uint32)
    tracemalloc.start()
    i, j = chroma.alike_windows(a, b, masks, 24)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    errors = sum(np.bitwise_count(a.seen[s][:, None] ^ b.seen[s][None]).astype(int) for s in range(chroma.WINDOW))
    assert len(i) == 94 and sorted(zip(i.tolist(), j.tolist())) == sorted(map(tuple, np.argwhere(errors <= 24).tolist()))
    assert peak < 16 << 20


def test_chroma_pairs_are_put_together_in_ranges():
    """2.25 million pairs, all close under every landmark, take 18 MB; putting new ones to all known ones at once took 92 MB."""
    rng = np.random.default_rng(3)
    q, d = (chroma.Windows([np.uint32(1) << rng.integers(0, 32, 1506).astype(np.uint32)]) for _ in range(2))
    masks = np.zeros((8, len(chroma.STEPS)), np.uint32)
    tracemalloc.start()
    i, j = chroma.alike_windows(q, d, masks, 24)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(i) == len(q.key) * len(d.key) and (np.diff(i.astype(np.int64) << 32 | j) > 0).all()
    assert peak < 72 << 20


def test_chroma_classes_in_parts_equal_all_at_once():
    """Queries meet classes in parts of any size; overlaps of all bits, and the ends of recordings, are counted as a loop counts them."""
    rng = np.random.default_rng(9)
    noise = lambda n: rng.integers(0, 1 << 32, n, dtype=np.uint32)
    qs = [noise(n) for n in (12, 13, 40, 90)]
    ds = [np.append(noise(5), qs[0]), qs[1] ^ np.uint32(4), ~qs[2], qs[2][20:], np.append(qs[3][70:], noise(9)), noise(30), qs[3][:50] ^ np.uint32(1)]
    masks = chroma.landmark_masks(list(range(32)), 16, 24)
    q = chroma.Windows(qs)
    whole = chroma.best_alignments(q, ds, masks, 12, 0.1)
    parts = [(i, j + k, *rest) for k in range(len(ds)) for i, j, *rest in chroma.best_alignments(q, ds[k : k + 1], masks, 12, 0.1)]
    assert sorted(whole) == sorted(parts) == [(0, 0, 5, 12, 0), (1, 1, 0, 13, 13), (2, 3, -20, 20, 0), (3, 4, -70, 20, 0), (3, 6, 0, 50, 50)]
    all_bits = chroma.passing(q, chroma.Windows([~x for x in qs]), *np.array([[k, k, 0, 9] for k in range(4)]).T, 12, 1.0)
    assert all_bits[:, 4].tolist() == [32 * len(x) for x in qs]


def test_fingerprints_do_not_depend_on_the_batch():
    rng = np.random.default_rng(5)
    audio = [rng.integers(0, 256, n).astype(np.uint8).tobytes() for n in (0, 1, 255, 256, 479, 480, 700, 5000)] + [b"\x90" * 2000]
    for a, b in zip(chroma.fingerprints(pa.array(audio, pa.binary())), audio, strict=True):
        (alone,) = chroma.fingerprints(pa.array([b], pa.binary()))
        assert a.tolist() == alone.tolist()
        assert len(a) == max(0, (len(b) - chroma.FRAME) // chroma.HOP + 2 - chroma.SPAN)
    assert not chroma.chroma(np.full(600, 144, np.uint8), np.array([0, 32])).any()


def test_quality_classifier_holds_out(spark, docs, nothing):
    sf = SF.replace("0.001", "0.01")
    scored = knn_quality.op3_knn_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").collect()
    assert len(scored) > 40 and np.mean([r["predicted"] == r["quality"] for r in scored]) > 0.9
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in knn_quality.quality_scores(docs, none).collect()} == {0.5}
    assert knn_quality.quality_scores(nothing, none).collect() == []


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_its_oracle(spark, same, name):
    same(entry.queries()[name](spark, SF), entry.oracle_sql()[name])


def test_pipeline_stages_act_on_what_is_kept(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {r["doc_id"] for r in line_rules.quality(docs).filter("kept").select("doc_id").collect()}
    near = {r[0] for r in docs.filter(docs.doc_id.isin(list(kept))).select("doc_id", "text").collect()}
    comp = components([tuple(r) for r in docs.filter(docs.doc_id.isin(list(near))).select("doc_id", "text").collect()], 80)
    stay = {i for i, _, c in comp if i == c}
    out = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"] for r in out} <= stay and len(out) > 0
    assert all(r["n_tokens"] == len(r["ids"]) for r in out)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "near-dedup", "personal data", "source mixing", "byte-level BPE"]
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")
