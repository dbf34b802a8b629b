"""Personal data: exact base patterns, and a semi-Markov conditional random field that adds spans.

Base spans per kind (email, ip, card, phone) are the leftmost non-overlapping matches of a pattern that pass its check.

The field labels regions: runs of neighbouring tokens (no white space inside) with a digit or an at sign, also one spelt (at) or [at].
Candidate segments are 1 to `max_tokens` neighbouring tokens, stripped of outer punctuation, of 6 to `max_chars` characters: the bound on an
entity. Whole-span features (shape, counts, checks, length, the word before) score each with each kind, tokens outside score 0, and
dynamic programming over bounded segments chooses boundaries and kinds jointly. Weights are fitted by gradient ascent
on the exact semi-Markov likelihood, over two bounded sets: at most `sample` regions of the input (those with the smallest hashes of
their text, of at most `region_chars` characters), labelled by the base spans, and `made` regions of examples(), which writes what the base patterns
miss: numbers of cards side by side or with dots, phones without a plus sign, defanged or spelt-out addresses, and numbers that
are none of these. Spans of the best labelling that overlap no base span and lie `margin` above the outside score are added; base spans
always stay. Every step is linear in the text, in tokens and in spans (but for sorting).

Nulls and empty texts have no spans. Offsets are code points, end exclusive. Repeated rows are searched one by one.
On an empty table the weights are 0 and nothing is added. redact() keeps all columns of its input.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.words import slices

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match can only begin where a run of digits does: further on the same run the same rest follows
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGITS = re.compile(r"[^0-9]+")
#: What makes a token begin a region, and what lets the next one go on with it.
TRIGGER = r"[0-9@]|[\[(]at[\])]"
BEGINS, GOES_ON = re.compile(TRIGGER), re.compile(r"[0-9@+()\[\]]")
SPELT = re.compile(r"[\[(]at[\])]")
SPACE = re.compile(r"\s")
TOKEN = re.compile(r"[^\s]+")
OUTER = "\"'()<>[]{},.;:!?*#$%&|"
FEATURES = 1 << 12
Span = tuple[int, str, int]  # start, kind, end


def emails(text: str):
    """By at sign: the local part is the run before it, so no run is scanned twice."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            free = m.end()
        at = text.find("@", max(at + 1, free))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    out = [(a, "email", b) for a, b in emails(text)]
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append((m.start(), "ip", m.end()))
    for m in CARD.finditer(text):
        d = DIGITS.sub("", m.group())
        if 14 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), "card", m.end()))
    for m in PHONE.finditer(text):
        if 10 <= len(DIGITS.sub("", m.group())) <= 15:
            out.append((m.start(), "phone", m.end()))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[1])))


def regions(text: str):
    """(start, end) of each region. A token that is only (at) takes its neighbours along."""
    free, m = 0, BEGINS.search(text)
    while m:
        a = m.start()
        while a > free and not text[a - 1].isspace():
            a -= 1
        b = token_end(text, m.start())
        if SPELT.fullmatch(text, a, b):
            if a - 1 > free and text[a - 1] == " ":
                a -= 1
                while a > free and not text[a - 1].isspace():
                    a -= 1
            b = token_end(text, b + 1) if text[b : b + 1] == " " else b
        while text[b : b + 1] == " " and b + 1 < len(text) and (GOES_ON.search(text, b + 1, to := token_end(text, b + 1)) or 0):
            b = to
        yield a, b
        free = b
        m = BEGINS.search(text, b)


def token_end(text: str, at: int) -> int:
    m = SPACE.search(text, at)
    return m.start() if m else len(text)


def segments(text: str, a: int, b: int, max_tokens: int, max_chars: int = 80) -> tuple[int, list[tuple[int, int, int, int]]]:
    """Tokens of the region text[a:b], and candidates (first token, last token + 1, start, end)."""
    tokens = [(m.start(), m.end()) for m in TOKEN.finditer(text, a, b)]
    out = []
    for i in range(len(tokens)):
        for j in range(i + 1, min(i + max_tokens, len(tokens)) + 1):
            s, e = tokens[i][0], tokens[j - 1][1]
            if e - s > max_chars + 16:  # outer punctuation may still go
                break
            while s < e and text[s] in OUTER and not (text[s] == "(" and j > i + 1):
                s += 1
            while e > s and text[e - 1] in OUTER:
                e -= 1
            if 6 <= e - s <= max_chars:
                out.append((i, j, s, e))
    return len(tokens), out


def luhn_number(rng: random.Random, n: int) -> str:
    body = "".join(rng.choice("0123456789") for _ in range(n - 1))
    return body + next(c for c in "0123456789" if luhn(body + c))


def examples(n: int, seed: int = 1) -> list[tuple[str, list[Span]]]:
    """n made regions with their labels: entities in forms that the base patterns miss, next to numbers that are no entities."""
    rng = random.Random(seed)
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    name = lambda: "".join(rng.choice("abcdefghiklmnoprstuvw") for _ in range(rng.randint(3, 8)))

    def card(sep: str) -> str:
        x = luhn_number(rng, 16)
        return sep.join(x[i : i + 4] for i in range(0, 16, 4))

    def phone() -> str:
        a, b, c = digits(3), digits(3), digits(4)
        return rng.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"0{a} {b} {c}", f"00{digits(2)} {a} {b} {c}", f"({a}) {b} {c}"])

    def ip() -> str:
        return rng.choice(["[.]", "(.)", "[dot]"]).join(str(rng.randint(0, 255)) for _ in range(4))

    def email() -> str:
        at, dot = rng.choice([("(at)", "."), ("[at]", "."), ("[at]", "[dot]"), ("(at)", "(dot)"), (" (at) ", "."), (" [at] ", ".")])
        return f"{name()}{rng.choice(['', '.' + name(), digits(2)])}{at}{name()}{dot}{rng.choice(['org', 'com', 'net', 'de'])}"

    def other() -> str:
        return rng.choice([digits(rng.randint(1, 9)), f"{rng.randint(1900, 2090)}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}", f"v{digits(1)}.{digits(2)}.{digits(1)}", f"{digits(3)},{digits(3)}.{digits(2)}", f"{digits(1)}.{digits(2)}", f"x{digits(6)}", f"{digits(2)}:{digits(2)}:{digits(2)}", f"{name()}_{digits(3)}@", f"978-{digits(1)}-{digits(4)}-{digits(4)}-{digits(1)}", "".join(rng.choice("0123456789abcdef") for _ in range(32)), f"({digits(2)})", f"{digits(4)} {digits(4)}"])

    leads = {"email": ["mail", "contact", "write to", ""], "ip": ["host", "from", "server", ""], "card": ["card", "cards", "paid with", ""], "phone": ["call", "tel", "phone", ""], "": ["in", "order", "no", "page", "on", ""]}
    out = []
    for _ in range(n):
        kind = rng.choice([*KINDS, "", ""])
        lead = rng.choice(leads[kind])
        text, spans = f"{lead}: " if lead and rng.random() < 0.4 else f"{lead} " if lead else "", []
        parts = {"email": [email()], "ip": [ip()], "phone": [phone()], "card": [card(""), card("")] if rng.random() < 0.5 else [card(".")], "": [other() for _ in range(rng.randint(1, 3))]}[kind]
        for k, x in enumerate(parts):
            text += " " * (k > 0)
            if kind:
                spans.append((len(text), kind, len(text) + len(x)))
            text += x
        out.append((text + rng.choice(["", ".", ","]), spans))
    return out


def features(text: str, s: int, e: int) -> list[int]:
    """Hashed whole-span features of text[s:e], the same for every process."""
    x = text[s:e]
    digits = DIGITS.sub("", x)
    shape = re.sub(r"[0-9]+", "9", re.sub(r"[^\W\d_]+", "a", x))
    before = text[max(0, s - 24) : s].rstrip(OUTER + "=\x20").rpartition(" ")[2].lower()
    parts = x.split(".")
    facts = [
        "bias", f"shape {shape[:24]}", f"digits {len(digits)}", f"letters {min(3, len(x) - len(digits)) if re.search(r'[^\W\d_]', x) else 0}", f"at {x.count('@')}", f"dots {min(6, x.count('.'))}", f"plus {x[:1] == '+'} {'+' in x[1:]}",
        f"hyphens {min(4, x.count('-'))}", f"blanks {min(4, x.count(' '))}", f"brackets {x.count('(')}{x.count(')')}", f"luhn {14 <= len(digits) <= 19 and luhn(digits)} {len(digits) + x.count(' ') + x.count('-') == len(x)}",
        f"quad {len(parts) == 4 and all(p.isdecimal() and len(p) < 4 and int(p) < 256 for p in parts)}", f"length {min(12, len(x) // 4)}", f"before {before[:12]}",
    ]
    return [int.from_bytes(hashlib.blake2b(f.encode(), digest_size=4).digest(), "little") % FEATURES for f in facts]


def score_table(text: str, found: list[tuple[int, int, int, int]], weights: np.ndarray) -> np.ndarray:
    return np.array([weights[:, features(text, s, e)].sum(1) for _, _, s, e in found]) if found else np.zeros((0, len(KINDS)))


def best_segments(n: int, found: list, score: np.ndarray, margin: float) -> list[tuple[int, int]]:
    """(candidate, kind) of the best labelling of n tokens."""
    by_end: list[list[int]] = [[] for _ in range(n + 1)]
    for c, (_, j, _, _) in enumerate(found):
        by_end[j].append(c)
    value, back = [0.0] * (n + 1), [None] * (n + 1)
    for j in range(1, n + 1):
        value[j] = value[j - 1]
        for c in by_end[j]:
            k = int(score[c].argmax())
            v = value[found[c][0]] + score[c, k] - margin
            if v > value[j]:
                value[j], back[j] = v, (c, k)
    out, j = [], n
    while j > 0:
        if back[j] is None:
            j -= 1
        else:
            out.append(back[j])
            j = found[back[j][0]][0]
    return out[::-1]


def gradient(n: int, found: list, score: np.ndarray) -> np.ndarray:
    """The probability of every (candidate, kind), by the forward-backward recursion over segments."""
    size = score.shape[0]
    mass = np.logaddexp.reduce(score, 1) if size else score[:, 0]
    begin: list[list[int]] = [[] for _ in range(n + 1)]
    end: list[list[int]] = [[] for _ in range(n + 1)]
    for c, (i, j, _, _) in enumerate(found):
        begin[i].append(c), end[j].append(c)
    f, g = np.zeros(n + 1), np.zeros(n + 1)
    for j in range(1, n + 1):
        f[j] = np.logaddexp.reduce([f[j - 1], *(f[found[c][0]] + mass[c] for c in end[j])])
    for i in range(n - 1, -1, -1):
        g[i] = np.logaddexp.reduce([g[i + 1], *(g[found[c][1]] + mass[c] for c in begin[i])])
    p = np.array([f[i] + g[j] - f[n] for i, j, _, _ in found])
    return np.exp(p[:, None] + score)


def fit(labelled: list[tuple[str, int, list[Span]]], max_tokens: int = 4, max_chars: int = 80, rounds: int = 12, rate: float = 0.3, decay: float = 1e-3) -> np.ndarray:
    """Weights (kind x feature) from (text, where its region begins, spans)."""
    weights = np.zeros((len(KINDS), FEATURES))
    data = []
    for text, lead, spans in labelled:
        n, found = segments(text, lead, len(text), max_tokens, max_chars)
        if found:
            gold = {(s, e): KINDS.index(k) for s, k, e in spans}
            feats = np.array([features(text, s, e) for _, _, s, e in found])
            want = np.zeros((len(found), len(KINDS)))
            for c, (_, _, s, e) in enumerate(found):
                if (s, e) in gold:
                    want[c, gold.pop((s, e))] = 1
            if not gold:  # labels that no candidate can express are left out
                data.append((n, found, feats, want))
    for r in range(rounds):
        for n, found, feats, want in data:
            score = weights[:, feats].sum(2).T
            step = want - gradient(n, found, score)
            for k in range(len(KINDS)):
                np.add.at(weights[k], feats.ravel(), np.repeat(step[:, k], feats.shape[1]) * rate / (1 + r))
        weights *= 1 - decay
    return weights


def all_spans(text: str, weights: np.ndarray, max_tokens: int, margin: float, max_chars: int = 80) -> list[tuple[int, str, int, bool]]:
    base = base_spans(text)
    out = [(s, k, e, True) for s, k, e in base]
    if weights.any():
        starts, ends = [s for s, _, _ in base], []
        for _, _, e in base:
            ends.append(max(e, ends[-1]) if ends else e)
        for a, b in regions(text):
            n, found = segments(text, a, b, max_tokens, max_chars)
            # of the base spans that begin before a candidate ends, the furthest end must not lie in it
            found = [c for c in found if not (i := bisect_left(starts, c[3])) or ends[i - 1] <= c[2]]
            if found:
                out += [(found[c][2], KINDS[k], found[c][3], False) for c, k in best_segments(n, found, score_table(text, found, weights), margin)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[1])))


def by_base(text: str, lead: int) -> tuple[str, int, list[Span]] | None:
    """A region with the labels of the base patterns; None where several numbers in a row may hide some from them."""
    if any(len(DIGITS.sub("", m.group())) > 19 for m in CARD.finditer(text)):
        return None
    return text, lead, [s for s in base_spans(text) if s[0] >= lead]


def train(docs: DataFrame, text: str = "text", sample: int = 1500, made: int = 1200, max_tokens: int = 4, max_chars: int = 80, region_chars: int = 300) -> np.ndarray:
    """Weights from at most `sample` regions of docs and `made` examples; all 0 where docs has no region."""

    def cut(batches):
        for b in slices(batches, "text"):
            out = []
            for t in b.column(0).filter(pc.fill_null(pc.match_substring_regex(b.column(0), TRIGGER), False)).to_pylist():
                for a, z in regions(t):
                    if z - a <= region_chars:
                        lead = t[max(0, a - 24) : a]
                        out.append(f"{len(lead):02d}{lead}{t[a:z]}")
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["region"])

    found = docs.select(F.col(text).alias("text")).mapInArrow(cut, "region string").orderBy(F.xxhash64("region"), "region").limit(sample)
    raw = sorted(r["region"] for r in found.collect())
    labelled = [x for r in raw if (x := by_base(r[2:], int(r[:2])))]
    more = [(t, next(iter(regions(t)), (0, 0))[0], spans) for t, spans in examples(made)] if raw else []
    return fit(labelled + more, max_tokens, max_chars)


def find_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", sample: int = 1500, max_tokens: int = 4, max_chars: int = 80, margin: float = 2.0) -> DataFrame:
    """(doc_id, spans): array of (kind, start, end, base) by start, then kind as listed in KINDS."""
    weights = train(docs, text, sample, max_tokens=max_tokens, max_chars=max_chars)
    kind = dict(docs.select(doc_id).dtypes)[doc_id]
    item = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())])

    def run(batches):
        for b in slices(batches, "text"):
            likely = pc.fill_null(pc.match_substring_regex(b.column(1), TRIGGER), False).to_pylist()
            spans = [[{"kind": k, "start": s, "end": e, "base": o} for s, k, e, o in all_spans(t.as_py(), weights, max_tokens, margin, max_chars)] if yes else [] for t, yes in zip(b.column(1), likely, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, pa.list_(item))], ["doc_id", "spans"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, spans array<struct<kind:string,start:int,end:int,base:boolean>>").withColumnRenamed("doc_id", doc_id)


def redact(docs: DataFrame, text: str = "text", sample: int = 1500, max_tokens: int = 4, max_chars: int = 80, margin: float = 2.0) -> DataFrame:
    """docs with each span, overlapping ones as one, replaced by its kind in brackets; other columns and rows stay."""
    weights = train(docs, text, sample, max_tokens=max_tokens, max_chars=max_chars)

    def clean(t: str) -> str:
        out, at = [], 0
        for s, k, e, _ in all_spans(t, weights, max_tokens, margin, max_chars):
            if s >= at:
                out += [t[at:s], f"[{k}]"]
            at = max(at, e)
        return "".join([*out, t[at:]])

    def run(batches):
        for b in slices(batches, text):
            i = b.schema.get_field_index(text)
            likely = pc.fill_null(pc.match_substring_regex(b.column(i), TRIGGER), False).to_pylist()
            texts = [clean(t.as_py()) if yes else t.as_py() for t, yes in zip(b.column(i), likely, strict=True)]
            yield b.set_column(i, b.schema.field(i), pa.array(texts, b.schema.field(i).type))

    return docs.mapInArrow(run, docs.schema)


def op6_personal_data(spark, sf_dir: str) -> DataFrame:
    spans = find_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))

    def number(kind: str):
        return F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")

    def listed(these):
        return F.array_join(F.transform(these, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = listed(F.filter("spans", lambda s: s["base"]))
    return spans.select("doc_id", *map(number, KINDS), F.sha2(base, 256).alias("base_sha256"), listed("spans").alias("spans"))
