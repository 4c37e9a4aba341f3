"""Personal data: fixed base patterns, and a semi-Markov conditional random field.

The base patterns decide what must be found. The field adds spans that they miss, such as a
phone number without a plus sign, a masked address, or a number that stands right before
another one. It scores whole candidate spans by features of the span and of what stands beside
it; a dynamic program over segments of bounded length picks boundaries and types together.

The field is trained here by its likelihood: on base spans of a bounded sample, some of them
rewritten into forms that the base patterns do not match.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from orthant.llm.common import bounded_sample, map_texts, settle

KINDS = ("email", "ip", "card", "phone")
#: Documents that the field is trained on, at most.
SAMPLE_DOCS = 1_500
#: Tokens in a candidate span, at most.
SPAN_TOKENS = 24
#: A region longer than this is decoded in overlapping parts of so many tokens.
REGION_TOKENS = 400

# The base patterns.
EMAIL_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
EMAIL_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

RUN = re.compile(r"[0-9][0-9\x20().+-]*")
TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|\s+|[^\sA-Za-z0-9]")
NON_DIGIT = re.compile(r"[^0-9]+")
WORD_BEFORE = re.compile(r"([^\W\d_]+)[^\w]{0,3}$")

Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        if i % 2:
            v = v * 2 - 9 * (v > 4)
        total += v
    return total % 10 == 0


def octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or (len(part) == 3 and part <= "255")


def digit_runs(text: str) -> list[tuple[int, int]]:
    """Stretches that hold all matches of the number patterns: digits with what may stand
    between them, and a plus sign right before."""
    runs = []
    for m in RUN.finditer(text):
        start = m.start()
        runs.append((start - 1 if start and text[start - 1] == "+" else start, m.end()))
    return runs


def base_spans(text: str, runs: list[tuple[int, int]] | None = None) -> list[Span]:
    """The leftmost non-overlapping matches of each kind that pass its check, ordered by start
    and then by kind. Linear in the text: each at-sign and each digit run is read once."""
    found = []
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in EMAIL_LOCAL:
            start -= 1
        domain = EMAIL_DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            free = domain.end()
            found.append((start, free, 0))
        at = text.find("@", at + 1)
    for a, b in digit_runs(text) if runs is None else runs:
        if b - a < 7:
            continue
        found += [
            (*m.span(), 1) for m in IP.finditer(text, a, b) if all(map(octet, m[0].split(".")))
        ]
        for m in CARD.finditer(text, a, b):
            digits = NON_DIGIT.sub("", m[0])
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((*m.span(), 2))
        for m in PHONE.finditer(text, a, b):
            if 9 <= len(NON_DIGIT.sub("", m[0])) <= 15:
                found.append((*m.span(), 3))
    found.sort(key=lambda s: (s[0], s[2]))
    return [(a, b, KINDS[k]) for a, b, k in found]


def regions(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Stretches where a candidate may stand: longer digit runs and what surrounds an at-sign."""
    marks = [(a, b) for a, b in runs if b - a >= 7]
    for sign in ("@", "[at]", "(at)", "{at}"):
        at = text.find(sign)
        while at >= 0:
            a, b = at, at + len(sign)
            limit = at - 64
            while a > max(0, limit) and (text[a - 1] in EMAIL_LOCAL or text[a - 1] == " " and a == at):
                a -= 1
            end = re.compile(r"(?: ?[A-Za-z0-9.-]| ?[\[({]dot[\])}])*").match(text, b, b + 96)
            marks.append((a, end.end()))
            at = text.find(sign, b)
    marks.sort()
    out: list[list[int]] = []
    for a, b in marks:
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def side(c: str) -> str:
    return "edge" if not c else "d" if c.isdigit() else "a" if c.isalpha() else "s" if c.isspace() else c


def span_features(text: str, a: int, b: int) -> tuple[str, ...]:
    """Features of the whole span and of what stands right beside it."""
    span = text[a:b]
    groups = [g for g in NON_DIGIT.split(span) if g]
    digits = "".join(groups)
    marks = "".join(sorted({c for c in span if not c.isalnum()}))
    out = [
        f"digits={min(len(digits), 20)}",
        f"groups={'-'.join(str(len(g)) for g in groups[:7])}",
        f"marks={marks}",
        f"head={span[0] if not span[0].isalnum() else side(span[0])}",
        f"sides={side(text[a - 1 : a])}|{side(text[b : b + 1])}",
        f"letters={any(map(str.isalpha, span))}",
    ]
    if 12 <= len(digits) <= 19:
        out.append(f"luhn={luhn(digits)}|{marks in ('', ' ', '-')}")
    if len(groups) == 4 and marks == ".":
        out.append(f"octets={all(map(octet, groups))}")
    low = span.lower()
    if "@" in span or "at]" in low or "at)" in low or "at}" in low:
        tail = re.split(r"[.\])}\s]", span)[-1]
        out.append(f"ats={span.count('@')}|dotted={'.' in span or 'dot' in low}|tail={tail.isalpha() and 2 <= len(tail) <= 6}")
        out.append(f"space={' ' in span}|{'[' in span or '(' in span or '{' in span}")
    before = WORD_BEFORE.search(text[max(0, a - 24) : a])
    if before:
        out.append(f"before={before[1].lower()[:10]}")
    return tuple(out)


def candidates(text: str, tokens: list[tuple[int, int]]) -> list[tuple[int, int, tuple[int, ...], tuple]]:
    """(first token, end token, kinds, features) of the spans worth scoring."""
    out = []
    n = len(tokens)
    kind_of = [
        "d" if text[a].isdigit() and text[a].isascii() else "a" if text[a].isalpha() else "s" if text[a].isspace() else text[a]
        for a, _ in tokens
    ]
    for i in range(n):
        if kind_of[i] not in "da+(":
            continue
        digits = dots = 0
        number, ats = kind_of[i] != "a", 0
        for j in range(i, min(n, i + SPAN_TOKENS)):
            k, (a, b) = kind_of[j], tokens[j]
            if k == "d":
                digits += b - a
            elif k == ".":
                dots += 1
            elif k == "@" or k == "a" and text[a:b].lower() == "at" and j > i and text[a - 1] in "[({":
                ats += 1
            if k == "a" or k not in "d.s()+-":
                number = False
            if k == "s" and b - a > 1 or digits > 24 or ats > 1:
                break
            if k not in "da" or not number and not ats:
                continue
            if number and ats == 0:
                kinds = tuple(
                    y for y, fits in ((1, dots == 3 and digits >= 4), (2, digits >= 11), (3, 7 <= digits <= 16)) if fits
                )
            else:
                kinds = (0,) if ats == 1 and j > i + 1 and kind_of[i] in "da" else ()
            if kinds:
                out.append((i, j + 1, kinds, span_features(text, tokens[i][0], b)))
    return out


@dataclass
class Field:
    """Weights of (kind, feature), and of moving from one kind to the next (4: outside)."""

    weights: dict[tuple[int, str], float]
    moves: list[list[float]]

    def spans_by_end(self, text: str, tokens: list[tuple[int, int]], n: int):
        """For each end: segments (start, kind, score, features). Outside segments score 0."""
        ends: list[list] = [[] for _ in range(n + 1)]
        for i, j, kinds, features in candidates(text, tokens):
            for y in kinds:
                score = sum(self.weights.get((y, f), 0.0) for f in features)
                ends[j].append((i, y, score, features))
        return ends

    def best(self, text: str, tokens: list[tuple[int, int]], taken: list[Span]) -> list[Span]:
        """The best segmentation, with no span over a taken stretch."""
        n = len(tokens)
        ends = self.spans_by_end(text, tokens, n)
        lowest = -1e18
        best = [[lowest] * 5 for _ in range(n + 1)]
        back: list[list] = [[None] * 5 for _ in range(n + 1)]
        best[0][4] = 0.0
        for j in range(1, n + 1):
            prior = best[j - 1]
            y = max(range(5), key=lambda y: prior[y] + self.moves[y][4])
            best[j][4], back[j][4] = prior[y] + self.moves[y][4], (j - 1, y)
            for i, kind, score, _ in ends[j]:
                a, b = tokens[i][0], tokens[j - 1][1]
                if any(a < e and s < b for s, e, _ in taken):
                    continue
                prior = best[i]
                y = max(range(5), key=lambda y: prior[y] + self.moves[y][kind])
                value = prior[y] + self.moves[y][kind] + score
                if value > best[j][kind]:
                    best[j][kind], back[j][kind] = value, (i, y)
        out, j = [], n
        y = max(range(5), key=lambda y: best[n][y])
        while j > 0:
            i, before = back[j][y]
            if y < 4:
                out.append((tokens[i][0], tokens[j - 1][1], KINDS[y]))
            j, y = i, before
        return out[::-1]

    def gradient(self, text: str, tokens: list[tuple[int, int]], gold: dict):
        """Gradient of the log likelihood of the gold segments: observed minus expected counts."""
        n = len(tokens)
        ends = self.spans_by_end(text, tokens, n)
        for j in range(1, n + 1):
            ends[j].append((j - 1, 4, 0.0, ()))
        alpha = [[-1e30] * 5 for _ in range(n + 1)]
        alpha[0][4] = 0.0
        for j in range(1, n + 1):
            for i, y, score, _ in ends[j]:
                total = _logsum([alpha[i][z] + self.moves[z][y] for z in range(5)]) + score
                alpha[j][y] = _logsum([alpha[j][y], total])
        beta = [[-1e30] * 5 for _ in range(n + 1)]
        beta[n] = [0.0] * 5
        whole = _logsum(alpha[n])
        up: dict = defaultdict(float)
        moved: dict = defaultdict(float)
        for j in range(n, 0, -1):
            for i, y, score, features in ends[j]:
                for z in range(5):
                    value = self.moves[z][y] + score + beta[j][y]
                    beta[i][z] = _logsum([beta[i][z], value])
                    p = math.exp(min(0.0, alpha[i][z] + value - whole))
                    if p > 1e-9:
                        moved[z, y] -= p
                        for f in features:
                            up[y, f] -= p
        j, y_before = 0, 4
        while j < n:
            end, y = gold.get(j, (j + 1, 4))
            features = next((f for i, k, _, f in ends[end] if i == j and k == y), None)
            if features is None:
                end, y, features = j + 1, 4, ()
            moved[y_before, y] += 1
            for f in features:
                up[y, f] += 1
            j, y_before = end, y
        return up, moved


def _logsum(values: list[float]) -> float:
    top = max(values)
    return top + math.log(sum(math.exp(v - top) for v in values)) if top > -1e29 else top


def tokenize(text: str, a: int, b: int) -> list[tuple[int, int]]:
    return [m.span() for m in TOKEN.finditer(text, a, b)]


def rewrite(span: str, kind: str, rng: random.Random) -> str:
    """Another way to write a base span, outside the base patterns."""
    if kind == "email":
        name, host = span.split("@", 1)
        at, dot = rng.choice([("[at]", "[dot]"), (" [at] ", " [dot] "), ("(at)", "."), (" (at) ", " (dot) "), (" @ ", ".")])
        return name + at + host.replace(".", dot)
    if kind == "phone":
        d = NON_DIGIT.sub("", span)[-10:]
        form = rng.choice(["({}) {}-{}", "{}-{}-{}", "{}.{}.{}", "{} {} {}", "1-{}-{}-{}", "({}) {} {}"])
        return form.format(d[:3], d[3:6], d[6:])
    if kind == "card":
        d = NON_DIGIT.sub("", span)
        return rng.choice([" ", "-", "."]).join(d[i : i + 4] for i in range(0, len(d), 4))
    return span


def examples(text: str, rng: random.Random) -> list[tuple[str, list[Span]]]:
    """Training stretches of a text: each region with its base spans, and a rewritten copy."""
    runs = digit_runs(text)
    spans = base_spans(text, runs)
    out = []
    for a, b in regions(text, runs):
        left, right = max(0, a - 24), min(len(text), b + 8)
        inside = [s for s in spans if a <= s[0] and s[1] <= b]
        piece = text[left:right]
        kept = [(s - left, e - left, k) for s, e, k in inside]
        kept = [s for i, s in enumerate(kept) if all(s[0] >= o[1] or s[1] <= o[0] for o in kept[:i])]
        out.append((piece, kept))
        for s, e, k in kept[:1]:
            new = rewrite(piece[s:e], k, rng)
            out.append((piece[:s] + new + piece[e:], [(s, s + len(new), k)]))
        if kept and rng.random() < 0.5:
            s, e, k = kept[0]
            number = "".join(rng.choice("0123456789") for _ in range(rng.choice((8, 14, 16))))
            extra = [(e + 1, e + 1 + len(number), "card")] if len(number) > 11 and luhn(number) else []
            out.append((f"{piece[:e]} {number}{piece[e:]}", [(s, e, k), *extra]))
    return out


def train(pieces: list[tuple[str, list[Span]]], rounds: int = 4, rate: float = 0.3) -> Field:
    """Gradient ascent on the likelihood, one stretch at a time, with adaptive steps."""
    field = Field({}, [[0.0] * 5 for _ in range(5)])
    seen: dict = defaultdict(float)
    order = list(range(len(pieces)))
    rng = random.Random(7)
    for _ in range(rounds):
        rng.shuffle(order)
        for p in order:
            text, spans = pieces[p]
            tokens = tokenize(text, 0, len(text))
            place = {a: i for i, (a, _) in enumerate(tokens)}
            ends = {b: i + 1 for i, (_, b) in enumerate(tokens)}
            gold = {
                place[a]: (ends[b], KINDS.index(k)) for a, b, k in spans if a in place and b in ends
            }
            up, moved = field.gradient(text, tokens, gold)
            for key, g in up.items():
                seen[key] += g * g
                field.weights[key] = field.weights.get(key, 0.0) * 0.9995 + rate * g / math.sqrt(
                    seen[key] + 1e-6
                )
            for (z, y), g in moved.items():
                seen[z, y] += g * g
                field.moves[z][y] += rate * g / math.sqrt(seen[z, y] + 1e-6)
    return field


def fit_field(docs: DataFrame, text: str = "text", sample_docs: int = SAMPLE_DOCS) -> Field:
    """A field trained on at most ``sample_docs`` documents that hold a digit or an at-sign."""
    usable = docs.select("doc_id", F.col(f"`{text}`").alias("__t")).where(F.col("__t").rlike("[0-9@]"))
    ids = usable.select("doc_id").where(F.col("doc_id").isNotNull()).distinct()
    chosen = bounded_sample(ids, "doc_id", sample_docs)
    rows = usable.join(F.broadcast(chosen), "doc_id")  # at most sample_docs ids

    def kernel():
        def run(texts):
            found = []
            for t in texts:
                rng = random.Random(hashlib.md5(t.encode("utf-8")).digest())
                pieces = [x for x in examples(t, rng) if len(x[0]) <= 400]
                found.append(repr(pieces[:24]))
            return {"pieces": found}

        return run

    added = StructType([StructField("pieces", StringType())])
    found = map_texts(rows, "__t", kernel, added, ["doc_id"])
    found = found.orderBy(F.xxhash64("doc_id"), "doc_id", "pieces").limit(sample_docs).collect()
    import ast

    return train([x for r in found for x in ast.literal_eval(r["pieces"])])


def all_spans(text: str, field: Field) -> tuple[list[Span], list[Span]]:
    """Base spans, and those the field adds beside them."""
    runs = digit_runs(text)
    base = base_spans(text, runs)
    added: list[Span] = []
    ordered = base[:]
    for a, b in regions(text, runs):
        while ordered and max(s[1] for s in ordered[:4]) <= a - 64:
            del ordered[:4]
        taken = [s for s in ordered if s[0] < b and s[1] > a] if len(ordered) < 64 else _within(ordered, a, b)
        if sum(e - s for s, e, _ in taken) >= b - a - 6 and len(taken) == 1:
            continue
        tokens = tokenize(text, a, b)
        start = 0
        while start < len(tokens):
            part = tokens[start : start + REGION_TOKENS]
            found = field.best(text, part, taken)
            more = start + REGION_TOKENS < len(tokens)
            edge = part[-SPAN_TOKENS][0] if more else b
            added += [s for s in found if s[0] < edge and (not added or s[0] >= added[-1][1])]
            start += REGION_TOKENS - SPAN_TOKENS if more else REGION_TOKENS
    return base, added


def _within(spans: list[Span], a: int, b: int) -> list[Span]:
    out = []
    for s in spans:
        if s[0] >= b:
            break
        if s[1] > a:
            out.append(s)
    return out


def joined(spans: list[Span]) -> str:
    ordered = sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))
    return ",".join(f"{k}:{a}:{b}" for a, b, k in ordered)


def find_personal_data(
    df: DataFrame, field: Field, text: str = "text", keep: list[str] | None = None
) -> DataFrame:
    """``n_email``, ``n_ip``, ``n_card``, ``n_phone`` and ``base_sha256`` of the base spans,
    ``spans`` (all spans as kind:start:end) and ``n_added`` of every whole text.

    Offsets count code points, the end is exclusive. Null and empty texts have no spans.
    Repeated rows are searched each; other columns are ignored.
    """
    shared = df.sparkSession.sparkContext.broadcast(field)  # bounded by the training sample
    keep = ["doc_id"] if keep is None else keep

    def kernel():
        model = shared.value
        settle()

        def run(texts):
            out: dict[str, list] = {f"n_{k}": [] for k in KINDS}
            out |= {"base_sha256": [], "spans": [], "n_added": []}
            for t in texts:
                base, added = all_spans(t, model)
                for k in KINDS:
                    out[f"n_{k}"].append(sum(s[2] == k for s in base))
                out["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
                out["spans"].append(joined(base + added))
                out["n_added"].append(len(added))
            return out

        return run

    fields = [StructField(f"n_{k}", LongType()) for k in KINDS]
    fields += [StructField("base_sha256", StringType()), StructField("spans", StringType())]
    fields += [StructField("n_added", LongType())]
    return map_texts(df, text, kernel, StructType(fields), keep)
