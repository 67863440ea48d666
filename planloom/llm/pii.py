"""Personal data: pattern rules, and a semi-Markov conditional random field that adds spans the rules miss.

The rules give the base spans, which always stay. The field then segments the tokens around digits and at-signs
into spans of at most `LONGEST` tokens: features describe a whole candidate span (its shape, digit count, check
digit, octet range, domain form), and one dynamic program picks boundaries and types together. It is trained on
windows in which the rules found something or nothing, and finds what a greedy rule lost, such as a valid card
number with another number right behind it. A found span is added if it scores at least `margin` above "no
entity" and touches no base span.
"""

from __future__ import annotations

import hashlib
import math
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planloom.llm.common import arrow_map, texts

KINDS = ("email", "ip", "card", "phone")
LONGEST = 6

LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# Possessive forms of the rules; a match never starts inside a run of digits, so they part texts alike in linear time.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _octets(text: str) -> bool:
    return all(len(x.lstrip("0")) <= 3 and int(x) <= 255 for x in text.split("."))


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Rule matches (kind, start, end) in code points, by kind as listed, then start."""
    out = []
    at, floor = text.find("@"), 0
    while at >= 0:
        a = at
        while a > floor and LOCAL.match(text[a - 1]):
            a -= 1
        m = DOMAIN.match(text, at + 1) if a < at else None
        if m:
            out.append(("email", a, m.end()))
            floor = m.end()
        # Signs of one run of local characters cannot be shared by two matches; the next sign starts behind this one.
        floor = max(floor, at + 1)
        at = text.find("@", floor)
    if DIGIT.search(text):
        if "." in text:
            out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if _octets(m.group())]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 16:
                d = _digits(m.group())
                if 16 <= len(d) <= 19 and luhn(d):
                    out.append(("card", m.start(), m.end()))
        if "+" in text:
            out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= len(_digits(m.group())) <= 15]
    return out


TOKEN = re.compile(r"[^\x20\x09-\x0D]*[0-9@][^\x20\x09-\x0D]*")


def windows(text: str) -> list[list[tuple[int, int]]]:
    """Runs of neighbouring tokens that hold a digit or an at-sign, each token without quotes and end punctuation."""
    runs: list[list[tuple[int, int]]] = []
    last = -9
    for m in TOKEN.finditer(text):
        a, z = m.span()
        core = m.group()
        a += len(core) - len(core.lstrip("\"'<[{,;:"))
        z -= len(core) - len(core.rstrip("\"'>]},;:.!?"))
        if z <= a:
            continue
        if m.start() - last == 1:
            runs[-1].append((a, z))
        else:
            runs.append([(a, z)])
        last = m.end()
    return runs


def span_features(span: str, tokens: int) -> list[str]:
    """Features of a whole candidate span."""
    digits = _digits(span)
    n = len(digits)
    shape = re.sub(r"[a-z]+", "a", re.sub(r"[0-9]+", "9", span.lower()))[:40]
    out = [f"tokens={tokens}", f"digits={min(n, 24)}", f"shape={shape}", f"letters={any(c.isalpha() for c in span)}", f"first={span[:1] if not span[:1].isalnum() else 'w'}"]
    if "@" in span:
        left, _, right = span.partition("@")
        out.append(f"mail={bool(left) and all(map(LOCAL.match, left)) and bool(DOMAIN.fullmatch(right))}")
    if re.fullmatch(r"[0-9]+(?:\.[0-9]+){3}", span):
        out.append(f"octets={_octets(span)}")
    if re.fullmatch(r"[0-9](?:[ .-]?[0-9])*", span):
        out.append(f"number={16 <= n <= 19},{luhn(digits)}")
    if re.fullmatch(r"\+?[ ().0-9-]+", span):
        out.append(f"dial={span[0] == '+'},{8 <= n <= 15}")
    return out


@dataclass
class Field:
    """Weights of (kind, feature); a segment without entity scores 0."""

    weights: dict[str, np.ndarray] = field(default_factory=dict)

    def candidates(self, text: str, tokens: list[tuple[int, int]]) -> list[list[tuple[int, list[str]]]]:
        """For each end token: (first token, features) of the spans that end there."""
        out = []
        for j in range(len(tokens)):
            out.append([(i, span_features(text[tokens[i][0] : tokens[j][1]], j - i + 1)) for i in range(max(0, j - LONGEST + 1), j + 1)])
        return out

    def scores(self, features: list[str]) -> np.ndarray:
        total = np.zeros(len(KINDS))
        for f in features:
            w = self.weights.get(f)
            if w is not None:
                total += w
        return total

    def decode(self, text: str, tokens: list[tuple[int, int]], margin: float) -> list[tuple[str, int, int]]:
        """Best segmentation: spans whose score is at least margin above that of no entity."""
        best, back = [0.0], [None]
        for j, ends in enumerate(self.candidates(text, tokens)):
            value, how = best[j], None
            for i, features in ends:
                s = self.scores(features)
                k = int(s.argmax())
                if best[i] + s[k] > value:
                    value, how = best[i] + s[k], (i, k, s[k])
            best.append(value)
            back.append(how)
        out, j = [], len(tokens)
        while j:
            how = back[j]
            if how is None:
                j -= 1
                continue
            i, k, s = how
            if s >= margin:
                out.append((KINDS[k], tokens[i][0], tokens[j - 1][1]))
            j = i
        return out[::-1]

    def learn(self, rows: list[tuple[str, list[tuple[int, int]], dict[tuple[int, int], int]]], epochs: int = 6, rate: float = 0.3, l2: float = 1e-3) -> None:
        """Stochastic gradient ascent on the log likelihood; rows: (text, tokens, {(first, last): kind})."""
        ready = [(self.candidates(t, tokens), gold) for t, tokens, gold in rows]
        for ends, _ in ready:
            for spans in ends:
                for _, features in spans:
                    for f in features:
                        self.weights.setdefault(f, np.zeros(len(KINDS)))
        for epoch in range(epochs):
            step = rate / (1 + epoch)
            for ends, gold in ready:
                n = len(ends)
                scored = [[(i, f, self.scores(f)) for i, f in spans] for spans in ends]
                fwd = np.full(n + 1, -math.inf)
                fwd[0] = 0.0
                for j in range(n):
                    fwd[j + 1] = np.logaddexp.reduce([fwd[j], *(fwd[i] + x for i, _, s in scored[j] for x in s)])
                bwd = np.full(n + 1, -math.inf)
                bwd[n] = 0.0
                for j in range(n - 1, -1, -1):
                    terms = [bwd[j + 1], *(bwd[e + 1] + x for e in range(j, min(n, j + LONGEST)) for i, _, s in scored[e] if i == j for x in s)]
                    bwd[j] = np.logaddexp.reduce(terms)
                for j in range(n):
                    for i, features, s in scored[j]:
                        slope = -np.exp(np.minimum(fwd[i] + s + bwd[j + 1] - fwd[n], 0))
                        if (i, j) in gold:
                            slope[gold[i, j]] += 1
                        if np.abs(slope).max() > 1e-4:
                            for f in features:
                                w = self.weights[f]
                                w += step * (slope - l2 * w)


def training_windows(text: str) -> list[tuple[str, list[tuple[int, int]], dict]]:
    """Windows of a text whose base spans, if any, fall on token boundaries."""
    spans, out = base_spans(text), []
    for tokens in windows(text):
        a, z = tokens[0][0], tokens[-1][1]
        inside = [s for s in spans if s[1] < z and s[2] > a]
        first, last = {t[0]: k for k, t in enumerate(tokens)}, {t[1]: k for k, t in enumerate(tokens)}
        if len(tokens) <= 12 and all(s in first and e in last for _, s, e in inside):
            gold = {(first[s], last[e]): KINDS.index(k) for k, s, e in inside}
            out.append((text[a:z], [(s - a, e - a) for s, e in tokens], gold))
    return out


def contrast(row: tuple[str, list[tuple[int, int]], dict]) -> list[tuple[str, list[tuple[int, int]], dict]]:
    """For each span of a window, the window with that span made invalid in place: check digit, octet or domain broken."""
    text, tokens, gold = row
    out = []
    for (i, j), k in gold.items():
        a, z = tokens[i][0], tokens[j][1]
        span = text[a:z]
        if KINDS[k] == "card":
            bad = span[:-1] + str((int(span[-1]) + 1) % 10)
        elif KINDS[k] == "ip":
            bad = re.sub(r"(?<![0-9])[12][0-9]{2}(?![0-9])", lambda m: "9" + m.group()[1:], span, count=1)
        elif KINDS[k] == "email":
            left, _, right = span.partition("@")
            bad = left + "@" + right.replace(".", "_")
        else:
            continue
        if bad != span:
            out.append((text[:a] + bad + text[z:], tokens, {x: y for x, y in gold.items() if x != (i, j)}))
    return out


def train(docs: DataFrame, most_docs: int = 6000, most_windows: int = 1500, id_col: str = "doc_id", text_col: str = "text") -> Field:
    """Fit on windows of the first `most_docs` documents in the order of a hash of the id, at most `most_windows` each
    with and without a span, and on the contrast of each window with one."""
    picked = docs.select(id_col).orderBy(F.xxhash64(id_col), id_col).limit(most_docs).distinct()

    def run(batches):
        for b in batches:
            kept = [(w[0], [x for t in w[1] for x in t], [[i, j, k] for (i, j), k in sorted(w[2].items())]) for t in texts(b, text_col) for w in training_windows(t)]
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in kept], pa.string()), pa.array([k[1] for k in kept], pa.list_(pa.int32())), pa.array([k[2] for k in kept], pa.list_(pa.list_(pa.int32())))], ["body", "tokens", "gold"])

    found = docs.select(id_col, text_col).join(F.broadcast(picked), id_col)  # at most most_docs ids
    rows = arrow_map(found, run, "body string, tokens array<int>, gold array<array<int>>").distinct()
    rows = rows.withColumn("has", F.size("gold") > 0)
    model, got = Field(), []
    for has in (True, False):
        got += rows.where(F.col("has") == has).orderBy(F.xxhash64("body"), "body").limit(most_windows).toArrow().to_pylist()
    got.sort(key=lambda r: (hashlib.md5(r["body"].encode()).digest(), r["body"]))
    ready = [(r["body"], list(zip(r["tokens"][::2], r["tokens"][1::2])), {(i, j): k for i, j, k in r["gold"]}) for r in got]
    model.learn([y for x in ready for y in (x, *contrast(x))])
    return model


def find(text: str, model: Field, margin: float = 2.0) -> tuple[list, list]:
    """(base spans, all spans), both by kind as listed, then start."""
    base = base_spans(text)
    more = []
    if "@" in text or DIGIT.search(text):
        taken = sorted((s, e) for _, s, e in base)
        for tokens in windows(text):
            a, z = tokens[0][0], tokens[-1][1]
            if any(s <= a and z <= e for s, e in taken):
                continue
            for kind, s, e in model.decode(text, tokens, margin):
                if not any(s < y and x < e for x, y in taken):
                    more.append((kind, s, e))
    return base, sorted([*base, *more], key=lambda x: (KINDS.index(x[0]), x[1], x[2]))


def write_spans(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def personal_data(docs: DataFrame, model: Field, margin: float = 2.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_sha256, spans): counts and digest of the base spans, and all spans.

    Null and empty texts have none. Repeated rows are treated alike; an empty table gives an empty result.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # features of at most twice most_windows windows

    def run(batches):
        m = sent.value
        for b in batches:
            found = [find(t, m, margin) for t in texts(b, text_col)]
            n = [pa.array([sum(s[0] == k for s in base) for base, _ in found], pa.int64()) for k in KINDS]
            sha = pa.array([hashlib.sha256(write_spans(base).encode()).hexdigest() for base, _ in found], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(id_col), *n, sha, pa.array([write_spans(x) for _, x in found], pa.string())], [id_col, *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return arrow_map(docs.select(id_col, text_col), run, f"{id_col} long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string")
