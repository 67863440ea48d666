"""Benchmark decontamination by the q-gram lemma.

Texts are compared as case-folded UTF-8 bytes with each run of white space written as one blank. A benchmark item
is cut into patterns of `span` bytes at half-span steps (a shorter item is one pattern), and for excerpts also into
patterns of `excerpt` bytes at steps of a third, so that any `excerpt` * 4/3 bytes of an item hold one whole. An item
under `least` bytes is looked for whole, word by word. An occurrence of a pattern of m bytes with at most k
edits shares at least m - q + 1 - k q of its q-grams with the text, all on diagonals that differ by at most k.

1. Every q-gram of the text is looked up in the set of all pattern q-grams. Stretches of text where the number of
   found q-grams, over any window that an occurrence could fill, stays below the least bound hold no occurrence.
2. In what is left, shared q-grams are counted for each pattern in overlapping diagonal bands (width 2k + 1
   diagonals at steps of k + 1, so that any k + 1 neighbouring diagonals lie in one band); bands below the
   pattern's bound hold no occurrence.
3. Regions that meet the bound are verified by banded alignment: pattern against any substring of the region.

No step samples or caps anything, so all occurrences within the edit budget are found.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from planloom.llm.common import arrow_map, bodies, ragged

MIX = np.uint64(0x9E3779B97F4A7C15)
SLOTS = 22


EXCERPT = 48


def normal(body: bytes) -> bytes:
    if not body.isascii():
        body = body.decode("utf-8", "replace").casefold().encode()
    return b" ".join(body.lower().split())


def grams(text: bytes, q: int) -> np.ndarray:
    """64-bit codes of the q-grams (8 <= q <= 16)."""
    b = np.frombuffer(text, np.uint8).astype(np.uint64)
    if len(b) < q:
        return np.zeros(0, np.uint64)
    two = b[:-1] | b[1:] << np.uint64(8)
    four = two[:-2] | two[2:] << np.uint64(16)
    eight = four[:-4] | four[4:] << np.uint64(32)
    if q == 8:
        return eight
    n = len(b) - q + 1
    return (eight[:n] * MIX) ^ (eight[q - 8 : q - 8 + n] + (eight[:n] >> np.uint64(29)))


def slot(codes: np.ndarray) -> np.ndarray:
    return (codes * MIX >> np.uint64(64 - SLOTS)).astype(np.int64)


def edits(pattern: bytes, region: bytes, shift: int, band: int) -> int:
    """Least edit distance of the pattern to any substring of the region, over diagonals within band of shift."""
    m, n = len(pattern), len(region)
    width = 2 * band + 1
    text = np.full(m + width + 1, 256, np.int32)
    first = shift - band
    lo, hi = max(0, first), min(n, first + len(text))
    if hi > lo:
        text[lo - first : hi - first] = np.frombuffer(region, np.uint8)[lo:hi]
    steps = np.arange(width)
    row = np.zeros(width, np.int64)  # row i, slot d: pattern[:i] against text ending at first + i + d
    for i in range(m):
        miss = (text[i : i + width] != pattern[i]).astype(np.int64)
        up = np.append(row[1:], m + 1) + 1
        best = np.minimum(row + miss, up)
        row = np.minimum.accumulate(best - steps) + steps
    return int(row.min())


@dataclass
class Patterns:
    """Patterns of one chunk of the benchmark with their q-gram index."""

    q: int
    texts: list[bytes]
    items: np.ndarray
    budget: np.ndarray
    need: np.ndarray
    codes: np.ndarray
    owner: np.ndarray
    offset: np.ndarray
    bitmap: np.ndarray
    short: dict[bytes, list[tuple[int, list[bytes]]]]

    @classmethod
    def of(cls, items: list[tuple[int, bytes]], q: int, rate: float, span: int, least: int, excerpt: int = 0) -> Patterns:
        """With `excerpt`, shorter patterns and whole items under `least` bytes are looked for too."""
        texts, ids, short = [], [], {}
        for item, body in items:
            t = normal(body)
            if len(t) < least:
                if excerpt and t:
                    short.setdefault(t.split()[0], []).append((item, t.split()))
                continue
            starts = [0] if len(t) <= span else [*range(0, len(t) - span, span // 2), len(t) - span]
            texts += [t[a : a + span] for a in starts]
            ids += [item] * len(starts)
            if excerpt and len(t) > excerpt:
                starts = [*range(0, len(t) - excerpt, excerpt // 3), len(t) - excerpt]
                texts += [t[a : a + excerpt] for a in starts]
                ids += [item] * len(starts)
        sizes = np.array([len(t) for t in texts], int)
        budget = np.minimum((sizes * rate).astype(int), np.maximum((sizes - q) // q, 0))
        codes = [grams(t, q) for t in texts]
        flat = np.concatenate(codes) if codes else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(texts)), [len(c) for c in codes]) if texts else np.zeros(0, int)
        offset = np.concatenate([np.arange(len(c)) for c in codes]) if codes else np.zeros(0, int)
        order = np.argsort(flat, kind="stable")
        bitmap = np.zeros(1 << SLOTS, bool)
        bitmap[slot(flat)] = True
        return cls(q, texts, np.array(ids), budget, sizes - q + 1 - budget * q, flat[order], owner[order], offset[order], bitmap, short)

    def find(self, text: bytes) -> list[tuple[int, int, int]]:
        """(item, edits, start) of each item found in a normal text: its pattern with the fewest edits, then the first place."""
        return self._whole(text) + self._near(text) if self.short else self._near(text)

    def _whole(self, text: bytes) -> list[tuple[int, int, int]]:
        words, found = text.split(), {}
        for k, w in enumerate(words):
            for item, all_words in self.short.get(w, ()):
                if item not in found and words[k : k + len(all_words)] == all_words:
                    found[item] = len(b" ".join(words[:k])) + (k > 0)
        return [(item, 0, at) for item, at in sorted(found.items())]

    def _near(self, text: bytes) -> list[tuple[int, int, int]]:
        codes = grams(text, self.q)
        if not len(codes) or not self.texts:
            return []
        at = np.flatnonzero(self.bitmap[slot(codes)])
        floor = int(self.need.min())
        if len(at) < floor:
            return []
        # Stage 1: a text q-gram stays only if some window of the longest occurrence around it holds `floor` found ones.
        reach = max(map(len, self.texts)) + int(self.budget.max())
        j = np.arange(len(at))
        full = np.flatnonzero(at[floor - 1 :] - at[: len(at) - floor + 1] < reach) if floor > 1 else j
        if not len(full):
            return []
        mark = np.zeros(len(at) + 1, np.int64)
        np.add.at(mark, full, 1)
        np.add.at(mark, full + max(floor, 1), -1)
        at = at[np.cumsum(mark[:-1]) > 0]
        # Stage 2: expand to (pattern, diagonal) and count by band.
        low, high = np.searchsorted(self.codes, codes[at], "left"), np.searchsorted(self.codes, codes[at], "right")
        n = high - low
        e = ragged(low, n)
        if not len(e):
            return []
        where, pattern = np.repeat(at, n), self.owner[e]
        diagonal = where - self.offset[e]
        k = self.budget[pattern]
        found: dict[int, tuple[int, int]] = {}
        base = diagonal // (k + 1)
        # Diagonals d .. d + k fit into the band that starts at their multiple of k + 1 and is twice as wide.
        band = np.concatenate([base, base - 1])
        both, at2 = np.concatenate([pattern, pattern]), np.concatenate([where, where])
        order = np.lexsort((at2, band, both))
        p, s, w = both[order], band[order], at2[order]
        edge = np.flatnonzero(np.r_[True, (np.diff(p) != 0) | (np.diff(s) != 0)])
        ends = np.r_[edge[1:], len(p)]
        for a, z in zip(edge, ends):
            who = int(p[a])
            if z - a < self.need[who]:
                continue
            places = w[a:z]
            size = len(self.texts[who]) + int(self.budget[who])
            need = max(int(self.need[who]), 1)
            if not (places[need - 1 :] - places[: len(places) - need + 1] < size).any():
                continue
            k0 = int(self.budget[who])
            start = int(s[a]) * (k0 + 1)
            cost = edits(self.texts[who], text, start + k0, 2 * k0 + 1)
            item = int(self.items[who])
            if cost <= k0 and (cost, max(start, 0)) < found.get(item, (1 << 30, 0)):
                found[item] = (cost, max(start, 0))
        return [(item, c, a) for item, (c, a) in sorted(found.items())]


def _scan(sent: list, batches, text_col: str, hold_bytes: int, seek):
    """(batch, what `seek` says of each text for each chunk) of all batches, with one chunk of the benchmark in memory at a time.

    With several chunks, batches are held up to hold_bytes of text, so that a chunk is loaded once for many texts.
    """
    held, size = [], 0

    def answer():
        texts = [[normal(x) for x in bodies(b, text_col)] for b in held]
        found = [[[] for _ in rows] for rows in texts]
        for chunk in sent:
            patterns = chunk.value
            for rows, outs in zip(texts, found):
                for t, out in zip(rows, outs):
                    out += seek(patterns, t)
            if len(sent) > 1:
                del patterns
                chunk.__dict__.pop("_value", None)  # the worker's copy; the next use reads it again
        return zip(held, found)

    for b in batches:
        held.append(b)
        size += b.column(text_col).nbytes
        if len(sent) == 1 or size >= hold_bytes:
            yield from answer()
            held, size = [], 0
    if held:
        yield from answer()


def _sent(docs: DataFrame, benchmark: DataFrame, q: int, rate: float, span: int, least: int, chunk_bytes: int) -> list:
    """The benchmark's patterns as broadcasts of about chunk_bytes of text each, as many as it needs."""
    chunks, now, size = [], [], 0
    for r in benchmark.select("item_id", "text").where("item_id is not null").orderBy("item_id", "text").toLocalIterator():
        body = (r["text"] or "").encode()
        now.append((r["item_id"], body))
        size += len(body)
        if size >= chunk_bytes:
            chunks.append(now)
            now, size = [], 0
    return [docs.sparkSession.sparkContext.broadcast(Patterns.of(c, q, rate, span, least, EXCERPT)) for c in [*chunks, now]]


def leaks(docs: DataFrame, benchmark: DataFrame, q: int = 10, rate: float = 0.06, span: int = 96, least: int = 40, chunk_bytes: int = 2_000_000, hold_bytes: int = 64_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_items, items array, least_edits) of each document: the benchmark items of which it holds a pattern.

    Items are benchmark rows (item_id, text). An item whose normal text is shorter than `least` bytes is
    found as a whole only; a null or empty one takes no part, nor does one without id. Null and empty documents hold no item (n_items 0, least_edits null).
    Items are sent to the workers in chunks of chunk_bytes of text, of which a worker holds one at a time; a document's finds in all chunks are put together. Repeated rows are
    treated alike; other columns are not read; empty tables give empty results.
    """
    sent = _sent(docs, benchmark, q, rate, span, least, chunk_bytes)

    def run(batches):
        for b, found in _scan(sent, batches, text_col, hold_bytes, Patterns.find):
            items = [sorted({x[0] for x in f}) for f in found]
            cols = [pa.array([len(i) for i in items], pa.int64()), pa.array(items, pa.list_(pa.int64())), pa.array([min((x[1] for x in f), default=None) for f in found], pa.int64())]
            yield pa.RecordBatch.from_arrays([b.column(id_col), *cols], [id_col, "n_items", "items", "least_edits"])

    return arrow_map(docs.select(id_col, text_col), run, f"{id_col} long, n_items long, items array<long>, least_edits long")


def clean(docs: DataFrame, benchmark: DataFrame, q: int = 10, rate: float = 0.06, span: int = 96, least: int = 40, chunk_bytes: int = 2_000_000, hold_bytes: int = 64_000_000, text_col: str = "text") -> DataFrame:
    """The rows of `docs` that hold no benchmark passage, all columns as they are.

    Null and empty texts hold none and stay, repeated rows are treated alike, null ids do not matter; without benchmark rows
    all rows stay, an empty table stays empty.
    """
    sent = _sent(docs, benchmark, q, rate, span, least, chunk_bytes)

    def run(batches):
        for b, found in _scan(sent, batches, text_col, hold_bytes, Patterns.find):
            yield b.filter(pa.array([not f for f in found], pa.bool_()))

    return arrow_map(docs, run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema))
