"""Language-model scoring by prediction by partial matching, beside a unigram base score.

A text is its A-Z lower-cased bytes between a start mark and an end symbol. The model is a trie of byte strings
of up to `order` + 1 bytes with their counts over all training documents. A symbol is looked for in the longest
known context; each context that lacks it is left at the price of an escape (method D: half the number of distinct
symbols over the total), and the symbols it did hold are excluded from the shorter contexts. Symbols of a
context are also symbols of its suffix, so what is excluded depends on the last context left alone, and each
node keeps its excluded totals ready. The result for a symbol depends on its last `order` bytes and itself only.

Every string counts, however rare, and the trie is never in one place: it is a table dealt into parts by the three bytes
before the symbol. A part holds all strings that end in such a group, and of the other levels only the strings of
up to three bytes are needed, at most 2^24. Documents pass in blocks; a block sends its distinct strings to the
parts and gets a log probability for each back.
"""

from __future__ import annotations

import math
import uuid
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planloom.llm.common import arrow_map, bodies
from planloom.storage import new_folder, written

START, END = 0xFE, 0xFF  # bytes that UTF-8 never uses
SYMBOLS = 255  # all bytes but the start mark
MIX = np.uint64(0x9E3779B97F4A7C15)
VACANT = np.uint64((1 << 64) - 1)
SPREAD = 2654435761


def held_out(doc_id) -> bool:
    return zlib.crc32(str("" if doc_id is None else doc_id).encode()) % 10 == 0


def strings(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """(codes, lengths): for each symbol of each text, end included, its last `order` bytes and itself as one number (order <= 6)."""
    pad = bytes([START]) * 7
    joined = b"".join(pad + t.lower() + bytes([END]) for t in texts)
    windows = np.ndarray((max(len(joined) - 7, 0),), ">u8", joined, 0, (1,)).astype(np.uint64)
    windows &= np.uint64((1 << (8 * (order + 1))) - 1)
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    # Windows that end in the next text's padding are dropped.
    keep = np.ones(len(windows), bool)
    if len(texts) > 1:
        at = np.cumsum(sizes + 7)[:-1] - 7
        keep[(at[:, None] + np.arange(7)).ravel()] = False
    return windows[keep], sizes


def _find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Place of each wanted key in sorted keys, -1 if absent."""
    if not len(keys):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


@dataclass
class Trie:
    """Per context length i: sorted strings (context and symbol) with counts, contexts with totals, and totals of the suffix without the context's symbols."""

    order: int
    grams: list[np.ndarray]
    counts: list[np.ndarray]
    contexts: list[np.ndarray]
    total: list[np.ndarray]
    kinds: list[np.ndarray]
    rest_total: list[np.ndarray]
    rest_kinds: list[np.ndarray]

    @classmethod
    def of(cls, levels: list[tuple[np.ndarray, np.ndarray]]) -> Trie:
        """levels[i]: distinct strings of i + 1 bytes and their counts; a string's suffix must be in the level below.

        A level may lack strings if it lacks all with the same context, and those contexts are not asked for.
        """
        order = len(levels) - 1
        grams, ns = [], []
        for codes, counts in levels:
            by = np.argsort(codes)
            grams.append(codes[by])
            ns.append(counts[by].astype(float))
        contexts, total, kinds, rest_total, rest_kinds = [], [], [], [], []
        for i in range(order + 1):
            c, back = np.unique(grams[i] >> np.uint64(8), return_inverse=True)
            contexts.append(c)
            total.append(np.bincount(back, ns[i], len(c)))
            kinds.append(np.bincount(back, minlength=len(c)).astype(float))
            if i:
                mask = np.uint64((1 << (8 * i)) - 1)
                below = _find(grams[i - 1], grams[i] & mask)
                suffix = _find(contexts[i - 1], c & np.uint64((1 << (8 * (i - 1))) - 1))
                rest_total.append(total[i - 1][suffix] - np.bincount(back, ns[i - 1][below], len(c)))
                rest_kinds.append(kinds[i - 1][suffix] - kinds[i])
            else:
                rest_total.append(np.zeros(len(c)))
                rest_kinds.append(np.zeros(len(c)))
        return cls(order, grams, ns, contexts, total, kinds, rest_total, rest_kinds)

    def log_prob(self, codes: np.ndarray) -> np.ndarray:
        """Natural log of each symbol's probability after its context, by walking down from the longest context."""
        out, live = np.zeros(len(codes)), np.ones(len(codes), bool)
        came = np.full(len(codes), -1)  # place of the context left last
        for i in range(self.order, -1, -1):
            mask = np.uint64((1 << (8 * (i + 1))) - 1)
            s = codes & mask
            node = _find(self.contexts[i], s >> np.uint64(8))
            here = np.flatnonzero(live & (node >= 0))
            first = came[here] < 0
            if i < self.order and len(self.contexts[i + 1]):
                total = np.where(first, self.total[i][node[here]], self.rest_total[i + 1][came[here]])
                kinds = np.where(first, self.kinds[i][node[here]], self.rest_kinds[i + 1][came[here]])
            else:
                total, kinds = self.total[i][node[here]], self.kinds[i][node[here]]
            gram = _find(self.grams[i], s[here])
            n = self.counts[i][gram] if len(self.counts[i]) else np.zeros(len(here))
            # Where nothing is left to escape to, plain shares.
            last = np.zeros(len(here), bool) if i else self.kinds[0][node[here]] >= SYMBOLS
            hit = gram >= 0
            with np.errstate(divide="ignore", invalid="ignore"):
                found = np.where(last, np.log(n) - np.log(total), np.log(2 * n - 1) - np.log(2 * total))
                gain = np.where(hit, found, np.where(total > 0, np.log(kinds) - np.log(2 * total), 0.0))
            out[here] += gain
            live[here[hit]] = False
            came[:] = -1
            came[here] = node[here]
        seen = self.kinds[0][0] if len(self.kinds[0]) else 0
        out[live] -= math.log(max(SYMBOLS - seen, 1))
        return out


class Lookup:
    """Open-addressing table from distinct codes to their values."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(8, int(np.ceil(np.log2(max(len(keys), 1) * 2.5))))
        self.shift, self.last = np.uint64(64 - bits), (1 << bits) - 1
        self.codes, self.values = np.full(1 << bits, VACANT), np.zeros(1 << bits, values.dtype)
        slot, left = (keys * MIX >> self.shift).astype(np.int64), np.arange(len(keys))
        while len(left):
            free = left[self.codes[slot[left]] == VACANT]
            at, pick = np.unique(slot[free], return_index=True)
            self.codes[at], self.values[at] = keys[free[pick]], values[free[pick]]
            left = left[self.codes[slot[left]] != keys[left]]
            slot[left] = (slot[left] + 1) & self.last

    def __call__(self, codes: np.ndarray) -> np.ndarray:
        """Values of codes, all of which are in the table."""
        slot = (codes * MIX >> self.shift).astype(np.int64)
        todo = np.flatnonzero(self.codes[slot] != codes)
        while len(todo):
            slot[todo] = (slot[todo] + 1) & self.last
            todo = todo[self.codes[slot[todo]] != codes[todo]]
        return self.values[slot]


def distinct(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct codes and how often each occurs."""
    s = np.sort(codes)
    first = np.flatnonzero(np.r_[True, s[1:] != s[:-1]]) if len(s) else np.zeros(0, np.int64)
    return s[first], np.diff(np.append(first, len(s)))


def merged(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two counts of codes as one."""
    keys, back = np.unique(np.concatenate([a[0], b[0]]), return_inverse=True)
    return keys, np.bincount(back, np.concatenate([a[1], b[1]]), len(keys)).astype(np.int64)


def pack(numbers: np.ndarray) -> bytes:
    """Eight-byte numbers by byte planes, compressed."""
    return zlib.compress(numbers.view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def unpack(raw: bytes, kind) -> np.ndarray:
    return np.frombuffer(zlib.decompress(raw), np.uint8).reshape(8, -1).T.copy().view(kind).ravel()


def pack_codes(codes: np.ndarray) -> bytes:
    return pack(np.diff(codes, prepend=np.uint64(0)))


def unpack_codes(raw: bytes) -> np.ndarray:
    return np.cumsum(unpack(raw, np.uint64), dtype=np.uint64)


def part_of(codes: np.ndarray, parts: int) -> np.ndarray:
    """The part of each string, from the three bytes before its symbol; `part_column` says the same."""
    group = codes >> np.uint64(8) & np.uint64(0xFFFFFF)
    return ((group * np.uint64(SPREAD) & np.uint64(0xFFFFFFFF)) >> np.uint64(8)).astype(np.int64) % parts


def part_column(code: Column, parts: int) -> Column:
    group = F.shiftrightunsigned(code, 8).bitwiseAND(F.lit(0xFFFFFF).cast("long"))
    mixed = (group * F.lit(SPREAD).cast("long")).bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))
    return (F.shiftrightunsigned(mixed, 8) % F.lit(parts).cast("long")).cast("int")


def by_part(codes: np.ndarray, parts: int) -> list[tuple[int, np.ndarray]]:
    """(part, places) of sorted codes, by part, in order within each."""
    part = part_of(codes, parts)
    order = np.argsort(part, kind="stable")
    edges = np.flatnonzero(np.diff(part[order], prepend=-1))
    return [(int(part[order[a]]), order[a:z]) for a, z in zip(edges, [*edges[1:], len(order)])]


def pieces_of(rows: list[bytes], most: int):
    a, size = 0, 0
    for i, t in enumerate(rows):
        size += len(t) + 1
        if size >= most:
            yield a, i + 1
            a, size = i + 1, 0
    if a < len(rows):
        yield a, len(rows)


def _words(rows: list[bytes]):
    """(numbers of all words, row after row, words in each row, distinct words by number): each row ends with the end token, which no word equals: the empty word, number 0."""
    flat, sizes = [b""], np.zeros(len(rows), np.int64)
    for i, row in enumerate(rows):
        before = len(flat)
        flat += row.lower().split()
        flat.append(b"")
        sizes[i] = len(flat) - before
    coded = pa.array(flat, pa.binary()).dictionary_encode()
    return coded.indices.to_numpy()[1:], sizes, coded.dictionary.cast(pa.string())


#: Rows of the block table: what a block's texts are, its distinct strings for each part, its words, and counts of training strings.
TEXTS, CHUNK, WORDS, COUNTS = 0, 1, 2, 3
FIELDS = "kind int, block long, part int, a binary, b binary, ids array<long>, tokens array<string>, known array<long>"
NAMES = [f.split()[0] for f in FIELDS.split(", ")]


def _row(kind: int, block: int, part: int | None = None, a=None, b=None, ids=None, tokens=None, known=None) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.int64())]
    values = zip((kind, block, part, a, b, ids, tokens, known), kinds)
    return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays([0, len(x)], x) if isinstance(x, pa.Array) else pa.array([x], t) for x, t in values], NAMES)


def _block_rows(block: int, ids: list, rows: list[bytes], order: int, parts: int):
    """The rows of one block, and the counts of its training strings."""
    bounds = np.cumsum([0, *map(len, rows)]).astype("<i8")
    yield _row(TEXTS, block, a=pa.compress(b"".join(rows), "zstd", asbytes=True), b=bounds.tobytes(), ids=ids)
    seen, learned = (np.zeros(0, np.uint64), np.zeros(0, np.int64)), (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    for train in (True, False):
        some = [r for i, r in zip(ids, rows) if held_out(i) != train]
        for lo, hi in pieces_of(some, 4_000_000):
            found = distinct(strings(some[lo:hi], order)[0])
            seen = merged(seen, found)
            if train:
                learned = merged(learned, found)
    for part, places in by_part(seen[0], parts):
        yield _row(CHUNK, block, part, a=pack_codes(seen[0][places]))
    numbers, sizes, words = _words(rows)
    known = np.bincount(numbers[np.repeat([not held_out(i) for i in ids], sizes)], minlength=len(words))
    yield _row(WORDS, block, tokens=words, known=pa.array(known, pa.int64()))
    return learned


def _blocks(docs: DataFrame, order: int, parts: int, block_bytes: int, most_counts: int, id_col: str, text_col: str) -> DataFrame:
    def run(batches):
        task = TaskContext.get().partitionId()
        k, ids, rows, size, counts = 0, [], [], 0, (np.zeros(0, np.uint64), np.zeros(0, np.int64))

        def flush():
            for a in range(0, len(counts[0]), 1 << 16):
                yield _row(COUNTS, task << 32, a=pack_codes(counts[0][a : a + (1 << 16)]), b=pack(counts[1][a : a + (1 << 16)]))

        for b in batches:
            for i, t in zip(b.column(id_col).to_pylist(), bodies(b, text_col)):
                ids.append(i)
                rows.append(t)
                size += len(t)
                if size >= block_bytes:
                    counts = merged(counts, (yield from _block_rows(task << 32 | k, ids, rows, order, parts)))
                    k, ids, rows, size = k + 1, [], [], 0
                    if len(counts[0]) >= most_counts:
                        yield from flush()
                        counts = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        if ids:
            counts = merged(counts, (yield from _block_rows(task << 32 | k, ids, rows, order, parts)))
        yield from flush()

    return arrow_map(docs.select(id_col, text_col), run, FIELDS)


def _string_counts(blocks: DataFrame) -> DataFrame:
    """(code, n): all strings of the training documents."""

    def run(batches):
        for b in batches:
            for a, n in zip(b.column("a").to_pylist(), b.column("b").to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array(unpack_codes(a).astype(np.int64)), pa.array(unpack(n, np.int64))], ["code", "n"])

    return arrow_map(blocks.where(F.col("kind") == COUNTS).select("a", "b"), run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def _levels(codes: np.ndarray, n: np.ndarray, sizes) -> list[tuple[np.ndarray, np.ndarray]]:
    out = []
    for size in sizes:
        keys, back = np.unique(codes & np.uint64((1 << (8 * size)) - 1), return_inverse=True)
        out.append((keys, np.bincount(back, n, len(keys))))
    return out


def _answers(chunks: DataFrame, counts: DataFrame, order: int, parts: int) -> DataFrame:
    """(block, part, lp): log probabilities of the strings of each chunk, in order."""
    short = min(order + 1, 3)
    low = counts.groupBy(F.col("code").bitwiseAND(F.lit((1 << (8 * short)) - 1)).alias("code")).agg(F.sum("n").alias("n")).toArrow()  # at most 2^24 rows
    spark = counts.sparkSession
    sent = spark.sparkContext.broadcast((low["code"].to_numpy().astype(np.uint64), low["n"].to_numpy().astype(float)))
    model = counts.select(part_column(F.col("code"), parts).alias("part"), F.lit(None).cast("long").alias("block"), "code", "n", F.lit(None).cast("binary").alias("a"))
    asked = chunks.select("part", "block", F.lit(None).cast("long").alias("code"), F.lit(None).cast("long").alias("n"), "a")
    # Nulls sort first: a part's strings come before the chunks that ask for it.
    both = model.unionByName(asked).repartition(parts, "part").sortWithinPartitions("part", "block")

    def run(batches):
        low_levels = _levels(*sent.value, range(1, short + 1))
        now, codes, ns, trie = None, [], [], None
        for b in batches:
            part, block = b.column("part").to_numpy(), b.column("block")
            edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), b.num_rows]
            for lo, hi in zip(edges[:-1], edges[1:]):
                if hi <= lo:
                    continue
                if part[lo] != now:
                    now, codes, ns, trie = part[lo], [], [], None
                model_rows = block.slice(lo, hi - lo).null_count
                if model_rows:
                    codes.append(b.column("code").slice(lo, model_rows).to_numpy().astype(np.uint64))
                    ns.append(b.column("n").slice(lo, model_rows).to_numpy().astype(float))
                for j in range(lo + model_rows, hi):
                    if trie is None:
                        mine, n = np.concatenate([*codes, np.zeros(0, np.uint64)]), np.concatenate([*ns, np.zeros(0)])
                        trie, codes, ns = Trie.of(low_levels + _levels(mine, n, range(short + 1, order + 2))), [], []
                    lp = trie.log_prob(unpack_codes(b.column("a")[j].as_py()))
                    yield pa.RecordBatch.from_arrays([pa.array([block[j].as_py()]), pa.array([int(now)], pa.int32()), pa.array([pack(lp)], pa.binary())], ["block", "part", "lp"])

    return arrow_map(both, run, "block long, part int, lp binary")


def score_documents(docs: DataFrame, order: int = 5, block_bytes: int = 8_000_000, part_bytes: int = 1 << 30, most_counts: int = 1 << 22, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row.

    Documents pass in blocks of about block_bytes; a block sends its distinct strings and words to be looked up and
    gets the answers back, so neither texts nor model nor vocabulary have to fit anywhere whole. `part_bytes` of
    text get one part of the model each, and there are at least 64. The block table is written once, bucketed by block, so its texts are not
    shuffled. Null text counts as empty (one end token); a null id counts as the empty text in the split; repeated
    rows stay; an empty table gives an empty result. Further columns are not read.
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(text_col).cast("long"))).first()[0] or 0
    parts, buckets = max(64, math.ceil(size / part_bytes)), max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / (8 * block_bytes)))
    name = f"ppm_blocks_{uuid.uuid4().hex}"
    made = _blocks(docs, order, parts, block_bytes, most_counts, id_col, text_col)
    made.write.partitionBy("kind").bucketBy(buckets, "block").option("path", new_folder(spark, "blocks")).saveAsTable(name)
    blocks = spark.table(name)
    answers = _answers(blocks.where(F.col("kind") == CHUNK).select("block", "part", "a"), written(_string_counts(blocks), "strings"), order, parts)
    scores = answers.groupBy("block").agg(F.collect_list(F.struct("part", "lp")).alias("answers"))

    each = blocks.where(F.col("kind") == WORDS).select("block", F.posexplode(F.arrays_zip("tokens", "known")).alias("pos", "t")).select("block", "pos", F.col("t.tokens").alias("token"), F.col("t.known").alias("known"))
    counts = written(each.groupBy("token").agg(F.sum("known").alias("c")).where("c > 0"), "tokens")
    n_all, v_all = counts.agg(F.sum("c"), F.count("*")).first()
    n_all = n_all or 0
    words = each.select("block", "pos", "token").join(counts, "token").groupBy("block").agg(F.collect_list("pos").alias("at"), F.collect_list("c").alias("c"))
    texts = blocks.where(F.col("kind") == TEXTS).select("block", "ids", "a", "b")
    joined = texts.join(scores, "block", "left").join(words, "block", "left").drop("block")

    def finish(batches):
        under = n_all + 0.1 * (v_all + 1)
        for b in batches:
            for j in range(b.num_rows):
                r = {c: b.column(c)[j] for c in b.schema.names}
                ids, bounds = r["ids"].values.to_pylist(), np.frombuffer(r["b"].as_py(), "<i8")
                body = pa.decompress(r["a"].as_py(), int(bounds[-1]), "zstd", asbytes=True)
                rows = [body[x:y] for x, y in zip(bounds[:-1], bounds[1:])]
                parts_of = sorted((x["part"], x["lp"]) for x in r["answers"].as_py())
                keys = np.zeros(0, np.uint64)
                pieces = list(pieces_of(rows, 1_000_000))
                for lo, hi in pieces:
                    keys = merged((keys, np.zeros(len(keys))), distinct(strings(rows[lo:hi], order)[0]))[0]
                lp = np.empty(len(keys))
                for (part, places), (answered, raw) in zip(by_part(keys, parts), parts_of, strict=True):
                    assert part == answered
                    lp[places] = unpack(raw, float)
                look, scores = Lookup(keys, lp), []
                for lo, hi in pieces:
                    codes, sizes = strings(rows[lo:hi], order)
                    scores += (np.add.reduceat(look(codes), np.cumsum(sizes) - sizes) / math.log(10)).tolist()
                flat, n, words = _words(rows)
                c = np.zeros(len(words))
                if r["at"].is_valid:
                    c[r["at"].values.to_numpy()] = r["c"].values.to_numpy()
                starts = np.cumsum(n) - n
                base = np.add.reduceat(np.log10((c + 0.1) / under)[flat], starts)
                seen = np.add.reduceat((c > 0).astype(np.int64)[flat], starts)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([held_out(i) for i in ids]), pa.array(n), pa.array(seen), pa.array(np.full(len(ids), n_all, np.int64)), pa.array(base), pa.array(scores)], [id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    out = written(arrow_map(joined, finish, f"{id_col} long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"), "scored")
    spark.sql(f"DROP TABLE {name}")
    return out
