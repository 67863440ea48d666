"""Approximate nearest neighbours by a hash-prefix forest.

Each tree gives every vector a long string of hash bits (signs of random projections), kept as a sorted array. A
query descends each tree to the rows that share the longest prefix with it, then all trees ascend together, one
bit at a time, until enough candidates are found; those are ranked by the exact inner product in double
precision. Rows are hashed into blocks, each with a forest of its own that is built and written once. A block's
task reads its forest, then the queries one batch after another, so it holds one block and one batch at a time.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from planloom.llm.common import arrow_map, ragged
from planloom.storage import written

BITS = 32


def planes(trees: int, dims: int, seed: int = 5) -> np.ndarray:
    """(dims, trees * BITS) projections, the same for every block."""
    return np.random.default_rng(seed).normal(size=(dims, trees * BITS)).astype(np.float32)


def strings(x: np.ndarray, trees: int, normals: np.ndarray) -> np.ndarray:
    """(rows, trees) hash strings; signs are of single-precision projections, which only choose candidates."""
    out = np.empty((len(x), trees), np.uint32)
    for at in range(0, len(x), 4096):
        signs = (x[at : at + 4096].astype(np.float32) @ normals > 0).reshape(-1, trees, BITS)
        out[at : at + 4096] = np.packbits(signs, axis=2).view(">u4")[:, :, 0]
    return out


class Forest:
    """Sorted hash strings of a block of vectors, one array a tree, and which row each belongs to."""

    def __init__(self, vectors: np.ndarray, keys: np.ndarray, orders: np.ndarray):
        self.x, self.keys, self.orders = vectors, keys, orders

    @classmethod
    def of(cls, vectors: np.ndarray, trees: int) -> Forest:
        """Rows that repeat a vector share their strings, so ties stay together."""
        hashed = strings(vectors, trees, planes(trees, vectors.shape[1])).T
        orders = np.argsort(hashed, axis=1, kind="stable").astype(np.int32)
        return cls(vectors, np.take_along_axis(hashed, orders, 1), orders)

    def search(self, queries: np.ndarray, want: int) -> list[np.ndarray]:
        """Sorted row numbers of at least `want` candidates of each query (all rows, if fewer)."""
        n, trees = len(self.x), len(self.keys)
        if want >= n:
            return [np.arange(n)] * len(queries)
        asked = strings(queries, trees, planes(trees, queries.shape[1]))
        out: list = [None] * len(queries)
        open_, depth = np.arange(len(queries)), min(BITS, int(math.log2(n)) + 2)
        while len(open_):
            low, high = np.empty((len(open_), trees), np.int64), np.empty((len(open_), trees), np.int64)
            rest = np.uint32((1 << (BITS - depth)) - 1)
            for t in range(trees):
                first = asked[open_, t] & ~rest
                low[:, t] = np.searchsorted(self.keys[t], first, "left")
                high[:, t] = np.searchsorted(self.keys[t], first | rest, "right")
            left = []
            for j, q in enumerate(open_):
                size = high[j] - low[j]
                if size.sum() >= want:
                    met = np.zeros(n, bool)
                    met[self.orders.ravel()[ragged(low[j] + np.arange(trees) * n, size)]] = True
                    rows = np.flatnonzero(met)
                    if len(rows) >= want:
                        out[q] = rows
                        continue
                left.append(q)
            open_, depth = np.array(left, int), depth - 1
        return out


def best(x: np.ndarray, ids: np.ndarray, rows: np.ndarray, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, scores) of the k largest inner products among `rows`, ties to the smaller id.

    A first pass in any summation order finds what can be among them, a second one sums row by row, so that equal vectors have equal scores.
    """
    score = x[rows] @ query
    if len(rows) > k:
        edge = np.partition(score, len(score) - k)[len(score) - k]
        rows = rows[score >= edge - 1e-9 * max(1.0, float(np.abs(score).max()))]
    score = (x[rows] * query).sum(1)
    order = np.lexsort((ids[rows], -score))[:k]
    return rows[order], score[order]


def _clean(embedding) -> np.ndarray | None:
    """The vector in double precision, or None if it takes no part."""
    if embedding is None or any(v is None for v in embedding):
        return None
    x = np.asarray(embedding, float)
    return x if len(x) and np.isfinite(x).all() and x.any() else None


def _usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, x): rows that take part, vectors as double precision bytes."""

    def run(batches):
        for b in batches:
            ids, xs = [], []
            for i, e in zip(b.column(id_col).to_pylist(), b.column(vec_col).to_pylist()):
                x = _clean(e)
                if x is not None and i is not None:
                    ids.append(i)
                    xs.append(x.astype("<f8").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(xs, pa.binary())], ["id", "x"])

    return arrow_map(vectors.select(id_col, vec_col), run, "id long, x binary")


def _matrix(xs: list[bytes], dims: int) -> np.ndarray:
    """One row a vector; shorter ones are padded with zeros."""
    if all(len(x) == 8 * dims for x in xs):
        return np.frombuffer(b"".join(xs), "<f8").reshape(-1, dims)
    out = np.zeros((len(xs), dims))
    for row, x in zip(out, xs):
        row[: len(x) // 8] = np.frombuffer(x, "<f8")
    return out


def _forests(usable: DataFrame, blocks: int, dims: int, trees: int) -> DataFrame:
    """(block, ids, data, keys, orders): one row a block."""
    dealt = usable.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).repartition(blocks, "block")

    def run(batches):
        held: dict[int, tuple[list, list]] = {}
        for b in batches:
            for i, x, k in zip(b.column("id").to_pylist(), b.column("x").to_pylist(), b.column("block").to_pylist()):
                ids, xs = held.setdefault(k, ([], []))
                ids.append(i)
                xs.append(x)
        for k in sorted(held):
            ids, xs = held.pop(k)
            data = _matrix(xs, dims)
            f = Forest.of(data, trees)
            cols = [np.array(ids, "<i8"), data.astype("<f8"), f.keys.astype("<u4"), f.orders.astype("<i4")]
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), *[pa.array([c.tobytes()], pa.binary()) for c in cols]], ["block", "ids", "data", "keys", "orders"])

    return arrow_map(dealt, run, "block int, ids binary, data binary, keys binary, orders binary")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, trees: int = 200, share: float = 0.25, least: int = 1500, block_rows: int = 16384, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, id_col, score): the k nearest found of each query by inner product, ties to the smaller id.

    In each block at least `share` of the rows and at least `least` become candidates, those that share the longest
    prefixes with the query; the two set the recall. Only queries are copied, one copy a block of `block_rows` rows. Null ids and
    vectors that are null, zero or hold null or non-finite components take no part; shorter vectors count as padded with
    zeros. Rows with the query's own id are no candidates. A repeated id is ranked row by row; equal rows among
    the queries ask once. Empty tables give an empty result; further columns are not read.
    """
    usable, asked = written(_usable(vectors, id_col, vec_col), "vectors"), written(_usable(queries, id_col, vec_col).distinct(), "asked")
    n, dims = usable.agg(F.count("*"), F.max(F.octet_length("x"))).first()
    asked_dims = asked.agg(F.max(F.octet_length("x"))).first()[0]
    dims, blocks = max(dims or 8, asked_dims or 8) // 8, max(1, math.ceil(n / block_rows))
    index = written(_forests(usable, blocks, dims, trees), "forests")
    nothing = F.lit(None).cast("binary")
    names = ["block", "id", "x", "ids", "data", "keys", "orders"]
    forests = index.select("block", F.lit(None).cast("long").alias("id"), nothing.alias("x"), "ids", "data", "keys", "orders")
    each = asked.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "id", "x", *[nothing.alias(c) for c in names[3:]])
    # Nulls sort first: a block's forest comes before its queries.
    both = forests.unionByName(each).repartition(blocks, "block").sortWithinPartitions("block", "id").select(*names)

    def answers(forest, ids, want, pending):
        y = _matrix([x for _, x in pending], dims)
        out_q, out_i, out_s = [], [], []
        for (q, _), x, rows in zip(pending, y, forest.search(y, want)):
            rows, score = best(forest.x, ids, rows[ids[rows] != q], x, k)
            out_q.append(np.full(len(rows), q))
            out_i.append(ids[rows])
            out_s.append(score)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_q).astype(np.int64)), pa.array(np.concatenate(out_i).astype(np.int64)), pa.array(np.concatenate(out_s))], ["query_id", id_col, "score"])

    def run(batches):
        forest, ids, want, now, pending = None, None, 0, None, []
        for b in batches:
            cols = {c: b.column(c) for c in names}
            for j in range(b.num_rows):
                block = cols["block"][j].as_py()
                if (block != now or len(pending) >= 256) and pending:
                    yield answers(forest, ids, want, pending)
                    pending = []
                if cols["ids"][j].is_valid:
                    now, ids = block, np.frombuffer(cols["ids"][j].as_py(), "<i8")
                    rows = len(ids)
                    parts = [np.frombuffer(cols[c][j].as_py(), t).reshape(s) for c, t, s in (("data", "<f8", (rows, dims)), ("keys", "<u4", (trees, rows)), ("orders", "<i4", (trees, rows)))]
                    forest, want = Forest(*parts), max(2 * k, least, math.ceil(share * rows))
                elif block == now:
                    pending.append((cols["id"][j].as_py(), cols["x"][j].as_py()))
        if pending:
            yield answers(forest, ids, want, pending)

    found = arrow_map(both, run, f"query_id long, {id_col} long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), id_col)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", id_col, "score")
