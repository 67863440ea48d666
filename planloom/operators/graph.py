"""Connected components of an edge table, by alternating star contraction."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from planloom.storage import cut


HOT_ROWS = 1_000_000


def joined(rows: DataFrame, facts: DataFrame, keys: list[str], count: str = "n", hot_rows: int = HOT_ROWS) -> DataFrame:
    """rows joined with one row of facts a key; `count` of facts says how many of the rows have the key.

    Keys with hot_rows rows or more are broadcast, so that none of them gathers in one task: there is at most one such
    key for every hot_rows rows. All others are joined by shuffle.
    """
    hot = F.broadcast(facts.where(F.col(count) >= hot_rows))
    cold = rows.join(hot.select(*keys), keys, "left_anti").join(facts.where(F.col(count) < hot_rows), keys)
    return rows.join(hot, keys).unionByName(cold)


def _lowest(edges: DataFrame, hot_rows: int | None) -> DataFrame:
    """(u, v, m): each edge with the smallest v of its u. Without hot_rows a vertex has few edges and one shuffle does."""
    if hot_rows is None:
        return edges.withColumn("m", F.min("v").over(Window.partitionBy("u")))
    lowest = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    return joined(edges, lowest, ["u"], hot_rows=hot_rows)


def _large_star(edges: DataFrame, hot_rows: int | None) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _lowest(both, hot_rows).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))


def _small_star(edges: DataFrame, hot_rows: int | None) -> DataFrame:
    """Every smaller neighbour of u, and u itself, goes to the smallest one."""
    down = _lowest(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), hot_rows)
    moved = down.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
    return moved.where("u <> v")


def _roots(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(vertices, the smallest vertex reachable from each)."""
    vertices, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    low = np.arange(len(vertices))
    while (low[a] != low[b]).any():
        x, y = low[a], low[b]
        np.minimum.at(low, np.maximum(x, y), np.minimum(x, y))
        while (low[low] != low).any():
            low = low[low]
    return vertices, vertices[low]


def connected_components(edges: DataFrame, max_rounds: int = 60, hot_rows: int = HOT_ROWS, driver_edges: int = 0) -> DataFrame:
    """``(u, v)`` -> ``(u, root)``: the smallest vertex reachable, for every vertex that has an edge to another.

    Where all edge ends together are fewer than `hot_rows`, a window finds the minima. Otherwise they are partial aggregates, and those
    of vertices with `hot_rows` edges or more are broadcast back, so no vertex with so many edges gathers in one task.
    Each round is checkpointed in the shared folder. Edges with a null end and loops are ignored. Raises if
    `max_rounds` do not suffice (the number needed grows with the logarithm of the longest path). At most `driver_edges`
    edges (rows of whole numbers, 16 bytes each, repeated ones too) are united on the driver instead, which saves a dozen shuffles; with `driver_edges`, `edges` is
    to be a frame that was cut, as it is read more than once.
    """
    if driver_edges and edges.count() <= driver_edges:
        held = edges.select("u", "v").where("u <> v").toArrow()
        vertices, roots = _roots(held["u"].to_numpy(), held["v"].to_numpy())
        kinds = [held.schema.field(c).type for c in ("u", "v")]
        return edges.sparkSession.createDataFrame(pa.table([pa.array(vertices, kinds[0]), pa.array(roots, kinds[1])], ["u", "root"]))
    now = cut(edges.select("u", "v").where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen, edges_now = None, now.count()
    for _ in range(max_rounds):
        # Both ends of every edge together are too few for a busy vertex: nothing to set apart.
        hot = hot_rows if 2 * edges_now >= hot_rows else None
        stars = _large_star(now, hot)
        now = cut(_small_star(stars if hot is None else stars.distinct(), hot).distinct())
        sign = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if sign == seen or not sign[0]:
            roots = now.select(F.col("v").alias("u"), F.col("v").alias("root")).distinct()
            return now.select("u", F.col("v").alias("root")).unionByName(roots)
        seen, edges_now = sign, sign[0]
    raise RuntimeError("connected_components did not settle")
