"""Raster operators on sparse cells (cap, r, c, ...); an absent row is an empty cell."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CELL = ("cap", "r", "c")


def _shifts(half: int, centre: bool = True):
    return F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in range(-half, half + 1) for b in range(-half, half + 1) if centre or a or b]))


def dilate(cells: DataFrame, size: int = 3) -> DataFrame:
    """Cells with a set cell in the size x size square around them."""
    s = cells.select(*CELL).distinct().select(*CELL, _shifts(size // 2).alias("k"))
    return s.select("cap", (F.col("r") + F.col("k.a")).alias("r"), (F.col("c") + F.col("k.b")).alias("c")).distinct()


def erode(cells: DataFrame, size: int = 3) -> DataFrame:
    """Cells whose whole size x size square is set."""
    s = cells.select(*CELL).distinct().select(*CELL, _shifts(size // 2).alias("k"))
    n = s.groupBy("cap", (F.col("r") + F.col("k.a")).alias("r"), (F.col("c") + F.col("k.b")).alias("c")).count()
    return n.where(F.col("count") == size * size).select(*CELL)


def opened(cells: DataFrame, size: int = 5) -> DataFrame:
    return dilate(erode(cells, size), size)


def closed(cells: DataFrame, size: int = 3) -> DataFrame:
    return erode(dilate(cells, size), size)


def neighbour_contact(labels: DataFrame, least: int = 1) -> DataFrame:
    """(cap, a, b, n): for labels a <> b, cells of b that touch a, diagonals included, where at least `least`."""
    s = labels.select("cap", "r", "c", F.col("label").alias("a"), _shifts(1, centre=False).alias("k"))
    ring = s.select("cap", (F.col("r") + F.col("k.a")).alias("r"), (F.col("c") + F.col("k.b")).alias("c"), "a").distinct()
    hit = ring.join(labels.select(*CELL, F.col("label").alias("b")), [*CELL]).where("a <> b")
    return hit.groupBy("cap", "a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def component_areas(labels: DataFrame, res: float) -> DataFrame:
    return labels.where("label > 0").groupBy("cap", "label").agg((F.count("*") * res * res).alias("area"))


def lookup(points: DataFrame, labels: DataFrame, column: str = "label") -> DataFrame:
    """Points with the label of their cell, 0 where there is none."""
    return points.join(labels.select(*CELL, column), [*CELL], "left").fillna(0, [column])


def swept_share(strips: DataFrame, others: DataFrame, res: float, by: tuple[str, ...], own: str | None = None) -> DataFrame:
    """(cap, *by, share): share of the cells of each strip (cap, u0, u1, v0, v1) that belong to `others`; an empty strip has 0.

    With `own`, a column of the strips, cells whose label is that number are not counted as another's.
    """
    by = ("cap", *[b for b in by if b != "cap"])
    u = F.expr(f"sequence(cast(floor(u0 / {res}) as int), cast(greatest(ceil(u1 / {res}) - 1, floor(u0 / {res})) as int))")
    v = F.expr(f"sequence(cast(floor(v0 / {res}) as int), cast(greatest(ceil(v1 / {res}) - 1, floor(v0 / {res})) as int))")
    cells = strips.where("u1 > u0 and v1 > v0").select(*by, F.explode(u).alias("c"), "v0", "v1").select(*by, "c", F.explode(v).alias("r"))
    label = F.col("label") if own else F.lit(1)
    hit = cells.join(others.select(*CELL, label.alias("_label")).distinct(), [*CELL], "left")
    theirs = F.col("_label").isNotNull() if own is None else F.coalesce(F.col("_label") != F.col(own), F.lit(False))
    share = hit.groupBy(*by).agg(F.avg(theirs.cast("double")).alias("share"))
    return strips.select(*by).join(share, [*by], "left").fillna(0.0, ["share"])
