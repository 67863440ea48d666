"""Walls against the cloud: band joins, measured positions, coverage and openings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from planloom import constants as K
from planloom.operators.path import close_gaps, runs

WALL = ("cap", "wall")


def band_join(points: DataFrame, walls: DataFrame, reach: float, margin: float, bucket: float | None = None, by: tuple[str, ...] = ("cap",)) -> DataFrame:
    """Points within `reach` of a wall's line and inside its ends plus `margin`, with `along` and `across` coordinates.

    `walls` has (cap, wall, axis, coord, lo, hi). Points are matched on buckets of the across coordinate, so that
    no pair of far rows is formed; `by` names what else must agree.
    """
    size = bucket or 2 * reach
    near = F.explode(F.sequence(F.floor((F.col("coord") - reach) / size), F.floor((F.col("coord") + reach) / size)))
    w = walls.select(*WALL, "axis", "coord", "lo", "hi", *[c for c in walls.columns if c not in (*WALL, "axis", "coord", "lo", "hi")], near.alias("_b"))
    both = None
    for axis, (along, across) in enumerate((("u", "v"), ("v", "u"))):
        p = points.withColumns({"along": F.col(along), "across": F.col(across), "_b": F.floor(F.col(across) / size)}).drop("u", "v")
        j = p.join(w.where(F.col("axis") == axis), [*by, "_b"])
        both = j if both is None else both.unionByName(j)
    return both.where((F.abs(F.col("across") - F.col("coord")) < reach) & (F.col("along") > F.col("lo") + margin) & (F.col("along") < F.col("hi") - margin)).drop("_b")


def snapped_layers(band: DataFrame, search: float = K.SNAP_SEARCH, width: float = K.SNAP_BIN, least: int = 50) -> DataFrame:
    """(cap, wall, bin, centre, strength, order): dense layers of each wall's band, outermost first.

    Counts are smoothed by 1-2-1; a layer is dense at 0.4 of the most. `band` has `inward`, the sign that points into the room.
    """
    able = band.groupBy(*WALL).count().where(F.col("count") >= least).select(*WALL)
    bins = band.join(able, [*WALL], "left_semi").groupBy(*WALL, "coord", "inward", F.floor((F.col("across") - (F.col("coord") - search)) / width).alias("bin")).agg(F.count("*").alias("n"))
    last = int(round(2 * search / width)) - 1
    spread = F.explode(F.array(*[F.struct(F.lit(d).alias("d"), F.lit(w).alias("w")) for d, w in ((-1, 1), (0, 2), (1, 1))]))
    s = bins.select("*", spread.alias("k")).groupBy(*WALL, "coord", "inward", (F.col("bin") + F.col("k.d")).alias("bin")).agg(F.sum(F.col("n") * F.col("k.w")).alias("strength")).where(F.col("bin").between(0, last))
    most = s.groupBy(*WALL).agg(F.max("strength").alias("most"))
    centre = F.col("coord") - search + (F.col("bin") + 0.5) * width
    dense = s.join(most, [*WALL]).where(F.col("strength") >= 0.4 * F.col("most")).select(*WALL, "bin", centre.alias("centre"), "strength", "inward")
    return dense.withColumn("order", F.row_number().over(Window.partitionBy(*WALL).orderBy(F.col("centre") * F.col("inward")))).drop("inward")


def measured_walls(band: DataFrame, peaks: DataFrame, half: float = 0.02, least_support: float = 0.2) -> DataFrame:
    """(cap, wall, coord, support, spread, n_points, snapped): exact medians of the points near each chosen peak."""
    near = band.select(*WALL, "along", "across", (F.col("hi") - F.col("lo")).alias("length")).join(peaks.select(*WALL, "centre"), [*WALL]).where(F.abs(F.col("across") - F.col("centre")) < half)
    mid = near.groupBy(*WALL).agg(F.median("across").alias("coord"), F.count("*").alias("n_points"), F.count_distinct(F.floor(F.col("along") / 0.05)).alias("bins"), F.first("length").alias("length"))
    mad = near.join(mid.select(*WALL, "coord"), [*WALL]).groupBy(*WALL).agg((K.MAD_SCALE * F.median(F.abs(F.col("across") - F.col("coord")))).alias("spread"))
    support = F.least(F.lit(1.0), F.col("bins") * 0.05 / F.col("length"))
    return mid.join(mad, [*WALL]).select(*WALL, "coord", support.alias("support"), "spread", "n_points", (support >= least_support).alias("snapped"))


def occupancy(band: DataFrame, walls: DataFrame, width: float = K.OPENING_BIN) -> DataFrame:
    """(cap, wall, bin, low, mid): one row for each bin along each wall, and whether the low and middle height bands are hit.

    `band` has along (distance from the wall's start) and h; `walls` has length.
    """
    nb = F.ceil(F.col("length") / width)
    bins = walls.select(*WALL, F.explode(F.sequence(F.lit(0).cast("long"), nb - 1)).alias("bin"))
    at = band.join(walls.select(*WALL, nb.alias("_nb")), [*WALL]).withColumn("bin", F.least(F.greatest((F.col("along") / width).cast("long"), F.lit(0)), F.col("_nb") - 1))
    hit = at.groupBy(*WALL, "bin").agg(F.bool_or((F.col("h") > 0.15) & (F.col("h") < 0.75)).alias("low"), F.bool_or((F.col("h") > 0.9) & (F.col("h") < 1.8)).alias("mid"))
    return bins.join(hit, [*WALL, "bin"], "left").fillna(False, ["low", "mid"])


def gap_runs(bins: DataFrame, width: float = K.OPENING_BIN) -> DataFrame:
    """(cap, wall, kind, start, stop): closed gaps of plausible width that touch neither end of the wall."""
    full = close_gaps(bins.withColumn("flag", ~F.col("low") & ~F.col("mid")), WALL).select(*WALL, "bin", F.col("flag").alias("full"))
    mid = close_gaps(bins.withColumn("flag", ~F.col("mid")), WALL).select(*WALL, "bin", F.col("flag").alias("part"))
    both = full.join(mid, [*WALL, "bin"])
    door = runs(both.withColumn("flag", F.col("full")), WALL).withColumn("kind", F.lit("door"))
    window = runs(both.withColumn("flag", F.col("part") & ~F.col("full")), WALL).withColumn("kind", F.lit("window"))
    ends = bins.groupBy(*WALL).agg((F.max("bin") + 1).alias("nb"))
    wide = (F.col("stop") - F.col("start")) * width
    kept = door.unionByName(window).join(ends, [*WALL]).where(wide.between(*K.OPENING_WIDTHS) & (F.col("start") > 0) & (F.col("stop") < F.col("nb")))
    return kept.select(*WALL, "kind", "start", "stop")


def openings(gaps: DataFrame, band: DataFrame, bins: DataFrame, seen: DataFrame, walls: DataFrame, width: float = K.OPENING_BIN) -> DataFrame:
    """(cap, wall, kind, offset, width, bottom, top, seen_share, jamb_points).

    A door must be seen through in half its bins; a window needs wall below it. Jambs, head and sill are percentiles of
    nearby points where there are enough, else bin edges and defaults. `seen` has (cap, wall, bin, seen); `walls` has length and top.
    """
    key = [*WALL, "kind", "start", "stop"]
    inside = gaps.join(seen, [*WALL]).where("bin >= start and bin < stop").groupBy(*key).agg(F.avg(F.col("seen").cast("double")).alias("seen_share"))
    low = gaps.join(bins, [*WALL]).where("bin >= start - 2 and bin < stop + 2").groupBy(*key).agg(F.avg(F.col("low").cast("double")).alias("low_share"))
    g = gaps.join(inside, key, "left").join(low, key, "left").fillna(0.0, ["seen_share", "low_share"])
    g = g.where(((F.col("kind") == "door") & (F.col("seen_share") >= 0.5)) | ((F.col("kind") == "window") & (F.col("low_share") > 0.6)))
    p = band.select(*WALL, "along", "h")
    a, z = F.col("start") * width, F.col("stop") * width
    m = g.join(p.where("h > 0.9 and h < 1.8"), [*WALL], "left")
    left, right = (F.col("along") < a + width) & (F.col("along") > a - 0.15), (F.col("along") > z - width) & (F.col("along") < z + 0.15)
    jamb = m.groupBy(*key, "seen_share").agg(F.count_if(left).alias("nl"), F.count_if(right).alias("nr"), F.percentile(F.when(left, F.col("along")), 0.98).alias("pl"), F.percentile(F.when(right, F.col("along")), 0.02).alias("pr"))
    jamb = jamb.join(walls.select(*WALL, "length", "top"), [*WALL]).select("*", F.when(F.col("nl") > 5, F.col("pl")).otherwise(a).alias("j0"), F.when(F.col("nr") > 5, F.col("pr")).otherwise(z).alias("j1"))
    jamb = jamb.where("j0 >= 0 and j1 <= length and j1 > j0")
    q = jamb.join(p, [*WALL], "left")
    between = (F.col("along") > F.col("j0")) & (F.col("along") < F.col("j1"))
    head, sill = between & (F.col("h") > 1.5), between & (F.col("h") < 1.2)
    out = q.groupBy(*key, "seen_share", "nl", "nr", "j0", "j1", "top").agg(F.count_if(head).alias("nh"), F.percentile(F.when(head, F.col("h")), 0.02).alias("ph"), F.count_if(sill).alias("ns"), F.percentile(F.when(sill, F.col("h")), 0.98).alias("ps"))
    bottom = F.when(F.col("kind") == "door", 0.0).when(F.col("ns") > 20, F.col("ps")).otherwise(0.9)
    return out.select(*WALL, "kind", F.col("j0").alias("offset"), (F.col("j1") - F.col("j0")).alias("width"), bottom.alias("bottom"), F.when(F.col("nh") > 20, F.col("ph")).otherwise(F.col("top")).alias("top"), "seen_share", (F.col("nl") + F.col("nr")).alias("jamb_points"))


def seen_beyond(walls: DataFrame, free: DataFrame, res: float, width: float = K.OPENING_BIN, least: int = 3) -> DataFrame:
    """(cap, wall, bin, seen): whether enough frames saw the space behind each bin, at the best of three depths.

    `walls` has axis, coord, start, direction, outward and length; `free` has (cap, r, c, n).
    """
    depth = F.explode(F.array(*[F.lit(d) for d in K.BEYOND_DEPTHS]))
    b = walls.select(*WALL, "axis", "coord", "start", "direction", "outward", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("length") / width) - 1)).alias("bin")).select("*", depth.alias("depth"))
    along, across = F.col("start") + F.col("direction") * (F.col("bin") + 0.5) * width, F.col("coord") + F.col("outward") * F.col("depth")
    u, v = F.when(F.col("axis") == 0, along).otherwise(across), F.when(F.col("axis") == 0, across).otherwise(along)
    q = b.select(*WALL, "bin", F.floor(v / res).cast("int").alias("r"), F.floor(u / res).cast("int").alias("c"))
    return q.join(free.select("cap", "r", "c", "n"), ["cap", "r", "c"], "left").groupBy(*WALL, "bin").agg((F.max(F.coalesce("n", F.lit(0))) >= least).alias("seen"))
