"""Plan records as tables: rooms, walls, openings, their measurements and surfaces."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from planloom import constants as K
from planloom.functions import geometry as G

ROOM = ("cap", "room")
# Fixed values.
SIGMA_UNMEASURED = 0.05
SIGMA_SURFACE = 0.02
SCALE = 0.01
SIGMA_JAMB = 0.008
SIGMA_JAMB_WEAK = 0.03
SIGMA_HEAD = 0.03
SIGMA_SILL = 0.02
JAMB_POINTS = 20


def _ring(order: str = "i"):
    part = Window.partitionBy(*ROOM).orderBy(order)
    return part, part.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def edges(ring: DataFrame) -> DataFrame:
    """(cap, room, i, u, v, nu, nv, length, axis): each corner with the next one, around the room."""
    w, whole = _ring()
    e = ring.select(*ROOM, "i", "u", "v", G.ring_next(F.col("u"), w, whole).alias("nu"), G.ring_next(F.col("v"), w, whole).alias("nv"))
    du, dv = F.col("nu") - F.col("u"), F.col("nv") - F.col("v")
    return e.select("*", F.sqrt(du * du + dv * dv).alias("length"), F.when(F.abs(du) >= F.abs(dv), 0).otherwise(1).alias("axis"))


def ring_metrics(ring: DataFrame) -> DataFrame:
    """(cap, room, corners, signed_area, area, perimeter)."""
    e = edges(ring)
    signed = F.sum(F.col("u") * F.col("nv") - F.col("nu") * F.col("v")) / 2
    return e.groupBy(*ROOM).agg(F.count("*").alias("corners"), signed.alias("signed_area"), F.abs(signed).alias("area"), F.sum("length").alias("perimeter"))


def counter_clockwise(ring: DataFrame) -> DataFrame:
    """Rings with positive area, renumbered backwards where they ran clockwise."""
    m = ring_metrics(ring).select(*ROOM, "signed_area", "corners")
    return ring.join(m, [*ROOM]).select(*ROOM, F.when(F.col("signed_area") > 0, F.col("i")).otherwise(F.col("corners") - 1 - F.col("i")).alias("i"), "u", "v")


def inward(ring: DataFrame) -> DataFrame:
    """(cap, room, i, axis, inward): sign of the direction across each wall that points into the room."""
    e = edges(ring)
    return e.select(*ROOM, "i", "axis", F.signum(F.when(F.col("axis") == 0, F.col("nu") - F.col("u")).otherwise(F.col("v") - F.col("nv"))).alias("inward"))


def corners_of_walls(walls: DataFrame) -> DataFrame:
    """(cap, room, i, u, v): corner i is where walls i - 1 and i meet; walls alternate in axis (0 runs along u)."""
    w, whole = _ring()
    p = walls.select(*ROOM, "i", "axis", "coord", G.ring_before(F.col("axis"), w, whole).alias("pa"), G.ring_before(F.col("coord"), w, whole).alias("pc"))
    return p.select(*ROOM, "i", F.when(F.col("pa") == 1, F.col("pc")).otherwise(F.col("coord")).alias("u"), F.when(F.col("pa") == 0, F.col("pc")).otherwise(F.col("coord")).alias("v"))


def wall_sigma(walls: DataFrame) -> DataFrame:
    """Adds sigma of a wall's position: from the spread of its surface, or a fixed value where it has none."""
    fit = G.root_sum_square(F.col("spread") / F.sqrt(F.greatest(F.col("n_points"), F.lit(1))), F.lit(SIGMA_SURFACE))
    return walls.withColumn("sigma", F.when(F.col("snapped"), fit).otherwise(SIGMA_UNMEASURED))


def propagated(walls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(walls with length_sigma, rooms with area, perimeter and their sigmas) from walls (i, length, sigma) of each room."""
    w, whole = _ring()
    s0, s1 = G.ring_before(F.col("sigma"), w, whole), G.ring_next(F.col("sigma"), w, whole)
    out = walls.withColumn("length_sigma", G.root_sum_square(s0, s1, SCALE * F.col("length")))
    sums = walls.groupBy(*ROOM).agg(F.sum(F.pow(F.col("length") * F.col("sigma"), 2)).alias("a2"), F.sum(4 * F.col("sigma") * F.col("sigma")).alias("p2"), F.sum("length").alias("perimeter"), F.first("area").alias("area"))
    rooms = sums.select(*ROOM, "area", F.sqrt(F.col("a2") + F.pow(2 * SCALE * F.col("area"), 2)).alias("area_sigma"), "perimeter", F.sqrt(F.col("p2") + F.pow(SCALE * F.col("perimeter"), 2)).alias("perimeter_sigma"))
    return out, rooms


def ceiling_sigma(rooms: DataFrame) -> DataFrame:
    """Adds height_sigma to rooms with height and the spread and number of points of both layers; null without a ceiling."""
    layer = lambda part: F.col(f"{part}_spread") / F.sqrt(F.greatest(F.col(f"{part}_points"), F.lit(1)))
    return rooms.withColumn("height_sigma", F.when(F.col("height").isNotNull(), G.root_sum_square(layer("ceiling"), layer("floor"), F.lit(SIGMA_SURFACE), SCALE * F.col("height"))))


def opening_sigmas(openings: DataFrame, walls: DataFrame) -> DataFrame:
    """Adds height and the sigmas of offset, width, height and sill to openings (wall, width, bottom, top, jamb_points).

    An offset counts from the corner with the wall before; walls hold their sigma. Only windows have a sill.
    """
    w, whole = _ring()
    before = walls.select(*ROOM, F.col("i").alias("wall"), G.ring_before(F.col("sigma"), w, whole).alias("_before"))
    jamb = F.when(F.col("jamb_points") > JAMB_POINTS, SIGMA_JAMB).otherwise(SIGMA_JAMB_WEAK)
    return openings.join(before, [*ROOM, "wall"], "left").withColumns({
        "height": F.col("top") - F.col("bottom"),
        "offset_sigma": G.root_sum_square(F.col("_before"), jamb),
        "width_sigma": G.root_sum_square(jamb, jamb, SCALE * F.col("width")),
        "height_sigma": G.root_sum_square(F.lit(SIGMA_HEAD), SCALE * F.col("top")),
        "bottom_sigma": F.when(F.col("kind") == "window", F.lit(SIGMA_SILL)),
    }).drop("_before")


def footprint(rooms: DataFrame) -> DataFrame:
    """(cap, value, sigma): areas add up, and so do their sigmas, which share their causes."""
    return rooms.groupBy("cap").agg(F.sum("area").alias("value"), F.sum("area_sigma").alias("sigma"))


def slabs(ring: DataFrame) -> DataFrame:
    """(cap, room, u0, u1, v0, v1): a rectilinear polygon as disjoint rectangles between neighbouring corner columns."""
    e = edges(ring)
    w = Window.partitionBy(*ROOM).orderBy("u0")
    cols = ring.select(*ROOM, F.col("u").alias("u0")).distinct().withColumn("u1", F.lead("u0").over(w)).where("u1 is not null")
    flat = e.where("axis = 0").select(*ROOM, F.least("u", "nu").alias("a"), F.greatest("u", "nu").alias("b"), F.col("v").alias("at"))
    over = cols.join(flat, [*ROOM]).where("a <= u0 and b >= u1")
    k = Window.partitionBy(*ROOM, "u0", "u1").orderBy("at")
    marked = over.select(*ROOM, "u0", "u1", F.col("at").alias("v0"), F.row_number().over(k).alias("k"), F.lead("at").over(k).alias("v1"))
    return marked.where("k % 2 = 1 and v1 is not null").drop("k")


def overlaps(ring: DataFrame, least: float = 0.005) -> DataFrame:
    """(cap, room_a, room_b, area): shared area of rooms of a capture, for rectilinear rooms, where above `least`."""
    a = slabs(ring)
    left = a.select("cap", F.col("room").alias("room_a"), *[F.col(c).alias(f"a{c}") for c in ("u0", "u1", "v0", "v1")])
    right = a.select("cap", F.col("room").alias("room_b"), *[F.col(c).alias(f"b{c}") for c in ("u0", "u1", "v0", "v1")])
    both = left.join(right, "cap").where("room_a < room_b and au0 < bu1 and bu0 < au1 and av0 < bv1 and bv0 < av1")
    part = (F.least("au1", "bu1") - F.greatest("au0", "bu0")) * (F.least("av1", "bv1") - F.greatest("av0", "bv0"))
    return both.groupBy("cap", "room_a", "room_b").agg(F.sum(part).alias("area")).where(F.col("area") > least)


def contains(ring: DataFrame, points: DataFrame) -> DataFrame:
    """Points (cap, *, u, v) joined with the rooms of their capture that cover them, edges included."""
    e = edges(ring).select(*ROOM, F.col("u").alias("au"), F.col("v").alias("av"), F.col("nu").alias("bu"), F.col("nv").alias("bv"))
    pid = points.columns
    j = points.join(e, "cap")
    area = (F.col("bu") - F.col("au")) * (F.col("v") - F.col("av")) - (F.col("bv") - F.col("av")) * (F.col("u") - F.col("au"))
    on = (F.abs(area) < 1e-12) & F.col("u").between(F.least("au", "bu"), F.greatest("au", "bu")) & F.col("v").between(F.least("av", "bv"), F.greatest("av", "bv"))
    span = (F.col("av") > F.col("v")) != (F.col("bv") > F.col("v"))
    hit = span & (F.col("u") < F.col("au") + (F.col("v") - F.col("av")) * (F.col("bu") - F.col("au")) / F.nullif(F.col("bv") - F.col("av"), F.lit(0.0)))
    agg = j.groupBy(*pid, "room").agg(F.sum(hit.cast("int")).alias("cuts"), F.max(on).alias("on"))
    return agg.where("on or cuts % 2 = 1").select(*pid, "room")


def surfaces(walls: DataFrame, rooms: DataFrame) -> DataFrame:
    """(cap, surface_id, kind, value, sigma): walls, floor and ceiling of each room; null where the height is unknown."""
    h = rooms.select(*ROOM, "height", "height_sigma")
    name = F.concat(F.lit("room-"), F.col("room").cast("string"))
    w = walls.join(h, [*ROOM]).select("cap", F.concat(name, F.lit("/wall-"), F.col("i").cast("string")).alias("surface_id"), F.lit("wall").alias("kind"), (F.col("length") * F.col("height")).alias("value"), G.root_sum_square(F.col("length_sigma") * F.col("height"), F.col("height_sigma") * F.col("length")).alias("sigma"))
    f = rooms.select("cap", F.concat(name, F.lit("/floor")).alias("surface_id"), F.lit("floor").alias("kind"), F.col("area").alias("value"), F.col("area_sigma").alias("sigma"))
    seen = F.col("height").isNotNull()
    c = rooms.select("cap", F.concat(name, F.lit("/ceiling")).alias("surface_id"), F.lit("ceiling").alias("kind"), F.when(seen, F.col("area")).alias("value"), F.when(seen, F.col("area_sigma")).alias("sigma"))
    return w.unionByName(f).unionByName(c)


def connections(openings: DataFrame, labels: DataFrame, res: float) -> DataFrame:
    """(cap, room, opening, connects_to): first other room met when stepping out through a door.

    `openings` has the door's middle (mu, mv), the axis of its wall and the outward sign; `labels` has (cap, r, c, label).
    """
    step = F.explode(F.array(*[F.lit(d) for d in K.PROBE_DEPTHS])).alias("depth")
    probe = openings.where("kind = 'door'").select(*ROOM, "opening", "mu", "mv", "axis", "outward", step)
    u = F.when(F.col("axis") == 1, F.col("mu") + F.col("outward") * F.col("depth")).otherwise(F.col("mu"))
    v = F.when(F.col("axis") == 0, F.col("mv") + F.col("outward") * F.col("depth")).otherwise(F.col("mv"))
    at = probe.select(*ROOM, "opening", "depth", G.cell(v, F.lit(0.0), res).alias("r"), G.cell(u, F.lit(0.0), res).alias("c"))
    hit = at.join(labels, ["cap", "r", "c"]).where("label > 0 and label <> room")
    return hit.groupBy(*ROOM, "opening").agg(F.min_by("label", "depth").alias("connects_to"))


def adjacency(connected: DataFrame) -> DataFrame:
    """(cap, room_a, room_b): sorted distinct pairs of connected rooms."""
    return connected.select("cap", F.least("room", "connects_to").alias("room_a"), F.greatest("room", "connects_to").alias("room_b")).distinct()
