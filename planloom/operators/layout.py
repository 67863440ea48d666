"""From labelled cells and points to measured rooms: wall fit, height layers, openings, overlaps."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from planloom import constants as K
from planloom.functions import geometry as G
from planloom.operators import cloud, kernels, raster, rooms, walls
from planloom.operators.plan import ROOM, _ring

# Fixed values.
NEAR_ROOM_CELLS = 17
SHORTEST_FIT = 0.3
SHORTEST_OPENING_WALL = 0.5
INWARD_COS = 0.85
SWEPT_LIMIT = 0.15
LAYER_BIN = 0.005
LAYER_HALF = 0.02
FLOOR_POINTS = 200
CEILING_POINTS = 500
TOP_DEFAULT = 2.4
TOP_MARGIN = 0.05
LEAST_PIECE = 0.2
LEAST_OVERLAP = 1e-4
SAME_WALL = 0.01

STATS = ("support", "spread", "n_points", "snapped")


def wall_lines(ring: DataFrame) -> DataFrame:
    """Walls (cap, room, i, axis, coord, u, v, ...) with the end of each, its extent along its axis, running direction and inward sign."""
    w, whole = _ring()
    out = ring.withColumns({"nu": G.ring_next(F.col("u"), w, whole), "nv": G.ring_next(F.col("v"), w, whole)})
    flat = F.col("axis") == 0
    out = out.withColumns({"start": F.when(flat, F.col("u")).otherwise(F.col("v")), "_stop": F.when(flat, F.col("nu")).otherwise(F.col("nv"))})
    out = out.withColumns({
        "lo": F.least("start", "_stop"),
        "hi": F.greatest("start", "_stop"),
        "length": F.abs(F.col("_stop") - F.col("start")),
        "direction": F.signum(F.col("_stop") - F.col("start")),
        "wall": F.col("room").cast("long") * 1000 + F.col("i"),
    })
    return out.withColumn("inward", F.when(flat, F.col("direction")).otherwise(-F.col("direction"))).drop("_stop")


def near_rooms(labels: DataFrame, size: int = NEAR_ROOM_CELLS) -> DataFrame:
    """(cap, room, r, c): cells within the size x size square of a cell of the room, one axis after the other."""
    half = size // 2
    across = labels.where("label > 0").select("cap", F.col("label").alias("room"), "r", F.explode(F.sequence(F.col("c") - half, F.col("c") + half)).alias("c")).distinct()
    return across.select("cap", "room", "c", F.explode(F.sequence(F.col("r") - half, F.col("r") + half)).alias("r")).distinct()


def with_cells(points: DataFrame, res: float) -> DataFrame:
    return points.withColumns({"r": G.cell(F.col("v"), F.lit(0.0), res), "c": G.cell(F.col("u"), F.lit(0.0), res)})


def fit_walls(outlines: DataFrame, points: DataFrame, labels: DataFrame, res: float) -> DataFrame:
    """Outline walls moved onto the surface measured for them, with support, spread, n_points and snapped.

    `points` has (cap, u, v, h, nu, nv, ny) of the cloud. A wall's surface is the outermost dense layer of points that face into
    the room, unless reaching it would sweep over cells of other rooms. Walls with too few points keep their place. Corners are
    those of the outline throughout.
    """
    lines = wall_lines(outlines)
    wanted = lines.where(F.col("length") >= SHORTEST_FIT).select("cap", "room", "wall", "axis", "coord", "lo", "hi", "inward")
    upright = points.where((F.abs("ny") < K.VERTICAL_NY) & (F.col("h") > 0.2) & (F.col("h") < 2.2)).select("cap", "u", "v", "nu", "nv")
    mine = with_cells(upright, res).join(near_rooms(labels), ["cap", "r", "c"]).drop("r", "c")
    band = walls.band_join(mine, wanted, K.SNAP_SEARCH, 0.05, by=("cap", "room"))
    facing = F.when(F.col("axis") == 0, F.col("nv")).otherwise(F.col("nu")) * F.col("inward") > INWARD_COS
    band = band.where(facing).drop("nu", "nv")
    layers = walls.snapped_layers(band).join(wanted.select("cap", "room", "wall", "axis", "coord", "lo", "hi"), ["cap", "wall"])
    flat, near, far = F.col("axis") == 0, F.least("coord", "centre"), F.greatest("coord", "centre")
    along = (F.col("lo") + 0.05, F.col("hi") - 0.05)
    strips = layers.where(F.abs(F.col("centre") - F.col("coord")) >= res).select(
        "cap", "room", "wall", "order",
        *[F.when(flat, a).otherwise(b).alias(n) for n, a, b in (("u0", along[0], near), ("u1", along[1], far), ("v0", near, along[0]), ("v1", far, along[1]))],
    )
    swept = raster.swept_share(strips, labels.where("label > 0"), res, ("room", "wall", "order"), own="room")
    open_ = layers.join(swept.select("cap", "wall", "order", "share"), ["cap", "wall", "order"], "left").where(F.coalesce("share", F.lit(0.0)) < SWEPT_LIMIT)
    peaks = open_.groupBy("cap", "wall").agg(F.min_by("centre", "order").alias("centre"))
    found = walls.measured_walls(band, peaks).withColumnRenamed("coord", "measured")
    out = lines.select(*ROOM, "i", "wall", "axis", "coord").join(found, ["cap", "wall"], "left")
    return out.select(*ROOM, "i", "axis", F.coalesce("measured", "coord").alias("coord"), F.coalesce("support", F.lit(0.0)).alias("support"), F.coalesce("spread", F.lit(0.0)).alias("spread"), F.coalesce("n_points", F.lit(0)).cast("long").alias("n_points"), F.coalesce("snapped", F.lit(False)).alias("snapped"))


def _table(cap, room, ring: list[rooms.Wall], stats: list[tuple]) -> pd.DataFrame:
    p = rooms.corners(ring)
    rows = [stats[w.source] if w.source >= 0 else (0.0, 0.0, 0, False) for w in ring]
    out = pd.DataFrame(rows, columns=list(STATS))
    return out.assign(cap=cap, room=room, i=np.arange(len(ring), dtype=np.int32), axis=[w.axis for w in ring], coord=[w.coord for w in ring], u=p[:, 0], v=p[:, 1])


def _ring_schema(df: DataFrame) -> str:
    kinds = dict(df.dtypes)
    return f"cap {kinds['cap']}, room {kinds['room']}, i int, axis int, coord double, u double, v double, support double, spread double, n_points long, snapped boolean"


NAMES = ["cap", "room", "i", "axis", "coord", "u", "v", *STATS]


def collapse(fitted: DataFrame) -> DataFrame:
    """Fitted walls without near-zero steps, counter-clockwise, with corners; of two walls that meet the better measured one keeps its place."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        stats = list(pdf[list(STATS)].itertuples(index=False, name=None))
        ring = [rooms.Wall(int(a), float(c), rank=(bool(s), int(n)), source=k) for k, (a, c, s, n) in enumerate(zip(pdf["axis"], pdf["coord"], pdf["snapped"], pdf["n_points"]))]
        return _table(pdf["cap"].iloc[0], pdf["room"].iloc[0], rooms.collapsed(ring), stats)[NAMES]

    return fitted.groupBy(*ROOM).applyInPandas(run, _ring_schema(fitted))


def layer(points: DataFrame, value: str, least: int) -> DataFrame:
    """(cap, room, level, spread, n): the strongest layer of each room with more than `least` points."""
    keyed = points.select(F.struct(*ROOM).alias("key"), value)
    able = keyed.groupBy("key").count().where(F.col("count") > least).select("key")
    keyed = keyed.join(able, "key", "left_semi")
    top = cloud.histogram(keyed, value, LAYER_BIN, "key").groupBy("key").agg(F.max(F.struct("n", (-F.col("bin")).alias("down"), "lo")).alias("b"))
    centre = top.select("key", (F.col("b.lo") - F.col("b.down") * LAYER_BIN + LAYER_BIN / 2).alias("centre"))
    near = keyed.join(centre, "key").where(F.abs(F.col(value) - F.col("centre")) < LAYER_HALF)
    mid = near.groupBy("key").agg(F.median(value).alias("level"), F.count("*").alias("n"))
    spread = near.join(mid, "key").groupBy("key").agg((K.MAD_SCALE * F.median(F.abs(F.col(value) - F.col("level")))).alias("spread"))
    return mid.join(spread, "key").select("key.*", "level", "spread", "n")


def heights(points: DataFrame, labels: DataFrame, floors: DataFrame, res: float) -> DataFrame:
    """(cap, room, floor, floor_spread, floor_points, ceiling, ceiling_spread, ceiling_points, height) of each labelled room.

    A floor seen too little is the capture's; a ceiling seen too little is null, and so is the height. Levels are world heights.
    """
    inside = with_cells(points.where(F.abs("ny") > K.HORIZONTAL_NY), res).join(labels.where("label > 0").select("cap", "r", "c", F.col("label").alias("room")), ["cap", "r", "c"])
    low = layer(inside.where(F.abs("h") < 0.05), "y", FLOOR_POINTS)
    high = layer(inside.where(F.col("h") > K.CEILING_MIN_HEIGHT), "y", CEILING_POINTS)
    name = lambda df, part: df.select(*ROOM, F.col("level").alias(part), F.col("spread").alias(f"{part}_spread"), F.col("n").alias(f"{part}_points"))
    every = labels.where("label > 0").select("cap", F.col("label").alias("room")).distinct().join(floors.select("cap", F.col("level").alias("_floor")), "cap")
    out = every.join(name(low, "floor"), [*ROOM], "left").join(name(high, "ceiling"), [*ROOM], "left")
    out = out.withColumn("floor", F.coalesce("floor", "_floor")).drop("_floor").fillna(0, ["floor_spread", "floor_points", "ceiling_spread", "ceiling_points"])
    return out.withColumn("height", F.col("ceiling") - F.col("floor"))


def fit_rooms(labels: DataFrame, points: DataFrame, floors: DataFrame, res: float) -> tuple[DataFrame, DataFrame]:
    """(walls, heights) of all rooms: outline, fit to surfaces, collapse, and both height layers."""
    return collapse(fit_walls(rooms.outlines(labels, res), points, labels, res)), heights(points, labels, floors, res)


def find_openings(ring: DataFrame, levels: DataFrame, points: DataFrame, floors: DataFrame, free: DataFrame, res: float) -> DataFrame:
    """(cap, room, wall, kind, offset, width, bottom, top, seen_share, jamb_points) of doors and windows.

    Gaps of a wall's surface along its length, as wide as an opening may be: a full-height gap that frames saw through is a door, a gap
    with wall below a window. Heights are above the room's floor; `points` has h above the capture's.
    """
    lines = wall_lines(ring).where(F.col("length") >= SHORTEST_OPENING_WALL).join(levels.select(*ROOM, "floor", "height"), [*ROOM])
    lines = lines.join(floors.select("cap", F.col("level").alias("_floor")), "cap")
    lines = lines.withColumns({"lift": F.col("floor") - F.col("_floor"), "top": F.coalesce("height", F.lit(TOP_DEFAULT)) - TOP_MARGIN, "outward": -F.col("inward")})
    wanted = lines.select("cap", "wall", "axis", "coord", "lo", "hi", "start", "direction", "lift")
    band = walls.band_join(points.select("cap", "u", "v", "h"), wanted, K.OPENING_PLANE, -0.05)
    band = band.select("cap", "wall", ((F.col("along") - F.col("start")) * F.col("direction")).alias("along"), (F.col("h") - F.col("lift")).alias("h"))
    bins = walls.occupancy(band, lines)
    gaps = walls.gap_runs(bins)
    found = walls.openings(gaps, band, bins, walls.seen_beyond(lines, free, res), lines)
    key = lines.select("cap", "wall", "room", "i")
    return found.join(key, ["cap", "wall"]).select(*ROOM, F.col("i").alias("wall"), "kind", "offset", "width", "bottom", "top", "seen_share", "jamb_points")


class Grid:
    """Rectilinear polygons of one capture on the grid of all their coordinates: set operations are exact."""

    def __init__(self, rings: list[np.ndarray]):
        self.us, self.vs = (np.unique(np.concatenate([r[:, k] for r in rings])) for k in (0, 1))
        self.areas = np.outer(np.diff(self.vs), np.diff(self.us))

    def mask(self, ring: np.ndarray) -> np.ndarray:
        """Cells inside a ring, by the parity of the horizontal edges below."""
        cells = np.zeros((len(self.vs), len(self.us)), int)
        for p, q in zip(ring, np.roll(ring, -1, 0)):
            if p[1] == q[1]:
                a, b = np.searchsorted(self.us, sorted((p[0], q[0])))
                cells[np.searchsorted(self.vs, p[1]), a:b] ^= 1
        return (np.cumsum(cells, 0)[:-1, :-1] % 2).astype(bool)

    def largest(self, mask: np.ndarray) -> tuple[np.ndarray, float]:
        """The piece with the most area, and its area; pieces that meet in a corner are apart."""
        parts, n = kernels.label(mask)
        size = np.bincount(parts.ravel(), self.areas.ravel(), n + 1)
        size[0] = -1
        best = int(size.argmax())
        return parts == best, max(float(size[best]), 0.0)

    def ring(self, mask: np.ndarray) -> np.ndarray:
        """Outer border of a piece, corners only, counter-clockwise."""
        at = kernels.outline(mask).astype(int)
        straight = ((at == np.roll(at, 1, 0)) & (at == np.roll(at, -1, 0))).any(1)
        at = at[~straight]
        return np.stack([self.us[at[:, 0]], self.vs[at[:, 1]]], 1)


def rebuilt(ring: np.ndarray, old: list[rooms.Wall]) -> list[rooms.Wall]:
    """Walls of a ring; each keeps the statistics of the first old wall on its line."""
    out = []
    for p, q in zip(ring, np.roll(ring, -1, 0)):
        axis = int(abs(q[0] - p[0]) < abs(q[1] - p[1]))
        coord = float(p[1 - axis])
        source = next((w.source for w in old if w.axis == axis and abs(w.coord - coord) < SAME_WALL), -1)
        out.append(rooms.Wall(axis, coord, source=source))
    return out if kernels.area(rooms.corners(out)) > 0 else out[::-1]


def cut_overlaps(layouts: dict[int, list[rooms.Wall]], cells: pd.DataFrame, res: float) -> int:
    """Room after room, each overlap stays with the room whose cells fill more of its box (the lower number in a tie) and is cut from
    the other, of which the largest piece stays. A cut that would leave too little is not made. Changes `layouts`, returns the cuts."""
    made, numbers = 0, sorted(layouts)
    owner = {(r, c): k for r, c, k in cells[["r", "c", "label"]].itertuples(index=False)}
    for n, a in enumerate(numbers):
        for b in numbers[n + 1 :]:
            grid = Grid([rooms.corners(layouts[a]), rooms.corners(layouts[b])])
            inside = {k: grid.mask(rooms.corners(layouts[k])) for k in (a, b)}
            shared = inside[a] & inside[b]
            if grid.areas[shared].sum() < LEAST_OVERLAP:
                continue
            r, c = np.nonzero(shared)
            us, vs = np.arange(grid.us[c.min()], grid.us[c.max() + 1], res / 2), np.arange(grid.vs[r.min()], grid.vs[r.max() + 1], res / 2)
            votes = [owner.get((y, x), 0) for y in np.floor(vs / res).astype(int) for x in np.floor(us / res).astype(int)]
            winner, loser = (a, b) if votes.count(a) >= votes.count(b) else (b, a)
            rest, area = grid.largest(inside[loser] & ~inside[winner])
            if area >= LEAST_PIECE:
                layouts[loser] = rebuilt(grid.ring(rest), layouts[loser])
                made += 1
    return made


def resolve_overlaps(ring: DataFrame, labels: DataFrame, res: float) -> tuple[DataFrame, DataFrame]:
    """(walls without overlaps, (cap, cuts)); the walls of one capture are a bounded group, like its cells."""
    schema = _ring_schema(ring) + ", cuts long"

    def run(pdf: pd.DataFrame, cells: pd.DataFrame) -> pd.DataFrame:
        if pdf.empty:
            return pd.DataFrame(columns=[*NAMES, "cuts"])
        layouts, stats = {}, {}
        for room, part in pdf.groupby("room"):
            part = part.sort_values("i")
            stats[room] = list(part[list(STATS)].itertuples(index=False, name=None))
            layouts[room] = [rooms.Wall(int(a), float(c), source=k) for k, (a, c) in enumerate(zip(part["axis"], part["coord"]))]
        cuts = cut_overlaps(layouts, cells, res)
        return pd.concat([_table(pdf["cap"].iloc[0], room, layouts[room], stats[room]) for room in sorted(layouts)])[NAMES].assign(cuts=cuts)

    done = ring.select(*NAMES).groupBy("cap").cogroup(labels.select("cap", "r", "c", "label").groupBy("cap")).applyInPandas(run, schema)
    return done.drop("cuts"), done.groupBy("cap").agg(F.max("cuts").alias("cuts"))


def number_openings(openings: DataFrame) -> DataFrame:
    """Adds `opening`, counted in each room by wall, doors before windows, then offset."""
    w = Window.partitionBy(*ROOM).orderBy("wall", "kind", "offset")
    return openings.withColumn("opening", (F.row_number().over(w) - 1).cast("int"))


def door_middles(openings: DataFrame, ring: DataFrame) -> DataFrame:
    """Openings with the middle (mu, mv) of each on its wall, the wall's axis and its outward sign."""
    lines = wall_lines(ring).select(*ROOM, F.col("i").alias("wall"), "axis", "coord", "start", "direction", (-F.col("inward")).alias("outward"))
    j = openings.join(lines, [*ROOM, "wall"])
    middle = F.col("start") + F.col("direction") * (F.col("offset") + F.col("width") / 2)
    flat = F.col("axis") == 0
    return j.withColumns({"mu": F.when(flat, middle).otherwise(F.col("coord")), "mv": F.when(flat, F.col("coord")).otherwise(middle)}).drop("coord", "start", "direction")
