"""From frames of points to dimensioned plans: every capture of a table in one run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planloom import constants as K
from planloom.functions import geometry as G
from planloom.operators import cloud, layout, path, plan, register, rooms
from planloom.sources import sinks
from planloom.storage import written

# Fixed values.
RES = 0.02
FREE_STEP = 5
FREE_POINTS = 50
FREE_LOW = 0.15
FREE_DEFAULT_TOP = 2.2
WALL_BAND = (0.2, 2.0)
WALL_CELL_POINTS = 3
WALL_PARALLEL = 0.8
PLANE_POINTS = 40
EXTENT_BAND = 0.05
WARNINGS = ("Walls are taken to meet at right angles.", "Openings follow from geometry and have not been confirmed.")


def capture_axes(points: DataFrame, angle: DataFrame, names: tuple[str, ...] = ("x", "y", "z"), key: str = "cap") -> DataFrame:
    """`points` turned about the vertical so that the main wall direction is an axis; the names are turned in place."""
    a, _, b = names
    c, s = F.cos("angle"), F.sin("angle")
    return points.join(angle.select(key, "angle"), key).withColumns({a: c * F.col(a) + s * F.col(b), b: -s * F.col(a) + c * F.col(b)}).drop("angle")


def correct_drift(points: DataFrame, poses: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(points, poses, report): frames shifted towards the planes of the whole capture, where that fits held-out points better.

    `points` has (cap, seq, x, y, z, nx, ny, nz) in world axes, `poses` (cap, seq, x, y, z). Plane positions come from the fused
    cloud, shifts of keyframes from every other residual of each axis, smoothed along the path; the other residuals
    decide. Only positions change. The report has (cap, applied, keyframes, before, after, most).
    """
    fused = cloud.voxel_downsample(points.where(F.col("seq") % FREE_STEP == 0).select("cap", "x", "y", "z", "nx", "ny", "nz"))
    angle = written(cloud.manhattan_angle(fused), "angle")
    turned = capture_axes(capture_axes(fused, angle), angle, ("nx", "ny", "nz"))
    anchors = register.plane_anchors(turned).select(F.struct("cap", "axis").alias("plane"), "anchor")
    keys = path.keyframes(poses.select("cap", "seq"))
    mine = capture_axes(capture_axes(points.join(keys, ["cap", "seq"], "left_semi"), angle), angle, ("nx", "ny", "nz"))
    axes = F.explode(F.array(*[F.struct(F.lit(i).alias("axis"), F.col(p).alias("value"), F.col(n).alias("n")) for i, (p, n) in enumerate((("x", "nx"), ("y", "ny"), ("z", "nz")))]))
    flat = mine.select("cap", "seq", F.xxhash64("x", "y", "z").alias("order"), axes.alias("k")).select("cap", "seq", "order", "k.*").where(F.abs("n") > K.AXIS_COS)
    able = flat.groupBy("cap", "seq", "axis").count().where(F.col("count") >= PLANE_POINTS).drop("count")
    near = path.nearest_anchor(flat.join(able, ["cap", "seq", "axis"], "left_semi").withColumn("plane", F.struct("cap", "axis")), anchors, key="plane")
    near = written(near.select("cap", "seq", "axis", "order", "residual"), "residuals")
    split = path.split_residuals(near, ("cap", "seq", "axis"), "order")
    every = keys.select("cap", "seq", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("axis")).join(split, ["cap", "seq", "axis"], "left").fillna(0.0, ["offset", "weight"])
    shifts = written(register.smooth_solve(every), "shifts")
    odd = path.held_out(near, ("cap", "seq", "axis"), "order").join(shifts, ["cap", "seq", "axis"])
    gain = path.held_out_gain(odd, F.col("value"))
    frames = None
    for axis, name in enumerate(("dx", "dy", "dz")):
        part = path.interpolate(poses.select("cap", "seq"), shifts.where(F.col("axis") == axis).select("cap", "seq", "value")).withColumnRenamed("value", name)
        frames = part if frames is None else frames.join(part, ["cap", "seq"])
    accepted = gain.where("accepted").select("cap")
    c, s = F.cos("angle"), F.sin("angle")
    world = frames.join(accepted, "cap", "left_semi").join(angle, "cap").select("cap", "seq", (c * F.col("dx") - s * F.col("dz")).alias("dx"), "dy", (s * F.col("dx") + c * F.col("dz")).alias("dz"))
    world = written(world.fillna(0.0), "corrections")

    def moved(df: DataFrame) -> DataFrame:
        j = df.join(world, ["cap", "seq"], "left").fillna(0.0, ["dx", "dy", "dz"])
        return j.withColumns({a: F.col(a) + F.col(f"d{a}") for a in "xyz"}).select(*df.columns)

    size = F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy") + F.col("dz") * F.col("dz"))
    counts = keys.groupBy("cap").agg(F.count("*").alias("keyframes")).join(world.groupBy("cap").agg(F.max(size).alias("most")), "cap", "left")
    report = poses.select("cap").distinct().join(gain, "cap", "left").join(counts, "cap", "left")
    report = report.select("cap", F.coalesce("accepted", F.lit(False)).alias("applied"), "keyframes", "before", "after", F.coalesce("most", F.lit(0.0)).alias("most"))
    return moved(points), moved(poses), report


def free_space(points: DataFrame, poses: DataFrame, tops: DataFrame, res: float, step: int = FREE_STEP) -> DataFrame:
    """(cap, r, c, n): how many of every `step`-th frame saw each cell; frames with too few points between shin and ceiling see nothing.

    `points` has (cap, seq, u, v, h), `poses` (cap, seq, u, v) and `tops` (cap, top), the height up to which points count.
    """
    hits = points.where(F.col("seq") % step == 0).join(tops, "cap").where((F.col("h") > FREE_LOW) & (F.col("h") < F.col("top"))).select("cap", "seq", "u", "v")
    able = hits.groupBy("cap", "seq").count().where(F.col("count") >= FREE_POINTS).drop("count")
    eyes = poses.select("cap", "seq", F.col("u").alias("cu"), F.col("v").alias("cv"))
    seen = hits.join(able.join(eyes, ["cap", "seq"]), ["cap", "seq"])
    by = ("cap", "seq", "cu", "cv")
    fans = cloud.fan_neighbours(cloud.fan_max(seen, F.col("cu"), F.col("cv"), by), by)
    return cloud.free_space_count(rooms.seen_cells(fans, res))


def wall_faces(points: DataFrame, res: float) -> DataFrame:
    """(cap, r, c, axis, n, lo, hi): cells of wall surface by the axis along which it runs, and how far their points reach along it."""
    axis = F.when(F.abs("nv") > WALL_PARALLEL, 0).when(F.abs("nu") > WALL_PARALLEL, 1)
    at = layout.with_cells(points.withColumn("axis", axis).where("axis is not null"), res)
    along = F.when(F.col("axis") == 0, F.col("u")).otherwise(F.col("v"))
    return at.groupBy("cap", "r", "c", "axis").agg(F.count("*").alias("n"), F.min(along).alias("lo"), F.max(along).alias("hi"))


def process(points: DataFrame, poses: DataFrame, drift: bool = True, tier: str = "lidar", res: float = RES, least_visits: int = 30) -> dict[str, DataFrame]:
    """Plans of all captures: (cap, seq, x, y, z, nx, ny, nz) points of frames and (cap, seq, t, x, y, z) poses, both in world axes.

    Returns the tables walls, rooms, openings, adjacency, labels, footprint, drift, diagnostics and documents. Captures without floor, wall
    direction or entered room have no plan; an empty table gives empty tables. Nulls in coordinates drop the point.
    """
    points = points.dropna(subset=["cap", "seq", "x", "y", "z", "nx", "ny", "nz"])
    if drift:
        points, poses, report = correct_drift(points, poses)
    else:
        none = F.lit(None).cast("double")
        report = poses.select("cap").distinct().select("cap", F.lit(False).alias("applied"), F.lit(None).cast("long").alias("keyframes"), none.alias("before"), none.alias("after"), F.lit(0.0).alias("most"))
    fused = written(cloud.voxel_downsample(points.where(F.col("seq") % FREE_STEP == 0).select("cap", "x", "y", "z", "nx", "ny", "nz")), "cloud")
    floors = written(cloud.floor_layer(fused), "floors")
    ceilings = cloud.ceiling_layer(fused, floors).select("cap", F.col("level").alias("ceiling"))
    angle = cloud.manhattan_angle(fused)
    world = floors.select("cap", F.col("level").alias("floor")).join(angle, "cap")
    turn = lambda df: df.join(world, "cap").withColumns(dict(zip(("u", "v"), G.to_plan(F.col("x"), F.col("z"), F.col("angle")))))
    flat = turn(fused).where(F.abs(F.col("y") - F.col("floor")) < EXTENT_BAND)
    frame = written(cloud.plan_extent(flat, res).join(world, "cap"), "frame")

    def placed(df: DataFrame) -> DataFrame:
        """With plan coordinates from the corner of the capture's frame, and heights above its floor."""
        j = df.join(frame, "cap")
        u, v = G.to_plan(F.col("x"), F.col("z"), F.col("angle"))
        out = {"u": u - F.col("u0"), "v": v - F.col("v0"), "h": F.col("y") - F.col("floor")}
        if "nx" in df.columns:
            out |= dict(zip(("nu", "nv"), G.to_plan(F.col("nx"), F.col("nz"), F.col("angle"))))
        return j.withColumns(out).drop("u0", "v0", "angle", "floor", "rows", "cols")

    cells = written(placed(fused), "placed")
    camera = written(placed(poses), "camera")
    upright = cells.where((F.abs("ny") < K.VERTICAL_NY) & (F.col("h") > WALL_BAND[0]) & (F.col("h") < WALL_BAND[1]))
    wall = cloud.raster_count(upright, res, WALL_CELL_POINTS)
    tops = floors.join(ceilings, "cap", "left").select("cap", F.coalesce(F.col("ceiling") - F.col("level") - FREE_LOW, F.lit(FREE_DEFAULT_TOP)).alias("top"))
    inside = lambda df: df.join(frame.select("cap", "rows", "cols"), "cap").where("r >= 0 and c >= 0 and r < rows and c < cols").drop("rows", "cols")
    free = written(inside(free_space(placed(points.where(F.col("seq") % FREE_STEP == 0)), camera, tops, res)), "free")
    visits = layout.with_cells(camera, res).select("cap", "seq", "r", "c")
    labels = written(rooms.segment_rooms(free, inside(wall), inside(wall_faces(upright, res)), inside(visits), res, least_visits=least_visits), "labels")

    ring, levels = layout.fit_rooms(labels, cells, floors, res)
    levels = written(levels, "levels")
    ring, cuts = layout.resolve_overlaps(written(ring, "ring"), labels, res)
    ring = written(ring, "walls")
    openings = written(layout.number_openings(layout.find_openings(ring, levels, cells, floors, free, res)), "openings")
    walls, totals = plan.propagated(plan.wall_sigma(layout.wall_lines(ring).join(plan.ring_metrics(ring).select(*plan.ROOM, "area"), [*plan.ROOM])))
    totals = plan.ceiling_sigma(totals.join(levels, [*plan.ROOM]))
    notes = walls.groupBy(*plan.ROOM).agg(F.count("*").alias("walls"), F.count_if(~F.col("snapped")).alias("unmeasured"))
    unseen = F.when(F.col("height").isNull(), F.lit("no ceiling was seen"))
    unfit = F.when(F.col("unmeasured") > 0, F.format_string("%d of %d walls follow free space alone", "unmeasured", "walls"))
    totals = totals.join(notes, [*plan.ROOM]).withColumn("notes", F.array_compact(F.array(unseen, unfit)))
    openings = layout.door_middles(plan.opening_sigmas(openings, walls), ring)
    openings = openings.join(plan.connections(openings, labels, res), [*plan.ROOM, "opening"], "left").drop("mu", "mv", "axis", "outward")
    walls, totals, openings = written(walls, "plan"), written(totals, "plan"), written(openings, "plan")
    adjacency = plan.adjacency(openings.where("connects_to is not null"))
    footprint = plan.footprint(totals)
    along = path.path_length(camera).select("cap", "frames", F.col("length").alias("camera_path"), "loop_gap")
    duration = poses.groupBy("cap").agg((F.max_by("t", "seq") - F.min_by("t", "seq")).alias("duration"))
    diagnostics = along.join(duration, "cap").join(cuts, "cap", "left").join(report.withColumnRenamed("keyframes", "drift_keyframes"), "cap", "left")
    turned = frame.select("cap", F.degrees("angle").alias("rotation"), F.col("floor").alias("floor_height"), "u0", "v0")
    out = {"walls": walls, "rooms": totals, "openings": openings, "adjacency": adjacency, "labels": labels, "footprint": footprint, "drift": report, "diagnostics": diagnostics, "frame": turned}
    out["documents"] = sinks.plan_documents(ring, walls, totals, openings, footprint, adjacency, diagnostics, turned, tier, WARNINGS)
    return out


def drift_ablation(points: DataFrame, poses: DataFrame, **how) -> DataFrame:
    """(cap, rooms_before, rooms_after, area_before, area_after, residual_before, residual_after, applied): each capture without and with drift correction."""
    sides = {}
    for name, drift in (("before", False), ("after", True)):
        done = process(points, poses, drift=drift, **how)
        counted = done["rooms"].groupBy("cap").agg(F.count("*").alias(f"rooms_{name}"), F.sum("area").alias(f"area_{name}"))
        sides[name] = counted
        report = done["drift"]
    residual = report.select("cap", F.col("before").alias("residual_before"), F.col("after").alias("residual_after"), "applied")
    return residual.join(sides["before"], "cap", "left").join(sides["after"], "cap", "left")
