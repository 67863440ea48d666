import numpy as np
from pyspark.sql import functions as F

from planloom.operators import cloud, layout, path, plan, register, rooms

RES = 0.04


def two_rooms():
    """Rooms of 4 x 3 m with a shared wall and a 0.9 m door; the camera walks through."""
    free = np.zeros((95, 220), int)
    free[10:85, 10:110] = free[10:85, 114:214] = 5
    free[36:58, 110:114] = 5
    wall = np.zeros_like(free, bool)
    wall[10:36, 110:114] = wall[58:85, 110:114] = True
    path_ = [(45, 20 + k) for k in range(80)] + [(45, 116 + k) for k in range(80)]
    return free, wall, path_


def tables(spark):
    free, wall, path_ = two_rooms()
    f = spark.createDataFrame([("a", int(r), int(c), int(free[r, c])) for r, c in np.argwhere(free)], "cap string, r int, c int, n int")
    w = spark.createDataFrame([("a", int(r), int(c)) for r, c in np.argwhere(wall)], "cap string, r int, c int")
    faces = w.select("cap", "r", "c", F.lit(1).alias("axis"), F.lit(4).alias("n"))
    v = spark.createDataFrame([("a", i, r, c) for i, (r, c) in enumerate(path_)], "cap string, seq long, r int, c int")
    return f, w, faces, v


def test_two_rooms_and_their_outlines(spark):
    lab = rooms.segment_rooms(*tables(spark), RES, 95, 220).cache()
    n = {r.label: r.n for r in lab.groupBy("label").agg(F.count("*").alias("n")).collect()}
    assert set(n) == {1, 2} and all(abs(x * RES * RES - 12.0) < 0.4 for x in n.values())
    left = lab.where("label = 1").agg(F.avg("c")).first()[0]
    assert left < 110
    ring = rooms.outlines(lab, RES)
    m = plan.ring_metrics(ring).collect()
    assert len(m) == 2 and all(r.corners == 4 and abs(r.area - 12.0) < 0.5 and r.signed_area > 0 for r in m)
    fitted = ring.selectExpr("*", "0.0d as support", "0.0d as spread", "0L as n_points", "false as snapped")
    apart, cuts = layout.resolve_overlaps(fitted, lab, RES)
    assert plan.overlaps(apart).count() == 0 and cuts.first().cuts == 0


def test_without_wall_faces_regions_merge(spark):
    f, w, faces, v = tables(spark)
    lab = rooms.segment_rooms(f, w, faces.limit(0), v, RES, 95, 220)
    assert [r.label for r in lab.select("label").distinct().collect()] == [1]


def squares(spark, *corners):
    """Rooms (u0, v0, u1, v1) as rings with statistics."""
    rows = []
    for k, (a, b, c, d) in enumerate(corners, 1):
        for i, (u, v, axis, coord) in enumerate(((a, b, 0, b), (c, b, 1, c), (c, d, 0, d), (a, d, 1, a))):
            rows.append(("a", k, i, axis, float(coord), float(u), float(v), 0.5, 0.01, 10 * k + i, True))
    return spark.createDataFrame(rows, "cap string, room int, i int, axis int, coord double, u double, v double, support double, spread double, n_points long, snapped boolean")


def test_overlap_goes_to_the_owner_and_walls_keep_their_statistics(spark):
    lab = spark.createDataFrame([("a", r, c, 2) for r in range(10) for c in range(8, 18)], "cap string, r int, c int, label int")
    apart, cuts = layout.resolve_overlaps(squares(spark, (0, 0, 1, 1), (0.8, 0, 1.8, 1)), lab, 0.1)
    area = {r.room: round(r.area, 6) for r in plan.ring_metrics(apart).collect()}
    assert area == {1: 0.8, 2: 1.0} and cuts.first().cuts == 1
    new = {(r.axis, round(r.coord, 6)): (r.n_points, r.snapped) for r in apart.where("room = 1").collect()}
    assert new == {(0, 0.0): (10, True), (0, 1.0): (12, True), (1, 0.0): (13, True), (1, 0.8): (0, False)}


def test_a_cut_that_leaves_too_little_is_not_made(spark):
    lab = spark.createDataFrame([("a", r, c, 1) for r in range(30) for c in range(30)], "cap string, r int, c int, label int")
    apart, cuts = layout.resolve_overlaps(squares(spark, (0, 0, 3, 3), (1, 1, 2, 2), (2.5, 0, 4, 1)), lab, 0.1)
    area = {r.room: round(r.area, 6) for r in plan.ring_metrics(apart).collect()}
    assert area == {1: 9.0, 2: 1.0, 3: 1.0} and cuts.first().cuts == 1


def test_the_largest_piece_of_a_cut_stays(spark):
    lab = spark.createDataFrame([("a", r, c, 2) for r in range(40) for c in range(10, 15)], "cap string, r int, c int, label int")
    apart, _ = layout.resolve_overlaps(squares(spark, (0, 0, 4, 1), (1, -1, 1.5, 3)), lab, 0.1)
    ring = sorted((round(r.u, 6), round(r.v, 6)) for r in apart.where("room = 1").collect())
    assert ring == [(1.5, 0.0), (1.5, 1.0), (4.0, 0.0), (4.0, 1.0)]


def test_collapse_keeps_the_better_wall():
    made = [(0, 0.0, True, 90), (1, 4.0, True, 90), (0, 1.0, True, 90), (1, 3.99, False, 5), (0, 3.0, True, 50), (1, 0.0, True, 90)]
    got = rooms.collapsed([rooms.Wall(a, c, rank=(s, n)) for a, c, s, n in made])
    assert len(got) == 4 and 4.0 in [w.coord for w in got]


def test_short_walls_leave_and_neighbours_meet_at_their_weighted_mean():
    ring = np.array([(0, 0), (4, 0), (4, 1), (4.1, 1), (4.1, 3), (0, 3)], float)
    got = rooms.rectilinear(ring)
    assert [(w.axis, round(w.coord, 6)) for w in got] == [(0, 0.0), (1, round((4 * 1 + 4.1 * 2) / 3, 6)), (0, 3.0), (1, 0.0)]


def test_seen_cells(spark):
    d = spark.createDataFrame([("a", 0, 2.0, 2.0, 90, 1.5, 1.5), ("a", 0, 2.0, 2.0, 91, 1.5, 1.5)], "cap string, seq long, cu double, cv double, az int, far double, far_next double")
    cells = rooms.seen_cells(d, 0.05, 80, 80).collect()
    assert cells and all(r.c >= 39 and abs(r.r - 41) <= 4 for r in cells)


def test_drift_is_found_and_smoothed(spark):
    rng = np.random.default_rng(0)
    pts = [("a", float(x), float(rng.random()), float(rng.random()), 1.0, 0.0, 0.0) for plane in (0.0, 2.0) for x in plane + rng.normal(0, 0.004, 400)]
    frame = spark.createDataFrame(pts, "cap string, x double, y double, z double, nx double, ny double, nz double")
    anchors = register.plane_anchors(frame)
    got = sorted((r.axis, round(r.anchor, 1)) for r in anchors.collect())
    assert got == [(0, 0.0), (0, 2.0)]
    values = frame.limit(400).select("cap", (F.col("x") + 0.03).alias("value"), F.monotonically_increasing_id().alias("k"), F.lit(0).alias("seq"))
    near = path.nearest_anchor(values, anchors.where("axis = 0"))
    s = path.split_residuals(near, ("cap", "seq"), "k")
    assert abs(s.first().offset + 0.03) < 0.01
    two = spark.createDataFrame([("a", 0, 0, 0.1, 1.0), ("a", 0, 10, 0.1, 1.0)], "cap string, axis int, seq long, offset double, weight double")
    assert [round(r.value, 6) for r in register.smooth_solve(two).collect()] == [0.08, 0.08]


def test_nearest_anchor_tie_is_gated(spark):
    a = spark.createDataFrame([("a", 0.0), ("a", 1.0)], "cap string, anchor double")
    v = spark.createDataFrame([("a", 0.5)], "cap string, value double")
    assert path.nearest_anchor(v, a).count() == 0
    assert path.nearest_anchor(v, a, gate=1.0).first().anchor == 0.0


def test_forest_and_hull(spark):
    views = spark.createDataFrame([("a", i) for i in range(4)], "cap string, view int")
    edges = spark.createDataFrame([("a", 0, 1, 50, 0.1), ("a", 1, 2, 40, 0.1), ("a", 0, 2, 10, 0.1)], "cap string, i int, j int, inliers int, error double")
    assert sorted((r.parent, r.child) for r in register.spanning_forest(views, edges).collect()) == [(0, 1), (1, 2)]
    p = spark.createDataFrame([("a", 1, x, y) for x, y in ((0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0), (0.5, 0.5))], "cap string, region int, along double, h double")
    r = register.convex_region(p, ("cap", "region")).first()
    assert (r.area, r.corners) == (1.0, 4)


def test_floor_is_the_lowest_strong_layer(spark):
    rng = np.random.default_rng(2)
    ys = [*(0.0 + rng.random(30) * 0.004), *(0.75 + rng.random(100) * 0.004)]
    d = spark.createDataFrame([("a", 0.0, float(y), 0.0, 0.0, 1.0, 0.0) for y in ys], "cap string, x double, y double, z double, nx double, ny double, nz double")
    assert abs(cloud.floor_layer(d).first().level - 0.002) < 0.003
