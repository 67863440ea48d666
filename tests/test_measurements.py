"""Sigmas and intervals against values worked out by hand, not against SQL that repeats the code."""

import math

from pyspark.sql import functions as F

from planloom.functions import geometry as G
from planloom.operators import evaluate, plan

ROOM = "cap string, room int"


def test_wall_room_and_footprint_sigmas(spark):
    """A 4 x 3 m room with walls of sigma 0.05."""
    rows = [("a", 1, i, n, 0.05, 12.0) for i, n in enumerate((4.0, 3.0, 4.0, 3.0))]
    walls, rooms = plan.propagated(spark.createDataFrame(rows, f"{ROOM}, i int, length double, sigma double, area double"))
    long = math.sqrt(2 * 0.05**2 + 0.04**2)
    assert [round(r.length_sigma, 9) for r in walls.orderBy("i").collect()] == [round(x, 9) for x in (long, math.sqrt(0.0059), long, math.sqrt(0.0059))]
    r = rooms.first()
    assert math.isclose(r.area_sigma, math.sqrt(2 * 0.2**2 + 2 * 0.15**2 + 0.24**2)) and math.isclose(r.perimeter_sigma, math.sqrt(4 * 0.1**2 + 0.14**2))
    f = plan.footprint(rooms.unionByName(rooms)).first()
    assert (f.value, round(f.sigma, 9)) == (24.0, round(2 * r.area_sigma, 9))


def test_fitted_and_unfitted_walls(spark):
    rows = [("a", 1, 0, True, 0.04, 400), ("a", 1, 1, False, 0.0, 0)]
    got = [r.sigma for r in plan.wall_sigma(spark.createDataFrame(rows, f"{ROOM}, i int, snapped boolean, spread double, n_points int")).orderBy("i").collect()]
    assert math.isclose(got[0], math.sqrt(0.002**2 + 0.02**2)) and got[1] == 0.05


def test_ceiling_and_opening_sigmas(spark):
    rooms = spark.createDataFrame([("a", 1, 2.5, 0.02, 400, 0.01, 100), ("a", 2, None, 0.0, 0, 0.0, 0)], f"{ROOM}, height double, ceiling_spread double, ceiling_points int, floor_spread double, floor_points int")
    got = {r.room: r.height_sigma for r in plan.ceiling_sigma(rooms).collect()}
    assert math.isclose(got[1], math.sqrt(0.001**2 + 0.001**2 + 0.02**2 + 0.025**2)) and got[2] is None
    walls = spark.createDataFrame([("a", 1, i, s) for i, s in enumerate((0.03, 0.05, 0.02, 0.04))], f"{ROOM}, i int, sigma double")
    openings = spark.createDataFrame([("a", 1, 0, "door", 0.9, 0.0, 2.0, 21), ("a", 1, 2, "window", 1.0, 0.9, 2.1, 20)], f"{ROOM}, wall int, kind string, width double, bottom double, top double, jamb_points int")
    door, window = plan.opening_sigmas(openings, walls).orderBy("wall").collect()
    assert math.isclose(door.offset_sigma, math.hypot(0.04, 0.008)) and math.isclose(door.width_sigma, math.sqrt(2 * 0.008**2 + 0.009**2))
    assert math.isclose(door.height_sigma, math.hypot(0.03, 0.02)) and door.bottom_sigma is None and door.height == 2.0
    assert math.isclose(window.offset_sigma, math.hypot(0.05, 0.03)) and math.isclose(window.width_sigma, math.sqrt(2 * 0.03**2 + 0.01**2))
    assert math.isclose(window.height_sigma, math.hypot(0.03, 0.021)) and window.bottom_sigma == 0.02 and math.isclose(window.height, 1.2)


def test_surfaces_of_a_room(spark):
    """Walls of 4 and 3 m with sigmas 0.1 and 0.05, a ceiling at 2.5 m with 0.1, area 12 with 0.5: 10 and 7.5 m2."""
    walls = spark.createDataFrame([("a", 1, i, n, s) for i, (n, s) in enumerate(((4.0, 0.05), (3.0, 0.05), (4.0, 0.05), (3.0, 0.05)))], f"{ROOM}, i int, length double, length_sigma double")
    rooms = spark.createDataFrame([("a", 1, 12.0, 0.5, 2.5, 0.1)], f"{ROOM}, area double, area_sigma double, height double, height_sigma double")
    got = {r.surface_id: (r.value, r.sigma) for r in plan.surfaces(walls, rooms).collect()}
    assert len(got) == 6 and math.isclose(got["room-1/wall-0"][1], math.hypot(0.125, 0.4), abs_tol=1e-9) and got["room-1/wall-0"][0] == 10.0
    assert got["room-1/wall-1"][0] == 7.5 and math.isclose(got["room-1/wall-1"][1], math.hypot(0.125, 0.3)) and got["room-1/floor"] == (12.0, 0.5)


def test_priors(spark):
    d = spark.createDataFrame([("photos", 2.0), ("video", 2.0), ("video", 0.5)], "tier string, x double")
    kinds = [G.prior_sigma(F.col("x"), F.col("tier"), k) for k in ("length", "height", "area", "perimeter")] + [G.prior_sigma(F.col("x"), F.col("tier"), "length", "segmented")]
    got = [[round(x, 9) for x in r] for r in d.select(*kinds).collect()]
    assert got == [[0.36, 0.36, 0.72, 0.36, 0.36], [0.24, 0.24, 0.48, 0.24, 0.24], [0.12, 0.2, 0.12, 0.06, 0.15]]


def test_crossing_rings_and_bad_intervals(spark):
    square, tie = [(0, 0), (2, 0), (2, 2), (0, 2)], [(0, 0), (2, 2), (2, 0), (0, 2.5)]
    rows = [("a", k, i, float(u), float(v)) for k, ring in ((1, square), (2, tie)) for i, (u, v) in enumerate(ring)]
    assert [r.room for r in evaluate.self_crossing(spark.createDataFrame(rows, f"{ROOM}, i int, u double, v double")).collect()] == [2]
    m = spark.createDataFrame([("a", "x", 1.0, 0.1, 0.8, 1.2), ("a", "y", 1.0, 0.1, 1.1, 1.2), ("a", "z", float("nan"), 0.1, 0.8, 1.2), ("a", "w", 1.0, None, 0.8, 1.2)], "cap string, dimension string, value double, sigma double, low double, high double")
    assert sorted(r.dimension for r in evaluate.bad_intervals(m).collect()) == ["w", "y", "z"]
