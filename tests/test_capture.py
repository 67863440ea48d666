"""Hand-checkable captures, plans and measurements."""

import json
import struct
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from planloom.functions import geometry as G
from planloom.operators import cloud, evaluate, path, plan
from planloom.sources import capture, sinks


def png(img: np.ndarray, method: int = 0) -> bytes:
    raw = img.astype(">u2").tobytes() if img.dtype == np.uint16 else img.tobytes()
    line = len(raw) // img.shape[0]
    rows = [raw[i : i + line] for i in range(0, len(raw), line)]
    if method == 2:
        rows = [bytes((a - b) & 255 for a, b in zip(r, rows[i - 1] if i else bytes(line))) for i, r in enumerate(rows)]
    body = zlib.compress(b"".join(bytes([method]) + r for r in rows))
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", img.shape[1], img.shape[0], 8 * img.dtype.itemsize, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", body) + chunk(b"IEND", b"")


@pytest.mark.parametrize("own", [True, False])
def test_depth_capture(spark, tmp_path, own):
    root = tmp_path / "scan"
    (root / "depth").mkdir(parents=True)
    (root / "confidence").mkdir()
    (root / "odometry.csv").write_text("timestamp, frame, x, y, z, qx, qy, qz, qw, fx, fy, cx, cy\n0.5, 7, 0, 0, 0, 0, 0, 0, 1" + (", 1200, 1200, 960, 720" if own else "") + "\n")
    (root / "camera_matrix.csv").write_text("1200,0,960\n0,1200,720\n0,0,1\n")
    (root / "depth/000007.png").write_bytes(png(np.full((12, 16), 2000, np.uint16), 2))
    (root / "confidence/000007.png").write_bytes(png(np.full((12, 16), 2, np.uint8)))
    assert capture.capture_root(tmp_path) == root
    poses = capture.read_poses(spark, {"a": f"{root}/odometry.csv"})
    depth = capture.read_grids(spark, {"a": f"{root}/depth"}, "depth_mm")
    conf = capture.read_grids(spark, {"a": f"{root}/confidence"}, "conf")
    px = capture.pixels(poses, depth, conf)
    k = G.scaled_intrinsics(*[F.col(c) for c in ("fx", "fy", "cx", "cy")], *[F.lit(x) for x in (1920.0, 1440.0, 16.0, 12.0)])
    assert tuple(px.select(*k).first()) == (10.0, 10.0, 8.0, 6.0)
    p = G.back_project(F.col("u"), F.col("v"), F.col("z"), *k)
    grid = px.select("cap", "seq", "u", "v", "conf", p[0].alias("x"), p[1].alias("y"), p[2].alias("z"))
    normals = cloud.normals_from_grid(grid, ("cap", "seq")).join(grid.select("cap", "seq", "u", "v", "conf"), ["cap", "seq", "u", "v"])
    r = cloud.valid_points(normals).agg(F.count("*"), F.min("x"), F.max("x"), F.min("y"), F.max("y"), F.max("n2"), F.max("z")).first()
    assert r[0] == 140 and np.allclose(r[1:5], (-1.4, 1.2, -1.0, 0.8)) and r[5] < -0.99 and r[6] == 2.0


def test_missing_captures(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        capture.capture_root(tmp_path)
    (tmp_path / "odometry.csv").write_text("header\n")
    with pytest.raises(ValueError):
        capture.read_poses(spark, {"a": f"{tmp_path}/odometry.csv"})


def test_archives(tmp_path):
    with zipfile.ZipFile(tmp_path / "bad.zip", "w") as z:
        z.writestr("../outside.txt", "x")
    with pytest.raises(ValueError):
        capture.unpack_archive(tmp_path / "bad.zip", tmp_path / "work")
    assert not (tmp_path / "outside.txt").exists() and not (tmp_path / "work/outside.txt").exists()
    with zipfile.ZipFile(tmp_path / "good.zip", "w") as z:
        z.writestr("a/b.txt", "x")
    out = capture.unpack_archive(tmp_path / "good.zip", tmp_path / "work")
    assert (out / "a/b.txt").read_text() == "x" and capture.unpack_archive(tmp_path / "good.zip", tmp_path / "work") == out


def test_photos(spark, tmp_path):
    with pytest.raises(ValueError):
        (tmp_path / "x").mkdir()
        (tmp_path / "x/readme.txt").write_text("no photo")
        capture.list_photos(spark, f"{tmp_path}/x")
    for i in range(3):
        (tmp_path / f"x/{i}.JPG").write_bytes(b"x")
    assert {r.room for r in capture.list_photos(spark, f"{tmp_path}/x").collect()} == {"x"}
    for i in range(9):
        (tmp_path / f"x/m{i}.png").write_bytes(b"x")
    with pytest.raises(ValueError):
        capture.list_photos(spark, f"{tmp_path}/x")


@pytest.mark.parametrize("angle", [0.0, 0.5, 1.4])
def test_plan_round_trip(spark, angle):
    d = spark.createDataFrame([(1.0, 3.0), (-2.0, 0.5)], "x double, z double")
    u, v = G.to_plan(F.col("x"), F.col("z"), F.lit(angle))
    bx, bz = G.to_world(F.col("u"), F.col("v"), F.lit(angle))
    for r in d.select("x", "z", u.alias("u"), v.alias("v")).select("x", "z", bx.alias("bx"), bz.alias("bz")).collect():
        assert abs(r.x - r.bx) < 1e-12 and abs(r.z - r.bz) < 1e-12


def test_intervals(spark):
    d = spark.createDataFrame([(0.01, 0.5), (4.0, 0.05)], "v double, s double")
    low, high = G.interval(F.col("v"), F.col("s"))
    rows = d.select(low.alias("l"), high.alias("h")).collect()
    assert rows[0].l == 0 and np.allclose(tuple(rows[1]), (3.902, 4.098))
    bad = spark.createDataFrame([(float("nan"), 0.1)], "v double, s double")
    with pytest.raises(Exception, match="finite"):
        bad.select(G.checked_sigma(F.col("v"), F.col("s"))).collect()


def square(spark, second=False):
    rooms = [("a", 1, 0.0, 0.0)] + [("a", 2, 0.0, 0.0)] * second
    return spark.createDataFrame([(c, r, i, x + u, y + v) for c, r, x, y in rooms for i, (u, v) in enumerate(((0, 0), (4, 0), (4, 3), (0, 3)))], "cap string, room int, i int, u double, v double")


def test_checks_and_overlaps(spark):
    ring = square(spark)
    walls = plan.edges(ring).select("cap", "room", "i", F.col("u").alias("su"), F.col("v").alias("sv"), F.col("nu").alias("eu"), F.col("nv").alias("ev"), "length")
    rooms = spark.createDataFrame([("a", 1, 12.0)], "cap string, room int, area_value double")
    none = spark.createDataFrame([], "cap string, room int, opening int, wall int, offset double, width double, connects_to int")
    assert evaluate.geometry_errors(ring, rooms, walls, none).count() == 0
    wrong = walls.withColumn("length", F.when(F.col("i") == 0, 7.0).otherwise(F.col("length")))
    assert [r.rule for r in evaluate.geometry_errors(ring, rooms, wrong, none).collect()] == ["wall_length"]
    assert [r.area for r in plan.overlaps(square(spark, True)).collect()] == [12.0]


def test_surfaces(spark):
    w = spark.createDataFrame([("a", 1, 0, 4.0, 0.05), ("a", 1, 1, 3.0, 0.05)], "cap string, room int, i int, length double, length_sigma double")
    r = spark.createDataFrame([("a", 1, 12.0, 0.5, 2.5, 0.1)], "cap string, room int, area double, area_sigma double, height double, height_sigma double")
    got = {s.surface_id: (s.value, round(s.sigma, 5)) for s in plan.surfaces(w, r).collect()}
    assert got["room-1/wall-0"] == (10.0, 0.41908) and got["room-1/wall-1"] == (7.5, 0.325) and got["room-1/ceiling"] == (12.0, 0.5)


def test_opening_gate(spark):
    dims = spark.createDataFrame([("a", f"room-1/opening-{i}/width", 0.9, 0.02) for i in (0, 1)], "cap string, dimension string, value double, sigma double")
    truth = spark.createDataFrame([("a", "lidar", "laser", True, 0.02, f"room-1/opening-{i}/width", t) for i, t in ((0, 0.9), (2, 0.8))], "cap string, tier string, source string, exhaustive boolean, lidar_tolerance double, dimension string, target double")
    rows = evaluate.evaluate_rows(dims, evaluate.checked_truth(truth))
    g = evaluate.opening_gate(rows, dims, truth).first()
    assert (g.successes, g.truths, g.phantoms) == (1, 2, 1) and abs(g.fraction - 1 / 3) < 1e-12 and not g.passes
    with pytest.raises(Exception, match="independently"):
        evaluate.checked_truth(truth.withColumn("source", F.lit("lidar"))).collect()


def test_voxels(spark):
    pts = spark.createDataFrame([("a", 0.123456789, 0.0, 0.0, 0.0, 1.0, 0.0), ("a", 0.126345678, 0.0, 0.0, 0.0, 1.0, 0.0), ("a", 1.0, 2.0, 3.0, 0.0, 1.0, 0.0)], "cap string, x double, y double, z double, nx double, ny double, nz double")
    got = sorted((r.n, round(r.x, 10)) for r in cloud.voxel_downsample(pts).collect())
    assert got == [(1, 1.0), (2, 0.1249012335)]


def test_closing_and_runs(spark):
    for flags, want in (([1, 0, 1], [1, 1, 1]), ([1, 0, 0, 1], [1, 1, 1, 1]), ([1, 0, 0, 0, 1], [1, 0, 0, 0, 1]), ([0, 1, 0], [0, 1, 0])):
        d = spark.createDataFrame([("a", i, bool(f)) for i, f in enumerate(flags)], "cap string, bin long, flag boolean")
        assert [int(r.flag) for r in path.close_gaps(d, ("cap",)).orderBy("bin").collect()] == want
    d = spark.createDataFrame([("a", i, bool(f)) for i, f in enumerate([0, 1, 1, 0, 1])], "cap string, bin long, flag boolean")
    assert sorted((r.start, r.stop) for r in path.runs(d, ("cap",)).collect()) == [(1, 3), (4, 5)]


def test_even_spacing_and_first_visits(spark):
    assert G.evenly_spaced(13, 4) == [0, 4, 8, 12] and G.evenly_spaced(1, 4) == [0]
    v = spark.createDataFrame([("a", i, x) for i, x in enumerate((5, 5, 2, 0, 5))], "cap string, seq long, label int")
    assert {r.label: r.room for r in path.first_visit_order(v).collect()} == {5: 1, 2: 2}
    t = spark.createDataFrame([("a", i, x) for i, x in enumerate((1, 1, 0, 2, 1))], "cap string, seq long, label int")
    assert [(r.room_a, r.room_b) for r in path.room_transitions(t).collect()] == [(1, 2)]


def test_page_escapes(spark):
    d = spark.createDataFrame([("a", json.dumps({"capture": "</script><b>"}))], "cap string, plan string")
    html = sinks.page(d).first().html
    assert html.count("</script>") == 1 and "\\u003c/script>" in html
