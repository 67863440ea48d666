"""Whole runs over drawn captures: two rooms with a door, seen by a camera that walks through."""

import json
import math

import numpy as np
import pandas as pd
import pytest

from planloom import process
from planloom.operators import evaluate, plan
from planloom.sources import sinks

HEIGHT, DOOR, HEAD = 2.5, (1.0, 1.9), 2.0
#: Wall faces (u, v) to (u, v) with the normal that faces the camera.
FACES = [
    ((0, 0), (4, 0), (0, 1)), ((0, 3), (4, 3), (0, -1)), ((0, 0), (0, 3), (1, 0)), ((4, 0), (4, 1), (-1, 0)), ((4, 1.9), (4, 3), (-1, 0)),
    ((4.12, 0), (8.12, 0), (0, 1)), ((4.12, 3), (8.12, 3), (0, -1)), ((8.12, 0), (8.12, 3), (-1, 0)), ((4.12, 0), (4.12, 1), (1, 0)), ((4.12, 1.9), (4.12, 3), (1, 0)),
    ((4, 1), (4.12, 1), (0, 1)), ((4, 1.9), (4.12, 1.9), (0, -1)),
]


def capture(name, turn, frames=200, rays=220, rungs=12, seed=0, drift=0.0):
    """(points, poses): every fifth frame has points; positions are off by `drift` in the second half."""
    rng = np.random.default_rng(seed)
    path = np.stack([np.where(np.arange(frames) < frames // 2, np.linspace(0.7, 5.3, frames), np.linspace(2.9, 7.4, frames)), 1.45 + 0.3 * np.sin(np.arange(frames) / 9)], 1)
    parts = []
    for seq in range(0, frames, 5):
        eye, a = path[seq], rng.random(rays) * 2 * math.pi
        d = np.stack([np.cos(a), np.sin(a)], 1)
        best, normal = np.full(rays, np.inf), np.zeros((rays, 2))
        for p, q, n in FACES:
            p, q = np.array(p, float), np.array(q, float)
            e = q - p
            det = d[:, 0] * -e[1] + d[:, 1] * e[0]
            with np.errstate(divide="ignore", invalid="ignore"):
                t = ((p - eye)[0] * -e[1] + (p - eye)[1] * e[0]) / det
                s = (d[:, 0] * (p - eye)[1] - d[:, 1] * (p - eye)[0]) / det
            hit = (t > 1e-6) & (s >= 0) & (s <= 1) & (t < best)
            best[hit], normal[hit] = t[hit], n
        ok = np.isfinite(best)
        at = eye + d[ok] * best[ok, None]
        h = rng.random((ok.sum(), rungs)) * HEIGHT
        noise = rng.normal(0, 0.003, (ok.sum(), rungs))
        u, v = (np.repeat(at[:, k], rungs) + np.repeat(normal[ok, k], rungs) * noise.ravel() for k in (0, 1))
        parts.append(pd.DataFrame({"seq": seq, "u": u, "v": v, "h": h.ravel(), "nu": np.repeat(normal[ok, 0], rungs), "nv": np.repeat(normal[ok, 1], rungs), "ny": 0.0}))
        if eye[0] < 3.9:
            v = DOOR[0] + rng.random(60) * (DOOR[1] - DOOR[0])
            parts.append(pd.DataFrame({"seq": seq, "u": 4 + rng.normal(0, 0.003, 60), "v": v, "h": HEAD + rng.random(60) * (HEIGHT - HEAD), "nu": -1.0, "nv": 0.0, "ny": 0.0}))
        base = 0.0 if eye[0] < 4.06 else 4.12
        for level, ny in ((0.0, 1.0), (HEIGHT, -1.0)):
            parts.append(pd.DataFrame({"seq": seq, "u": base + rng.random(500) * 4, "v": rng.random(500) * 3, "h": level + rng.normal(0, 0.003, 500), "nu": 0.0, "nv": 0.0, "ny": ny}))
    p = pd.concat(parts)
    late = drift * (p["seq"] >= frames // 2)
    c, s = math.cos(turn), math.sin(turn)
    world = pd.DataFrame({"cap": name, "seq": p["seq"], "x": c * (p["u"] + late) - s * p["v"] + 3, "y": p["h"] - 1.2, "z": s * (p["u"] + late) + c * p["v"] - 2, "nx": c * p["nu"] - s * p["nv"], "ny": p["ny"], "nz": s * p["nu"] + c * p["nv"]})
    u = path[:, 0] + drift * (np.arange(frames) >= frames // 2)
    poses = pd.DataFrame({"cap": name, "seq": np.arange(frames), "t": np.arange(frames) / 10, "x": c * u - s * path[:, 1] + 3, "y": 0.2, "z": s * u + c * path[:, 1] - 2})
    return world, poses


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("captures")
    both = [capture("a", 0.3), capture("b", 1.1, seed=1)]
    for k, name in enumerate(("points", "poses")):
        pd.concat([x[k] for x in both]).astype({"seq": "int64"}).to_parquet(folder / f"{name}.parquet", index=False)
    frames = [spark.read.parquet(f"file://{folder}/{n}.parquet") for n in ("points", "poses")]
    done = process.process(*frames, drift=False)
    return {k: v.cache() for k, v in done.items()}


def test_rooms_and_their_measurements(made):
    rooms = made["rooms"].collect()
    assert sorted((r.cap, r.room) for r in rooms) == [("a", 1), ("a", 2), ("b", 1), ("b", 2)]
    for r in rooms:
        assert abs(r.area - 12) < 0.15 and abs(r.perimeter - 14) < 0.1 and abs(r.height - HEIGHT) < 0.01
        assert r.notes == [] and 0.02 < r.height_sigma < 0.05 and 0 < r.area_sigma < 0.5
    assert all(w.snapped for w in made["walls"].collect()) and made["walls"].count() == 16


def test_the_door_joins_the_rooms(made):
    doors = made["openings"].where("kind = 'door'").collect()
    assert {(d.cap, d.room, d.connects_to) for d in doors} == {(c, a, b) for c in "ab" for a, b in ((1, 2), (2, 1))}
    assert all(abs(d.width - 0.9) < 0.06 for d in doors)
    assert sorted((r.cap, r.room_a, r.room_b) for r in made["adjacency"].collect()) == [("a", 1, 2), ("b", 1, 2)]


def test_documents_read_back_and_are_valid(made):
    docs = made["documents"]
    first = json.loads(docs.first().plan)
    assert first["schema"] == sinks.VERSION and len(first["rooms"]) == 2 and first["diagnostics"]["frames"] == 200
    t = sinks.read_plans(docs)
    said = t["rooms"].withColumnRenamed("area", "area_value")
    errors = evaluate.geometry_errors(t["ring"], said, t["walls"], t["openings"])
    assert errors.collect() == [] and evaluate.bad_intervals(t["intervals"]).count() == 0
    assert {r.valid for r in evaluate.validity(said, errors, plan.overlaps(t["ring"])).collect()} == {True}
    assert abs(t["footprint"].first().value - 24) < 0.3


def test_no_captures_give_no_plans(spark, made):
    points = spark.createDataFrame([], "cap string, seq long, x double, y double, z double, nx double, ny double, nz double")
    poses = spark.createDataFrame([], "cap string, seq long, t double, x double, y double, z double")
    assert all(v.count() == 0 for v in process.process(points, poses).values())


def test_drift_is_taken_out(spark, tmp_path):
    points, poses = capture("a", 0.3, rays=120, drift=0.05)
    frames = []
    for name, table in (("points", points), ("poses", poses)):
        table.astype({"seq": "int64"}).to_parquet(tmp_path / f"{name}.parquet", index=False)
        frames.append(spark.read.parquet(f"file://{tmp_path}/{name}.parquet"))
    moved, _, report = process.correct_drift(*frames)
    r = report.first()
    assert r.keyframes == 20 and moved.count() == len(points)
    assert (r.after < 0.995 * r.before) == r.applied and r.most <= 0.08 * math.sqrt(3) + 1e-9
