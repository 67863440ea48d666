"""Queries over point clouds and camera paths."""

from __future__ import annotations


from pyspark.sql import functions as F

from planloom.functions import geometry as G
from planloom.operators import cloud
from planloom.plans.registry import query
from planloom.plans.views import ORIENTED, POINTS, TRAJECTORY, oriented, points, trajectory

FLOOR = f"""WITH {POINTS}, flat AS (SELECT cap, y FROM pts WHERE abs(ny) > 0.9),
ends AS (SELECT cap, min(y) AS lo, max(y) AS hi FROM flat GROUP BY cap HAVING count(*) >= 20 AND max(y) - min(y) >= 0.01),
bins AS (SELECT cap, lo, least(floor((y - lo) / 0.01), greatest(ceil((hi + 0.01 - lo) / 0.01) - 2, 0)) AS bin, count(*) AS n
  FROM flat JOIN ends USING (cap) GROUP BY ALL),
mid AS (SELECT cap, min(lo) + min(bin) * 0.01 + 0.01 / 2 AS centre FROM bins b
  WHERE n > 0.25 * (SELECT max(n) FROM bins m WHERE m.cap = b.cap) GROUP BY cap),
floors AS (SELECT cap, median(y) AS level, count(*) AS support FROM flat JOIN mid USING (cap) WHERE abs(y - centre) < 0.03 GROUP BY cap)"""


@query(FLOOR + " SELECT cap, round(level + 1e-9, 6) AS level, support FROM floors")
def floor_layer(spark, sf_dir):
    return cloud.floor_layer(points(spark, sf_dir)).select("cap", F.round(F.col("level") + 1e-9, 6).alias("level"), "support")


def _ceiling(least):
    return FLOOR + f""", high AS (SELECT cap, y FROM pts JOIN floors USING (cap) WHERE abs(ny) > 0.9 AND y > level + 1.9),
cends AS (SELECT cap, min(y) AS lo, max(y) AS hi FROM high GROUP BY cap HAVING count(*) >= {least}),
cbins AS (SELECT cap, lo, least(floor((y - lo) / 0.01), greatest(ceil((hi + 0.01 - lo) / 0.01) - 2, 0)) AS bin, count(*) AS n
  FROM high JOIN cends USING (cap) GROUP BY ALL),
top AS (SELECT cap, lo + bin * 0.01 + 0.01 / 2 AS centre, row_number() OVER (PARTITION BY cap ORDER BY n DESC, bin) AS k FROM cbins),
lev AS (SELECT cap, median(y) AS level FROM high JOIN top USING (cap) WHERE k = 1 AND abs(y - centre) < 0.03 GROUP BY cap)
SELECT floors.cap, round(lev.level + 1e-9, 6) AS level FROM floors LEFT JOIN lev USING (cap)"""


@query(_ceiling(500))
def ceiling_layer(spark, sf_dir):
    p = points(spark, sf_dir)
    return cloud.ceiling_layer(p, cloud.floor_layer(p), min_points=500).select("cap", F.round(F.col("level") + 1e-9, 6).alias("level"))


@query(_ceiling(1000000))
def ceiling_unseen(spark, sf_dir):
    p = points(spark, sf_dir)
    return cloud.ceiling_layer(p, cloud.floor_layer(p), min_points=1000000).select("cap", F.round(F.col("level") + 1e-9, 6).alias("level"))


WEIGHTS = ", ".join(f"({i - 8}, {w!r})" for i, w in enumerate(cloud.gaussian_weights(2.0)))
ANGLE = f"""WITH {ORIENTED}, k(shift, w) AS (VALUES {WEIGHTS}),
ang AS (SELECT cap, a - floor(a / (pi() / 2)) * (pi() / 2) AS a FROM (SELECT cap, atan2(nz, nx) AS a FROM ori WHERE abs(ny) < 0.15)),
able AS (SELECT cap FROM ang GROUP BY cap HAVING count(*) >= 2),
bins AS (SELECT cap, least(floor(a / (pi() / 2 / 360)), 359)::BIGINT AS bin, count(*) AS n FROM ang SEMI JOIN able USING (cap) GROUP BY ALL),
sm AS (SELECT cap, (bin + shift + 360) % 360 AS bin, round(sum(n * w), 9) AS s FROM bins, k GROUP BY ALL),
pk AS (SELECT cap, (bin + 0.5) * (pi() / 2 / 360) AS a0, row_number() OVER (PARTITION BY cap ORDER BY s DESC, bin) AS r FROM sm),
d0 AS (SELECT cap, a0, a - a0 + pi() / 4 AS t FROM ang JOIN pk USING (cap) WHERE r = 1),
d AS (SELECT cap, a0, t - floor(t / (pi() / 2)) * (pi() / 2) - pi() / 4 AS d FROM d0),
m AS (SELECT cap, a0 + avg(d) AS a FROM d WHERE abs(d) < radians(2) GROUP BY cap, a0)
SELECT cap, round(a - floor(a / (pi() / 2)) * (pi() / 2), 6) AS angle FROM m"""


@query(ANGLE)
def manhattan_angle(spark, sf_dir):
    return cloud.manhattan_angle(oriented(spark, sf_dir), min_points=2).select("cap", F.round("angle", 6).alias("angle"))


@query(f"""WITH {POINTS}, s AS (SELECT cap, floor(x / 0.5)::BIGINT AS vx, floor(y / 0.5)::BIGINT AS vy, floor(z / 0.5)::BIGINT AS vz, avg(x) AS x, avg(y) AS y, avg(z) AS z,
  sum(nx) AS a, sum(ny) AS b, sum(nz) AS c, count(*) AS n FROM pts GROUP BY ALL)
SELECT cap, vx, vy, vz, round(x + 1e-9, 6) AS x, round(y + 1e-9, 6) AS y, round(z + 1e-9, 6) AS z, round(a / (sqrt(a*a+b*b+c*c) + 1e-12), 6) AS nx,
  round(b / (sqrt(a*a+b*b+c*c) + 1e-12), 6) AS ny, round(c / (sqrt(a*a+b*b+c*c) + 1e-12), 6) AS nz, n FROM s""")
def voxel_downsample(spark, sf_dir):
    v = cloud.voxel_downsample(points(spark, sf_dir), 0.5)
    return v.select("cap", "vx", "vy", "vz", *[F.round(F.col(c) + 1e-9, 6).alias(c) for c in "xyz"], *[F.round(c, 6).alias(c) for c in ("nx", "ny", "nz")], "n")


@query(f"""WITH {POINTS} SELECT cap, floor(z / 0.5)::INTEGER AS r, floor(x / 0.5)::INTEGER AS c, count(*) AS n FROM pts GROUP BY ALL HAVING count(*) >= 3""")
def raster_count(spark, sf_dir):
    p = points(spark, sf_dir).withColumns({"u": F.col("x"), "v": F.col("z")})
    return cloud.raster_count(p, 0.5, 3)


@query(f"""WITH {POINTS}, q AS (SELECT cap, quantile_cont(x, 0.001) - 0.5 AS u0, quantile_cont(x, 0.999) + 0.5 AS u1,
  quantile_cont(z, 0.001) - 0.5 AS v0, quantile_cont(z, 0.999) + 0.5 AS v1 FROM pts GROUP BY cap)
SELECT cap, round(u0, 6) AS u0, round(v0, 6) AS v0, ceil((v1 - v0) / 0.02 - 1e-9)::INTEGER AS rows, ceil((u1 - u0) / 0.02 - 1e-9)::INTEGER AS cols FROM q""")
def plan_extent(spark, sf_dir):
    p = points(spark, sf_dir).withColumns({"u": F.col("x"), "v": F.col("z")})
    e = cloud.plan_extent(p, 0.02)
    return e.select("cap", F.round("u0", 6).alias("u0"), F.round("v0", 6).alias("v0"), "rows", "cols")


@query(f"""WITH {ORIENTED}, t AS (SELECT vec_id, x, z, cos(0.5) * x + sin(0.5) * z AS u, -sin(0.5) * x + cos(0.5) * z AS v FROM ori)
SELECT vec_id, round(u, 6) AS u, round(v, 6) AS v, floor((u + 1) / 0.02)::INTEGER AS c, floor((v + 1) / 0.02)::INTEGER AS r,
  round(cos(0.5) * u - sin(0.5) * v, 6) AS bx, round(sin(0.5) * u + cos(0.5) * v, 6) AS bz FROM t""")
def world_to_plan(spark, sf_dir):
    a = F.lit(0.5)
    u, v = G.to_plan(F.col("x"), F.col("z"), a)
    t = oriented(spark, sf_dir).select("vec_id", u.alias("u"), v.alias("v"))
    bx, bz = G.to_world(F.col("u"), F.col("v"), a)
    return t.select("vec_id", F.round("u", 6).alias("u"), F.round("v", 6).alias("v"), G.cell(F.col("u"), F.lit(-1.0), 0.02).alias("c"), G.cell(F.col("v"), F.lit(-1.0), 0.02).alias("r"), F.round(bx, 6).alias("bx"), F.round(bz, 6).alias("bz"))


BACK = """WITH px AS (SELECT vec_id, label, vec_id % 16 AS u, vec_id % 12 AS v, 1 + abs(embedding[7])::DOUBLE AS d, embedding[8]::DOUBLE AS qx, embedding[9]::DOUBLE AS qy,
  embedding[10]::DOUBLE AS qz, embedding[11]::DOUBLE AS qw FROM embeddings),
cam AS (SELECT vec_id, (u - 8.0) / 10 * d AS x, (v - 6.0) / 10 * d AS y, d AS z, qx / n AS a, qy / n AS b, qz / n AS c, qw / n AS w
  FROM (SELECT *, sqrt(qx*qx + qy*qy + qz*qz + qw*qw) AS n FROM px))
SELECT vec_id, round((1 - 2*(b*b + c*c))*x + 2*(a*b - c*w)*y + 2*(a*c + b*w)*z + 1, 6) AS wx,
  round(2*(a*b + c*w)*x + (1 - 2*(a*a + c*c))*y + 2*(b*c - a*w)*z + 2, 6) AS wy,
  round(2*(a*c - b*w)*x + 2*(b*c + a*w)*y + (1 - 2*(a*a + b*b))*z + 3, 6) AS wz FROM cam"""


@query(BACK)
def back_projection(spark, sf_dir):
    from planloom.plans.views import read

    e = F.col("embedding")
    px = read(spark, sf_dir, "embeddings").select("vec_id", (F.col("vec_id") % 16).alias("u"), (F.col("vec_id") % 12).alias("v"), (1 + F.abs(e[6]).cast("double")).alias("d"), *[e[7 + i].cast("double").alias(c) for i, c in enumerate(("qx", "qy", "qz", "qw"))])
    k = G.scaled_intrinsics(*[F.lit(x) for x in (1200.0, 1200.0, 960.0, 720.0, 1920.0, 1440.0, 16.0, 12.0)])
    p = G.back_project(F.col("u"), F.col("v"), F.col("d"), *k)
    world = G.apply_rotation(G.rotation(*[F.col(c) for c in ("qx", "qy", "qz", "qw")]), p)
    return px.select("vec_id", *[F.round(w + i + 1, 6).alias(f"w{c}") for i, (w, c) in enumerate(zip(world, "xyz"))])


FAN = f"""WITH {TRAJECTORY}, f AS (SELECT cap, (floor((atan2(v - 4.8, u - 1.0) + pi()) / (2 * pi()) * 180)::INTEGER % 180 + 180) % 180 AS az,
  sqrt((u - 1.0) * (u - 1.0) + (v - 4.8) * (v - 4.8)) AS d FROM traj),
fan AS (SELECT cap, az, max(d) AS far FROM f GROUP BY ALL HAVING max(d) > 0)"""


def _fan(spark, sf_dir):
    return cloud.fan_max(trajectory(spark, sf_dir), F.lit(1.0), F.lit(4.8), ("cap",))


@query(FAN + " SELECT cap, az, round(far, 6) AS far FROM fan")
def fan_max(spark, sf_dir):
    return _fan(spark, sf_dir).select("cap", "az", F.round("far", 6).alias("far"))


@query(FAN + " SELECT a.cap, a.az, round(a.far, 6) AS far, round(b.far, 6) AS far_next FROM fan a JOIN fan b ON a.cap = b.cap AND b.az = a.az + 1")
def fan_neighbours(spark, sf_dir):
    f = cloud.fan_neighbours(_fan(spark, sf_dir), ("cap",))
    return f.select("cap", "az", F.round("far", 6).alias("far"), F.round("far_next", 6).alias("far_next"))


@query(f"WITH {TRAJECTORY} SELECT cap % 7 AS cap, floor(v)::INTEGER AS r, floor(u)::INTEGER AS c, count(DISTINCT seq) AS n FROM traj GROUP BY ALL")
def free_space_count(spark, sf_dir):
    t = trajectory(spark, sf_dir)
    seen = t.select((F.col("cap") % 7).alias("cap"), "seq", G.cell(F.col("v"), F.lit(0.0), 1.0).alias("r"), G.cell(F.col("u"), F.lit(0.0), 1.0).alias("c"))
    return cloud.free_space_count(seen)


GRID = f"""WITH g AS (SELECT label AS cap, vec_id // 16 AS v, vec_id % 16 AS u, 2 + embedding[1]::DOUBLE / 50 AS z FROM embeddings),
p AS (SELECT v, u, (u - 8.0) / 10 * z AS x, (v - 6.0) / 10 * z AS y, z FROM g),
f AS (SELECT c.v, c.u, c.x, c.y, c.z, r.x - l.x AS ax, r.y - l.y AS ay, r.z - l.z AS az, d.x - t.x AS bx, d.y - t.y AS by_, d.z - t.z AS bz, l.z AS zl, r.z AS zr, t.z AS zu, d.z AS zd FROM p c
  JOIN p l ON l.v = c.v AND l.u = c.u - 1 JOIN p r ON r.v = c.v AND r.u = c.u + 1 JOIN p t ON t.u = c.u AND t.v = c.v - 1 JOIN p d ON d.u = c.u AND d.v = c.v + 1),
k AS (SELECT *, ay * bz - az * by_ AS m0, az * bx - ax * bz AS m1, ax * by_ - ay * bx AS m2 FROM f),
n AS (SELECT *, CASE WHEN m0 * x + m1 * y + m2 * z > 0 THEN -1.0 ELSE 1.0 END / (sqrt(m0*m0 + m1*m1 + m2*m2) + 1e-12) AS s FROM k)
SELECT v, u, round(m0 * s, 6) AS n0, round(m1 * s, 6) AS n1, round(m2 * s, 6) AS n2 FROM n
WHERE z > 0.1 AND z < 4 AND least(zl, zr, zu, zd) > 0 AND greatest(abs(zl - z), abs(zr - z), abs(zu - z), abs(zd - z)) < 0.05 * z + 0.02 AND (u - 1) % 2 = 0 AND (v - 1) % 2 = 0"""


@query(GRID)
def depth_normals(spark, sf_dir):
    from planloom.plans.views import read

    g = read(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 16).alias("v"), (F.col("vec_id") % 16).alias("u"), (2 + F.col("embedding")[0].cast("double") / 50).alias("z"))
    p = G.back_project(F.col("u"), F.col("v"), F.col("z"), *[F.lit(x) for x in (10.0, 10.0, 8.0, 6.0)])
    px = g.select(F.lit(0).alias("frame"), "u", "v", *[e.alias(c) for e, c in zip(p, "xyz")])
    ok = cloud.valid_points(cloud.normals_from_grid(px, ("frame",)), stride=2)
    return ok.select("v", "u", *[F.round(f"n{i}", 6).alias(f"n{i}") for i in range(3)])


@query(f"WITH {POINTS} SELECT cap, count(*) FILTER (WHERE abs(ny) > 0.9) AS horizontal, count(*) FILTER (WHERE abs(ny) < 0.15) AS vertical, count(*) FILTER (WHERE y > 0.2 AND y < 2.0) AS wall_band FROM pts GROUP BY cap")
def surface_flags(spark, sf_dir):
    p = points(spark, sf_dir)
    return p.groupBy("cap").agg(F.count_if(F.abs("ny") > 0.9).alias("horizontal"), F.count_if(F.abs("ny") < 0.15).alias("vertical"), F.count_if((F.col("y") > 0.2) & (F.col("y") < 2.0)).alias("wall_band"))


