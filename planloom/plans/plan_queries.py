"""Queries over plans: rings, overlaps, measurements, checks and accuracy."""

from __future__ import annotations

from pyspark.sql import functions as F

from planloom.functions import geometry as G
from planloom.operators import evaluate as E
from planloom.operators import plan as P
from planloom.plans.registry import query
from planloom.plans.views import RING, ROOMS, TRAJECTORY, ring, rooms, trajectory

BASE = f"""WITH {ROOMS}, {RING},
edges AS (SELECT a.cap, a.room, a.i, a.u, a.v, b.u AS nu, b.v AS nv, sqrt((b.u - a.u) ** 2 + (b.v - a.v) ** 2) AS length,
  CASE WHEN abs(b.u - a.u) >= abs(b.v - a.v) THEN 0 ELSE 1 END AS axis FROM ring a JOIN ring b ON a.cap = b.cap AND a.room = b.room AND b.i = (a.i + 1) % 4),
metrics AS (SELECT cap, room, count(*) AS corners, sum(u * nv - nu * v) / 2 AS signed_area, abs(sum(u * nv - nu * v) / 2) AS area, sum(length) AS perimeter FROM edges GROUP BY ALL)"""
PLAN = BASE + """, w0 AS (SELECT *, (room + i) % 3 <> 0 AS snapped, 0.01 * (1 + room % 4) AS spread, 50 + room % 200 AS n_points FROM edges),
w1 AS (SELECT *, CASE WHEN snapped THEN sqrt((spread / sqrt(greatest(n_points, 1))) ** 2 + 0.02 ** 2) ELSE 0.05 END AS sigma FROM w0),
walls AS (SELECT a.*, sqrt(p.sigma ** 2 + n.sigma ** 2 + (0.01 * a.length) ** 2) AS length_sigma FROM w1 a
  JOIN w1 p ON p.cap = a.cap AND p.room = a.room AND p.i = (a.i + 3) % 4 JOIN w1 n ON n.cap = a.cap AND n.room = a.room AND n.i = (a.i + 1) % 4),
r0 AS (SELECT cap, room, sum((length * sigma) ** 2) AS a2, sum(4 * sigma ** 2) AS p2 FROM w1 GROUP BY ALL),
proom AS (SELECT m.cap, m.room, area, sqrt(a2 + (2 * 0.01 * area) ** 2) AS area_sigma, perimeter, sqrt(p2 + (0.01 * perimeter) ** 2) AS perimeter_sigma,
  CASE WHEN m.room % 6 <> 0 THEN 2.4 + (m.room % 5) / 10 END AS height, CASE WHEN m.room % 6 <> 0 THEN sqrt((0.01 * (1 + m.room % 3) / sqrt(greatest(m.room % 700, 1))) ** 2 + (0.012 / sqrt(greatest(m.room % 300, 1))) ** 2 + 0.02 ** 2 + (0.01 * (2.4 + (m.room % 5) / 10)) ** 2) END AS height_sigma FROM metrics m JOIN r0 USING (cap, room)),
foot AS (SELECT cap, sum(area) AS value, sum(area_sigma) AS sigma FROM proom GROUP BY cap),
opens AS (SELECT *, top - bottom AS height, sqrt(before ** 2 + jamb ** 2) AS offset_sigma, sqrt(2 * jamb ** 2 + (0.01 * width) ** 2) AS width_sigma, sqrt(0.03 ** 2 + (0.01 * top) ** 2) AS height_sigma,
  CASE WHEN kind = 'window' THEN 0.02::DOUBLE END AS bottom_sigma FROM (SELECT r.cap, r.room, 0 AS opening, (r.room % 4)::INTEGER AS wall, 0.3::DOUBLE AS "offset", 0.5 + (r.room % 10) / 20 AS width,
   CASE WHEN r.room % 2 = 0 THEN 'window' ELSE 'door' END AS kind, CASE WHEN r.room % 2 = 0 THEN 0.9 ELSE 0.0 END::DOUBLE AS bottom, 2.0::DOUBLE AS top,
   CASE WHEN r.room % 37 > 20 THEN 0.008::DOUBLE ELSE 0.03::DOUBLE END AS jamb, p.sigma AS before, CASE WHEN r.room % 3 = 0 THEN r.room + 7 END AS connects_to
   FROM rooms r JOIN w1 p ON p.cap = r.cap AND p.room = r.room AND p.i = (r.room % 4 + 3) % 4)),
dims AS (SELECT cap, 'footprint_area' AS dimension, value, sigma FROM foot
  UNION ALL SELECT cap, 'room-' || room || '/floor_area', area, area_sigma FROM proom
  UNION ALL SELECT cap, 'room-' || room || '/ceiling_height', height, height_sigma FROM proom WHERE height IS NOT NULL
  UNION ALL SELECT cap, 'room-' || room || '/perimeter', perimeter, perimeter_sigma FROM proom
  UNION ALL SELECT cap, 'room-' || room || '/wall-' || i || '/length', length, length_sigma FROM walls
  UNION ALL SELECT cap, 'room-' || room || '/opening-' || opening || '/width', width, width_sigma FROM opens
  UNION ALL SELECT cap, 'room-' || room || '/opening-' || opening || '/height', height, height_sigma FROM opens),
truth AS (SELECT cap, CASE cap % 3 WHEN 0 THEN 'photos' WHEN 1 THEN 'video' ELSE 'lidar' END AS tier, cap % 2 = 0 AS exhaustive, 0.02::DOUBLE AS lidar_tolerance,
  'room-' || room || d AS dimension, t AS target FROM (
   SELECT cap, room, '/wall-1/length' AS d, h * (1 + (room % 3 - 1) * 0.04) AS t FROM rooms WHERE room % 2 = 0
   UNION ALL SELECT cap, room, '/opening-0/width', 0.5 + (room % 10) / 20 + (room % 7) / 200 FROM rooms WHERE room % 4 = 0
   UNION ALL SELECT cap, room, '/opening-1/width', 0.9 FROM rooms WHERE room % 40 = 0
   UNION ALL SELECT cap, room, '/ceiling_height', 2.5 FROM rooms WHERE room % 5 = 0)),
evals AS (SELECT t.cap, t.dimension, target, value AS prediction, abs(value - target) AS error, sigma,
  CASE WHEN value IS NULL THEN NULL WHEN t.dimension LIKE '%/wall-%' THEN CASE tier WHEN 'photos' THEN 0.08 * target WHEN 'video' THEN 0.03 * target ELSE lidar_tolerance END
   WHEN t.dimension LIKE '%/opening-%/width' THEN 0.02 WHEN t.dimension LIKE '%/ceiling_height' THEN 0.015 END AS tolerance
  FROM truth t LEFT JOIN dims d ON d.cap = t.cap AND d.dimension = t.dimension),
tkeys AS (SELECT DISTINCT cap, dimension FROM truth WHERE dimension LIKE '%/opening-%/width'),
dkeys AS (SELECT DISTINCT cap, dimension FROM dims WHERE dimension LIKE '%/opening-%/width')"""


def plan_tables(spark, sf_dir):
    """(ring, walls, rooms, openings) of the stand-in plans."""
    r = rooms(spark, sf_dir)
    rg = ring(r)
    k = F.col("room")
    m = P.ring_metrics(rg)
    w = P.edges(rg).withColumns({"snapped": (k + F.col("i")) % 3 != 0, "spread": 0.01 * (1 + k % 4), "n_points": 50 + k % 200}).join(m.select("cap", "room", "area"), ["cap", "room"])
    walls, totals = P.propagated(P.wall_sigma(w))
    seen = k % 6 != 0
    totals = P.ceiling_sigma(totals.withColumns({"height": F.when(seen, 2.4 + (k % 5) / 10), "ceiling_spread": 0.01 * (1 + k % 3), "ceiling_points": k % 700, "floor_spread": F.lit(0.012), "floor_points": k % 300}))
    window = k % 2 == 0
    openings = r.select("cap", "room", F.lit(0).alias("opening"), (k % 4).cast("int").alias("wall"), F.lit(0.3).alias("offset"), (0.5 + (k % 10) / 20).alias("width"), F.when(window, "window").otherwise("door").alias("kind"), F.when(window, 0.9).otherwise(0.0).alias("bottom"), F.lit(2.0).alias("top"), (k % 37).alias("jamb_points"), F.when(k % 3 == 0, k + 7).alias("connects_to"))
    openings = P.opening_sigmas(openings, walls)
    return rg, walls, totals, openings


def dimensions(spark, sf_dir):
    _, walls, totals, openings = plan_tables(spark, sf_dir)
    return E.flatten(P.footprint(totals), totals, walls, openings)


def truth_table(spark, sf_dir):
    r = rooms(spark, sf_dir)
    k = F.col("room")
    rows = [("/wall-1/length", F.col("h") * (1 + (k % 3 - 1) * 0.04), k % 2 == 0), ("/opening-0/width", 0.5 + (k % 10) / 20 + (k % 7) / 200, k % 4 == 0), ("/opening-1/width", F.lit(0.9), k % 40 == 0), ("/ceiling_height", F.lit(2.5), k % 5 == 0)]
    tier = F.when(F.col("cap") % 3 == 0, "photos").when(F.col("cap") % 3 == 1, "video").otherwise("lidar")
    out = None
    for d, t, keep in rows:
        part = r.where(keep).select("cap", tier.alias("tier"), F.lit("laser").alias("source"), (F.col("cap") % 2 == 0).alias("exhaustive"), F.lit(0.02).alias("lidar_tolerance"), F.concat(F.lit("room-"), k.cast("string"), F.lit(d)).alias("dimension"), t.alias("target"))
        out = part if out is None else out.unionByName(part)
    return E.checked_truth(out)


def _r(*names):
    return [F.round(F.col(n) + 1e-9, 6).alias(n) for n in names]


@query(BASE + " SELECT cap, room, corners, signed_area, area, perimeter FROM metrics")
def ring_metrics(spark, sf_dir):
    return P.ring_metrics(ring(rooms(spark, sf_dir)))


@query(BASE + " SELECT cap, room, i, axis, sign(CASE WHEN axis = 0 THEN nu - u ELSE v - nv END)::DOUBLE AS inward FROM edges")
def inward_sign(spark, sf_dir):
    return P.inward(ring(rooms(spark, sf_dir)))


@query(f"WITH {ROOMS}, {RING} SELECT cap, room, i, u, v FROM ring")
def clockwise_reversed(spark, sf_dir):
    turned = ring(rooms(spark, sf_dir)).withColumn("i", F.when(F.col("room") % 2 == 0, 3 - F.col("i")).otherwise(F.col("i")))
    return P.counter_clockwise(turned)


@query(f"WITH {ROOMS}, {RING} SELECT cap, room, i, u, v FROM ring")
def corners_of_walls(spark, sf_dir):
    e = P.edges(ring(rooms(spark, sf_dir)))
    return P.corners_of_walls(e.select("cap", "room", "i", "axis", F.when(F.col("axis") == 0, F.col("v")).otherwise(F.col("u")).alias("coord")))


OVERLAP = f"""WITH {ROOMS} SELECT a.cap, a.room AS room_a, b.room AS room_b,
  (least(a.x0 + a.w, b.x0 + b.w) - greatest(a.x0, b.x0)) * (least(a.y0 + a.h, b.y0 + b.h) - greatest(a.y0, b.y0)) AS area
FROM rooms a JOIN rooms b ON a.cap = b.cap AND a.room < b.room
WHERE least(a.x0 + a.w, b.x0 + b.w) > greatest(a.x0, b.x0) AND least(a.y0 + a.h, b.y0 + b.h) > greatest(a.y0, b.y0)"""


@query(OVERLAP)
def overlap_area(spark, sf_dir):
    return P.overlaps(ring(rooms(spark, sf_dir)))


@query(f"WITH {ROOMS}, {TRAJECTORY}, pt AS (SELECT cap // 4 AS cap, event_id, u * 10 AS u, v FROM traj) SELECT pt.cap, event_id, room FROM pt JOIN rooms USING (cap) WHERE u >= x0 AND u <= x0 + w AND v >= y0 AND v <= y0 + h")
def points_in_rooms(spark, sf_dir):
    p = trajectory(spark, sf_dir).select(F.floor(F.col("cap") / 4).alias("cap"), "event_id", (F.col("u") * 10).alias("u"), "v")
    return P.contains(ring(rooms(spark, sf_dir)), p).select("cap", "event_id", "room")


@query(PLAN + " SELECT cap, room, i, round(length + 1e-9, 6) AS length, round(sigma + 1e-9, 6) AS sigma, round(length_sigma + 1e-9, 6) AS length_sigma FROM walls")
def propagated_sigma(spark, sf_dir):
    return plan_tables(spark, sf_dir)[1].select("cap", "room", "i", *_r("length", "sigma", "length_sigma"))


@query(PLAN + " SELECT cap, room, round(area_sigma + 1e-9, 6) AS area_sigma, round(perimeter_sigma + 1e-9, 6) AS perimeter_sigma FROM proom")
def room_sigma(spark, sf_dir):
    return plan_tables(spark, sf_dir)[2].select("cap", "room", *_r("area_sigma", "perimeter_sigma"))


@query(PLAN + " SELECT cap, round(value + 1e-9, 6) AS value, round(sigma + 1e-9, 6) AS sigma FROM foot")
def footprint(spark, sf_dir):
    return P.footprint(plan_tables(spark, sf_dir)[2]).select("cap", *_r("value", "sigma"))


@query(PLAN + " SELECT cap, dimension, round(greatest(0, value - 1.96 * sigma) + 1e-9, 6) AS low, round(value + 1.96 * sigma + 1e-9, 6) AS high FROM dims")
def ci95(spark, sf_dir):
    low, high = G.interval(F.col("value"), G.checked_sigma(F.col("value"), F.col("sigma")))
    return dimensions(spark, sf_dir).select("cap", "dimension", low.alias("low"), high.alias("high")).select("cap", "dimension", *_r("low", "high"))


PRIOR = PLAN + """, p AS (SELECT cap, room, perimeter, area, height, CASE WHEN cap % 2 = 0 THEN 0.18 ELSE 0.12 END AS rel FROM proom)
SELECT cap, room, round(rel * perimeter + 1e-9, 6) AS perimeter_sigma, round(2 * rel * area + 1e-9, 6) AS area_sigma,
  CASE WHEN height IS NOT NULL THEN round(greatest(0.2, rel * height) + 1e-9, 6) END AS height_sigma FROM p"""


@query(PRIOR)
def prior_sigma(spark, sf_dir):
    r = plan_tables(spark, sf_dir)[2].withColumn("tier", F.when(F.col("cap") % 2 == 0, "photos").otherwise("video"))
    h = F.when(F.col("height").isNotNull(), G.prior_sigma(F.col("height"), F.col("tier"), "height"))
    return r.select("cap", "room", G.prior_sigma(F.col("perimeter"), F.col("tier"), "perimeter").alias("perimeter_sigma"), G.prior_sigma(F.col("area"), F.col("tier"), "area").alias("area_sigma"), h.alias("height_sigma")).select("cap", "room", *_r("perimeter_sigma", "area_sigma", "height_sigma"))


@query(PLAN + """ SELECT cap, room, i, round(greatest(0.12, CASE WHEN cap % 2 = 0 THEN 0.18 ELSE 0.12 END * length) + 1e-9, 6) AS envelope, round(greatest(0.15, 0.12 * length) + 1e-9, 6) AS segmented FROM walls""")
def prior_wall_sigma(spark, sf_dir):
    w = plan_tables(spark, sf_dir)[1]
    tier = F.when(F.col("cap") % 2 == 0, "photos").otherwise("video")
    return w.select("cap", "room", "i", G.prior_sigma(F.col("length"), tier, "length").alias("envelope"), G.prior_sigma(F.col("length"), F.lit("video"), "length", "segmented").alias("segmented")).select("cap", "room", "i", *_r("envelope", "segmented"))


@query(PLAN + """ SELECT cap, room, opening, kind, round(offset_sigma + 1e-9, 6) AS offset_sigma, round(width_sigma + 1e-9, 6) AS width_sigma, round(height_sigma + 1e-9, 6) AS height_sigma, bottom_sigma FROM opens""")
def opening_sigma(spark, sf_dir):
    return plan_tables(spark, sf_dir)[3].select("cap", "room", "opening", "kind", *_r("offset_sigma", "width_sigma", "height_sigma"), "bottom_sigma")


@query(PLAN + " SELECT cap, room, round(height_sigma + 1e-9, 6) AS height_sigma FROM proom")
def ceiling_sigma(spark, sf_dir):
    return plan_tables(spark, sf_dir)[2].select("cap", "room", *_r("height_sigma"))


SURFACES = PLAN + """ SELECT w.cap, 'room-' || w.room || '/wall-' || i AS surface_id, 'wall' AS kind, round(length * height + 1e-9, 6) AS value,
  round(sqrt((length_sigma * height) ** 2 + (height_sigma * length) ** 2) + 1e-9, 6) AS sigma FROM walls w JOIN proom USING (cap, room)
UNION ALL SELECT cap, 'room-' || room || '/floor', 'floor', round(area + 1e-9, 6), round(area_sigma + 1e-9, 6) FROM proom
UNION ALL SELECT cap, 'room-' || room || '/ceiling', 'ceiling', CASE WHEN height IS NOT NULL THEN round(area + 1e-9, 6) END, CASE WHEN height IS NOT NULL THEN round(area_sigma + 1e-9, 6) END FROM proom"""


@query(SURFACES)
def surfaces_rollup(spark, sf_dir):
    _, walls, totals, _ = plan_tables(spark, sf_dir)
    return P.surfaces(walls, totals).select("cap", "surface_id", "kind", *_r("value", "sigma"))


@query(PLAN + " SELECT cap, dimension, round(value + 1e-9, 6) AS value, round(sigma + 1e-9, 6) AS sigma FROM dims")
def flatten_plan(spark, sf_dir):
    return dimensions(spark, sf_dir).select("cap", "dimension", *_r("value", "sigma"))


@query(PLAN + """ SELECT cap, dimension, round(target + 1e-9, 6) AS target, round(prediction + 1e-9, 6) AS prediction, round(error + 1e-9, 6) AS error, round(error / target + 1e-9, 6) AS relative,
  CASE WHEN prediction IS NOT NULL THEN greatest(0, prediction - 1.96 * sigma) <= target AND target <= prediction + 1.96 * sigma END AS inside, round(tolerance + 1e-9, 6) AS tolerance,
  error <= tolerance AS passes, CASE WHEN prediction IS NULL THEN 'missed' ELSE 'matched' END AS status FROM evals""")
def evaluate_rows(spark, sf_dir):
    e = E.evaluate_rows(dimensions(spark, sf_dir), truth_table(spark, sf_dir))
    return e.select("cap", "dimension", *_r("target", "prediction", "error", "relative"), "inside", *_r("tolerance"), "passes", "status")


@query(PLAN + """ SELECT cap, round(avg(CASE WHEN prediction IS NOT NULL THEN (greatest(0, prediction - 1.96 * sigma) <= target AND target <= prediction + 1.96 * sigma)::INTEGER END) + 1e-9, 6) AS coverage,
  count(prediction) AS n FROM evals GROUP BY cap""")
def interval_coverage(spark, sf_dir):
    return E.interval_coverage(E.evaluate_rows(dimensions(spark, sf_dir), truth_table(spark, sf_dir))).select("cap", *_r("coverage"), "n")


@query(PLAN + " SELECT cap, dimension FROM dkeys WHERE cap IN (SELECT cap FROM truth) EXCEPT SELECT cap, dimension FROM tkeys")
def phantom_openings(spark, sf_dir):
    return E.phantoms(dimensions(spark, sf_dir), truth_table(spark, sf_dir))


@query(PLAN + " SELECT cap, dimension FROM tkeys EXCEPT SELECT cap, dimension FROM dkeys")
def missed_openings(spark, sf_dir):
    return E.misses(dimensions(spark, sf_dir), truth_table(spark, sf_dir))


@query(PLAN + """, ph AS (SELECT cap, count(*) AS phantoms FROM (SELECT cap, dimension FROM dkeys EXCEPT SELECT cap, dimension FROM tkeys) GROUP BY cap),
ok AS (SELECT e.cap, count(*) FILTER (WHERE error <= tolerance) AS successes, count(*) AS truths FROM evals e SEMI JOIN tkeys k ON k.cap = e.cap AND k.dimension = e.dimension GROUP BY e.cap),
g AS (SELECT t.cap, ex, coalesce(successes, 0) AS successes, coalesce(truths, 0) AS truths, coalesce(phantoms, 0) AS phantoms
  FROM (SELECT cap, max(exhaustive) AS ex FROM truth GROUP BY cap) t LEFT JOIN ok ON ok.cap = t.cap LEFT JOIN ph ON ph.cap = t.cap)
SELECT cap, successes, truths, phantoms, CASE WHEN ex AND truths + phantoms > 0 THEN round(successes / (truths + phantoms) + 1e-9, 6) END AS fraction,
  CASE WHEN ex AND truths + phantoms > 0 THEN successes / (truths + phantoms) >= 0.85 END AS passes FROM g""")
def opening_gate(spark, sf_dir):
    # No other dimension counts, and each would be one more pass over all rooms, walls and sigmas.
    d, t = E.opening_dimensions(plan_tables(spark, sf_dir)[3], "width"), truth_table(spark, sf_dir)
    return E.opening_gate(E.evaluate_rows(d, E.opening_widths(t)), d, t).select("cap", "successes", "truths", "phantoms", *_r("fraction"), "passes")


CHECKS = PLAN + """, cw AS (SELECT cap, room, i, u AS su, v AS sv, nu + CASE WHEN room % 23 = 0 THEN 0.01 ELSE 0 END AS eu, nv AS ev, length + CASE WHEN room % 11 = 0 THEN 0.01 ELSE 0 END AS length, u, v, nu, nv FROM walls),
errs AS (SELECT cap, room, 'area' AS rule, NULL::INTEGER AS item FROM metrics WHERE room % 13 = 0
  UNION ALL SELECT cap, room, 'wall_length', i FROM cw WHERE abs(sqrt((eu - su) ** 2 + (ev - sv) ** 2) - length) > 0.002
  UNION ALL SELECT cap, room, 'wall_ends', i FROM cw WHERE sqrt((eu - nu) ** 2 + (ev - nv) ** 2) > 0.002
  UNION ALL SELECT o.cap, o.room, 'opening_range', opening FROM opens o JOIN cw ON cw.cap = o.cap AND cw.room = o.room AND cw.i = o.wall WHERE o."offset" + o.width > cw.length + 0.025
  UNION ALL SELECT cap, room, 'opening_target', opening FROM opens o WHERE connects_to IS NOT NULL AND NOT EXISTS (SELECT 1 FROM rooms r WHERE r.cap = o.cap AND r.room = o.connects_to))"""


def _checked(spark, sf_dir):
    rg, walls, totals, openings = plan_tables(spark, sf_dir)
    k = F.col("room")
    said = walls.select("cap", "room", "i", F.col("u").alias("su"), F.col("v").alias("sv"), (F.col("nu") + F.when(k % 23 == 0, 0.01).otherwise(0.0)).alias("eu"), F.col("nv").alias("ev"), (F.col("length") + F.when(k % 11 == 0, 0.01).otherwise(0.0)).alias("length"))
    rooms_said = totals.select("cap", "room", (F.col("area") + F.when(k % 13 == 0, 0.02).otherwise(0.0)).alias("area_value"))
    return rg, rooms_said, E.geometry_errors(rg, rooms_said, said, openings)


@query(CHECKS + " SELECT * FROM errs")
def geometry_checks(spark, sf_dir):
    return _checked(spark, sf_dir)[2]


@query(CHECKS + f""", ov AS (SELECT a.cap FROM rooms a JOIN rooms b ON a.cap = b.cap AND a.room < b.room WHERE least(a.x0 + a.w, b.x0 + b.w) > greatest(a.x0, b.x0) AND least(a.y0 + a.h, b.y0 + b.h) > greatest(a.y0, b.y0)),
c AS (SELECT cap, (SELECT count(*) FROM errs e WHERE e.cap = m.cap) AS n_errors, (SELECT count(*) FROM ov WHERE ov.cap = m.cap) AS n_overlaps FROM (SELECT DISTINCT cap FROM rooms) m)
SELECT cap, n_errors, n_overlaps, n_errors = 0 AND n_overlaps = 0 AS valid FROM c""")
def plan_validity(spark, sf_dir):
    rg, said, errors = _checked(spark, sf_dir)
    return E.validity(said, errors, P.overlaps(rg))


DOORS = f"""WITH {ROOMS}, lab AS (SELECT DISTINCT ON (cap, r, c) cap, r, c, room AS label FROM (SELECT cap, y::INTEGER AS r, x::INTEGER AS c, room
   FROM rooms, generate_series(0, 22) AS gx(x), generate_series(0, 20) AS gy(y) WHERE x >= x0 AND x < x0 + w AND y >= y0 AND y < y0 + h) ORDER BY cap, r, c, room),
d AS (SELECT cap, room, 0 AS opening, x0 + w AS mu, y0 + 0.5 AS mv FROM rooms),
p AS (SELECT cap, room, opening, depth, floor(mv)::INTEGER AS r, floor(mu + depth)::INTEGER AS c FROM d, (VALUES (0.3), (0.5), (0.8)) AS t(depth)),
h AS (SELECT p.cap, p.room, opening, label, row_number() OVER (PARTITION BY p.cap, p.room, opening ORDER BY depth) AS k FROM p JOIN lab USING (cap, r, c) WHERE label > 0 AND label <> p.room),
con AS (SELECT cap, room, opening, label AS connects_to FROM h WHERE k = 1)"""


def _connected(spark, sf_dir):
    r = rooms(spark, sf_dir)
    cells = r.select("cap", "room", F.explode(F.sequence(F.col("x0").cast("int"), (F.col("x0") + F.col("w")).cast("int") - 1)).alias("c"), "y0", "h").select("cap", "room", "c", F.explode(F.sequence(F.col("y0").cast("int"), (F.col("y0") + F.col("h")).cast("int") - 1)).alias("r"))
    labels = cells.groupBy("cap", "r", "c").agg(F.min("room").alias("label"))
    doors = r.select("cap", "room", F.lit(0).alias("opening"), F.lit("door").alias("kind"), (F.col("x0") + F.col("w")).alias("mu"), (F.col("y0") + 0.5).alias("mv"), F.lit(1).alias("axis"), F.lit(1.0).alias("outward"))
    return P.connections(doors, labels, 1.0)


@query(DOORS + " SELECT * FROM con")
def door_connections(spark, sf_dir):
    return _connected(spark, sf_dir)


@query(DOORS + " SELECT DISTINCT cap, least(room, connects_to) AS room_a, greatest(room, connects_to) AS room_b FROM con")
def room_adjacency(spark, sf_dir):
    return P.adjacency(_connected(spark, sf_dir))


def _documents(spark, sf_dir):
    from planloom.sources import sinks

    rg, walls, totals, openings = plan_tables(spark, sf_dir)
    return sinks.plan_documents(rg, walls, totals, openings, P.footprint(totals))


@query(PLAN + " SELECT foot.cap, (SELECT count(*)::INTEGER FROM rooms r WHERE r.cap = foot.cap) AS rooms, (SELECT count(*)::INTEGER FROM opens o WHERE o.cap = foot.cap) AS openings, round(value, 4) AS area FROM foot")
def plan_roll_up(spark, sf_dir):
    from planloom.sources import sinks

    return sinks.roll_up(_documents(spark, sf_dir))


@query()
def plan_pages(spark, sf_dir):
    from planloom.sources import sinks

    return sinks.page(_documents(spark, sf_dir))


@query(f"""WITH {ROOMS}, {RING}, s AS (SELECT cap, room, string_agg(printf('%.1f,%.1f', u * 40, v * 40), ' ' ORDER BY i) AS points FROM ring GROUP BY ALL)
SELECT cap, '<svg xmlns="http://www.w3.org/2000/svg">' || string_agg('<polygon id="room-' || room || '" points="' || points || '" fill="none" stroke="black"/>', '' ORDER BY room) || '</svg>' AS svg FROM s GROUP BY cap""")
def plan_drawing(spark, sf_dir):
    from planloom.sources import sinks

    return sinks.svg(ring(rooms(spark, sf_dir)))
