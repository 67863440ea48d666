"""Queries that join walls with the cloud, match descriptors and place damage."""

from __future__ import annotations

from pyspark.sql import functions as F

from planloom.operators import match, walls
from planloom.plans.registry import query
from planloom.plans.views import POINTS, ROOMS, points, read, rooms

WALLS = POINTS + """, wl AS (SELECT cap, wall, axis, coord, 0.0::DOUBLE AS lo, CASE WHEN axis = 0 THEN 10.0 ELSE 5.0 END::DOUBLE AS hi, CASE wall WHEN 0 THEN 1.0 WHEN 1 THEN -1.0 WHEN 2 THEN -1.0 ELSE 1.0 END::DOUBLE AS inward
  FROM (SELECT DISTINCT cap FROM pts), (VALUES (0, 0, 0.5::DOUBLE), (1, 1, 9.5::DOUBLE), (2, 0, 4.5::DOUBLE), (3, 1, 0.5::DOUBLE)) AS t(wall, axis, coord)),
band AS (SELECT p.cap, wall, axis, coord, lo, hi, inward, y AS h, CASE WHEN axis = 0 THEN x ELSE z END AS along, CASE WHEN axis = 0 THEN z ELSE x END AS across
  FROM pts p JOIN wl ON wl.cap = p.cap AND abs(CASE WHEN axis = 0 THEN z ELSE x END - coord) < 0.35
  AND CASE WHEN axis = 0 THEN x ELSE z END > lo + 0.05 AND CASE WHEN axis = 0 THEN x ELSE z END < hi - 0.05)"""


def wall_table(spark, sf_dir):
    caps = points(spark, sf_dir).select("cap").distinct()
    rows = F.array(*[F.struct(F.lit(w).alias("wall"), F.lit(a).alias("axis"), F.lit(c).alias("coord"), F.lit(s).alias("inward")) for w, a, c, s in ((0, 0, 0.5, 1.0), (1, 1, 9.5, -1.0), (2, 0, 4.5, -1.0), (3, 1, 0.5, 1.0))])
    w = caps.select("cap", F.explode(rows).alias("t")).select("cap", "t.*")
    return w.withColumns({"lo": F.lit(0.0), "hi": F.when(F.col("axis") == 0, 10.0).otherwise(5.0)})


def band(spark, sf_dir):
    p = points(spark, sf_dir).select("cap", F.col("x").alias("u"), F.col("z").alias("v"), F.col("y").alias("h"))
    return walls.band_join(p, wall_table(spark, sf_dir), 0.35, 0.05)


@query(f"WITH {WALLS} SELECT cap, wall, count(*) AS n, round(sum(along) + 1e-9, 4) AS along, round(sum(across) + 1e-9, 4) AS across FROM band GROUP BY ALL")
def wall_band_join(spark, sf_dir):
    return band(spark, sf_dir).groupBy("cap", "wall").agg(F.count("*").alias("n"), F.round(F.sum("along") + 1e-9, 4).alias("along"), F.round(F.sum("across") + 1e-9, 4).alias("across"))


SNAP = WALLS + """, sb AS (SELECT cap, wall, coord, inward, floor((across - (coord - 0.35)) / 0.05)::BIGINT AS bin, count(*) AS n FROM band SEMI JOIN (SELECT cap, wall FROM band GROUP BY ALL HAVING count(*) >= 50) able USING (cap, wall) GROUP BY ALL),
sm AS (SELECT cap, wall, coord, inward, bin + d AS bin, sum(n * w) AS strength FROM sb, (VALUES (-1, 1), (0, 2), (1, 1)) AS k(d, w) WHERE bin + d BETWEEN 0 AND 13 GROUP BY ALL),
dense AS (SELECT *, coord - 0.35 + (bin + 0.5) * 0.05 AS centre FROM sm s WHERE strength >= 0.4 * (SELECT max(strength) FROM sm m WHERE m.cap = s.cap AND m.wall = s.wall)),
ranked AS (SELECT cap, wall, bin, centre, strength, row_number() OVER (PARTITION BY cap, wall ORDER BY centre * inward) AS ord FROM dense)"""


def _layers(spark, sf_dir):
    return walls.snapped_layers(band(spark, sf_dir), width=0.05)


@query(f"WITH {SNAP} SELECT cap, wall, bin, round(centre + 1e-9, 6) AS centre, strength::BIGINT AS strength, ord FROM ranked")
def wall_snap_peak(spark, sf_dir):
    return _layers(spark, sf_dir).select("cap", "wall", "bin", F.round(F.col("centre") + 1e-9, 6).alias("centre"), F.col("strength").cast("long").alias("strength"), F.col("order").alias("ord"))


@query(f"""WITH {SNAP}, pk AS (SELECT cap, wall, centre + 0.0101 AS centre FROM ranked WHERE ord = 1), near AS (SELECT b.cap, b.wall, along, across, hi - lo AS length FROM band b JOIN pk USING (cap, wall) WHERE abs(across - centre) < 0.03),
mid AS (SELECT cap, wall, median(across) AS coord, count(*) AS n_points, least(1.0, count(DISTINCT floor(along / 0.05)) * 0.05 / any_value(length)) AS support FROM near GROUP BY ALL)
SELECT cap, wall, round(coord + 1e-9, 6) AS coord, round(support + 1e-9, 6) AS support, (SELECT round(1.4826 * median(abs(n.across - mid.coord)) + 1e-9, 6) FROM near n WHERE n.cap = mid.cap AND n.wall = mid.wall) AS spread, n_points, support >= 0.2 AS snapped FROM mid""")
def wall_coverage(spark, sf_dir):
    peaks = _layers(spark, sf_dir).where(F.col("order") == 1).select("cap", "wall", (F.col("centre") + 0.0101).alias("centre"))
    m = walls.measured_walls(band(spark, sf_dir), peaks, half=0.03)
    return m.select("cap", "wall", *[F.round(F.col(c) + 1e-9, 6).alias(c) for c in ("coord", "support", "spread")], "n_points", "snapped")


OPEN = WALLS + """, wo AS (SELECT cap, wall, axis, hi - lo AS length FROM wl), ob AS (SELECT b.cap, b.wall, along, h, least(greatest(trunc(along / 0.2::DOUBLE)::BIGINT, 0), ceil(length / 0.2::DOUBLE)::BIGINT - 1) AS bin FROM band b JOIN wo USING (cap, wall) WHERE abs(across - coord) < 0.08),
grid AS (SELECT cap, wall, bin, length FROM wo, generate_series(0, 99) AS g(bin) WHERE bin < ceil(length / 0.2::DOUBLE)),
occ AS (SELECT g.cap, g.wall, g.bin, coalesce(bool_or(h > 0.15 AND h < 0.75), false) AS low, coalesce(bool_or(h > 0.9 AND h < 1.8), false) AS mid FROM grid g LEFT JOIN ob USING (cap, wall, bin) GROUP BY ALL)"""


@query(f"WITH {OPEN} SELECT cap, wall, bin, low, mid FROM occ")
def wall_occupancy(spark, sf_dir):
    b = band(spark, sf_dir).where(F.abs(F.col("across") - F.col("coord")) < 0.08)
    w = wall_table(spark, sf_dir).withColumn("length", F.col("hi") - F.col("lo"))
    return walls.occupancy(b, w, 0.2)


GAPS = OPEN + """, f AS (SELECT *, NOT low AND NOT mid AS a, NOT mid AS b FROM occ),
f1 AS (SELECT *, a OR coalesce(lag(a) OVER w, false) OR coalesce(lead(a) OVER w, false) AS da, b OR coalesce(lag(b) OVER w, false) OR coalesce(lead(b) OVER w, false) AS db FROM f WINDOW w AS (PARTITION BY cap, wall ORDER BY bin)),
f2 AS (SELECT cap, wall, bin, a OR (da AND coalesce(lag(da) OVER w, false) AND coalesce(lead(da) OVER w, false)) AS full_, b OR (db AND coalesce(lag(db) OVER w, false) AND coalesce(lead(db) OVER w, false)) AS part FROM f1 WINDOW w AS (PARTITION BY cap, wall ORDER BY bin)),
u AS (SELECT cap, wall, 'door' AS kind, bin FROM f2 WHERE full_ UNION ALL SELECT cap, wall, 'window', bin FROM f2 WHERE part AND NOT full_),
i AS (SELECT *, bin - row_number() OVER (PARTITION BY cap, wall, kind ORDER BY bin) AS g FROM u),
rn AS (SELECT cap, wall, kind, min(bin) AS start, max(bin) + 1 AS stop FROM i GROUP BY cap, wall, kind, g),
gaps AS (SELECT rn.cap, rn.wall, kind, start, stop FROM rn JOIN wo USING (cap, wall) WHERE (stop - start) * 0.2::DOUBLE BETWEEN 0.45 AND 2.4 AND start > 0 AND stop < ceil(length / 0.2::DOUBLE))"""


def _gaps(spark, sf_dir):
    b = band(spark, sf_dir).where((F.abs(F.col("across") - F.col("coord")) < 0.08) & (F.col("along") * 10 % 20 > 6.5))
    w = wall_table(spark, sf_dir).withColumns({"length": F.col("hi") - F.col("lo"), "top": F.lit(2.35)})
    bins = walls.occupancy(b, w, 0.2)
    return b, w, bins, walls.gap_runs(bins, 0.2)


GAPS = GAPS.replace("WHERE abs(across - coord) < 0.08)", "WHERE abs(across - coord) < 0.08 AND along * 10 % 20 > 6.5)")


@query(f"WITH {GAPS} SELECT cap, wall, kind, start, stop FROM gaps")
def wall_gaps(spark, sf_dir):
    return _gaps(spark, sf_dir)[3]


JAMBS = GAPS + """, op AS (SELECT cap, wall, kind, start, stop, length FROM gaps JOIN wo USING (cap, wall) WHERE kind = 'door'),
jm AS (SELECT o.cap, o.wall, start, stop, any_value(length) AS length, count(*) FILTER (WHERE along < start * 0.2::DOUBLE + 0.2::DOUBLE AND along > start * 0.2::DOUBLE - 0.15) AS nl, count(*) FILTER (WHERE along > stop * 0.2::DOUBLE - 0.2::DOUBLE AND along < stop * 0.2::DOUBLE + 0.15) AS nr,
  quantile_cont(CASE WHEN along < start * 0.2::DOUBLE + 0.2::DOUBLE AND along > start * 0.2::DOUBLE - 0.15 THEN along END, 0.98) AS pl, quantile_cont(CASE WHEN along > stop * 0.2::DOUBLE - 0.2::DOUBLE AND along < stop * 0.2::DOUBLE + 0.15 THEN along END, 0.02) AS pr
  FROM op o LEFT JOIN (SELECT * FROM ob WHERE h > 0.9 AND h < 1.8) p USING (cap, wall) GROUP BY o.cap, o.wall, start, stop),
j2 AS (SELECT *, CASE WHEN nl > 5 THEN pl ELSE start * 0.2::DOUBLE END AS j0, CASE WHEN nr > 5 THEN pr ELSE stop * 0.2::DOUBLE END AS j1 FROM jm),
j3 AS (SELECT * FROM j2 WHERE j0 >= 0 AND j1 <= length AND j1 > j0)
SELECT j3.cap, j3.wall, 'door' AS kind, round(j0 + 1e-9, 6) AS offset_m, round(j1 - j0 + 1e-9, 6) AS width, 0.0::DOUBLE AS bottom,
 round(CASE WHEN count(*) FILTER (WHERE along > j0 AND along < j1 AND h > 1.5) > 20 THEN quantile_cont(CASE WHEN along > j0 AND along < j1 AND h > 1.5 THEN h END, 0.02) ELSE 2.35 END + 1e-9, 6) AS top, 1.0::DOUBLE AS seen_share, nl + nr AS jamb_points
FROM j3 LEFT JOIN ob USING (cap, wall) GROUP BY ALL"""


@query("WITH " + JAMBS)
def wall_openings(spark, sf_dir):
    b, w, bins, gaps = _gaps(spark, sf_dir)
    seen = bins.select("cap", "wall", "bin", F.lit(True).alias("seen"))
    o = walls.openings(gaps.where("kind = 'door'"), b, bins, seen, w, 0.2)
    return o.select("cap", "wall", "kind", F.round(F.col("offset") + 1e-9, 6).alias("offset_m"), F.round(F.col("width") + 1e-9, 6).alias("width"), "bottom", F.round(F.col("top") + 1e-9, 6).alias("top"), "seen_share", "jamb_points")


@query(f"""WITH {WALLS}, free AS (SELECT cap, floor(z)::INTEGER AS r, floor(x)::INTEGER AS c, count(*) AS n FROM pts WHERE y > 2 GROUP BY ALL),
q AS (SELECT cap, wall, bin, floor(CASE WHEN axis = 0 THEN coord - inward * depth ELSE (bin + 0.5) * 0.5 END)::INTEGER AS r, floor(CASE WHEN axis = 0 THEN (bin + 0.5) * 0.5 ELSE coord - inward * depth END)::INTEGER AS c
  FROM wl, generate_series(0, 19) AS g(bin), (VALUES (0.25), (0.4), (0.6)) AS t(depth) WHERE bin < ceil((hi - lo) / 0.5))
SELECT cap, wall, bin, max(coalesce(n, 0)) >= 30 AS seen FROM q LEFT JOIN free USING (cap, r, c) GROUP BY ALL""")
def seen_beyond(spark, sf_dir):
    w = wall_table(spark, sf_dir).select("cap", "wall", "axis", "coord", F.lit(0.0).alias("start"), F.lit(1.0).alias("direction"), (-F.col("inward")).alias("outward"), (F.col("hi") - F.col("lo")).alias("length"))
    free = points(spark, sf_dir).where("y > 2").groupBy("cap", F.floor("z").cast("int").alias("r"), F.floor("x").cast("int").alias("c")).agg(F.count("*").alias("n"))
    return walls.seen_beyond(w, free, 1.0, 0.5, 30)


KNN = """WITH d AS (SELECT vec_id, vec_id // 100 AS pair, vec_id % 2 AS side, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b, embedding[3]::DOUBLE AS c FROM embeddings),
n AS (SELECT q.pair, q.vec_id AS q_id, t.vec_id AS t_id, sqrt((q.a - t.a) * (q.a - t.a) + (q.b - t.b) * (q.b - t.b) + (q.c - t.c) * (q.c - t.c)) AS distance FROM d q JOIN d t ON q.pair = t.pair AND q.side = 0 AND t.side = 1),
k AS (SELECT *, row_number() OVER w AS k, lead(distance) OVER w AS second FROM n WINDOW w AS (PARTITION BY q_id ORDER BY distance, t_id))
SELECT pair, q_id, t_id, round(distance, 6) AS distance FROM k WHERE k = 1 AND distance < 0.78 * second"""


@query(KNN)
def knn_ratio_match(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings")
    d = e.select(F.floor(F.col("vec_id") / 100).alias("pair"), F.col("vec_id").alias("id"), F.transform(F.slice("embedding", 1, 3), lambda x: x.cast("double")).alias("descriptor"))
    m = match.knn_ratio_match(d.where("id % 2 = 0"), d.where("id % 2 = 1"))
    return m.select("pair", "q_id", "t_id", F.round("distance", 6).alias("distance"))


@query("""WITH e AS (SELECT o_orderkey AS id, o_orderkey % 60 AS matches, o_orderkey % 37 AS inliers, (o_orderkey % 11) / 100 AS bbox_share, (o_orderkey % 13) / 10 AS residual, 1 + o_orderkey % 4 AS median_z, o_orderkey % 10 AS distance FROM orders)
SELECT id FROM e WHERE matches >= 12 AND inliers >= 10 AND inliers >= 0.2::DOUBLE * matches AND bbox_share >= 0.02::DOUBLE AND residual <= greatest(0.6::DOUBLE, 0.3::DOUBLE * median_z) AND distance <= 8""")
def accepted_edges(spark, sf_dir):
    k = F.col("o_orderkey")
    e = read(spark, sf_dir, "orders").select(k.alias("id"), (k % 60).alias("matches"), (k % 37).alias("inliers"), ((k % 11) / 100).alias("bbox_share"), ((k % 13) / 10).alias("residual"), (1 + k % 4).alias("median_z"), (k % 10).alias("distance"))
    return match.accepted_edges(e).select("id")


@query("""WITH v AS (SELECT c_custkey // 40 AS cap, c_custkey AS view, CASE WHEN c_custkey // 40 % 2 = 0 THEN 'photos' ELSE 'video' END AS tier FROM customer ), n AS (SELECT cap, count(*) AS n FROM v GROUP BY cap)
SELECT a.cap, a.view AS i, b.view AS j, (a.tier = 'photos' AND n <= 32) OR b.view - a.view <= 3 AS learned FROM v a JOIN v b ON a.cap = b.cap AND a.view < b.view JOIN n ON n.cap = a.cap""")
def view_pairs(spark, sf_dir):
    k = F.col("c_custkey")
    v = read(spark, sf_dir, "customer").select(F.floor(k / 40).alias("cap"), k.alias("view"), F.when(F.floor(k / 40) % 2 == 0, "photos").otherwise("video").alias("tier"))
    return match.view_pairs(v)


DAMAGE = f"""{ROOMS}, rw AS (SELECT cap, room, 0 AS wall, x0 AS su, y0 AS sv, x0 + w AS eu, y0 AS ev, w AS length FROM rooms UNION ALL SELECT cap, room, 1, x0 + w, y0, x0 + w, y0 + h, h FROM rooms),
px AS (SELECT cap, (l % 2) AS region, u, v, h FROM (SELECT l_orderkey // 40 AS cap, l_orderkey AS l, l_quantity / 5 AS u, l_tax * 50 + l_discount * 10 + 0.0 AS v, l_extendedprice / 40000 AS h FROM lineitem)),
hit AS (SELECT px.cap, region, room, wall, count(*) AS n FROM px JOIN rw ON rw.cap = px.cap WHERE h > 0
  AND abs((v - sv) * (eu - su) / length - (u - su) * (ev - sv) / length) < 1.5 AND (u - su) * (eu - su) / length + (v - sv) * (ev - sv) / length > 0 AND (u - su) * (eu - su) / length + (v - sv) * (ev - sv) / length < length GROUP BY ALL HAVING count(*) >= 12),
best AS (SELECT *, row_number() OVER (PARTITION BY cap, region ORDER BY n DESC, room, wall) AS k FROM hit)"""


@query(f"WITH {DAMAGE} SELECT cap, region, room, wall, n FROM best WHERE k = 1")
def damage_region_topwall(spark, sf_dir):
    p = read(spark, sf_dir, "lineitem").select(F.floor(F.col("l_orderkey") / 40).alias("cap"), (F.col("l_orderkey") % 2).alias("region"), (F.col("l_quantity") / 5).alias("u"), (F.col("l_tax") * 50 + F.col("l_discount") * 10 + 0.0).alias("v"), (F.col("l_extendedprice") / 40000).alias("h"))
    r = rooms(spark, sf_dir)
    a = r.select("cap", "room", F.lit(0).alias("wall"), F.col("x0").alias("su"), F.col("y0").alias("sv"), (F.col("x0") + F.col("w")).alias("eu"), F.col("y0").alias("ev"), F.col("w").alias("length"))
    b = r.select("cap", "room", F.lit(1).alias("wall"), (F.col("x0") + F.col("w")).alias("su"), F.col("y0").alias("sv"), (F.col("x0") + F.col("w")).alias("eu"), (F.col("y0") + F.col("h")).alias("ev"), F.col("h").alias("length"))
    return match.wall_of_region(p, a.unionByName(b), 1.5)


@query("""WITH r AS (SELECT p_partkey % 10 AS cap, 'room-' || (p_partkey % 7) || '/wall-' || (p_partkey % 4) AS surface_id, CASE WHEN p_partkey % 3 = 0 THEN 'crack' ELSE 'water_stain' END AS class, p_size / 50 AS score, 'evidence/' || (p_partkey % 23) || '.jpg' AS evidence FROM part),
g AS (SELECT cap, surface_id, class, max(score) AS score, string_agg(DISTINCT evidence, ',' ORDER BY evidence) AS evidence FROM r GROUP BY ALL)
SELECT cap, surface_id, class, score, evidence, 'damage-' || row_number() OVER (PARTITION BY cap ORDER BY surface_id, class) AS damage_id FROM g""")
def damage_groups(spark, sf_dir):
    k = F.col("p_partkey")
    r = read(spark, sf_dir, "part").select((k % 10).alias("cap"), F.concat(F.lit("room-"), k % 7, F.lit("/wall-"), k % 4).alias("surface_id"), F.when(k % 3 == 0, "crack").otherwise("water_stain").alias("class"), (F.col("p_size") / 50).alias("score"), F.concat(F.lit("evidence/"), k % 23, F.lit(".jpg")).alias("evidence"))
    return match.damage_groups(r)


@query("""WITH s AS (SELECT l_orderkey AS id, l_linenumber AS ln, l_partkey AS pk, l_quantity / 50 AS water_stain, l_discount * 8 AS crack, l_tax * 4 AS clean FROM lineitem)
SELECT id, ln, pk, 'water_stain' AS class, round(water_stain, 6) AS score FROM s WHERE water_stain > 0.55 AND water_stain > clean + 0.15 UNION ALL SELECT id, ln, pk, 'crack', round(crack, 6) FROM s WHERE crack > 0.55 AND crack > clean + 0.15""")
def damage_mask(spark, sf_dir):
    s = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("ln"), F.col("l_partkey").alias("pk"), (F.col("l_quantity") / 50).alias("water_stain"), (F.col("l_discount") * 8).alias("crack"), (F.col("l_tax") * 4).alias("clean"))
    return match.damage_mask(s).withColumn("score", F.round("score", 6))
