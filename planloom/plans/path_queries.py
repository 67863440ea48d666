"""Queries over camera paths, bins and rasters."""

from __future__ import annotations

from pyspark.sql import functions as F

from planloom.operators import graph, path, raster
from planloom.plans.registry import query
from planloom.plans.views import POINTS, ROOMS, TRAJECTORY, points, rooms, trajectory

VISITS = TRAJECTORY + ", vis AS (SELECT cap, seq, event_id % 6 AS label FROM traj)"


def visits(spark, sf_dir):
    return trajectory(spark, sf_dir).select("cap", "seq", (F.col("event_id") % 6).alias("label"))


@query(f"""WITH {TRAJECTORY}, s AS (SELECT cap, seq, u, v, sqrt((u - lag(u) OVER w) ** 2 + (v - lag(v) OVER w) ** 2) AS step FROM traj WINDOW w AS (PARTITION BY cap ORDER BY seq))
SELECT cap, count(*) AS frames, round(coalesce(sum(step), 0) + 1e-9, 6) AS length, round(sqrt((arg_max(u, seq) - arg_min(u, seq)) ** 2 + (arg_max(v, seq) - arg_min(v, seq)) ** 2) + 1e-9, 6) AS loop_gap FROM s GROUP BY cap""")
def path_length(spark, sf_dir):
    return path.path_length(trajectory(spark, sf_dir)).select("cap", "frames", *[F.round(F.col(c) + 1e-9, 6).alias(c) for c in ("length", "loop_gap")])


@query(f"WITH {VISITS}, f AS (SELECT cap, label, min(seq) AS first FROM vis WHERE label > 0 GROUP BY ALL HAVING count(*) >= 5) SELECT cap, label, row_number() OVER (PARTITION BY cap ORDER BY first) AS room FROM f")
def first_visit_order(spark, sf_dir):
    return path.first_visit_order(visits(spark, sf_dir), least=5)


@query(f"WITH {VISITS}, p AS (SELECT cap, label, lag(label) OVER (PARTITION BY cap ORDER BY seq) AS was FROM vis WHERE label > 0) SELECT DISTINCT cap, least(label, was) AS room_a, greatest(label, was) AS room_b FROM p WHERE was <> label")
def room_transitions(spark, sf_dir):
    return path.room_transitions(visits(spark, sf_dir))


ANCHORS = POINTS + """, anc AS (SELECT cap, a * 0.25::DOUBLE AS anchor FROM (SELECT DISTINCT l_orderkey // 40 AS cap FROM lineitem), generate_series(0, 10) AS g(a)),
vals AS (SELECT l_orderkey // 40 AS cap, l_extendedprice / 40000 AS value, l_orderkey * 10000000000 + l_partkey * 100000 + (l_extendedprice * 100)::BIGINT % 100000 AS vid FROM lineitem),
near AS (SELECT cap, vid, value, anchor, row_number() OVER (PARTITION BY cap, vid, value ORDER BY abs(anchor - value), anchor) AS k FROM (SELECT DISTINCT cap, vid, value FROM vals) JOIN anc USING (cap)),
res AS (SELECT cap, vid, value, anchor, anchor - value AS residual FROM near WHERE k = 1 AND abs(anchor - value) < 0.09)"""


def _residuals(spark, sf_dir):
    from planloom.plans.views import read

    v = read(spark, sf_dir, "lineitem").select(F.floor(F.col("l_orderkey") / 40).alias("cap"), (F.col("l_extendedprice") / 40000).alias("value"), (F.col("l_orderkey") * F.lit(10000000000) + F.col("l_partkey") * 100000 + F.round(F.col("l_extendedprice") * 100).cast("long") % 100000).alias("vid")).distinct()
    a = v.select("cap").distinct().select("cap", F.explode(F.sequence(F.lit(0), F.lit(10))).alias("a")).select("cap", (F.col("a") * 0.25).alias("anchor"))
    return path.nearest_anchor(v, a)


@query(f"WITH {ANCHORS} SELECT cap, vid, anchor, round(residual + 1e-9, 6) AS residual FROM res")
def nearest_anchor(spark, sf_dir):
    return _residuals(spark, sf_dir).select("cap", "vid", "anchor", F.round(F.col("residual") + 1e-9, 6).alias("residual"))


@query(f"""WITH {ANCHORS}, k AS (SELECT *, row_number() OVER (PARTITION BY cap ORDER BY vid) % 2 = 1 AS train FROM res)
SELECT cap, round(CASE WHEN count(*) FILTER (WHERE train) >= 20 THEN median(CASE WHEN train THEN residual END) ELSE 0 END + 1e-9, 6) AS offset_m,
 CASE WHEN count(*) FILTER (WHERE train) >= 20 THEN least(1.0, count(*) FILTER (WHERE train) / 200) ELSE 0 END AS weight, count(*) FILTER (WHERE train) AS n_train, count(*) FILTER (WHERE NOT train) AS n_test FROM k GROUP BY cap""")
def split_residuals(spark, sf_dir):
    s = path.split_residuals(_residuals(spark, sf_dir), ("cap",), "vid")
    return s.select("cap", F.round(F.col("offset") + 1e-9, 6).alias("offset_m"), "weight", "n_train", "n_test")


@query(f"WITH {ANCHORS} SELECT cap, round(avg(abs(residual)) + 1e-9, 6) AS before, round(avg(abs(residual - 0.01)) + 1e-9, 6) AS after, avg(abs(residual - 0.01)) < 0.995 * avg(abs(residual)) AS accepted FROM res GROUP BY cap")
def held_out_gain(spark, sf_dir):
    g = path.held_out_gain(_residuals(spark, sf_dir), F.lit(0.01))
    return g.select("cap", F.round(F.col("before") + 1e-9, 6).alias("before"), F.round(F.col("after") + 1e-9, 6).alias("after"), "accepted")


@query(f"""WITH {TRAJECTORY}, s AS (SELECT cap, seq, u FROM traj WHERE seq % 10 = 3),
j AS (SELECT t.cap, t.seq, (SELECT max(seq) FROM s WHERE s.cap = t.cap AND s.seq <= t.seq) AS a, (SELECT min(seq) FROM s WHERE s.cap = t.cap AND s.seq >= t.seq) AS b FROM traj t)
SELECT j.cap, j.seq, round(CASE WHEN a IS NULL THEN y.u WHEN b IS NULL OR a = b THEN x.u ELSE x.u + (y.u - x.u) * ((j.seq - a) / (b - a)) END + 1e-9, 6) AS value
FROM j LEFT JOIN s x ON x.cap = j.cap AND x.seq = a LEFT JOIN s y ON y.cap = j.cap AND y.seq = b""")
def interp_asof(spark, sf_dir):
    t = trajectory(spark, sf_dir)
    s = t.where("seq % 10 = 3").select("cap", "seq", F.col("u").alias("value"))
    return path.interpolate(t.select("cap", "seq"), s).select("cap", "seq", F.round(F.col("value") + 1e-9, 6).alias("value"))


@query(f"WITH {TRAJECTORY}, n AS (SELECT cap, count(*) AS n FROM traj GROUP BY cap) SELECT cap, seq FROM traj JOIN n USING (cap) WHERE seq % greatest(10, n // 160) = 0")
def keyframes(spark, sf_dir):
    return path.keyframes(trajectory(spark, sf_dir)).select("cap", "seq")


@query(f"""WITH {TRAJECTORY}, n AS (SELECT cap, count(*) AS n, least(12, count(*)) AS k FROM traj GROUP BY cap)
SELECT DISTINCT cap, CASE WHEN k = 1 THEN 0 WHEN i = k - 1 THEN n - 1 ELSE floor(i * ((n - 1) / (k - 1)))::BIGINT END AS seq FROM n, generate_series(0, 11) AS g(i) WHERE i < k""")
def evenly_spaced_frames(spark, sf_dir):
    return path.evenly_spaced(trajectory(spark, sf_dir), 12).select("cap", "seq")


BINS = TRAJECTORY + """, b AS (SELECT cap, seq AS bin, event_id % 5 < 3 AS flag FROM traj),
x AS (SELECT cap, bin, flag, flag OR coalesce(lag(flag) OVER w, false) OR coalesce(lead(flag) OVER w, false) AS d FROM b WINDOW w AS (PARTITION BY cap ORDER BY bin)),
y AS (SELECT cap, bin, flag OR (d AND coalesce(lag(d) OVER w, false) AND coalesce(lead(d) OVER w, false)) AS flag FROM x WINDOW w AS (PARTITION BY cap ORDER BY bin))"""


def _bins(spark, sf_dir):
    return trajectory(spark, sf_dir).select("cap", F.col("seq").alias("bin"), (F.col("event_id") % 5 < 3).alias("flag"))


@query(f"WITH {BINS} SELECT cap, bin, flag FROM y")
def closed_bins(spark, sf_dir):
    return path.close_gaps(_bins(spark, sf_dir), ("cap",)).select("cap", "bin", "flag")


@query(f"WITH {BINS}, g AS (SELECT cap, bin, bin - row_number() OVER (PARTITION BY cap ORDER BY bin) AS g FROM y WHERE flag) SELECT cap, min(bin) AS start, max(bin) + 1 AS stop FROM g GROUP BY cap, g")
def opening_runs(spark, sf_dir):
    return path.runs(path.close_gaps(_bins(spark, sf_dir), ("cap",)), ("cap",))


@query(f"WITH {ROOMS} SELECT cap, room AS component, coalesce(sum(w + 1.5) OVER (PARTITION BY cap ORDER BY room ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS offset_m FROM rooms")
def display_offsets(spark, sf_dir):
    r = rooms(spark, sf_dir).select("cap", F.col("room").alias("component"), F.col("w").alias("width"))
    return path.display_offsets(r).withColumnRenamed("offset", "offset_m")


@query(f"WITH {TRAJECTORY}, n AS (SELECT cap, seq % 4 AS folder, event_id % 7 AS component, count(*) AS n FROM traj GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY cap, folder ORDER BY n DESC, component) AS k FROM n) SELECT cap, folder, component FROM k WHERE k = 1")
def majority_component(spark, sf_dir):
    v = trajectory(spark, sf_dir).select("cap", (F.col("seq") % 4).alias("folder"), (F.col("event_id") % 7).alias("component"))
    return path.majority(v, "folder", "component")


CELLS = POINTS + ", cells AS (SELECT DISTINCT cap, floor(z * 4)::INTEGER AS r, floor(x * 4)::INTEGER AS c FROM pts WHERE y > 2.3)"
OFF = "(SELECT a, b FROM generate_series(-1, 1) AS g(a), generate_series(-1, 1) AS h(b))"


def _cells(spark, sf_dir):
    return points(spark, sf_dir).where("y > 2.3").select("cap", F.floor(F.col("z") * 4).cast("int").alias("r"), F.floor(F.col("x") * 4).cast("int").alias("c")).distinct()


@query(f"WITH {CELLS} SELECT DISTINCT cap, (r + a)::INTEGER AS r, (c + b)::INTEGER AS c FROM cells, {OFF}")
def dilate(spark, sf_dir):
    return raster.dilate(_cells(spark, sf_dir))


@query(f"WITH {CELLS}, d AS (SELECT DISTINCT cap, (r + a)::INTEGER AS r, (c + b)::INTEGER AS c FROM cells, {OFF}), e AS (SELECT cap, (r + a)::INTEGER AS r, (c + b)::INTEGER AS c FROM d, {OFF}) SELECT cap, r, c FROM e GROUP BY ALL HAVING count(*) = 9")
def closed_raster(spark, sf_dir):
    return raster.closed(_cells(spark, sf_dir))


@query(f"WITH {CELLS}, e AS (SELECT cap, (r + a)::INTEGER AS r, (c + b)::INTEGER AS c FROM cells, {OFF}), k AS (SELECT cap, r, c FROM e GROUP BY ALL HAVING count(*) = 9) SELECT DISTINCT cap, (r + a)::INTEGER AS r, (c + b)::INTEGER AS c FROM k, {OFF}")
def opened_raster(spark, sf_dir):
    return raster.opened(_cells(spark, sf_dir), 3)


LAB = CELLS + ", lab AS (SELECT cap, r, c, ((r // 6) * 100 + c // 8 + 1)::INTEGER AS label FROM cells)"


def _labels(spark, sf_dir):
    return _cells(spark, sf_dir).withColumn("label", (F.floor(F.col("r") / 6) * 100 + F.floor(F.col("c") / 8) + 1).cast("int"))


@query(f"WITH {LAB}, ring AS (SELECT DISTINCT cap, r + a AS r, c + b AS c, label AS a FROM lab, {OFF} WHERE a <> 0 OR b <> 0) SELECT ring.cap, ring.a, lab.label AS b, count(*) AS n FROM ring JOIN lab ON lab.cap = ring.cap AND lab.r = ring.r AND lab.c = ring.c WHERE lab.label <> ring.a GROUP BY ALL HAVING count(*) >= 2")
def neighbour_contact(spark, sf_dir):
    return raster.neighbour_contact(_labels(spark, sf_dir), 2)


@query(f"WITH {LAB} SELECT cap, label, count(*) * 0.25 * 0.25 AS area FROM lab GROUP BY ALL")
def component_areas(spark, sf_dir):
    return raster.component_areas(_labels(spark, sf_dir), 0.25)


@query(f"WITH {LAB} SELECT p.cap, coalesce(label, 0) AS label, count(*) AS n FROM (SELECT cap, floor(z * 4)::INTEGER AS r, floor(x * 4)::INTEGER AS c FROM pts) p LEFT JOIN lab USING (cap, r, c) GROUP BY ALL")
def point_labels(spark, sf_dir):
    p = points(spark, sf_dir).select("cap", F.floor(F.col("z") * 4).cast("int").alias("r"), F.floor(F.col("x") * 4).cast("int").alias("c"))
    return raster.lookup(p, _labels(spark, sf_dir)).groupBy("cap", "label").agg(F.count("*").alias("n"))


@query(f"""WITH {LAB}, {ROOMS}, s AS (SELECT room, cap % 8 AS cap, x0 AS u0, x0 + w AS u1, y0 AS v0, y0 + h AS v1 FROM rooms),
q AS (SELECT room, cap, c, r FROM s, generate_series(0, 100) AS g(c), generate_series(0, 100) AS h(r) WHERE c >= floor(u0 / 0.25) AND c < u1 / 0.25 AND r >= floor(v0 / 0.25) AND r < v1 / 0.25)
SELECT room, round(avg(CASE WHEN label IS NULL THEN 0 ELSE 1 END) + 1e-9, 6) AS share FROM q LEFT JOIN lab USING (cap, r, c) GROUP BY room""")
def swept_share(spark, sf_dir):
    s = rooms(spark, sf_dir).select("room", (F.col("cap") % 8).alias("cap"), F.col("x0").alias("u0"), (F.col("x0") + F.col("w")).alias("u1"), F.col("y0").alias("v0"), (F.col("y0") + F.col("h")).alias("v1"))
    return raster.swept_share(s, _labels(spark, sf_dir), 0.25, ("room",)).select("room", F.round(F.col("share") + 1e-9, 6).alias("share"))


@query(f"""WITH RECURSIVE {ROOMS}, e AS (SELECT room AS a, room + 15 AS b FROM rooms WHERE room % 4 = 0 AND room // 200 = (room + 15) // 200 UNION ALL SELECT room, room + 5 FROM rooms WHERE room % 9 = 0 AND room // 200 = (room + 5) // 200),
s AS (SELECT a, b FROM e UNION SELECT b, a FROM e), walk(u, v) AS (SELECT a, a FROM s UNION SELECT walk.u, s.b FROM walk JOIN s ON s.a = walk.v)
SELECT u, min(v) AS root FROM walk GROUP BY u""")
def component_labels(spark, sf_dir):
    r = rooms(spark, sf_dir).select("room")
    a = r.where("room % 4 = 0 and floor(room / 200) = floor((room + 15) / 200)").select(F.col("room").alias("u"), (F.col("room") + 15).alias("v"))
    b = r.where("room % 9 = 0 and floor(room / 200) = floor((room + 5) / 200)").select(F.col("room").alias("u"), (F.col("room") + 5).alias("v"))
    return graph.connected_components(a.unionByName(b))
