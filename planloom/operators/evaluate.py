"""Geometry checks of plans, and their accuracy against independent measurements."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planloom import constants as K
from planloom.operators import plan as P

ROOM = P.ROOM


def self_crossing(ring: DataFrame) -> DataFrame:
    """(cap, room): rings in which two walls that are no neighbours meet. Only walls of one room are compared."""
    e = P.edges(ring).select(*ROOM, "i", "u", "v", "nu", "nv")
    last = e.groupBy(*ROOM).agg(F.max("i").alias("_last"))
    named = lambda n, start, stop: e.select(*ROOM, F.col("i").alias(n), *[F.col(f"{c}{a}").alias(f"{p}{a}") for p, c in ((start, ""), (stop, "n")) for a in "uv"])
    j = named("_i", "p", "q").join(named("_j", "r", "s"), [*ROOM]).where("_j > _i + 1").join(last, [*ROOM]).where("not (_i = 0 and _j = _last)")
    side = lambda p, q, r: (F.col(f"{q}u") - F.col(f"{p}u")) * (F.col(f"{r}v") - F.col(f"{p}v")) - (F.col(f"{q}v") - F.col(f"{p}v")) * (F.col(f"{r}u") - F.col(f"{p}u"))
    apart = side("p", "q", "r") * side("p", "q", "s") > 0
    beside = side("r", "s", "p") * side("r", "s", "q") > 0
    boxes = F.lit(True)
    for c in "uv":
        boxes = boxes & (F.greatest(f"p{c}", f"q{c}") >= F.least(f"r{c}", f"s{c}")) & (F.greatest(f"r{c}", f"s{c}") >= F.least(f"p{c}", f"q{c}"))
    return j.where(~apart & ~beside & boxes).select(*ROOM).distinct()


def bad_intervals(measured: DataFrame) -> DataFrame:
    """Measurements (cap, dimension, value, sigma, low, high) that are not finite numbers in order."""
    finite = F.lit(True)
    for c in ("value", "sigma", "low", "high"):
        finite = finite & F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))
    return measured.where(~(finite & (F.col("low") <= F.col("value")) & (F.col("value") <= F.col("high"))))


def geometry_errors(ring: DataFrame, rooms: DataFrame, walls: DataFrame, openings: DataFrame) -> DataFrame:
    """(cap, room, rule, item): one row for each broken rule.

    Rules: duplicate_room, invalid_polygon, area, wall_length, wall_ends, opening_range, opening_target. A room
    with an invalid polygon is reported once and not checked further.
    """
    m = P.ring_metrics(ring)
    bad = m.where("area <= 0").select(*ROOM).unionByName(self_crossing(ring)).distinct()
    twice = rooms.groupBy(*ROOM).count().where("count > 1").select(*ROOM, F.lit("duplicate_room").alias("rule"), F.lit(None).cast("int").alias("item"))
    invalid = bad.select(*ROOM, F.lit("invalid_polygon").alias("rule"), F.lit(None).cast("int").alias("item"))
    sound = rooms.join(bad, [*ROOM], "left_anti")
    area = sound.join(m, [*ROOM]).where(F.abs(F.col("area") - F.col("area_value")) > 0.01).select(*ROOM, F.lit("area").alias("rule"), F.lit(None).cast("int").alias("item"))
    w = walls.join(bad, [*ROOM], "left_anti")
    gap = lambda a, b, c, d: F.sqrt((F.col(a) - F.col(c)) * (F.col(a) - F.col(c)) + (F.col(b) - F.col(d)) * (F.col(b) - F.col(d)))
    length = w.where(F.abs(gap("su", "sv", "eu", "ev") - F.col("length")) > 0.002).select(*ROOM, F.lit("wall_length").alias("rule"), "i")
    e = P.edges(ring).select(*ROOM, "i", "u", "v", "nu", "nv")
    ends = w.join(e, [*ROOM, "i"], "left").where(F.col("u").isNull() | (gap("su", "sv", "u", "v") > 0.002) | (gap("eu", "ev", "nu", "nv") > 0.002)).select(*ROOM, F.lit("wall_ends").alias("rule"), "i")
    o = openings.join(bad, [*ROOM], "left_anti")
    lengths = walls.select(*ROOM, F.col("i").alias("wall"), "length")
    beyond = o.join(lengths, [*ROOM, "wall"], "left").where(F.col("length").isNull() | (F.col("offset") + F.col("width") > F.col("length") + 0.025)).select(*ROOM, F.lit("opening_range").alias("rule"), F.col("opening").alias("i"))
    ids = rooms.select("cap", F.col("room").alias("connects_to")).distinct()
    target = o.where("connects_to is not null").join(ids, ["cap", "connects_to"], "left_anti").select(*ROOM, F.lit("opening_target").alias("rule"), F.col("opening").alias("i"))
    out = twice.unionByName(invalid).unionByName(area)
    for part in (length, ends, beyond, target):
        out = out.unionByName(part.select(*ROOM, "rule", F.col("i").cast("int").alias("item")))
    return out


def validity(rooms: DataFrame, errors: DataFrame, overlaps: DataFrame) -> DataFrame:
    """(cap, n_errors, n_overlaps, valid) of each plan."""
    e, o = errors.groupBy("cap").agg(F.count("*").alias("n_errors")), overlaps.groupBy("cap").agg(F.count("*").alias("n_overlaps"))
    out = rooms.select("cap").distinct().join(e, "cap", "left").join(o, "cap", "left").fillna(0, ["n_errors", "n_overlaps"])
    return out.withColumn("valid", (F.col("n_errors") == 0) & (F.col("n_overlaps") == 0))


def opening_dimensions(openings: DataFrame, key: str) -> DataFrame:
    """(cap, dimension, value, sigma): the width or height of every opening under its key."""
    name = F.concat(F.lit("room-"), F.col("room").cast("string"), F.lit("/opening-"), F.col("opening").cast("string"), F.lit(f"/{key}"))
    return openings.select("cap", name.alias("dimension"), F.col(key).alias("value"), F.col(f"{key}_sigma").alias("sigma"))


def flatten(footprint: DataFrame, rooms: DataFrame, walls: DataFrame, openings: DataFrame) -> DataFrame:
    """(cap, dimension, value, sigma): every measured dimension of a plan under its key."""
    room = F.concat(F.lit("room-"), F.col("room").cast("string"))
    parts = [footprint.select("cap", F.lit("footprint_area").alias("dimension"), "value", "sigma")]
    for key, value in (("floor_area", "area"), ("ceiling_height", "height"), ("perimeter", "perimeter")):
        parts.append(rooms.where(F.col(value).isNotNull()).select("cap", F.concat(room, F.lit(f"/{key}")).alias("dimension"), F.col(value).alias("value"), F.col(f"{value}_sigma").alias("sigma")))
    parts.append(walls.select("cap", F.concat(room, F.lit("/wall-"), F.col("i").cast("string"), F.lit("/length")).alias("dimension"), F.col("length").alias("value"), F.col("length_sigma").alias("sigma")))
    parts += [opening_dimensions(openings, key) for key in ("width", "height")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def checked_truth(truth: DataFrame) -> DataFrame:
    """The truth rows, or an error for a source that is no measuring tool and for targets that are not positive numbers."""
    bad = ~F.col("source").isin("laser", "tape") | F.col("target").isNull() | F.isnan("target") | (F.col("target") <= 0) | (F.col("target") == float("inf"))
    return truth.withColumn("target", F.when(bad, F.raise_error(F.concat(F.lit("not independently measured: "), F.col("dimension"))).cast("double")).otherwise(F.col("target")))


def evaluate_rows(dimensions: DataFrame, truth: DataFrame) -> DataFrame:
    """(cap, dimension, target, prediction, error, relative, inside, tolerance, passes, status) of each measured dimension.

    `truth` has (cap, tier, dimension, target, lidar_tolerance). Dimensions the plan lacks are `missed`.
    """
    j = truth.join(dimensions, ["cap", "dimension"], "left")
    error, d, t = F.abs(F.col("value") - F.col("target")), F.col("dimension"), F.col("target")
    wall = F.when(F.col("tier") == "photos", 0.08 * t).when(F.col("tier") == "video", 0.03 * t).otherwise(F.col("lidar_tolerance"))
    width = d.contains("/opening-") & d.endswith("/width")
    tolerance = F.when(d.contains("/wall-"), wall).when(width, F.lit(0.02)).when(d.endswith("/ceiling_height"), F.lit(0.015)).when((d == "footprint_area") & (F.col("tier") == "photos"), 0.08 * t)
    seen = F.col("value").isNotNull()
    inside = (F.greatest(F.lit(0.0), F.col("value") - K.Z95 * F.col("sigma")) <= t) & (t <= F.col("value") + K.Z95 * F.col("sigma"))
    j = j.withColumn("tol", F.when(seen, tolerance))
    return j.select("cap", "dimension", "target", F.col("value").alias("prediction"), error.alias("error"), (error / t).alias("relative"), F.when(seen, inside).alias("inside"), F.col("tol").alias("tolerance"), (error <= F.col("tol")).alias("passes"), F.when(seen, "matched").otherwise("missed").alias("status"))


def interval_coverage(rows: DataFrame) -> DataFrame:
    """(cap, coverage, n): share of matched dimensions whose interval holds the truth; null where none is matched."""
    m = F.col("status") == "matched"
    return rows.groupBy("cap").agg(F.avg(F.when(m, F.col("inside").cast("double"))).alias("coverage"), F.count_if(m).alias("n"))


def opening_widths(frame: DataFrame) -> DataFrame:
    """The rows of a table of dimensions or truths that are widths of openings."""
    d = F.col("dimension")
    return frame.where(d.contains("/opening-") & d.endswith("/width"))


def opening_keys(frame: DataFrame) -> DataFrame:
    return opening_widths(frame).select("cap", "dimension").distinct()


def phantoms(dimensions: DataFrame, truth: DataFrame) -> DataFrame:
    """Openings of plans that the truth does not have."""
    return opening_keys(dimensions).join(truth.select("cap").distinct(), "cap", "left_semi").join(opening_keys(truth), ["cap", "dimension"], "left_anti")


def misses(dimensions: DataFrame, truth: DataFrame) -> DataFrame:
    """Openings of the truth that plans do not have."""
    return opening_keys(truth).join(opening_keys(dimensions), ["cap", "dimension"], "left_anti")


def opening_gate(rows: DataFrame, dimensions: DataFrame, truth: DataFrame) -> DataFrame:
    """(cap, successes, truths, phantoms, fraction, passes), fraction and verdict only where the truth lists all openings.

    Only widths of openings count: `rows` and `dimensions` may hold just those, while `truth` has every truth of a plan.
    """
    keys = opening_keys(truth)
    ok = rows.join(keys, ["cap", "dimension"], "left_semi").groupBy("cap").agg(F.count_if(F.col("passes")).alias("successes"), F.count("*").alias("truths"))
    extra = phantoms(dimensions, truth).groupBy("cap").agg(F.count("*").alias("phantoms"))
    whole = truth.groupBy("cap").agg(F.max("exhaustive").alias("exhaustive"))
    j = whole.join(ok, "cap", "left").join(extra, "cap", "left").fillna(0, ["successes", "truths", "phantoms"])
    fraction = F.when(F.col("exhaustive"), F.col("successes") / F.nullif(F.col("truths") + F.col("phantoms"), F.lit(0)))
    return j.select("cap", "successes", "truths", "phantoms", fraction.alias("fraction"), (fraction >= K.OPENING_PASS).alias("passes"))
