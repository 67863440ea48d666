"""Plans as documents: nested JSON, a drawing, a page, and roll-ups over many plans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planloom.functions import geometry as G

VERSION = "planloom.plan/1"


def measurement(value: str, sigma: str, unit: str = "m"):
    """Struct of a value, its sigma and its interval, rounded to four places; null where the value is."""
    low, high = G.interval(F.col(value), F.col(sigma))
    m = F.struct(F.round(value, 4).alias("value"), F.round(sigma, 4).alias("sigma"), F.array(F.round(low, 4), F.round(high, 4)).alias("ci95"), F.lit(unit).alias("unit"))
    return F.when(F.col(value).isNotNull(), m)


def _ordered(df: DataFrame, name: str, *fields) -> DataFrame:
    return df.select("cap", "room", F.struct(*fields).alias("_x")).groupBy("cap", "room").agg(F.array_sort(F.collect_list("_x")).alias(name))


def plan_documents(ring: DataFrame, walls: DataFrame, rooms: DataFrame, openings: DataFrame, footprint: DataFrame, adjacency: DataFrame | None = None, diagnostics: DataFrame | None = None, frame: DataFrame | None = None, tier: str = "lidar", warnings: tuple[str, ...] = ()) -> DataFrame:
    """(cap, plan): one nested JSON document a capture; rooms, walls and openings in order, numbers to four places.

    Walls have ends and, of a wall fitted to no surface, measured = false; openings have offset, width, height and, of windows, sill where
    the tables hold them. Adjacency, diagnostics and frame become parts of the document where they are given.
    """
    key = ["cap", "room"]
    here = lambda df, value, unit="m": measurement(value, f"{value}_sigma", unit).alias(value) if {value, f"{value}_sigma"} <= set(df.columns) else F.lit(None).alias(value)
    at = lambda u, v: F.array(F.round(u, 4), F.round(v, 4))
    poly = ring.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", F.round("u", 4).alias("u"), F.round("v", 4).alias("v")))), lambda p: F.array(p["u"], p["v"])).alias("polygon"))
    w = _ordered(walls, "walls", F.col("i").alias("index"), at("u", "v").alias("start"), at("nu", "nv").alias("end"), here(walls, "length"), F.col("snapped").alias("measured"))
    kind = F.col("kind") if "kind" in openings.columns else F.lit("door").alias("kind")
    o = _ordered(openings, "openings", "opening", kind, "wall", here(openings, "offset"), here(openings, "width"), here(openings, "height"), here(openings, "bottom"), "connects_to")
    notes = F.col("notes") if "notes" in rooms.columns else F.array().cast("array<string>").alias("notes")
    r = rooms.select(*key, measurement("area", "area_sigma", "m2").alias("floor_area"), here(rooms, "perimeter"), measurement("height", "height_sigma").alias("ceiling_height"), notes)
    full = r.join(poly, key).join(w, key).join(o, key, "left")
    nested = full.groupBy("cap").agg(F.array_sort(F.collect_list(F.struct(F.col("room").alias("id"), F.concat(F.lit("Room "), F.col("room").cast("string")).alias("name"), "polygon", "walls", "floor_area", "perimeter", "ceiling_height", F.coalesce("openings", F.array()).alias("openings"), "notes"))).alias("rooms"))
    whole = nested.join(footprint, "cap")
    parts = [F.lit(VERSION).alias("schema"), F.col("cap").cast("string").alias("capture"), F.lit(tier).alias("tier"), "rooms", measurement("value", "sigma", "m2").alias("footprint_area")]
    if adjacency is not None:
        pairs = adjacency.groupBy("cap").agg(F.array_sort(F.collect_list(F.struct(F.array("room_a", "room_b").alias("rooms"), F.lit("door").alias("via")))).alias("adjacency"))
        whole = whole.join(pairs, "cap", "left").withColumn("adjacency", F.coalesce("adjacency", F.array()))
        parts.append("adjacency")
    for name, table in (("diagnostics", diagnostics), ("frame", frame)):
        if table is not None:
            rounded = [F.round(c, 4).alias(c) if t == "double" else F.col(c) for c, t in table.dtypes if c != "cap"]
            whole = whole.join(table.select("cap", F.struct(*rounded).alias(name)), "cap", "left")
            parts.append(name)
    quality = F.struct(F.lit("experimental").alias("status"), F.lit("not calibrated against independent measurements").alias("intervals"), F.array(*[F.lit(x) for x in warnings]).cast("array<string>").alias("warnings"))
    return whole.select("cap", F.to_json(F.struct(*parts, quality.alias("quality"))).alias("plan"))


MEASURED = "struct<value:double,sigma:double,ci95:array<double>,unit:string>"
PLAN = (
    "struct<schema:string,capture:string,tier:string,footprint_area:M,adjacency:array<struct<rooms:array<long>,via:string>>,rooms:array<struct<id:long,name:string,polygon:array<array<double>>,"
    "walls:array<struct<index:int,start:array<double>,end:array<double>,length:M,measured:boolean>>,floor_area:M,perimeter:M,ceiling_height:M,"
    "openings:array<struct<opening:int,kind:string,wall:int,offset:M,width:M,height:M,bottom:M,connects_to:long>>,notes:array<string>>>>"
).replace(":M", ":" + MEASURED)


def read_plans(documents: DataFrame) -> dict[str, DataFrame]:
    """The tables of plan documents (cap, plan): ring, walls, rooms, openings, footprint, adjacency, dimensions.

    A document that does not have the form of a plan, or another schema version, is an error when it is read.
    """
    p = documents.select("cap", F.from_json("plan", PLAN, {"mode": "FAILFAST"}).alias("p"))
    ok = (F.col("p.schema") == VERSION) & F.col("p.rooms").isNotNull() & F.col("p.footprint_area.value").isNotNull()
    p = p.select("cap", F.when(F.coalesce(ok, F.lit(False)), F.col("p")).otherwise(F.raise_error(F.concat(F.lit("no plan document of this version: "), F.col("cap").cast("string"))).cast(p.schema["p"].dataType)).alias("p"))
    room = p.select("cap", F.explode("p.rooms").alias("r"))
    value = lambda c, name: [F.col(f"{c}.value").alias(name), F.col(f"{c}.sigma").alias(f"{name}_sigma")]
    rid = F.col("r.id").alias("room")
    wall = room.select("cap", rid, F.explode("r.walls").alias("w"))
    opening = room.select("cap", rid, F.explode("r.openings").alias("o"))
    end = lambda c, n: [F.col(f"w.{c}")[k].alias(f"{n}{a}") for k, a in enumerate("uv")]
    return {
        "ring": room.select("cap", rid, F.posexplode("r.polygon").alias("i", "at")).select("cap", "room", "i", F.col("at")[0].alias("u"), F.col("at")[1].alias("v")),
        "walls": wall.select("cap", "room", F.col("w.index").alias("i"), *end("start", "s"), *end("end", "e"), *value("w.length", "length"), F.col("w.measured").alias("snapped")),
        "rooms": room.select("cap", rid, *value("r.floor_area", "area"), *value("r.perimeter", "perimeter"), *value("r.ceiling_height", "height")),
        "openings": opening.select("cap", "room", "o.opening", "o.kind", "o.wall", *[c for n in ("offset", "width", "height", "bottom") for c in value(f"o.{n}", n)], "o.connects_to"),
        "footprint": p.select("cap", F.col("p.footprint_area.value").alias("value"), F.col("p.footprint_area.sigma").alias("sigma")),
        "adjacency": p.select("cap", F.explode("p.adjacency").alias("a")).select("cap", F.col("a.rooms")[0].alias("room_a"), F.col("a.rooms")[1].alias("room_b")),
        "intervals": _intervals(p),
    }


def _intervals(p: DataFrame) -> DataFrame:
    """(cap, dimension, value, sigma, low, high): every measurement of a plan as it is written."""
    named = lambda name, m: F.struct(name.alias("dimension"), m.alias("m"))

    def of(r):
        room = F.concat(F.lit("room-"), r["id"].cast("string"))
        single = F.array(*[named(F.concat(room, F.lit(f"/{k}")), r[k]) for k in ("floor_area", "ceiling_height", "perimeter")])
        walls = F.transform(r["walls"], lambda w: named(F.concat(room, F.lit("/wall-"), w["index"].cast("string"), F.lit("/length")), w["length"]))
        openings = F.flatten(F.transform(r["openings"], lambda o: F.array(*[named(F.concat(room, F.lit("/opening-"), o["opening"].cast("string"), F.lit(f"/{k}")), o[k]) for k in ("width", "height")])))
        return F.concat(single, walls, openings)

    every = F.concat(F.array(named(F.lit("footprint_area"), F.col("p.footprint_area"))), F.flatten(F.transform("p.rooms", of)))
    return p.select("cap", F.explode(every).alias("x")).where("x.m is not null").select("cap", "x.dimension", "x.m.value", "x.m.sigma", F.col("x.m.ci95")[0].alias("low"), F.col("x.m.ci95")[1].alias("high"))


def read_truth(spark, path: str) -> DataFrame:
    """(cap, tier, source, exhaustive, lidar_tolerance, dimension, target) from truth files: JSON objects whose measurements map dimensions to metres.

    The capture is the file's name without its ending. A file without measurements is an error.
    """
    files = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(\.[^./]*)?$", 1).alias("cap"), "value")
    t = files.select("cap", F.from_json("value", "source string, tier string, openings_exhaustive boolean, lidar_wall_tolerance_m double, measurements map<string,double>", {"mode": "FAILFAST"}).alias("t"))
    some = F.coalesce(F.size("t.measurements") > 0, F.lit(False))
    given = F.when(some, F.col("t.measurements")).otherwise(F.raise_error(F.concat(F.lit("no measured dimensions: "), F.col("cap"))).cast("map<string,double>"))
    return t.select("cap", F.col("t.tier").alias("tier"), F.col("t.source").alias("source"), F.coalesce("t.openings_exhaustive", F.lit(False)).alias("exhaustive"), F.col("t.lidar_wall_tolerance_m").alias("lidar_tolerance"), F.explode(given).alias("dimension", "target"))


def svg(ring: DataFrame, scale: float = 40.0) -> DataFrame:
    """(cap, svg): outline of every room of a capture as one drawing."""
    point = F.format_string("%.1f,%.1f", F.col("u") * scale, F.col("v") * scale)
    shape = ring.groupBy("cap", "room").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", point.alias("p")))), lambda s: s["p"]), " ").alias("points"))
    each = shape.select("cap", "room", F.format_string('<polygon id="room-%d" points="%s" fill="none" stroke="black"/>', F.col("room").cast("long"), "points").alias("s"))
    return each.groupBy("cap").agg(F.concat(F.lit('<svg xmlns="http://www.w3.org/2000/svg">'), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("room", "s"))), lambda s: s["s"]), ""), F.lit("</svg>")).alias("svg"))


def page(documents: DataFrame) -> DataFrame:
    """(cap, html): the plan inside a script element; a closing tag in any name cannot end it."""
    safe = F.replace(F.col("plan"), F.lit("<"), F.lit("\\u003c"))
    return documents.select("cap", F.concat(F.lit('<!doctype html><meta charset="utf-8"><script id="plan" type="application/json">'), safe, F.lit("</script>")).alias("html"))


def roll_up(documents: DataFrame) -> DataFrame:
    """(cap, rooms, openings, area) over many plan documents."""
    schema = "struct<rooms:array<struct<id:long,openings:array<struct<opening:int>>>>,footprint_area:struct<value:double>>"
    p = documents.select("cap", F.from_json("plan", schema, {"mode": "FAILFAST"}).alias("p"))
    return p.select("cap", F.size("p.rooms").alias("rooms"), F.aggregate("p.rooms", F.lit(0), lambda s, r: s + F.size(r["openings"])).alias("openings"), F.col("p.footprint_area.value").alias("area"))
