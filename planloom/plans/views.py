"""Deterministic stand-ins for captures, computed alike in Spark and in SQL from the sample tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Point cloud of eight captures from lineitem; one third of the points are horizontal."""
    k = F.col("l_linenumber") % 3
    return read(spark, sf_dir, "lineitem").select(
        (F.col("l_suppkey") % 8).alias("cap"),
        (F.col("l_quantity") / 5).alias("x"),
        (F.col("l_extendedprice") / 40000).alias("y"),
        (F.col("l_tax") * 50 + F.col("l_discount") * 10 + 0.0).alias("z"),
        *[F.when(k == i, 1.0).otherwise(0.0).alias(n) for i, n in ((0, "nx"), (1, "ny"), (2, "nz"))],
    )


POINTS = """pts AS (SELECT l_suppkey % 8 AS cap, l_quantity / 5 AS x, l_extendedprice / 40000 AS y,
  l_tax * 50 + l_discount * 10 + 0.0 AS z, CASE WHEN l_linenumber % 3 = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS nx,
  CASE WHEN l_linenumber % 3 = 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS ny,
  CASE WHEN l_linenumber % 3 = 2 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS nz FROM lineitem)"""


def oriented(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points with arbitrary unit normals from embeddings."""
    e = F.col("embedding")
    n = [e[i].cast("double") for i in (3, 4, 5)]
    size = F.sqrt(n[0] * n[0] + n[1] * n[1] + n[2] * n[2])
    return read(spark, sf_dir, "embeddings").select(
        F.col("label").alias("cap"), "vec_id", *[e[i].cast("double").alias(c) for i, c in enumerate("xyz")], *[(v / size).alias(c) for v, c in zip(n, ("nx", "ny", "nz"))]
    )


ORIENTED = """e0 AS (SELECT label AS cap, vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z,
  embedding[4]::DOUBLE AS a, embedding[5]::DOUBLE AS b, embedding[6]::DOUBLE AS c FROM embeddings),
ori AS (SELECT cap, vec_id, x, y, z, a / sqrt(a*a + b*b + c*c) AS nx, b / sqrt(a*a + b*b + c*c) AS ny, c / sqrt(a*a + b*b + c*c) AS nz FROM e0)"""


def trajectory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Camera paths from events: one capture a user, in time order."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return read(spark, sf_dir, "events").select(
        F.col("user_id").alias("cap"), (F.row_number().over(w) - 1).cast("long").alias("seq"), "event_id", (F.col("value") / 100).alias("u"), ((F.col("event_id") % 97) / 10).alias("v")
    )


TRAJECTORY = """traj AS (SELECT user_id AS cap, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq, event_id,
  value / 100 AS u, (event_id % 97) / 10 AS v FROM events)"""


def rooms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rectangular rooms from orders: a capture for every forty keys."""
    k = F.col("o_orderkey")
    return read(spark, sf_dir, "orders").select(
        F.floor(k / 40).alias("cap"), k.alias("room"), (k % 17).cast("double").alias("x0"), (k % 13).cast("double").alias("y0"), (1 + k % 5).cast("double").alias("w"), (1 + k % 7).cast("double").alias("h")
    )


ROOMS = """rooms AS (SELECT o_orderkey // 40 AS cap, o_orderkey AS room, (o_orderkey % 17)::DOUBLE AS x0, (o_orderkey % 13)::DOUBLE AS y0,
  (1 + o_orderkey % 5)::DOUBLE AS w, (1 + o_orderkey % 7)::DOUBLE AS h FROM orders)"""


def ring(rooms_df: DataFrame) -> DataFrame:
    """(cap, room, i, u, v): corners of each room, counter-clockwise."""
    corners = F.array(*[F.struct(F.lit(i).alias("i"), (F.col("x0") + a * F.col("w")).alias("u"), (F.col("y0") + b * F.col("h")).alias("v")) for i, (a, b) in enumerate(((0, 0), (1, 0), (1, 1), (0, 1)))])
    return rooms_df.select("cap", "room", F.explode(corners).alias("k")).select("cap", "room", "k.i", "k.u", "k.v")


RING = """ring AS (SELECT cap, room, i, x0 + a * w AS u, y0 + b * h AS v FROM rooms,
  (VALUES (0, 0, 0), (1, 1, 0), (2, 1, 1), (3, 0, 1)) AS k(i, a, b))"""
