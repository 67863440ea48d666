"""View matching and damage regions as relational operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def knn_ratio_match(queries: DataFrame, train: DataFrame, ratio: float = 0.78) -> DataFrame:
    """(pair, q_id, t_id, distance): nearest train descriptor of each query whose second nearest is clearly farther.

    Both sides have (pair, id, descriptor array<double>); descriptors are compared only within a view pair, whose
    keypoint count is bounded by the detector. Ties go to the smaller id.
    """
    a = queries.select("pair", F.col("id").alias("q_id"), F.col("descriptor").alias("qd"))
    b = train.select("pair", F.col("id").alias("t_id"), F.col("descriptor").alias("td"))
    d = F.sqrt(F.aggregate(F.zip_with("qd", "td", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    near = a.join(b, "pair").select("pair", "q_id", "t_id", d.alias("distance"))
    w = Window.partitionBy("pair", "q_id").orderBy("distance", "t_id")
    two = near.withColumn("k", F.row_number().over(w)).where("k <= 2").withColumn("second", F.lead("distance").over(w))
    return two.where((F.col("k") == 1) & (F.col("distance") < ratio * F.col("second"))).select("pair", "q_id", "t_id", "distance")


def accepted_edges(edges: DataFrame, least_matches: int = 12, least_inliers: int = 10, share: float = 0.2, farthest: float = 8.0) -> DataFrame:
    """View pairs whose geometry is trustworthy: enough matches and inliers, spread over the image, small residual, no leap."""
    ok = (F.col("matches") >= least_matches) & (F.col("inliers") >= least_inliers) & (F.col("inliers") >= share * F.col("matches"))
    ok = ok & (F.col("bbox_share") >= 0.02) & (F.col("residual") <= F.greatest(F.lit(0.6), 0.3 * F.col("median_z"))) & (F.col("distance") <= farthest)
    return edges.where(ok)


def view_pairs(views: DataFrame, most_all: int = 32, gap: int = 3) -> DataFrame:
    """(cap, i, j, learned): pairs i < j of each capture, and whether the costly matcher should run on them."""
    n = views.groupBy("cap").agg(F.count("*").alias("n"))
    a, b = views.select("cap", "tier", F.col("view").alias("i")), views.select("cap", F.col("view").alias("j"))
    pairs = a.join(b, "cap").where("i < j").join(n, "cap")
    return pairs.select("cap", "i", "j", (((F.col("tier") == "photos") & (F.col("n") <= most_all)) | (F.col("j") - F.col("i") <= gap)).alias("learned"))


def wall_of_region(pixels: DataFrame, walls: DataFrame, reach: float, least: int = 12) -> DataFrame:
    """(cap, region, room, wall, n): the wall with the most pixels of a damage region close in front of it.

    `pixels` has (cap, region, u, v, h); `walls` has (cap, room, wall, su, sv, eu, ev, length). The first room and wall win ties.
    """
    j = pixels.where("h > 0").join(walls, "cap")
    du, dv = (F.col("eu") - F.col("su")) / F.col("length"), (F.col("ev") - F.col("sv")) / F.col("length")
    pu, pv = F.col("u") - F.col("su"), F.col("v") - F.col("sv")
    along, off = pu * du + pv * dv, F.abs(pv * du - pu * dv)
    hit = j.where((off < reach) & (along > 0) & (along < F.col("length")))
    n = hit.groupBy("cap", "region", "room", "wall").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    k = F.row_number().over(Window.partitionBy("cap", "region").orderBy(F.desc("n"), "room", "wall"))
    return n.withColumn("k", k).where("k = 1").drop("k")


def damage_groups(regions: DataFrame) -> DataFrame:
    """(cap, surface_id, class, score, evidence, damage_id): regions of one surface and class, numbered in order."""
    g = regions.groupBy("cap", "surface_id", "class").agg(F.max("score").alias("score"), F.array_join(F.array_sort(F.collect_set("evidence")), ",").alias("evidence"))
    n = F.row_number().over(Window.partitionBy("cap").orderBy("surface_id", "class"))
    return g.withColumn("damage_id", F.concat(F.lit("damage-"), n.cast("string")))


def damage_mask(scores: DataFrame, least: float = 0.55, margin: float = 0.15) -> DataFrame:
    """(…, class): pixels whose class score is high and clearly above that of a clean surface."""
    s = scores.select("*", F.explode(F.array(*[F.struct(F.lit(c).alias("class"), F.col(c).alias("score")) for c in ("water_stain", "crack")])).alias("k"))
    return s.where((F.col("k.score") > least) & (F.col("k.score") > F.col("clean") + margin)).select(*[c for c in scores.columns if c not in ("water_stain", "crack", "clean")], "k.class", "k.score")
