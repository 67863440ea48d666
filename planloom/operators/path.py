"""Camera-path operators: order, gaps, neighbours in time, and plane residuals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planloom import constants as K

KEY = "cap"


def path_length(path: DataFrame, key: str = KEY) -> DataFrame:
    """(key, frames, length, loop_gap): frames in order of seq; the gap is from the last frame to the first."""
    w = Window.partitionBy(key).orderBy("seq")
    du, dv = F.col("u") - F.lag("u").over(w), F.col("v") - F.lag("v").over(w)
    steps = path.select(key, "seq", "u", "v", F.sqrt(du * du + dv * dv).alias("step"))
    agg = steps.groupBy(key).agg(F.count("*").alias("frames"), F.coalesce(F.sum("step"), F.lit(0.0)).alias("length"), F.min_by(F.struct("u", "v"), "seq").alias("a"), F.max_by(F.struct("u", "v"), "seq").alias("z"))
    gu, gv = F.col("z.u") - F.col("a.u"), F.col("z.v") - F.col("a.v")
    return agg.select(key, "frames", "length", F.sqrt(gu * gu + gv * gv).alias("loop_gap"))


def first_visit_order(visits: DataFrame, least: int = 1, key: str = KEY) -> DataFrame:
    """(key, label, room): labels seen in at least `least` frames, numbered from 1 by their first frame; label 0 is no room."""
    seen = visits.where("label > 0").groupBy(key, "label").agg(F.min("seq").alias("first"), F.count("*").alias("n")).where(F.col("n") >= least)
    return seen.select(key, "label", F.row_number().over(Window.partitionBy(key).orderBy("first")).alias("room"))


def room_transitions(visits: DataFrame, key: str = KEY) -> DataFrame:
    """(key, room_a, room_b): sorted pairs of rooms visited one after the other, frames without a room skipped."""
    inside = visits.where("label > 0")
    pairs = inside.select(key, "label", F.lag("label").over(Window.partitionBy(key).orderBy("seq")).alias("was")).where("was <> label")
    return pairs.select(key, F.least("label", "was").alias("room_a"), F.greatest("label", "was").alias("room_b")).distinct()


def nearest_anchor(values: DataFrame, anchors: DataFrame, gate: float = K.RESIDUAL_GATE, key: str = KEY) -> DataFrame:
    """Adds anchor and residual (anchor - value): the nearest anchor of the key, the lower one in a tie, within the gate.

    Anchors are plane positions, a bounded sorted array for each key and axis.
    """
    lists = anchors.groupBy(key).agg(F.array_sort(F.collect_set("anchor")).alias("_all"))
    best = F.array_min(F.transform("_all", lambda a: F.struct(F.abs(a - F.col("value")).alias("d"), a.alias("a"))))
    out = values.join(lists, key).withColumn("anchor", best["a"]).drop("_all").withColumn("residual", F.col("anchor") - F.col("value"))
    return out.where(F.abs("residual") < gate)


def split_residuals(residuals: DataFrame, by: tuple[str, ...], order: str, least: int = 20) -> DataFrame:
    """(*by, offset, weight, n_train, n_test): median of every other residual; none of weight below `least`."""
    k = F.row_number().over(Window.partitionBy(*by).orderBy(order)) % 2
    agg = residuals.withColumn("train", k == 1).groupBy(*by).agg(F.median(F.when(F.col("train"), F.col("residual"))).alias("m"), F.count_if("train").alias("n_train"), F.count_if(~F.col("train")).alias("n_test"))
    ok = F.col("n_train") >= least
    return agg.select(*by, F.when(ok, F.col("m")).otherwise(0.0).alias("offset"), F.when(ok, F.least(F.lit(1.0), F.col("n_train") / 200)).otherwise(0.0).alias("weight"), "n_train", "n_test")


def held_out(residuals: DataFrame, by: tuple[str, ...], order: str) -> DataFrame:
    """The residuals that split_residuals leaves out."""
    k = F.row_number().over(Window.partitionBy(*by).orderBy(order)) % 2
    return residuals.withColumn("_k", k).where("_k = 0").drop("_k")


def interpolate(frames: DataFrame, samples: DataFrame, key: str = KEY) -> DataFrame:
    """Value of each frame by linear interpolation between sampled frames; held constant beyond the first and last."""
    j = frames.join(samples.select(key, "seq", "value"), [key, "seq"], "left").withColumn("at", F.when(F.col("value").isNotNull(), F.struct("seq", "value")))
    back = Window.partitionBy(key).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(key).orderBy("seq").rowsBetween(0, Window.unboundedFollowing)
    j = j.withColumn("a", F.last("at", True).over(back)).withColumn("b", F.first("at", True).over(ahead))
    part = F.try_divide(F.col("seq") - F.col("a.seq"), F.col("b.seq") - F.col("a.seq"))
    mixed = F.col("a.value") + (F.col("b.value") - F.col("a.value")) * F.coalesce(part.cast("double"), F.lit(0.0))
    return j.select(*frames.columns, F.coalesce(mixed, F.col("a.value"), F.col("b.value")).alias("value"))


def keyframes(frames: DataFrame, key: str = KEY) -> DataFrame:
    """Every max(10, n // 160)-th frame of each capture."""
    n = frames.groupBy(key).agg(F.count("*").alias("_n"))
    return frames.join(n, key).where(F.col("seq") % F.greatest(F.lit(10), F.floor(F.col("_n") / 160)) == 0).drop("_n")


def evenly_spaced(frames: DataFrame, most: int, key: str = KEY) -> DataFrame:
    """At most `most` evenly spaced frames of each capture, first and last included."""
    n = frames.groupBy(key).agg(F.count("*").alias("_n"))
    want = F.least(F.lit(most), F.col("_n"))
    step = (F.col("_n") - 1) / F.nullif(want - 1, F.lit(0))
    at = F.transform(F.sequence(F.lit(0), (want - 1).cast("int")), lambda i: F.when(want == 1, F.lit(0)).when(i == want - 1, F.col("_n") - 1).otherwise(F.floor(i * step)).cast("long"))
    picked = n.select(key, F.explode(F.array_distinct(at)).alias("seq"))
    return frames.join(picked, [key, "seq"], "left_semi")


def runs(flags: DataFrame, by: tuple[str, ...], flag: str = "flag") -> DataFrame:
    """(*by, start, stop): half-open runs of true flags over bin numbers."""
    w = Window.partitionBy(*by).orderBy("bin")
    return flags.where(flag).select(*by, "bin", (F.col("bin") - F.row_number().over(w)).alias("g")).groupBy(*by, "g").agg(F.min("bin").alias("start"), (F.max("bin") + 1).alias("stop")).drop("g")


def close_gaps(flags: DataFrame, by: tuple[str, ...], flag: str = "flag") -> DataFrame:
    """Flags closed with a width of three: gaps of one or two bins inside are filled, never at the ends. One row a bin."""
    w = Window.partitionBy(*by).orderBy("bin")
    no = F.lit(False)
    near = F.col(flag) | F.coalesce(F.lag(flag).over(w), no) | F.coalesce(F.lead(flag).over(w), no)
    wide = flags.withColumn("_d", near)
    core = F.col("_d") & F.coalesce(F.lag("_d").over(w), no) & F.coalesce(F.lead("_d").over(w), no)
    return wide.withColumn("_c", F.col(flag) | core).drop("_d").withColumn(flag, F.col("_c")).drop("_c")


def display_offsets(components: DataFrame, gap: float = 1.5, key: str = KEY) -> DataFrame:
    """(key, component, offset): where to draw each separate component, left to right, from widths."""
    before = Window.partitionBy(key).orderBy("component").rowsBetween(Window.unboundedPreceding, -1)
    return components.select(key, "component", F.coalesce(F.sum(F.col("width") + gap).over(before), F.lit(0.0)).alias("offset"))


def majority(votes: DataFrame, group: str, choice: str, key: str = KEY) -> DataFrame:
    """(key, group, choice): the choice with the most votes in each group, the lowest in a tie."""
    n = votes.groupBy(key, group, choice).agg(F.count("*").alias("n"))
    return n.groupBy(key, group).agg(F.max_by(F.col(choice), F.struct("n", -F.col(choice))).alias(choice))


def held_out_gain(rows: DataFrame, shift: Column, key: str = KEY) -> DataFrame:
    """(key, before, after, accepted): mean absolute residual without and with the shift; accepted if at least 0.5 % better."""
    agg = rows.groupBy(key).agg(F.avg(F.abs("residual")).alias("before"), F.avg(F.abs(F.col("residual") - shift)).alias("after"))
    return agg.withColumn("accepted", F.col("after") < 0.995 * F.col("before"))
