"""Exact integer allocation: stratified, by largest fraction, by cumulative mass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinweave.functions.ranking import rank_descending


def stratified_allocate(items: DataFrame, scale: float, n: str = "n", key: str = "group_id") -> DataFrame:
    """``alloc`` beside each item: floor(scale*n), the remainder to the largest items, round robin.

    The allocations sum to floor(scale * total). ``scale`` is a double.
    """
    s = F.lit(float(scale))
    floors = items.withColumn("_a", (s * F.col(n)).cast("long"))
    total = floors.agg(F.sum(n).alias("_t"), F.sum("_a").alias("_s"), F.count("*").alias("_k"))
    total = total.select(((s * F.col("_t")).cast("long") - F.col("_s")).alias("_r"), "_k")
    ranked = rank_descending(floors, n, key, key, "_rank").crossJoin(F.broadcast(total))  # one row
    extra = F.floor(F.col("_r") / F.col("_k")) + (F.col("_rank") <= F.col("_r") % F.col("_k")).cast("long")
    return ranked.withColumn("alloc", (F.col("_a") + extra).cast("long")).drop("_a", "_rank", "_r", "_k")


def scaled_budget(pairs: DataFrame, scale: float) -> DataFrame:
    """``src_g, dst_g, target``: floor(scale*n), one more for the largest pairs until the scaled total is met."""
    s = F.lit(float(scale))
    floors = pairs.withColumn("_a", (s * F.col("n")).cast("long"))
    rest = floors.agg(((s * F.sum("n")).cast("long") - F.sum("_a")).alias("_r"))
    ranked = rank_descending(floors, "n", "src_g", "dst_g", "_rank").crossJoin(F.broadcast(rest))
    return ranked.select("src_g", "dst_g", (F.col("_a") + (F.col("_rank") <= F.col("_r")).cast("long")).alias("target"))


def proportional_alloc(items: DataFrame, total: int, weight: str, key: str) -> DataFrame:
    """``size`` of each item: at least 1, proportional to weight, what is left to the largest fractions."""
    sums = items.agg(F.sum(weight).cast("double").alias("_w"), F.count("*").alias("_k"))
    x = items.crossJoin(F.broadcast(sums))
    share = F.when(F.col("_w") > 0, F.col(weight) / F.col("_w") * total).otherwise(F.lit(float(total)) / F.col("_k"))
    x = x.withColumn("_f", share).withColumn("_s", F.greatest(F.lit(1), F.floor("_f")).cast("long"))
    left = x.agg((F.lit(total) - F.sum("_s")).alias("_left"))
    by = Window.orderBy((F.col("_f") - F.floor("_f")).desc(), key)
    x = x.withColumn("_rn", F.row_number().over(by)).crossJoin(F.broadcast(left))
    return x.withColumn("size", F.col("_s") + (F.col("_rn") <= F.col("_left")).cast("long")).drop("_w", "_k", "_f", "_s", "_left", "_rn")


def cumulative_split(clusters: DataFrame, total: int, mass: str = "mass", key: str = "cluster_id") -> DataFrame:
    """``size`` and ``start`` of each cluster: cuts of the running mass, at least 1, repaired by mass order."""
    everything = Window.orderBy(key)
    upto = everything.rowsBetween(Window.unboundedPreceding, 0)
    all_mass = clusters.agg(F.greatest(F.sum(mass), F.lit(1)).cast("double").alias("_m"), F.count("*").alias("_k"))
    x = clusters.crossJoin(F.broadcast(all_mass))
    x = x.withColumn("_cum", F.floor(F.lit(float(total)) * F.sum(mass).over(upto) / F.col("_m") + 1e-9).cast("long"))
    cut = F.col("_cum") - F.coalesce(F.lag("_cum").over(everything), F.lit(0))
    x = x.withColumn("_s", F.when(F.col("_k") < total, F.greatest(F.lit(1), cut)).otherwise(F.lit(1)))
    gap = x.agg((F.lit(total) - F.sum("_s")).alias("_gap"))
    x = x.crossJoin(F.broadcast(gap)).withColumn("_rn", F.row_number().over(Window.orderBy(F.col(mass).desc(), key)) - 1)
    more = F.floor(F.col("_gap") / F.col("_k")) + (F.col("_rn") < F.col("_gap") % F.col("_k")).cast("long")
    fewer = F.least(F.col("_s") - 1, F.floor(-F.col("_gap") / F.col("_k")) + (F.col("_rn") < (-F.col("_gap")) % F.col("_k")).cast("long"))
    size = F.when(F.col("_k") >= total, F.lit(1)).when(F.col("_gap") >= 0, F.col("_s") + more).otherwise(F.col("_s") - fewer).cast("long")
    x = x.withColumn("size", size)
    return x.withColumn("start", F.sum("size").over(upto) - F.col("size")).drop("_m", "_k", "_cum", "_s", "_gap", "_rn")
