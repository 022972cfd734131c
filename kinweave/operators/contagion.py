"""Threshold contagion: synchronous adoption, all thresholds and simulations in one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.functions.hashing import u
from kinweave.functions.ranking import rank_within
from kinweave.scratch import checkpoint


def seed_random(nodes: DataFrame, sims: int, k: int, base_seed: int = 0) -> DataFrame:
    """``sim, node_id``: k random nodes for each simulation."""
    drawn = nodes.select("node_id", F.explode(F.sequence(F.lit(0), F.lit(sims - 1))).alias("sim"))
    drawn = drawn.withColumn("x", u(base_seed, "sim", "node_id"))
    return rank_within(drawn, ["sim"], "x", "node_id").where(F.col("rank") <= k).select("sim", "node_id")


def seed_neighbors(nodes: DataFrame, edges: DataFrame, sims: int, k: int | None, base_seed: int = 0) -> DataFrame:
    """``sim, node_id``: a random focal node and its out-neighbours, all (None) or k of them.

    A focal node has at least k out-links; it is an error if none has.
    """
    out = edges.groupBy("src").agg(F.count("*").alias("d"))
    able = out.where(F.col("d") >= (k or 0)).select(F.col("src").alias("node_id"))
    if able.isEmpty():
        raise ValueError(f"no node has {k} out-neighbours")
    focal = seed_random(able, sims, 1, base_seed)
    near = edges.join(focal.withColumnRenamed("node_id", "src"), "src").select("sim", F.col("dst").alias("node_id"))
    if k is not None:
        near = rank_within(near.withColumn("x", u(base_seed + 1, "sim", "node_id")), ["sim"], "x", "node_id").where(F.col("rank") <= k).select("sim", "node_id")
    return focal.unionByName(near).distinct()


def spread(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, thresholds: list[float], fractional: bool, max_steps: int = 10_000) -> DataFrame:
    """``threshold, sim, node_id, step``: when each node adopted (seeds at 0); others have no row.

    Repeated links, or a column ``w``, are weights. A node listens to its out-neighbours. It adopts when their infected weight
    is at least the threshold, or, if ``fractional``, when that weight over its
    out-weight is. Only new adopters are joined; counts of earlier ones are kept.
    """
    spark = edges.sparkSession
    weighted = edges.groupBy("src", "dst").agg((F.sum("w") if "w" in edges.columns else F.count("*")).alias("w"))
    degree = weighted.groupBy("src").agg(F.sum("w").alias("degree"))
    links = checkpoint(weighted.join(degree, "src").select("src", "dst", "w", "degree"))
    taus = spark.createDataFrame([(float(t),) for t in thresholds], "threshold double")
    infected = checkpoint(seeds.join(nodes.select("node_id"), "node_id", "left_semi").distinct().crossJoin(F.broadcast(taus)).select("threshold", "sim", "node_id", F.lit(0).alias("step")))
    fresh, heard = infected, None
    level: Column = F.col("heard") / F.col("degree") if fractional else F.col("heard")
    keys = ["threshold", "sim", "node_id"]
    for step in range(1, max_steps + 1):
        got = links.join(fresh.select("threshold", "sim", F.col("node_id").alias("dst")), "dst").groupBy("threshold", "sim", F.col("src").alias("node_id")).agg(F.sum("w").alias("heard"), F.first("degree").alias("degree"))
        summed = got if heard is None else heard.unionByName(got).groupBy(*keys).agg(F.sum("heard").alias("heard"), F.first("degree").alias("degree"))
        heard = checkpoint(summed.join(infected.select(*keys), keys, "left_anti"))
        fresh = checkpoint(heard.where(level >= F.col("threshold")).select(*keys, F.lit(step).alias("step")))
        if fresh.isEmpty():
            break
        infected = checkpoint(infected.unionByName(fresh))
    return infected


def series(infected: DataFrame) -> DataFrame:
    """``threshold, sim, step, infected``: adopters up to each step; a run that stopped repeats its last count."""
    new = infected.groupBy("threshold", "sim", "step").agg(F.count("*").alias("new"))
    last = new.agg(F.max("step").alias("last"))
    grid = new.select("threshold", "sim").distinct().crossJoin(F.broadcast(last)).select("threshold", "sim", F.explode(F.sequence(F.lit(0), "last")).alias("step"))
    from pyspark.sql.window import Window

    upto = Window.partitionBy("threshold", "sim").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    full = grid.join(new, ["threshold", "sim", "step"], "left")
    return full.select("threshold", "sim", "step", F.sum(F.coalesce("new", F.lit(0))).over(upto).alias("infected"))


def summary(infected: DataFrame) -> DataFrame:
    """Mean and population variance of the final adoption at each threshold, over simulations."""
    final = infected.groupBy("threshold", "sim").agg(F.count("*").alias("final"))
    return final.groupBy("threshold").agg(F.avg("final").alias("mean_final"), F.var_pop("final").alias("variance_final"), F.count("*").alias("sims"))
