"""Searches for the parameters whose network comes nearest to stated targets; every search resumes where it stopped."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave import api
from kinweave.operators import contagion
from kinweave.operators import metrics as M
from kinweave.operators.sensitivity import anneal, grid, metric_loss, random_search
from kinweave.sources import sinks

# Measured on the real network that generated ones are held against.
TARGETS = {"transitivity": 0.4941, "modularity": 0.8774, "skew": 7.0774}
BOUNDS = {"n_communities": (1, 35000), "attachment": (0.0, 1.0), "transitivity": (0.0, 1.0)}
INTEGERS = {"n_communities"}


def measures(nodes: DataFrame, edges: DataFrame, membership: DataFrame) -> DataFrame:
    """One row: ``transitivity``, ``modularity`` of the communities, ``skew`` of total degrees."""
    parts = [
        M.global_clustering(edges).select("transitivity"),
        M.modularity(edges, membership, "community_id").select("modularity"),
        M.degrees(nodes, edges).agg(F.skewness("degree").alias("skew")),
    ]
    return parts[0].crossJoin(parts[1]).crossJoin(parts[2])  # one row each


def evaluation(nodes: DataFrame, edges: DataFrame, membership: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """The measures of a network and its ``loss``: the sum of squared relative errors; null where a measure is undefined."""
    targets = targets or TARGETS
    return measures(nodes, edges, membership).withColumn("loss", metric_loss({k: F.col(k) for k in targets}, targets))


def evaluate(net: api.Network, point: dict, targets: dict[str, float] | None = None, mode: str = "capacity", refine_rounds: int = 10, seed: int = 42) -> dict:
    """One evaluation: communities, links, measures and loss at a point (``n_communities`` and any of the link rates)."""
    rates = {k: point[k] for k in ("attachment", "reciprocity", "transitivity", "bridge") if k in point}
    made = api.create_communities(replace(net), min(int(point["n_communities"]), max(1, net.nodes.count())), mode, seed, refine_rounds)
    made = api.generate(made, seed=seed, **rates)
    row = evaluation(made.nodes, made.edges, made.membership, targets).first().asDict()
    if row["loss"] is None:
        raise ValueError(f"no loss at {point}: {row}")
    return row


def calibrate(net: api.Network, out: str, bounds: dict | None = None, iterations: int = 60, **how) -> dict:
    """Annealed search from the middle of the bounds; trajectory and best step are written to ``out``."""
    spark, known = net.nodes.sparkSession, sinks.Trials(net.nodes.sparkSession, f"{out}/steps")
    earlier = {json.dumps(t["point"], sort_keys=True): t["loss"] for t in known.known()}

    def loss(point: dict) -> float:
        # The moves are drawn from a fixed seed: a search that starts again meets the steps it has done.
        key = json.dumps(point, sort_keys=True)
        if key not in earlier:
            earlier[key] = evaluate(net, point, **how)["loss"]
            known.add({"trial": len(earlier) - 1, "point": point, "loss": earlier[key]})
        return earlier[key]

    return sinks.write_trajectory(spark, anneal(loss, bounds or BOUNDS, INTEGERS, iterations), out)


def search(net: api.Network, out: str, bounds: dict | None = None, trials: int = 25, **how) -> dict:
    """Independent trials, each written as it ends; a point that can't be built costs a million."""
    spark, store = net.nodes.sparkSession, sinks.Trials(net.nodes.sparkSession, f"{out}/trials")
    trail = store.known()
    while len(trail) < trials:
        trail = random_search(lambda p: evaluate(net, p, **how)["loss"], bounds or BOUNDS, INTEGERS, len(trail) + 1, known=trail)
        store.add(trail[-1])
    return sinks.write_trajectory(spark, trail, out)


def pilot_grid(net: api.Network, axes: dict[str, list], out: str, **how) -> DataFrame:
    """Every point of a grid that has no result yet is evaluated and appended; the results of all."""
    spark = net.nodes.sparkSession
    points = grid(spark, axes)
    todo = sinks.missing_keys(points, spark.read.parquet(out), points.columns) if sinks.exists(spark, out) else points
    for r in todo.orderBy(*points.columns).collect():  # a grid's points are parameters, not data
        point = r.asDict()
        got = evaluate(net, point, **how)
        # A rate may be called like a measure: measures are named as such.
        told = {**point, **{f"measured_{k}": float(v) for k, v in got.items() if k != "loss"}, "loss": float(got["loss"])}
        kinds = {f.name: f.dataType.simpleString() for f in points.schema.fields}
        rows = spark.createDataFrame([tuple(told.values())], ", ".join(f"`{k}` {kinds.get(k, 'double')}" for k in told))
        sinks.append_results(rows, out, points.columns)
    return spark.read.parquet(out)


def best_row(results: DataFrame, by: str = "loss") -> DataFrame:
    """The row of the least loss (ties: the least of the other columns, in order); unknown losses never win."""
    keys = [c for c in results.columns if c != by]
    return results.where(F.col(by).isNotNull() & ~F.isnan(F.col(by).cast("double"))).orderBy(by, *keys).limit(1)


def contagion_study(networks: list[tuple[str, DataFrame, DataFrame]], out: str, thresholds: list[float], ways: dict[str, Callable[[DataFrame, DataFrame], DataFrame]], fractional: bool = True) -> DataFrame:
    """Mean and variance of final adoption for each network, seeding and threshold; networks with a result are left out.

    ``networks`` has (name, nodes, edges); ``ways`` maps a name to seeds of (nodes, edges).
    """
    spark: SparkSession = networks[0][1].sparkSession
    keys = ["network", "seeding", "threshold"]
    for name, nodes, edges in networks:
        for way, seed in ways.items():
            wanted = spark.createDataFrame([(name, way, float(t)) for t in thresholds], "network string, seeding string, threshold double")
            left = sinks.missing_keys(wanted, spark.read.parquet(out), keys) if sinks.exists(spark, out) else wanted
            taus = [r["threshold"] for r in left.collect()]
            if taus:
                told = contagion.summary(contagion.spread(nodes, edges, seed(nodes, edges), taus, fractional))
                sinks.append_results(told.select(F.lit(name).alias("network"), F.lit(way).alias("seeding"), "threshold", "mean_final", "variance_final", "sims"), out, keys)
    return spark.read.parquet(out)
