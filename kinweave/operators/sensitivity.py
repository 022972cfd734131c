"""Distances between distributions, PAWN indices, losses, designs and searches."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinweave.functions.hashing import u
from kinweave.functions.ranking import rank_within
from kinweave.operators.bootstrap import bootstrap_indices


def finite(*names: str) -> Column:
    out = F.lit(True)
    for n in names:
        x = F.col(n).cast("double")
        out = out & x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return out


def ks_distance(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """``ks``: the largest gap of two empirical distribution functions; 1 when either is empty."""
    side = lambda d, k: d.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("v")).agg(F.count("*").alias("k")).select("v", *[F.col("k").alias(c) if c == k else F.lit(0).cast("long").alias(c) for c in ("ka", "kb")])
    both = side(a, "ka").unionByName(side(b, "kb")).groupBy("v").agg(F.sum("ka").alias("ka"), F.sum("kb").alias("kb"))
    upto = Window.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)  # one row for each distinct value
    total = both.agg(F.sum("ka").alias("na"), F.sum("kb").alias("nb"))
    cum = both.select(F.sum("ka").over(upto).alias("ca"), F.sum("kb").over(upto).alias("cb")).crossJoin(F.broadcast(total))
    gap = F.max(F.abs(F.col("ca") / F.col("na") - F.col("cb") / F.col("nb")))
    return cum.where("na > 0 and nb > 0").agg(F.coalesce(gap, F.lit(1.0)).alias("ks"))


def frobenius_distance(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``frobenius``: root of summed squared cell differences over the union of cells; 1 when both are empty."""
    j = a.select(*keys, F.col(value).alias("x")).join(b.select(*keys, F.col(value).alias("y")), keys, "full_outer")
    return j.agg(F.coalesce(F.sqrt(F.sum(F.pow(F.coalesce("x", F.lit(0.0)) - F.coalesce("y", F.lit(0.0)), 2))), F.lit(1.0)).alias("frobenius"))


def unpivot(rows: DataFrame, inputs: list[str], outputs: list[str], label: str | None = None) -> DataFrame:
    """``label, input, output, x, y`` of every finite pair."""
    name = F.col(label).cast("string") if label else F.lit("all")
    pairs = F.array(*[F.struct(F.lit(i).alias("input"), F.lit(o).alias("output"), F.col(i).cast("double").alias("x"), F.col(o).cast("double").alias("y")) for i in inputs for o in outputs])
    return rows.select(name.alias("label"), F.explode(pairs).alias("p")).select("label", "p.*").where(finite("x", "y"))


def pawn(pairs: DataFrame, slices: int = 10, statistic: str = "median", least_rows: int = 20, least_slice: int = 10, extra: tuple[str, ...] = (), edge_digits: int | None = None) -> DataFrame:
    """``label, input, output, index``: how far slices of the input move the output's distribution.

    Slices lie between linear quantiles of the input, half open, the last
    closed; small ones are skipped. ``edge_digits`` rounds the quantiles, so that
    values equal to one fall on the same side everywhere. NaN for few rows, a constant output or no slice.
    All inputs, outputs and labels are one job.
    """
    keys = ["label", "input", "output", *extra]
    quantiles = F.percentile("x", F.array(*[F.lit(i / slices) for i in range(slices + 1)]))
    quantiles = quantiles if edge_digits is None else F.transform(quantiles, lambda q: F.round(q, edge_digits))
    edges = pairs.groupBy(*keys).agg(quantiles.alias("e"), F.count("*").alias("rows"), F.stddev_pop("y").alias("sd"))
    usable = edges.where(F.col("rows") >= least_rows).where("sd > 0")
    at = pairs.join(F.broadcast(usable), keys).withColumn("slice", F.expr(f"case when x = e[{slices}] then size(filter(slice(e, 1, {slices}), q -> q <= x and q < e[{slices}])) else size(filter(slice(e, 1, {slices}), q -> q <= x)) end"))
    last_empty = F.expr(f"case when x = e[{slices}] then {slices} else slice end")
    counts = at.withColumn("slice", last_empty).groupBy(*keys, "slice", "y").agg(F.count("*").alias("k"))
    every = counts.groupBy(*keys, "y").agg(F.sum("k").alias("k"))
    upto = Window.partitionBy(*keys).orderBy("y").rowsBetween(Window.unboundedPreceding, 0)
    n = F.sum("k").over(Window.partitionBy(*keys))
    every = every.select(*keys, "y", (F.sum("k").over(upto) / n).alias("f"), ((F.sum("k").over(upto) - F.col("k")) / n).alias("f_before"))
    own = Window.partitionBy(*keys, "slice").orderBy("y").rowsBetween(Window.unboundedPreceding, 0)
    m = F.sum("k").over(Window.partitionBy(*keys, "slice"))
    sliced = counts.select(*keys, "slice", "y", m.alias("m"), (F.sum("k").over(own) / m).alias("g"), ((F.sum("k").over(own) - F.col("k")) / m).alias("g_before"))
    # A slice's own values are enough: between them its function is flat and the other only rises.
    gaps = sliced.where(F.col("m") >= least_slice).join(every, [*keys, "y"]).groupBy(*keys, "slice").agg(F.max(F.greatest(F.abs(F.col("g") - F.col("f")), F.abs(F.col("g_before") - F.col("f_before")))).alias("ks"))
    stat = {"median": F.median("ks"), "max": F.max("ks"), "mean": F.avg("ks")}[statistic]
    index = gaps.groupBy(*keys).agg(stat.alias("index"))
    return edges.select(*keys).join(index, keys, "left").select(*keys, F.coalesce("index", F.lit(float("nan"))).alias("index"))


def pawn_bootstrap(pairs: DataFrame, replicates: int = 200, seed: int = 0, **how) -> DataFrame:
    """``label, input, output, ci_lo, ci_hi``: 2.5 and 97.5 % of the index over resamples of the rows.

    ``pairs`` has ``row`` besides, a key of the row within its label, input and output.
    """
    keys = ["label", "input", "output"]
    each = bootstrap_indices(pairs, replicates, seed, **how)
    q = F.percentile("index", F.array(F.lit(0.025), F.lit(0.975)))
    return each.groupBy(*keys).agg(q[0].alias("ci_lo"), q[1].alias("ci_hi"))


def numeric_columns(rows: DataFrame, without: set[str] = frozenset()) -> list[str]:
    """Names of number columns (not booleans) outside ``without``, in their order."""
    from pyspark.sql.types import NumericType

    return [f.name for f in rows.schema.fields if isinstance(f.dataType, NumericType) and f.name not in without]


def mean_index(indices: DataFrame) -> DataFrame:
    """``label, input, mean``: a label's mean index of each input over its outputs, NaN left out; null where all are."""
    return indices.groupBy("label", "input").agg(F.avg(F.nanvl("index", F.lit(None).cast("double"))).alias("mean"))


def first_known(*columns: str) -> Column:
    """The first of several columns that is neither null nor NaN."""
    return F.coalesce(*[F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in columns])


def interleaved(rows: DataFrame, by: str, key: str, seed: int = 42) -> DataFrame:
    """``place``: round robin over the groups ``by``: everyone's place in a random order of the own group, then the group."""
    turns = rank_within(rows.withColumn("_u", u(seed, key)), [by], "_u", key, "turn").drop("_u")
    # One row for each turn: as many as the largest group has members.
    sizes = turns.groupBy("turn").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("turn").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("turn", F.coalesce(before, F.lit(0)).alias("_start"))
    own = F.row_number().over(Window.partitionBy("turn").orderBy(by))
    return turns.withColumn("_rn", own).join(starts, "turn").withColumn("place", F.col("_start") + F.col("_rn")).drop("_rn", "_start", "turn")


def top_indices(indices: DataFrame, k: int, by: str | None = "label") -> DataFrame:
    """The k largest indices, overall or for each label (NaN last)."""
    known = indices.where(~F.isnan("index"))
    if by is None:
        return known.orderBy(F.desc("index"), "input", "output").limit(k)
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("index"), "input", "output"))
    return known.withColumn("place", rank.cast("long")).where(F.col("place") <= k)


def metric_loss(values: dict[str, Column], targets: dict[str, float]) -> Column:
    """Sum of squared relative errors."""
    return sum((F.pow((values[k] - F.lit(t)) / F.lit(t), 2) for k, t in targets.items()), F.lit(0.0))


def composite_loss(pairs: dict[str, tuple[Column, Column]], weights: dict[str, float], frobenius: Column | None = None, ks: Column | None = None) -> Column:
    """Weighted squared relative differences (absolute where the target is nearly 0) and weighted distances."""
    out = F.lit(0.0)
    for k, (g, e) in pairs.items():
        out = out + F.lit(weights.get(k, 1.0)) * F.when(F.abs(e) < 1e-12, F.pow(g - e, 2)).otherwise(F.pow((g - e) / F.abs(e), 2))
    for k, c in (("mixing", frobenius), ("ks", ks)):
        out = out if c is None else out + F.lit(weights.get(k, 1.0)) * c
    return out


def latin_hypercube(spark: SparkSession, samples: int, bounds: dict[str, tuple[float, float]], seed: int = 42) -> DataFrame:
    """``sample_id`` and one column a variable: one draw in each of ``samples`` equal strata."""
    out = spark.range(samples).withColumnRenamed("id", "sample_id")
    for d, (name, (low, high)) in enumerate(bounds.items()):
        rank = F.row_number().over(Window.orderBy(u(seed + 10 * d, "sample_id"), "sample_id")) - 1  # as many rows as the design has
        out = out.withColumn(name, F.lit(float(low)) + F.lit(float(high - low)) * (rank + u(seed + 10 * d + 1, "sample_id")) / samples)
    return out


def grid(spark: SparkSession, axes: dict[str, list]) -> DataFrame:
    """Every combination of the axes' values."""
    out = None
    for name, values in axes.items():
        kind = "long" if all(isinstance(v, int) for v in values) else "double"
        axis = spark.createDataFrame([(v,) for v in values], f"`{name}` {kind}")
        out = axis if out is None else out.crossJoin(axis)
    return out


def geometric_or_linear(low: float, high: float, n: int) -> list[float]:
    """``n`` points, geometric where the range spans more than a factor of ten."""
    if low > 0 and high / low > 10:
        return [low * (high / low) ** (i / (n - 1)) for i in range(n)]
    return [low + (high - low) * i / (n - 1) for i in range(n)]


def anneal(evaluate, bounds: dict[str, tuple[float, float]], integers: set[str] = frozenset(), iterations: int = 60, t0: float = 1.0, cooling: float = 0.97, seed: int = 42) -> list[dict]:
    """Search from the midpoints by cooled gaussian moves; the trajectory, with the best loss so far.

    ``evaluate(point) -> loss`` runs Spark jobs; the loop itself holds a few numbers.
    """
    import random

    rng = random.Random(seed)
    at = {k: (lo + hi) / 2 for k, (lo, hi) in bounds.items()}
    at = {k: round(v) if k in integers else v for k, v in at.items()}
    loss = best = evaluate(at)
    trail = [{"iteration": 0, **at, "loss": loss, "accepted": True, "temperature": t0, "best": best}]
    for i in range(1, iterations + 1):
        t, new = t0 * cooling**i, {}
        for k, (lo, hi) in bounds.items():
            sigma = max(2.0, 0.1 * (hi - lo) * t) if k in integers else max(0.01 * (hi - lo), 0.15 * (hi - lo) * t)
            v = min(hi, max(lo, rng.gauss(at[k], sigma)))
            new[k] = round(v) if k in integers else v
        got = evaluate(new)
        taken = got < loss or rng.random() < math.exp(-(got - loss) / (t + 1e-12))
        if taken:
            at, loss = new, got
        best = min(best, got)
        trail.append({"iteration": i, **new, "loss": got, "accepted": taken, "temperature": t, "best": best})
    return trail


def random_search(evaluate, bounds: dict[str, tuple[float, float]], integers: set[str] = frozenset(), trials: int = 25, seed: int = 42, known: list[dict] | None = None, failed_loss: float = 1e6) -> list[dict]:
    """Independent trials at quasi-random points; earlier ones (``known``) are resumed, a failure costs ``failed_loss``."""
    steps, trail = (0.6180339887498949, 0.7548776662466927, 0.5698402909980532, 0.8191725133961645), list(known or [])
    for n in range(len(trail), trials):
        point = {}
        for d, (k, (lo, hi)) in enumerate(bounds.items()):
            v = lo + (hi - lo) * ((0.5 + (n + seed) * steps[d % len(steps)]) % 1.0)
            point[k] = round(v) if k in integers else v
        try:
            loss = float(evaluate(point))
        except Exception as e:  # a point that can't be built is a bad point
            trail.append({"trial": n, **point, "loss": failed_loss, "error": str(e)[:200]})
            continue
        trail.append({"trial": n, **point, "loss": loss})
    return trail


def mean_by_sample(metrics: DataFrame, samples: DataFrame, value: str = "value") -> DataFrame:
    """Mean of each sample's metric over labels, NaN and error rows left out, beside the sample's inputs."""
    good = metrics.where(F.col("error").isNull()).drop("error")
    means = good.groupBy("sample_id", "metric").agg(F.avg(F.nanvl(F.col(value), F.lit(None).cast("double"))).alias("mean"), F.countDistinct("label").alias("labels"))
    return samples.join(means, "sample_id")
