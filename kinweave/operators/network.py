"""Groups, nodes, budgets and the check of actual links against them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinweave.operators.allocate import scaled_budget, stratified_allocate


def describe_groups(pop: DataFrame, count: str = "n") -> DataFrame:
    """Groups with ``ord``, their place by descending count (ties by id)."""
    return pop.withColumn("ord", F.row_number().over(Window.orderBy(F.col(count).desc(), "group_id")).cast("long"))


def unfold_nodes(pop: DataFrame, scale: float = 1.0) -> DataFrame:
    """``node_id, group_id``: scaled people, numbered from 0 group by group in descending count."""
    sized = describe_groups(stratified_allocate(pop, scale))
    end = F.sum("alloc").over(Window.orderBy("ord").rowsBetween(Window.unboundedPreceding, 0))
    ranges = sized.where("alloc >= 0").select("group_id", "alloc", (end - F.col("alloc")).alias("first"))
    kept = ranges.where("alloc > 0")
    return kept.select(F.explode(F.sequence("first", F.col("first") + F.col("alloc") - 1)).alias("node_id"), "group_id")


def resolve_pairs(inter: DataFrame, pop: DataFrame, attrs: list[str], src: str = "_src", dst: str = "_dst", link: str = "n") -> DataFrame:
    """``src_g, dst_g, n`` of each interaction row whose two sides are known groups; null attributes match null."""
    out = inter
    for side, name in ((src, "src_g"), (dst, "dst_g")):
        g = pop.select(F.col("group_id").alias(name), *[F.col(a).alias(f"_{a}{side}") for a in attrs])
        same = reduce(lambda x, y: x & y, (F.col(a + side).eqNullSafe(F.col(f"_{a}{side}")) for a in attrs))
        out = out.join(g, same)
    return out.select("src_g", "dst_g", F.col(link).cast("long").alias("n"))


def unresolved_pairs(inter: DataFrame, pop: DataFrame, attrs: list[str], src: str = "_src", dst: str = "_dst") -> DataFrame:
    """Interaction rows with a side that is no known group."""
    sides = [reduce(lambda x, y: x & y, (inter[a + s].eqNullSafe(pop[a]) for a in attrs)) for s in (src, dst)]
    bad = [inter.join(pop.select(*attrs), on, "left_anti") for on in sides]
    return bad[0].union(bad[1]).distinct()


def pair_budget(inter: DataFrame, pop: DataFrame, attrs: list[str], scale: float = 1.0, **names) -> DataFrame:
    """``src_g, dst_g, target``: duplicate pairs are added, then scaled so that the total is exact."""
    sums = resolve_pairs(inter, pop, attrs, **names).groupBy("src_g", "dst_g").agg(F.sum("n").alias("n"))
    return scaled_budget(sums, scale)


def normalised(budget: DataFrame, epsilon: float = 1e-5, value: str = "target") -> DataFrame:
    """``p``: each budget over its row sum plus epsilon."""
    row = F.sum(value).over(Window.partitionBy("src_g"))
    return budget.withColumn("p", F.col(value) / (row + F.lit(epsilon)))


def smoothed(budget: DataFrame, groups: DataFrame, epsilon: float = 1e-5) -> DataFrame:
    """``src_g, dst_g, p`` for every two groups; absent and zero cells are epsilon."""
    ids = groups.select(F.col("group_id").alias("src_g"))
    grid = ids.crossJoin(groups.select(F.col("group_id").alias("dst_g")))  # the dense matrix is what is asked for
    p = normalised(budget, epsilon).select("src_g", "dst_g", "p")
    return grid.join(p, ["src_g", "dst_g"], "left").select("src_g", "dst_g", F.when(F.coalesce("p", F.lit(0.0)) == 0, F.lit(epsilon)).otherwise(F.col("p")).alias("p"))


def hierarchical_normalised(budget: DataFrame) -> DataFrame:
    """``p``: over the row sum, where a zero sum counts as 1e-10."""
    row = F.sum("target").over(Window.partitionBy("src_g"))
    return budget.withColumn("p", F.col("target") / F.when(row == 0, F.lit(1e-10)).otherwise(row.cast("double")))


def actual_pairs(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``src_g, dst_g, actual``: links of each pair of groups; endpoints without a group are skipped."""
    s = nodes.select(F.col("node_id").alias("src"), F.col("group_id").alias("src_g"))
    d = nodes.select(F.col("node_id").alias("dst"), F.col("group_id").alias("dst_g"))
    return edges.join(s, "src").join(d, "dst").groupBy("src_g", "dst_g").agg(F.count("*").alias("actual"))


def check_pairs(budget: DataFrame, actual: DataFrame) -> DataFrame:
    """Targets against actual links over the pairs of either side: difference, ratio, and whether within 5 %."""
    both = budget.join(actual, ["src_g", "dst_g"], "full_outer").select("src_g", "dst_g", F.coalesce("target", F.lit(0)).alias("target"), F.coalesce("actual", F.lit(0)).alias("actual"))
    diff = F.col("actual") - F.col("target")
    ratio = F.when(F.col("target") > 0, F.col("actual") / F.col("target")).otherwise(F.lit(float("inf")))
    return both.withColumns({"diff": diff, "ratio": ratio, "ok": F.abs(diff) / F.greatest("target", F.lit(1)) < 0.05}).withColumn("visible", (F.col("target") > 0) | (F.col("actual") > 0))


def check_summary(checked: DataFrame) -> DataFrame:
    """Totals and counts of visible pairs."""
    v = checked.where("visible")
    t, a = F.coalesce(F.sum("target"), F.lit(0)), F.coalesce(F.sum("actual"), F.lit(0))
    return v.agg(t.alias("target"), a.alias("actual"), (100.0 * a / F.greatest(t, F.lit(1))).alias("pct"), F.count_if("ok").alias("n_ok"), F.count_if(~F.col("ok")).alias("n_bad"))


def fulfilment(budget: DataFrame, actual: DataFrame) -> DataFrame:
    """Requested and created links, the rate, and how many pairs are over their target."""
    j = budget.join(actual, ["src_g", "dst_g"], "left").withColumn("actual", F.coalesce("actual", F.lit(0)))
    return j.agg(F.sum("target").alias("requested"), F.sum("actual").alias("created"), (F.sum("actual") / F.sum("target")).alias("rate"), F.count_if(F.col("actual") > F.col("target")).alias("overfulfilled"))


def unfulfilled(budget: DataFrame, actual: DataFrame) -> DataFrame:
    """Pairs that still lack links, and how many."""
    j = budget.join(actual, ["src_g", "dst_g"], "left").withColumn("actual", F.coalesce("actual", F.lit(0)))
    return j.where("target > 0 and actual < target").select("src_g", "dst_g", "target", "actual", (F.col("target") - F.col("actual")).alias("missing"))


def find_nodes(nodes: DataFrame, pop: DataFrame, **attrs) -> DataFrame:
    """Nodes of the group with these attributes; an unknown group raises KeyError."""
    group = pop.where(reduce(lambda x, y: x & y, (F.col(k).eqNullSafe(F.lit(v)) for k, v in attrs.items())))
    if group.isEmpty():
        raise KeyError(f"no group has {attrs}")
    return nodes.join(F.broadcast(group.select("group_id")), "group_id", "left_semi")


def non_isolates(candidates: DataFrame, edges: DataFrame, limit: int = 0, order: str = "node_id") -> DataFrame:
    """Candidates with a link, in order, at most ``limit`` of them (0: all)."""
    ends = edges.select(F.col("src").alias("node_id")).union(edges.select(F.col("dst").alias("node_id"))).distinct()
    out = candidates.join(ends, "node_id", "left_semi")
    return out.orderBy(order).limit(limit) if limit else out
