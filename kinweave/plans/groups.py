"""Queries over groups, budgets and their check."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinweave.functions.stats import rounded
from kinweave.operators import network as N
from kinweave.operators.allocate import cumulative_split, proportional_alloc, stratified_allocate
from kinweave.sources import fixtures as X

SCALE, TARGET_SCALE = 0.29, 0.95


def resolved(spark, sf):
    return N.resolve_pairs(X.interactions(spark, sf), X.population(spark, sf), X.ATTRIBUTES)


def budget(spark, sf, scale=TARGET_SCALE):
    return N.pair_budget(X.interactions(spark, sf), X.population(spark, sf), X.ATTRIBUTES, scale)


def actual(spark, sf):
    return N.actual_pairs(X.edges(spark, sf), X.nodes(spark, sf))


def uneven_budget(spark, sf):
    """Targets above and below what is there; some pairs have none."""
    b = budget(spark, sf)
    factor = F.lit(0.5) + F.lit(0.25) * F.pmod(F.col("src_g") * 7 + F.col("dst_g") * 3, F.lit(5))
    return b.where("(src_g + dst_g) % 11 <> 0").select("src_g", "dst_g", F.floor(F.col("target") * factor).cast("long").alias("target"))


def uneven_actual(spark, sf):
    """Some pairs have a target and no links."""
    return actual(spark, sf).where("(src_g * 3 + dst_g) % 13 <> 0")


def checked(spark, sf):
    return N.check_pairs(uneven_budget(spark, sf), uneven_actual(spark, sf))


def clusters(spark, sf):
    """Regions as clusters of groups, with their people as mass."""
    return X.population(spark, sf).groupBy("r_name").agg(F.sum("n").alias("mass"), F.min("group_id").alias("cluster_id"))


QUERIES = {
    "population_groups": lambda s, d: N.describe_groups(X.population(s, d)).select("group_id", *X.ATTRIBUTES, "n", "ord"),
    "stratified_allocation": lambda s, d: stratified_allocate(X.population(s, d), SCALE).select("group_id", "n", "alloc"),
    "node_unfold": lambda s, d: N.unfold_nodes(X.population(s, d), SCALE),
    "interaction_group_ids": resolved,
    "pair_budget": lambda s, d: budget(s, d, SCALE),
    "budget_row_normalised": lambda s, d: rounded(N.normalised(budget(s, d)).select("src_g", "dst_g", "p"), 9),
    "budget_smoothed_dense": lambda s, d: rounded(N.smoothed(budget(s, d), X.population(s, d)), 9),
    "budget_hierarchical_norm": lambda s, d: rounded(N.hierarchical_normalised(budget(s, d)).select("src_g", "dst_g", "p"), 9),
    "pair_actual": actual,
    "pair_check": lambda s, d: rounded(checked(s, d)),
    "pair_check_summary": lambda s, d: rounded(N.check_summary(checked(s, d))),
    "fulfilment_report": lambda s, d: rounded(N.fulfilment(uneven_budget(s, d), uneven_actual(s, d))),
    "unfulfilled_pairs": lambda s, d: N.unfulfilled(uneven_budget(s, d), uneven_actual(s, d)),
    "non_isolates": lambda s, d: N.non_isolates(X.nodes(s, d), X.edges(s, d), 100).select("node_id", "group_id"),
    "find_nodes": lambda s, d: N.find_nodes(X.nodes(s, d), X.population(s, d), c_mktsegment="BUILDING", r_name="ASIA").select("node_id", "group_id"),
    "proportional_alloc": lambda s, d: proportional_alloc(X.population(s, d), 60, "n", "group_id").select("group_id", "n", "size"),
    "cluster_split": lambda s, d: cumulative_split(clusters(s, d), 17).select("cluster_id", "mass", "size", "start"),
}

V = X.VIEWS_SQL


def budget_cte(scale: float) -> str:
    return f""", fl AS (SELECT *, trunc({scale}::double * n)::bigint AS a FROM pairs),
rk AS (SELECT *, row_number() OVER (ORDER BY n DESC, src_g, dst_g) AS rank, (SELECT trunc({scale}::double * sum(n))::bigint - sum(a)::bigint FROM fl) AS r FROM fl),
budget AS (SELECT src_g, dst_g, (a + CASE WHEN rank <= r THEN 1 ELSE 0 END)::bigint AS target FROM rk)
"""


B = budget_cte(TARGET_SCALE)
ALLOC = f""", fl AS (SELECT *, trunc({SCALE}::double * n)::bigint AS a, row_number() OVER (ORDER BY n DESC, group_id) AS rank, count(*) OVER () AS k FROM pop),
al AS (SELECT *, (SELECT trunc({SCALE}::double * sum(n))::bigint - sum(a)::bigint FROM fl) AS r FROM fl),
sized AS (SELECT group_id, n, rank, (a + r // k + CASE WHEN rank <= r % k THEN 1 ELSE 0 END)::bigint AS alloc FROM al)
"""
UNEVEN = """, ub AS (SELECT src_g, dst_g, floor(target * (0.5::double + 0.25::double * ((src_g * 7 + dst_g * 3) % 5)))::bigint AS target FROM budget WHERE (src_g + dst_g) % 11 <> 0),
ua AS (SELECT * FROM actual WHERE (src_g * 3 + dst_g) % 13 <> 0)
"""
CHECK = f"""{V}{B}{UNEVEN}, checked AS (SELECT src_g, dst_g, coalesce(target, 0)::bigint AS target, coalesce(actual, 0)::bigint AS actual FROM ub FULL JOIN ua USING (src_g, dst_g)),
judged AS (SELECT *, actual - target AS diff, CASE WHEN target > 0 THEN round(actual / target, 6) ELSE 'inf'::double END AS ratio,
           abs(actual - target) / greatest(target, 1) < 0.05 AS ok, (target > 0 OR actual > 0) AS visible FROM checked)
"""
MISSING = "SELECT b.src_g, b.dst_g, target, coalesce(actual, 0)::bigint AS actual FROM ub b LEFT JOIN ua USING (src_g, dst_g)"

ORACLE_SQL = {
    "population_groups": f"{V} SELECT group_id, c_mktsegment, r_name, n, row_number() OVER (ORDER BY n DESC, group_id) AS ord FROM pop",
    "stratified_allocation": f"{V}{ALLOC} SELECT group_id, n, alloc FROM sized",
    "node_unfold": f"{V}{ALLOC}, ends AS (SELECT *, (sum(alloc) OVER (ORDER BY rank))::bigint AS e FROM sized) SELECT unnest(range(e - alloc, e)) AS node_id, group_id FROM ends WHERE alloc > 0",
    "interaction_group_ids": f"{V} SELECT src_g, dst_g, n FROM pairs",
    "pair_budget": f"{V}{budget_cte(SCALE)} SELECT src_g, dst_g, target FROM budget",
    "budget_row_normalised": f"{V}{B} SELECT src_g, dst_g, round(target / (sum(target) OVER (PARTITION BY src_g) + 1e-5::double), 9) AS p FROM budget",
    "budget_smoothed_dense": f"{V}{B}, q AS (SELECT src_g, dst_g, target / (sum(target) OVER (PARTITION BY src_g) + 1e-5::double) AS p FROM budget) SELECT a.group_id AS src_g, b.group_id AS dst_g, round(CASE WHEN coalesce(p, 0) = 0 THEN 1e-5::double ELSE p END, 9) AS p FROM pop a CROSS JOIN pop b LEFT JOIN q ON q.src_g = a.group_id AND q.dst_g = b.group_id",
    "budget_hierarchical_norm": f"{V}{B}, q AS (SELECT *, sum(target) OVER (PARTITION BY src_g) AS s FROM budget) SELECT src_g, dst_g, round(target / CASE WHEN s = 0 THEN 1e-10::double ELSE s::double END, 9) AS p FROM q",
    "pair_actual": f"{V} SELECT src_g, dst_g, actual FROM actual",
    "pair_check": f"{CHECK} SELECT * FROM judged",
    "pair_check_summary": f"{CHECK} SELECT sum(target)::bigint AS target, sum(actual)::bigint AS actual, round(100.0::double * sum(actual) / greatest(sum(target), 1), 6) AS pct, count(*) FILTER (ok) AS n_ok, count(*) FILTER (NOT ok) AS n_bad FROM judged WHERE visible",
    "fulfilment_report": f"{V}{B}{UNEVEN}, m AS ({MISSING}) SELECT sum(target)::bigint AS requested, sum(actual)::bigint AS created, round(sum(actual)::double / sum(target)::double, 6) AS rate, count(*) FILTER (actual > target) AS overfulfilled FROM m",
    "unfulfilled_pairs": f"{V}{B}{UNEVEN}, m AS ({MISSING}) SELECT *, target - actual AS missing FROM m WHERE target > 0 AND actual < target",
    "non_isolates": f"{V} SELECT node_id, group_id FROM nodes WHERE node_id IN (SELECT src FROM edges UNION SELECT dst FROM edges) ORDER BY node_id LIMIT 100",
    "find_nodes": f"{V} SELECT node_id, group_id FROM nodes JOIN pop USING (group_id) WHERE c_mktsegment = 'BUILDING' AND r_name = 'ASIA'",
    "proportional_alloc": f"{V}, f AS (SELECT group_id, n, n / sum(n) OVER () * 60 AS f FROM pop), z AS (SELECT *, greatest(1, floor(f))::bigint AS s, row_number() OVER (ORDER BY f - floor(f) DESC, group_id) AS rn FROM f) SELECT group_id, n, (s + CASE WHEN rn <= 60 - (SELECT sum(s) FROM z) THEN 1 ELSE 0 END)::bigint AS size FROM z",
    "cluster_split": f"""{V}, cl AS (SELECT min(group_id) AS cluster_id, sum(n)::bigint AS mass FROM pop GROUP BY r_name),
cu AS (SELECT *, floor(17.0::double * sum(mass) OVER (ORDER BY cluster_id) / sum(mass) OVER () + 1e-9::double)::bigint AS cum FROM cl),
ct AS (SELECT *, greatest(1, cum - coalesce(lag(cum) OVER (ORDER BY cluster_id), 0)) AS s, row_number() OVER (ORDER BY mass DESC, cluster_id) - 1 AS rn, count(*) OVER () AS k FROM cu),
gp AS (SELECT *, (17 - sum(s) OVER ())::bigint AS gap FROM ct),
fx AS (SELECT cluster_id, mass, (CASE WHEN gap >= 0 THEN s + gap // k + CASE WHEN rn < gap % k THEN 1 ELSE 0 END
       ELSE s - least(s - 1, (-gap) // k + CASE WHEN rn < (-gap) % k THEN 1 ELSE 0 END) END)::bigint AS size FROM gp)
SELECT *, (sum(size) OVER (ORDER BY cluster_id) - size)::bigint AS start FROM fx""",
}
