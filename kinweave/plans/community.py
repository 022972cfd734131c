"""Queries over communities and edge creation."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinweave.functions.hashing import normal_sql, u_sql
from kinweave.functions.stats import rounded
from kinweave.operators import communities as C
from kinweave.operators import edges as E
from kinweave.plans.groups import B, budget
from kinweave.sources import fixtures as X

K, SEED, WINDOW = X.COMMUNITIES, 42, 5


def fast(s, d):
    return C.assign_fast(X.nodes(s, d), K, SEED)


def placed(s, d):
    return C.coordinates(X.membership(s, d), SEED)


def ring(s, d):
    """The communities of group 0 that are nearest to every person."""
    p = placed(s, d)
    return C.ring_nearest(p.select("node_id", "theta", F.lit(0).cast("long").alias("group_id")), C.centroids(p).where("group_id = 0"), WINDOW)


def targets(s, d):
    total = X.nodes(s, d).agg(F.count("*").alias("n"))
    kinds = [C.size_targets(total, K, k, e).select(F.lit(k).alias("law"), F.lit(e).alias("exact"), F.col("rank").cast("long").alias("rank"), "target") for k in ("powerlaw", "uniform") for e in (False, True)]
    out = kinds[0]
    for x in kinds[1:]:
        out = out.unionAll(x)
    return out


def strategy(mode):
    def run(s, d):
        m = C.create_communities(X.nodes(s, d), X.population(s, d), budget(s, d), X.ATTRIBUTES, K, mode, refine_rounds=2)
        return C.community_sizes(m)

    return run


def proposals(s, d):
    """One round of draws for all budgets, capped."""
    nodes, m = X.nodes(s, d), X.membership(s, d)
    b = budget(s, d)
    lack = b.where("target > 0").select("src_g", "dst_g", F.col("target").alias("lack"))
    ranks = E.member_ranks(m, SEED)
    none = X.edges(s, d).limit(0)
    return E.accept(E.propose(lack, C.shared_communities(b, m), ranks, ranks, K, 0.0, SEED), none, lack)


def separated(s, d):
    order = C.separated_groups(X.population(s, d), budget(s, d), 10)
    return s.createDataFrame([(i, int(g)) for i, g in enumerate(order)], "place long, group_id long")


def full_creation(s, d):
    nodes, m = X.nodes(s, d), X.membership(s, d)
    return E.create_edges(nodes, budget(s, d), m, K, attachment=0.3, reciprocity=0.2, transitivity=0.1, bridge=0.1)


def separated_sql(count: int) -> str:
    """A chain of picks, each the group least linked to those before."""
    parts = [", ww AS (SELECT src_g AS a, dst_g AS b, target AS n FROM budget UNION ALL SELECT dst_g, src_g, target FROM budget), s0 AS (SELECT 0::bigint AS place, group_id FROM pop LEFT JOIN (SELECT a, sum(n) AS t FROM ww GROUP BY a) ON a = group_id ORDER BY coalesce(t, 0), group_id LIMIT 1)"]
    for i in range(1, count):
        parts.append(f", s{i} AS MATERIALIZED (SELECT * FROM s{i - 1} UNION ALL (SELECT {i}::bigint, group_id FROM pop LEFT JOIN (SELECT b, sum(n) AS t FROM ww WHERE a IN (SELECT group_id FROM s{i - 1}) GROUP BY b) ON b = group_id WHERE group_id NOT IN (SELECT group_id FROM s{i - 1}) ORDER BY coalesce(t, 0), group_id LIMIT 1))")
    return "".join(parts) + f" SELECT * FROM s{count - 1}"


QUERIES = {
    "shared_communities": lambda s, d: C.shared_communities(budget(s, d), X.membership(s, d)),
    "community_sizes": lambda s, d: C.community_sizes(X.membership(s, d)),
    "community_size_stats": lambda s, d: rounded(C.size_stats(X.membership(s, d))),
    "community_composition": lambda s, d: C.composition(X.membership(s, d)),
    "achieved_pairs": lambda s, d: C.achieved_pairs(X.membership(s, d)),
    "swap_loss": lambda s, d: rounded(C.swap_loss(budget(s, d), X.membership(s, d)), 3),
    "hierarchical_communities": lambda s, d: C.hierarchical(X.membership(s, d), K, 3),
    "isolation_index": lambda s, d: rounded(C.isolation(X.population(s, d), X.nodes(s, d), budget(s, d), X.ATTRIBUTES), 9),
    "spread_factor_kg": lambda s, d: C.spread_factor(X.nodes(s, d), X.population(s, d), budget(s, d), K),
    "community_size_targets": targets,
    "fast_assignment": fast,
    "community_coordinates": lambda s, d: rounded(placed(s, d).select("node_id", "community_id", "theta"), 9),
    "community_centroids": lambda s, d: rounded(C.centroids(placed(s, d)), 9),
    "ring_nearest": ring,
    "clique_edges": lambda s, d: C.clique_edges(X.membership(s, d)).groupBy("community_id").agg(F.count("*").alias("links")),
    "separated_groups_order": separated,
    "assign_clustered": strategy("clustered"),
    "assign_adaptive": strategy("adaptive"),
    "assign_segregation": strategy("segregation"),
    "assign_probability": strategy("probability"),
    "assign_capacity": strategy("capacity"),
    "propose_edges_round1": proposals,
    "reciprocal_round1": lambda s, d: E.reciprocal(proposals(s, d), 0.3, 50).select("src", "dst", "src_g", "dst_g"),
    "transitive_round1": lambda s, d: E.transitive(proposals(s, d), X.edges(s, d).limit(0), X.nodes(s, d), 0.05, 52).select("src", "dst", "src_g", "dst_g"),
    "edge_creation": full_creation,
}

V = X.VIEWS_SQL
PLACED = f""", placed AS (SELECT *, (({{t}}) % 1 + 1) % 1 AS theta FROM membership)""".replace("{t}", f"{u_sql(SEED, 'community_id')} + 1e-4::double * {normal_sql(SEED + 1, 'node_id')}")
CENTERS = ", centers AS (SELECT community_id, group_id, avg(theta) AS centroid FROM placed GROUP BY ALL)"
ACHIEVED = ", ach AS (SELECT a.group_id AS src_g, b.group_id AS dst_g, sum(a.n * b.n)::bigint AS achieved FROM comp a JOIN comp b USING (community_id) GROUP BY ALL)"
FAST = f""", rk AS (SELECT node_id, group_id, row_number() OVER (PARTITION BY group_id ORDER BY {u_sql(SEED, 'node_id')}, node_id) - 1 AS r, count(*) OVER (PARTITION BY group_id) AS n FROM nodes),
hm AS (SELECT group_id, c, row_number() OVER (PARTITION BY group_id ORDER BY {u_sql(SEED + 1, 'group_id', 'c')}, c) - 1 AS pos FROM (SELECT DISTINCT group_id FROM nodes) CROSS JOIN (SELECT unnest(range({K})) AS c)),
ps AS (SELECT *, CASE WHEN r < (n % {K}) * (n // {K} + 1) THEN r // (n // {K} + 1) ELSE n % {K} + (r - (n % {K}) * (n // {K} + 1)) // greatest(n // {K}, 1) END AS pos FROM rk)
"""
# Draws of round 1 with bridge 0, as in the engine: keys are round, pair, community and draw.
_KEY = ("'1'", "src_g", "dst_g", "dr.community_id", "i")
PROPOSED = f""", sh AS (SELECT DISTINCT b.src_g, b.dst_g, s.community_id FROM budget b JOIN comp s ON s.group_id = b.src_g JOIN comp d ON d.group_id = b.dst_g AND d.community_id = s.community_id),
wy AS (SELECT src_g, dst_g, count(*) AS k FROM sh GROUP BY ALL),
dr AS (SELECT b.src_g, b.dst_g, sh.community_id, unnest(range(1, ceil(b.target / k)::bigint + 1)) AS i FROM budget b JOIN wy USING (src_g, dst_g) JOIN sh USING (src_g, dst_g) WHERE b.target > 0),
mr AS (SELECT community_id, group_id, node_id, row_number() OVER (PARTITION BY community_id, group_id ORDER BY {u_sql(SEED, 'node_id')}, node_id) - 1 AS pos FROM membership),
dw AS (SELECT dr.*, floor({u_sql(SEED + 2, *_KEY)} * s.n)::bigint AS ps, floor({u_sql(SEED + 3, *_KEY)} * d.n)::bigint AS pd, {u_sql(SEED + 4, *_KEY)} AS x
       FROM dr JOIN comp s ON s.community_id = dr.community_id AND s.group_id = dr.src_g JOIN comp d ON d.community_id = dr.community_id AND d.group_id = dr.dst_g),
pr AS (SELECT s.node_id AS src, d.node_id AS dst, src_g, dst_g, min(x) AS x FROM dw JOIN mr s ON s.community_id = dw.community_id AND s.group_id = src_g AND s.pos = ps
       JOIN mr d ON d.community_id = dw.community_id AND d.group_id = dst_g AND d.pos = pd WHERE s.node_id <> d.node_id GROUP BY ALL),
ac AS (SELECT src, dst, src_g, dst_g FROM (SELECT pr.*, target, row_number() OVER (PARTITION BY src_g, dst_g ORDER BY x, src, dst) AS rn FROM pr JOIN budget USING (src_g, dst_g)) WHERE rn <= target)
"""

ORACLE_SQL = {
    "separated_groups_order": f"{V}{B}{separated_sql(10)}",
    "shared_communities": f"{V}{B} SELECT DISTINCT src_g, dst_g, s.community_id FROM budget JOIN comp s ON s.group_id = src_g JOIN comp d ON d.group_id = dst_g AND d.community_id = s.community_id",
    "community_sizes": f"{V} SELECT community_id, count(*) AS size FROM membership GROUP BY 1",
    "community_size_stats": f"{V}, z AS (SELECT count(*)::double AS size FROM membership GROUP BY community_id) SELECT max(size) AS max, min(size) AS min, round(avg(size), 6) AS mean, median(size) AS median, round(stddev_pop(size), 6) AS std, quantile_cont(size, 0.25) AS q1, quantile_cont(size, 0.75) AS q3 FROM z",
    "community_composition": f"{V} SELECT * FROM comp",
    "achieved_pairs": f"{V}{ACHIEVED} SELECT * FROM ach",
    "swap_loss": f"{V}{B}{ACHIEVED}, df AS (SELECT coalesce(achieved, 0)::double - coalesce(target, 0)::double AS d FROM budget FULL JOIN ach USING (src_g, dst_g)) SELECT round(sum(d * d * CASE WHEN d > 0 THEN 10.0::double ELSE 1.0::double END), 3) AS loss FROM df",
    "hierarchical_communities": f"{V} SELECT *, least(community_id // 3, 2)::bigint AS super_id FROM membership",
    "isolation_index": f"""{V}{B}, lg AS (SELECT group_id, 'c_mktsegment' AS attribute, c_mktsegment AS value FROM pop UNION ALL SELECT group_id, 'r_name', r_name FROM pop),
pp AS (SELECT attribute, value, count(*) AS n FROM lg JOIN nodes USING (group_id) GROUP BY ALL),
lk AS (SELECT s.attribute, s.value, sum(CASE WHEN s.value = t.value THEN target ELSE 0 END) AS intra, sum(target) AS out FROM budget JOIN lg s ON s.group_id = src_g JOIN lg t ON t.group_id = dst_g AND t.attribute = s.attribute GROUP BY ALL)
SELECT attribute, round(avg(CASE WHEN out > 0 THEN intra::double / out::double - n / (SELECT count(*) FROM nodes)::double ELSE 0 END), 9) AS isolation FROM pp LEFT JOIN lk USING (attribute, value) GROUP BY attribute""",
    "spread_factor_kg": f"{V}{B} SELECT p.group_id, (CASE WHEN p.n = 0 THEN 1 WHEN coalesce(target, 0) = 0 THEN {K} ELSE least({K}, greatest(1, p.n * p.n // target)) END)::bigint AS k FROM pop p LEFT JOIN budget ON src_g = p.group_id AND dst_g = p.group_id",
    "community_size_targets": f"""{V}, rr AS (SELECT unnest(range(1, {K + 1})) AS rank), nn AS (SELECT count(*) AS n FROM nodes),
sh AS (SELECT 'powerlaw' AS law, rank, (1.0::double / rank) / {sum(1.0 / r for r in range(1, K + 1))!r}::double AS f FROM rr UNION ALL SELECT 'uniform', rank, 1.0::double / {K} FROM rr),
tt AS (SELECT law, rank, trunc(f * n)::bigint AS t, n FROM sh, nn), lf AS (SELECT *, (n - sum(t) OVER (PARTITION BY law))::bigint AS l FROM tt)
SELECT law, false AS exact, rank, t AS target FROM lf UNION ALL SELECT law, true, rank, (t + l // {K} + CASE WHEN rank <= l % {K} THEN 1 ELSE 0 END)::bigint FROM lf""",
    "fast_assignment": f"{V}{FAST} SELECT node_id, ps.group_id, c AS community_id FROM ps JOIN hm ON hm.group_id = ps.group_id AND hm.pos = ps.pos",
    "community_coordinates": f"{V}{PLACED} SELECT node_id, community_id, round(theta, 9) AS theta FROM placed",
    "community_centroids": f"{V}{PLACED}{CENTERS} SELECT community_id, group_id, round(centroid, 9) AS centroid FROM centers",
    "ring_nearest": f"""{V}{PLACED}{CENTERS}, ce AS (SELECT community_id, centroid, row_number() OVER (ORDER BY centroid, community_id) - 1 AS pos, count(*) OVER () AS n FROM centers WHERE group_id = 0),
st AS (SELECT node_id, (SELECT count(*) FROM ce WHERE centroid < theta) AS c, (SELECT max(n) FROM ce) AS n FROM placed),
vi AS (SELECT node_id, delta, side, CASE WHEN side = 0 THEN (c + delta) % n ELSE (c + n - delta - 1) % n END AS pos FROM st CROSS JOIN (SELECT unnest(range({WINDOW})) AS delta) CROSS JOIN (SELECT unnest(range(2)) AS side) WHERE delta < n)
SELECT node_id, 0::bigint AS group_id, delta, side, community_id FROM vi JOIN ce USING (pos)""",
    "clique_edges": f"{V} SELECT community_id, count(*) * (count(*) - 1) AS links FROM membership GROUP BY 1",
    "propose_edges_round1": f"{V}{B}{PROPOSED} SELECT * FROM ac",
    "reciprocal_round1": f"{V}{B}{PROPOSED} SELECT dst AS src, src AS dst, dst_g AS src_g, src_g AS dst_g FROM ac WHERE {u_sql(50, 'dst', 'src')} < 0.3::double",
    "transitive_round1": f"{V}{B}{PROPOSED} SELECT DISTINCT a.src, b.dst, a.src_g, n.group_id AS dst_g FROM ac a JOIN ac b ON b.src = a.dst JOIN nodes n ON n.node_id = b.dst WHERE {u_sql(52, 'a.src', 'a.dst')} <= 0.05::double AND a.src <> b.dst",
}
