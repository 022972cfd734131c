"""Queries over graph metrics and contagion."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinweave.functions.hashing import u_sql
from kinweave.functions.stats import eight_numbers, eight_sql, rounded
from kinweave.operators import contagion as C
from kinweave.operators import iterative as I
from kinweave.operators import metrics as M
from kinweave.sources import fixtures as X

V = X.VIEWS_SQL
LPA_ROUNDS, PR_ROUNDS, CORE_ROUNDS, SIMS, SEEDS = 5, 20, 60, 20, 12
ABSOLUTE, FRACTIONAL = [1.0, 2.0], [0.05, 0.175, 0.3]


def degree(s, d):
    return M.degrees(X.nodes(s, d), X.edges(s, d))


def first_source(s, d):
    """The smallest node with an out-link: one number."""
    return X.edges(s, d).agg(F.min("src")).first()[0]


def log_degree_stats(s, d):
    logs = degree(s, d).select(F.log1p("in_degree").alias("li"), F.log1p("out_degree").alias("lo"), F.log1p("degree").alias("lt"))
    parts = [eight_numbers(logs, c, p) for c, p in (("li", "in_"), ("lo", "out_"), ("lt", "total_"))]
    return rounded(parts[0].crossJoin(parts[1]).crossJoin(parts[2]))


def seeds(s, d, k=SEEDS):
    return C.seed_random(X.nodes(s, d), SIMS, k, 7)


def adopted(s, d, taus, fractional):
    return C.spread(X.nodes(s, d), X.edges(s, d), seeds(s, d), taus, fractional)


def final_counts(infected):
    return infected.groupBy("threshold", "sim", "step").agg(F.count("*").alias("adopted"), F.sum("node_id").alias("id_sum"))


def subgraph(s, d):
    nodes, edges = I.bfs_subgraph(X.nodes(s, d), X.edges(s, d), first_source(s, d), 200)
    return edges.select("src", "dst")


def louvain_summary(s, d):
    nodes, edges = X.nodes(s, d), X.edges(s, d)
    return rounded(M.modularity(edges, I.louvain(nodes, edges), "community"))


QUERIES = {
    "degree_table": degree,
    "degree_stats": lambda s, d: rounded(M.degree_stats(degree(s, d))),
    "log_degree_stats": log_degree_stats,
    "degree_fractions": lambda s, d: rounded(M.degree_fractions(degree(s, d))),
    "degree_histogram": lambda s, d: M.degree_histogram(degree(s, d)),
    "reciprocity": lambda s, d: rounded(M.reciprocity(X.edges(s, d)), 9),
    "density": lambda s, d: rounded(M.density(X.nodes(s, d), X.edges(s, d)), 12),
    "local_clustering": lambda s, d: rounded(M.local_clustering(X.nodes(s, d), X.edges(s, d)), 9),
    "global_clustering": lambda s, d: rounded(M.global_clustering(X.edges(s, d)), 9),
    "directed_transitivity": lambda s, d: rounded(M.directed_transitivity(X.nodes(s, d), X.edges(s, d)), 9),
    "avg_neighbor_degree": lambda s, d: rounded(M.average_neighbor_degree(X.nodes(s, d), X.edges(s, d))),
    "undirected_weights": lambda s, d: M.undirected(X.edges(s, d)),
    "compact_edges": lambda s, d: M.compact(M.simple_edges(X.edges(s, d))),
    "weak_components": lambda s, d: I.weak_components(X.nodes(s, d), X.edges(s, d)),
    "component_summary": lambda s, d: rounded(I.component_summary(I.weak_components(X.nodes(s, d), X.edges(s, d)))),
    "kcore": lambda s, d: I.coreness(X.nodes(s, d), X.edges(s, d)),
    "pagerank_20": lambda s, d: rounded(I.pagerank(X.nodes(s, d), X.edges(s, d), PR_ROUNDS), 9),
    "strong_components": lambda s, d: I.strong_components(X.nodes(s, d), X.edges(s, d)),
    "bfs_distance": lambda s, d: I.bfs(X.edges(s, d), first_source(s, d)),
    "double_sweep_diameter": lambda s, d: I.double_sweep(X.edges(s, d), first_source(s, d)),
    "bfs_subgraph": subgraph,
    "label_propagation_5": lambda s, d: I.label_propagation(X.nodes(s, d), X.edges(s, d), LPA_ROUNDS),
    "louvain": louvain_summary,
    "modularity_of_partition": lambda s, d: rounded(M.modularity(X.edges(s, d), X.membership(s, d), "community_id"), 9),
    "mixing_matrix": lambda s, d: rounded(M.mixing_matrix(X.edges(s, d), X.nodes(s, d), "group_id")),
    "within_between": lambda s, d: rounded(M.within_between(X.edges(s, d), X.membership(s, d), "community_id")),
    "bridge_widths": lambda s, d: M.bridge_widths(X.edges(s, d), X.membership(s, d), "community_id"),
    "contagion_seed_random": seeds,
    "contagion_seed_neighbor_k": lambda s, d: C.seed_neighbors(X.nodes(s, d), X.edges(s, d), SIMS, 5, 7),
    "contagion_absolute": lambda s, d: final_counts(adopted(s, d, ABSOLUTE, False)),
    "contagion_fractional": lambda s, d: final_counts(adopted(s, d, FRACTIONAL, True)),
    "contagion_series": lambda s, d: C.series(adopted(s, d, FRACTIONAL, True)),
    "contagion_summary": lambda s, d: rounded(C.summary(adopted(s, d, FRACTIONAL, True))),
}

DEG = """, deg AS (SELECT n.node_id, coalesce(i.k, 0)::bigint AS in_degree, coalesce(o.k, 0)::bigint AS out_degree, (coalesce(i.k, 0) + coalesce(o.k, 0))::bigint AS degree
FROM nodes n LEFT JOIN (SELECT dst, count(*) k FROM edges GROUP BY 1) i ON i.dst = n.node_id LEFT JOIN (SELECT src, count(*) k FROM edges GROUP BY 1) o ON o.src = n.node_id)
"""
UND = """, und AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, count(*) AS w FROM edges GROUP BY ALL),
nb AS (SELECT a AS v, b AS o, w FROM und UNION ALL SELECT b, a, w FROM und),
kk AS (SELECT v, count(*) AS k FROM nb GROUP BY v),
tri AS (SELECT x.a, x.b, y.b AS c, x.w * y.w * z.w AS weight FROM und x JOIN und y ON x.b = y.a JOIN und z ON z.a = x.a AND z.b = y.b)
"""
BOTH = ", bw AS (SELECT src AS v, dst AS o FROM edges UNION ALL SELECT dst, src FROM edges)"
LBL = ", le AS (SELECT e.src, e.dst, s.community_id AS ls, t.community_id AS ld, s.group_id AS gs, t.group_id AS gd FROM edges e JOIN membership s ON e.src = s.node_id JOIN membership t ON e.dst = t.node_id)"
START = "(SELECT min(src) FROM edges)"
BFS = f"""{BOTH}, bf(v, dist) USING KEY (v) AS (
SELECT {START}, 0 UNION SELECT DISTINCT ON (bw.o) bw.o, bf.dist + 1 FROM bf JOIN bw ON bw.v = bf.v WHERE bw.o NOT IN (SELECT v FROM recurring.bf))
"""
FAR = f"""{BFS}, far AS (SELECT v FROM bf ORDER BY dist DESC, v LIMIT 1), bg(v, dist) USING KEY (v) AS (
SELECT v, 0 FROM far UNION SELECT DISTINCT ON (bw.o) bw.o, bg.dist + 1 FROM bg JOIN bw ON bw.v = bg.v WHERE bw.o NOT IN (SELECT v FROM recurring.bg))
"""
REACH = ", reach(a, b) AS (SELECT src, dst FROM edges UNION SELECT reach.a, e.dst FROM reach JOIN edges e ON e.src = reach.b)"
CC = f"""{BOTH}, cc(v, comp) USING KEY (v) AS (
SELECT node_id, node_id FROM nodes UNION
SELECT p.v, min(i.comp) FROM recurring.cc p JOIN bw ON bw.v = p.v JOIN cc i ON i.v = bw.o WHERE i.comp < p.comp GROUP BY p.v)
"""
_SEED = f"""SELECT sim, node_id FROM (SELECT node_id, sim, row_number() OVER (PARTITION BY sim ORDER BY {u_sql(7, 'sim', 'node_id')}, node_id) AS r
FROM nodes CROSS JOIN (SELECT unnest(range({SIMS}))::int AS sim)) WHERE r <= {{k}}"""
SEED_SQL = f", seeds AS ({_SEED.format(k=SEEDS)})"


def spread_sql(taus: list[float], fractional: bool, steps: int = 200) -> str:
    """Synchronous steps until nothing changes; the whole state is carried along."""
    t = ", ".join(f"({x}::double)" for x in taus)
    level = "count(*) / max(k.k)" if fractional else "count(*)"
    return f"""{SEED_SQL}, taus(threshold) AS (VALUES {t}), outk AS (SELECT src, count(*) AS k FROM edges GROUP BY src),
inf(threshold, sim, node_id, step) USING KEY (threshold, sim, node_id) AS (
SELECT threshold, sim, node_id, 0 FROM seeds CROSS JOIN taus UNION
SELECT r.threshold, r.sim, e.src, (SELECT max(step) FROM inf) + 1 FROM recurring.inf r JOIN edges e ON e.dst = r.node_id JOIN outk k ON k.src = e.src
WHERE NOT EXISTS (SELECT 1 FROM recurring.inf q WHERE q.threshold = r.threshold AND q.sim = r.sim AND q.node_id = e.src)
GROUP BY r.threshold, r.sim, e.src HAVING {level} >= r.threshold)
"""


FINAL = "SELECT threshold, sim, step, count(*) AS adopted, sum(node_id)::bigint AS id_sum FROM inf GROUP BY ALL"


def pagerank_sql(rounds: int) -> str:
    parts = [", outk AS (SELECT src, count(*) AS k FROM edges GROUP BY src), nn AS (SELECT count(*)::double AS n FROM nodes), r0 AS MATERIALIZED (SELECT node_id, 1.0::double / n AS r FROM nodes, nn)"]
    for i in range(rounds):
        parts.append(
            f", g{i} AS MATERIALIZED (SELECT nodes.node_id, coalesce(sum(r.r / k), 0) AS got FROM nodes LEFT JOIN (edges JOIN outk USING (src) JOIN r{i} r ON r.node_id = edges.src) ON edges.dst = nodes.node_id GROUP BY 1)"
            f", r{i + 1} AS MATERIALIZED (SELECT node_id, 0.15::double / n + 0.85::double * (1 - (SELECT sum(got) FROM g{i})) / n + 0.85::double * got AS r FROM g{i}, nn)"
        )
    return "".join(parts) + f" SELECT node_id, round(r, 9) AS rank FROM r{rounds}"


def lpa_sql(rounds: int) -> str:
    parts = [", l0 AS (SELECT node_id, node_id AS label FROM nodes)"]
    for i in range(rounds):
        parts.append(
            f", b{i} AS (SELECT v, l.label, count(*) AS k FROM nb JOIN l{i} l ON l.node_id = nb.o GROUP BY ALL), t{i} AS (SELECT v, label FROM b{i} QUALIFY row_number() OVER (PARTITION BY v ORDER BY k DESC, label) = 1)"
            f", l{i + 1} AS MATERIALIZED (SELECT l.node_id, coalesce(t.label, l.label) AS label FROM l{i} l LEFT JOIN t{i} t ON t.v = l.node_id)"
        )
    return "".join(parts) + f" SELECT node_id, label FROM l{rounds}"


def core_sql(rounds: int) -> str:
    return f"""{BOTH}, co(it, v, c) AS (SELECT 0, v, count(*) FROM bw GROUP BY v UNION ALL
SELECT it + 1, v, max(least(oc, rn)) FROM (SELECT p.it, bw.v, o.c AS oc, row_number() OVER (PARTITION BY bw.v ORDER BY o.c DESC) AS rn
  FROM bw JOIN co p ON p.v = bw.v JOIN co o ON o.v = bw.o WHERE p.it < {rounds}) GROUP BY it, v)
SELECT n.node_id, coalesce(c, 0)::bigint AS core FROM nodes n LEFT JOIN (SELECT v, c FROM co WHERE it = {rounds}) z ON z.v = n.node_id"""


def _three(source: str, names: dict[str, str], digits: int = 6) -> str:
    return "SELECT * FROM " + ", ".join(f"({eight_sql(c, p, source, digits)})" for p, c in names.items())


ORACLE_SQL = {
    "degree_table": f"{V}{DEG} SELECT * FROM deg",
    "degree_stats": f"{V}{DEG} " + _three("deg", {"in_": "in_degree", "out_": "out_degree", "total_": "degree"}),
    "log_degree_stats": f"{V}{DEG} " + _three("deg", {"in_": "ln(1 + in_degree)", "out_": "ln(1 + out_degree)", "total_": "ln(1 + degree)"}),
    "degree_fractions": f"{V}{DEG} SELECT round(avg((degree = 0)::int::double), 6) AS frac_isolates, round(avg((in_degree = 0 AND out_degree > 0)::int::double), 6) AS frac_sources, round(avg((out_degree = 0 AND in_degree > 0)::int::double), 6) AS frac_sinks, round(avg((degree = 1)::int::double), 6) AS frac_degree1 FROM deg",
    "degree_histogram": f"{V}{DEG} SELECT degree, count(*) AS nodes FROM deg GROUP BY degree",
    "reciprocity": f"{V} SELECT round(avg((EXISTS (SELECT 1 FROM edges r WHERE r.src = e.dst AND r.dst = e.src))::int::double), 9) AS reciprocity FROM edges e",
    "density": f"{V} SELECT n, m, round(m / (n * (n - 1)), 12) AS density FROM (SELECT count(*) AS n FROM nodes), (SELECT count(*) AS m FROM edges)",
    "local_clustering": f"{V}{UND}, tv AS (SELECT v, count(*) AS t FROM (SELECT unnest([a, b, c]) AS v FROM tri) GROUP BY v) SELECT node_id, coalesce(t, 0)::bigint AS triangles, round(CASE WHEN k > 1 THEN 2.0::double * coalesce(t, 0) / (k * (k - 1)) ELSE 0 END, 9) AS clustering FROM nodes LEFT JOIN kk ON kk.v = node_id LEFT JOIN tv ON tv.v = node_id",
    "global_clustering": f"{V}{UND} SELECT triangles, triples, round(3.0::double * triangles / triples, 9) AS transitivity FROM (SELECT count(*) AS triangles FROM tri), (SELECT sum(k * (k - 1) // 2)::bigint AS triples FROM kk)",
    "directed_transitivity": f"{V}{DEG}{UND}, mu AS (SELECT v, count(*) AS r FROM nb WHERE w = 2 GROUP BY v) SELECT round(3.0::double * t / room, 9) AS transitivity FROM (SELECT sum(weight) AS t FROM tri), (SELECT sum(degree * (degree - 1) - 2 * coalesce(r, 0)) AS room FROM deg LEFT JOIN mu ON v = node_id)",
    "avg_neighbor_degree": f"{V}{DEG}{BOTH} SELECT n.node_id, round(coalesce(avg(d.degree), 0), 6) AS knn FROM nodes n LEFT JOIN bw ON bw.v = n.node_id LEFT JOIN deg d ON d.node_id = bw.o GROUP BY n.node_id",
    "undirected_weights": f"{V}{UND} SELECT * FROM und",
    "compact_edges": f"{V}, ids AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS n FROM (SELECT src AS id FROM edges UNION SELECT dst FROM edges)) SELECT a.n AS src, b.n AS dst FROM edges JOIN ids a ON a.id = src JOIN ids b ON b.id = dst",
    "weak_components": f"{V}{CC} SELECT v AS node_id, comp AS component FROM cc",
    "component_summary": f"{V}{CC}, sz AS (SELECT comp, count(*) AS size FROM cc GROUP BY comp) SELECT count(*) AS components, arg_max(comp, (size, -comp)) AS largest, max(size) AS largest_size, round(max(size) / sum(size)::double, 6) AS largest_fraction, count(*) = 1 AS connected FROM sz",
    "kcore": f"{V}{core_sql(CORE_ROUNDS)}",
    "pagerank_20": f"{V}{pagerank_sql(PR_ROUNDS)}",
    "bfs_distance": f"{V}{BFS} SELECT v AS node_id, dist AS distance FROM bf",
    "double_sweep_diameter": f"{V}{FAR} SELECT (SELECT v FROM far) AS from_node, v AS to_node, dist::bigint AS diameter FROM bg ORDER BY dist DESC, v LIMIT 1",
    "bfs_subgraph": f"{V}{BFS}, near AS (SELECT v FROM bf ORDER BY dist, v LIMIT 200) SELECT src, dst FROM edges WHERE src IN (SELECT v FROM near) AND dst IN (SELECT v FROM near)",
    "strong_components": f"{V}{REACH}, mutual AS (SELECT a, min(b) AS low FROM reach x WHERE EXISTS (SELECT 1 FROM reach y WHERE y.a = x.b AND y.b = x.a) GROUP BY a) SELECT node_id, least(node_id, coalesce(low, node_id)) AS component FROM nodes LEFT JOIN mutual ON a = node_id",
    "label_propagation_5": f"{V}{UND}{lpa_sql(LPA_ROUNDS)}",
    "modularity_of_partition": f"{V}{UND}, lc AS (SELECT s.community_id AS x, t.community_id AS y FROM und JOIN membership s ON s.node_id = a JOIN membership t ON t.node_id = b), dd AS (SELECT c, count(*) AS d FROM (SELECT x AS c FROM lc UNION ALL SELECT y FROM lc) GROUP BY c), ii AS (SELECT x AS c, count(*) AS i FROM lc WHERE x = y GROUP BY x), mm AS (SELECT count(*)::double AS m FROM lc) SELECT round(sum(coalesce(i, 0) / m - pow(d / (2 * m), 2)), 9) AS modularity, count(*) AS communities FROM dd LEFT JOIN ii USING (c), mm",
    "mixing_matrix": f"{V}{LBL} SELECT gs AS l_src, gd AS l_dst, count(*) AS links, round(count(*) / sum(count(*)) OVER (PARTITION BY gs)::double, 6) AS share FROM le GROUP BY gs, gd",
    "within_between": f'{V}{LBL} SELECT count(*) FILTER (ls = ld) AS within, count(*) FILTER (ls <> ld) AS "between", round(avg((ls = ld)::int::double), 6) AS frac_within FROM le',
    "bridge_widths": f"{V}{LBL} SELECT least(ls, ld) AS c1, greatest(ls, ld) AS c2, count(*) AS width FROM le WHERE ls <> ld GROUP BY ALL",
    "contagion_seed_random": f"{V}{SEED_SQL} SELECT * FROM seeds",
    "contagion_seed_neighbor_k": f"""{V}, able AS (SELECT src AS node_id FROM edges GROUP BY src HAVING count(*) >= 5),
focal AS (SELECT sim, node_id FROM (SELECT node_id, sim, row_number() OVER (PARTITION BY sim ORDER BY {u_sql(7, 'sim', 'node_id')}, node_id) AS r FROM able CROSS JOIN (SELECT unnest(range({SIMS}))::int AS sim)) WHERE r = 1),
near AS (SELECT sim, node_id FROM (SELECT sim, dst AS node_id, row_number() OVER (PARTITION BY sim ORDER BY {u_sql(8, 'sim', 'dst')}, dst) AS r FROM focal JOIN edges ON src = focal.node_id) WHERE r <= 5)
SELECT * FROM focal UNION SELECT * FROM near""",
    "contagion_absolute": f"{V}{spread_sql(ABSOLUTE, False)} {FINAL}",
    "contagion_fractional": f"{V}{spread_sql(FRACTIONAL, True)} {FINAL}",
    "contagion_series": f"{V}{spread_sql(FRACTIONAL, True)}, st AS (SELECT unnest(range(max(step) + 1))::int AS step FROM inf), ks AS (SELECT DISTINCT threshold, sim FROM inf) SELECT threshold, sim, step, (SELECT count(*) FROM inf i WHERE i.threshold = ks.threshold AND i.sim = ks.sim AND i.step <= st.step) AS infected FROM ks CROSS JOIN st",
    "contagion_summary": f"{V}{spread_sql(FRACTIONAL, True)}, fi AS (SELECT threshold, sim, count(*) AS n FROM inf GROUP BY ALL) SELECT threshold, round(avg(n), 6) AS mean_final, round(var_pop(n), 6) AS variance_final, count(*) AS sims FROM fi GROUP BY threshold",
}
