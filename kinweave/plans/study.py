"""Queries over distances, sensitivity, losses and designs."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinweave.functions.hashing import u_sql
from kinweave.functions.stats import rounded
from kinweave.calibrate import best_row, evaluation
from kinweave.operators import metrics as M
from kinweave.operators import sensitivity as S
from kinweave.operators.contagion import seed_random
from kinweave.plans.graph import DEG, LBL, UND, degree
from kinweave.sources import fixtures as X
from kinweave.sources.readers import error_records

INPUTS, OUTPUT, SLICES, REPLICATES = ["l_quantity", "l_discount"], "l_extendedprice", 10, 20
BOUNDS = {"n_communities": (1, 35000), "transitivity": (0.0, 1.0)}
AXES = {"n_communities": [1, 33, 1063, 35000], "attachment": [0.0, 1.0], "transitivity": [0.0, 1.0]}
TARGETS = {"transitivity": 0.4941, "modularity": 0.8774, "skew": 7.0774}


def pairs(s, d, label=None):
    return S.unpivot(X.table(s, d, "lineitem"), INPUTS, [OUTPUT], label)


def boot(s, d):
    rows = X.table(s, d, "lineitem").withColumn("row", F.concat_ws(".", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(F.col("l_extendedprice").cast("double") * 100).cast("long")))
    p = F.array(*[F.struct(F.lit(i).alias("input"), F.col(i).cast("double").alias("x")) for i in INPUTS])
    long = rows.select(F.lit("all").alias("label"), "row", F.explode(p).alias("p"), F.col(OUTPUT).cast("double").alias("y")).select("label", "p.input", F.lit(OUTPUT).alias("output"), "p.x", "y", "row")
    return rounded(S.pawn_bootstrap(long.where(S.finite("x", "y")), REPLICATES, slices=SLICES, edge_digits=9))


def mixing(s, d, even):
    e = X.edges(s, d)
    return M.mixing_matrix(e.where("src % 2 = 0") if even else e, X.nodes(s, d), "group_id")


def losses(s, d):
    m = X.membership(s, d)
    return evaluation(X.nodes(s, d), X.edges(s, d), m, TARGETS)


def worked(s, d):
    """Grid results: the loss of every customer's total against a target, as a table of points."""
    return X.table(s, d, "orders").groupBy((F.col("o_custkey") % 7).alias("a"), F.year("o_orderdate").cast("long").alias("b")).agg(F.avg(F.col("o_totalprice").cast("double")).alias("m")).select("a", "b", F.round(F.pow((F.col("m") - 150000.0) / 150000.0, 2), 9).alias("loss"))


def halves(s, d):
    return X.table(s, d, "lineitem").groupBy((F.col("l_partkey") % 50).alias("k")).agg(F.sum("l_linenumber").alias("t")).select("k", F.bround(F.col("t") / 2.0, 0).cast("long").alias("even"))


def composite(s, d):
    e, n = X.edges(s, d), X.nodes(s, d)
    stats = lambda x: M.degrees(n, x).agg(F.avg("degree").alias("mean"), F.stddev_pop("degree").alias("std"))
    a, b = stats(e), stats(e.where("src % 2 = 0")).toDF("mean_e", "std_e")
    ks = S.ks_distance(M.degrees(n, e), M.degrees(n, e.where("src % 2 = 0")), "degree")
    fro = S.frobenius_distance(mixing(s, d, False), mixing(s, d, True), ["l_src", "l_dst"], "share")
    j = a.crossJoin(b).crossJoin(ks).crossJoin(fro)
    loss = S.composite_loss({"mean": (F.col("mean"), F.col("mean_e")), "std": (F.col("std"), F.col("std_e"))}, {"mixing": 1.5}, F.col("frobenius"), F.col("ks"))
    return j.select(loss.alias("loss"))


METRICS = [(0, "a", "t", 0.5, None), (0, "b", "t", float("nan"), None), (0, "c", "t", 0.7, None), (1, "a", "t", 0.25, None), (1, "b", "t", 1.0, "failed"), (1, "c", "t", None, None)]


def aggregate(s, d):
    rows = s.createDataFrame(METRICS, "sample_id long, label string, metric string, value double, error string")
    samples = s.createDataFrame([(0, 10), (1, 20)], "sample_id long, n_communities long")
    return rounded(S.mean_by_sample(rows, samples))


RECORDS = ['{"file_path": "a/x.npz", "error": "TypeError"}', '{"file_path": "b/y.npz", "error": null}', ",", '{"file_path": "c/z.npz", "error": "MemoryError"}']


def records(s, d):
    return error_records(s.createDataFrame([(r,) for r in RECORDS], "value string")).groupBy("status").agg(F.count("*").alias("n"))


QUERIES = {
    "ks_distance": lambda s, d: rounded(S.ks_distance(degree(s, d), degree(s, d).select(F.col("out_degree").alias("degree")), "degree"), 9),
    "frobenius_distance": lambda s, d: rounded(S.frobenius_distance(mixing(s, d, False), mixing(s, d, True), ["l_src", "l_dst"], "share"), 9),
    "pawn_indices": lambda s, d: rounded(S.pawn(pairs(s, d), SLICES, edge_digits=9)),
    "pawn_by_label": lambda s, d: rounded(S.pawn(pairs(s, d, "l_returnflag"), SLICES, edge_digits=9)),
    "pawn_top3": lambda s, d: rounded(S.top_indices(S.pawn(pairs(s, d, "l_returnflag"), SLICES, edge_digits=9), 3)),
    "pawn_bootstrap": boot,
    "loss_metrics": lambda s, d: rounded(losses(s, d)),
    "composite_loss": lambda s, d: rounded(composite(s, d)),
    "latin_hypercube": lambda s, d: rounded(S.latin_hypercube(s, 250, BOUNDS), 9),
    "grid_points": lambda s, d: S.grid(s, AXES),
    "pawn_mean_by_input": lambda s, d: rounded(S.mean_index(S.pawn(pairs(s, d, "l_returnflag"), SLICES, edge_digits=9))),
    "best_grid_row": lambda s, d: best_row(worked(s, d)),
    "round_half_even": halves,
    "interleaved_people": lambda s, d: S.interleaved(X.nodes(s, d), "group_id", "node_id", 11).select("node_id", "group_id", F.col("place").cast("long").alias("place")),
    "numeric_columns": lambda s, d: s.createDataFrame([(i, c) for i, c in enumerate(S.numeric_columns(X.table(s, d, "lineitem"), {"l_orderkey"}))], "place long, name string"),
    "people_without_seeds": lambda s, d: X.nodes(s, d).join(seed_random(X.nodes(s, d), 1, 40, 5), "node_id", "left_anti").select("node_id"),
    "sensitivity_aggregate": aggregate,
    "error_records": records,
}

V = X.VIEWS_SQL


def pawn_sql(source: str, keys: str = "label, input, output") -> str:
    """From rows (keys, x, y): slices between linear quantiles, gaps of distributions, their median."""
    qs = ", ".join(str(i / SLICES) for i in range(SLICES + 1))
    on = " AND ".join(f"a.{k.strip()} = b.{k.strip()}" for k in keys.split(","))
    return f"""{source}, ed AS (SELECT {keys}, list_transform(quantile_cont(x, [{qs}]), lambda q: round(q, 9)) AS e, count(*) AS nr, stddev_pop(y) AS sd FROM rw GROUP BY {keys}),
sl AS (SELECT a.*, CASE WHEN x = e[{SLICES + 1}] THEN {SLICES} ELSE len(list_filter(e[1:{SLICES}], lambda q: q <= x)) END AS slice FROM rw a JOIN ed b ON {on} WHERE nr >= 20 AND sd > 0),
ct AS (SELECT {keys}, slice, y, count(*) AS k FROM sl GROUP BY ALL),
al AS (SELECT {keys}, y, sum(k) AS k FROM ct GROUP BY ALL),
fa AS (SELECT *, sum(k) OVER (PARTITION BY {keys} ORDER BY y)::double AS c, sum(k) OVER (PARTITION BY {keys})::double AS n FROM al),
fs AS (SELECT *, sum(k) OVER (PARTITION BY {keys}, slice ORDER BY y)::double AS c, sum(k) OVER (PARTITION BY {keys}, slice)::double AS m FROM ct),
gp AS (SELECT {', '.join('a.' + k.strip() for k in keys.split(','))}, a.slice, max(greatest(abs(a.c / m - b.c / n), abs((a.c - a.k) / m - (b.c - b.k) / n))) AS ks FROM fs a JOIN fa b ON {on} AND a.y = b.y WHERE m >= 10 GROUP BY ALL),
ix AS (SELECT {keys}, median(ks) AS "index" FROM gp GROUP BY {keys})
"""


_ROWS = "SELECT {label} AS label, 'l_quantity' AS input, 'l_extendedprice' AS output, l_quantity::double AS x, l_extendedprice::double AS y FROM lineitem UNION ALL SELECT {label}, 'l_discount', 'l_extendedprice', l_discount::double, l_extendedprice::double FROM lineitem"
ALL = pawn_sql("WITH rw AS (" + _ROWS.format(label="'all'") + ")")
BY = pawn_sql("WITH rw AS (" + _ROWS.format(label="l_returnflag") + ")")
BOOT = (
    "WITH r0 AS ("
    + "SELECT 'l_quantity' AS input, l_quantity::double AS x, l_extendedprice::double AS y, concat_ws('.', l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_extendedprice::double * 100)::bigint) AS rowkey FROM lineitem UNION ALL SELECT 'l_discount', l_discount::double, l_extendedprice::double, concat_ws('.', l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_extendedprice::double * 100)::bigint) FROM lineitem"
    + f"), r1 AS (SELECT *, row_number() OVER (PARTITION BY input ORDER BY {u_sql(0, 'rowkey')}, rowkey) AS i, count(*) OVER (PARTITION BY input) AS n FROM r0), "
    + f"dr AS (SELECT input, rep, floor({u_sql(1, 'input', chr(39) + 'l_extendedprice' + chr(39), chr(39) + 'all' + chr(39), 'rep', 'i')} * n)::bigint + 1 AS i FROM r1 CROSS JOIN (SELECT unnest(range({REPLICATES})) AS rep)), "
    + "rw AS (SELECT 'all' AS label, dr.input, 'l_extendedprice' AS output, rep, x, y FROM dr JOIN r1 ON r1.input = dr.input AND r1.i = dr.i)"
)
MIX = f"{V}{LBL}, ma AS (SELECT gs, gd, count(*) / sum(count(*)) OVER (PARTITION BY gs)::double AS p FROM le GROUP BY gs, gd), mb AS (SELECT gs, gd, count(*) / sum(count(*)) OVER (PARTITION BY gs)::double AS p FROM le WHERE src % 2 = 0 GROUP BY gs, gd), fr AS (SELECT sqrt(sum(pow(coalesce(ma.p, 0) - coalesce(mb.p, 0), 2))) AS f FROM ma FULL JOIN mb USING (gs, gd))"


def _ks(a: str, b: str) -> str:
    return f"ka AS (SELECT v, sum(x) OVER (ORDER BY v) / sum(x) OVER () AS fa, sum(y) OVER (ORDER BY v) / sum(y) OVER () AS fb FROM (SELECT v, sum(x)::double AS x, sum(y)::double AS y FROM (SELECT v, 1 AS x, 0 AS y FROM ({a}) UNION ALL SELECT v, 0, 1 FROM ({b})) GROUP BY v)), kk2 AS (SELECT max(abs(fa - fb)) AS ks FROM ka)"


EVEN = ", ed2 AS (SELECT * FROM edges WHERE src % 2 = 0), deg2 AS (SELECT n.node_id, coalesce(i.k, 0) + coalesce(o.k, 0) AS degree FROM nodes n LEFT JOIN (SELECT dst, count(*) k FROM ed2 GROUP BY 1) i ON i.dst = n.node_id LEFT JOIN (SELECT src, count(*) k FROM ed2 GROUP BY 1) o ON o.src = n.node_id)"

ORACLE_SQL = {
    "ks_distance": f"{V}{DEG}, {_ks('SELECT degree AS v FROM deg', 'SELECT out_degree AS v FROM deg')} SELECT round(ks, 9) AS ks FROM kk2",
    "frobenius_distance": f"{MIX} SELECT round(f, 9) AS frobenius FROM fr",
    "pawn_indices": f'{ALL} SELECT label, input, output, round("index", 6) AS "index" FROM ix',
    "pawn_by_label": f'{BY} SELECT label, input, output, round("index", 6) AS "index" FROM ix',
    "pawn_top3": f'{BY} SELECT * FROM (SELECT label, input, output, round("index", 6) AS "index", row_number() OVER (PARTITION BY label ORDER BY "index" DESC, input, output) AS place FROM ix) WHERE place <= 3',
    "pawn_bootstrap": f"""{pawn_sql(BOOT, "label, input, output, rep")} SELECT label, input, output, round(quantile_cont("index", 0.025), 6) AS ci_lo, round(quantile_cont("index", 0.975), 6) AS ci_hi FROM ix GROUP BY ALL""",
    "pawn_mean_by_input": f'{BY} SELECT label, input, round(avg("index"), 6) AS mean FROM ix GROUP BY label, input',
    "best_grid_row": "SELECT * FROM (SELECT o_custkey % 7 AS a, year(o_orderdate)::bigint AS b, round(pow((avg(o_totalprice::double) - 150000.0::double) / 150000.0::double, 2), 9) AS loss FROM orders GROUP BY 1, 2) ORDER BY loss, a, b LIMIT 1",
    "round_half_even": "SELECT l_partkey % 50 AS k, round_even(sum(l_linenumber) / 2.0::double, 0)::bigint AS even FROM lineitem GROUP BY 1",
    "interleaved_people": f"{V}, tn AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY {u_sql(11, 'node_id')}, node_id) AS turn FROM nodes) SELECT node_id, group_id, row_number() OVER (ORDER BY turn, group_id) AS place FROM tn",
    "numeric_columns": "SELECT row_number() OVER (ORDER BY column_index) - 1 AS place, column_name AS name FROM duckdb_columns() WHERE table_name = 'lineitem' AND column_name <> 'l_orderkey' AND regexp_matches(data_type, '^(TINYINT|SMALLINT|INTEGER|BIGINT|HUGEINT|FLOAT|DOUBLE|DECIMAL.*)$')",
    "people_without_seeds": f"{V} SELECT node_id FROM nodes WHERE node_id NOT IN (SELECT node_id FROM nodes ORDER BY {u_sql(5, '0', 'node_id')}, node_id LIMIT 40)",
    "loss_metrics": f"{V}{DEG}{UND}, lc AS (SELECT s.community_id AS x, t.community_id AS y FROM und JOIN membership s ON s.node_id = a JOIN membership t ON t.node_id = b), dd AS (SELECT c, count(*) AS d FROM (SELECT x AS c FROM lc UNION ALL SELECT y FROM lc) GROUP BY c), ii AS (SELECT x AS c, count(*) AS i FROM lc WHERE x = y GROUP BY x), mm AS (SELECT count(*)::double AS m FROM lc), mo AS (SELECT sum(coalesce(i, 0) / m - pow(d / (2 * m), 2)) AS q FROM dd LEFT JOIN ii USING (c), mm), tr AS (SELECT 3.0::double * (SELECT count(*) FROM tri) / (SELECT sum(k * (k - 1) // 2) FROM kk)::double AS t), sk AS (SELECT avg(pow(degree - mu, 3)) / pow(var_pop(degree), 1.5) AS g FROM deg, (SELECT avg(degree) AS mu FROM deg)) SELECT round(t, 6) AS transitivity, round(q, 6) AS modularity, round(g, 6) AS skew, round(pow((t - 0.4941) / 0.4941, 2) + pow((q - 0.8774) / 0.8774, 2) + pow((g - 7.0774) / 7.0774, 2), 6) AS loss FROM tr, mo, sk",
    "composite_loss": f"{MIX}{DEG}{EVEN}, {_ks('SELECT degree AS v FROM deg', 'SELECT degree AS v FROM deg2')}, sa AS (SELECT avg(degree) AS m, stddev_pop(degree) AS s FROM deg), sb AS (SELECT avg(degree) AS m, stddev_pop(degree) AS s FROM deg2) SELECT round(pow((sa.m - sb.m) / sb.m, 2) + pow((sa.s - sb.s) / sb.s, 2) + 1.5 * f + ks, 6) AS loss FROM sa, sb, fr, kk2",
    "latin_hypercube": f"WITH s AS (SELECT unnest(range(250)) AS sample_id), r AS (SELECT sample_id, row_number() OVER (ORDER BY {u_sql(42, 'sample_id')}, sample_id) - 1 AS a, row_number() OVER (ORDER BY {u_sql(52, 'sample_id')}, sample_id) - 1 AS b FROM s) SELECT sample_id, round(1.0::double + 34999.0::double * (a + {u_sql(43, 'sample_id')}) / 250, 9) AS n_communities, round(0.0::double + 1.0::double * (b + {u_sql(53, 'sample_id')}) / 250, 9) AS transitivity FROM r",
    "grid_points": "SELECT n_communities::bigint AS n_communities, attachment::double AS attachment, transitivity::double AS transitivity FROM (SELECT unnest([1, 33, 1063, 35000]) AS n_communities) CROSS JOIN (SELECT unnest([0.0, 1.0]) AS attachment) CROSS JOIN (SELECT unnest([0.0, 1.0]) AS transitivity)",
    "sensitivity_aggregate": "SELECT * FROM (VALUES (0::bigint, 10::bigint, 't', 0.6::double, 3::bigint), (1::bigint, 20::bigint, 't', 0.25::double, 2::bigint)) v(sample_id, n_communities, metric, mean, labels)",
    "error_records": "SELECT * FROM (VALUES ('corrupt', 1::bigint), ('error', 2::bigint), ('ok', 1::bigint)) v(status, n)",
}
