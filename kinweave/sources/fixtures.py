"""Network inputs derived from the star schema: population, nodes, edges, interactions, membership."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

COMMUNITIES = 8
ATTRIBUTES = ["c_mktsegment", "r_name"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def located(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return table(spark, sf_dir, "customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", *ATTRIBUTES)


def population(spark: SparkSession, sf_dir: str) -> DataFrame:
    """group_id, attributes, n: one row for each segment and region."""
    counts = located(spark, sf_dir).groupBy(*ATTRIBUTES).agg(F.count("*").alias("n"))
    return counts.withColumn("group_id", (F.row_number().over(Window.orderBy(*ATTRIBUTES)) - 1).cast("long"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node_id, group_id of every customer."""
    pop = population(spark, sf_dir).select(*ATTRIBUTES, "group_id")
    return located(spark, sf_dir).join(F.broadcast(pop), ATTRIBUTES).select(F.col("c_custkey").alias("node_id"), "group_id")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst: an earlier buyer of a part to each later one."""
    lines = table(spark, sf_dir, "lineitem").where("l_linenumber = 1").select("l_orderkey", "l_partkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    b = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("l_partkey").alias("p"), F.col("o_custkey").alias("c"), F.col("o_orderdate").alias("d")).distinct()
    later = b.select("p", F.col("c").alias("dst"), F.col("d").alias("later"))
    return b.join(later, "p").where("d < later and c <> dst").select(F.col("c").alias("src"), "dst").distinct()


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links between groups in long form: attributes of both sides and n."""
    own, pop = nodes(spark, sf_dir), population(spark, sf_dir).select("group_id", *ATTRIBUTES)
    side = lambda s: own.join(F.broadcast(pop), "group_id").select(F.col("node_id").alias(s), *[F.col(a).alias(f"{a}_{s}") for a in ATTRIBUTES])
    joined = edges(spark, sf_dir).join(side("src"), "src").join(side("dst"), "dst")
    return joined.groupBy(*[f"{a}_{s}" for s in ("src", "dst") for a in ATTRIBUTES]).agg(F.count("*").alias("n"))


def membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes(spark, sf_dir).withColumn("community_id", F.col("node_id") % COMMUNITIES)


VIEWS_SQL = f"""WITH RECURSIVE pop AS (
  SELECT c_mktsegment, r_name, count(*) AS n, row_number() OVER (ORDER BY c_mktsegment, r_name) - 1 AS group_id
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY c_mktsegment, r_name),
nodes AS (
  SELECT c.c_custkey AS node_id, p.group_id FROM customer c JOIN nation ON c.c_nationkey = n_nationkey
  JOIN region r ON n_regionkey = r.r_regionkey JOIN pop p ON p.c_mktsegment = c.c_mktsegment AND p.r_name = r.r_name),
buys AS (SELECT DISTINCT l_partkey AS p, o_custkey AS c, o_orderdate AS d FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linenumber = 1),
edges AS MATERIALIZED (SELECT DISTINCT a.c AS src, b.c AS dst FROM buys a JOIN buys b ON a.p = b.p AND a.d < b.d AND a.c <> b.c),
inter AS (
  SELECT ps.c_mktsegment AS c_mktsegment_src, ps.r_name AS r_name_src, pd.c_mktsegment AS c_mktsegment_dst, pd.r_name AS r_name_dst, count(*) AS n
  FROM edges e JOIN nodes s ON e.src = s.node_id JOIN nodes t ON e.dst = t.node_id
  JOIN pop ps ON ps.group_id = s.group_id JOIN pop pd ON pd.group_id = t.group_id GROUP BY ALL),
membership AS (SELECT node_id, group_id, node_id % {COMMUNITIES} AS community_id FROM nodes),
pairs AS (
  SELECT s.group_id AS src_g, d.group_id AS dst_g, sum(i.n)::bigint AS n FROM inter i
  JOIN pop s ON s.c_mktsegment = i.c_mktsegment_src AND s.r_name = i.r_name_src
  JOIN pop d ON d.c_mktsegment = i.c_mktsegment_dst AND d.r_name = i.r_name_dst GROUP BY ALL),
actual AS (
  SELECT s.group_id AS src_g, t.group_id AS dst_g, count(*) AS actual
  FROM edges e JOIN nodes s ON e.src = s.node_id JOIN nodes t ON e.dst = t.node_id GROUP BY ALL),
comp AS (SELECT community_id, group_id, count(*) AS n FROM membership GROUP BY ALL)
"""
