"""Graph metrics in one pass or a few joins: degrees, triangles, mixing, modularity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinweave.functions.ranking import dense_ids
from kinweave.functions.stats import eight_numbers


def simple_edges(edges: DataFrame) -> DataFrame:
    """Distinct directed edges without self-loops."""
    return edges.where("src <> dst").select("src", "dst").distinct()


def compact(edges: DataFrame) -> DataFrame:
    """Edges over dense ids 0..k-1 in the order of the old ids; isolates vanish."""
    ids = dense_ids(edges.select(F.col("src").alias("id")).union(edges.select("dst")), "id", "new")
    s, d = ids.select(F.col("id").alias("src"), F.col("new").alias("s")), ids.select(F.col("id").alias("dst"), F.col("new").alias("d"))
    return edges.join(s, "src").join(d, "dst").select(F.col("s").alias("src"), F.col("d").alias("dst"))


def undirected(edges: DataFrame) -> DataFrame:
    """``a < b, w``: links of each unordered pair and how many directed edges they stand for."""
    return edges.where("src <> dst").groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.count("*").alias("w"))


def both_ways(edges: DataFrame) -> DataFrame:
    """``node, other``: every edge seen from both ends; a mutual pair counts twice."""
    return edges.select(F.col("src").alias("node"), F.col("dst").alias("other")).unionAll(edges.select(F.col("dst").alias("node"), F.col("src").alias("other")))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """in, out and total degree of every node, 0 for isolates."""
    ends = edges.select(F.col("src").alias("node_id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionAll(edges.select(F.col("dst").alias("node_id"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    sums = ends.groupBy("node_id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    j = nodes.select("node_id").join(sums, "node_id", "left")
    i, o = F.coalesce("in_degree", F.lit(0)).cast("long"), F.coalesce("out_degree", F.lit(0)).cast("long")
    return j.select("node_id", i.alias("in_degree"), o.alias("out_degree"), (i + o).alias("degree"))


def degree_stats(degree: DataFrame) -> DataFrame:
    """The eight numbers of each kind of degree, side by side."""
    parts = [eight_numbers(degree, c, p) for c, p in (("in_degree", "in_"), ("out_degree", "out_"), ("degree", "total_"))]
    return parts[0].crossJoin(parts[1]).crossJoin(parts[2])  # one row each


def degree_fractions(degree: DataFrame) -> DataFrame:
    share = lambda cond: F.avg(F.expr(cond).cast("double"))
    return degree.agg(
        share("degree = 0").alias("frac_isolates"),
        share("in_degree = 0 and out_degree > 0").alias("frac_sources"),
        share("out_degree = 0 and in_degree > 0").alias("frac_sinks"),
        share("degree = 1").alias("frac_degree1"),
    )


def reciprocity(edges: DataFrame) -> DataFrame:
    """Share of edges whose reverse is an edge: in a pair of weight 2 both have one."""
    w = undirected(simple_edges(edges))
    return w.agg(F.coalesce(F.sum(F.when(F.col("w") == 2, 2).otherwise(0)) / F.sum("w"), F.lit(0.0)).alias("reciprocity"))


def density(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    n, m = nodes.agg(F.count("*").alias("n")), edges.agg(F.count("*").alias("m"))
    return n.crossJoin(m).select("n", "m", F.when(F.col("n") > 1, F.col("m") / (F.col("n") * (F.col("n") - 1))).otherwise(0.0).alias("density"))


def triangles(edges: DataFrame) -> DataFrame:
    """``a, b, c, weight`` of every undirected triangle once; weight is the product of its pairs' directed edges.

    Each pair points from the end of lower degree to the other, so a node opens
    wedges only over its few stronger neighbours: hubs open next to none.
    """
    pairs = undirected(edges)
    deg = pairs.select(F.explode(F.array("a", "b")).alias("v")).groupBy("v").agg(F.count("*").alias("d"))
    da, db = deg.select(F.col("v").alias("a"), F.col("d").alias("da")), deg.select(F.col("v").alias("b"), F.col("d").alias("db"))
    up = F.struct("da", "a") < F.struct(F.col("db").alias("da"), F.col("b").alias("a"))
    low = pairs.join(da, "a").join(db, "b").select(F.when(up, F.col("a")).otherwise(F.col("b")).alias("x"), F.when(up, F.col("b")).otherwise(F.col("a")).alias("y"), "w")
    other = low.select("x", F.col("y").alias("z"), F.col("w").alias("w2"))
    wedges = low.join(other, "x").where("y < z")
    closing = pairs.select(F.col("a").alias("y"), F.col("b").alias("z"), F.col("w").alias("w3"))
    return wedges.join(closing, ["y", "z"]).select(F.col("x").alias("a"), F.col("y").alias("b"), F.col("z").alias("c"), (F.col("w") * F.col("w2") * F.col("w3")).alias("weight"))


def local_clustering(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Share of a node's neighbour pairs that are linked, undirected; 0 below two neighbours."""
    t = triangles(edges).select(F.explode(F.array("a", "b", "c")).alias("node_id")).groupBy("node_id").agg(F.count("*").alias("triangles"))
    d = undirected(edges).select(F.explode(F.array("a", "b")).alias("node_id")).groupBy("node_id").agg(F.count("*").alias("k"))
    j = nodes.select("node_id").join(d, "node_id", "left").join(t, "node_id", "left")
    k, n = F.coalesce("k", F.lit(0)), F.coalesce("triangles", F.lit(0))
    return j.select("node_id", n.cast("long").alias("triangles"), F.when(k > 1, 2.0 * n / (k * (k - 1))).otherwise(0.0).alias("clustering"))


def global_clustering(edges: DataFrame) -> DataFrame:
    """Three times the triangles over the connected triples; 0 without a triple."""
    d = undirected(edges).select(F.explode(F.array("a", "b")).alias("v")).groupBy("v").agg(F.count("*").alias("k"))
    triples = d.agg(F.coalesce(F.sum(F.expr("k * (k - 1) div 2")), F.lit(0)).alias("triples"))
    t = triangles(edges).agg(F.count("*").alias("triangles"))
    return t.crossJoin(triples).withColumn("transitivity", F.when(F.col("triples") > 0, 3.0 * F.col("triangles") / F.col("triples")).otherwise(0.0))


def directed_transitivity(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Directed triangles of all eight patterns over the possible ones (d(d-1) - 2 mutual, twice)."""
    mutual = undirected(edges).where("w = 2").select(F.explode(F.array("a", "b")).alias("node_id")).groupBy("node_id").agg(F.count("*").alias("r"))
    d = degrees(nodes, edges).join(mutual, "node_id", "left")
    room = d.agg(F.sum(F.col("degree") * (F.col("degree") - 1) - 2 * F.coalesce("r", F.lit(0))).alias("room"))
    t = triangles(edges).agg(F.coalesce(F.sum("weight"), F.lit(0)).alias("t"))
    return t.crossJoin(room).select(F.when(F.col("room") > 0, 3.0 * F.col("t") / F.col("room")).otherwise(0.0).alias("transitivity"))


def average_neighbor_degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Mean total degree over a node's neighbours, a mutual one counted twice; 0 for isolates."""
    d = degrees(nodes, edges).select(F.col("node_id").alias("other"), "degree")
    mean = both_ways(edges).join(d, "other").groupBy(F.col("node").alias("node_id")).agg(F.avg("degree").alias("knn"))
    return nodes.select("node_id").join(mean, "node_id", "left").select("node_id", F.coalesce("knn", F.lit(0.0)).alias("knn"))


def degree_histogram(degree: DataFrame) -> DataFrame:
    return degree.groupBy("degree").agg(F.count("*").alias("nodes"))


def labelled_edges(edges: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """``src, dst, l_src, l_dst``: the labels of both ends; edges with an unlabelled end are skipped."""
    s = labels.select(F.col("node_id").alias("src"), F.col(label).alias("l_src"))
    d = labels.select(F.col("node_id").alias("dst"), F.col(label).alias("l_dst"))
    return edges.join(s, "src").join(d, "dst").select("src", "dst", "l_src", "l_dst")


def mixing_matrix(edges: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """``l_src, l_dst, links, share``: row-normalised counts."""
    counts = labelled_edges(edges, labels, label).groupBy("l_src", "l_dst").agg(F.count("*").alias("links"))
    row = F.sum("links").over(Window.partitionBy("l_src"))
    return counts.withColumn("share", F.when(row > 0, F.col("links") / row).otherwise(0.0))


def within_between(edges: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    e = labelled_edges(edges, labels, label)
    inside = F.count_if(F.col("l_src") == F.col("l_dst"))
    return e.agg(inside.alias("within"), (F.count("*") - inside).alias("between"), F.coalesce(inside / F.count("*"), F.lit(0.0)).alias("frac_within"))


def bridge_widths(edges: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """Links between each unordered pair of different communities, widest first."""
    e = labelled_edges(edges, labels, label).where("l_src <> l_dst")
    return e.groupBy(F.least("l_src", "l_dst").alias("c1"), F.greatest("l_src", "l_dst").alias("c2")).agg(F.count("*").alias("width")).orderBy(F.desc("width"), "c1", "c2")


def modularity(edges: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """Modularity of a partition on the collapsed undirected graph, and the number of communities."""
    pairs = undirected(edges).select(F.col("a").alias("src"), F.col("b").alias("dst"))
    return weighted_modularity(labelled_edges(pairs, labels, label).withColumn("w", F.lit(1.0)))


def weighted_modularity(e: DataFrame) -> DataFrame:
    """The same from ``l_src, l_dst, w`` rows, one for each undirected link."""
    ends = e.select(F.explode(F.array(F.struct(F.col("l_src").alias("c"), F.col("w").alias("d"), F.when(F.col("l_src") == F.col("l_dst"), F.col("w")).otherwise(0.0).alias("i")), F.struct(F.col("l_dst").alias("c"), F.col("w").alias("d"), F.lit(0.0).alias("i")))).alias("x")).select("x.*")
    by = ends.groupBy("c").agg(F.sum("d").alias("d"), F.sum("i").alias("inside"))
    m = by.agg((F.sum("d") / 2).alias("m"))
    q = F.sum(F.col("inside") / F.col("m") - F.pow(F.col("d") / (2 * F.col("m")), 2))
    return by.crossJoin(m).agg(F.coalesce(q, F.lit(0.0)).alias("modularity"), F.count("*").alias("communities"))
