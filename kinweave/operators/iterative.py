"""Graph metrics by rounds; every round's state is checkpointed in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinweave.operators.components import connected_components
from kinweave.operators.metrics import both_ways, simple_edges, undirected, weighted_modularity
from kinweave.scratch import checkpoint

#: Rows of two numbers that are broadcast at most; 16 MB of them.
BROADCAST_ROWS = 1_000_000


def weak_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``node_id, component``: the smallest node reachable; isolates are their own."""
    found = connected_components(edges)
    return nodes.select("node_id").join(found, F.col("node_id") == F.col("node"), "left").select("node_id", F.coalesce("component", "node_id").alias("component"))


def component_summary(labels: DataFrame) -> DataFrame:
    """How many components, the largest (ties: the smallest id), its share of nodes, and whether it is all."""
    sizes = labels.groupBy("component").agg(F.count("*").alias("size"))
    big = F.max_by(F.struct("component", "size"), F.struct("size", -F.col("component")))
    out = sizes.agg(F.count("*").alias("components"), big.alias("b"), F.sum("size").alias("n"))
    return out.select("components", F.col("b.component").alias("largest"), F.col("b.size").alias("largest_size"), (F.col("b.size") / F.col("n")).alias("largest_fraction"), (F.col("components") == 1).alias("connected"))


def coreness(nodes: DataFrame, edges: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """``node_id, core`` over total degrees (a mutual pair counts twice).

    Every node's estimate falls to the h-index of its neighbours' estimates
    until nothing changes; the fixed point is the core number. A round looks only
    at nodes with a neighbour that fell to below their own estimate.
    """
    links = checkpoint(both_ways(simple_edges(edges)))
    est = checkpoint(links.groupBy("node").agg(F.count("*").alias("c")))
    near = links.join(est.withColumnRenamed("node", "other").withColumnRenamed("c", "oc"), "other").join(est, "node")
    for _ in range(max_rounds):
        # Values above a node's own estimate can't raise it: cutting them there keeps the histogram short.
        hist = near.groupBy("node", F.least("oc", "c").alias("v")).agg(F.count("*").alias("k"), F.first("c").alias("c"))
        upto = Window.partitionBy("node").orderBy(F.desc("v")).rowsBetween(Window.unboundedPreceding, 0)
        low = hist.select("node", "c", F.least("v", F.sum("k").over(upto)).alias("h")).groupBy("node").agg(F.max("h").alias("new"), F.first("c").alias("c"))
        fell = checkpoint(low.where("new < c").select("node", "new"))
        some = fell.count()
        if not some:
            break
        fallen = F.broadcast(fell) if some <= BROADCAST_ROWS else fell
        est = checkpoint(est.join(fallen, "node", "left").select("node", F.coalesce("new", "c").alias("c")))
        touched = links.join(fallen.select(F.col("node").alias("other"), "new"), "other").join(est, "node").where("new < c").select("node").distinct()
        rows = links.join(touched, "node", "left_semi")
        near = rows.join(est.withColumnRenamed("node", "other").withColumnRenamed("c", "oc"), "other").join(est, "node")
    else:
        raise RuntimeError(f"core numbers did not settle in {max_rounds} rounds")
    return nodes.select("node_id").join(est, F.col("node_id") == F.col("node"), "left").select("node_id", F.coalesce("c", F.lit(0)).cast("long").alias("core"))


def pagerank(nodes: DataFrame, edges: DataFrame, iterations: int = 20, damping: float = 0.85, tolerance: float | None = None) -> DataFrame:
    """``node_id, rank`` summing to 1; nodes without out-links spread theirs evenly."""
    out = edges.groupBy("src").agg(F.count("*").alias("k"))
    links = checkpoint(edges.join(out, "src").select("src", "dst", "k"))
    n = nodes.count()
    if not n:
        return nodes.select("node_id", F.lit(0.0).alias("rank"))
    ids = checkpoint(nodes.select("node_id"))
    rank = ids.withColumn("rank", F.lit(1.0 / n))
    for _ in range(iterations):
        got = links.join(rank, links.src == rank.node_id).groupBy("dst").agg(F.sum(F.col("rank") / F.col("k")).alias("got"))
        held = checkpoint(ids.join(got, ids.node_id == got.dst, "left").select("node_id", F.coalesce("got", F.lit(0.0)).alias("got")))
        lost = 1.0 - held.agg(F.sum("got")).first()[0]
        new = held.select("node_id", (F.lit((1 - damping) / n + damping * lost / n) + damping * F.col("got")).alias("rank"))
        if tolerance is not None:
            moved = new.join(rank.withColumnRenamed("rank", "old"), "node_id").agg(F.sum(F.abs(F.col("rank") - F.col("old")))).first()[0]
            rank = new
            if moved < tolerance:
                break
        rank = new
    return rank


def bfs(edges: DataFrame, start: int, directed: bool = False, max_depth: int = 10_000) -> DataFrame:
    """``node_id, distance`` of all nodes reachable from ``start``, by frontiers."""
    spark = edges.sparkSession
    links = checkpoint((edges.select(F.col("src").alias("node"), F.col("dst").alias("other")) if directed else both_ways(edges)).distinct())
    kind = edges.schema["src"].dataType.simpleString()
    seen = spark.createDataFrame([(start, 0)], f"node_id {kind}, distance int")
    frontier = seen
    for depth in range(1, max_depth + 1):
        near = links.join(frontier.select(F.col("node_id").alias("node")), "node").select(F.col("other").alias("node_id")).distinct()
        frontier = checkpoint(near.join(seen, "node_id", "left_anti").withColumn("distance", F.lit(depth)))
        if frontier.isEmpty():
            break
        seen = checkpoint(seen.unionAll(frontier))
    else:
        raise RuntimeError(f"nodes are more than {max_depth} links away")
    return seen


def double_sweep(edges: DataFrame, start: int) -> DataFrame:
    """A lower bound of the diameter: BFS to the farthest node (ties: the smallest id), and again from there."""
    far = bfs(edges, start).orderBy(F.desc("distance"), "node_id").first()
    again = bfs(edges, far["node_id"]).orderBy(F.desc("distance"), "node_id").limit(1)
    return again.select(F.lit(far["node_id"]).cast("long").alias("from_node"), F.col("node_id").alias("to_node"), F.col("distance").cast("long").alias("diameter"))


def bfs_subgraph(nodes: DataFrame, edges: DataFrame, center: int, max_nodes: int, directed: bool = True) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges around ``center``: whole BFS levels (both directions), the last cut by id to ``max_nodes``."""
    if max_nodes <= 0 or nodes.where(F.col("node_id") == center).isEmpty():
        raise ValueError(f"no subgraph of {max_nodes} nodes around {center}")
    kept = checkpoint(bfs(edges, center).orderBy("distance", "node_id").limit(max_nodes).select("node_id"))
    inside = edges.join(kept.withColumnRenamed("node_id", "src"), "src", "left_semi").join(kept.withColumnRenamed("node_id", "dst"), "dst", "left_semi")
    if not directed:
        inside = undirected(inside).select(F.col("a").alias("src"), F.col("b").alias("dst"))
    return nodes.join(kept, "node_id", "left_semi"), inside


def _spread(links: DataFrame, color: DataFrame) -> DataFrame:
    """The largest color that reaches each node along ``src -> dst``."""
    while True:
        got = links.join(color, links.src == color.node).groupBy("dst").agg(F.max("color").alias("got"))
        new = checkpoint(color.join(got, color.node == got.dst, "left").select("node", F.greatest("color", F.coalesce("got", "color")).alias("new"), "color"))
        changed = not new.where("new <> color").isEmpty()
        color = new.select("node", F.col("new").alias("color"))
        if not changed:
            return color


def strong_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``node_id, component`` (the smallest node of the strong component).

    Nodes without an in- or an out-link are cut off round by round, each a
    component of itself. Of the rest, every node takes the largest id that
    reaches it; those that reach back to that id within its color are one
    component. They leave, and it starts again.
    """
    left = checkpoint(simple_edges(edges))
    done: list[DataFrame] = []
    while not left.isEmpty():
        while True:
            core = left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
            core = checkpoint(core.join(left.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
            if core.count() == left.count():
                break
            left = core
        if left.isEmpty():
            break
        ids = left.select(F.col("src").alias("node")).union(left.select("dst")).distinct()
        color = checkpoint(_spread(left, checkpoint(ids.withColumn("color", F.col("node")))))
        same = left.join(color.select(F.col("node").alias("src"), F.col("color").alias("cs")), "src").join(color.select(F.col("node").alias("dst"), F.col("color").alias("cd")), "dst")
        own = checkpoint(same.where("cs = cd").select("src", "dst"))
        # Back from each color's root: a node is in if it leads to a node that is in.
        back = own.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        marked = _spread(back, checkpoint(color.select("node", F.when(F.col("node") == F.col("color"), F.col("color")).otherwise(F.lit(-(1 << 62))).alias("color"))))
        found = checkpoint(marked.where(F.col("color") > -(1 << 62)).select(F.col("node").alias("node_id"), "color"))
        lows = found.groupBy("color").agg(F.min("node_id").alias("component"))
        done.append(checkpoint(found.join(lows, "color").select("node_id", "component")))
        left = checkpoint(left.join(found.select(F.col("node_id").alias("src")), "src", "left_anti").join(found.select(F.col("node_id").alias("dst")), "dst", "left_anti").select("src", "dst"))
    out = nodes.select("node_id")
    if not done:
        return out.withColumn("component", F.col("node_id"))
    labels = done[0]
    for d in done[1:]:
        labels = labels.unionAll(d)
    return out.join(labels, "node_id", "left").select("node_id", F.coalesce("component", "node_id").alias("component"))


def label_propagation(nodes: DataFrame, edges: DataFrame, rounds: int = 5) -> DataFrame:
    """``node_id, label`` after synchronous rounds: the most frequent neighbour label, ties to the smallest."""
    pairs = undirected(edges)
    links = checkpoint(both_ways(pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"))))
    labels = nodes.select("node_id", F.col("node_id").alias("label"))
    for _ in range(rounds):
        votes = links.join(labels, links.other == labels.node_id).groupBy("node", "label").agg(F.count("*").alias("k"))
        best = votes.groupBy("node").agg(F.max_by("label", F.struct("k", -F.col("label"))).alias("new"))
        labels = checkpoint(labels.join(best, labels.node_id == best.node, "left").select("node_id", F.coalesce("new", "label").alias("label")))
    return labels


def louvain(nodes: DataFrame, edges: DataFrame, levels: int = 4, rounds: int = 8, seed: int = 42, resolution: float = 1.0) -> DataFrame:
    """``node_id, community`` by local moves in rounds and contraction of communities.

    In a round, a hashed half of the nodes moves at once, each to the
    neighbouring community of the highest gain; a round that lowers modularity
    is undone and ends the level.
    """
    from kinweave.functions.hashing import u

    pairs = undirected(edges).select(F.col("a").alias("src"), F.col("b").alias("dst"), F.col("w").cast("double").alias("w"))
    graph = checkpoint(pairs)
    member = checkpoint(nodes.select("node_id", F.col("node_id").alias("c")))
    total = graph.agg(F.sum("w")).first()[0]
    if not total:
        return member.withColumnRenamed("c", "community")
    for level in range(levels):
        both = graph.select(F.col("src").alias("v"), F.col("dst").alias("o"), "w").unionAll(graph.select(F.col("dst").alias("v"), F.col("src").alias("o"), "w"))
        both = checkpoint(both)
        strength = checkpoint(both.groupBy("v").agg(F.sum("w").alias("k")))
        at = checkpoint(strength.select("v", F.col("v").alias("c")))  # no longer known to be equal: constraints would multiply

        def quality(at: DataFrame, graph: DataFrame = graph) -> float:
            s, d = at.select(F.col("v").alias("src"), F.col("c").alias("l_src")), at.select(F.col("v").alias("dst"), F.col("c").alias("l_dst"))
            return weighted_modularity(graph.join(s, "src").join(d, "dst")).first()["modularity"]

        best, moved_any = quality(at), False
        for r in range(rounds):
            sums = at.join(strength, "v").groupBy("c").agg(F.sum("k").alias("ck"))
            to = both.where("v <> o").join(at.withColumnRenamed("v", "o").withColumnRenamed("c", "oc"), "o").groupBy("v", "oc").agg(F.sum("w").alias("kin"))
            cand = to.join(at, "v").join(strength, "v").join(sums.withColumnRenamed("c", "oc"), "oc")
            rest = F.col("ck") - F.when(F.col("oc") == F.col("c"), F.col("k")).otherwise(0.0)
            gain = F.col("kin") - resolution * F.col("k") * rest / (2 * total)
            pick = cand.withColumn("gain", gain).groupBy("v").agg(F.max_by("oc", F.struct("gain", -F.col("oc"))).alias("new"), F.max("gain").alias("top"))
            half = (u(seed, F.lit(level), F.lit(r), "v") < 0.5) & (F.col("top") > 0)
            new = checkpoint(at.join(pick, "v", "left").select("v", F.when(half, F.col("new")).otherwise(F.col("c")).alias("c")))
            q = quality(new)
            if q <= best + 1e-9 and r:
                break
            if q > best:
                at, best, moved_any = new, q, True
        if not moved_any:
            break
        member = checkpoint(member.join(at.withColumnRenamed("c", "nc"), member.c == at.v, "left").select("node_id", F.coalesce("nc", "c").alias("c")))
        s, d = at.select(F.col("v").alias("src"), F.col("c").alias("cs")), at.select(F.col("v").alias("dst"), F.col("c").alias("cd"))
        graph = checkpoint(graph.join(s, "src").join(d, "dst").groupBy(F.least("cs", "cd").alias("src"), F.greatest("cs", "cd").alias("dst")).agg(F.sum("w").alias("w")))
    return member.withColumnRenamed("c", "community")
