"""Edge creation in rounds that never exceed a pair's budget.

A round proposes links for what each pair still lacks, drops self-loops,
repeats and known links, and keeps at most the lacking number of each pair, by
a keyed hash. Reciprocal and transitive links pass the same cap. Budgets are
settled per round, not per link, so the order of links within a round does not
matter; a pair's links are ranked by ranges of the hash, so a pair that holds
nearly all links is ranked by many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.functions.hashing import u
from kinweave.functions.ranking import rank_within
from kinweave.operators.network import actual_pairs
from kinweave.scratch import checkpoint


def lacking(budget: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``src_g, dst_g, lack`` of pairs below their target."""
    j = budget.join(actual_pairs(edges, nodes), ["src_g", "dst_g"], "left")
    return j.select("src_g", "dst_g", (F.col("target") - F.coalesce("actual", F.lit(0))).alias("lack")).where("lack > 0")


def member_ranks(membership: DataFrame, seed: int) -> DataFrame:
    """``community_id, group_id, node_id, pos, n``: people of a community's group in shuffled order, from 0."""
    ranked = rank_within(membership.select("community_id", "group_id", "node_id").withColumn("x", u(seed, "node_id")), ["community_id", "group_id"], "x", "node_id")
    sizes = membership.groupBy("community_id", "group_id").agg(F.count("*").alias("n"))
    return ranked.join(sizes, ["community_id", "group_id"]).select("community_id", "group_id", "node_id", (F.col("rank") - 1).alias("pos"), "n")


def pool(ranks: DataFrame, fraction: float) -> DataFrame:
    """The first ceil(fraction * n) people of each community's group: those who may be linked to."""
    kept = F.ceil(F.col("n") * F.lit(float(fraction)))
    return ranks.where(F.col("pos") < kept).select("community_id", "group_id", "node_id", "pos", kept.cast("long").alias("n"))


def propose(lack: DataFrame, shared: DataFrame, ranks: DataFrame, targets: DataFrame, communities: int, bridge: float, seed: int, round_: int = 1) -> DataFrame:
    """``src, dst, src_g, dst_g, x``: drawn links. ``shared``: communities of each pair.

    What a pair lacks is spread over its communities (ceil of the share); each
    draw takes a random source and a random pool member, with chance ``bridge``
    from a community next to the source's. ``x`` orders draws for the cap.
    """
    ways = shared.groupBy("src_g", "dst_g").agg(F.count("*").alias("k"))
    spread = lack.join(ways, ["src_g", "dst_g"]).join(shared, ["src_g", "dst_g"]).withColumn("quota", F.ceil(F.col("lack") / F.col("k")))
    draws = spread.select("src_g", "dst_g", "community_id", F.explode(F.sequence(F.lit(1), F.col("quota").cast("int"))).alias("i"))
    key = (F.lit(round_), F.col("src_g"), F.col("dst_g"), F.col("community_id"), F.col("i"))
    step = F.when(u(seed + 1, *key) < 0.5, 1).otherwise(-1)
    to = F.when(u(seed, *key) < bridge, F.pmod(F.col("community_id") + step, F.lit(communities))).otherwise(F.col("community_id")) if bridge > 0 else F.col("community_id")
    draws = draws.withColumns({"to": to, "us": u(seed + 2, *key), "ud": u(seed + 3, *key), "x": u(seed + 4, *key)})
    size = lambda t, c, g, n: t.groupBy(F.col("community_id").alias(c), F.col("group_id").alias(g)).agg(F.first("n").alias(n))
    drawn = draws.join(size(ranks, "community_id", "src_g", "ns"), ["community_id", "src_g"]).join(size(targets, "to", "dst_g", "nd"), ["to", "dst_g"])
    drawn = drawn.withColumns({"ps": F.floor(F.col("us") * F.col("ns")), "pd": F.floor(F.col("ud") * F.col("nd"))})
    s = ranks.select("community_id", F.col("group_id").alias("src_g"), F.col("pos").alias("ps"), F.col("node_id").alias("src"))
    d = targets.select(F.col("community_id").alias("to"), F.col("group_id").alias("dst_g"), F.col("pos").alias("pd"), F.col("node_id").alias("dst"))
    return drawn.join(s, ["community_id", "src_g", "ps"]).join(d, ["to", "dst_g", "pd"]).select("src", "dst", "src_g", "dst_g", "x")


def accept(proposed: DataFrame, known: DataFrame, lack: DataFrame) -> DataFrame:
    """New links only, at most ``lack`` of each pair, the smallest ``x`` first."""
    fresh = proposed.where("src <> dst").groupBy("src", "dst").agg(F.min(F.struct("x", "src_g", "dst_g")).alias("p")).select("src", "dst", "p.*")
    fresh = fresh.join(known, ["src", "dst"], "left_anti").join(lack, ["src_g", "dst_g"])
    # Hash ties are broken by the source, then by the hash of both ends.
    ordered = fresh.withColumn("_tie", F.struct("src", "dst"))
    return rank_within(ordered, ["src_g", "dst_g"], "x", "_tie").where("rank <= lack").select("src", "dst", "src_g", "dst_g")


def reciprocal(new: DataFrame, chance: float, seed: int) -> DataFrame:
    """Reverse links of new ones, each with the given chance."""
    back = new.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("dst_g").alias("src_g"), F.col("src_g").alias("dst_g"))
    x = u(seed, "src", "dst")
    return back.where(x < chance).withColumn("x", x)


def transitive(new: DataFrame, known: DataFrame, nodes: DataFrame, chance: float, seed: int) -> DataFrame:
    """For a share of new links (s, d): links from s to the out-neighbours of d."""
    lucky = new.where(u(seed, "src", "dst") <= chance).select("src", F.col("dst").alias("via"), "src_g")
    out = known.select(F.col("src").alias("via"), "dst").unionAll(new.select(F.col("src").alias("via"), "dst"))
    group = nodes.select(F.col("node_id").alias("dst"), F.col("group_id").alias("dst_g"))
    return lucky.join(out, "via").where("src <> dst").join(group, "dst").select("src", "dst", "src_g", "dst_g").distinct().withColumn("x", u(seed + 1, "src", "dst"))


def heavier_pool(targets: DataFrame, ranks: DataFrame, new: DataFrame, membership: DataFrame, attachment: float, round_: int) -> DataFrame:
    """A pool in which nodes that were just linked to appear again, once for each lucky link.

    A link is lucky with chance ``attachment`` squared, as two draws must exceed
    the pool's fraction; a random other member joins with it.
    """
    lucky = new.where(u(900 + round_, "src", "dst") < attachment * attachment).select(F.col("dst").alias("node_id"), u(901 + round_, "src", "dst").alias("r"))
    home = membership.select("node_id", "community_id", "group_id")
    again = lucky.join(home, "node_id")
    sizes = ranks.groupBy("community_id", "group_id").agg(F.first("n").alias("n"))
    other = again.join(sizes, ["community_id", "group_id"]).select("community_id", "group_id", F.floor(F.col("r") * F.col("n")).alias("pos")).join(ranks.select("community_id", "group_id", "pos", "node_id"), ["community_id", "group_id", "pos"])
    slot = ["community_id", "group_id", "node_id"]
    more = again.select(*slot).unionByName(other.select(*slot))
    # Copies of a node are numbered, not keyed by where they lie: draws do not depend on partitions.
    copies = targets.select(*slot).unionByName(more).groupBy(*slot).agg(F.count("*").alias("k"))
    every = copies.select(*slot, F.explode(F.sequence(F.lit(1), F.col("k").cast("int"))).alias("k"))
    every = checkpoint(every)
    ranked = rank_within(every.withColumn("x", u(902 + round_, "node_id", "k")).withColumn("key", F.struct("node_id", "k")), ["community_id", "group_id"], "x", "key")
    sizes = every.groupBy("community_id", "group_id").agg(F.count("*").alias("n"))
    return checkpoint(ranked.join(sizes, ["community_id", "group_id"]).select("community_id", "group_id", "node_id", (F.col("rank") - 1).alias("pos"), "n"))


def create_edges(
    nodes: DataFrame, budget: DataFrame, membership: DataFrame, communities: int, *, attachment: float = 0.0, reciprocity: float = 0.0, transitivity: float = 0.0,
    bridge: float = 0.0, known: DataFrame | None = None, rounds: int = 3, fill: bool = True, coordinates: DataFrame | None = None, seed: int = 42,
) -> DataFrame:
    """``src, dst``: links within communities up to every pair's budget.

    ``known`` links count against budgets and are part of the result. After the
    rounds, with ``coordinates`` (``node_id, theta``), what is lacking goes to
    the communities nearest on the circle; with ``fill``, to shared communities
    again and then to whole groups.
    """
    from kinweave.operators.communities import shared_communities

    spark = nodes.sparkSession
    kind = nodes.schema["node_id"].dataType.simpleString()
    edges = checkpoint(known.select("src", "dst").distinct()) if known is not None else spark.createDataFrame([], f"src {kind}, dst {kind}")
    shared = checkpoint(shared_communities(budget.where("target > 0"), membership))
    ranks = checkpoint(member_ranks(membership, seed))
    targets = checkpoint(pool(ranks, 1.0 - attachment)) if attachment > 0 else ranks

    def grow(edges: DataFrame, proposed: DataFrame) -> tuple[DataFrame, DataFrame]:
        new = checkpoint(accept(proposed, edges, lacking(budget, edges, nodes)))
        return checkpoint(edges.unionByName(new.select("src", "dst"))), new

    def follow(edges: DataFrame, new: DataFrame, r: int) -> DataFrame:
        """Reverse links of the new ones, then links to their neighbours and the reverse of those."""
        if reciprocity > 0:
            edges, _ = grow(edges, reciprocal(new, reciprocity, seed + 50 + 10 * r))
        if transitivity > 0:
            edges, made = grow(edges, transitive(new, edges, nodes, transitivity, seed + 52 + 10 * r))
            if reciprocity > 0:
                edges, _ = grow(edges, reciprocal(made, reciprocity, seed + 55 + 10 * r))
        return edges

    for r in range(1, rounds + 1):
        lack = checkpoint(lacking(budget, edges, nodes))
        edges, new = grow(edges, propose(lack, shared, ranks, targets, communities, bridge, seed + 100 * r, r))
        if new.isEmpty():
            break
        if attachment > 0:
            targets = heavier_pool(targets, ranks, new, membership, attachment, r)
        edges = follow(edges, new, r)
    if coordinates is not None:
        edges, new = grow(edges, ring_proposals(lacking(budget, edges, nodes), membership, coordinates, ranks, seed + 700))
        edges = follow(edges, new, 8)
    if fill:
        everyone = checkpoint(member_ranks(membership.withColumn("community_id", F.lit(0).cast("long")), seed + 800))
        whole = budget.where("target > 0").select("src_g", "dst_g", F.lit(0).cast("long").alias("community_id"))
        for stage, (ways, people) in enumerate(((shared, ranks), (whole, everyone))):
            for r in range(10):
                lack = checkpoint(lacking(budget, edges, nodes))
                more = lack.withColumn("lack", F.col("lack") * 4)
                edges, new = grow(edges, propose(more, ways, people, people, max(communities, 1), 0.0, seed + 810 + 20 * stage + r, r + 10))
                if new.isEmpty():
                    break
                if reciprocity > 0:
                    edges, _ = grow(edges, reciprocal(new, reciprocity, seed + 860 + 20 * stage + r))
    return edges


def ring_proposals(lack: DataFrame, membership: DataFrame, coordinates: DataFrame, ranks: DataFrame, seed: int, window: int = 200) -> DataFrame:
    """Links from people of a lacking pair to a random member of each nearest community of the other group."""
    from kinweave.operators.communities import centroids, ring_nearest

    placed = membership.join(coordinates.select("node_id", "theta"), "node_id", "left")
    people = membership.groupBy("group_id").agg(F.count("*").alias("people"))
    each = lack.join(people, lack.src_g == people.group_id).select("src_g", "dst_g", F.greatest(F.lit(1), F.least(F.lit(window), F.ceil(F.col("lack") / F.col("people")))).alias("each"))
    sources = placed.select("node_id", F.coalesce("theta", F.lit(0.5)).alias("theta"), F.col("group_id").alias("src_g")).join(each, "src_g").select("node_id", "theta", F.col("dst_g").alias("group_id"), "src_g", "each")
    near = ring_nearest(sources.select("node_id", "theta", "group_id"), centroids(placed), window)
    wanted = near.join(sources.select("node_id", "group_id", "src_g", "each"), ["node_id", "group_id"]).where("2 * delta + side < each")
    sizes = ranks.groupBy("community_id", "group_id").agg(F.first("n").alias("n"))
    x = u(seed, "node_id", "community_id", "group_id")
    drawn = wanted.join(sizes, ["community_id", "group_id"]).withColumn("x", x).withColumn("pos", F.floor(u(seed + 1, "node_id", "community_id", "group_id") * F.col("n")))
    d = ranks.select("community_id", "group_id", "pos", F.col("node_id").alias("dst"))
    return drawn.withColumnRenamed("node_id", "src").join(d, ["community_id", "group_id", "pos"]).select("src", "dst", "src_g", F.col("group_id").alias("dst_g"), "x")
