"""Communities: their tables and checks, and the strategies that assign people to them.

Group-level decisions (orders, shares, clusters of groups) run on the driver
where they are sequential by nature; the number of groups is a property of the
population table's attributes, not of its people. People are never collected.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinweave.functions.hashing import normal, u
from kinweave.functions.ranking import rank_within
from kinweave.scratch import checkpoint

MODES = {
    "none": "none", "probability": "probability", "clustered": "clustered", "adaptive": "adaptive", "segregation": "segregation",
    "capacity_fast": "capacity_fast", "capacity": "capacity", "capacity_capacity": "capacity", "capacity_greedy": "capacity",
}


# ---- tables and checks


def community_sizes(membership: DataFrame) -> DataFrame:
    return membership.groupBy("community_id").agg(F.count("*").alias("size"))


def size_stats(membership: DataFrame) -> DataFrame:
    x = F.col("size").cast("double")
    q = F.percentile(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return community_sizes(membership).agg(F.max(x).alias("max"), F.min(x).alias("min"), F.avg(x).alias("mean"), q[1].alias("median"), F.stddev_pop(x).alias("std"), q[0].alias("q1"), q[2].alias("q3"))


def composition(membership: DataFrame) -> DataFrame:
    """``community_id, group_id, n``."""
    return membership.groupBy("community_id", "group_id").agg(F.count("*").alias("n"))


def shared_communities(budget: DataFrame, membership: DataFrame) -> DataFrame:
    """``src_g, dst_g, community_id``: communities where both groups of a budgeted pair have people."""
    gc = composition(membership).select("community_id", "group_id")
    s, d = gc.withColumnRenamed("group_id", "src_g"), gc.withColumnRenamed("group_id", "dst_g")
    return budget.select("src_g", "dst_g").join(s, "src_g").join(d, ["dst_g", "community_id"]).select("src_g", "dst_g", "community_id").distinct()


def achieved_pairs(membership: DataFrame) -> DataFrame:
    """``src_g, dst_g, achieved``: sum over communities of the product of both groups' counts."""
    a = composition(membership).select("community_id", F.col("group_id").alias("src_g"), F.col("n").alias("x"))
    b = composition(membership).select("community_id", F.col("group_id").alias("dst_g"), F.col("n").alias("y"))
    return a.join(b, "community_id").groupBy("src_g", "dst_g").agg(F.sum(F.col("x") * F.col("y")).alias("achieved"))


def swap_loss(budget: DataFrame, membership: DataFrame, overshoot: float = 10.0) -> DataFrame:
    """Sum of squared differences over the cells of either side; overshoot weighs more."""
    j = budget.join(achieved_pairs(membership), ["src_g", "dst_g"], "full_outer")
    diff = F.coalesce("achieved", F.lit(0)).cast("double") - F.coalesce("target", F.lit(0)).cast("double")
    return j.agg(F.sum(diff * diff * F.when(diff > 0, overshoot).otherwise(1.0)).alias("loss"))


def hierarchical(membership: DataFrame, communities: int, supers: int) -> DataFrame:
    """``super_id``: communities in blocks of equal number; the last takes the rest."""
    block = math.ceil(communities / supers)
    return membership.withColumn("super_id", F.least(F.floor(F.col("community_id") / block), F.lit(supers - 1)).cast("long"))


def isolation(pop: DataFrame, nodes: DataFrame, budget: DataFrame, attrs: list[str]) -> DataFrame:
    """``attribute, isolation``: mean over values of the share of links that stay inside, less the value's share of people."""
    sizes = nodes.groupBy("group_id").agg(F.count("*").alias("people"))
    long = pop.join(sizes, "group_id", "left").select("group_id", F.coalesce("people", F.lit(0)).alias("people"), F.explode(F.create_map(*[x for a in attrs for x in (F.lit(a), F.col(a).cast("string"))])).alias("attribute", "value")).where("value is not null")
    people = long.groupBy("attribute", "value").agg(F.sum("people").alias("n"))
    values = people.groupBy("attribute").agg(F.count("*").alias("values"))
    s = long.select("attribute", F.col("group_id").alias("src_g"), F.col("value").alias("v"))
    d = long.select("attribute", F.col("group_id").alias("dst_g"), F.col("value").alias("w"))
    links = budget.join(s, "src_g").join(d, ["attribute", "dst_g"]).groupBy("attribute", F.col("v").alias("value")).agg(F.sum(F.when(F.col("v") == F.col("w"), F.col("target")).otherwise(0)).alias("intra"), F.sum("target").alias("out"))
    total = nodes.agg(F.count("*").alias("all"))
    j = people.where("n > 0").join(links, ["attribute", "value"], "left").crossJoin(F.broadcast(total))
    each = F.when(F.col("out") > 0, F.col("intra") / F.col("out") - F.col("n") / F.col("all")).otherwise(0.0)
    mean = j.groupBy("attribute").agg(F.avg(each).alias("mean"))
    return values.join(mean, "attribute", "left").select("attribute", F.when(F.col("values") > 1, F.coalesce("mean", F.lit(0.0))).otherwise(0.0).alias("isolation"))


def spread_factor(nodes: DataFrame, pop: DataFrame, budget: DataFrame, communities: int) -> DataFrame:
    """``group_id, k``: over how many communities a group may spread so that its own budget can be met."""
    sizes = nodes.groupBy("group_id").agg(F.count("*").alias("n"))
    own = budget.where("src_g = dst_g").select(F.col("src_g").alias("group_id"), "target")
    j = pop.select("group_id").join(sizes, "group_id", "left").join(own, "group_id", "left")
    n, x = F.coalesce("n", F.lit(0)), F.coalesce("target", F.lit(0))
    k = F.when(n == 0, F.lit(1)).when(x == 0, F.lit(communities)).otherwise(F.least(F.lit(communities), F.greatest(F.lit(1), F.floor(n * n / x))))
    return j.select("group_id", k.cast("long").alias("k"))


def size_targets(total: DataFrame, communities: int, kind: str | list[float], exact: bool, seed: int = 42) -> DataFrame:
    """``rank, target``: community sizes by law or by given shares; ``exact`` gives the remainder out round robin.

    ``total`` has one row with ``n``, the number of people. The laws are ``powerlaw`` (1 / rank),
    ``uniform`` and ``normal`` (spread 0.3 of the mean, at least one person).
    """
    ranks = total.select("n", F.explode(F.sequence(F.lit(1), F.lit(communities))).alias("rank"))
    if isinstance(kind, list):
        if len(kind) != communities:
            raise ValueError(f"{len(kind)} shares for {communities} communities")
        share = F.element_at(F.array(*[F.lit(float(x)) for x in kind]), F.col("rank"))
    elif kind == "powerlaw":
        share = (1.0 / F.col("rank")) / F.lit(sum(1.0 / r for r in range(1, communities + 1)))
    elif kind == "uniform":
        share = F.lit(1.0) / communities
    elif kind == "normal":
        raw = ranks.withColumn("raw", F.greatest(F.lit(1.0), F.col("n") / communities * (1 + 0.3 * normal(seed, "rank"))))
        ranks = raw.withColumn("share", F.col("raw") / F.sum("raw").over(Window.partitionBy("n")))
        share = F.greatest(F.lit(1.0), F.bround(F.col("share") * F.col("n"), 0)) / F.col("n") + 1e-12
    else:
        raise ValueError(f"unknown size law {kind}")
    out = ranks.withColumn("t", (share * F.col("n")).cast("long"))
    if not exact:
        return out.select("rank", F.col("t").alias("target"))
    left = F.col("n") - F.sum("t").over(Window.partitionBy("n"))
    more = F.floor(left / communities) + (F.col("rank") <= left % communities).cast("long")
    return out.select("rank", (F.col("t") + more).cast("long").alias("target"))


def coordinates(membership: DataFrame, seed: int = 42) -> DataFrame:
    """``theta``: a random anchor of the community on the circle, with a little jitter."""
    theta = F.pmod(u(seed, "community_id") + 1e-4 * normal(seed + 1, "node_id"), F.lit(1.0))
    return membership.withColumn("theta", theta)


def centroids(placed: DataFrame) -> DataFrame:
    """``community_id, group_id, centroid``: mean place; a missing one counts as 0.5."""
    return placed.groupBy("community_id", "group_id").agg(F.avg(F.coalesce("theta", F.lit(0.5))).alias("centroid"))


def ring_nearest(sources: DataFrame, centers: DataFrame, window: int, buckets: int = 1024) -> DataFrame:
    """``node_id, group_id, delta, side, community_id``: communities of a destination group nearest on the circle.

    ``sources``: ``node_id, theta, group_id`` (the destination group);
    ``centers``: ``group_id, community_id, centroid``. How many centers lie
    before a source is counted by ranges of the circle and within each, so a
    large group is not ranked by one task. From there communities are visited
    outwards, one to each side for every delta, round the circle.
    """
    rank = F.row_number().over(Window.partitionBy("group_id").orderBy("centroid", "community_id")) - 1
    ranked = centers.withColumn("pos", rank)
    sizes = centers.groupBy("group_id").agg(F.count("*").alias("n"))
    bucket = lambda x: F.least(F.floor(F.col(x) * buckets), F.lit(buckets - 1)).cast("int")
    both = sources.select("group_id", "theta", bucket("theta").alias("b"), "node_id", F.lit(0).alias("is_center")).unionByName(
        centers.select("group_id", F.col("centroid").alias("theta"), bucket("centroid").alias("b"), F.lit(None).cast("long").alias("node_id"), F.lit(1).alias("is_center"))
    )
    before = Window.partitionBy("group_id").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    starts = both.groupBy("group_id", "b").agg(F.sum("is_center").alias("c")).select("group_id", "b", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("start"))
    upto = Window.partitionBy("group_id", "b").orderBy("theta", "is_center").rowsBetween(Window.unboundedPreceding, 0)
    at = both.withColumn("c", F.sum("is_center").over(upto)).where("is_center = 0").join(starts, ["group_id", "b"]).select("node_id", "group_id", (F.col("start") + F.col("c")).alias("center"))
    steps = at.join(sizes, "group_id").select("node_id", "group_id", "center", "n", F.explode(F.sequence(F.lit(0), F.least(F.lit(window), F.col("n")) - 1)).alias("delta"))
    sides = F.explode(F.array(F.struct(F.lit(0).alias("side"), ((F.col("center") + F.col("delta")) % F.col("n")).alias("pos")), F.struct(F.lit(1).alias("side"), ((F.col("center") + F.col("n") - F.col("delta") - 1) % F.col("n")).alias("pos"))))
    visits = steps.select("node_id", "group_id", F.col("delta").cast("long").alias("delta"), sides.alias("s")).select("node_id", "group_id", "delta", F.col("s.side").cast("long").alias("side"), F.col("s.pos").alias("pos"))
    return visits.join(ranked.select("group_id", "pos", "community_id"), ["group_id", "pos"]).select("node_id", "group_id", "delta", "side", "community_id")


def clique_edges(membership: DataFrame) -> DataFrame:
    """``src, dst, community_id``: every ordered pair within a community; the caller asks for their number."""
    a = membership.select("community_id", F.col("node_id").alias("src"))
    b = membership.select("community_id", F.col("node_id").alias("dst"))
    return a.join(b, "community_id").where("src <> dst").select("src", "dst", "community_id")


# ---- strategies: each returns node_id, group_id, community_id


def even_split(nodes: DataFrame, homes: DataFrame, seed: int) -> DataFrame:
    """People of each group over its home communities, counts at most one apart, in shuffled order.

    ``homes``: ``group_id, community_id, pos`` with ``pos`` from 0 within the group.
    """
    shuffled = rank_within(nodes.select("node_id", "group_id").withColumn("_x", u(seed, "node_id")), ["group_id"], "_x", "node_id", "_rank").drop("_x")
    sizes = nodes.groupBy("group_id").agg(F.count("*").alias("_n"))
    ways = homes.groupBy("group_id").agg(F.count("*").alias("_k"))
    j = shuffled.join(sizes, "group_id").join(ways, "group_id")
    base, extra, r = F.floor(F.col("_n") / F.col("_k")), F.col("_n") % F.col("_k"), F.col("_rank") - 1
    wide = extra * (base + 1)
    pos = F.when(r < wide, F.floor(r / (base + 1))).otherwise(extra + F.floor((r - wide) / F.greatest(base, F.lit(1))))
    return j.withColumn("pos", pos.cast("long")).join(homes.withColumn("pos", F.col("pos").cast("long")), ["group_id", "pos"]).select("node_id", "group_id", "community_id")


def assign_single(nodes: DataFrame) -> DataFrame:
    return nodes.select("node_id", "group_id", F.lit(0).cast("long").alias("community_id"))


def assign_fast(nodes: DataFrame, communities: int, seed: int = 42) -> DataFrame:
    """Every group spread evenly over all communities, in an order shuffled for each group."""
    _positive(communities)
    grid = nodes.select("group_id").distinct().select("group_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(communities - 1).cast("long"))).alias("community_id"))
    pos = F.row_number().over(Window.partitionBy("group_id").orderBy(u(seed + 1, "group_id", "community_id"), "community_id")) - 1
    return even_split(nodes, grid.withColumn("pos", pos), seed)


def _positive(communities: int) -> None:
    if communities < 1:
        raise ValueError(f"{communities} communities: at least one is needed")


def _budget_rows(budget: DataFrame) -> list[tuple[int, int, int]]:
    return [(r["src_g"], r["dst_g"], r["target"]) for r in budget.where("target > 0").collect()]  # group pairs


def _chance(seed: int, *keys) -> float:
    from hashlib import md5

    return int(md5("|".join(map(str, (seed, *keys))).encode()).hexdigest()[:13], 16) / float(1 << 52)


def _with_homes(nodes: DataFrame, homes: dict[int, list[int]], seed: int) -> DataFrame:
    rows = [(int(g), int(c), k) for g, cs in homes.items() for k, c in enumerate(cs)]
    table = nodes.sparkSession.createDataFrame(rows, "group_id long, community_id long, pos int")
    return even_split(nodes, table, seed)


def separated_groups(pop: DataFrame, budget: DataFrame, count: int) -> list[int]:
    """Groups far from each other: the least linked first, then always the one least linked to those chosen (ties: id)."""
    weight, total = defaultdict(float), defaultdict(float)
    for g, h, n in _budget_rows(budget):
        weight[g, h] += n
        weight[h, g] += n
        total[g] += n
        total[h] += n
    groups = sorted(r["group_id"] for r in pop.select("group_id").collect())
    chosen: list[int] = []
    tied = dict.fromkeys(groups, 0.0)
    while tied and len(chosen) < count:
        g = min(tied, key=lambda x: ((tied[x] if chosen else total[x]), x))
        chosen.append(g)
        del tied[g]
        for x in tied:
            tied[x] += weight[g, x]
    return chosen


def seed_nodes(nodes: DataFrame, pop: DataFrame, budget: DataFrame, count: int, seed: int = 42) -> DataFrame:
    """``node_id, community_id``: one random person of each separated group, each opening a community."""
    order = separated_groups(pop, budget, count)
    rows = [(g, c) for c, g in enumerate(order)]
    chosen = nodes.sparkSession.createDataFrame(rows, "group_id long, community_id long")
    first = nodes.groupBy("group_id").agg(F.min_by("node_id", F.struct(u(seed, "node_id"), F.col("node_id"))).alias("node_id"))
    return first.join(F.broadcast(chosen), "group_id").select("node_id", "community_id")


def cluster_groups(pop: DataFrame, budget: DataFrame, clusters: int, steps: int = 30) -> dict[int, int]:
    """Group to cluster: local moves on the group graph, with the resolution that comes nearest to ``clusters``.

    Groups without links are dealt round robin.
    """
    links: dict[int, dict[int, float]] = defaultdict(lambda: defaultdict(float))
    for g, h, n in _budget_rows(budget):
        if g != h:
            links[g][h] += n
            links[h][g] += n
    groups = sorted(r["group_id"] for r in pop.select("group_id").collect())
    linked = [g for g in groups if g in links]
    strength = {g: sum(links[g].values()) for g in linked}
    twice = sum(strength.values()) or 1.0

    def moved(resolution: float) -> dict[int, int]:
        at, mass = {g: g for g in linked}, dict(strength)
        for _ in range(20):
            changed = False
            for g in linked:
                near: dict[int, float] = defaultdict(float)
                for h, w in links[g].items():
                    near[at[h]] += w
                mass[at[g]] -= strength[g]
                gain = lambda c: near[c] - resolution * strength[g] * mass[c] / twice  # noqa: B023, E731
                best = max(sorted(near), key=gain, default=at[g])
                if gain(best) <= gain(at[g]) + 1e-12:
                    best = at[g]
                mass[best] += strength[g]
                changed |= best != at[g]
                at[g] = best
            if not changed:
                break
        return at

    if clusters >= len(linked):
        at = dict.fromkeys(linked, 0)
    else:
        low, high, at = 1e-6, 500.0, moved(1.0)
        for _ in range(steps):
            mid = math.sqrt(low * high)
            trial = moved(mid)
            n = len(set(trial.values()))
            if abs(n - clusters) < abs(len(set(at.values())) - clusters):
                at = trial
            if n == clusters:
                break
            low, high = (mid, high) if n < clusters else (low, mid)
    names = {c: k for k, c in enumerate(sorted(set(at.values())))}
    out = {g: names[c] for g, c in at.items()}
    for k, g in enumerate(g for g in groups if g not in out):
        out[g] = k % max(1, len(names))
    return out


def assign_clustered(nodes: DataFrame, pop: DataFrame, budget: DataFrame, communities: int, clusters: int | None = None, seed: int = 42) -> DataFrame:
    """Clusters of linked groups get communities by their people; a group spreads over its cluster's."""
    from kinweave.operators.allocate import cumulative_split

    _positive(communities)
    spark, at = nodes.sparkSession, cluster_groups(pop, budget, clusters or communities)
    table = spark.createDataFrame([(int(g), int(c)) for g, c in at.items()], "group_id long, cluster_id long")
    mass = table.join(nodes.groupBy("group_id").agg(F.count("*").alias("n")), "group_id", "left").groupBy("cluster_id").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("mass"))
    homes = {r["cluster_id"]: range(r["start"], r["start"] + r["size"]) for r in cumulative_split(mass, communities).collect()}
    return _with_homes(nodes, {g: list(homes[c]) for g, c in at.items()}, seed)


def assign_adaptive(nodes: DataFrame, pop: DataFrame, budget: DataFrame, communities: int, seed: int = 42) -> DataFrame:
    """Hubs first, each group joins one community of every placed neighbour and fills up to its spread factor."""
    _positive(communities)
    k = {r["group_id"]: r["k"] for r in spread_factor(nodes, pop, budget, communities).collect()}
    near, out = defaultdict(set), defaultdict(int)
    for g, h, n in _budget_rows(budget):
        near[g].add(h)
        near[h].add(g)
        out[g] += n
    homes: dict[int, list[int]] = {}
    for g in sorted(k, key=lambda x: (-sum(out[h] for h in near[x]), x)):
        own: list[int] = []
        for h in sorted(near[g] & homes.keys()):
            if len(own) < k[g]:
                c = homes[h][int(_chance(seed, "share", g, h) * len(homes[h]))]
                own += [c] * (c not in own)
        rest = sorted((c for c in range(communities) if c not in own), key=lambda c: (_chance(seed, "fill", g, c), c))
        homes[g] = (own + rest)[: max(1, k[g])]
    return _with_homes(nodes, homes, seed)


def assign_segregation(nodes: DataFrame, pop: DataFrame, budget: DataFrame, attrs: list[str], communities: int, threshold: float = 0.05, seed: int = 42) -> DataFrame:
    """Values of the one or two most isolated attributes are blocks with communities by people; groups stay in their block.

    More blocks than communities share communities round robin.
    """
    from kinweave.operators.allocate import proportional_alloc

    _positive(communities)
    marked = isolation(pop, nodes, budget, attrs).where(F.col("isolation") >= threshold).orderBy(F.desc("isolation"), "attribute").limit(2)
    keys = [r["attribute"] for r in marked.collect()]
    groups = pop.select("group_id", F.concat_ws("|", *[F.col(a).cast("string") for a in keys]).alias("block"))
    mass = groups.join(nodes.groupBy("group_id").agg(F.count("*").alias("n")), "group_id", "left").groupBy("block").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    shares, start = {}, 0
    for r in proportional_alloc(mass, communities, "n", "block").orderBy("block").collect():
        shares[r["block"]] = [c % communities for c in range(start, start + r["size"])]
        start += r["size"]
    return _with_homes(nodes, {r["group_id"]: shares[r["block"]] for r in groups.collect()}, seed)


def soft_cost(x: Column, overshoot: float = 10.0) -> Column:
    return x * x * F.when(x >= 0, 1.0).otherwise(overshoot)


def _deal(batch: DataFrame, choices: DataFrame, heat: float, seed: int) -> DataFrame:
    """People of a batch in the communities of their group's ``choices`` (``g, community_id, cost``).

    Shares fall with the cost as in a softmax of temperature ``heat``; a group's people, in random
    order, are cut at the sums of its shares. One row for each choice and one for each person.
    """
    own = Window.partitionBy("g")
    weight = F.exp(-F.least((F.col("cost") - F.min("cost").over(own)) / max(heat, 1e-3), F.lit(60.0)))
    upto = own.orderBy(u(seed, "g", "community_id"), "community_id").rowsBetween(Window.unboundedPreceding, 0)
    sizes = batch.groupBy(F.col("group_id").alias("g")).agg(F.count("*").alias("n"))
    shares = choices.withColumn("w", weight).select("g", "community_id", (F.sum("w").over(upto) / F.sum("w").over(own)).alias("cum"))
    cuts = shares.join(sizes, "g").withColumn("hi", F.floor(F.col("n") * F.col("cum") + 1e-9))
    ends = cuts.withColumn("lo", F.coalesce(F.lag("hi").over(own.orderBy("cum", "community_id")), F.lit(0))).where("hi > lo")
    slots = ends.select(F.col("g").alias("group_id"), "community_id", F.explode(F.expr("sequence(lo + 1, hi)")).alias("rank"))
    ranked = rank_within(batch.withColumn("x", u(seed + 1, "node_id")), ["group_id"], "x", "node_id")
    return ranked.join(slots, ["group_id", "rank"]).select("node_id", "group_id", "community_id")


def assign_annealed(nodes: DataFrame, budget: DataFrame, communities: int, mode: str = "capacity", batches: int = 12, seed: int = 42, capacity: float | None = None, candidates: int = 500, fresh: int = 64) -> DataFrame:
    """Simulated annealing by batches of people, with falling temperature.

    A batch sees the composition that earlier ones left. ``capacity``: a
    community costs by how far the links that it would add to the group leave
    its budgets, overshoot ten times as much. ``probability``: by the distance
    of its mix of groups from the group's ideal row. A group's candidates are
    the communities where it has budgets with someone and ``fresh`` random ones,
    ``candidates`` at most, drawn at random; its people are dealt among them
    (``_deal``). A community above ``capacity`` people (default: a half more than
    the mean) is closed for the next batches, unless a group has no other.
    """
    _positive(communities)
    people = checkpoint(nodes.select("node_id", "group_id").withColumn("_batch", F.floor(u(seed, "node_id") * batches).cast("int")))
    limit = capacity or 1.5 * max(1, people.count()) / communities
    wanted = checkpoint(budget.where("target > 0").select("src_g", "dst_g", "target"))
    sym = wanted.select(F.col("src_g").alias("g"), F.col("dst_g").alias("h"), "target").unionAll(wanted.where("src_g <> dst_g").select("dst_g", "src_g", "target")).groupBy("g", "h").agg(F.sum("target").cast("double").alias("want"))
    sym, done = checkpoint(sym), None
    for b in range(batches):
        batch = people.where(F.col("_batch") == b)
        groups = batch.select(F.col("group_id").alias("g")).distinct()
        if communities <= fresh:
            new = groups.select("g", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(communities - 1).cast("long"))).alias("community_id"))
        else:
            drawn = groups.select("g", F.explode(F.sequence(F.lit(0), F.lit(fresh - 1))).alias("k"))
            new = drawn.select("g", F.floor(u(seed + 1, F.lit(b), "g", "k") * communities).cast("long").alias("community_id")).distinct()
        if done is None:
            choices = new.withColumn("cost", F.lit(0.0))
        else:
            comp = checkpoint(composition(done))
            size = comp.groupBy("community_id").agg(F.sum("n").alias("size"))
            have = comp.select("community_id", F.col("group_id").alias("h"), F.col("n").cast("double").alias("n"))
            if mode == "probability":
                share = have.join(size, "community_id").select("community_id", "h", (F.col("n") / F.col("size")).alias("share"))
                ideal = sym.join(groups, "g").withColumn("ideal", F.col("want") / (F.sum("want").over(Window.partitionBy("g")) + 1e-5))
                met = ideal.join(share, "h").groupBy("g", "community_id").agg(F.sum(F.col("ideal") * F.col("share")).alias("told"))
            else:
                acc = have.join(comp.select("community_id", F.col("group_id").alias("g"), F.col("n").alias("m")), "community_id").groupBy("g", "h").agg(F.sum(F.col("n") * F.col("m")).alias("acc"))
                lack = sym.join(groups, "g").join(acc, ["g", "h"], "left").select("g", "h", (F.col("want") - F.coalesce("acc", F.lit(0.0))).alias("lack"))
                add = F.col("n") * F.when(F.col("g") == F.col("h"), 2.0).otherwise(1.0)
                met = lack.join(have, "h").groupBy("g", "community_id").agg(F.sum(soft_cost(F.col("lack") - add) - soft_cost(F.col("lack"))).alias("told"))
            both = met.unionAll(new.withColumn("told", F.lit(0.0))).groupBy("g", "community_id").agg(F.sum("told").alias("told"))
            both = rank_within(both.withColumn("x", u(seed + 2, F.lit(b), "g", "community_id")), ["g"], "x", "community_id").where(F.col("rank") <= candidates)
            known = both.join(size, "community_id", "left").withColumn("full", F.coalesce(F.col("size") >= limit, F.lit(False)))
            # A group whose candidates are all full keeps them.
            known = checkpoint(known.withColumn("none", F.min("full").over(Window.partitionBy("g"))).where("not full or none").select("g", "community_id", "told"))
            if mode == "probability":
                norm = share.groupBy("community_id").agg(F.sum(F.col("share") * F.col("share")).alias("nc"))
                rows = ideal.groupBy("g").agg(F.sum(F.col("ideal") * F.col("ideal")).alias("ng"))
                far = F.coalesce("nc", F.lit(0.0)) + F.coalesce("ng", F.lit(0.0)) - 2 * F.col("told")
                choices = known.join(norm, "community_id", "left").join(rows, "g", "left").select("g", "community_id", F.sqrt(F.greatest(far, F.lit(0.0))).alias("cost"))
            else:
                widest = F.greatest(F.max(F.abs("told")).over(Window.partitionBy("g")), F.lit(1e-9))
                choices = known.select("g", "community_id", (F.col("told") / widest).alias("cost"))
        # Sharper than one, or costs within [-1, 1] would hardly tell.
        placed = _deal(batch.select("node_id", "group_id"), choices, 0.5 * (1.0 - b / batches) ** 2, seed + 100 * (b + 1))
        done = checkpoint(placed if done is None else done.unionByName(placed))
    return done


def assign_by_size(nodes: DataFrame, targets: DataFrame, seed: int = 42) -> DataFrame:
    """Communities of given sizes (``rank, target``, from 1): people are dealt to them round robin over the groups.

    People beyond the sizes' sum begin again at the first community; every community has a mix of groups.
    """
    from kinweave.operators.sensitivity import interleaved

    upto = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)  # one row for each community
    starts = checkpoint(targets.withColumn("start", F.coalesce(F.sum("target").over(upto), F.lit(0))))
    slots = starts.where("target > 0").select((F.col("rank") - 1).cast("long").alias("community_id"), F.explode(F.expr("sequence(start, start + target - 1)")).alias("slot"))
    room = starts.agg(F.sum("target")).first()[0] or 0
    if not room:
        raise ValueError("the communities have no room")
    placed = interleaved(nodes.select("node_id", "group_id"), "group_id", "node_id", seed)
    return placed.withColumn("slot", (F.col("place") - 1) % room).join(slots, "slot").select("node_id", "group_id", "community_id")


def _over(x: Column, overshoot: float = 10.0) -> Column:
    """The loss of a cell that is ``x`` above its target."""
    return x * x * F.when(x > 0, overshoot).otherwise(1.0)


def swap_deltas(swaps: DataFrame, matched: DataFrame, cells: DataFrame) -> DataFrame:
    """``swap, delta``: the change of the loss by each swap alone, from the cells that it touches.

    ``swaps``: ``swap, pair, a, b``, a person of group a leaving side 0 of the pair for side 1 and one of
    group b coming back. ``matched``: ``pair, h, m``, people of group h on side 0 less those on side 1.
    ``cells``: ``src_g, dst_g, x``, what each pair of groups has above its target; others have 0.
    With d = -1 for a and 1 for b, a cell changes by d(g) m(h) + d(h) m(g) + 2 d(g) d(h).
    """
    cell = lambda g, h, v: F.struct(F.col(g).alias("src_g"), F.col(h).alias("dst_g"), v.cast("double").alias("v"))
    m = F.col("m")
    linear = swaps.join(matched, "pair").select("swap", F.explode(F.array(cell("a", "h", -m), cell("h", "a", -m), cell("b", "h", m), cell("h", "b", m))).alias("c"))
    square = swaps.select("swap", F.explode(F.array(cell("a", "a", F.lit(2)), cell("b", "b", F.lit(2)), cell("a", "b", F.lit(-2)), cell("b", "a", F.lit(-2)))).alias("c"))
    touched = linear.unionAll(square).groupBy("swap", "c.src_g", "c.dst_g").agg(F.sum("c.v").alias("v")).where("v <> 0")
    x = F.coalesce("x", F.lit(0.0))
    return touched.join(cells, ["src_g", "dst_g"], "left").groupBy("swap").agg(F.sum(_over(x + F.col("v")) - _over(x)).alias("delta"))


def refine_by_swaps(membership: DataFrame, budget: DataFrame, rounds: int = 10, seed: int = 42, temperature: float = 0.0, proposals: int = 8, biased: float = 0.8) -> DataFrame:
    """Swap rounds that lower the loss between achieved and targeted pairs.

    In a round communities are matched in random pairs. Each pair proposes
    ``proposals`` swaps of two people of different groups; in a share ``biased``
    of them a person's chance grows with what the own group has above its
    targets. Each swap's change of the loss is computed from the cells it
    touches; the best of a pair is taken if it lowers the loss, or by the
    temperature's chance, which falls to 0. Swaps of a round share cells: where
    together they raise the loss, a half, a quarter, ... of them is taken
    instead, so the loss never rises at temperature 0.
    """
    at = checkpoint(membership.select("node_id", "group_id", "community_id"))
    goal = checkpoint(budget.select("src_g", "dst_g", F.col("target").cast("double").alias("target")))

    def above(at: DataFrame) -> DataFrame:
        j = goal.join(achieved_pairs(at), ["src_g", "dst_g"], "full_outer")
        return checkpoint(j.select("src_g", "dst_g", (F.coalesce("achieved", F.lit(0)).cast("double") - F.coalesce("target", F.lit(0.0))).alias("x")))

    total = lambda cells: cells.agg(F.sum(_over(F.col("x")))).first()[0] or 0.0
    cells = above(at)
    loss = total(cells)
    for r in range(rounds):
        ids = at.select("community_id").distinct().withColumn("all", F.lit(0)).withColumn("x", u(seed, F.lit(r), "community_id"))
        place = F.col("rank") - 1
        pairs = checkpoint(rank_within(ids, ["all"], "x", "community_id").select("community_id", F.floor(place / 2).alias("pair"), (place % 2).alias("side")))
        heavy = cells.groupBy(F.col("src_g").alias("group_id")).agg(F.sum(F.greatest("x", F.lit(0.0))).alias("w"))
        people = at.join(pairs, "community_id").join(heavy, "group_id", "left").withColumn("cell", F.pmod(F.xxhash64(F.lit(seed + r), "node_id"), F.lit(proposals)))
        weight = F.when(F.col("cell") < round(biased * proposals), F.coalesce("w", F.lit(0.0)) + 1e-9).otherwise(1.0)
        race = -F.log(1 - u(seed + 1, F.lit(r), "node_id") + 1e-18) / weight
        drawn = people.groupBy("pair", "cell", "side").agg(F.min_by(F.struct("node_id", "group_id", "community_id"), F.struct(race, F.col("node_id"))).alias("p"))
        a, b = drawn.where("side = 0").select("pair", "cell", F.col("p").alias("p")), drawn.where("side = 1").select("pair", "cell", F.col("p").alias("q"))
        met = a.join(b, ["pair", "cell"]).where("p.group_id <> q.group_id").select((F.col("pair") * proposals + F.col("cell")).alias("swap"), "pair", "p", "q", F.col("p.group_id").alias("a"), F.col("q.group_id").alias("b"))
        met = checkpoint(met)
        matched = composition(at).join(pairs, "community_id").groupBy("pair", F.col("group_id").alias("h")).agg(F.sum(F.when(F.col("side") == 0, F.col("n")).otherwise(-F.col("n"))).alias("m"))
        deltas = swap_deltas(met.select("swap", "pair", "a", "b"), matched, cells)
        heat = temperature * (1 - r / rounds)
        wanted = F.col("delta") < (-heat * F.log(1 - u(seed + 2, F.lit(r), "swap") + 1e-18) if heat > 0 else F.lit(0.0))
        best = met.join(deltas.where(wanted), "swap").groupBy("pair").agg(F.min_by(F.struct("p", "q"), F.struct("delta", "swap")).alias("s"))
        best = checkpoint(best.select(F.col("s.p").alias("p"), F.col("s.q").alias("q"), u(seed + 3, F.lit(r), "pair").alias("turn")))
        if best.isEmpty():
            continue
        for share in (1.0, 0.5, 0.25, 0.125, 0.0625):
            taken = best.where(F.col("turn") < share)
            move = lambda x, y: F.struct(F.col(f"{x}.node_id").alias("node_id"), F.col(f"{y}.community_id").alias("to"))
            moves = taken.select(F.explode(F.array(move("p", "q"), move("q", "p"))).alias("m")).select("m.*")
            new = checkpoint(at.join(moves, "node_id", "left").select("node_id", "group_id", F.coalesce("to", "community_id").alias("community_id")))
            told = above(new)
            now = total(told)
            if now < loss or (heat > 0 and math.exp(-(now - loss) / heat) > _chance(seed, "accept", r)):
                at, cells, loss = new, told, now
                break
    return at


def create_communities(nodes: DataFrame, pop: DataFrame, budget: DataFrame, attrs: list[str], communities: int, mode: str = "capacity", seed: int = 42, refine_rounds: int = 10, sizes: str | list[float] | None = None) -> DataFrame:
    """People with a community by a named strategy; an unknown name is an error.

    ``sizes``: a law or shares of the communities' sizes, for the capacity strategies: people are dealt to
    such sizes first, and swaps keep them.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode}; known are {sorted(MODES)}")
    _positive(communities)
    kind = MODES[mode]
    if kind == "none" or communities == 1:
        return assign_single(nodes)
    if kind == "clustered":
        return assign_clustered(nodes, pop, budget, communities, seed=seed)
    if kind == "adaptive":
        return assign_adaptive(nodes, pop, budget, communities, seed)
    if kind == "segregation":
        return assign_segregation(nodes, pop, budget, attrs, communities, seed=seed)
    if kind == "probability":
        return assign_annealed(nodes, budget, communities, "probability", seed=seed)
    if sizes is not None:
        out = assign_by_size(nodes, size_targets(nodes.agg(F.count("*").alias("n")), communities, sizes, sizes != "normal", seed), seed)
        return refine_by_swaps(out, budget, refine_rounds, seed) if refine_rounds else out
    out = assign_fast(nodes, communities, seed) if kind == "capacity_fast" else assign_annealed(nodes, budget, communities, seed=seed)
    return refine_by_swaps(out, budget, refine_rounds, seed) if refine_rounds else out
