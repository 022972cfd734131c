"""What a user calls: from population and interaction files to a checked network."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.operators import communities as C
from kinweave.operators import metrics as M
from kinweave.operators.edges import create_edges
from kinweave.operators.iterative import coreness, pagerank, strong_components, weak_components
from kinweave.operators.network import actual_pairs, check_pairs, fulfilment, pair_budget, unfold_nodes
from kinweave.scratch import checkpoint
from kinweave.sources import readers, sinks


@dataclass
class Network:
    """People, groups, budgets, communities and links of one generated network."""

    population: DataFrame
    attributes: list[str]
    nodes: DataFrame
    budget: DataFrame
    membership: DataFrame | None = None
    edges: DataFrame | None = None
    communities: int = 1

    def check(self) -> DataFrame:
        """Targets against actual links of every pair of groups."""
        return check_pairs(self.budget, actual_pairs(self.edges, self.nodes))

    def fulfilment(self) -> DataFrame:
        return fulfilment(self.budget, actual_pairs(self.edges, self.nodes))

    def write(self, path: str, mode: str = "errorifexists") -> None:
        sinks.write_graph(self.nodes.join(F.broadcast(self.population.drop("n")), "group_id"), self.edges, path, mode)
        if self.membership is not None:
            sinks.write_membership(self.membership, self.budget, path, mode)


def unfold(spark: SparkSession, population_path: str, interactions_path: str, scale: float = 1.0, count: str = "n", link: str = "n", src: str = "_src", dst: str = "_dst") -> Network:
    """People and budgets from the two aggregate tables."""
    pop, attrs = readers.population(spark, population_path, count)
    pop = checkpoint(pop)
    inter = readers.interactions(spark, interactions_path, attrs, src, dst, link)
    return Network(pop, attrs, checkpoint(unfold_nodes(pop, scale)), checkpoint(pair_budget(inter, pop, attrs, scale)))


def create_communities(net: Network, communities: int, mode: str = "capacity", seed: int = 42, refine_rounds: int = 10, sizes: str | list[float] | None = None) -> Network:
    """The network with people assigned to communities by a named strategy."""
    net.membership = checkpoint(C.create_communities(net.nodes, net.population, net.budget, net.attributes, communities, mode, seed, refine_rounds, sizes))
    net.communities = communities
    return net


def generate(net: Network, *, attachment: float = 0.0, reciprocity: float = 0.0, transitivity: float = 0.0, bridge: float = 0.0, known: DataFrame | None = None, within_only: bool = False, seed: int = 42) -> Network:
    """The network with links up to its budgets; ``within_only`` links every two people of a community instead."""
    if net.membership is None:
        net = create_communities(net, 1, "none")
    if within_only:
        net.edges = checkpoint(C.clique_edges(net.membership).select("src", "dst"))
        return net
    places = C.coordinates(net.membership, seed) if net.communities > 1 else None
    net.edges = create_edges(net.nodes, net.budget, net.membership, net.communities, attachment=attachment, reciprocity=reciprocity, transitivity=transitivity, bridge=bridge, known=known, coordinates=places, seed=seed)
    return net


def metrics(nodes: DataFrame, edges: DataFrame, membership: DataFrame | None = None, iterative: bool = True) -> DataFrame:
    """One row of scalars that describe a network."""
    edges = checkpoint(M.simple_edges(edges))
    degree = checkpoint(M.degrees(nodes, edges))
    parts = [
        M.density(nodes, edges), M.degree_stats(degree), M.degree_fractions(degree), M.reciprocity(edges),
        M.global_clustering(edges), M.local_clustering(nodes, edges).agg(F.avg("clustering").alias("mean_local_clustering")),
        M.average_neighbor_degree(nodes, edges).agg(F.avg("knn").alias("mean_knn")),
    ]
    if iterative:
        weak, strong = weak_components(nodes, edges), strong_components(nodes, edges)
        sizes = lambda labels, name: labels.groupBy("component").agg(F.count("*").alias("k")).agg(F.count("*").alias(f"n_{name}"), (F.max("k") / F.sum("k")).alias(f"{name}_largest"))
        parts += [sizes(weak, "weak"), sizes(strong, "strong"), coreness(nodes, edges).agg(F.avg("core").alias("mean_core"), F.max("core").alias("max_core")), pagerank(nodes, edges, 100, tolerance=1e-9).agg(F.max("rank").alias("max_pagerank"))]
    if membership is not None:
        parts.append(M.modularity(edges, membership, "community_id"))
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)  # one row each
    return out
