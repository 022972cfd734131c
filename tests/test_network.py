"""Allocation, budgets, communities and edges on small inline tables."""

import pytest
from pyspark.sql import functions as F

from kinweave import api
from kinweave.operators import communities as C
from kinweave.operators import edges as E
from kinweave.operators import iterative as I
from kinweave.operators import metrics as M
from kinweave.operators import network as N
from kinweave.operators.allocate import cumulative_split, proportional_alloc, scaled_budget, stratified_allocate
from kinweave.sources import readers, sinks


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_allocation_sums_and_double_scale(spark):
    items = frame(spark, [(0, 100), (1, 50), (2, 50), (3, 0)], "group_id long, n long")
    got = {r["group_id"]: r["alloc"] for r in stratified_allocate(items, 0.29).collect()}
    assert sum(got.values()) == int(0.29 * 200)
    assert got[3] == 0 and got[0] >= 28
    empty = stratified_allocate(items.limit(0), 0.5)
    assert empty.count() == 0


def test_budget_adds_duplicates_and_drops_unknown_groups(spark):
    pop = frame(spark, [("m", 61, 0), ("f", 59, 1), (None, 3, 2)], "sex string, n long, group_id long")
    inter = frame(spark, [("m", "f", 140), ("m", "f", 10), ("x", "m", 5), (None, "f", 7)], "sex_src string, sex_dst string, n long")
    got = {(r["src_g"], r["dst_g"]): r["target"] for r in N.pair_budget(inter, pop, ["sex"]).collect()}
    assert got == {(0, 1): 150, (2, 1): 7}
    assert [r["sex_src"] for r in N.unresolved_pairs(inter, pop, ["sex"]).collect()] == ["x"]
    assert scaled_budget(frame(spark, [(0, 1, 3), (1, 0, 3)], "src_g long, dst_g long, n long"), 0.5).agg(F.sum("target")).first()[0] == 3


def test_splits(spark):
    w = frame(spark, [(0, 5), (1, 3), (2, 0)], "k long, w long")
    assert sum(r["size"] for r in proportional_alloc(w, 10, "w", "k").collect()) >= 10
    assert {r["size"] for r in proportional_alloc(frame(spark, [(0, 0), (1, 0)], "k long, w long"), 5, "w", "k").collect()} == {2, 3}
    rows = cumulative_split(frame(spark, [(0, 1), (1, 100), (2, 3)], "cluster_id long, mass long"), 7).orderBy("cluster_id").collect()
    assert sum(r["size"] for r in rows) == 7 and min(r["size"] for r in rows) >= 1
    assert [r["start"] for r in rows] == [0, rows[0]["size"], rows[0]["size"] + rows[1]["size"]]


TOY = [(0, 1), (1, 2), (2, 0), (2, 3), (4, 5), (5, 4)]


@pytest.fixture()
def toy(spark):
    return frame(spark, [(i,) for i in range(7)], "node_id long"), frame(spark, TOY, "src long, dst long")


def test_components_and_cores(toy):
    nodes, edges = toy
    assert {r["node_id"]: r["component"] for r in I.weak_components(nodes, edges).collect()} == {0: 0, 1: 0, 2: 0, 3: 0, 4: 4, 5: 4, 6: 6}
    assert {r["node_id"]: r["component"] for r in I.strong_components(nodes, edges).collect()} == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4, 5: 4, 6: 6}
    assert {r["node_id"]: r["core"] for r in I.coreness(nodes, edges).collect()} == {0: 2, 1: 2, 2: 2, 3: 1, 4: 2, 5: 2, 6: 0}
    assert abs(sum(r["rank"] for r in I.pagerank(nodes, edges, 30).collect()) - 1) < 1e-9
    assert {r["node_id"]: r["distance"] for r in I.bfs(edges, 0).collect()} == {0: 0, 1: 1, 2: 1, 3: 2}
    assert I.double_sweep(edges, 0).first()["diameter"] == 2


def test_clustering_by_hand(toy):
    nodes, edges = toy
    got = {r["node_id"]: r["clustering"] for r in M.local_clustering(nodes, edges).collect()}
    assert got[0] == 1.0 and abs(got[2] - 1 / 3) < 1e-12 and got[6] == 0.0
    assert abs(M.global_clustering(edges).first()["transitivity"] - 3 / 5) < 1e-12
    assert M.reciprocity(edges).first()["reciprocity"] == 2 / 6


def test_louvain_splits_two_cliques(spark):
    pairs = [(a, b) for k in (0, 10) for a in range(k, k + 5) for b in range(k, k + 5) if a < b] + [(0, 10)]
    nodes = frame(spark, [(i,) for k in (0, 10) for i in range(k, k + 5)], "node_id long")
    edges = frame(spark, pairs, "src long, dst long")
    found = I.louvain(nodes, edges)
    assert M.modularity(edges, found, "community").first()["modularity"] > 0.3


@pytest.fixture()
def small(spark):
    nodes = frame(spark, [(i, i % 3) for i in range(60)], "node_id long, group_id long")
    pop = frame(spark, [(g, f"v{g}", 20) for g in range(3)], "group_id long, kind string, n long")
    budget = frame(spark, [(g, h, 30 if g == h else 8) for g in range(3) for h in range(3)], "src_g long, dst_g long, target long")
    return nodes, pop, budget


@pytest.mark.parametrize("mode", ["none", "capacity_fast", "clustered", "adaptive", "segregation", "capacity", "probability"])
def test_every_strategy_assigns_everyone_once(small, mode):
    nodes, pop, budget = small
    m = C.create_communities(nodes, pop, budget, ["kind"], 4, mode, refine_rounds=1)
    rows = m.collect()
    assert len(rows) == 60 and len({r["node_id"] for r in rows}) == 60
    assert all(0 <= r["community_id"] < 4 for r in rows)


def test_fast_split_is_even_and_bad_arguments_fail(small):
    nodes, pop, budget = small
    sizes = C.assign_fast(nodes, 3).groupBy("group_id", "community_id").count().collect()
    assert {r["count"] for r in sizes} <= {6, 7}
    with pytest.raises(ValueError):
        C.create_communities(nodes, pop, budget, ["kind"], 0, "capacity")
    with pytest.raises(ValueError):
        C.create_communities(nodes, pop, budget, ["kind"], 2, "unheard-of")


def test_swaps_never_raise_the_loss(small):
    nodes, _, budget = small
    m = C.assign_fast(nodes, 4)
    before = C.swap_loss(budget, m).first()["loss"]
    after = C.refine_by_swaps(m, budget, 3)
    assert C.swap_loss(budget, after).first()["loss"] <= before
    assert after.groupBy("community_id").count().orderBy("community_id").collect() == m.groupBy("community_id").count().orderBy("community_id").collect()


def test_edges_keep_their_budgets(small):
    nodes, _, budget = small
    m = C.assign_fast(nodes, 2)
    e = E.create_edges(nodes, budget, m, 2, attachment=0.3, reciprocity=0.4, transitivity=0.2, rounds=2)
    rows = [(r["src"], r["dst"]) for r in e.collect()]
    assert len(rows) == len(set(rows)) and all(s != d for s, d in rows) and rows
    over = N.fulfilment(budget, N.actual_pairs(e, nodes)).first()
    assert over["overfulfilled"] == 0 and over["rate"] > 0.9


def test_files_round_trip(spark, tmp_path):
    (tmp_path / "pop_sex.csv").write_text("sex,n\nm,6\nf,4\n")
    (tmp_path / "interactions_sex.csv").write_text("sex_src,sex_dst,n\nm,f,9\nm,f,1\nf,m,5\nx,m,3\n")
    found, alone = readers.discover_pairs([str(p) for p in tmp_path.iterdir()])
    assert [f[0] for f in found] == ["sex"] and not alone
    net = api.generate(api.create_communities(api.unfold(spark, found[0][1], found[0][2]), 1, "none"))
    assert net.nodes.count() == 10 and net.fulfilment().first()["overfulfilled"] == 0
    net.write(str(tmp_path / "out"))
    nodes, edges = readers.load_graph(spark, str(tmp_path / "out"))
    assert nodes.count() == 10 and edges.count() == net.edges.count()
    rows = frame(spark, [(1, 2.0)], "k long, v double")
    assert sinks.append_results(rows, str(tmp_path / "r"), ["k"]) == 1
    assert sinks.append_results(rows, str(tmp_path / "r"), ["k"]) == 0
    with pytest.raises(ValueError):
        readers.read_file(spark, "x.txt")
