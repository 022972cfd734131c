"""Sweeps, stores, searches, swaps and size laws on small inline tables."""

import itertools
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinweave import __main__ as cli
from kinweave import api, calibrate
from kinweave.operators import communities as C
from kinweave.operators import contagion, sensitivity
from kinweave.sources import sinks, sweeps


def people(spark, n=90, groups=3):
    return spark.createDataFrame([(i, i % groups) for i in range(n)], "node_id long, group_id long")


@pytest.fixture()
def net(spark):
    pop = spark.createDataFrame([(g, f"v{g}", 20) for g in range(3)], "group_id long, kind string, n long")
    budget = spark.createDataFrame([(g, h, 60 if g == h else 10) for g in range(3) for h in range(3)], "src_g long, dst_g long, target long")
    return api.Network(pop, ["kind"], people(spark, 60), budget)


def loss_of(member, goal, groups):
    n = np.zeros((max(member[:, 1]) + 1, groups))
    for g, c in member:
        n[c, g] += 1
    x = n.T @ n - goal
    return float((x * x * np.where(x > 0, 10, 1)).sum())


def test_swap_deltas_brute_force(spark):
    r = np.random.default_rng(3)
    member = np.array([(int(r.integers(4)), int(r.integers(2))) for _ in range(40)])
    goal = r.integers(0, 120, (4, 4))
    cells_now = np.zeros((2, 4))
    for g, c in member:
        cells_now[c, g] += 1
    x = cells_now.T @ cells_now - goal
    cells = spark.createDataFrame([(a, b, float(x[a, b])) for a in range(4) for b in range(4)], "src_g long, dst_g long, x double")
    matched = spark.createDataFrame([(0, g, int(cells_now[0, g] - cells_now[1, g])) for g in range(4)], "pair long, h long, m long")
    swaps, want = [], {}
    side = {c: [g for g in range(4) if cells_now[c, g]] for c in (0, 1)}
    for k, (a, b) in enumerate(p for p in itertools.product(side[0], side[1]) if p[0] != p[1]):
        i = next(i for i, m in enumerate(member) if tuple(m) == (a, 0))
        j = next(i for i, m in enumerate(member) if tuple(m) == (b, 1))
        moved = member.copy()
        moved[i, 1], moved[j, 1] = 1, 0
        swaps.append((k, 0, a, b))
        want[k] = loss_of(moved, goal, 4) - loss_of(member, goal, 4)
    got = {r["swap"]: r["delta"] for r in C.swap_deltas(spark.createDataFrame(swaps, "swap long, pair long, a long, b long"), matched, cells).collect()}
    assert got == pytest.approx({k: v for k, v in want.items()}) and len(got) > 4


def test_swaps_lower_the_loss_clearly(spark):
    nodes = people(spark, 120, 4)
    budget = spark.createDataFrame([(g, h, 300 if g == h else 0) for g in range(4) for h in range(4)], "src_g long, dst_g long, target long")
    start = C.assign_fast(nodes, 12)
    after = C.refine_by_swaps(start, budget, 10)
    before, now = (C.swap_loss(budget, m).first()["loss"] for m in (start, after))
    assert now < 0.8 * before
    sizes = lambda m: sorted((r["community_id"], r["count"]) for r in m.groupBy("community_id").count().collect())
    assert sizes(start) == sizes(after) and after.select("node_id").distinct().count() == 120


@pytest.mark.parametrize("law", ["powerlaw", "uniform", "normal", [0.7, 0.2, 0.1]])
def test_size_laws(spark, law):
    nodes = people(spark)
    m = C.create_communities(nodes, None, None, [], 3, "capacity", refine_rounds=0, sizes=law)
    sizes = {r["community_id"]: r["count"] for r in m.groupBy("community_id").count().collect()}
    assert sum(sizes.values()) == 90 and len(sizes) == 3
    if law == "uniform":
        assert set(sizes.values()) == {30}
    if law == "powerlaw":
        assert sizes[0] > sizes[1] > sizes[2]
    if isinstance(law, list):
        assert sizes == {0: 63, 1: 18, 2: 9}
        mixed = m.where("community_id = 2").groupBy("group_id").count().collect()
        assert {r["count"] for r in mixed} == {3}
    with pytest.raises(ValueError):
        C.size_targets(nodes.agg(F.count("*").alias("n")), 3, "unheard-of", False)


def test_round_robin_order(spark):
    got = sensitivity.interleaved(spark.createDataFrame([(i, i // 4) for i in range(10)], "node_id long, group_id long"), "group_id", "node_id").orderBy("place").collect()
    assert [r["place"] for r in got] == list(range(1, 11))
    assert [r["group_id"] for r in got] == [0, 1, 2, 0, 1, 2, 0, 1, 0, 1]


def test_sweep_folders_and_networks(spark, tmp_path):
    base = str(tmp_path / "sweep")
    for k in (2, 1):
        edges = spark.createDataFrame([(0, 1), (0, 1), (1, 0), (2, 2)], "src long, dst long")
        edges.write.parquet(f"{base}/sample_{k}/net/gen/edges")
        sinks.write_text(spark, f"{base}/sample_{k}/net/params.json", json.dumps({"k": k}))
        edges.write.parquet(f"{base}/sample_{k}/broken/gen/edges")
    found = sweeps.sample_folders(spark, base)
    assert [f[-8:] for f in found] == ["sample_1", "sample_2"] and sweeps.sample_folders(spark, str(tmp_path / "no")) == []
    (name, told, edges), = sweeps.iter_networks(spark, found[0])
    assert (name, told) == ("net", {"k": 1}) and {tuple(r) for r in edges.collect()} == {(0, 1, 2), (1, 0, 1), (2, 2, 1)}
    (_, _, plain), = sweeps.iter_networks(spark, found[0], directed=False)
    assert {tuple(r) for r in plain.collect()} == {(0, 1, 1), (1, 0, 1)}
    assert sweeps.path_parts("a/b/sample_1.tar.gz") == {"folder": "a/b", "name": "sample_1.tar.gz", "stem": "sample_1.tar", "ending": "gz"}
    made = []
    make = lambda: made.append(1) or spark.range(3)
    for _ in range(2):
        assert sweeps.read_or_create(spark, f"{base}/design", make).count() == 3
    assert len(made) == 1
    ways = {"random": lambda n, e: contagion.seed_random(n, 2, 1)}
    nodes = spark.range(3).withColumnRenamed("id", "node_id")
    for _ in range(2):
        assert calibrate.contagion_study([("net", nodes, edges)], f"{base}/contagion", [0.5, 1.0], ways).count() == 2


def test_stores(spark, tmp_path):
    out = str(tmp_path)
    assert sinks.metric_record(spark, f"{out}/m", "sample_00001_a", lambda: spark.range(1).select(F.lit(0.5).alias("t")))
    assert not sinks.metric_record(spark, f"{out}/m", "sample_00001_a", lambda: 1 / 0)
    assert sinks.metric_record(spark, f"{out}/m", "sample_00001_b", lambda: 1 / 0)
    kept = {r["label"]: r for r in __import__("kinweave.sources.readers", fromlist=["x"]).metric_records(spark, f"{out}/m/*.json").collect()}
    assert kept["a"]["t"] == 0.5 and kept["b"]["error"].startswith("ZeroDivisionError")
    trials = sinks.Trials(spark, f"{out}/t")
    assert trials.known() == []
    trials.add({"trial": 0, "loss": 2.0})
    trials.add({"trial": 1, "loss": 1.0})
    sinks.write_text(spark, f"{out}/t/trial_000002.json", "{half")
    assert [t["loss"] for t in trials.known()] == [2.0, 1.0]
    assert sinks.write_trajectory(spark, trials.known(), f"{out}/best")["trial"] == 1
    assert (tmp_path / "best" / "trajectory.csv").read_text() == "loss,trial\n2.0,0\n1.0,1\n"
    sinks.write_sample_edges(spark.createDataFrame([(10, 20), (20, 10), (10, 10)], "src long, dst long"), out, 3, "x", scale=1)
    assert json.loads((tmp_path / "sample_id=3" / "label=x" / "meta.json").read_text()) == {"edges": 2, "label": "x", "sample_id": 3, "scale": 1}
    sinks.write_hierarchy(spark.createDataFrame([(0, 0, 1), (1, 0, 1)], "node_id long, macro_id long, community_id long"), f"{out}/h")
    assert spark.read.parquet(f"{out}/h/communities").first()["people"] == 2
    part = lambda: spark.createDataFrame([(0, 5)], "node_id long, community_id long")
    assert sinks.cached_partition(spark, f"{out}/p", "k", part).first()["community_id"] == 5
    sinks.write_json_lines(part(), f"{out}/j")
    sinks.write_json_lines(part(), f"{out}/j")
    assert spark.read.json(f"{out}/j").count() == 2


def test_searches_resume(spark, net, tmp_path, monkeypatch):
    calls = []

    def fake(net, point, **how):
        calls.append(point)
        if point["n_communities"] == 3:
            raise ValueError("no such network")
        return {"transitivity": 0.1, "modularity": 0.2, "skew": 0.3, "loss": abs(point["n_communities"] - 5) + point["attachment"]}

    monkeypatch.setattr(calibrate, "evaluate", fake)
    bounds = {"n_communities": (1, 9), "attachment": (0.0, 1.0)}
    first = calibrate.search(net, str(tmp_path / "s"), bounds, 4)
    assert len(calls) == 4 and calibrate.search(net, str(tmp_path / "s"), bounds, 6)["loss"] <= first["loss"] and len(calls) == 6
    del calls[:]
    whole = calibrate.calibrate(net, str(tmp_path / "c"), {"n_communities": (4, 9), "attachment": (0.0, 1.0)}, 5)
    n = len(calls)
    again = calibrate.calibrate(net, str(tmp_path / "c"), {"n_communities": (4, 9), "attachment": (0.0, 1.0)}, 5)
    assert whole == again and len(calls) == n
    axes = {"n_communities": [4, 5], "attachment": [0.0, 0.5]}
    assert calibrate.pilot_grid(net, axes, str(tmp_path / "g")).count() == 4
    n = len(calls)
    grid = calibrate.pilot_grid(net, {**axes, "n_communities": [4, 5, 6]}, str(tmp_path / "g"))
    assert grid.count() == 6 and len(calls) == n + 2
    assert calibrate.best_row(grid).first()["n_communities"] == 5


def test_one_evaluation(net):
    got = calibrate.evaluate(net, {"n_communities": 3, "transitivity": 0.1}, mode="capacity_fast", refine_rounds=1)
    assert set(got) == {"transitivity", "modularity", "skew", "loss"} and got["loss"] > 0


def test_plot_data_and_axes(spark):
    rows = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 3.0), ("b", "x", 2.0)], "label string, input string, index double")
    got = sinks.heatmap(rows, "label", "input", "index").orderBy("label")
    assert got.columns == ["label", "y", "x"] and [tuple(r) for r in got.collect()] == [("a", 3.0, 1.0), ("b", None, 2.0)]
    assert sensitivity.geometric_or_linear(1, 100, 3) == pytest.approx([1, 10, 100]) and sensitivity.geometric_or_linear(0, 1, 3) == [0, 0.5, 1]


def test_seeds_open_communities(spark, net):
    got = C.seed_nodes(net.nodes, net.population, net.budget, 2).collect()
    assert sorted(r["community_id"] for r in got) == [0, 1] and len({r["node_id"] % 3 for r in got}) == 2


def test_command_line():
    a = cli.parser().parse_args(["grid", "--population", "p", "--interactions", "i", "--out", "o", "--communities", "1", "5", "--bridge", "0.1"])
    assert (a.command, a.communities, a.bridge) == ("grid", [1, 5], [0.1])
    with pytest.raises(SystemExit):
        cli.parser().parse_args(["unheard-of"])
