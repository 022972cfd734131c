"""Command line: generate a network, measure it, search for parameters, study a sweep."""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F

from kinweave import api, calibrate
from kinweave.operators import contagion, sensitivity
from kinweave.session import build_session
from kinweave.sources import readers, sinks, sweeps

RATES = ("attachment", "reciprocity", "transitivity", "bridge")


def _network(p: argparse.ArgumentParser) -> None:
    for name in ("population", "interactions", "out"):
        p.add_argument(f"--{name}", required=True)
    p.add_argument("--scale", type=float, default=1.0)
    p.add_argument("--mode", default="capacity", choices=sorted(api.C.MODES))
    p.add_argument("--seed", type=int, default=42)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="kinweave", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)
    p = sub.add_parser("generate", help="unfold aggregate tables into a network and write it")
    _network(p)
    p.add_argument("--communities", type=int, default=1)
    p.add_argument("--sizes", choices=["powerlaw", "uniform", "normal"])
    for name in RATES:
        p.add_argument(f"--{name}", type=float, default=0.0)
    p.add_argument("--overwrite", action="store_true")
    for name, help_, n in (("calibrate", "annealed search for the targets", 60), ("search", "independent trials", 25)):
        p = sub.add_parser(name, help=help_)
        _network(p)
        p.add_argument("--steps", type=int, default=n)
        p.add_argument("--most-communities", type=int, default=35000)
    p = sub.add_parser("grid", help="evaluate every point of a grid, and show the best")
    _network(p)
    p.add_argument("--communities", type=int, nargs="+", default=[1, 33, 1063, 35000])
    for name in RATES:
        p.add_argument(f"--{name}", type=float, nargs="+", default=[0.0])
    p = sub.add_parser("metrics", help="a record of metrics for each written network; errors are recorded")
    p.add_argument("--networks", nargs="+", required=True)
    p.add_argument("--out", required=True)
    p = sub.add_parser("aggregate", help="metric records and a design as one CSV")
    p.add_argument("--records", required=True)
    p.add_argument("--samples", required=True)
    p.add_argument("--out", required=True)
    p = sub.add_parser("pawn", help="PAWN indices of every number column on every other, from a table with a label")
    p.add_argument("--table", required=True)
    p.add_argument("--inputs", nargs="+", required=True)
    p.add_argument("--label")
    p.add_argument("--replicates", type=int, default=200)
    p.add_argument("--out", required=True)
    p = sub.add_parser("contagion", help="threshold contagion on every network of a sweep, by ways of seeding")
    p.add_argument("--sweep", required=True)
    p.add_argument("--out", required=True)
    p.add_argument("--thresholds", type=float, nargs="+", default=[0.05, 0.175, 0.3])
    p.add_argument("--sims", type=int, default=20)
    p.add_argument("--seeds", type=int, default=20)
    p.add_argument("--undirected", action="store_true")
    return top


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    spark = build_session()
    if a.command in ("generate", "calibrate", "search", "grid"):
        net = api.unfold(spark, a.population, a.interactions, a.scale)
    if a.command == "generate":
        net = api.create_communities(net, a.communities, a.mode, a.seed, sizes=a.sizes)
        net = api.generate(net, seed=a.seed, **{k: getattr(a, k) for k in RATES})
        net.write(a.out, "overwrite" if a.overwrite else "errorifexists")
        sinks.write_text(spark, f"{a.out}/metadata.json", sinks.metadata(net.nodes, net.edges, **{k: v for k, v in vars(a).items() if k != "command"}))
        net.fulfilment().show()
    elif a.command in ("calibrate", "search"):
        bounds = {**calibrate.BOUNDS, "n_communities": (1, a.most_communities)}
        run = calibrate.calibrate if a.command == "calibrate" else calibrate.search
        print(run(net, a.out, bounds, a.steps, mode=a.mode, seed=a.seed))
    elif a.command == "grid":
        axes = {"n_communities": a.communities, **{k: getattr(a, k) for k in RATES}}
        calibrate.best_row(calibrate.pilot_grid(net, axes, a.out, mode=a.mode, seed=a.seed)).show()
    elif a.command == "metrics":
        for path in a.networks:
            sinks.metric_record(spark, a.out, sweeps.path_parts(path)["name"], lambda path=path: api.metrics(*readers.load_graph(spark, path)))
    elif a.command == "aggregate":
        records, samples = readers.metric_records(spark, a.records), readers.read_file(spark, a.samples)
        names = [c for c in sensitivity.numeric_columns(records, {"sample_id"})]
        long = records.withColumn("error", F.col("error").cast("string")).select("sample_id", "label", "error", F.explode(F.create_map(*[x for c in names for x in (F.lit(c), F.col(c).cast("double"))])).alias("metric", "value"))
        sinks.write_csv(sensitivity.mean_by_sample(long, samples.withColumn("sample_id", F.col("sample_id").cast("long"))), a.out)
    elif a.command == "pawn":
        rows = readers.read_file(spark, a.table)
        outputs = sensitivity.numeric_columns(rows, {*a.inputs, a.label or ""})
        pairs = sensitivity.unpivot(rows, a.inputs, outputs, a.label)
        index = sensitivity.pawn(pairs)
        keyed = pairs.withColumn("row", F.concat_ws("|", "x", "y"))
        sinks.write_csv(index.join(sensitivity.pawn_bootstrap(keyed, a.replicates), ["label", "input", "output"], "left"), f"{a.out}/indices")
        sinks.write_csv(sensitivity.mean_index(index), f"{a.out}/means")
    elif a.command == "contagion":
        ways = {
            "random": lambda n, e: contagion.seed_random(n, a.sims, a.seeds),
            "neighbors": lambda n, e: contagion.seed_neighbors(n, e, a.sims, None),
        }
        for folder in sweeps.sample_folders(spark, a.sweep) or [a.sweep]:
            for name, _, edges in sweeps.iter_networks(spark, folder, not a.undirected):
                nodes = edges.select(F.col("src").alias("node_id")).union(edges.select("dst")).distinct()
                calibrate.contagion_study([(f"{sweeps.path_parts(folder)['name']}/{name}", nodes, edges)], a.out, a.thresholds, ways).show()


if __name__ == "__main__":
    main()
