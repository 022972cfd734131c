"""Writers of graphs, communities, metrics and resumable results."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.sources.sweeps import children, exists, file_system, read_json, read_or_create


def write_graph(nodes: DataFrame, edges: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Nodes and edges as two tables; an existing graph is replaced only on request (``mode='overwrite'``)."""
    nodes.write.mode(mode).parquet(f"{path}/nodes")
    edges.write.mode(mode).parquet(f"{path}/edges")


def write_membership(membership: DataFrame, budget: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Communities of people, and the row-normalised budgets as sparse cells."""
    from kinweave.operators.network import normalised

    membership.write.mode(mode).parquet(f"{path}/membership")
    normalised(budget.where("target > 0")).select("src_g", "dst_g", "p").write.mode(mode).parquet(f"{path}/probabilities")


def metadata(nodes: DataFrame, edges: DataFrame, **parameters) -> str:
    """A small JSON record of a graph's size and parameters."""
    return json.dumps({"nodes": nodes.count(), "edges": edges.count(), **parameters}, sort_keys=True)


def missing_keys(wanted: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Work that has no result yet."""
    return wanted.join(done.select(*keys).distinct(), keys, "left_anti")


def append_results(rows: DataFrame, path: str, keys: list[str]) -> int:
    """Append rows whose keys are not there yet; the number of new rows."""
    spark = rows.sparkSession
    if exists(spark, path):
        rows = missing_keys(rows, spark.read.parquet(path), keys)
    rows = rows.cache()
    try:
        rows.write.mode("append").parquet(path)
        return rows.count()
    finally:
        rows.unpersist()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small text file in any store that Spark writes; it replaces an earlier one."""
    where, fs = file_system(spark, path)
    out = fs.create(where, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


def write_hierarchy(levels: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A hierarchical assignment (``node_id, macro_id, community_id``): people, and the communities of each macro community."""
    levels.write.mode(mode).parquet(f"{path}/people")
    levels.groupBy("macro_id", "community_id").agg(F.count("*").alias("people")).write.mode(mode).parquet(f"{path}/communities")


def write_sample_edges(edges: DataFrame, path: str, sample_id: int, label: str, **parameters) -> None:
    """A sample's links under ``sample_id=.../label=...`` with compact ids, and a small record of it beside them."""
    from kinweave.operators.metrics import compact, simple_edges

    where = f"{path}/sample_id={sample_id}/label={label}"
    compact(simple_edges(edges)).write.mode("overwrite").parquet(f"{where}/edges")
    count = edges.sparkSession.read.parquet(f"{where}/edges").count()
    write_text(edges.sparkSession, f"{where}/meta.json", json.dumps({"sample_id": sample_id, "label": label, "edges": count, **parameters}, sort_keys=True))


def metric_record(spark: SparkSession, path: str, key: str, measure) -> bool:
    """Write ``measure()``'s one row of metrics, or its error, once for each key; whether it was measured now.

    A network that can't be measured leaves a record with its error and doesn't stop the others.
    """
    if exists(spark, f"{path}/{key}.json"):
        return False
    try:
        record = {"file_path": key, "error": None, **measure().first().asDict()}
    except Exception as e:  # the record says why
        record = {"file_path": key, "error": f"{type(e).__name__}: {e}"[:500]}
    write_text(spark, f"{path}/{key}.json", json.dumps(record, sort_keys=True, default=str))
    return True


def write_trajectory(spark: SparkSession, trail: list[dict], path: str, by: str = "loss") -> dict:
    """A search's steps as CSV and its best step as JSON; the best step (ties: the first)."""
    best = min(trail, key=lambda r: r[by])
    names = list(dict.fromkeys(k for r in trail for k in r))
    cell = lambda v: "" if v is None else json.dumps(v) if isinstance(v, str) else str(v)
    write_text(spark, f"{path}/trajectory.csv", "\n".join([",".join(names), *(",".join(cell(r.get(k)) for k in names) for r in trail)]) + "\n")
    write_text(spark, f"{path}/best.json", json.dumps(best, sort_keys=True))
    return best


class Trials:
    """A search's trials, one JSON file each, so that a stopped search goes on where it was."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def known(self) -> list[dict]:
        """Earlier trials in order; a broken file ends them, as its trial is run again."""
        out = []
        for at in children(self.spark, self.path, "trial_*.json"):
            try:
                out.append(read_json(self.spark, at))
            except ValueError:
                break
        return out

    def add(self, trial: dict) -> None:
        write_text(self.spark, f"{self.path}/trial_{trial['trial']:06d}.json", json.dumps(trial, sort_keys=True))


def cached_partition(spark: SparkSession, path: str, key: str, make) -> DataFrame:
    """A partition of a network (``node_id, community_id``) that is found once for each key."""
    return read_or_create(spark, f"{path}/{key}", make)


def write_json_lines(rows: DataFrame, path: str, mode: str = "append") -> None:
    """Results as JSON lines; rows that are there stay."""
    rows.write.mode(mode).json(path)


def write_csv(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV with a header; arrays become comma-joined text."""
    flat = [F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c) if t.startswith("array") else F.col(c) for c, t in rows.dtypes]
    rows.select(*flat).write.mode(mode).option("header", True).csv(path)


def heatmap(rows: DataFrame, by: str, across: str, value: str) -> DataFrame:
    """The data of a heat map: one row each, one column for each value of ``across``, widest maximum first."""
    order = [r[across] for r in rows.groupBy(across).agg(F.max(value).alias("m")).orderBy(F.desc("m"), across).collect()]
    return rows.groupBy(by).pivot(across, order).agg(F.first(value))
