"""Readers of population, interaction, graph, community and metric files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def read_file(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A CSV or Parquet table by its ending; XLSX needs an installed reader; others are an error."""
    low = path.lower()
    if low.endswith(".parquet"):
        return spark.read.parquet(path)
    if low.endswith(".csv"):
        reader = spark.read.option("header", True).option("quote", '"').option("escape", '"')
        return (reader.schema(schema) if schema else reader).csv(path)
    if low.endswith((".xlsx", ".xls")):
        try:
            import openpyxl  # noqa: F401
        except ImportError as e:
            raise ValueError(f"{path}: reading spreadsheets needs openpyxl; save it as CSV") from e
        import pandas as pd

        return spark.createDataFrame(pd.read_excel(path, dtype=str).where(lambda x: x.notna(), None))
    raise ValueError(f"{path}: neither CSV, XLSX nor Parquet")


def population(spark: SparkSession, path: str, count: str = "n") -> tuple[DataFrame, list[str]]:
    """Groups with ``group_id`` (the row's place in the file), attributes as strings and ``n``; and the sorted attributes.

    A population file is one table of groups, small beside its people.
    """
    raw = read_file(spark, path)
    attrs = sorted(set(raw.columns) - {count})
    rows = raw.select(*[F.col(a).cast("string").alias(a) for a in attrs], F.col(count).cast("double").cast("long").alias("n"), F.monotonically_increasing_id().alias("_at"))
    return rows.withColumn("group_id", (F.row_number().over(Window.orderBy("_at")) - 1).cast("long")).drop("_at"), attrs


def interactions(spark: SparkSession, path: str, attrs: list[str], src: str = "_src", dst: str = "_dst", link: str = "n") -> DataFrame:
    raw = read_file(spark, path)
    return raw.select(*[F.col(a + s).cast("string").alias(a + t) for s, t in ((src, "_src"), (dst, "_dst")) for a in attrs], F.col(link).cast("double").cast("long").alias("n"))


def discover_pairs(paths: list[str], excluded: str | None = None, most_underscores: int | None = None) -> tuple[list[tuple[str, str, str]], list[str]]:
    """(label, population file, interaction file) of files that share a stem, and stems without a mate."""
    import posixpath
    import re

    stems: dict[str, dict[str, str]] = {"pop_": {}, "interactions_": {}}
    for p in sorted(paths):
        name = posixpath.basename(p).rsplit(".", 1)[0]
        for head, found in stems.items():
            if name.startswith(head):
                found[name.removeprefix(head)] = p
    pops, links = stems.values()
    good = lambda s: not (excluded and re.search(excluded, s)) and (most_underscores is None or s.count("_") < most_underscores)
    return [(s, pops[s], links[s]) for s in sorted(pops.keys() & links.keys()) if good(s)], sorted(pops.keys() ^ links.keys())


def edges_npz(spark: SparkSession, path: str) -> DataFrame:
    """``src, dst`` of a NumPy archive's first array: 2 x n is turned, self-loops and repeats go."""
    import numpy as np

    with np.load(path, allow_pickle=False) as z:
        e = np.asarray(z[z.files[0]])
    if e.ndim == 2 and e.shape[1] != 2 and e.shape[0] == 2:
        e = e.T
    if e.ndim != 2 or e.shape[1] != 2:
        raise ValueError(f"{path}: edges of shape {e.shape}, not n x 2")
    import pyarrow as pa

    t = pa.table({"src": e[:, 0].astype("int64"), "dst": e[:, 1].astype("int64")})
    return spark.createDataFrame(t).where("src <> dst").distinct()


def load_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a written graph."""
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")


def load_membership(nodes: DataFrame, membership: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Communities of known nodes, and the nodes that have none."""
    kept = nodes.select("node_id", "group_id").join(membership.select("node_id", "community_id"), "node_id")
    return kept, nodes.join(membership, "node_id", "left_anti")


def communities_json(spark: SparkSession, path: str) -> DataFrame:
    """``node_id, community_id`` of an exported assignment: a map of node to community."""
    doc = spark.read.option("multiLine", True).schema("number_of_communities long, nodes_to_communities map<string,long>").json(path)
    return doc.select(F.explode("nodes_to_communities").alias("n", "community_id")).select(F.col("n").cast("long").alias("node_id"), "community_id")


def metric_records(spark: SparkSession, path: str) -> DataFrame:
    """One row for each metric file, with ``sample_id`` and ``label`` from its name ``sample_00001_label.json``."""
    rows = spark.read.option("multiLine", True).json(path).withColumn("_f", F.element_at(F.split(F.input_file_name(), "/"), -1))
    pattern = r"^sample_(\d+)_(.+)\.json$"
    return rows.withColumn("sample_id", F.regexp_extract("_f", pattern, 1).cast("long")).withColumn("label", F.regexp_extract("_f", pattern, 2)).where("sample_id is not null").drop("_f")


def error_records(lines: DataFrame) -> DataFrame:
    """``status`` (ok, error, corrupt), ``file_path`` and ``error`` of JSON lines in column ``value``."""
    parsed = lines.select(F.from_json("value", "file_path string, error string").alias("r"))
    status = F.when(F.col("r.file_path").isNull(), "corrupt").when(F.col("r.error").isNotNull(), "error").otherwise("ok")
    return parsed.select(status.alias("status"), "r.file_path", "r.error")
