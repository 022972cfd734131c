"""Folders of a parameter sweep: samples, their networks and their designs."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.operators.metrics import undirected


def file_system(spark: SparkSession, path: str):
    """Hadoop's path and file system of a path: any store that Spark reads."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    where, fs = file_system(spark, path)
    return fs.exists(where)


def children(spark: SparkSession, path: str, pattern: str = "*") -> list[str]:
    """Paths below ``path`` that fit a glob pattern, in order; none if there is no such folder."""
    where, fs = file_system(spark, f"{path}/{pattern}")
    return sorted(str(s.getPath().toString()) for s in fs.globStatus(where) or [])


def path_parts(path: str) -> dict[str, str]:
    """``folder, name, stem, ending`` of a path with slashes."""
    folder, _, name = path.rstrip("/").rpartition("/")
    stem, dot, ending = name.rpartition(".")
    return {"folder": folder, "name": name, "stem": stem if dot and stem else name, "ending": ending if dot and stem else ""}


def sample_folders(spark: SparkSession, base: str) -> list[str]:
    """The ``sample_*`` folders of a sweep, in order."""
    return children(spark, base, "sample_*")


def read_json(spark: SparkSession, path: str) -> dict:
    rows = spark.read.text(path, wholetext=True).collect()
    return json.loads(rows[0]["value"]) if rows else {}


def iter_networks(spark: SparkSession, folder: str, directed: bool = True) -> Iterator[tuple[str, dict, DataFrame]]:
    """(name, parameters, ``src, dst, w``) of each ``<name>/gen`` graph of a sample with its ``params.json``.

    Repeated directed links add up in ``w``; an undirected network has each pair once, both ways, with weight 1.
    Folders without a graph or without parameters are left out.
    """
    for at in children(spark, folder):
        graph, told = f"{at}/gen/edges", f"{at}/params.json"
        if not exists(spark, graph) or not exists(spark, told):
            continue
        edges = spark.read.parquet(graph).select("src", "dst")
        if directed:
            out = edges.groupBy("src", "dst").agg(F.count("*").alias("w"))
        else:
            pairs = undirected(edges.where("src <> dst")).select(F.col("a").alias("src"), F.col("b").alias("dst"))
            out = pairs.unionAll(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).withColumn("w", F.lit(1).cast("long"))
        yield path_parts(at)["name"], read_json(spark, told), out


def read_or_create(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table at ``path``; it is made and written first if it is missing. A half-written one is made anew."""
    if not exists(spark, f"{path}/_SUCCESS"):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
