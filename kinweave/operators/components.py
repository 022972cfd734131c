"""Weak connected components: alternating large-star and small-star rounds, or one task where links are few."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.scratch import checkpoint, scope

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have this package


def _union_find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import numpy as np
    import pyarrow as pa

    up: dict = {}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for b in batches:
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            up.setdefault(x, x)
            up.setdefault(y, y)
            p, q = find(x), find(y)
            if p != q:
                up[max(p, q)] = min(p, q)
    nodes = list(up)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(np.array([find(x) for x in nodes], dtype=np.int64))], ["node", "component"])


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60, one_task_rows: int = 0) -> DataFrame:
    """Component label of every endpoint: the smallest node that it reaches.

    Edges are undirected; self-loops are ignored and null endpoints dropped.
    Nodes without another endpoint do not appear. Returns ``node, component``.
    Each round is two grouped minima joined back to the edges, so a hot node
    is summed before the shuffle and its join partition can be split. Up to
    ``one_task_rows`` links between whole numbers, counted first, are joined in one
    Arrow task instead; by default built-in functions do all.
    """
    a, b = F.col(src), F.col(dst)
    with scope(edges.sparkSession) as keep:
        e = checkpoint(
            edges.where(a.isNotNull() & b.isNotNull() & (a != b))
            .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
            .distinct()
        )
        seen = None
        for r in range(max_rounds):
            print_of = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
            if not r and print_of[0] <= one_task_rows and e.schema["u"].dataType.simpleString() == "bigint":
                return keep(checkpoint(e.coalesce(1).mapInArrow(_union_find, "node long, component long")))
            if print_of == seen or print_of[0] == 0:
                break
            seen = print_of
            both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
            low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
            large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
            low = large.groupBy("u").agg(F.min("v").alias("m"))
            hung = large.join(low, "u").select("u", "v", "m")
            small = hung.select("u", F.col("m").alias("v")).unionAll(
                hung.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            )
            e = checkpoint(small.distinct())
        else:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
        e = keep(e)
    return (
        e.select(F.col("u").alias("node"), F.col("v").alias("component"))
        .unionAll(e.select(F.col("v").alias("node"), F.col("v").alias("component")))
        .distinct()
    )
