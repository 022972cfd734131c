"""Ranks over whole tables without one task that sorts them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinweave.scratch import checkpoint


def rank_descending(rows: DataFrame, value: str, bucket: str, key: str, name: str = "rank") -> DataFrame:
    """1-based position by ``value`` descending, then ``bucket``, then ``key`` ascending.

    Rows before a row are counted from two small tables, the distinct values
    and the distinct (value, bucket) pairs; only rows of one pair are sorted
    together.
    """
    pairs = rows.groupBy(value, bucket).agg(F.count("*").alias("_n"))
    values = pairs.groupBy(value).agg(F.sum("_n").alias("_v"))
    over = Window.orderBy(F.col(value).desc()).rowsBetween(Window.unboundedPreceding, -1)
    values = values.select(value, F.coalesce(F.sum("_v").over(over), F.lit(0)).alias("_above"))
    within = Window.partitionBy(value).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    pairs = pairs.select(value, bucket, F.coalesce(F.sum("_n").over(within), F.lit(0)).alias("_beside")).join(values, value)
    place = F.row_number().over(Window.partitionBy(value, bucket).orderBy(key))
    return rows.withColumn("_rn", place).join(pairs, [value, bucket]).withColumn(name, F.col("_above") + F.col("_beside") + F.col("_rn")).drop("_above", "_beside", "_rn")


def dense_ids(values: DataFrame, column: str, name: str) -> DataFrame:
    """0-based dense ids of distinct values in their order: ranges are ranked by themselves and begin where others end."""
    ranges = values.select(column).distinct().repartitionByRange(F.col(column)).withColumn("_p", F.spark_partition_id())
    ranges = checkpoint(ranges)
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    starts = ranges.groupBy("_p").agg(F.count("*").alias("_n")).select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy("_p").orderBy(column))
    return ranges.withColumn("_rn", place).join(F.broadcast(starts), "_p").select(column, (F.col("_start") + F.col("_rn") - 1).cast("long").alias(name))


def rank_within(rows: DataFrame, group: list[str], order: str, key: str, name: str = "rank", buckets: int = 64) -> DataFrame:
    """1-based position in the group by ``order``, a number in [0, 1), then ``key``.

    A group is cut into equal ranges of ``order``, so that a large one is
    ranked by many tasks; earlier ranges are counted.
    """
    rows = rows.withColumn("_b", F.floor(F.col(order) * buckets).cast("int"))
    counts = rows.groupBy(*group, "_b").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(*group, "_b", F.coalesce(before, F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy(*group, "_b").orderBy(order, key))
    return rows.withColumn("_rn", place).join(starts, [*group, "_b"]).withColumn(name, F.col("_start") + F.col("_rn")).drop("_b", "_rn", "_start")
