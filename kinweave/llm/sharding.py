"""Operator 9, sharding: a uniform shuffle through a hypergeometric communication matrix.

The rows are written once with the part they lie in. How many rows each part
sends to each shard is drawn exactly: row by row of the matrix, from the
multivariate hypergeometric law of what the shards still lack. Each part ranks
its rows by a keyed hash (the local permutation) and cuts the ranks at its
matrix row (the exchange); each shard then orders what it got by a second hash.
Shard sizes are exact, counts differ by one at most, and no step depends on
any value of the data, so copies and hot keys spread like other rows. Null
text counts 0 bytes and the crc of an empty text; no rows give no rows.
Built-in functions only; the driver holds one small matrix row per part.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinweave.llm.common import table
from kinweave.scratch import materialize

#: Rows that one task ranks when a shard is put in its final order.
RUN_ROWS = 200_000


def communication_matrix(counts: list[int], shards: int, seed: int) -> np.ndarray:
    """Rows by part, columns by shard; margins are the part counts and near-equal shard sizes."""
    rng, total = np.random.default_rng(seed), sum(counts)
    lack = np.array([total // shards + (j < total % shards) for j in range(shards)], dtype=np.int64)
    out = np.zeros((len(counts), shards), dtype=np.int64)
    for i, n in enumerate(counts):
        out[i] = rng.multivariate_hypergeometric(lack, n, method="marginals") if n < lack.sum() else lack
        lack -= out[i]
    return out


def shuffle_into_shards(rows: DataFrame, shards: int, seed: int = 0) -> DataFrame:
    """``shard`` and gapless ``slot`` for every row, beside its columns (same names are replaced)."""
    spark = rows.sparkSession
    own = [c for c in rows.columns if c.lower() not in ("shard", "slot")]
    # The row travels as one column: no name of its columns can clash with those used here.
    packed = rows.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("row")).withColumn("uid", F.monotonically_increasing_id())
    kept = materialize(packed, "shard-input").withColumn("part", F.shiftright("uid", 33))
    counts = {r["part"]: r["count"] for r in kept.groupBy("part").count().collect()}
    parts = sorted(counts)
    matrix = communication_matrix([counts[p] for p in parts], shards, seed)
    cuts = spark.createDataFrame(
        [(int(p), [int(x) for x in np.cumsum(row)]) for p, row in zip(parts, matrix, strict=True)], "part long, cuts array<long>"
    )
    mixed = lambda k: F.xxhash64(F.lit(seed * 2 + k), F.col("uid"))
    local = Window.partitionBy("part").orderBy(mixed(0), "uid")
    ranked = kept.withColumn("rank", F.row_number().over(local))
    # The matrix has one row per part: its size is that of the plan, not of the data.
    sent = ranked.join(F.broadcast(cuts), "part").withColumn("shard", F.expr("cast(size(filter(cuts, c -> c < rank)) as int)"))
    total = sum(counts.values())
    runs = max(1, -(-total // (shards * RUN_ROWS)))
    sent = materialize(sent.select("row", "shard", mixed(1).alias("mix"), "uid").withColumn("run", F.expr(f"cast(floor((mix / 18446744073709551616d + 0.5d) * {runs}) as int)")), "shard-sent")
    sizes = sent.groupBy("shard", "run").count()
    before = Window.partitionBy("shard").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("shard", "run", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    final = Window.partitionBy("shard", "run").orderBy("mix", "uid")
    out = sent.withColumn("at", F.row_number().over(final)).join(starts, ["shard", "run"])
    return out.select(*[F.col("row")[c].alias(c) for c in own], "shard", (F.col("start") + F.col("at") - 1).alias("slot"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    out = shuffle_into_shards(docs, 8)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
