"""A cleaning pipeline over ``documents``, from raw texts to packed sequences.

Each stage takes (spark, docs, sf_dir) and works on all rows that its
predecessor kept; the caller may write and reread the rows in between, as
``run`` does. All stages but the last return the columns of ``documents``.
Null and empty texts pass every filter but the near-duplicate one, where all of
them are one group; repeated rows are one group there as well.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm import contamination, linededup, neardup, packing, toxicity
from kinweave.llm.common import table
from kinweave.scratch import materialize


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: documents that score 0.5 or more go."""
    return toxicity.reject(docs, toxicity.learn(spark, sf_dir, docs))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: recurring lines go; the documents stay, with ``n_chars`` of what is left."""
    out = linededup.drop_recurring_lines(docs)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("lines_dropped") > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: one document of each near-duplicate group stays, that of the smallest id."""
    return neardup.keep_one_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents that contain a benchmark item go."""
    return contamination.without_items(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: the pieces of every document with their place in a sequence."""
    out = packing.pack_pieces(packing.token_pieces(docs, ["doc_id"], packing.default_tokenizer()))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_dedup_stage),
    ("simhash_near_dedup", near_dedup_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("best_fit_packing", packing_stage),
]

#: A learned filter and a tokenizer are not SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for all documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
