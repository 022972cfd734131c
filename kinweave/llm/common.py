"""What the text operators share."""

from __future__ import annotations

import gc
import sys
import types

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text as an array; null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")


def let(value: Column, body) -> Column:
    """Bind ``value`` once for ``body``, so that nested lambdas do not compute it anew."""
    return F.transform(F.array(value), body)[0]


#: Settings of a session that gives none of its own: rows and bytes of a batch of whole texts.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000"), "spark.sql.execution.arrow.maxBytesPerBatch": (None, str(16 << 20))}


def small_batches(df: DataFrame) -> DataFrame:
    """Have rows with whole texts handed to Python in batches of bounded rows and bytes.

    A plan is run after this returns, so the session keeps the settings; ones that it has got itself stay.
    """
    conf = df.sparkSession.conf
    for name, (plain, own) in BATCH.items():
        if conf.get(name, plain) in (plain, str((1 << 31) - 1), "2147483647b"):
            conf.set(name, own)
    return df


def ship(module: str) -> None:
    """Send a module's functions to the workers by value: executors need not have this package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


ship(__name__)


def per_process(key: str, make):
    """A value that a worker process makes once and keeps for its later tasks."""
    kept = sys.modules.setdefault("_kinweave_worker", types.ModuleType("_kinweave_worker")).__dict__
    if key not in kept:
        kept[key] = make()
    return kept[key]


def forget() -> None:
    """Let go of what ``per_process`` keeps: another operator's tasks need the memory, so it goes back to the system."""
    import ctypes

    import pyarrow as pa

    sys.modules.setdefault("_kinweave_worker", types.ModuleType("_kinweave_worker")).__dict__.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):  # only glibc has it
        pass


def batched(column, rows: int = 256):
    """The Python values of an Arrow column, a few rows at a time: long texts never pile up."""
    for at in range(0, len(column), rows):
        yield from column.slice(at, rows).to_pylist()


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of the frame is called so in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def ddl(df: DataFrame) -> str:
    """The schema of a frame as text for mapInArrow."""
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
