"""Where intermediate tables live, so that every executor and every retry can read them.

A cluster names a folder that the driver and all executors share in
``spark.checkpoint.dir``; only where that is unset (tests, a laptop) is a
local folder chosen, and only if Spark runs on one machine.
"""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Without Hadoop's native library a local file system starts a ``chmod`` process from the executor for every file, and one
#: more for its checksum file. Such a process shares the executor's memory until it executes. Parquet pages have checksums
#: of their own, so tables in a local folder are written without the second file.
PLAIN_FILES = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}
_LOCAL: dict[str, str] = {}
_WRITTEN: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session; a temporary one if the session names none."""
    named = spark.conf.get("spark.checkpoint.dir", "") or ""
    sc = spark.sparkContext
    if not named and not sc.master.split("[")[0] == "local":
        raise RuntimeError("spark.checkpoint.dir is unset: a cluster must name a folder that all its machines share")
    if not named:
        named = _LOCAL.setdefault(sc.applicationId, "file://" + tempfile.mkdtemp(prefix="kinweave-"))
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(named)
    return named


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage of a slim table between the rounds of a loop.

    The table is written, not checkpointed as an RDD: that would keep the
    estimated size of its plan, and sizes that multiply in every round's joins
    stall the optimizer and hide what is small enough to broadcast.
    """
    return materialize(df, "round")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table as Parquet in the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/kinweave-{uuid.uuid4().hex}/{name}"
    df.write.options(**(PLAIN_FILES if path.startswith("file:") else {})).parquet(path)
    if not _WRITTEN:
        atexit.register(_clean)
    _WRITTEN.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


@contextmanager
def scope(spark: SparkSession):
    """Tables written inside are deleted at the end, but for those given to the yielded function.

    What leaves the block must rest on kept tables alone. Shuffle files go as well:
    Spark drops those that nothing refers to when the driver collects its garbage.
    """
    first, kept = len(_WRITTEN), set()

    def keep(df: DataFrame) -> DataFrame:
        kept.add(df.written_at)
        return df

    yield keep
    gone = [w for w in _WRITTEN[first:] if w[1] not in kept]
    _WRITTEN[first:] = [w for w in _WRITTEN[first:] if w[1] in kept]
    for session, path in gone:
        _delete(session, path)
    gc.collect()
    spark._jvm.System.gc()


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path).getParent()
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _clean() -> None:
    for spark, path in _WRITTEN:
        try:
            _delete(spark, path)
        except Exception:  # the session may be gone already
            return
