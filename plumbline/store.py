"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


#: The session whose tables go at the driver's end, once there are any.
_ENDING: list[SparkSession] = []
#: What the session had for bytes of a batch when first asked.
_BYTES: dict[str, str] = {}
#: Paths that were handed out and may still have a table.
_PLACED: list[str] = []


def shared(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; one of our own where that is unset, on a single machine (tests) only.

    On a cluster such a folder would be the driver's alone, so that is an error.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        at = spark.sparkContext.getCheckpointDir()
        if not at:
            if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="plumbline-"))
            at = spark.sparkContext.getCheckpointDir()
    return at.rstrip("/")


def _own(spark: SparkSession) -> str:
    return f"{shared(spark)}/plumbline/{spark.sparkContext.applicationId}"


def place(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, in this application's part of it."""
    if not _ENDING:
        _ENDING.append(spark)
        atexit.register(_end)
    _PLACED.append(f"{_own(spark)}/{name}-{uuid.uuid4().hex}")
    return _PLACED[-1]


def clear(spark: SparkSession) -> None:
    """Remove all that this application has placed; nothing may read it any more."""
    p = spark._jvm.org.apache.hadoop.fs.Path(_own(spark))
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _end() -> None:
    """At the driver's end nothing reads the application's tables; a session that has been stopped leaves them."""
    with contextlib.suppress(Exception):
        clear(_ENDING[0])


def stash(df: DataFrame, name: str, **options) -> DataFrame:
    """Write df there and read it back: the lineage ends, and lost executors cost no recomputation."""
    spark, path = df.sparkSession, place(df.sparkSession, name)
    schema = df.schema
    df.write.options(**{"compression": "zstd"} | options).parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._plumbline_path = path
    return out


def discard(df: DataFrame) -> None:
    """Remove a stashed table that nothing will read again."""
    _remove(df.sparkSession, df._plumbline_path)


def _remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    if path in _PLACED:
        _PLACED.remove(path)


def settled(spark: SparkSession, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """What make() gives, stashed; every table that was stashed on the way to it goes, so nothing else may read one."""
    before = set(_PLACED)
    out = stash(make(), name)
    for path in [p for p in _PLACED if p not in before and p != out._plumbline_path]:
        _remove(spark, path)
    return out


def plain_sizes(spark: SparkSession, times: int = 64) -> None:
    """Let the planner take Parquet tables for so many times their files' size, which few-valued columns have as rows; a setting of the user's stays.

    By file size alone a table of millions of rows passes for one to broadcast.
    Adaptive execution still broadcasts what turns out little.
    """
    key = "spark.sql.sources.fileCompressionFactor"
    if float(spark.conf.get(key)) == 1.0:
        spark.conf.set(key, str(times))


def arrow_bytes(spark: SparkSession, most: int = 4 << 20) -> None:
    """Bound what one Arrow batch holds, so that very long texts do not add up; a setting of the user's stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) == _BYTES.setdefault("default", spark.conf.get(key)):
        spark.conf.set(key, str(most))
