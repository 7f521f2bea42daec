"""Reading tables, and cutting lineage through the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Only a local session without one gets a folder of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = f"file://{tempfile.mkdtemp(prefix='credsieve-')}"
    spark.conf.set("spark.checkpoint.dir", own)
    return own


_made: list[list[str]] = []


def stash(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df written to the shared folder and read again, so that a lost executor costs no recomputation; and its path."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    for made in _made:
        made.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def forget(spark: SparkSession, *paths: str) -> None:
    """Deletes tables of stash() that no later plan reads."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def buckets(spark: SparkSession, least: int = 8) -> int:
    """Buckets to deal rows into by a hash: as many as the session has shuffle partitions, which users set by the size of the data."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end all that stash() wrote within. What operators return reads such tables, so it must have been written
    or collected by then."""
    made: list[str] = []
    _made.append(made)
    try:
        yield
    finally:
        _made[:] = [m for m in _made if m is not made]
        forget(spark, *made)


def without(columns: list[str], *replaced: str) -> list[str]:
    """The columns but those of these names, in any case of their letters, as Spark reads names."""
    gone = {c.lower() for c in replaced}
    return [c for c in columns if c.lower() not in gone]


def place(columns: list[str], name: str) -> int:
    """Where a column stands."""
    return [c.lower() for c in columns].index(name.lower())


def fresh(columns: list[str], *wanted: str) -> list[str]:
    """Names for helper columns that none of the columns has."""
    taken, mark = {c.lower() for c in columns}, "_"
    while any(f"{mark}{w}" in taken for w in wanted):
        mark += "_"
    return [f"{mark}{w}" for w in wanted]


#: Bytes of an Arrow batch between the JVM and Python; one row may be larger.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches by bytes, for texts whose lengths differ a lot; a session with a lower bound keeps it."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark.conf.get(key).rstrip("bB")) <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def give_back() -> None:
    """Returns memory that a Python worker no longer uses; workers live on between stages."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
