"""Session helpers: a local session for tests and the shared scratch folder."""

from __future__ import annotations

import functools
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

SMALL_ROWS = 100_000
SMALL_BYTES = 32_000_000
FEW_ROWS = 1_000


def local_session(cpus: int | str = 8, app: str = "affectlake") -> SparkSession:
    """A single-JVM session for tests and the bench; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("AFFECTLAKE_DRIVER_MEMORY", "12g"))
        .config("spark.sql.shuffle.partitions", str(cpus) if str(cpus).isdigit() else "8")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


@functools.cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="affectlake-")


def shared_folder(spark: SparkSession) -> str:
    """A fresh path under the folder all executors share.

    The cluster names it in ``spark.checkpoint.dir``, which must be a place that every
    executor sees (a ``file:`` path only if it is a shared mount); only a local session
    without that setting (tests, laptops) gets a folder of its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = _own_folder()
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def bounded(df: DataFrame, max_rows: int = SMALL_ROWS) -> tuple[DataFrame, bool]:
    """Materialise ``df`` as a local relation if it really is small.

    Returns ``(frame, True)`` when it has at most ``max_rows`` rows of together at
    most SMALL_BYTES: the frame is then computed once and safe to broadcast.  A larger
    frame comes back untouched with ``False``, and the caller must use a shuffle join.
    """
    rows = df.limit(max_rows + 1).toArrow()
    if rows.num_rows > max_rows or rows.nbytes > SMALL_BYTES:
        return df, False
    return df.sparkSession.createDataFrame(rows, df.schema), True


def saved(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    For costly rows that several passes need: later passes read only the columns
    they use, and a lost executor costs a re-read, not a recomputation.
    """
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Spread a table over all cores if its scan cannot fill them.

    Costly per-row work (cleaning, Arrow functions) on a table below one split
    per core would run in few tasks, so its rows are hashed by ``key`` first.  So are those
    of a table whose rows lie in few of its splits: a block of a file is read by one task,
    however many splits it touches; FEW_ROWS are no long task.  Other tables come back as they are.  ``df`` is a scan
    with narrow steps; the rows of its splits are counted without reading a column.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    splits = df.select("*").rdd.getNumPartitions()
    if splits < cores:
        return df.repartition(cores, key)
    held = df.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).agg(F.max("n"), F.sum("n")).first()
    uneven = held[0] is not None and held[0] > FEW_ROWS and held[0] * cores > 2 * held[1]
    return df.repartition(splits, key) if uneven else df
