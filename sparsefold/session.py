"""Session settings and the few places where code must know about the cluster."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession, functions as F

BROADCAST_ROW_LIMIT = 200_000
ROWS_PER_TASK = 10_000
# Five seeds or folds in one round.
PARALLEL_FITS = 5
STORED: list[str] = []


def build_session(cpus: int | str = "*", app: str = "sparsefold", shuffle_partitions: int = 8) -> SparkSession:
    """Local session for tests and the bench; a cluster supplies its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder under the one the session names in ``spark.checkpoint.dir``, which every executor can reach.

    Where that is unset, a local session uses its warehouse; a cluster has no folder that this could guess.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = os.path.join(spark.conf.get("spark.sql.warehouse.dir"), "stored")
    path = os.path.join(base, f"sparsefold-{uuid.uuid4().hex}")
    STORED.append(path)
    return path


def drop_stored(spark: SparkSession) -> None:
    """Delete the tables stored so far. For when no result that reads them is still to be computed."""
    jvm = spark.sparkContext._jvm
    while STORED:
        path = jvm.org.apache.hadoop.fs.Path(STORED.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def spread(scan: DataFrame, key: str) -> DataFrame:
    """Give a scan with fewer splits than cores (one small file, one row group) a task per core.

    For plain table scans only. At volume a scan has far more splits than cores and comes back untouched,
    so no shuffle is added.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores, key)


def for_matrices(df: DataFrame, rows_per_matrix: int = 1_000_000) -> DataFrame:
    """Store compact rows whose tasks will each add up a whole matrix, and read them back in few enough tasks.

    What makes the rows (text work) keeps the partitions of its scan; only the stored numbers are merged, to a task
    per ``rows_per_matrix`` rows, and to a few at least where there are fewer.
    """
    stored = settle(df, merge=False)
    return stored.coalesce(matrix_tasks(stored, rows_per_matrix))


def matrix_tasks(stored: DataFrame, rows_per_matrix: int = 1_000_000) -> int:
    return max(8, -(-stored.count() // rows_per_matrix))


def in_threads(fn: Callable, items: list, parallel: int = PARALLEL_FITS) -> list:
    """Submit Spark jobs from a few driver threads, so that small fits fill the cluster."""
    if not items:
        return []
    spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    with ThreadPool(min(parallel, len(items))) as pool:
        return pool.map(inheritable_thread_target(spark)(fn), items)


def settle(df: DataFrame, merge: bool = True, **options: str) -> DataFrame:
    """Write df to the shared folder and read it back, for frames that many jobs start from.

    Their plans become one scan, and losing an executor costs no recomputation. Iterative fits pay for every
    task in every iteration, so partitions of fewer than ROWS_PER_TASK rows are merged unless rows are large. ``options``
    are the writer's.
    """
    path = shared_dir(df.sparkSession)
    df.write.options(**options).parquet(path)
    stored = df.sparkSession.read.parquet(path)
    return stored.coalesce(1 + stored.count() // ROWS_PER_TASK) if merge else stored


def small_side(df: DataFrame, max_rows: int = BROADCAST_ROW_LIMIT) -> DataFrame:
    """Hint a broadcast only after counting; above the limit the caller's join stays a shuffle join.

    The aggregate behind ``df`` is persisted so that the count does not run it twice.
    """
    df = df.persist()
    return F.broadcast(df) if df.count() <= max_rows else df
