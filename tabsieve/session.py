"""Session helpers: reliable materialisation, size-checked broadcast and joins that survive hot keys."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Sequence
from contextlib import contextmanager
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest side, in estimated bytes, that is ever broadcast.
BROADCAST_BYTES = 64 << 20
#: Below this many rows no key can be hot enough to need its own path.
SPREAD_FROM = 1_000_000
#: Rows that one task of an iterative fit takes at least, where there are as many.
TASK_ROWS = 20_000


def _ensure_checkpoint_dir(spark: SparkSession) -> None:
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None and not sc.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    # Only a local session that names no folder (tests) gets one of its own.
    sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="tabsieve-ckpt-"))


def shared_folder(spark: SparkSession) -> str:
    """A new folder next to the checkpoints, readable by every executor."""
    _ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/tabsieve-{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` once to a table in the shared folder and continue from there.

    The lineage ends at files every executor can read, so lost executors cost
    nothing but their own tasks. Unlike ``checkpoint`` the plan runs only once.
    """
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession):
    """A block whose intermediate tables are deleted at its end; save the results inside."""
    try:
        yield spark
    finally:
        release(spark)


def release(spark: SparkSession) -> None:
    """Delete the tables written by ``materialise``; results built on them must be saved by then."""
    jvm, root = spark.sparkContext._jvm, spark.sparkContext.getCheckpointDir()
    if root is None:
        return
    fs = jvm.org.apache.hadoop.fs.Path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for found in fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{root}/tabsieve-*")) or []:
        fs.delete(found.getPath(), True)


def spread_join(rows: DataFrame, table: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """``spread_lookup`` with the key counts taken from ``rows`` when it is large enough to matter."""
    n = rows.count()
    if n < SPREAD_FROM:
        return rows.join(table, on, how)
    return spread_lookup(rows, table, on, rows.groupBy(*on).agg(F.count(F.lit(1)).alias("_rows")), n, how)


def null_safe_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join in which null keys are equal; key columns come from ``left`` (``inner``, ``left``, ``left_semi``, ``left_anti``)."""
    marked = right.select(*[F.col(c).alias(f"_key_{c}") if c in on else F.col(c) for c in right.columns])
    same = [F.col(c).eqNullSafe(F.col(f"_key_{c}")) for c in on]
    return left.join(marked, reduce(and_, same, F.lit(True)), how).drop(*[f"_key_{c}" for c in on])


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def in_few_tasks(df: DataFrame, n_rows: int) -> DataFrame:
    """``df`` of ``n_rows`` rows in fewer partitions where it is small, for fits that run a job over it many times."""
    wanted = max(1, math.ceil(n_rows / TASK_ROWS))
    return df.coalesce(wanted) if wanted < partitions(df.sparkSession) else df


def broadcast_if(df: DataFrame, estimated_bytes: float) -> DataFrame:
    """Broadcast hint only under a checked size; otherwise a shuffled join."""
    return F.broadcast(df) if estimated_bytes <= BROADCAST_BYTES else df


def spread_lookup(rows: DataFrame, table: DataFrame, on: list[str], counts: DataFrame,
                  n_rows: int, how: str = "inner") -> DataFrame:
    """Join of ``rows`` to ``table`` (one row per key) that survives hot keys.

    ``counts`` holds ``on`` plus ``_rows``, the number of rows per key. Keys with
    over a thousandth of all rows number fewer than 1000, so their part of
    ``table`` can be broadcast; everything else takes the shuffled join.
    """
    if n_rows < SPREAD_FROM:
        return rows.join(table, on, how)
    # Null keys match nothing, so they stay in the part that ``how`` decides.
    hot = counts.where(F.col("_rows") > n_rows / 1000.0).select(*on)
    hot_table = table.join(F.broadcast(hot), on, "left_semi")
    return (rows.join(F.broadcast(hot), on, "left_semi").join(F.broadcast(hot_table), on, how)
            .unionByName(rows.join(F.broadcast(hot), on, "left_anti").join(table, on, how)))
