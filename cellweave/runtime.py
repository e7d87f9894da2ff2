"""Settings every operator shares: partition sizes, broadcast limits, checkpoints, job threads."""

from __future__ import annotations

import math
import tempfile
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PARTITION_BYTES = 128 << 20
BROADCAST_BYTES = 64 << 20

T = TypeVar("T")


def partitions_for(spark: SparkSession, n_bytes: float) -> int:
    """Number of partitions of about ``PARTITION_BYTES`` each, at least one per core."""
    return max(spark.sparkContext.defaultParallelism, math.ceil(n_bytes / PARTITION_BYTES))


def broadcast_if_small(df: DataFrame, n_rows: int, row_bytes: int) -> DataFrame:
    """Mark ``df`` for broadcast when its counted size allows it; otherwise leave the
    choice to the optimizer, which shuffles both sides."""
    return F.broadcast(df) if n_rows * row_bytes <= BROADCAST_BYTES else df


def counted_broadcast(df: DataFrame, row_bytes: int = 64) -> DataFrame:
    """Count a table of labels or names, then broadcast it when that is small enough. A few
    labels mean hot join keys, which a broadcast leaves where they are; a table too large to
    broadcast has so many keys that none of them is hot."""
    return broadcast_if_small(df, df.count(), row_bytes)


def one_record(*frames: DataFrame) -> DataFrame:
    """Tables of one record each, side by side in one record."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return stacked.agg(*[F.max(name).alias(name) for name in stacked.columns])


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder named by ``spark.checkpoint.dir``. Only a local session without that
    setting gets a temporary folder; on a cluster the setting is required."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="cellweave-checkpoint-")
    context.setCheckpointDir(folder)


def checkpoint(df: DataFrame) -> DataFrame:
    """Store ``df`` in the shared checkpoint folder and cut its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def run_together(tasks: Sequence[Callable[[], T]], width: int = 4) -> list[T]:
    """Run independent driver loops at the same time so that their Spark jobs overlap.
    Results keep the order of ``tasks``."""
    if len(tasks) <= 1 or width <= 1:
        return [task() for task in tasks]
    inherit = inheritable_thread_target(SparkSession.getActiveSession())
    with ThreadPoolExecutor(max_workers=width) as pool:
        futures = [pool.submit(inherit(task)) for task in tasks]
        return [future.result() for future in futures]
