"""Positions in a total order of a whole table, without a one-partition window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellweave.runtime import broadcast_if_small, checkpoint, partitions_for

ROW_BYTES = 64
ROWS_PER_BAND = 1 << 17


def dense_index(df: DataFrame, columns: Sequence[str], out: str, n_rows: int) -> DataFrame:
    """Number the rows of a table of *distinct* ``columns`` 0..n-1 in their order.

    The table is split by ranges; each range is numbered on its own and shifted by the
    sizes of the ranges before it. The split is stored first because its bounds come from
    a sample, and both uses must see the same bounds."""
    spark = df.sparkSession
    parts = partitions_for(spark, n_rows * ROW_BYTES)
    split = checkpoint(
        df.repartitionByRange(parts, *columns).withColumn("range_no", F.spark_partition_id())
    )
    before = Window.orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    sizes = split.groupBy("range_no").agg(F.count(F.lit(1)).alias("size"))
    starts = sizes.select(
        "range_no", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start")
    )
    inside = Window.partitionBy("range_no").orderBy(*columns)
    return (
        split.withColumn("in_range", F.row_number().over(inside))
        .join(broadcast_if_small(starts, parts, ROW_BYTES), "range_no")
        .withColumn(out, (F.col("in_range") + F.col("start") - 1).cast("bigint"))
        .drop("range_no", "in_range", "start")
    )


def first_of_each(
    df: DataFrame, groups: Sequence[str], u: Column, tie: str, m: int, own_m: str | None = None
) -> DataFrame:
    """The ``m`` rows of each group that come first in the order of a hash uniform, ties by id,
    from one pass: every task keeps ``m`` rows of a group before they are shuffled. A column
    ``own_m`` may give a group fewer."""
    order = Window.partitionBy(*groups).orderBy("_u", tie)
    ranked = df.withColumn("_u", u).withColumn("_place", F.row_number().over(order))
    kept = ranked.where(F.col("_place") <= m)
    kept = kept if own_m is None else kept.where(F.col("_place") <= F.col(own_m))
    return kept.drop("_u", "_place")


def uniform_rank(
    df: DataFrame, groups: Sequence[str], u: Column, tie: str, out: str, n_rows: int
) -> DataFrame:
    """Number the rows of each group 0..n-1 in the order of a hash uniform ``u``, ties by
    id. ``n_rows`` is the size of a group. The uniform cuts every group into bands of equal
    expected size, so a band is ranked by one task and a group is not. Where a band begins is
    joined by its key: one record per 131,072 rows and group, left to the optimizer to move."""
    bands = max(1, -(-n_rows // ROWS_PER_BAND))
    drawn = df.withColumn("u", u).withColumn("band", F.floor(F.col("u") * bands).cast("int"))
    if bands == 1:
        inside = Window.partitionBy(*groups, "band").orderBy("u", tie)
        ranked = drawn.withColumn(out, (F.row_number().over(inside) - 1).cast("bigint"))
        return ranked.drop("u", "band")
    before = (
        Window.partitionBy(*groups).orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    )
    starts = (
        drawn.groupBy(*groups, "band")
        .agg(F.count(F.lit(1)).alias("size"))
        .select(*groups, "band", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start"))
    )
    inside = Window.partitionBy(*groups, "band").orderBy("u", tie)
    return (
        drawn.withColumn("in_band", F.row_number().over(inside))
        .join(starts, [*groups, "band"])
        .withColumn(out, (F.col("in_band") + F.col("start") - 1).cast("bigint"))
        .drop("u", "band", "in_band", "start")
    )
