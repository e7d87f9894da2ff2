"""Series tables: from events, from ready-made arrays, and back to cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.runtime import partitions_for

# Up to this many buckets the sums of a cell are columns of one aggregation.
WIDE_BUCKETS = 64
RECORD_BYTES = 64


def bucket_range(df: DataFrame, bucket: Column, records: Column | None = None) -> tuple[int, int, int]:
    """Lowest bucket of the table, the number of buckets up to the highest, and the number of records:
    lines of the table unless ``records`` says otherwise."""
    low, high, n = df.agg(F.min(bucket), F.max(bucket), F.count(F.lit(1)) if records is None else records).first()
    if low is None:
        raise ValueError("no record has a time")
    return int(low), int(high - low) + 1, int(n)


def series_build(
    df: DataFrame, row: str, col: str, bucket: Column, value: str, n_buckets: int, n_records: int | None = None
) -> DataFrame:
    """Sum ``value`` per (row, column, bucket 1..n) and collect one array pair per cell,
    ``(row_id, col_id, t, x)``; buckets without a record count as zero.

    No record is passed over: one without row, column or bucket, or with a bucket outside
    1..n, is an error. Up to ``WIDE_BUCKETS`` buckets are added up in one aggregation by cell;
    more are summed before they are grouped, so a cell holds at most ``n_buckets`` entries
    when it is collected.

    Records are dealt out by row before they are added up, in partitions whose number follows
    ``n_records`` if that is counted. A task then holds the sums of its own cells, one by one, and
    not those of nearly every cell its records belong to, which would grow with the table."""
    known = F.col("row_id").isNotNull() & F.col("col_id").isNotNull()
    inside = known & F.coalesce(F.col("bucket").between(1, n_buckets), F.lit(False))
    outside = F.raise_error(F.lit(f"a record has no row, no column or no bucket in 1..{n_buckets}"))
    records = df.select(
        F.col(row).alias("row_id"), F.col(col).alias("col_id"),
        bucket.cast("int").alias("bucket"), F.col(value).cast("double").alias("v"),
    ).withColumn("bucket", F.when(inside, F.col("bucket")).otherwise(outside.cast("int")))
    parts = [] if n_records is None else [partitions_for(df.sparkSession, n_records * RECORD_BYTES)]
    records = records.repartition(*parts, "row_id")
    buckets, zero = F.sequence(F.lit(1), F.lit(n_buckets)), F.lit(0.0)
    times = F.transform(buckets, lambda b: b.cast("double")).alias("t")
    if n_buckets <= WIDE_BUCKETS:
        sums = [
            F.coalesce(F.sum(F.when(F.col("bucket") == b, F.col("v"))), zero)
            for b in range(1, n_buckets + 1)
        ]
        return records.groupBy("row_id", "col_id").agg(times, F.array(*sums).alias("x"))
    summed = records.groupBy("row_id", "col_id", "bucket").agg(F.sum("v").alias("v"))
    entries = F.map_from_entries(F.collect_list(F.struct("bucket", "v")))
    found = summed.groupBy("row_id", "col_id").agg(entries.alias("entries"))
    series = F.transform(buckets, lambda b: F.coalesce(F.try_element_at("entries", b), zero))
    return found.select("row_id", "col_id", times, series.alias("x"))


def fill_missing_cells(cells: DataFrame, n_cols: int, n_buckets: int) -> DataFrame:
    """Add an all-zero series for every (row, column 0..n_cols-1) that has no record. The series of a
    row are put together once and read out again column by column, so the table is read once
    and nothing is joined."""
    buckets = F.sequence(F.lit(1), F.lit(n_buckets))
    times = F.transform(buckets, lambda b: b.cast("double"))
    zeros = F.array_repeat(F.lit(0.0), n_buckets)
    columns = F.sequence(F.lit(0).cast("bigint"), F.lit(n_cols - 1).cast("bigint"))
    known = F.map_from_entries(F.collect_list(F.struct(F.col("col_id").cast("bigint"), F.col("x"))))
    by_row = cells.groupBy("row_id").agg(known.alias("known"))
    return by_row.select("row_id", "known", F.explode(columns).alias("col_id")).select(
        "row_id", "col_id", times.alias("t"), F.coalesce(F.try_element_at("known", F.col("col_id")), zeros).alias("x")
    )


def cells_ingest(raw: DataFrame) -> DataFrame:
    """``(row_id, col_id, t, x)`` to the series table
    ``(decorators, time_from, time_to, time_step, series)``."""
    first = F.element_at("t", 1)
    return raw.select(
        F.create_map(
            F.lit("row_id"), F.col("row_id").cast("string"),
            F.lit("col_id"), F.col("col_id").cast("string"),
        ).alias("decorators"),
        first.alias("time_from"),
        F.element_at("t", -1).alias("time_to"),
        (F.element_at("t", 2) - first).alias("time_step"),
        F.col("x").alias("series"),
    )


def decorator_lookup(table: DataFrame, key: str, out: str) -> DataFrame:
    """One decorator as a string column; null where the key is absent."""
    return table.withColumn(out, F.try_element_at("decorators", F.lit(key)))
