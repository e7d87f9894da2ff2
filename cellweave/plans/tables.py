"""The given tables read as matrices of series or vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.operators.shape import apply_dictionary, id_dictionary
from cellweave.runtime import checkpoint
from cellweave.sources.series import bucket_range, cells_ingest, fill_missing_cells, series_build

SLICE_WIDTH = 8


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def dictionary(df: DataFrame, name: str, out: str) -> tuple[DataFrame, int]:
    """Stored once, as every pass over the coded table reads it again."""
    names = checkpoint(df.select(name).distinct())
    n_names = names.count()
    return checkpoint(id_dictionary(names, name, out, n_names)), n_names


def events_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users x event types; a series is the daily sum of ``value`` from the first day of the table
    to the last."""
    events = read(spark, sf_dir, "events")
    day = F.unix_date(F.to_date("ts"))
    # The names, and the days and the number of the records of each, from one reading.
    seen = checkpoint(events.groupBy("event_type").agg(
        F.min(day).alias("first"), F.max(day).alias("last"), F.count(F.lit(1)).alias("n")))
    names, n_names = dictionary(seen, "event_type", "type_id")
    ends = seen.select("n", F.posexplode(F.array("first", "last")).alias("end", "day"))
    first, days, n_records = bucket_range(ends, F.col("day"), F.sum(F.when(F.col("end") == 0, F.col("n"))))
    coded = apply_dictionary(events, names, "event_type", n_names)
    built = series_build(coded, "user_id", "type_id", day - first + 1, "value", days, n_records)
    return fill_missing_cells(built, n_names, days)


def supplier_brand_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers x brands; a series is the quarterly sum of the quantity from the first quarter
    of the table to the last."""
    lineitem = read(spark, sf_dir, "lineitem").select(
        "l_partkey", "l_suppkey", "l_quantity", "l_shipdate"
    )
    part = read(spark, sf_dir, "part").select("p_partkey", "p_brand")
    names, n_names = dictionary(part, "p_brand", "brand_id")
    coded = apply_dictionary(part, names, "p_brand", n_names).select("p_partkey", "brand_id")
    joined = lineitem.join(coded, F.col("l_partkey") == F.col("p_partkey"))
    quarter = F.year("l_shipdate") * 4 + F.quarter("l_shipdate")
    first, quarters, n_records = bucket_range(lineitem, quarter)
    built = series_build(joined, "l_suppkey", "brand_id", quarter - first + 1, "l_quantity", quarters, n_records)
    return fill_missing_cells(built, n_names, quarters)


def events_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells_ingest(events_raw(spark, sf_dir))


def embedding_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors x slices of eight entries of their embedding, however long it is. A length that eight
    does not divide is an error."""
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    refused = F.raise_error(F.lit(f"an embedding is not made of slices of {SLICE_WIDTH} entries")).cast("int")
    whole = (F.size("embedding") > 0) & (F.size("embedding") % SLICE_WIDTH == 0)
    n_slices = F.when(F.coalesce(whole, F.lit(False)), (F.size("embedding") / SLICE_WIDTH).cast("int")).otherwise(refused)
    slices = F.transform(
        F.sequence(F.lit(0), n_slices - 1),
        lambda s: F.transform(
            F.slice("embedding", s * SLICE_WIDTH + 1, F.lit(SLICE_WIDTH)), lambda x: x.cast("double")
        ),
    )
    return vectors.select(
        F.col("vec_id").alias("row_id"), F.posexplode(slices).alias("col_id", "feat")
    ).withColumn("col_id", F.col("col_id").cast("bigint"))


def measure_pairs(spark: SparkSession, sf_dir: str, measures: dict[str, float]) -> DataFrame:
    """Two features per cell of suppliers x (return flag, measure of a line): mean and sample sd over
    the lines. Columns of one measure are alike."""
    lines = read(spark, sf_dir, "lineitem").select("l_suppkey", "l_returnflag", *measures)
    names, n_names = dictionary(lines, "l_returnflag", "flag")
    coded = apply_dictionary(lines, names, "l_returnflag", n_names)
    values = [F.struct(F.lit(i).alias("m"), (F.col(c) * factor).alias("v")) for i, (c, factor) in enumerate(measures.items())]
    spread = coded.select(F.col("l_suppkey").alias("row_id"), "flag", F.inline(F.array(*values)))
    column = (F.col("flag") * len(measures) + F.col("m")).cast("bigint")
    return spread.groupBy("row_id", column.alias("col_id")).agg(F.array(F.avg("v"), F.stddev_samp("v")).alias("feat"))


def events_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two features per cell of the event matrix: mean and sample sd of the series."""
    raw = events_raw(spark, sf_dir)
    mean = F.aggregate("x", F.lit(0.0), lambda a, v: a + v) / F.size("x")
    with_mean = raw.withColumn("m", mean)
    squares = F.aggregate("x", F.lit(0.0), lambda a, v: a + (v - F.col("m")) * (v - F.col("m")))
    return with_mean.select(
        "row_id", "col_id", F.array("m", F.sqrt(squares / (F.size("x") - 1))).alias("feat")
    )
