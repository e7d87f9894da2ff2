"""Result tables and their Spark writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellweave.operators.ranks import dense_index
from cellweave.operators.shape import label_maps
from cellweave.runtime import counted_broadcast

SEPARATOR = ":"


def joined(values: Column) -> Column:
    return F.array_join(values.cast("array<string>"), SEPARATOR)


def model_table(blocks: DataFrame) -> DataFrame:
    """One numbered line per block, mean and covariance as joined strings. The number of
    lines is the number of blocks of a model."""
    order = Window.orderBy("l", "k")
    return blocks.select(
        F.row_number().over(order).alias("id"),
        F.col("k").alias("rowCluster"),
        F.col("l").alias("colCluster"),
        F.col("row_prop").alias("rowProportion"),
        F.col("col_prop").alias("colProportion"),
        joined(F.col("mean")).alias("mean"),
        joined(F.flatten("cov")).alias("cov"),
    )


def labelled_cells(
    cells: DataFrame, row_part: DataFrame, col_part: DataFrame,
    row_names: DataFrame, col_names: DataFrame, vectors: list[str],
) -> DataFrame:
    """Cells under their original names with their clusters; the row cluster is the one of
    the row inside the column's cluster. ``vectors`` become joined strings. A cell without a
    name goes under its id, one without a label has none. Names and labels of a row are put
    together first, so cells kept by row are not moved."""
    columns = col_part.join(col_names, "col_id", "full_outer")
    rows = label_maps(row_part).join(row_names.select("row_id", "row_name"), "row_id", "full_outer")
    labelled = cells.join(counted_broadcast(columns, 128), "col_id", "left").join(rows, "row_id", "left")
    return labelled.select(
        F.coalesce("row_name", F.col("row_id").cast("string")).alias("row_name"),
        F.coalesce("col_name", F.col("col_id").cast("string")).alias("col_name"),
        F.try_element_at("z", F.col("l")).alias("row_cluster"), F.col("l").alias("col_cluster"),
        *[joined(F.col(v)).alias(v) for v in vectors],
    )


def matrix_sink(cells: DataFrame, value: str, n_rows: int, n_cols: int) -> DataFrame:
    """Numeric matrix with the header ``id`` and the column ids in their order; ``id`` numbers
    the rows from 1 in the order of their row ids. ``value`` is a numeric column. ``n_cols`` is
    the counted number of columns, which bounds what the driver reads for the header."""
    found = cells.select("col_id").distinct().limit(n_cols + 1).collect()
    if len(found) > n_cols:
        raise ValueError(f"the matrix has more than {n_cols} columns")
    columns = sorted(row.col_id for row in found)
    wide = cells.groupBy("row_id").pivot("col_id", columns).agg(F.first(value))
    numbered = dense_index(wide.select("row_id"), ["row_id"], "place", n_rows)
    return wide.join(numbered, "row_id").select(
        (F.col("place") + 1).alias("id"), *[F.col(f"`{j}`") for j in columns]
    )


def write_csv(df: DataFrame, path: str, header: bool = True, append: bool = False) -> None:
    """Write a result table as CSV files, one per partition."""
    df.write.mode("append" if append else "errorifexists").csv(path, header=header)


def score_append(scores: DataFrame, path: str) -> None:
    """Append score lines to a results table."""
    scores.write.mode("append").parquet(path)
