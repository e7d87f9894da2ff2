"""From events to labelled cells in one go."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.operators import blocks, starts
from cellweave.operators.fit import clbm_settings
from cellweave.operators.matrix import CellMatrix, long_row_part
from cellweave.operators.packed import RowDraw, drawn_columns, drawn_rows
from cellweave.operators.spectral import spectral_features
from cellweave.plans import tables
from cellweave.sources.sinks import labelled_cells


def users_alike(spark: SparkSession, sf_dir: str, row_clusters=(2, 2), seed: int = 0) -> DataFrame:
    """Daily series per user and event type, spectral features, a random partition, one
    estimation and one stochastic step, and the cells under their names."""
    matrix = CellMatrix.prepare(spectral_features(tables.events_series(spark, sf_dir)))
    settings = clbm_settings(row_clusters)
    model, col_part = starts.from_random_partition(matrix, settings, seed)
    labels = matrix.col_labels(col_part)
    for sweep in range(1, blocks.SWEEPS + 1):
        draw = RowDraw(model, labels, False, 1, sweep, seed)
        labels = drawn_columns(matrix, draw)
    rows = long_row_part(drawn_rows(matrix, draw))
    names, _ = tables.dictionary(tables.read(spark, sf_dir, "events"), "event_type", "col_id")
    row_names = matrix.rows().withColumn("row_name", F.col("row_id").cast("string"))
    return labelled_cells(
        matrix.cells, rows, matrix.col_part(labels), row_names,
        names.withColumnRenamed("event_type", "col_name"), ["feat"],
    )
