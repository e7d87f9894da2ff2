"""The demonstration run: 90 x 90 series in known blocks. Takes about two minutes, so it runs
when ``CELLWEAVE_SLOW`` is set."""

import os

import pytest
from pyspark.sql import functions as F

from cellweave.operators import fit, partitions
from cellweave.operators.matrix import CellMatrix
from cellweave.operators.spectral import spectral_features
from cellweave.sources.series import cells_ingest
from planted import series_cells

ROWS, COLS = [(20, 40, 30), (60, 30), (40, 50)], (45, 15, 30)


@pytest.mark.skipif(not os.environ.get("CELLWEAVE_SLOW"), reason="set CELLWEAVE_SLOW=1")
def test_planted_blocks_are_found(spark):
    cells = series_cells(spark, ROWS, COLS, points=40, noise_level=0.2).persist()
    matrix = CellMatrix.prepare(spectral_features(cells_ingest(cells)))
    settings = fit.clbm_settings((3, 2, 2), iterations=3, burn_in=3, update_loadings=3, max_tries=5)
    found = fit.multi_start(matrix, settings, 4)
    known = cells.select("row_id", "col_id", (F.col("l") * 10 + F.col("k")).alias("b"))
    blocks = partitions.block_partition(matrix.cells, found.row_part(), found.col_part)
    pairs = blocks.withColumnRenamed("block", "a").join(known, ["row_id", "col_id"])
    score = partitions.adjusted_rand_index(pairs, "a", "b").first().ari
    assert score == 1.0
    assert matrix.dim < 20
