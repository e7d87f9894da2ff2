"""Starting models and column partitions of the fits."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.functions.draws import uniform
from cellweave.operators.blocks import draw_cols_from_proportions, estimate, m_step
from cellweave.operators.kmeans import Items, kmeans_fit, kmeans_groups
from cellweave.operators.matrix import CellMatrix, wide_row_part
from cellweave.operators.model import BlockModel, EmptyClusterError
from cellweave.operators.packed import (
    Balanced,
    MomentPass,
    SamplePass,
    Steps,
    balanced_col_labels,
    col_labels_from,
    together,
)
from cellweave.operators.partitions import balanced_col_partition, balanced_row_partition
from cellweave.operators.pca import project_loadings
from cellweave.operators.ranks import first_of_each
from cellweave.operators.stats import block_sums, unpack_sums
from cellweave.runtime import broadcast_if_small, checkpoint

# Rows sampled per block, and the inner fits of the LBM start.
SAMPLE_ROWS = 50
LBM_START_ITERATIONS = 5
START_LOADING_STRATEGY = 4
START_TRIES = 10


def sampled_block_cells(
    matrix: CellMatrix, blocks: Sequence[tuple[int, int]], m: int, seed: int
) -> DataFrame:
    """For each block ``m`` random rows and one random column of each, ``(l, k, feat)``."""
    names = F.array(*[F.struct(F.lit(l).alias("l"), F.lit(k).alias("k")) for l, k in blocks])
    spread = matrix.rows().select("row_id", F.inline(names))
    order = uniform("b", F.col("row_id"), F.col("l"), F.col("k"), seed)
    chosen = first_of_each(spread, ["l", "k"], order, "row_id", m)
    column = F.struct(uniform("s", F.col("row_id"), F.col("col_id"), F.col("l"), F.col("k"), seed),
                      F.col("col_id"))
    return (
        matrix.cells.join(broadcast_if_small(chosen, m * len(blocks), 32), "row_id")
        .groupBy("l", "k", "row_id")
        .agg(F.min_by("feat", column).alias("feat"))
        .select("l", "k", "feat")
    )


# The steps of a start return the model and the column labels: an array in the order of the columns
# if rows are kept whole, otherwise a table.


def component_steps(matrix: CellMatrix, settings, seed: int) -> Steps:
    """Pooled loadings, each block's normal from sampled cells, uniform proportions, columns
    drawn from the proportions."""
    sizes = settings.row_clusters
    blocks = tuple((l, k) for l, size in enumerate(sizes) for k in range(size))
    w = matrix.pooled_loadings(settings.max_components, settings.threshold)
    m = min(matrix.n_rows, SAMPLE_ROWS)
    shift = matrix.pooled()[0]
    if matrix.packs is None:
        cells = sampled_block_cells(matrix, blocks, m, seed)
        found = {(r.l, r.k): unpack_sums(r.sums, matrix.dim) for r in block_sums(cells, matrix.dim, shift).collect()}
    else:
        found = yield SamplePass(matrix, blocks, m, seed)
    means, covs = {}, {}
    for block in blocks:
        n, s, q = found[block]
        if n < 2:
            raise EmptyClusterError("too few rows to sample a block from")
        centre = s / n
        means[block] = w @ (shift + centre)
        covs[block] = w @ ((q - n * np.outer(centre, centre)) / (n - 1)) @ w.T

    def table(values) -> list[list[np.ndarray]]:
        return [[values[l, k] for k in range(size)] for l, size in enumerate(sizes)]

    model = BlockModel(
        [np.full(size, 1.0 / size) for size in sizes],
        np.full(len(sizes), 1.0 / len(sizes)),
        table(means),
        table(covs),
        [[w] * size for size in sizes],
    )
    if matrix.packs is None:
        return model, draw_cols_from_proportions(matrix, model.col_props, seed)
    return model, col_labels_from(matrix, model.col_props, seed)


def as_tables(matrix: CellMatrix, steps: Steps) -> tuple[BlockModel, DataFrame]:
    """The model and column partition of a start."""
    model, columns = together([steps])[0]
    return model, matrix.col_part(columns) if isinstance(columns, np.ndarray) else columns


def from_component_sample(matrix: CellMatrix, settings, seed: int) -> tuple[BlockModel, DataFrame]:
    return as_tables(matrix, component_steps(matrix, settings, seed))


def from_given_partition(
    matrix: CellMatrix, row_labels: DataFrame, col_part: DataFrame, settings
) -> tuple[BlockModel, DataFrame]:
    """Pooled loadings shared by all blocks, then one estimation."""
    w = matrix.pooled_loadings(settings.max_components, settings.threshold)
    model, _ = m_step(
        matrix, row_labels, col_part, settings.row_clusters, settings.shared, w,
        center_divisor=settings.center_divisor,
    )
    return model, col_part


def random_partition_steps(matrix: CellMatrix, settings, seed: int) -> Steps:
    """Balanced random labels, then the given-partition start."""
    sizes = settings.row_clusters
    if matrix.packs is None:
        col_part = checkpoint(balanced_col_partition(matrix.columns(), len(sizes), seed, matrix.n_cols))
        rows = balanced_row_partition(matrix.rows(), sizes, seed, matrix.n_rows)
        return from_given_partition(matrix, wide_row_part(rows, len(sizes)), col_part, settings)
    labels = balanced_col_labels(matrix, len(sizes), seed)
    moments = yield MomentPass(matrix, Balanced(tuple(sizes), seed), labels, tuple(sizes))
    w = matrix.pooled_loadings(settings.max_components, settings.threshold)
    model = estimate(
        moments, matrix.n_rows, matrix.n_cols, settings.shared, w, center_divisor=settings.center_divisor
    )
    return model, labels


def from_random_partition(matrix: CellMatrix, settings, seed: int) -> tuple[BlockModel, DataFrame]:
    return as_tables(matrix, random_partition_steps(matrix, settings, seed))


def joined_row_labels(parts: Sequence[DataFrame]) -> DataFrame:
    """``(row_id, z)`` from one ``(row_id, k)`` table per column cluster."""
    stacked = None
    for l, part in enumerate(parts):
        labelled = part.select("row_id", F.lit(l).alias("l"), "k")
        stacked = labelled if stacked is None else stacked.unionByName(labelled)
    return wide_row_part(stacked, len(parts))


def from_kmeans(matrix: CellMatrix, settings, seed: int) -> tuple[BlockModel, DataFrame]:
    """k-means on the columns, then on the rows inside all column clusters at once, both on the
    projected features."""
    sizes = settings.row_clusters
    w = matrix.pooled_loadings(settings.max_components, settings.threshold)
    # every round of k-means reads the projected cells, so they are kept
    cells = project_loadings(matrix.cells, "feat", "feat", w).persist(StorageLevel.MEMORY_AND_DISK)

    def column_labels() -> DataFrame:
        items = Items.of_columns(matrix, len(w), cells)
        if len(sizes) == 1:
            return items.cells.select("item").distinct().withColumn("k", F.lit(0))
        found = kmeans_fit(items, len(sizes), seed=seed)
        if found.status != "ok":
            raise EmptyClusterError("k-means found no start without an empty cluster")
        return found.labels

    try:
        col_part = checkpoint(column_labels().select(F.col("item").alias("col_id"), F.col("k").alias("l")))
        inside = cells.join(matrix.beside_columns(col_part), "col_id").select(
            F.col("l").alias("group"), F.col("row_id").alias("item"), F.col("col_id").alias("attr"), "feat"
        )
        items = Items(inside, matrix.n_rows * len(sizes), matrix.n_cols, len(w), ("group", "item"))
        by_row = kmeans_groups(items, dict(enumerate(sizes)), seed)
        long = by_row.select(F.col("item").alias("row_id"), F.col("group").alias("l"), "k")
        row_labels = checkpoint(wide_row_part(long, len(sizes)))
    finally:
        cells.unpersist()
    return from_given_partition(matrix, row_labels, col_part, settings)


def from_lbm(matrix: CellMatrix, settings, seed: int) -> tuple[BlockModel, DataFrame]:
    """An LBM for the columns, then a one-cluster CLBM on each column cluster for its rows, all of
    these at once."""
    from cellweave.operators.fit import clbm_settings, fit, fit_all, lbm_settings

    sizes = settings.row_clusters
    outer = fit(matrix, lbm_settings(
        max(sizes), len(sizes), iterations=LBM_START_ITERATIONS, burn_in=LBM_START_ITERATIONS,
        update_loadings=START_LOADING_STRATEGY, max_tries=START_TRIES, seed=seed,
        max_components=settings.max_components, threshold=settings.threshold,
    ))
    if outer.status == "failed":
        raise EmptyClusterError("the LBM start failed")
    inner = fit_all([
        (matrix.slice(outer.col_part, l), clbm_settings(
            (size,), init="random", update_loadings=START_LOADING_STRATEGY, max_tries=START_TRIES,
            seed=seed, max_components=settings.max_components, threshold=settings.threshold,
        ))
        for l, size in enumerate(sizes)
    ])
    if any(found.status == "failed" for found in inner):
        raise EmptyClusterError("the start inside a column cluster failed")
    parts = [found.row_part().select("row_id", "k") for found in inner]
    return from_given_partition(
        matrix, checkpoint(joined_row_labels(parts)), outer.col_part, replace(settings, shared=False)
    )


#: By name, the steps of a start, or a start that takes jobs of its own.
CLBM_STARTS = {
    "random": component_steps,
    "random_partition": random_partition_steps,
    "kmeans": from_kmeans,
    "lbm": from_lbm,
}
LBM_STARTS = {"random": component_steps}
