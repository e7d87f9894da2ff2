"""Steps of the block models: scores, draws, estimation and likelihood.

``shared`` tells the two models apart. The latent block model has one row partition for all
column clusters (``shared=True``), the conditional one has a row partition inside each
column cluster (``shared=False``). Row labels travel as one array ``z`` per row, with one
entry for a shared partition and one per column cluster otherwise."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.functions.draws import pick_category, pick_from_log_scores, uniform
from cellweave.functions.kernels import (
    all_block_scores,
    column_block_scores,
    own_block_score,
    row_block_scores,
)
from cellweave.operators.matrix import CellMatrix
from cellweave.operators.model import BlockModel, EmptyClusterError, log_likelihood
from cellweave.operators.pca import principal_axes
from cellweave.operators.stats import block_sums, unpack_sums
from cellweave.runtime import checkpoint, one_record


def log_or_lowest(prob: float) -> float:
    return float(np.log(prob)) if prob > 0 else -np.inf


def cell_log_densities(matrix: CellMatrix, model: BlockModel) -> DataFrame:
    """Log density of every cell under every block, ``(row_id, col_id, l, k, ll)``."""
    blocks = F.array(*[
        F.struct(F.lit(l).alias("l"), F.lit(k).alias("k"))
        for l, size in enumerate(model.row_clusters) for k in range(size)
    ])
    scored = matrix.cells.select(
        "row_id", "col_id", all_block_scores(model.scorers())(F.col("feat")).alias("scores")
    )
    paired = F.arrays_zip(blocks.alias("block"), F.col("scores").alias("ll"))
    return scored.select("row_id", "col_id", F.explode(paired).alias("e")).select(
        "row_id", "col_id", F.col("e")["block"]["l"].alias("l"),
        F.col("e")["block"]["k"].alias("k"), F.col("e")["ll"].alias("ll"),
    )


# -- row side ---------------------------------------------------------------------------


def row_score_names(model: BlockModel, shared: bool) -> list[list[str]]:
    sizes = model.row_clusters[:1] if shared else model.row_clusters
    return [[f"s{l}_{k}" for k in range(size)] for l, size in enumerate(sizes)]


def wide_row_scores(
    matrix: CellMatrix, col_part: DataFrame, model: BlockModel, shared: bool
) -> DataFrame:
    """``(row_id, s{l}_{k}...)``: each row's log proportion plus the log densities of its
    cells. A cell is scored for the row clusters of its own column cluster only, and every
    task adds up its rows before they are shuffled."""
    met = matrix.cells.join(matrix.beside_columns(col_part), "col_id")
    scores = row_block_scores(model.scorers())(F.col("feat"), F.col("l"))
    scored = met.select("row_id", "l", scores.alias("ll"))
    sums = []
    for l, names in enumerate(row_score_names(model, shared)):
        for k, name in enumerate(names):
            value = F.get("ll", F.lit(k))
            if not shared:
                value = F.when(F.col("l") == l, value)
            prior = F.lit(log_or_lowest(model.row_props[l][k]))
            sums.append((F.coalesce(F.sum(value), F.lit(0.0)) + prior).alias(name))
    return scored.groupBy("row_id").agg(*sums)


def row_scores(
    matrix: CellMatrix, col_part: DataFrame, model: BlockModel, shared: bool
) -> DataFrame:
    """``(row_id, l, k, score)``; with shared rows l is 0."""
    wide = wide_row_scores(matrix, col_part, model, shared)
    entries = [
        F.struct(F.lit(l).alias("l"), F.lit(k).alias("k"), F.col(name).alias("score"))
        for l, names in enumerate(row_score_names(model, shared)) for k, name in enumerate(names)
    ]
    return wide.select("row_id", F.inline(F.array(*entries)))


def draw_rows(
    matrix: CellMatrix, col_part: DataFrame, model: BlockModel, shared: bool,
    iteration: int, sweep: int, seed: int, tags: Sequence[int] | None = None,
) -> DataFrame:
    """One label per row, or per row and column cluster: ``(row_id, z)``. ``tags`` number the column
    clusters in the key of the draw, by default by their places."""
    wide = wide_row_scores(matrix, col_part, model, shared)
    labels = [
        pick_from_log_scores(
            [F.col(name) for name in names],
            uniform("d", F.col("row_id"), l if tags is None else tags[l], iteration, sweep, seed),
        )
        for l, names in enumerate(row_score_names(model, shared))
    ]
    return wide.select("row_id", F.array(*labels).alias("z"))


# -- column side ------------------------------------------------------------------------


def wide_col_scores(matrix: CellMatrix, row_labels: DataFrame, model: BlockModel) -> DataFrame:
    """``(col_id, s0, s1, ...)``: each column's log proportion plus the log densities of its
    cells given the row labels. At most columns x L sums leave a task."""
    met = matrix.cells.join(matrix.beside_rows(row_labels), "row_id")
    scores = column_block_scores(model.scorers())(F.col("feat"), F.col("z"))
    scored = met.select("col_id", scores.alias("ll"))
    sums = [
        (F.sum(F.get("ll", F.lit(l))) + F.lit(log_or_lowest(model.col_props[l]))).alias(f"s{l}")
        for l in range(model.n_cols)
    ]
    return scored.groupBy("col_id").agg(*sums)


def col_scores(matrix: CellMatrix, row_labels: DataFrame, model: BlockModel) -> DataFrame:
    """``(col_id, l, score)``."""
    entries = [
        F.struct(F.lit(l).alias("l"), F.col(f"s{l}").alias("score")) for l in range(model.n_cols)
    ]
    wide = wide_col_scores(matrix, row_labels, model)
    return wide.select("col_id", F.inline(F.array(*entries)))


def draw_cols(
    matrix: CellMatrix, row_labels: DataFrame, model: BlockModel,
    iteration: int, sweep: int, seed: int,
) -> DataFrame:
    """``(col_id, l)``."""
    wide = wide_col_scores(matrix, row_labels, model)
    scores = [F.col(f"s{l}") for l in range(model.n_cols)]
    u = uniform("e", F.col("col_id"), iteration, sweep, seed)
    return wide.select("col_id", pick_from_log_scores(scores, u).alias("l"))


def draw_cols_from_proportions(matrix: CellMatrix, col_props: Sequence[float], seed: int) -> DataFrame:
    """Column labels drawn from the proportions alone."""
    weights = [F.lit(float(w)) for w in col_props]
    drawn = pick_category(weights, uniform("e", F.col("col_id"), 0, 0, seed))
    return matrix.columns().select("col_id", drawn.cast("int").alias("l"))


# -- stochastic step --------------------------------------------------------------------

SWEEPS = 3


def se_step(
    matrix: CellMatrix, col_part: DataFrame, model: BlockModel, shared: bool,
    iteration: int, seed: int, sweeps: int = SWEEPS,
) -> tuple[DataFrame, DataFrame]:
    """Alternate row and column draws with the model fixed; ``(row_id, z), (col_id, l)``.

    Each draw depends on the one before only, so all but the last column draw form one
    plan. The two results are checkpointed: they cut the lineage of the iteration, and a
    lost executor cannot change labels that later steps have used. A column cluster that has
    vanished ends the try."""
    rows = draw_rows(matrix, col_part, model, shared, iteration, 1, seed)
    for sweep in range(2, sweeps + 1):
        columns = draw_cols(matrix, rows, model, iteration, sweep - 1, seed)
        rows = draw_rows(matrix, columns, model, shared, iteration, sweep, seed)
    rows = checkpoint(rows)
    columns = checkpoint(draw_cols(matrix, rows, model, iteration, sweeps, seed))
    if columns.select("l").distinct().count() < model.n_cols:
        raise EmptyClusterError("a column cluster has vanished")
    return rows, columns


# -- estimation -------------------------------------------------------------------------


@dataclass(frozen=True)
class BlockMoments:
    """Count, sum and product matrix about ``shift`` of each block, indexed [l][k]."""

    shift: np.ndarray
    sizes: list[list[int]]
    sums: list[list[np.ndarray]]
    products: list[list[np.ndarray]]


def labelled_with_blocks(
    matrix: CellMatrix, row_labels: DataFrame, col_part: DataFrame, shared: bool
) -> DataFrame:
    """``(row_id, col_id, l, k, feat)``."""
    met = matrix.cells.join(matrix.beside_rows(row_labels), "row_id")
    met = met.join(matrix.beside_columns(col_part), "col_id")
    own: Column = F.get("z", F.lit(0)) if shared else F.get("z", F.col("l"))
    return met.select("row_id", "col_id", "l", own.alias("k"), "feat")


def block_moments(
    matrix: CellMatrix, row_labels: DataFrame, col_part: DataFrame,
    row_clusters: Sequence[int], shared: bool,
) -> BlockMoments:
    """Moments of all blocks from one pass over the cells. Fails on a block that has fewer
    than two cells, before anything is estimated."""
    shift = matrix.pooled()[0]
    labelled = labelled_with_blocks(matrix, row_labels, col_part, shared)
    sums = block_sums(labelled.select("l", "k", "feat"), matrix.dim, shift)
    return collected_moments(sums, shift, row_clusters)


def collected_moments(
    sums: DataFrame, shift: np.ndarray, row_clusters: Sequence[int]
) -> BlockMoments:
    """Bring the moments of the expected blocks, one record each, to the driver."""
    found = {(r.l, r.k): unpack_sums(r.sums, len(shift)) for r in sums.collect()}
    return moments_found(found, shift, row_clusters)


def moments_found(
    found: dict[tuple[int, int], tuple], shift: np.ndarray, row_clusters: Sequence[int]
) -> BlockMoments:
    """The moments of the expected blocks; fails on one with fewer than two cells."""
    empty = [
        (l, k) for l, size in enumerate(row_clusters) for k in range(size)
        if found.get((l, k), (0,))[0] < 2
    ]
    if empty:
        raise EmptyClusterError(f"blocks (l, k) with fewer than two cells: {empty}")

    def pick(part: int) -> list[list]:
        return [[found[l, k][part] for k in range(size)] for l, size in enumerate(row_clusters)]

    return BlockMoments(shift, pick(0), pick(1), pick(2))


def estimate(
    moments: BlockMoments, n_rows: int, n_cols: int, shared: bool,
    loadings: list[list[np.ndarray]] | np.ndarray | None,
    components: int | None = None, per_block: bool = False, center_divisor: str = "n",
) -> BlockModel:
    """Model of the given moments. ``loadings`` are one matrix for all blocks, one per block,
    or None for a PCA of each block: with ``components`` axes, or as many as each block
    needs when ``per_block`` is set.

    The centre is the block sum over n, or over n - 1 when ``center_divisor`` is 'n-1'; the
    covariance is always divided by n - 1. As the matrix is complete, block sizes give both
    kinds of proportions."""
    if center_divisor not in ("n", "n-1"):
        raise ValueError("center_divisor must be 'n' or 'n-1'")
    means, covs, axes = [], [], []
    for l, row in enumerate(moments.sizes):
        means.append([])
        covs.append([])
        axes.append([])
        for k, n in enumerate(row):
            s, q = moments.sums[l][k], moments.products[l][k]
            divisor = n if center_divisor == "n" else n - 1
            centre = (s + n * moments.shift) / divisor - moments.shift
            spread = (
                q - np.outer(centre, s) - np.outer(s, centre) + n * np.outer(centre, centre)
            ) / (n - 1)
            if loadings is None:
                true_mean = s / n
                true_cov = (q - n * np.outer(true_mean, true_mean)) / (n - 1)
                w = principal_axes(true_cov, count=None if per_block else components)
            else:
                w = loadings if isinstance(loadings, np.ndarray) else loadings[l][k]
            means[l].append(w @ (centre + moments.shift))
            covs[l].append(w @ spread @ w.T)
            axes[l].append(w)
    widths = [sum(row) / n_rows for row in moments.sizes]
    if shared:
        per_row = np.sum([np.array(row, dtype=float) for row in moments.sizes], axis=0)
        row_props = [per_row / per_row.sum() for _ in moments.sizes]
    else:
        row_props = [np.array(row, dtype=float) / sum(row) for row in moments.sizes]
    return BlockModel(
        row_props, np.array(widths) / n_cols, means, covs, axes, [list(r) for r in moments.sizes]
    )


def m_step(
    matrix: CellMatrix, row_labels: DataFrame, col_part: DataFrame,
    row_clusters: Sequence[int], shared: bool,
    loadings: list[list[np.ndarray]] | np.ndarray | None = None,
    components: int | None = None, per_block: bool = False, center_divisor: str = "n",
) -> tuple[BlockModel, float]:
    """Estimated model and its log-likelihood on the labels it was estimated from; both come
    from the same moments."""
    moments = block_moments(matrix, row_labels, col_part, row_clusters, shared)
    return estimate_with_likelihood(
        moments, matrix, shared, loadings, components, per_block, center_divisor
    )


def estimate_with_likelihood(
    moments: BlockMoments, matrix: CellMatrix, shared: bool, loadings,
    components: int | None, per_block: bool, center_divisor: str,
) -> tuple[BlockModel, float]:
    model = estimate(
        moments, matrix.n_rows, matrix.n_cols, shared, loadings,
        components, per_block, center_divisor,
    )
    return model, likelihood_of(model, moments)


def likelihood_of(model: BlockModel, moments: BlockMoments) -> float:
    return log_likelihood(model, moments.shift, moments.sizes, moments.sums, moments.products)


def block_sizes(
    matrix: CellMatrix, row_labels: DataFrame, col_part: DataFrame,
    row_clusters: Sequence[int], shared: bool,
) -> DataFrame:
    """Size of every expected block, zero for one without cells: ``(l, k, size)``."""
    labelled = labelled_with_blocks(matrix, row_labels, col_part, shared)
    expected = F.array(*[
        F.struct(F.lit(l).alias("l"), F.lit(k).alias("k"))
        for l, size in enumerate(row_clusters) for k in range(size)
    ])
    blocks = matrix.cells.sparkSession.range(1).select(F.inline(expected))
    counted = labelled.groupBy("l", "k").agg(F.count(F.lit(1)).alias("size"))
    return blocks.join(counted, ["l", "k"], "left").select(
        "l", "k", F.coalesce("size", F.lit(0)).alias("size")
    )


def block_loadings(
    matrix: CellMatrix, row_labels: DataFrame, col_part: DataFrame,
    row_clusters: Sequence[int], shared: bool, components: int | None = None,
) -> DataFrame:
    """One PCA per block, ``(l, k, i, j, loading)``, from the one-pass moments."""
    moments = block_moments(matrix, row_labels, col_part, row_clusters, shared)
    model = estimate(
        moments, matrix.n_rows, matrix.n_cols, shared, None, components, components is None
    )
    records = [
        (l, k, i, j, float(value))
        for l, row in enumerate(model.loadings) for k, w in enumerate(row)
        for (i, j), value in np.ndenumerate(w)
    ]
    return matrix.cells.sparkSession.createDataFrame(
        records, "l int, k int, i int, j int, loading double"
    )


def row_proportions(row_part: DataFrame, n_rows: int) -> DataFrame:
    """``(l, k, row_prop)``."""
    counted = row_part.groupBy("l", "k").agg(F.count(F.lit(1)).alias("n"))
    return counted.select("l", "k", (F.col("n") / F.lit(n_rows)).alias("row_prop"))


def col_proportions(col_part: DataFrame, n_cols: int) -> DataFrame:
    """``(l, col_prop)``."""
    counted = col_part.groupBy("l").agg(F.count(F.lit(1)).alias("n"))
    return counted.select("l", (F.col("n") / F.lit(n_cols)).alias("col_prop"))


def block_log_likelihood(
    matrix: CellMatrix, row_labels: DataFrame, col_part: DataFrame, model: BlockModel, shared: bool
) -> DataFrame:
    """One record ``(loglik_cells, loglik_complete)``: the block log densities summed over
    the cells, and the same with the log proportion of every label added once."""
    labelled = labelled_with_blocks(matrix, row_labels, col_part, shared)
    density = own_block_score(model.scorers())(F.col("feat"), F.col("l"), F.col("k"))
    cells = labelled.select(density.alias("ll")).agg(F.sum("ll").alias("loglik_cells"))

    def prior(table: list[float], index: Column) -> Column:
        return F.get(F.array(*[F.lit(log_or_lowest(p)) for p in table]), index)

    props = model.row_props[:1] if shared else model.row_props
    row_terms = sum(
        (prior(list(p), F.get("z", F.lit(l))) for l, p in enumerate(props)), F.lit(0.0)
    )
    rows = row_labels.agg(F.sum(row_terms).alias("row_terms"))
    cols = col_part.agg(F.sum(prior(list(model.col_props), F.col("l"))).alias("col_terms"))
    return one_record(cells, rows, cols).select(
        "loglik_cells",
        (F.col("loglik_cells") + F.col("row_terms") + F.col("col_terms")).alias("loglik_complete"),
    )

