"""The block model: one Gaussian per block (l, k). Its size depends on the numbers of
clusters and features only, so it lives on the driver and is a table on request."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.functions.kernels import Scorer

BLOCK_SCHEMA = (
    "l int, k int, n_cells bigint, row_prop double, col_prop double, "
    "mean array<double>, cov array<array<double>>, loadings array<array<double>>"
)


class EmptyClusterError(ValueError):
    """A block has too few cells to be estimated; a new start may help."""


@dataclass(frozen=True)
class BlockModel:
    """Everything is indexed [l][k]. A model with shared rows (one row partition for all
    column clusters) repeats its row proportions for every l."""

    row_props: list[np.ndarray]
    col_props: np.ndarray
    means: list[list[np.ndarray]]
    covs: list[list[np.ndarray]]
    loadings: list[list[np.ndarray]]
    sizes: list[list[int]] | None = None

    @property
    def row_clusters(self) -> list[int]:
        return [len(row) for row in self.means]

    @property
    def n_cols(self) -> int:
        return len(self.means)

    @property
    def dim(self) -> int:
        """Dimension of the projected features of the first block."""
        return len(self.means[0][0])

    def dims(self) -> set[int]:
        """Numbers of components that occur; only a fit ``per_block`` has more than one."""
        return {len(mean) for row in self.means for mean in row}

    def parameters(self) -> float:
        """Mean number of parameters of a block."""
        return float(np.mean([parameters_per_block(len(m)) for row in self.means for m in row]))

    def scorers(self) -> list[list[Scorer]]:
        return [
            [gaussian_scorer(m, c, w) for m, c, w in zip(*parts)]
            for parts in zip(self.means, self.covs, self.loadings)
        ]

    def to_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.records(), BLOCK_SCHEMA)

    def records(self) -> list[tuple]:
        return [
            (
                l,
                k,
                self.sizes[l][k] if self.sizes else None,
                float(self.row_props[l][k]),
                float(self.col_props[l]),
                self.means[l][k].tolist(),
                self.covs[l][k].tolist(),
                self.loadings[l][k].tolist(),
            )
            for l in range(self.n_cols)
            for k in range(self.row_clusters[l])
        ]

    @staticmethod
    def from_frame(blocks: DataFrame) -> BlockModel:
        """Read a model back from its table, one record per block."""
        rows = blocks.select(*[part.split()[0] for part in BLOCK_SCHEMA.split(", ")])
        per_l: dict[int, list] = {}
        for row in rows.orderBy("l", "k").collect():
            per_l.setdefault(row.l, []).append(row)
        groups = [per_l[l] for l in sorted(per_l)]
        sized = all(r.n_cells is not None for g in groups for r in g)
        return BlockModel(
            [np.array([r.row_prop for r in g]) for g in groups],
            np.array([g[0].col_prop for g in groups]),
            [[np.array(r.mean) for r in g] for g in groups],
            [[np.array(r.cov) for r in g] for g in groups],
            [[np.array(r.loadings) for r in g] for g in groups],
            [[r.n_cells for r in g] for g in groups] if sized else None,
        )


def gaussian_scorer(mean: np.ndarray, cov: np.ndarray, loadings: np.ndarray) -> Scorer:
    """Whitening form of a normal log density after projection by ``loadings``. A singular
    covariance is replaced by its pseudo-inverse and pseudo-determinant, with the tolerance
    Spark ML's multivariate normal uses."""
    values, vectors = np.linalg.eigh((cov + cov.T) / 2)
    kept = values > np.finfo(float).eps * max(values.max(), 0.0) * len(values)
    if not kept.any():
        raise EmptyClusterError("a block has no spread in any direction")
    root = vectors[:, kept].T / np.sqrt(values[kept])[:, None]
    constant = -0.5 * (len(mean) * np.log(2 * np.pi) + np.log(values[kept]).sum())
    return root @ loadings, root @ mean, float(constant)


def mean_model(models: Sequence[BlockModel]) -> BlockModel:
    """Average of several models of one shape. Loadings are averaged after their signs have
    been fixed, which ``principal_axes`` does."""
    if not models:
        raise ValueError("no model to average")
    shapes = {tuple(tuple(w.shape for w in row) for row in m.loadings) for m in models}
    if len(shapes) > 1:
        raise ValueError("models of different shape cannot be averaged")

    def average(pick) -> list[list[np.ndarray]]:
        return [
            [sum(pick(m)[l][k] for m in models) / len(models) for k in range(size)]
            for l, size in enumerate(models[0].row_clusters)
        ]

    return BlockModel(
        [sum(m.row_props[l] for m in models) / len(models) for l in range(models[0].n_cols)],
        sum(m.col_props for m in models) / len(models),
        average(lambda m: m.means),
        average(lambda m: m.covs),
        average(lambda m: m.loadings),
    )


def mean_model_table(history: DataFrame, burn_in: int) -> DataFrame:
    """The same average from a table ``(iter, blocks...)``, by position:
    ``(l, k, row_prop, col_prop, mean, cov, loadings)``."""
    late = history.filter(F.col("iter") > burn_in)
    props = late.groupBy("l", "k").agg(
        F.avg("row_prop").alias("row_prop"), F.avg("col_prop").alias("col_prop")
    )

    def by_position(column: str) -> DataFrame:
        exploded = late.select("l", "k", F.posexplode(column).alias("i", "value"))
        averaged = exploded.groupBy("l", "k", "i").agg(F.avg("value").alias("value"))
        return averaged.groupBy("l", "k").agg(in_order("i", "value").alias(column))

    def by_two_positions(column: str) -> DataFrame:
        rows = late.select("l", "k", F.posexplode(column).alias("i", "row"))
        exploded = rows.select("l", "k", "i", F.posexplode("row").alias("j", "value"))
        averaged = exploded.groupBy("l", "k", "i", "j").agg(F.avg("value").alias("value"))
        packed = averaged.groupBy("l", "k", "i").agg(in_order("j", "value").alias("row"))
        return packed.groupBy("l", "k").agg(in_order("i", "row").alias(column))

    return (
        props.join(by_position("mean"), ["l", "k"])
        .join(by_two_positions("cov"), ["l", "k"])
        .join(by_two_positions("loadings"), ["l", "k"])
    )


def in_order(position: str, value: str):
    """Values of a group of bounded size as an array ordered by their position."""
    pairs = F.sort_array(F.collect_list(F.struct(position, value)))
    return F.transform(pairs, lambda pair: pair[value])


def update_model(former: BlockModel, l: int, new: BlockModel) -> BlockModel:
    """Replace column cluster ``l`` by the column clusters of ``new``, which come last. The
    new column proportions share the removed one."""
    if not 0 <= l < former.n_cols:
        raise ValueError(f"column cluster {l} is not in 0..{former.n_cols - 1}")
    if former.dims() | new.dims() != former.dims():
        raise ValueError(f"blocks of {new.dims()} components cannot join blocks of {former.dims()}")

    def spliced(old: list, added: list) -> list:
        return old[:l] + old[l + 1 :] + added

    sized = former.sizes is not None and new.sizes is not None
    return BlockModel(
        spliced(former.row_props, new.row_props),
        np.concatenate([np.delete(former.col_props, l), new.col_props * former.col_props[l]]),
        spliced(former.means, new.means),
        spliced(former.covs, new.covs),
        spliced(former.loadings, new.loadings),
        spliced(former.sizes, new.sizes) if sized else None,
    )


def update_model_table(blocks: DataFrame, l: int, new_blocks: DataFrame, n_cols: int) -> DataFrame:
    """``update_model`` on block tables; ``n_cols`` is the former number of column clusters."""
    removed = blocks.filter(F.col("l") == l).select("col_prop").first()
    kept = blocks.filter(F.col("l") != l).withColumn(
        "l", F.col("l") - (F.col("l") > l).cast("int")
    )
    added = new_blocks.withColumn("l", F.col("l") + F.lit(n_cols - 1)).withColumn(
        "col_prop", F.col("col_prop") * F.lit(removed.col_prop)
    )
    return kept.unionByName(added)


def lbm_to_clbm(model: BlockModel) -> BlockModel:
    """A model with shared rows read as a conditional one: every column cluster gets its
    own copy of the row proportions."""
    return replace(model, row_props=[np.array(props) for props in model.row_props])


def lbm_to_clbm_table(lbm_blocks: DataFrame, row_props: DataFrame, col_props: DataFrame) -> DataFrame:
    """The same on tables: blocks ``(k, l, ...)`` without proportions, row proportions
    ``(k, row_prop)`` repeated over l, column proportions ``(l, col_prop)``."""
    return lbm_blocks.join(F.broadcast(row_props), "k").join(F.broadcast(col_props), "l")


def log_likelihood(model: BlockModel, shift: np.ndarray, sizes, sums, products) -> float:
    """Sum of block log densities over cells, from the moments of each block about
    ``shift``: no pass over the cells is needed."""
    total = 0.0
    for l, row in enumerate(model.scorers()):
        for k, (linear, offset, constant) in enumerate(row):
            n, s, q = sizes[l][k], sums[l][k], products[l][k]
            gap = linear @ shift - offset
            squares = np.einsum("ij,jk,ik->", linear, q, linear)
            squares += 2 * gap @ (linear @ s) + n * (gap @ gap)
            total += n * constant - 0.5 * squares
    return float(total)


def parameters_per_block(dim: int, full_covariance: bool = True) -> float:
    return dim + dim * (dim + 1) / 2 if full_covariance else 2.0 * dim


def clbm_penalty(row_clusters: Sequence[int], n: int, p: int, per_block: float,
                 count_blocks_once: bool = False) -> float:
    """What ICL subtracts from the log-likelihood, given the parameters of a block. The recorded form counts every row
    cluster once per column cluster; ``count_blocks_once`` counts the blocks that exist."""
    n_cols, total = len(row_clusters), sum(row_clusters)
    blocks = total if count_blocks_once else total * n_cols
    return (
        np.log(n) * (total - n_cols) / 2
        + np.log(p) * (n_cols - 1) / 2
        + np.log(n * p) * blocks * per_block / 2
    )


def lbm_penalty(n_row_clusters: int, n_col_clusters: int, n: int, p: int, per_block: float) -> float:
    return (
        np.log(n) * (n_row_clusters - 1) / 2
        + np.log(p) * (n_col_clusters - 1) / 2
        + np.log(n * p) * n_row_clusters * n_col_clusters * per_block / 2
    )
