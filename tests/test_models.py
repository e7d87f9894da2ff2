"""Fits, their two ways of running, and the numbers behind them."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cellweave.functions import kernels
from cellweave.operators import fit, kmeans, partitions, selection, starts
from cellweave.operators.blocks import cell_log_densities
from cellweave.operators.kmeans import Items
from cellweave.operators.matrix import CellMatrix, IncompleteMatrixError
from cellweave.operators.model import (
    BlockModel, clbm_penalty, gaussian_scorer, mean_model, parameters_per_block, update_model,
)
from cellweave.operators.pca import pca_threshold
from planted import feature_cells

ROWS, COLS = [(6, 12), (9, 9)], (5, 7)


@pytest.fixture(scope="module")
def truth(spark):
    return feature_cells(spark, ROWS, COLS).cache()


@pytest.fixture(scope="module")
def matrix(truth):
    return CellMatrix.prepare(truth)


def collected(result):
    rows = {(r.row_id, r.l): r.k for r in result.row_part().collect()}
    cols = {r.col_id: r.l for r in result.col_part.collect()}
    return rows, cols


def ari(left, right, keys, label):
    pairs = left.withColumnRenamed(label, "a").join(right.withColumnRenamed(label, "b"), keys)
    return partitions.adjusted_rand_index(pairs, "a", "b").first().ari


def test_scorer_is_the_normal_log_density():
    rng = np.random.default_rng(3)
    a = rng.normal(size=(3, 3))
    cov, mean, w = a @ a.T + np.eye(3), rng.normal(size=3), rng.normal(size=(3, 5))
    x = rng.normal(size=(7, 5))
    gap = x @ w.T - mean
    direct = -0.5 * (np.einsum("ij,jk,ik->i", gap, np.linalg.inv(cov), gap)
                     + np.log(np.linalg.det(cov)) + 3 * np.log(2 * np.pi))
    assert np.allclose(kernels.score(x, gaussian_scorer(mean, cov, w)), direct)


def test_singular_covariance_uses_the_pseudo_inverse():
    linear, offset, constant = gaussian_scorer(np.zeros(2), np.diag([4.0, 0.0]), np.eye(2))
    assert linear.shape == (1, 2)
    assert np.isclose(constant, -0.5 * (2 * np.log(2 * np.pi) + np.log(4.0)))


def test_arrays_of_one_table_share_a_length():
    assert kernels.to_matrix(pa.array([[1.0, 2.0], [3.0, 4.0]])).shape == (2, 2)
    with pytest.raises(ValueError):
        kernels.to_matrix(pa.array([[1.0], [3.0, 4.0]]))


def test_icl_penalty_of_the_recorded_runs():
    assert np.isclose(clbm_penalty([3, 2, 2], 90, 90, parameters_per_block(20)), 21747.58013670617, rtol=0, atol=1e-8)
    assert clbm_penalty([3, 2, 2], 90, 90, parameters_per_block(20), count_blocks_once=True) < 8000


def test_incomplete_matrices_are_refused(truth):
    missing = truth.filter("NOT (row_id = 3 AND col_id = 2)")
    doubled = truth.withColumn("col_id", F.when(F.col("col_id") == 3, F.lit(4)).otherwise(F.col("col_id")))
    one_row_odd = truth.withColumn(
        "col_id", F.when((F.col("row_id") == 1) & (F.col("col_id") == 3), F.lit(4)).otherwise(F.col("col_id")))
    for broken in (missing, one_row_odd):
        for limit in (0, 1 << 20):
            with pytest.raises(IncompleteMatrixError):
                CellMatrix.prepare(broken, limit)
    with pytest.raises(IncompleteMatrixError):
        CellMatrix.prepare(doubled)


@pytest.mark.parametrize("shared", [False, True])
def test_whole_rows_and_long_table_agree(truth, matrix, shared):
    long = CellMatrix.prepare(truth, pack_bytes=0)
    assert long.packs is None and matrix.packs is not None
    settings = fit.Settings(
        (2, 2), shared=shared, iterations=1, burn_in=1, seed=1,
        init="random" if shared else "random_partition")
    a, b = fit.fit(matrix, settings), fit.fit(long, settings)
    assert collected(a) == collected(b)
    assert np.allclose(a.logliks, b.logliks)
    long.release()


def test_wide_matrix_is_split_by_columns(truth, matrix):
    turned = truth.select(F.col("col_id").alias("row_id"), F.col("row_id").alias("col_id"), "feat")
    long, packed = CellMatrix.prepare(turned, pack_bytes=0), CellMatrix.prepare(turned)
    assert long.layout == "col_id"
    settings = fit.clbm_settings((2, 2), iterations=1, burn_in=0, seed=2)
    a, b = fit.fit(packed, settings), fit.fit(long, settings)
    assert collected(a) == collected(b)
    assert np.allclose(a.logliks, b.logliks)


def test_fit_finds_the_planted_blocks(truth, matrix):
    found = fit.multi_start(matrix, fit.clbm_settings((2, 2), iterations=3, burn_in=3), 4)
    cols = truth.select("col_id", "l").distinct()
    assert ari(found.col_part, cols, "col_id", "l") == 1.0
    blocks = partitions.block_partition(matrix.cells, found.row_part(), found.col_part)
    known = truth.select("row_id", "col_id", (F.col("l") * 10 + F.col("k")).alias("block"))
    assert ari(blocks, known, ["row_id", "col_id"], "block") == 1.0
    for props in found.model.row_props:
        assert np.isclose(props.sum(), 1.0)
    assert np.isclose(found.model.col_props.sum(), 1.0)
    assert found.trace().count() == len(found.logliks)
    assert found.blocks_history().select("iter").distinct().count() == len(found.history)


def test_labels_do_not_depend_on_partitioning(truth, matrix):
    settings = fit.clbm_settings((2, 2), iterations=1, burn_in=0, seed=5)
    shuffled = CellMatrix.prepare(truth.repartition(3, "col_id").orderBy(F.desc("col_id")))
    assert collected(fit.fit(matrix, settings)) == collected(fit.fit(shuffled, settings))


def test_settings_are_checked():
    for wrong in (
        {"row_clusters": ()}, {"row_clusters": (0, 1)}, {"row_clusters": (2, 2), "iterations": 0},
        {"row_clusters": (2,), "burn_in": -1}, {"row_clusters": (2,), "init": "nothing"},
        {"row_clusters": (2,), "update_loadings": "sometimes"}, {"row_clusters": (2,), "update_loadings": -1},
        {"row_clusters": (2,), "full_covariance": False}, {"row_clusters": (2,), "method": "VariationalEM"},
        {"row_clusters": (2, 3), "shared": True, "init": "random"},
    ):
        with pytest.raises(ValueError):
            fit.Settings(**wrong)
    assert fit.loading_start("always") == 0 and fit.loading_start("3") == 3
    assert fit.loading_start("never") == float("inf")


def test_failed_fit_keeps_the_schema(matrix):
    found = fit.fit(matrix, fit.clbm_settings((18, 18), max_tries=1, iterations=1, burn_in=0))
    assert found.status == "failed" and found.loglik == -np.inf
    assert found.blocks().count() == 0 and found.trace().count() == 1


def test_given_model_must_match(matrix):
    found = fit.clbm_fit(matrix, (2, 2), iterations=1, burn_in=0)
    again = BlockModel.from_frame(found.blocks())
    assert np.allclose(again.means[1][0], found.model.means[1][0])
    with pytest.raises(ValueError):
        fit.clbm_settings((2, 3), init="", model=again)
    with pytest.raises(ValueError):
        fit.clbm_settings((2, 2), init="random", model=again)
    cut = update_model(again, 0, again)
    assert cut.row_clusters == [2, 2, 2] and np.isclose(cut.col_props.sum(), 1.0)
    assert np.allclose(mean_model([again, again]).covs[0][0], again.covs[0][0])


def test_kmeans_starts_find_the_columns(truth, matrix):
    _, col_part = starts.from_kmeans(matrix, fit.clbm_settings((2, 2)), 0)
    assert ari(col_part, truth.select("col_id", "l").distinct(), "col_id", "l") == 1.0


def test_kmeans_draw_of_an_item_in_bands(matrix, monkeypatch):
    weights = matrix.cells.select(F.col("row_id").alias("item")).distinct().withColumn(
        "weight", (F.col("item") % 4).cast("double")).cache()
    values = sorted((r.item, r.weight) for r in weights.collect())
    running = np.cumsum([w for _, w in values])
    for u in (0.0, 0.2, 0.5, 0.9999):
        expected = values[int(np.searchsorted(running, u * running[-1]))][0]
        for bands, items in ((1024, 4096), (3, 2)):
            monkeypatch.setattr(kmeans, "BANDS", bands)
            monkeypatch.setattr(kmeans, "BAND_ITEMS", items)
            assert kmeans.draw_item(weights, F.lit(u), len(values)).first().item == expected


def test_kmeans_rejects_unknown_starts_and_small_clusters(matrix):
    items = Items.of_rows(matrix)
    with pytest.raises(ValueError):
        kmeans.kmeans_fit(items, 2, init="nothing")
    assert kmeans.kmeans_fit(items, 3, init="random", iterations=1, max_tries=1).status == "failed"


def test_fits_and_ml_agree_on_the_components(matrix):
    scored, loadings = pca_threshold(matrix.cells, "feat", "scores", 2, threshold=1.0)
    assert np.allclose(np.abs(loadings), np.abs(matrix.pooled_loadings(threshold=1.0)), atol=1e-8)
    assert np.allclose(loadings @ loadings.T, np.eye(2))


def test_densities_of_all_blocks(matrix):
    found = fit.clbm_fit(matrix, (2, 1), iterations=1, burn_in=0)
    assert cell_log_densities(matrix, found.model).count() == 18 * 12 * 3


def test_candidates_and_limits(matrix):
    assert selection.row_cluster_candidates([1, 2], [2]) == [(1, 1), (1, 2), (2, 2)]
    with pytest.raises(ValueError):
        selection.clbm_grid_search(matrix, [6], [1])


def test_greedy_search_finds_two_column_clusters(truth, matrix):
    found = selection.clbm_greedy_search(
        matrix, [1, 2], max_l=2, n_starts=1, split_starts=2, iterations=2, burn_in=1)
    assert found.model.n_cols == 2
    assert found.icl > found.icls[0]
    assert ari(found.col_part, truth.select("col_id", "l").distinct(), "col_id", "l") == 1.0


def test_lbm_greedy_search_respects_its_caps(matrix):
    found = selection.lbm_greedy_search(matrix, max_k=1, max_l=2, n_starts=1, iterations=1, burn_in=1)
    assert found.model.row_clusters[0] == 1 and found.model.n_cols <= 2
