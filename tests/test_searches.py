"""Fits in step, and searches on a matrix with planted clusters."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave.operators import fit, packed, partitions, selection, starts
from cellweave.operators.matrix import CellMatrix, long_row_part
from planted import feature_cells

ROWS, COLS = [(8, 12), (6, 14), (10, 10)], (5, 4, 6)


@pytest.fixture(scope="module")
def truth(spark):
    return feature_cells(spark, ROWS, COLS).cache()


@pytest.fixture(scope="module")
def matrix(truth):
    return CellMatrix.prepare(truth)


def jobs(spark, call):
    tracker, group = spark.sparkContext.statusTracker(), f"group-{np.random.default_rng().integers(1 << 40)}"
    spark.sparkContext.setJobGroup(group, "counted")
    try:
        result = call()
        return result, len(tracker.getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def collected(result):
    rows = {(r.row_id, r.l): r.k for r in result.row_part().collect()}
    return rows, {r.col_id: r.l for r in result.col_part.collect()}


def col_ari(found, truth):
    known = truth.select("col_id", F.col("l").alias("b")).distinct()
    return partitions.adjusted_rand_index(found.col_part.withColumnRenamed("l", "a").join(known, "col_id"), "a", "b").first().ari


def block_ari(found, truth, matrix):
    blocks = partitions.block_partition(matrix.cells, found.row_part(), found.col_part)
    known = truth.select("row_id", "col_id", (F.col("l") * 10 + F.col("k")).alias("b"))
    return partitions.adjusted_rand_index(blocks.withColumnRenamed("block", "a").join(known, ["row_id", "col_id"]), "a", "b").first().ari


def test_fits_in_step_equal_fits_alone(truth, matrix):
    columns = truth.select("col_id", "l").distinct()
    piece = matrix.slice(columns, 2)
    tasks = [
        (matrix, fit.clbm_settings((2, 2, 2), iterations=1, burn_in=1, seed=1)),
        (matrix, fit.clbm_settings((1, 3), iterations=2, burn_in=0, seed=4)),
        (matrix, fit.lbm_settings(2, 3, iterations=1, burn_in=1, seed=2)),
        (piece, fit.clbm_settings((2,), iterations=1, burn_in=1, seed=3)),
        (piece, fit.clbm_settings((2,), iterations=1, burn_in=0, init="random", seed=3)),
        (matrix, fit.clbm_settings((20, 20), max_tries=2)),
    ]
    for one, (own, settings) in zip(fit.fit_all(tasks), tasks, strict=True):
        alone = fit.fit(own, settings)
        assert one.status == alone.status and np.allclose(one.logliks, alone.logliks, rtol=1e-9)
        if one.status != "failed":
            assert collected(one) == collected(alone)


def test_starts_of_packed_and_long_matrices_agree(truth, matrix):
    long = CellMatrix.prepare(truth, pack_bytes=0)
    for settings in (fit.clbm_settings((3, 2)), fit.clbm_settings((2, 2), init="random"), fit.lbm_settings(2, 3)):
        start = starts.from_component_sample if settings.init == "random" else starts.from_random_partition
        (a, left), (b, right) = start(matrix, settings, 5), start(long, settings, 5)
        assert {tuple(r) for r in left.collect()} == {tuple(r) for r in right.collect()}
        assert all(np.allclose(x, y) for p, q in zip(a.covs, b.covs, strict=True) for x, y in zip(p, q, strict=True))
    labels = packed.balanced_col_labels(matrix, 4, 9)
    known = {r.col_id: r.l for r in partitions.balanced_col_partition(matrix.columns(), 4, 9, matrix.n_cols).collect()}
    assert labels.tolist() == [known[int(c)] for c in matrix.col_ids]
    long.release()


def test_jobs_do_not_grow_with_the_candidates(spark, matrix):
    matrix.pooled()
    options = {"iterations": 2, "burn_in": 1, "max_tries": 1}
    _, few = jobs(spark, lambda: selection.clbm_grid_search(matrix, [2], [1], 1, **options))
    _, many = jobs(spark, lambda: selection.clbm_grid_search(matrix, [1, 2, 3], [1, 2], 2, **options))
    assert many <= few + 4


def test_grid_search_finds_the_planted_blocks(spark, truth, matrix):
    found = selection.clbm_grid_search(matrix, [2], [2, 3], n_starts=6, iterations=3, burn_in=3)
    assert found.model.row_clusters == [2, 2, 2]
    assert col_ari(found, truth) == 1.0 and block_ari(found, truth, matrix) == 1.0


def test_greedy_search_finds_three_column_clusters(truth, matrix):
    found = selection.clbm_greedy_search(matrix, [1, 2, 3], max_l=4)
    assert found.model.n_cols == 3 and found.model.row_clusters == [2, 2, 2]
    assert col_ari(found, truth) == 1.0 and block_ari(found, truth, matrix) == 1.0
    assert found.icls[-3:] == sorted(found.icls[-3:]) and found.status == "composed"


def test_scores_of_a_composed_model_are_those_of_its_rows(truth, matrix):
    from cellweave.operators.blocks import block_log_likelihood

    found = selection.clbm_greedy_search(matrix, [2], max_l=3, n_starts=1, split_starts=3)
    again = block_log_likelihood(matrix, found.labels(), found.col_part, found.model, False).first().loglik_cells
    assert np.isclose(found.loglik, again)


@pytest.mark.parametrize("pack_bytes", [0, 1 << 20])
def test_cuts_are_scored_alike_in_both_layouts(truth, pack_bytes):
    small = truth.where("row_id < 12")
    own = CellMatrix.prepare(small, pack_bytes=pack_bytes)
    found = selection.clbm_greedy_search(own, [2], max_l=2, n_starts=1, split_starts=1, iterations=1, burn_in=1)
    assert found.model.n_cols == 2 and found.row_part().count() == 24
    test_cuts_are_scored_alike_in_both_layouts.seen = getattr(test_cuts_are_scored_alike_in_both_layouts, "seen", []) + [found.logliks]
    assert np.allclose(test_cuts_are_scored_alike_in_both_layouts.seen[0], found.logliks)


def test_refinement_after_an_lbm_finds_the_planted_blocks(truth, matrix):
    found = selection.clbm_after_lbm_grid(matrix, [2, 3], [3], n_starts=3, inner_starts=2)
    assert found.status != "failed" and found.model.n_cols == 3
    assert col_ari(found, truth) == 1.0 and block_ari(found, truth, matrix) > 0.9


def test_starts_inside_column_clusters_run_together(truth, matrix):
    for init in ("kmeans", "lbm"):
        model, col_part = starts.CLBM_STARTS[init](matrix, fit.clbm_settings((2, 2, 2), init=init), 0)
        assert col_part.count() == 15 and model.row_clusters == [2, 2, 2]


def test_row_labels_are_drawn_when_asked_for(matrix):
    found = fit.clbm_fit(matrix, (2, 2), iterations=1, burn_in=0)
    assert callable(found.row_labels)
    assert long_row_part(found.labels()).count() == 40 and not callable(found.row_labels)


def test_kmeans_of_groups_equals_kmeans_of_each(truth, matrix):
    from cellweave.operators import kmeans

    columns = truth.select("col_id", "l").distinct()
    grouped = matrix.cells.join(columns, "col_id").select(
        F.col("l").alias("group"), F.col("row_id").alias("item"), F.col("col_id").alias("attr"), "feat")
    items = kmeans.Items(grouped, 60, 15, 2, ("group", "item"))
    sizes = {0: 2, 1: 3, 2: 1}
    found = {(r.group, r.item): r.k for r in kmeans.kmeans_groups(items, sizes, seed=1, iterations=3).collect()}
    for l, k in sizes.items():
        own = kmeans.kmeans_fit(kmeans.Items.of_rows(matrix.slice(columns, l)), k, seed=1, iterations=3)
        assert {r.item: r.k for r in own.labels.collect()} == {i: c for (g, i), c in found.items() if g == l}
