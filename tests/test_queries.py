"""Queries against their SQL on the smallest tables; ``check.py`` runs all of them."""

import pytest

import __spark_entry__ as contract
from check import database, differences
from conftest import SF_DIR

from cellweave.plans import registry

QUERIES, ORACLES = contract.queries(), contract.oracle_sql()
# Statistical and structural operators; the longer fits are compared in check.py.
COMPARED = [
    "cells_ingest", "series_build", "decorator_lookup", "row_pack", "col_pack", "block_filter",
    "id_dictionary", "sample_cells", "matrix_shape", "model_table", "labelled_cells",
    "score_append", "matrix_sink", "spectral_features", "periodogram", "pooled_pca_loadings",
    "covariance_matrix", "weighted_covariance_matrix", "grouped_covariance",
    "weighted_covariance_scalar", "log_sum_exp", "categorical_draw", "gaussian_logpdf",
    "kmeans_init_random", "kmeans_init_pp", "kmeans_fit", "lbm_draw_rows", "lbm_draw_cols",
    "clbm_draw_rows", "clbm_draw_cols", "clbm_loglik", "clbm_icl", "clbm_mean_model", "clbm_fit",
    "lbm_fit", "clbm_init_random", "clbm_init_given_partition", "entire_row_partition",
    "adjusted_rand_index", "partitions_equal", "merge_col_partition", "update_model", "lbm_to_clbm",
    "clbm_grid_search", "lbm_grid_search", "lbm_greedy_search", "clbm_greedy_search", "clbm_after_lbm_grid",
]


@pytest.fixture(scope="module")
def con():
    return database(SF_DIR)


@pytest.mark.parametrize("name", COMPARED)
def test_query_equals_sql(spark, con, name):
    df = QUERIES[name](spark, SF_DIR)
    result = con.execute(ORACLES[name])
    names = [column[0] for column in result.description]
    rows = [tuple(r) for r in df.collect()]
    assert differences(rows, df.columns, result.fetchall(), names, slack=1.5e-6) is None


def test_every_sql_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
    assert len(registry.queries()) == 96
    assert set(registry.queries()) <= set(QUERIES)


def test_entry(spark):
    rows = contract.entry(spark)
    assert rows.count() == 15 * 5
    assert {"row_name", "col_name", "row_cluster", "col_cluster", "feat"} == set(rows.columns)
