"""No record, name, key or cell is lost without a word; large means cost no digits."""

import datetime as dt
import math
import re

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from cellweave.operators import kmeans, partitions, shape, spectral, stats
from cellweave.operators.matrix import CellMatrix, IncompleteMatrixError
from cellweave.operators.model import BlockModel, mean_model, update_model
from cellweave.plans import tables
from cellweave.sources import series, sinks


def events(spark, tmp_path, rows):
    schema = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double"
    frame = spark.createDataFrame([(i, *row) for i, row in enumerate(rows)], schema)
    frame.write.parquet(str(tmp_path / "events.parquet"))
    return str(tmp_path)


def test_series_span_months_and_missing_cells(spark, tmp_path):
    at = lambda month, day: dt.datetime(2024, month, day, 12)
    path = events(spark, tmp_path, [
        (at(1, 31), 1, "a", 2.0), (at(2, 1), 1, "a", 3.0), (at(3, 1), 2, "b", 4.0), (at(1, 31), 3, None, 5.0)])
    found = {(r.row_id, r.col_id): r.x for r in tables.events_raw(spark, path).collect()}
    assert len(found) == 9 and {len(x) for x in found.values()} == {31}
    assert sum(map(sum, found.values())) == 14.0
    assert found[1, 1][:2] == [2.0, 3.0] and found[2, 2][30] == 4.0 and found[3, 0][0] == 5.0


@pytest.mark.parametrize("n", [3, 100])
def test_records_outside_the_buckets_are_refused(spark, n):
    good = [(1, 1, 1, 1.0), (1, 1, n, 2.0), (1, 1, n, 3.0)]
    make = lambda rows: spark.createDataFrame(rows, "r int, c int, b int, v double")
    built = series.series_build(make(good), "r", "c", F.col("b"), "v", n).first()
    assert built.x == [1.0] + [0.0] * (n - 2) + [5.0] and built.t[-1] == n
    for bad in ((1, 1, n + 1, 1.0), (1, 1, None, 1.0), (None, 1, 1, 1.0), (1, None, 1, 1.0), (1, 1, 0, 1.0)):
        with pytest.raises(PySparkException, match="no bucket"):
            series.series_build(make([*good, bad]), "r", "c", F.col("b"), "v", n).collect()


def test_sparse_column_ids_and_missing_names(spark):
    cells = spark.createDataFrame([(7, 10, 1.0), (7, 20, 2.0), (9, 10, 3.0), (9, 20, 4.0)], "row_id long, col_id long, v double")
    wide = sinks.matrix_sink(cells, "v", 2, 2)
    assert wide.columns == ["id", "10", "20"]
    assert sorted(map(tuple, wide.collect())) == [(1, 1.0, 2.0), (2, 3.0, 4.0)]
    names = spark.createDataFrame([("x",), (None,)], "name string")
    dictionary, n = tables.dictionary(names, "name", "id")
    assert sorted(r.id for r in shape.apply_dictionary(names, dictionary, "name", n).collect()) == [0, 1]
    row_part = spark.createDataFrame([(7, 0, 1)], "row_id long, l int, k int")
    col_part = spark.createDataFrame([(10, 0)], "col_id long, l int")
    row_names = spark.createDataFrame([(9, "nine")], "row_id long, row_name string")
    col_names = spark.createDataFrame([(20, "twenty")], "col_id long, col_name string")
    vectors = cells.select("row_id", "col_id", F.array("v").alias("v"))
    lines = sinks.labelled_cells(vectors, row_part, col_part, row_names, col_names, ["v"]).collect()
    assert sorted(map(str, map(tuple, lines))) == sorted(map(str, [
        ("7", "10", 1, 0, "1.0"), ("7", "twenty", None, None, "2.0"),
        ("nine", "10", None, 0, "3.0"), ("nine", "twenty", None, None, "4.0")]))


def test_packs_are_cut_by_position(spark):
    cells = spark.createDataFrame([(1, c, [float(c)]) for c in (5, 5000, 1_000_000)], "row_id long, col_id long, feat array<double>")
    assert [(r.pack, r.col_ids) for r in shape.row_pack(cells).collect()] == [(0, [5, 5000, 1_000_000])]
    two = sorted((r.pack, r.col_ids) for r in shape.row_pack(cells, 2).collect())
    assert two == [(0, [5, 5000]), (1, [1_000_000])]


def test_log_sum_exp_keeps_every_key(spark):
    inf = math.inf
    scores = {"low": [-inf, -inf], "high": [1.0, inf], "mixed": [-inf, 2.0, 3.0], "none": [None], "nan": [1.0, math.nan],
              "far": [-1e6, -1e6 + 1], "edge": [299.9, 300.1, -5.0], "zero": [-0.5, 0.5], None: [4.0], "huge": [1e30]}
    rows = [(k, s) for k, values in scores.items() for s in values]
    df = spark.createDataFrame(rows, "k string, score double")
    plan = stats.log_sum_exp_by_key(df, ["k"], "score")
    found = {r.k: r.lse for r in plan.collect()}
    assert found["low"] == -inf and found["high"] == inf and found["none"] is None and math.isnan(found["nan"])
    for key in ("mixed", "far", "edge", "zero", None, "huge"):
        finite = [s for s in scores[key] if s > -inf]
        top = max(finite)
        assert found[key] == pytest.approx(top + math.log(sum(math.exp(s - top) for s in finite)), abs=1e-9)
    assert set(found) == set(scores)
    final = plan._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert final.count("Exchange hashpartitioning") <= 2


def test_covariances_about_large_means(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 2)) + np.repeat([[1e8, -1e8], [3.0, 1e9]], 200, axis=0)
    w = rng.random(400)
    rows = [("a" if i < 200 else None, float(a), float(b), float(v)) for i, ((a, b), v) in enumerate(zip(x, w))]
    df = spark.createDataFrame(rows, "g string, x double, y double, w double")
    found = {r.g: r.weighted_covariance for r in stats.weighted_covariance_scalar(df, ["g"], "x", "y", "w").collect()}
    for key, part in (("a", slice(0, 200)), (None, slice(200, 400))):
        gaps = x[part] - x[part].mean(axis=0)
        assert found[key] == pytest.approx((w[part] * gaps[:, 0] * gaps[:, 1]).sum() / w[part].sum(), abs=1e-6)
    cells = spark.createDataFrame([(0, i // 200, [float(a), float(b)]) for i, (a, b) in enumerate(x)], "l int, k int, feat array<double>")
    centres = cells.groupBy("l", "k").agg(F.array(F.avg(F.col("feat")[0]), F.avg(F.col("feat")[1])).alias("mean"))
    covs = {(r.k, r.i, r.j): r.cov for r in stats.grouped_covariance(cells, centres, 2).collect()}
    for k in range(2):
        expected = np.cov(x[k * 200 : k * 200 + 200].T)
        assert [[covs[k, i, j] for j in range(2)] for i in range(2)] == pytest.approx(expected, abs=1e-6)


@pytest.mark.parametrize("bad", [[1.0], [1.0, None], [1.0, 2.0, 3.0], None])
@pytest.mark.parametrize("pack_bytes", [1 << 20, 1])
def test_ragged_features_are_refused_in_both_layouts(spark, bad, pack_bytes):
    rows = [(r, c, [1.0, 2.0]) for r in range(3) for c in range(2) if (r, c) != (1, 1)] + [(1, 1, bad)]
    cells = spark.createDataFrame(rows, "row_id long, col_id long, feat array<double>")
    with pytest.raises(IncompleteMatrixError):
        CellMatrix.prepare(cells, pack_bytes)


@pytest.mark.parametrize("dim", [2, 9])
def test_moments_refuse_missing_entries(spark, dim):
    good, bad = [1.0] * dim, [1.0] * (dim - 1) + [None]
    cells = spark.createDataFrame([(0, 0, good), (0, 0, bad)], "l int, k int, feat array<double>")
    with pytest.raises(PySparkException):
        stats.block_sums(cells, dim).collect()


def test_interpolation_between_uneven_frequencies(spark):
    df = spark.createDataFrame([([0.0, 1.0, 3.0], [0.0, 10.0, 30.0]), ([1.0, 2.0, 3.0], [10.0, 20.0, 30.0])], "f array<double>, v array<double>")
    found = [r.out for r in spectral.linear_interpolation(df, "f", "v", [2.0, 2.5, 0.5, 3.0, 4.0], "out").collect()]
    assert found == [[20.0, 25.0, 5.0, 30.0, None], [20.0, 25.0, None, 30.0, None]]


def test_items_with_wide_ids_are_drawn(spark, monkeypatch):
    monkeypatch.setattr(kmeans, "BAND_ITEMS", 2)
    ids = [-(2**63), -5, 2**53 + 1, 2**53 + 2, 2**63 - 1]
    weights = spark.createDataFrame([(i, 1.0) for i in ids], "item long, weight double")
    drawn = [kmeans.draw_item(weights, F.lit(u), 5).first().item for u in (0.1, 0.3, 0.5, 0.7, 0.9)]
    assert drawn == ids


def block(dim):
    eye = np.eye(dim)
    return BlockModel([np.ones(1)], np.ones(1), [[np.zeros(dim)]], [[eye]], [[eye]], [[5]])


def test_models_of_different_dimension_do_not_mix():
    with pytest.raises(ValueError, match="different shape"):
        mean_model([block(2), block(1)])
    with pytest.raises(ValueError, match="components"):
        update_model(block(2), 0, block(1))


def test_slices_keep_the_components_of_the_whole(spark):
    rng = np.random.default_rng(2)
    rows = [(r, c, [float(rng.normal()), float(rng.normal()) if c else 0.0]) for r in range(20) for c in range(4)]
    cells = spark.createDataFrame(rows, "row_id long, col_id long, feat array<double>")
    columns = spark.createDataFrame([(0, 0), (1, 1), (2, 1), (3, 1)], "col_id long, l int")
    for pack_bytes in (1 << 20, 1):
        matrix = CellMatrix.prepare(cells, pack_bytes)
        pieces = [matrix.slice(columns, l).pooled_loadings() for l in range(2)]
        assert {p.shape for p in pieces} == {matrix.pooled_loadings().shape}


def test_labels_do_not_move_cells(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        cells = spark.range(1000).select((F.col("id") % 100).alias("row_id"), F.floor(F.col("id") / 100).alias("col_id"))
        kept = cells.repartition(5, "row_id").persist()
        rows = spark.range(100).select(F.col("id").alias("row_id"), F.explode(F.sequence(F.lit(0), F.lit(1))).alias("l"), F.lit(0).alias("k"))
        cols = spark.range(10).select(F.col("id").alias("col_id"), (F.col("id") % 2).cast("int").alias("l"))
        for found in (shape.with_blocks(kept, rows, cols), partitions.cond_block_partition(kept, rows, cols)):
            assert found.count() == 1000
            plan = found._jdf.queryExecution().executedPlan().toString()
            keys = re.findall(r"hashpartitioning\(([^)]*)\)", plan)
            assert keys and not any("row_id#" in k and "l#" in k for k in keys)
        kept.unpersist()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("dim", [3, 10])
def test_grouped_covariances_of_far_blocks_cost_no_digits(spark, dim):
    rng = np.random.default_rng(5)
    rows, expected = [], {}
    for l, offset in ((0, 1e8), (1, -3e7), (2, 0.0)):
        x = rng.normal(size=(40, dim)) + offset
        centre = x.mean(axis=0) + 0.5
        rows += [(l, 0, v.tolist()) for v in x]
        expected[l] = (centre, (x - centre).T @ (x - centre) / 39)
    cells = spark.createDataFrame(rows, "l int, k int, feat array<double>")
    centres = spark.createDataFrame([(l, 0, c.tolist()) for l, (c, _) in expected.items()], "l int, k int, mean array<double>")
    for r in stats.grouped_covariance(cells, centres, dim).collect():
        assert math.isclose(r["cov"], expected[r.l][1][r.i, r.j], rel_tol=1e-5, abs_tol=1e-5)
    if dim == 3:
        for odd in ([1.0, 2.0], [1.0, None, 2.0], None):
            with pytest.raises(PySparkException):
                stats.grouped_covariance(cells.unionByName(spark.createDataFrame([(0, 0, odd)], cells.schema)), centres, dim).collect()


def test_embeddings_of_any_width_are_read_whole(spark, tmp_path):
    def path(name, vectors):
        frame = spark.createDataFrame([(i, v, 0) for i, v in enumerate(vectors)], "vec_id bigint, embedding array<float>, label int")
        frame.write.parquet(str(tmp_path / name / "embeddings.parquet"))
        return str(tmp_path / name)

    cells = tables.embedding_cells(spark, path("wide", [[float(i) for i in range(96)], [1.0] * 96])).collect()
    assert len(cells) == 24 and sum(sum(r.feat) for r in cells) == sum(range(96)) + 96
    for bad in ([1.0] * 60, [], None):
        with pytest.raises(PySparkException, match="slices"):
            tables.embedding_cells(spark, path(f"bad{len(bad or '') + (bad is None)}", [bad])).collect()
