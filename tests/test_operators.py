"""Operators on small tables, against direct computation."""

import math

import numpy as np
from pyspark.sql import Row, Window
from pyspark.sql import functions as F

from cellweave.functions.draws import uniform, uniform_value
from cellweave.operators import ranks, shape, spectral, stats
from cellweave.operators.partitions import adjusted_rand_index, balanced_row_partition, partitions_equal
from cellweave.runtime import run_together
from cellweave.sources import series, sinks


def test_uniform_is_the_same_on_driver_and_workers(spark):
    rows = spark.range(50).select("id", uniform("d", F.col("id"), 3).alias("u")).collect()
    assert all(r.u == uniform_value("d", r.id, 3) for r in rows)


def test_rank_in_bands_equals_one_window(spark, monkeypatch):
    df = spark.range(500).select(F.col("id").alias("row_id"), (F.col("id") % 2).alias("g"))
    u = uniform("r", F.col("row_id"))
    monkeypatch.setattr(ranks, "ROWS_PER_BAND", 32)
    found = ranks.uniform_rank(df, ["g"], u, "row_id", "place", 250)
    order = Window.partitionBy("g").orderBy(u, "row_id")
    direct = df.withColumn("direct", F.row_number().over(order) - 1)
    assert found.join(direct, "row_id").filter("place <> direct").count() == 0
    assert found.count() == 500


def test_dense_index_counts_across_ranges(spark):
    df = spark.range(300).select((F.col("id") * 7 % 1000).alias("v"))
    rows = ranks.dense_index(df, ["v"], "n", 300).orderBy("v").collect()
    assert [r.n for r in rows] == list(range(300))


def test_balanced_labels_differ_by_at_most_one(spark):
    rows = spark.range(101).withColumnRenamed("id", "row_id")
    part = balanced_row_partition(rows, (3, 2), 0, 101)
    for l, groups in ((0, 3), (1, 2)):
        sizes = [r["count"] for r in part.filter(F.col("l") == l).groupBy("k").count().collect()]
        assert len(sizes) == groups and max(sizes) - min(sizes) <= 1


def test_log_sum_exp_at_extremes(spark):
    scores = {"a": [-1e6, -1e6 - 1], "b": [800.0, 799.0, -5000.0], "c": [0.0], "d": [299.9, 300.1]}
    df = spark.createDataFrame([(k, v) for k, vs in scores.items() for v in vs], "key string, s double")
    for row in stats.log_sum_exp_by_key(df, ["key"], "s").collect():
        values = scores[row.key]
        top = max(values)
        assert math.isclose(row.lse, top + math.log(sum(math.exp(v - top) for v in values)), rel_tol=1e-12)


def test_block_sums_native_and_batched_agree(spark, monkeypatch):
    cells = spark.range(400).select(
        (F.col("id") % 2).cast("int").alias("l"), (F.col("id") % 3).cast("int").alias("k"),
        F.array(*[uniform("x", F.col("id"), i) for i in range(3)]).alias("feat"))
    shift = np.array([0.5, 0.4, 0.3])
    native = {(r.l, r.k): r.sums for r in stats.block_sums(cells, 3, shift).collect()}
    monkeypatch.setattr(stats, "NATIVE_DIM", 0)
    batched = {(r.l, r.k): r.sums for r in stats.block_sums(cells, 3, shift).collect()}
    assert native.keys() == batched.keys()
    for key in native:
        assert np.allclose(native[key], batched[key])
        x = np.array([r.feat for r in cells.filter(f"l = {key[0]} AND k = {key[1]}").collect()]) - shift
        n, sums, products = stats.unpack_sums(native[key], 3)
        assert n == len(x) and np.allclose(sums, x.sum(axis=0)) and np.allclose(products, x.T @ x)


def test_spectral_steps_equal_the_single_pass(spark):
    raw = spark.range(12).select(
        F.col("id").alias("row_id"), F.lit(0).cast("bigint").alias("col_id"),
        F.array(*[F.lit(float(t)) for t in range(16)]).alias("t"),
        F.array(*[uniform("w", F.col("id"), t) for t in range(16)]).alias("x"))
    table = series.cells_ingest(raw)
    steps = spectral.z_normalize(table, "series", "z")
    steps = spectral.dft_frequencies(spectral.dft(steps, "z", "dft"), "series", "time_step", "freq")
    steps = spectral.periodogram(steps, "dft", "series", "power")
    grid = spectral.grid_values(steps, "freq")
    assert len(grid) == 7
    steps = spectral.log_scale(spectral.linear_interpolation(steps, "freq", "power", grid, "v"), "v", "v")
    steps = spectral.column_scale(steps, "v", "feat", len(grid)).select(
        F.element_at("decorators", "row_id").cast("bigint").alias("row_id"), F.col("feat").alias("stepwise"))
    both = spectral.spectral_features(table).join(steps, "row_id").collect()
    assert len(both) == 12
    for row in both:
        assert np.allclose(row.feat, row.stepwise)


def test_flat_series_become_zeros(spark):
    df = spark.createDataFrame([([2.0, 2.0, 2.0],)], "x array<double>")
    assert spectral.z_normalize(df, "x", "z").first().z == [0.0, 0.0, 0.0]


def test_missing_cells_are_filled(spark):
    events = spark.createDataFrame([(1, 0, 1, 2.0), (1, 0, 1, 3.0), (2, 1, 3, 4.0)],
                                   "r bigint, c bigint, b int, v double")
    cells = series.series_build(events, "r", "c", F.col("b"), "v", 3)
    filled = {(r.row_id, r.col_id): r.x for r in series.fill_missing_cells(cells, 2, 3).collect()}
    assert filled == {(1, 0): [5.0, 0.0, 0.0], (1, 1): [0.0] * 3, (2, 0): [0.0] * 3, (2, 1): [0.0, 0.0, 4.0]}


def test_packs_are_bounded(spark):
    cells = spark.range(100).select(
        F.lit(0).cast("bigint").alias("row_id"), F.col("id").alias("col_id"), F.array(F.lit(1.0)).alias("feat"))
    packs = shape.row_pack(cells, width=30)
    assert sorted(packs.select(F.size("col_ids")).toPandas().iloc[:, 0]) == [10, 30, 30, 30]


def test_rand_index_of_equal_and_trivial_partitions(spark):
    pairs = spark.range(20).select((F.col("id") % 3).alias("a"), (F.col("id") % 3 + 5).alias("b"), F.lit(1).alias("c"))
    assert adjusted_rand_index(pairs, "a", "b").first().ari == 1.0
    assert adjusted_rand_index(pairs, "a", "c").first().ari == 0.0
    assert adjusted_rand_index(pairs, "c", "c").first().ari is None


def test_partitions_of_different_items_are_not_equal(spark):
    a = spark.createDataFrame([Row(i=1, k=0), Row(i=2, k=1)])
    assert partitions_equal(a, a, ["i"], "k").first().equal == 1
    assert partitions_equal(a, a.filter("i = 1"), ["i"], "k").first().equal == 0


def test_sinks_write_files(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.5)], "id bigint, score double")
    sinks.write_csv(df, str(tmp_path / "m"))
    sinks.write_csv(df, str(tmp_path / "m"), append=True)
    assert spark.read.csv(str(tmp_path / "m"), header=True).count() == 2
    sinks.score_append(df, str(tmp_path / "s"))
    sinks.score_append(df, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == 2


def test_run_together_keeps_the_order(spark):
    assert run_together([lambda i=i: spark.range(i).count() for i in range(6)], 3) == list(range(6))
