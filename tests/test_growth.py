"""Plans and results that let a query grow no faster than its input."""

from __future__ import annotations

from conftest import SF_DIR
from pyspark.sql import functions as F

from cellweave import runtime
from cellweave.plans import shape_queries
from cellweave.sources import series


def plan_of(df, capsys) -> str:
    capsys.readouterr()
    df.explain()
    return capsys.readouterr().out


def test_log_scale_makes_each_vector_once(spark, capsys):
    plan = plan_of(shape_queries.log_scale(spark, SF_DIR), capsys)
    assert plan.count("ArrowEvalPython") == 1
    assert plan.count("filter(freq") == 1  # the place of a frequency, not one for each use of it


def test_positions_keep_null_entries_and_leave_out_empty_vectors(spark):
    rows = [(1, 2, [0.5, None]), (1, 3, []), (1, 4, None)]
    df = spark.createDataFrame(rows, "row_id long, col_id long, v array<double>")
    found = sorted(map(tuple, shape_queries.positions(df, "v", "pos", "x").collect()))
    assert found == [(1, 2, 0, 0.5), (1, 2, 1, None)]


def test_series_are_added_up_where_their_row_is(spark, capsys):
    plan = plan_of(shape_queries.series_build(spark, SF_DIR), capsys)
    assert "partial_sum" not in plan.split("Exchange hashpartitioning(row_id", 1)[1]  # below the exchange
    assert plan.count("Exchange hashpartitioning(row_id") == 1


def test_partitions_of_series_follow_the_number_of_records(spark, monkeypatch):
    monkeypatch.setattr(runtime, "PARTITION_BYTES", 64)
    events = spark.createDataFrame([(r, 0, 1, 1.0) for r in range(40)], "r long, c long, b int, v double")
    built = series.series_build(events, "r", "c", F.col("b"), "v", 1, n_records=40)
    assert built.rdd.getNumPartitions() == max(40, spark.sparkContext.defaultParallelism)
    assert sorted((r.row_id, r.x) for r in built.collect()) == [(r, [1.0]) for r in range(40)]
