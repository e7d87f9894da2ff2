"""Sources, shaping, sinks and the spectral chain."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.functions.draws import uniform
from cellweave.operators import fit, partitions, shape, spectral
from cellweave.operators.matrix import matrix_shape
from cellweave.operators.pca import pca_threshold, pooled_pca_loadings, project_loadings
from cellweave.plans import sql, tables
from cellweave.plans.catalogue import big, embedding_matrix, entry_of, pairs_matrix, query, r6
from cellweave.plans.model_queries import BURN_IN, CLBM, ITERATIONS, ROTATION, balanced, estimated_model
from cellweave.plans.sql import Chain
from cellweave.runtime import checkpoint, ensure_checkpoint_dir
from cellweave.sources import series, sinks

# An arbitrary projection of the eight embedding features to two.
PROJECTION = np.array([
    [0.5, -0.25, 0.125, 1.0, 0.0, -1.0, 0.75, 2.0],
    [1.5, 0.5, -0.5, 0.25, 3.0, 0.0, -0.125, 1.0],
])
SAMPLE = 50


@query("cells_ingest", sql.events_chain().select(
    "SELECT row_id::BIGINT AS row_id, col_id::BIGINT AS col_id, 1.0::DOUBLE AS time_from, n::DOUBLE AS time_to, "
    f"1.0::DOUBLE AS time_step, (t - 1)::BIGINT AS i, {sql.r6('x')} AS x FROM ev, ev_n"))
def cells_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = tables.events_series(spark, sf_dir)
    return table.select(
        F.element_at("decorators", "row_id").cast("bigint").alias("row_id"),
        F.element_at("decorators", "col_id").cast("bigint").alias("col_id"),
        "time_from", "time_to", "time_step", F.posexplode("series").alias("i", "x"),
    ).withColumn("i", big("i")).withColumn("x", r6("x"))


@query("series_build", sql.supplier_chain().select(
    "SELECT row_id::BIGINT AS row_id, col_id::BIGINT AS col_id, t::DOUBLE AS t, x::DOUBLE AS x FROM sb"))
def series_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = tables.supplier_brand_raw(spark, sf_dir)
    points = raw.select("row_id", "col_id", F.explode(F.arrays_zip("t", "x")).alias("point"))
    return points.select("row_id", "col_id", "point.t", "point.x")


@query("decorator_lookup", sql.events_chain().select(
    "SELECT row_id::VARCHAR AS row_name, col_id::VARCHAR AS col_name, NULL::VARCHAR AS absent, "
    f"count(*)::BIGINT AS points, {sql.r6('sum(x)')} AS total FROM ev GROUP BY row_id, col_id"))
def decorator_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = tables.events_series(spark, sf_dir)
    named = series.decorator_lookup(table, "row_id", "row_name")
    named = series.decorator_lookup(named, "col_id", "col_name")
    named = series.decorator_lookup(named, "unknown", "absent")
    total = F.aggregate("series", F.lit(0.0), lambda a, x: a + x)
    return named.select("row_name", "col_name", "absent", big(F.size("series")).alias("points"),
                        r6(total).alias("total"))


@query("row_pack", sql.pairs_chain().select(
    "SELECT row_id::BIGINT AS row_id, 0::BIGINT AS pack, (row_number() OVER (PARTITION BY row_id ORDER BY col_id) - 1)::BIGINT AS place, "
    f"col_id::BIGINT AS col_id, {sql.r6('f0')} AS f0, {sql.r6('f1')} AS f1 FROM cell"))
def row_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    packs = shape.row_pack(tables.events_pairs(spark, sf_dir))
    entries = packs.select("row_id", "pack", F.posexplode(F.arrays_zip("col_ids", "feats")).alias("place", "e"))
    return entries.select("row_id", "pack", big("place").alias("place"), F.col("e.col_ids").alias("col_id"),
                          r6(F.col("e.feats")[0]).alias("f0"), r6(F.col("e.feats")[1]).alias("f1"))


@query("col_pack", sql.embedding_chain().select(
    "SELECT col_id::BIGINT AS col_id, ((dense_rank() OVER (ORDER BY row_id) - 1) // 128)::BIGINT AS pack, "
    "((dense_rank() OVER (ORDER BY row_id) - 1) % 128)::BIGINT AS place, row_id::BIGINT AS row_id, "
    f"{sql.r6('sum(x)')} AS total FROM em GROUP BY row_id, col_id"))
def col_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    packs = shape.col_pack(tables.embedding_cells(spark, sf_dir), width=128)
    entries = packs.select("col_id", "pack", F.posexplode(F.arrays_zip("row_ids", "feats")).alias("place", "e"))
    total = F.aggregate(F.col("e.feats"), F.lit(0.0), lambda a, x: a + x)
    return entries.select("col_id", "pack", big("place").alias("place"), F.col("e.row_ids").alias("row_id"),
                          r6(total).alias("total"))


def labels_chain(chain: Chain, clusters=(3, 2), seed: int = 0) -> Chain:
    sql.add_col_labels(chain, "cp", len(clusters), seed)
    return sql.add_row_labels(chain, "rp", clusters, seed)


@query("block_filter", sql.add_labelled(labels_chain(sql.pairs_chain()), "lab", "rp", "cp", False).select(
    "SELECT l::BIGINT AS l, k::BIGINT AS k, count(*)::BIGINT AS size FROM lab GROUP BY l, k"))
def block_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = balanced(spark, sf_dir, (3, 2))
    sizes = shape.block_filter(labels.matrix.cells, labels.row_part, labels.col_part)
    return sizes.select(big("l").alias("l"), big("k").alias("k"), "size")


@query("column_slice", labels_chain(sql.pairs_chain()).select(
    f"SELECT row_id::BIGINT AS row_id, col_id::BIGINT AS col_id, {sql.r6('f0')} AS f0, {sql.r6('f1')} AS f1 "
    "FROM cell SEMI JOIN (SELECT col_id FROM cp WHERE l = 1) USING (col_id)"))
def column_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = balanced(spark, sf_dir, (3, 2))
    kept = shape.column_slice(labels.matrix.cells, labels.col_part, 1)
    return kept.select("row_id", "col_id", r6(entry_of("feat", 0)).alias("f0"), r6(entry_of("feat", 1)).alias("f1"))


@query("attach_row_partition", labels_chain(sql.pairs_chain()).select(
    "SELECT row_id::BIGINT AS row_id, col_id::BIGINT AS col_id, l::BIGINT AS l, k::BIGINT AS k, "
    f"{sql.r6('f0')} AS f0 FROM cell JOIN rp USING (row_id)"))
def attach_row_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = balanced(spark, sf_dir, (3, 2))
    joined = shape.attach_row_partition(labels.matrix.cells, labels.row_part)
    listed = joined.select("row_id", "col_id", F.explode("z").alias("l", "k"), "feat")
    return listed.select("row_id", "col_id", big("l").alias("l"), big("k").alias("k"), r6(entry_of("feat", 0)).alias("f0"))


@query("id_dictionary", "SELECT p_brand AS name, (dense_rank() OVER (ORDER BY p_brand) - 1)::BIGINT AS id "
       "FROM (SELECT DISTINCT p_brand FROM part)")
def id_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    names, _ = tables.dictionary(tables.read(spark, sf_dir, "part"), "p_brand", "id")
    return names.select(F.col("p_brand").alias("name"), "id")


@query("sample_cells", sql.pairs_chain()
       .add("pick", f"SELECT row_id FROM (SELECT DISTINCT row_id FROM cell) ORDER BY {sql.uniform_sql(sql.text('q'), 'row_id', sql.text(0))}, row_id LIMIT {SAMPLE}")
       .select("SELECT row_id::BIGINT AS row_id, col_id::BIGINT AS col_id, " + f"{sql.r6('f0')} AS f0 FROM ("
               f"SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY {sql.uniform_sql(sql.text('s'), 'row_id', 'col_id', sql.text(0))}, col_id) AS rn "
               "FROM cell SEMI JOIN pick USING (row_id)) WHERE rn = 1"))
def sample_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = pairs_matrix(spark, sf_dir).cells
    sampled = shape.sample_cells(cells, SAMPLE, uniform("q", F.col("row_id"), 0), 0)
    return sampled.select("row_id", "col_id", r6(entry_of("feat", 0)).alias("f0"))


@query("matrix_shape", sql.supplier_chain().select(
    "SELECT count(DISTINCT row_id)::BIGINT AS n_rows, count(DISTINCT col_id)::BIGINT AS n_cols, (count(*) // any_value(n))::BIGINT AS n_cells, "
    "(count(*) // any_value(n) = count(DISTINCT row_id) * count(DISTINCT col_id))::BIGINT AS complete FROM sb, sb_n"))
def shape_of_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = matrix_shape(tables.supplier_brand_raw(spark, sf_dir))
    return found.select("n_rows", "n_cols", "n_cells", big("complete").alias("complete"))


def clbm_model_chain(clusters=(3, 2), seed: int = 0) -> Chain:
    chain = labels_chain(sql.pairs_chain(), clusters, seed)
    sql.add_labelled(chain, "lab", "rp", "cp", False)
    return sql.add_model(chain, "mod", "lab", False)


@query("model_table", clbm_model_chain().select(
    "SELECT (row_number() OVER (ORDER BY l, k))::BIGINT AS id, k::BIGINT AS row_cluster, l::BIGINT AS col_cluster, "
    f"{sql.r6('row_prop')} AS row_proportion, {sql.r6('col_prop')} AS col_proportion, {sql.r6('m0')} AS mean0, {sql.r6('m1')} AS mean1, "
    f"{sql.r6('c00')} AS cov0, {sql.r6('c01')} AS cov1, {sql.r6('c01')} AS cov2, {sql.r6('c11')} AS cov3 FROM mod"))
def model_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = sinks.model_table(estimated_model(spark, sf_dir, (3, 2), False).to_frame(spark))

    def part(column: str, i: int):
        return r6(F.element_at(F.split(column, ":"), i + 1).cast("double"))

    return lines.select(
        big("id").alias("id"), big("rowCluster").alias("row_cluster"), big("colCluster").alias("col_cluster"),
        r6("rowProportion").alias("row_proportion"), r6("colProportion").alias("col_proportion"),
        *[part("mean", i).alias(f"mean{i}") for i in range(2)], *[part("cov", i).alias(f"cov{i}") for i in range(4)],
    )


def supplier_labels(chain: Chain) -> Chain:
    chain.add("cell", "SELECT DISTINCT row_id, col_id FROM sb")
    return labels_chain(chain, (2, 2, 3), 4)


@query("labelled_cells", supplier_labels(sql.supplier_chain()).select(
    "SELECT row_id::VARCHAR AS row_name, p_brand AS col_name, k::BIGINT AS row_cluster, l::BIGINT AS col_cluster, "
    "string_agg(x::VARCHAR, ':' ORDER BY t) AS x FROM sb JOIN cp USING (col_id) JOIN rp USING (row_id, l) "
    "JOIN sb_names USING (col_id) GROUP BY ALL"))
def labelled_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = checkpoint(tables.supplier_brand_raw(spark, sf_dir).select("row_id", "col_id", "x"))
    found = matrix_shape(raw).first()
    rows, cols = raw.select("row_id").distinct(), raw.select("col_id").distinct()
    row_part = partitions.balanced_row_partition(rows, (2, 2, 3), 4, found.n_rows)
    col_part = partitions.balanced_col_partition(cols, 3, 4, found.n_cols)
    names, _ = tables.dictionary(tables.read(spark, sf_dir, "part"), "p_brand", "col_id")
    row_names = rows.select("row_id", F.col("row_id").cast("string").alias("row_name"))
    lines = sinks.labelled_cells(
        raw, row_part, col_part, row_names, names.withColumnRenamed("p_brand", "col_name"), ["x"])
    return lines.select("row_name", "col_name", big("row_cluster").alias("row_cluster"),
                        big("col_cluster").alias("col_cluster"), "x")


def add_ari(chain: Chain, name: str, a: str, b: str, source: str) -> Chain:
    chain.add(f"{name}_t", f"SELECT {a} AS a, {b} AS b, count(*)::DOUBLE AS n FROM {source} GROUP BY {a}, {b}")
    chain.add(f"{name}_s", f"SELECT (SELECT sum(n * (n - 1) / 2) FROM {name}_t) AS both_in, "
              f"(SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM {name}_t GROUP BY a)) AS in_a, "
              f"(SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM {name}_t GROUP BY b)) AS in_b, "
              f"(SELECT sum(n) * (sum(n) - 1) / 2 FROM {name}_t) AS all_in")
    return chain.add(name, f"SELECT (both_in - in_a * in_b / all_in) / ((in_a + in_b) / 2 - in_a * in_b / all_in) AS ari FROM {name}_s")


def two_labellings() -> Chain:
    """Row labels of two seeds side by side, and the column labels of two seeds."""
    chain = labels_chain(sql.pairs_chain())
    sql.add_col_labels(chain, "cp2", 2, 1)
    sql.add_row_labels(chain, "rp2", (3, 2), 1)
    chain.add("rows2", "SELECT row_id, list(a.k ORDER BY l) AS a, list(b.k ORDER BY l) AS b "
              "FROM rp a JOIN rp2 b USING (row_id, l) GROUP BY row_id")
    chain.add("cols2", "SELECT a.col_id, a.l AS a, b.l AS b FROM cp a JOIN cp2 b USING (col_id)")
    add_ari(chain, "row_ari", "a", "b", "rows2")
    return add_ari(chain, "col_ari", "a", "b", "cols2")


def scored_fit() -> str:
    """Scores of a fit against known labels: the line of a results table."""
    chain = labels_chain(sql.pairs_chain(), CLBM, 1)
    sql.add_col_labels(chain, "cq", len(CLBM), 0)
    sql.add_row_labels(chain, "rq", CLBM, 0)
    sql.add_labelled(chain, "lab_s", "rq", "cq", False)
    sql.add_model(chain, "mod_s", "lab_s", False)
    names, rows, cols = sql.add_fit(chain, "f", "mod_s", "cq", False, ITERATIONS, 0)
    chain.add("rows2", f"SELECT row_id, list(a.k ORDER BY l) AS a, list(b.k ORDER BY l) AS b "
              f"FROM {rows} a JOIN rp b USING (row_id, l) GROUP BY row_id")
    chain.add("cols2", f"SELECT a.l AS a, b.l AS b FROM {cols} a JOIN cp b USING (col_id)")
    sql.add_labelled(chain, "lab_f", rows, cols, False)
    sql.add_labelled(chain, "lab_t", "rp", "cp", False)
    chain.add("cells2", "SELECT a.l * 100 + a.k AS a, b.l * 100 + b.k AS b FROM lab_f a JOIN lab_t b USING (row_id, col_id)")
    for what, source in (("row", "rows2"), ("col", "cols2"), ("block", "cells2")):
        add_ari(chain, f"{what}_ari", "a", "b", source)
    aris = ", ".join(f"(SELECT {sql.r6('ari')} FROM {what}_ari) AS {what}_ari" for what in ("row", "col", "block"))
    sizes = "(SELECT count(DISTINCT row_id)::DOUBLE AS n, count(DISTINCT col_id)::DOUBLE AS p FROM cell)"
    total, count = sum(CLBM), len(CLBM)
    penalty = f"(ln(n) * ({total} - {count}) / 2 + ln(p) * ({count} - 1) / 2 + ln(n * p) * {total * count} * 5.0 / 2)"
    return chain.select(f"SELECT 1::BIGINT AS run, {aris}, {sql.r6('loglik')} AS loglik, {sql.r6(f'loglik - {penalty}')} AS icl FROM {names[-1]}, {sizes}",
                        inline=[f"df_{i}" for i in range(ITERATIONS + 1)])


@query("score_append", scored_fit())
def score_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    return score_line(spark, sf_dir, f"{spark.sparkContext.getCheckpointDir()}/scores-{uuid.uuid4().hex}")


def score_line(spark: SparkSession, sf_dir: str, path: str) -> DataFrame:
    """Fit, score against the known labels and append the line to the table at ``path``."""
    truth = balanced(spark, sf_dir, CLBM, 1)
    found = fit.fit(truth.matrix, fit.clbm_settings(CLBM, iterations=ITERATIONS - BURN_IN, burn_in=BURN_IN, **ROTATION))
    scores = partitions.partition_scores(
        truth.matrix.cells, (found.row_part(), found.col_part), (truth.row_part, truth.col_part))
    aris = [F.max(F.when(F.col("what") == what, F.col("ari"))).alias(name)
            for what, name in (("rows", "row_ari"), ("columns", "col_ari"), ("blocks", "block_ari"))]
    sinks.score_append(scores.agg(*aris).select(
        F.lit(1).cast("bigint").alias("run"), "*", F.lit(found.loglik).alias("loglik"), F.lit(float(found.icl)).alias("icl")), path)
    return spark.read.parquet(path).select(
        "run", *[r6(c).alias(c) for c in ("row_ari", "col_ari", "block_ari", "loglik", "icl")])


@query("matrix_sink", sql.pairs_chain().select(
    "SELECT (row_number() OVER (ORDER BY row_id))::BIGINT AS id, " + ", ".join(
        f'''{sql.r6(f"max(CASE WHEN col_id = {j} THEN f0 END)")} AS "{j}"''' for j in range(5))
    + " FROM cell GROUP BY row_id"))
def matrix_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    matrix = pairs_matrix(spark, sf_dir)
    values = matrix.cells.select("row_id", "col_id", entry_of("feat", 0).alias("value"))
    wide = sinks.matrix_sink(values, "value", matrix.n_rows, matrix.n_cols)
    return wide.select(big("id").alias("id"), *[r6(F.col(f"`{j}`")).alias(str(j)) for j in range(matrix.n_cols)])


# -- spectral chain ---------------------------------------------------------------------


def event_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.events_series(spark, sf_dir).select(
        F.element_at("decorators", "row_id").cast("bigint").alias("row_id"),
        F.element_at("decorators", "col_id").cast("bigint").alias("col_id"), "time_step", "series",
    )


def positions(df: DataFrame, vector: str, place: str, value: str) -> DataFrame:
    """The entries of a vector, one by one. ``posexplode`` would have the optimizer ask for vectors
    that are not empty before they are made, and so make each of them twice; empty ones are left
    out afterwards instead."""
    exploded = df.select("row_id", "col_id", F.posexplode_outer(vector).alias(place, value)).where(F.col(place).isNotNull())
    return exploded.select("row_id", "col_id", big(place).alias(place), r6(value).alias(value))


KEYS = "row_id::BIGINT AS row_id, col_id::BIGINT AS col_id"


@query("z_normalize", sql.spectral_chain().select(f"SELECT {KEYS}, i::BIGINT AS i, {sql.r6('z')} AS z FROM zn"))
def z_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return positions(spectral.z_normalize(event_table(spark, sf_dir), "series", "z"), "z", "i", "z")


def transformed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spectral.dft(spectral.z_normalize(event_table(spark, sf_dir), "series", "z"), "z", "dft")


@query("dft", sql.spectral_chain().select(
    f"SELECT {KEYS}, k::BIGINT AS k, {sql.r6('re')} AS re, {sql.r6('im')} AS im FROM ft"))
def dft(spark: SparkSession, sf_dir: str) -> DataFrame:
    bins = transformed(spark, sf_dir).select(
        "row_id", "col_id", F.posexplode(F.arrays_zip("dft.re", "dft.im")).alias("k", "bin"))
    return bins.select("row_id", "col_id", big("k").alias("k"), r6("bin.re").alias("re"), r6("bin.im").alias("im"))


def with_frequencies(df: DataFrame) -> DataFrame:
    return spectral.dft_frequencies(df, "series", "time_step", "freq")


@query("dft_frequencies", sql.spectral_chain().select(
    f"SELECT {KEYS}, k::BIGINT AS k, {sql.r6('freq')} AS freq FROM fr"))
def dft_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return positions(with_frequencies(event_table(spark, sf_dir)), "freq", "k", "freq")


def powers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_frequencies(spectral.periodogram(transformed(spark, sf_dir), "dft", "series", "power"))


@query("periodogram", sql.spectral_chain().select(
    f"SELECT {KEYS}, k::BIGINT AS k, {sql.r6('power')} AS power FROM pg"))
def periodogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return positions(powers(spark, sf_dir), "power", "k", "power")


@query("mean_frequency_step", sql.spectral_chain().select(f"SELECT {sql.r6('mean_step')} AS mean_step FROM step"))
def mean_frequency_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spectral.mean_frequency_step(with_frequencies(event_table(spark, sf_dir)), "freq")
    return found.select(r6("mean_step").alias("mean_step"))


@query("frequency_grid", sql.spectral_chain().select(
    f"SELECT i::BIGINT AS i, {sql.r6('frequency')} AS frequency FROM grid"))
def frequency_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = spectral.frequency_grid(with_frequencies(event_table(spark, sf_dir)), "freq")
    return grid.select(big("i").alias("i"), r6("frequency").alias("frequency"))


def resampled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    powered = powers(spark, sf_dir)
    grid = spectral.grid_values(with_frequencies(event_table(spark, sf_dir)), "freq")
    return spectral.linear_interpolation(powered, "freq", "power", grid, "v"), len(grid)


@query("linear_interpolation", sql.spectral_chain().select(
    f"SELECT {KEYS}, pos::BIGINT AS pos, {sql.r6('v')} AS v FROM ip"))
def linear_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return positions(resampled(spark, sf_dir)[0], "v", "pos", "v")


@query("log_scale", sql.spectral_chain().select(f"SELECT {KEYS}, pos::BIGINT AS pos, {sql.r6('v')} AS v FROM lg"))
def log_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return positions(spectral.log_scale(resampled(spark, sf_dir)[0], "v", "v"), "v", "pos", "v")


@query("column_scale", sql.spectral_chain().select(f"SELECT {KEYS}, pos::BIGINT AS pos, {sql.r6('v')} AS v FROM cs"))
def column_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    values, width = resampled(spark, sf_dir)
    logged = spectral.log_scale(values, "v", "v")
    return positions(spectral.column_scale(logged, "v", "v", width), "v", "pos", "v")


@query("spectral_features", sql.spectral_chain().select(f"SELECT {KEYS}, pos::BIGINT AS pos, {sql.r6('v')} AS v FROM cs"))
def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return positions(spectral.spectral_features(tables.events_series(spark, sf_dir)), "feat", "pos", "v")


# -- principal components ---------------------------------------------------------------


@query("pca_threshold", sql.add_pooled_axes(sql.pairs_chain()).select(
    f"SELECT {KEYS}, i::BIGINT AS i, {sql.r6('f0 * w0 + f1 * w1')} AS score FROM cell, "
    "(SELECT * FROM axes WHERE i = 0 OR (SELECT share FROM axes WHERE i = 0) < 0.99)"))
def pca_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    matrix = pairs_matrix(spark, sf_dir)
    return positions(pca_threshold(matrix.cells, "feat", "scores", 2)[0], "scores", "i", "score")


@query("pooled_pca_loadings", sql.add_pooled_axes(sql.pairs_chain())
       .add("sc", "SELECT row_id, col_id, i, f0 * w0 + f1 * w1 AS score FROM cell, "
            "(SELECT * FROM axes WHERE i = 0 OR (SELECT share FROM axes WHERE i = 0) < 0.99)")
       .select(f"SELECT {KEYS}, i::BIGINT AS i, {sql.r6('(score - avg(score) OVER (PARTITION BY i)) / stddev_samp(score) OVER (PARTITION BY i)')} AS score FROM sc"))
def pooled_pca(spark: SparkSession, sf_dir: str) -> DataFrame:
    matrix = pairs_matrix(spark, sf_dir)
    return positions(pooled_pca_loadings(matrix.cells, "feat", "scores", 2)[0], "scores", "i", "score")


@query("project_loadings", sql.embedding_chain()
       .add("w", "SELECT * FROM (VALUES " + ", ".join(
           f"({i}, {j}, {w}::DOUBLE)" for (i, j), w in np.ndenumerate(PROJECTION)) + ") v(i, pos, w)")
       .select(f"SELECT {KEYS}, i::BIGINT AS i, {sql.r6('sum(w * x)')} AS score FROM em JOIN w USING (pos) GROUP BY row_id, col_id, i"))
def projected(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = embedding_matrix(spark, sf_dir).cells
    return positions(project_loadings(cells, "feat", "scores", PROJECTION), "scores", "i", "score")
