"""Steps, fits and starts of the two block models."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.operators import blocks, fit, model, partitions, starts
from cellweave.operators.matrix import CellMatrix, long_row_part, wide_row_part
from cellweave.operators.model import BlockModel
from cellweave.plans import sql
from cellweave.plans.catalogue import big, pairs_matrix, query, r6
from cellweave.plans.sql import Chain

CLBM = (3, 2)
LBM = (3, 3)
# Iterations of the fits that are written out in SQL; the models after burn-in are averaged.
ITERATIONS, BURN_IN = 4, 2
# With both components kept the projection is a rotation, which leaves densities unchanged.
ROTATION = {"threshold": 1.0}


@dataclass(frozen=True)
class Labelled:
    matrix: CellMatrix
    row_part: DataFrame
    col_part: DataFrame
    row_labels: DataFrame


def labelled(matrix: CellMatrix, clusters: Sequence[int], seed: int = 0, shared: bool = False) -> Labelled:
    """Balanced labels; a shared row partition is the one of the first column cluster."""
    row_part = partitions.balanced_row_partition(
        matrix.rows(), clusters[:1] if shared else clusters, seed, matrix.n_rows)
    col_part = partitions.balanced_col_partition(matrix.columns(), len(clusters), seed, matrix.n_cols)
    groups = 1 if shared else len(clusters)
    return Labelled(matrix, row_part, col_part, wide_row_part(row_part, groups))


def balanced(spark: SparkSession, sf_dir: str, clusters: Sequence[int], seed: int = 0, shared: bool = False) -> Labelled:
    return labelled(pairs_matrix(spark, sf_dir), clusters, seed, shared)


def estimated(labels: Labelled, clusters: Sequence[int], shared: bool, divisor: str = "n") -> BlockModel:
    return blocks.m_step(labels.matrix, labels.row_labels, labels.col_part, clusters, shared,
                         np.eye(labels.matrix.dim), center_divisor=divisor)[0]


def estimated_model(spark: SparkSession, sf_dir: str, clusters: Sequence[int], shared: bool) -> BlockModel:
    return estimated(balanced(spark, sf_dir, clusters, 0, shared), clusters, shared)


def chain_of(clusters: Sequence[int], shared: bool, seed: int = 0, tag: str = "", chain: Chain | None = None) -> Chain:
    """Balanced labels ``rp``/``cp``, their blocks ``mod`` and all densities ``ll``."""
    chain = chain or sql.pairs_chain()
    sql.add_col_labels(chain, f"cp{tag}", len(clusters), seed)
    sql.add_row_labels(chain, f"rp{tag}", clusters[:1] if shared else clusters, seed)
    sql.add_labelled(chain, f"lab{tag}", f"rp{tag}", f"cp{tag}", shared)
    sql.add_model(chain, f"mod{tag}", f"lab{tag}", shared)
    return sql.add_densities(chain, f"ll{tag}", f"mod{tag}")


MODEL_COLUMNS = "l::BIGINT AS l, k::BIGINT AS k, " + ", ".join(
    f"{sql.r6(c)} AS {c}" for c in ("m0", "m1", "c00", "c01", "c11", "row_prop", "col_prop"))


def model_columns(frame: DataFrame) -> DataFrame:
    mean, cov = F.col("mean"), F.col("cov")
    return frame.select(
        big("l").alias("l"), big("k").alias("k"), r6(mean[0]).alias("m0"), r6(mean[1]).alias("m1"),
        r6(cov[0][0]).alias("c00"), r6(cov[0][1]).alias("c01"), r6(cov[1][1]).alias("c11"),
        r6("row_prop").alias("row_prop"), r6("col_prop").alias("col_prop"),
    )


def rotated_back(found: BlockModel) -> BlockModel:
    """A model of rotated features in terms of the features themselves."""
    def each(values, turn: Callable) -> list:
        return [[turn(v, w) for v, w in zip(row, ws)] for row, ws in zip(values, found.loadings)]

    return BlockModel(found.row_props, found.col_props, each(found.means, lambda m, w: w.T @ m),
                      each(found.covs, lambda c, w: w.T @ c @ w), found.loadings, found.sizes)


# -- steps, registered for both models --------------------------------------------------


def register_steps(prefix: str, clusters: Sequence[int], shared: bool) -> None:
    chain = lambda: chain_of(clusters, shared)
    long_keys = "row_id::BIGINT AS row_id, l::BIGINT AS l, k::BIGINT AS k"

    @query(f"{prefix}_row_scores", sql.add_row_scores(chain(), "rs", "ll", "cp", shared).select(
        f"SELECT {long_keys}, {sql.r6('score')} AS score FROM rs"))
    def row_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
        labels = balanced(spark, sf_dir, clusters, 0, shared)
        scores = blocks.row_scores(labels.matrix, labels.col_part, estimated(labels, clusters, shared), shared)
        return scores.select("row_id", big("l").alias("l"), big("k").alias("k"), r6("score").alias("score"))

    @query(f"{prefix}_draw_rows", sql.add_row_draw(
        sql.add_row_scores(chain(), "rs", "ll", "cp", shared), "dr", "rs", 1, 1, 0).select(f"SELECT {long_keys} FROM dr"))
    def draw_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
        labels = balanced(spark, sf_dir, clusters, 0, shared)
        drawn = blocks.draw_rows(
            labels.matrix, labels.col_part, estimated(labels, clusters, shared), shared, 1, 1, 0)
        return long_row_part(drawn).select("row_id", big("l").alias("l"), big("k").alias("k"))

    @query(f"{prefix}_col_scores", sql.add_col_scores(chain(), "cs", "ll", "rp", shared).select(
        f"SELECT col_id::BIGINT AS col_id, l::BIGINT AS l, {sql.r6('score')} AS score FROM cs"))
    def col_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
        labels = balanced(spark, sf_dir, clusters, 0, shared)
        scores = blocks.col_scores(labels.matrix, labels.row_labels, estimated(labels, clusters, shared))
        return scores.select("col_id", big("l").alias("l"), r6("score").alias("score"))

    @query(f"{prefix}_draw_cols", sql.add_col_draw(
        sql.add_col_scores(chain(), "cs", "ll", "rp", shared), "dc", "cs", 1, 1, 0).select(
            "SELECT col_id::BIGINT AS col_id, l::BIGINT AS l FROM dc"))
    def draw_cols(spark: SparkSession, sf_dir: str) -> DataFrame:
        labels = balanced(spark, sf_dir, clusters, 0, shared)
        drawn = blocks.draw_cols(
            labels.matrix, labels.row_labels, estimated(labels, clusters, shared), 1, 1, 0)
        return drawn.select("col_id", big("l").alias("l"))

    swept = chain()
    drawn_rows, drawn_cols = sql.add_sweeps(swept, "s", "ll", "cp", shared, 1, 0)

    @query(f"{prefix}_se_step", swept.select(
        f"SELECT 'row' AS side, row_id::BIGINT AS id, l::BIGINT AS l, k::BIGINT AS label FROM {drawn_rows} UNION ALL "
        f"SELECT 'column', col_id, 0, l FROM {drawn_cols}", inline=["ll"]))
    def se_step(spark: SparkSession, sf_dir: str) -> DataFrame:
        labels = balanced(spark, sf_dir, clusters, 0, shared)
        drawn, columns = blocks.se_step(
            labels.matrix, labels.col_part, estimated(labels, clusters, shared), shared, 1, 0)
        by_row = long_row_part(drawn).select(
            F.lit("row").alias("side"), F.col("row_id").alias("id"), big("l").alias("l"), big("k").alias("label"))
        by_col = columns.select(
            F.lit("column").alias("side"), F.col("col_id").alias("id"), big(F.lit(0)).alias("l"), big("l").alias("label"))
        return by_row.unionByName(by_col)

    @query(f"{prefix}_m_step", chain().select(f"SELECT {MODEL_COLUMNS}, n::BIGINT AS n_cells FROM mod"))
    def m_step(spark: SparkSession, sf_dir: str) -> DataFrame:
        frame = estimated_model(spark, sf_dir, clusters, shared).to_frame(spark)
        sizes = frame.select(big("l").alias("l"), big("k").alias("k"), "n_cells")
        return model_columns(frame).join(sizes, ["l", "k"])

    row_terms = "(SELECT sum(ln(row_prop)) FROM rp JOIN (SELECT DISTINCT k, row_prop FROM mod) USING (k))" if shared \
        else "(SELECT sum(ln(row_prop)) FROM rp JOIN mod USING (l, k))"
    col_terms = "(SELECT sum(ln(col_prop)) FROM cp JOIN (SELECT DISTINCT l, col_prop FROM mod) USING (l))"

    @query(f"{prefix}_loglik", sql.add_likelihood(chain(), "lk", "ll", "rp", "cp", shared).select(
        f"SELECT {sql.r6('loglik')} AS loglik_cells, {sql.r6(f'loglik + {row_terms} + {col_terms}')} AS loglik_complete FROM lk"))
    def loglik(spark: SparkSession, sf_dir: str) -> DataFrame:
        labels = balanced(spark, sf_dir, clusters, 0, shared)
        found = blocks.block_log_likelihood(
            labels.matrix, labels.row_labels, labels.col_part, estimated(labels, clusters, shared), shared)
        return found.select(r6("loglik_cells").alias("loglik_cells"), r6("loglik_complete").alias("loglik_complete"))

    total, count = sum(clusters), len(clusters)
    rows_of = f"ln(n) * ({clusters[0]} - 1) / 2" if shared else f"ln(n) * ({total} - {count}) / 2"
    recorded = clusters[0] * count if shared else total * count
    existing = clusters[0] * count if shared else total
    penalty = lambda b: f"({rows_of} + ln(p) * ({count} - 1) / 2 + ln(n * p) * {b} * 5.0 / 2)"

    @query(f"{prefix}_icl", sql.add_likelihood(chain(), "lk", "ll", "rp", "cp", shared)
           .add("dims", "SELECT count(DISTINCT row_id)::DOUBLE AS n, count(DISTINCT col_id)::DOUBLE AS p FROM cell")
           .select(f"SELECT {sql.r6(f'loglik - {penalty(recorded)}')} AS icl, {sql.r6(f'loglik - {penalty(existing)}')} AS icl_blocks FROM lk, dims"))
    def icl(spark: SparkSession, sf_dir: str) -> DataFrame:
        labels = balanced(spark, sf_dir, clusters, 0, shared)
        found = estimated(labels, clusters, shared)
        likelihood = blocks.block_log_likelihood(labels.matrix, labels.row_labels, labels.col_part, found, shared)
        counted, once = fit.penalties(found, labels.matrix, shared)
        return likelihood.select(r6(F.col("loglik_cells") - float(counted)).alias("icl"),
                                 r6(F.col("loglik_cells") - float(once)).alias("icl_blocks"))

    averaged = sql.pairs_chain()
    for seed in range(4):
        chain_of(clusters, shared, seed, f"_{seed}", averaged)
    late = " UNION ALL ".join(f"SELECT * FROM mod_{seed}" for seed in (2, 3))
    averages = ", ".join(f"avg({c}) AS {c}" for c in ("m0", "m1", "c00", "c01", "c11", "row_prop", "col_prop"))

    @query(f"{prefix}_mean_model", averaged.add("late", late).add(
        "avgs", f"SELECT l, k, {averages} FROM late GROUP BY l, k").select(f"SELECT {MODEL_COLUMNS} FROM avgs"))
    def mean_model(spark: SparkSession, sf_dir: str) -> DataFrame:
        matrix = pairs_matrix(spark, sf_dir)
        records = []
        for seed in range(4):
            found = estimated(labelled(matrix, clusters, seed, shared), clusters, shared)
            records += [(seed, *record) for record in found.records()]
        history = spark.createDataFrame(records, "iter int, " + model.BLOCK_SCHEMA)
        return model_columns(model.mean_model_table(history, 1))

    # -- fits written out in SQL ----------------------------------------------------------

    sampled = sql.pairs_chain()
    sql.add_sampled_model(sampled, "sm", clusters, starts.SAMPLE_ROWS, 0)

    @query(f"{prefix}_init_random", sampled.select(f"SELECT {MODEL_COLUMNS} FROM sm"))
    def init_random(spark: SparkSession, sf_dir: str) -> DataFrame:
        settings = fit.Settings(tuple(clusters), shared=shared, init="random", **ROTATION)
        found, _ = starts.from_component_sample(pairs_matrix(spark, sf_dir), settings, 0)
        return model_columns(rotated_back(found).to_frame(spark))

    def outcome(result: fit.FitResult) -> DataFrame:
        """Likelihoods, labels and proportions of a fit as ``(what, id, l, value)``."""
        def lines(frame: DataFrame, what: str, id_: str, l: Column, value: Column) -> DataFrame:
            return frame.select(F.lit(what).alias("what"), big(id_).alias("id"), big(l).alias("l"), r6(value).alias("value"))

        zero, number = F.lit(0), lambda c: F.col(c).cast("double")
        parts = result.blocks()
        return reduce(DataFrame.unionAll, [
            lines(result.trace(), "loglik", "iter", zero, number("loglik_cells")),
            lines(result.row_part(), "row", "row_id", F.col("l"), number("k")),
            lines(result.col_part, "column", "col_id", zero, number("l")),
            lines(parts, "row_prop", "k", F.col("l"), number("row_prop")),
            lines(parts, "col_prop", "k", F.col("l"), number("col_prop")),
        ])

    def outcome_sql(tag: str, likelihoods: Sequence[str], rows: str, cols: str, condition: str = "true") -> str:
        """The same from the links of ``add_fit``."""
        late = " UNION ALL ".join(f"SELECT * FROM m{tag}_{it}" for it in range(BURN_IN + 1, ITERATIONS + 1))
        traced = [f"SELECT 'loglik' AS what, {i}::BIGINT AS id, 0::BIGINT AS l, {sql.r6('loglik')} AS value FROM {name} WHERE {condition}"
                  for i, name in enumerate(likelihoods)]
        props = [f"SELECT '{p}', k, l, {sql.r6(f'avg({p})')} FROM ({late}) WHERE {condition} GROUP BY l, k" for p in ("row_prop", "col_prop")]
        return " UNION ALL ".join([
            *traced, f"SELECT 'row', row_id, l, k::DOUBLE FROM {rows} WHERE {condition}",
            f"SELECT 'column', col_id, 0, l::DOUBLE FROM {cols} WHERE {condition}", *props])

    def densities_of(*tags: str) -> list[str]:
        return [f"d{tag}_{it}" for tag in tags for it in range(ITERATIONS + 1)]

    def start_chain(chain: Chain, tag: str, seed: int) -> tuple[str, str]:
        """Model and columns of the default start."""
        if shared:
            sql.add_sampled_model(chain, f"sm{tag}", clusters, starts.SAMPLE_ROWS, seed)
            sql.add_cols_from_proportions(chain, f"cq{tag}", len(clusters), seed)
            return f"sm{tag}", f"cq{tag}"
        chain_of(clusters, shared, seed, tag, chain)
        return f"mod{tag}", f"cp{tag}"

    def default_settings(**options) -> fit.Settings:
        init = "random" if shared else "random_partition"
        return fit.Settings(tuple(clusters), **{
            "shared": shared, "init": init, "iterations": ITERATIONS - BURN_IN, "burn_in": BURN_IN, **ROTATION, **options})

    fitted = sql.pairs_chain()
    found = sql.add_fit(fitted, "f", *start_chain(fitted, "_s", 0), shared, ITERATIONS, 0)

    @query(f"{prefix}_fit", fitted.select(outcome_sql("f", *found), densities_of("f")))
    def fit_query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return outcome(fit.fit(pairs_matrix(spark, sf_dir), default_settings()))

    several = sql.pairs_chain()
    ends = []
    for n in range(2):
        seed = n * fit.START_SEED_STEP
        ends.append(sql.add_fit(several, f"g{n}", *start_chain(several, f"_t{n}", seed), shared, ITERATIONS, seed))
    last = ", ".join(f"(SELECT loglik FROM {names[-1]})" for names, _, _ in ends)
    picked = " UNION ALL ".join(
        outcome_sql(f"g{n}", names, rows, cols, f"(SELECT loglik FROM {names[-1]}) = greatest({last})")
        for n, (names, rows, cols) in enumerate(ends))

    @query(f"{prefix}_multi_start", several.select(picked, densities_of("g0", "g1")))
    def multi_start(spark: SparkSession, sf_dir: str) -> DataFrame:
        return outcome(fit.multi_start(pairs_matrix(spark, sf_dir), default_settings(), 2))

    given = chain_of(clusters, shared, 5, "_g")
    if shared:
        # columns are drawn from the model's own proportions
        u = sql.uniform_sql(sql.text("e"), "col_id", sql.text(0), sql.text(0), sql.text(0))
        given.add("props", "SELECT l, any_value(col_prop) AS col_prop FROM mod_g GROUP BY l")
        given.add("runs", "SELECT l, sum(col_prop) OVER (ORDER BY l) AS running, max(l) OVER () AS top FROM props")
        given.add("cq_g", f"SELECT col_id, sum(CASE WHEN running < {u} AND l < top THEN 1 ELSE 0 END)::BIGINT AS l "
                  "FROM (SELECT DISTINCT col_id FROM cell), runs GROUP BY col_id")
    given_fit = sql.add_fit(given, "h", "mod_g", "cq_g" if shared else "cp_g", shared, ITERATIONS, 0)

    @query(f"{prefix}_init_given_model", given.select(outcome_sql("h", *given_fit), densities_of("h")))
    def init_given_model(spark: SparkSession, sf_dir: str) -> DataFrame:
        labels = balanced(spark, sf_dir, clusters, 5, shared)
        table = estimated(labels, clusters, shared).to_frame(spark)
        settings = default_settings(
            init="", model=BlockModel.from_frame(table), col_part=None if shared else labels.col_part)
        return outcome(fit.fit(labels.matrix, settings))


register_steps("lbm", LBM, True)
register_steps("clbm", CLBM, False)


@query("gaussian_logpdf", chain_of(CLBM, False).select(
    "SELECT row_id::BIGINT AS row_id, col_id::BIGINT AS col_id, l::BIGINT AS l, k::BIGINT AS k, "
    f"{sql.r6('ll')} AS ll FROM ll"))
def gaussian_logpdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    matrix = pairs_matrix(spark, sf_dir)
    densities = blocks.cell_log_densities(matrix, estimated_model(spark, sf_dir, CLBM, False))
    return densities.select("row_id", "col_id", big("l").alias("l"), big("k").alias("k"), r6("ll").alias("ll"))


@query("clbm_block_sizes", chain_of(CLBM, False).select(
    "SELECT l::BIGINT AS l, k::BIGINT AS k, n::BIGINT AS size FROM mod UNION ALL SELECT 1, 2, 0"))
def clbm_block_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second column cluster is asked for a row cluster it does not have."""
    labels = balanced(spark, sf_dir, CLBM)
    sizes = blocks.block_sizes(labels.matrix, labels.row_labels, labels.col_part, (3, 3), False)
    return sizes.select(big("l").alias("l"), big("k").alias("k"), "size")


def block_axes_chain() -> Chain:
    """Principal axes of each block in closed form."""
    chain = chain_of(CLBM, False)
    chain.add("e1", "SELECT l, k, c00 AS a, c01 AS b, c11 AS c, (c00 + c11) / 2 + sqrt((c00 - c11) * (c00 - c11) / 4 + c01 * c01) AS big FROM mod")
    chain.add("d1", "SELECT l, k, b / sqrt(b * b + (big - a) * (big - a)) AS x, (big - a) / sqrt(b * b + (big - a) * (big - a)) AS y FROM e1")
    chain.add("s1", "SELECT l, k, 0 AS i, x AS w0, y AS w1 FROM d1 UNION ALL SELECT l, k, 1, -y, x FROM d1")
    chain.add("s2", "SELECT l, k, i, sign(CASE WHEN abs(w0) >= abs(w1) THEN w0 ELSE w1 END) AS s, w0, w1 FROM s1")
    return chain


@query("clbm_block_loadings", block_axes_chain().select(
    f"SELECT l::BIGINT AS l, k::BIGINT AS k, i::BIGINT AS i, 0::BIGINT AS j, {sql.r6('s * w0')} AS loading FROM s2 UNION ALL "
    f"SELECT l, k, i, 1, {sql.r6('s * w1')} FROM s2"))
def clbm_block_loadings(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = balanced(spark, sf_dir, CLBM)
    axes = blocks.block_loadings(labels.matrix, labels.row_labels, labels.col_part, CLBM, False, components=2)
    return axes.select(*[big(c).alias(c) for c in ("l", "k", "i", "j")], r6("loading").alias("loading"))


@query("clbm_block_moments", chain_of(CLBM, False)
       .add("ctr", "SELECT l, k, sum(f0) / (count(*) - 1) AS m0, sum(f1) / (count(*) - 1) AS m1 FROM lab GROUP BY l, k")
       .select(f"SELECT l::BIGINT AS l, k::BIGINT AS k, {sql.r6('any_value(m0)')} AS m0, {sql.r6('any_value(m1)')} AS m1, "
               f"{sql.r6('sum((f0 - m0) * (f0 - m0)) / (count(*) - 1)')} AS c00, {sql.r6('sum((f0 - m0) * (f1 - m1)) / (count(*) - 1)')} AS c01, "
               f"{sql.r6('sum((f1 - m1) * (f1 - m1)) / (count(*) - 1)')} AS c11 FROM lab JOIN ctr USING (l, k) GROUP BY l, k"))
def clbm_block_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = estimated(balanced(spark, sf_dir, CLBM), CLBM, False, "n-1")
    return model_columns(found.to_frame(spark)).drop("row_prop", "col_prop")


@query("clbm_row_proportions", chain_of(CLBM, False).select(
    f"SELECT l::BIGINT AS l, k::BIGINT AS k, {sql.r6('count(*) / (SELECT count(DISTINCT row_id) FROM cell)')} AS row_prop FROM rp GROUP BY l, k"))
def clbm_row_proportions(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = balanced(spark, sf_dir, CLBM)
    props = blocks.row_proportions(labels.row_part, labels.matrix.n_rows)
    return props.select(big("l").alias("l"), big("k").alias("k"), r6("row_prop").alias("row_prop"))


@query("clbm_col_proportions", chain_of(CLBM, False).select(
    f"SELECT l::BIGINT AS l, {sql.r6('count(*) / (SELECT count(*) FROM cp)')} AS col_prop FROM cp GROUP BY l"))
def clbm_col_proportions(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = balanced(spark, sf_dir, CLBM)
    props = blocks.col_proportions(labels.col_part, labels.matrix.n_cols)
    return props.select(big("l").alias("l"), r6("col_prop").alias("col_prop"))


@query("balanced_random_partition", chain_of(CLBM, False).select(
    "SELECT 'row' AS side, row_id::BIGINT AS id, l::BIGINT AS l, k::BIGINT AS label FROM rp UNION ALL "
    "SELECT 'column', col_id, 0, l FROM cp"))
def balanced_random_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = balanced(spark, sf_dir, CLBM)
    by_row = labels.row_part.select(
        F.lit("row").alias("side"), F.col("row_id").alias("id"), big("l").alias("l"), big("k").alias("label"))
    by_col = labels.col_part.select(
        F.lit("column").alias("side"), F.col("col_id").alias("id"), big(F.lit(0)).alias("l"), big("l").alias("label"))
    return by_row.unionByName(by_col)


@query("clbm_init_random_partition", chain_of(CLBM, False, 3).select(f"SELECT {MODEL_COLUMNS} FROM mod"))
def clbm_init_random_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = starts.from_random_partition(
        pairs_matrix(spark, sf_dir), fit.clbm_settings(CLBM, **ROTATION), 3)
    return model_columns(rotated_back(found).to_frame(spark))


@query("clbm_init_given_partition", sql.add_pooled_axes(chain_of(CLBM, False, 6))
       .add("w0", "SELECT w0 AS a, w1 AS b FROM axes WHERE i = 0").add("w1", "SELECT w0 AS c, w1 AS d FROM axes WHERE i = 1")
       .select("SELECT l::BIGINT AS l, k::BIGINT AS k, " + ", ".join(f"{sql.r6(e)} AS {n}" for n, e in (
           ("m0", "a * m0 + b * m1"), ("m1", "c * m0 + d * m1"),
           ("c00", "a * a * c00 + 2 * a * b * c01 + b * b * c11"),
           ("c01", "a * c * c00 + (a * d + b * c) * c01 + b * d * c11"),
           ("c11", "c * c * c00 + 2 * c * d * c01 + d * d * c11"),
           ("row_prop", "row_prop"), ("col_prop", "col_prop"))) + " FROM mod, w0, w1"))
def clbm_init_given_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = balanced(spark, sf_dir, CLBM, 6)
    found, _ = starts.from_given_partition(
        labels.matrix, labels.row_labels, labels.col_part, fit.clbm_settings(CLBM, **ROTATION))
    return model_columns(found.to_frame(spark))
