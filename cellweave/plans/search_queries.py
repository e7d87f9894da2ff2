"""Searches over the numbers of clusters and the starts that need fits of their own, on a matrix
whose columns fall into groups, with the SQL of every fit they make."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.operators import fit, kmeans, selection, starts
from cellweave.operators.model import BlockModel
from cellweave.plans import sql
from cellweave.plans.catalogue import big, measures_matrix, query, r6
from cellweave.plans.model_queries import rotated_back
from cellweave.plans.sql import Chain

# Iterations of the fits that are written out in SQL. A fit is not tried again, so that a candidate
# that loses a cluster is out in both. With both components kept the projection is a rotation,
# which leaves densities unchanged.
ITERATIONS, BURN_IN = 3, 1
SEARCH = {"iterations": ITERATIONS - BURN_IN, "burn_in": BURN_IN, "max_tries": 1, "threshold": 1.0}


def chosen(result: fit.FitResult) -> DataFrame:
    """Scores and labels of the chosen fit as ``(what, id, l, value)``."""
    def lines(frame: DataFrame, what: str, id_: str, l: str, value: str) -> DataFrame:
        return frame.select(F.lit(what).alias("what"), big(id_).alias("id"), big(l).alias("l"), F.col(value).cast("double").alias("value"))

    scores = result.spark.range(1).select(
        F.inline(F.array(*[
            F.struct(F.lit(what).alias("what"), F.lit(0).cast("bigint").alias("id"), F.lit(0).cast("bigint").alias("l"),
                     r6(F.lit(float(value))).alias("value"))
            for what, value in (("loglik", result.loglik), ("icl", result.icl))
        ]))
    )
    columns = result.col_part.withColumn("zero", F.lit(0))
    return reduce(DataFrame.unionAll, [
        scores, lines(result.row_part(), "row", "row_id", "l", "k"), lines(columns, "column", "col_id", "zero", "l")])


class Fits:
    """Fits of a chain, each with its validity, score and labels."""

    def __init__(self) -> None:
        self.chain = sql.measures_chain()
        self.densities: list[str] = []

    def add(self, tag: str, clusters: Sequence[int], shared: bool, seed: int = 0, cells: str = "cell",
            start: tuple[str, str] | None = None, iterations: int = ITERATIONS) -> str:
        """A fit from its default start, or from a given model and columns."""
        chain = self.chain
        if start is None and shared:
            sql.add_sampled_model(chain, f"sm{tag}", clusters, starts.SAMPLE_ROWS, seed, cells)
            sql.add_cols_from_proportions(chain, f"cq{tag}", len(clusters), seed, cells)
            start = f"sm{tag}", f"cq{tag}"
        elif start is None:
            start = self.partition(tag, clusters, seed, cells)
        likelihoods, rows, cols = sql.add_fit(chain, tag, *start, shared, iterations, seed, cells)
        self.densities += [f"d{tag}_{it}" for it in range(iterations + 1)]
        blocks = len(clusters) * clusters[0] if shared else sum(clusters)
        whole = " AND ".join(f"(SELECT count(*) FROM m{tag}_{it} WHERE n >= 2) = {blocks}" for it in range(1, iterations + 1))
        chain.add(f"dim{tag}", f"SELECT count(DISTINCT row_id)::DOUBLE AS n, count(DISTINCT col_id)::DOUBLE AS p FROM {cells}")
        chain.add(f"sc{tag}", f"SELECT loglik, loglik - {penalty(clusters, shared)} AS icl FROM {likelihoods[-1]}, dim{tag} WHERE {whole}")
        chain.add(f"ro{tag}", f"SELECT row_id, l, k FROM {rows}")
        chain.add(f"co{tag}", f"SELECT col_id, l FROM {cols}")
        late = " UNION ALL ".join(f"SELECT * FROM m{tag}_{it}" for it in range(BURN_IN + 1, iterations + 1))
        averages = ", ".join(f"avg({c}) AS {c}" for c in ("m0", "m1", "c00", "c01", "c11", "row_prop", "col_prop"))
        chain.add(f"mo{tag}", f"SELECT l, k, {averages} FROM ({late}) GROUP BY l, k")
        return tag

    def partition(self, tag: str, clusters: Sequence[int], seed: int, cells: str) -> tuple[str, str]:
        chain = self.chain
        sql.add_col_labels(chain, f"cp{tag}", len(clusters), seed, cells)
        sql.add_row_labels(chain, f"rp{tag}", clusters, seed, cells)
        sql.add_labelled(chain, f"lab{tag}", f"rp{tag}", f"cp{tag}", False, cells)
        sql.add_model(chain, f"mod{tag}", f"lab{tag}", False)
        return f"mod{tag}", f"cp{tag}"

    def best(self, name: str, tags: Sequence[str]) -> str:
        """Of several fits the one of the greatest ICL, the first on ties, under one name."""
        chain = self.chain
        scores = " UNION ALL ".join(f"SELECT {i} AS i, loglik, icl FROM sc{tag}" for i, tag in enumerate(tags))
        chain.add(f"pick{name}", f"SELECT * FROM ({scores}) ORDER BY icl DESC, i LIMIT 1")
        chain.add(f"sc{name}", f"SELECT loglik, icl FROM pick{name}")
        for kind in ("ro", "co", "mo"):
            parts = " UNION ALL ".join(f"SELECT * FROM {kind}{tag} WHERE (SELECT i FROM pick{name}) = {i}" for i, tag in enumerate(tags))
            chain.add(f"{kind}{name}", parts)
        return name

    def piece(self, name: str, columns: str, l: int, cells: str = "cell") -> str:
        """The cells of one column cluster."""
        self.chain.add(name, f"SELECT c.* FROM {cells} c SEMI JOIN (SELECT col_id FROM {columns} WHERE l = {l}) USING (col_id)")
        return name

    def select(self, name: str) -> str:
        scores = " UNION ALL ".join(f"SELECT '{what}' AS what, 0::BIGINT AS id, 0::BIGINT AS l, {sql.r6(what)} AS value FROM sc{name}"
                                    for what in ("loglik", "icl"))
        return self.chain.select(
            f"{scores} UNION ALL SELECT 'row', row_id::BIGINT, l::BIGINT, k::DOUBLE FROM ro{name} "
            f"UNION ALL SELECT 'column', col_id::BIGINT, 0, l::DOUBLE FROM co{name}", inline=self.densities)


def penalty(clusters: Sequence[int], shared: bool) -> str:
    """What the ICL of two features takes off, in terms of ``n`` and ``p``."""
    total, count = sum(clusters), len(clusters)
    free = clusters[0] - 1 if shared else total - count
    blocks = clusters[0] * count if shared else total * count
    return f"(ln(n) * {free} / 2.0 + ln(p) * {count - 1} / 2.0 + ln(n * p) * {blocks} * 5.0 / 2)"


# -- grid searches ------------------------------------------------------------------------

GRID_K, GRID_L = [1, 2], [1, 2]


def clbm_grid_sql() -> str:
    fits = Fits()
    candidates = selection.row_cluster_candidates(GRID_K, GRID_L)
    return fits.select(fits.best("best", [fits.add(f"f{i}", c, False) for i, c in enumerate(candidates)]))


@query("clbm_grid_search", clbm_grid_sql())
def clbm_grid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen(selection.clbm_grid_search(measures_matrix(spark, sf_dir), GRID_K, GRID_L, **SEARCH))


def lbm_grid_sql() -> str:
    fits = Fits()
    pairs = [(k, l) for k in GRID_K for l in GRID_L]
    return fits.select(fits.best("best", [fits.add(f"f{i}", (k,) * l, True) for i, (k, l) in enumerate(pairs)]))


@query("lbm_grid_search", lbm_grid_sql())
def lbm_grid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen(selection.lbm_grid_search(measures_matrix(spark, sf_dir), GRID_K, GRID_L, n_starts=1, **SEARCH))


# -- greedy searches ----------------------------------------------------------------------

MAX_K, MAX_L = 2, 3


def lbm_greedy_fits(max_k: int, max_l: int) -> tuple[Fits, str]:
    """All fits within the caps, and the path through them step by step."""
    fits = Fits()
    pairs = [(k, l) for k in range(1, max_k + 1) for l in range(1, max_l + 1)]
    tags = [fits.add(f"f{k}{l}", (k,) * l, True) for k, l in pairs]
    scores = " UNION ALL ".join(f"SELECT {k} AS k, {l} AS l, icl FROM sc{tag}" for (k, l), tag in zip(pairs, tags, strict=True))
    chain = fits.chain.add("scores", scores).add("at_0", "SELECT k, l, icl FROM scores WHERE k = 1 AND l = 1")
    steps = max_k + max_l - 2
    for step in range(1, steps + 1):
        chain.add(f"next_{step}", f"SELECT b.k, b.l, b.icl, a.icl AS before FROM at_{step - 1} a JOIN scores b "
                  "ON (b.k = a.k + 1 AND b.l = a.l) OR (b.k = a.k AND b.l = a.l + 1) ORDER BY b.icl DESC, b.l DESC LIMIT 1")
        chain.add(f"at_{step}", f"SELECT k, l, icl FROM next_{step} WHERE icl > before")
    path = " UNION ALL ".join(f"SELECT k, l, {step} AS step FROM at_{step}" for step in range(steps + 1))
    chain.add("pickbest", f"SELECT CASE {' '.join(f'WHEN k = {k} AND l = {l} THEN {i}' for i, (k, l) in enumerate(pairs))} END AS i "
              f"FROM ({path}) ORDER BY step DESC LIMIT 1")
    union = " UNION ALL ".join(f"SELECT {i} AS i, loglik, icl FROM sc{tag}" for i, tag in enumerate(tags))
    chain.add("scbest", f"SELECT loglik, icl FROM ({union}) SEMI JOIN pickbest USING (i)")
    return fits, fits.best("best", tags)


def lbm_greedy_sql() -> str:
    fits, best = lbm_greedy_fits(MAX_K, MAX_L)
    return fits.select(best)


@query("lbm_greedy_search", lbm_greedy_sql())
def lbm_greedy_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen(selection.lbm_greedy_search(measures_matrix(spark, sf_dir), MAX_K, MAX_L, n_starts=1, **SEARCH))


def clbm_greedy_sql() -> str:
    """Cuts into clusters of one row cluster each, whose rows need no draw: the first cut, then the
    cuts of both halves, the better of which is accepted if it improves."""
    fits = Fits()
    chain = fits.chain
    fits.add("w", (1,), False)

    def cut(tag: str, cells: str) -> str:
        """A fit of two clusters, and the log-likelihood of each under its averaged blocks."""
        fits.add(tag, (1, 1), False, cells=cells)
        sql.add_densities(chain, f"dd{tag}", f"mo{tag}", cells)
        return chain.add(f"li{tag}", f"SELECT l, sum(ll) AS loglik FROM dd{tag} SEMI JOIN co{tag} USING (col_id, l) GROUP BY l") and tag

    cut("a", "cell")
    for l in (0, 1):
        cut(f"b{l}", fits.piece(f"cell_{l}", "coa", l))
    chain.add("dims", "SELECT count(DISTINCT row_id)::DOUBLE AS n, count(DISTINCT col_id)::DOUBLE AS p FROM cell")
    chain.add("opts", "SELECT 0 AS i, 1 AS stage, loglik, icl FROM scw UNION ALL "
              f"SELECT 1, 2, loglik, loglik - {penalty((1, 1), False)} FROM (SELECT sum(loglik) AS loglik FROM lia SEMI JOIN sca ON true), dims "
              "UNION ALL " + " UNION ALL ".join(
                  f"SELECT {2 + l}, 3, loglik, loglik - {penalty((1, 1, 1), False)} FROM (SELECT sum(loglik) AS loglik FROM "
                  f"(SELECT loglik FROM lia WHERE l <> {l} UNION ALL SELECT loglik FROM lib{l} SEMI JOIN scb{l} ON true) HAVING count(*) = 3), dims"
                  for l in (0, 1)))
    chain.add("first", "SELECT * FROM opts WHERE stage = 1")
    chain.add("second", "SELECT o.* FROM opts o, first f WHERE o.stage = 2 AND o.icl > f.icl")
    chain.add("third", "SELECT o.* FROM opts o, second f WHERE o.stage = 3 AND o.icl > f.icl ORDER BY o.icl DESC, o.i LIMIT 1")
    chain.add("pick", "SELECT * FROM (SELECT * FROM first UNION ALL SELECT * FROM second UNION ALL SELECT * FROM third) ORDER BY stage DESC LIMIT 1")
    chain.add("scg", "SELECT loglik, icl FROM pick")
    chain.add("cog", "SELECT col_id, 0 AS l FROM cow, pick WHERE i = 0 UNION ALL SELECT col_id, l FROM coa, pick WHERE i = 1 UNION ALL "
              + " UNION ALL ".join(
                  f"SELECT col_id, 0 FROM coa, pick WHERE i = {2 + l} AND l <> {l} UNION ALL SELECT col_id, l + 1 FROM cob{l}, pick WHERE i = {2 + l}"
                  for l in (0, 1)))
    chain.add("rog", "SELECT DISTINCT row_id, l, 0 AS k FROM cell, (SELECT DISTINCT l FROM cog)")
    fits.densities += ["dda", "ddb0", "ddb1"]
    return fits.select("g")


@query("clbm_greedy_search", clbm_greedy_sql())
def clbm_greedy_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen(selection.clbm_greedy_search(
        measures_matrix(spark, sf_dir), [1], MAX_L, n_starts=1, split_starts=1, **SEARCH))


# -- CLBM after LBM -----------------------------------------------------------------------


def refined_sql(fits: Fits, found: str, max_l: int, range_k: Sequence[int]) -> str:
    """Row clusters chosen again inside each column cluster of ``found``, and a last fit."""
    chain = fits.chain
    parts = []
    for l in range(max_l):
        cells = fits.piece(f"in_{l}", f"co{found}", l)
        inner = fits.best(f"i{l}", [fits.add(f"i{l}{k}", (k,), False, cells=cells) for k in range_k])
        share = f"(SELECT any_value(col_prop) FROM mo{found} WHERE l = {l})"
        parts.append(f"SELECT {l} AS l, k, m0, m1, c00, c01, c11, row_prop, {share} AS col_prop FROM mo{inner}")
    chain.add("moz", " UNION ALL ".join(parts))
    likelihoods, rows, cols = sql.add_fit(chain, "z", "moz", f"co{found}", False, ITERATIONS, 0)
    fits.densities += [f"dz_{it}" for it in range(ITERATIONS + 1)]
    chain.add("dimz", "SELECT count(DISTINCT row_id)::DOUBLE AS n, count(DISTINCT col_id)::DOUBLE AS p FROM cell")
    chain.add("numz", "SELECT count(*) AS total, count(DISTINCT l) AS wide FROM moz")
    icl = "loglik - (ln(n) * (total - wide) / 2.0 + ln(p) * (wide - 1) / 2.0 + ln(n * p) * total * wide * 5.0 / 2)"
    chain.add("scz", f"SELECT loglik, {icl} AS icl FROM {likelihoods[-1]}, dimz, numz")
    chain.add("roz", f"SELECT row_id, l, k FROM {rows}").add("coz", f"SELECT col_id, l FROM {cols}")
    return fits.select("z")


AFTER_K, AFTER_L = [1, 2], [2]


def after_grid_sql() -> str:
    fits = Fits()
    found = fits.best("best", [fits.add(f"f{k}", (k,) * AFTER_L[0], True) for k in AFTER_K])
    return refined_sql(fits, found, AFTER_L[0], AFTER_K)


@query("clbm_after_lbm_grid", after_grid_sql())
def clbm_after_lbm_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen(selection.clbm_after_lbm_grid(
        measures_matrix(spark, sf_dir), AFTER_K, AFTER_L, n_starts=1, inner_starts=1, **SEARCH))


def after_greedy_sql() -> str:
    fits, best = lbm_greedy_fits(MAX_K, 2)
    return refined_sql(fits, best, 2, range(1, MAX_K + 1))


@query("clbm_after_lbm_greedy", after_greedy_sql())
def clbm_after_lbm_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen(selection.clbm_after_lbm_greedy(
        measures_matrix(spark, sf_dir), MAX_K, 2, n_starts=1, inner_starts=1, **SEARCH))


# -- starts from k-means and from an LBM ----------------------------------------------------

START = (2, 2)


def started(found: tuple[BlockModel, DataFrame], spark: SparkSession) -> DataFrame:
    """The blocks and the columns of a start as ``(what, id, l, value)``."""
    blocks = rotated_back(found[0]).to_frame(spark)
    mean, cov = F.col("mean"), F.col("cov")
    values = {"n": F.col("n_cells"), "m0": mean[0], "m1": mean[1], "c00": cov[0][0], "c01": cov[0][1], "c11": cov[1][1],
              "row_prop": F.col("row_prop"), "col_prop": F.col("col_prop")}
    entries = F.array(*[F.struct(F.lit(what).alias("what"), r6(value.cast("double")).alias("value")) for what, value in values.items()])
    lines = blocks.select(big("k").alias("id"), big("l").alias("l"), F.inline(entries)).select("what", "id", "l", "value")
    columns = found[1].select(F.lit("column").alias("what"), big("col_id").alias("id"), F.lit(0).cast("bigint").alias("l"),
                              F.col("l").cast("double").alias("value"))
    return lines.unionAll(columns)


def started_sql(chain: Chain, rows: str, cols: str, densities: Sequence[str] = ()) -> str:
    sql.add_labelled(chain, "labz", rows, cols, False)
    sql.add_model(chain, "modz", "labz", False)
    lines = " UNION ALL ".join(f"SELECT '{what}' AS what, k::BIGINT AS id, l::BIGINT AS l, {sql.r6(what)} AS value FROM modz"
                               for what in ("n", "m0", "m1", "c00", "c01", "c11", "row_prop", "col_prop"))
    return chain.select(f"{lines} UNION ALL SELECT 'column', col_id::BIGINT, 0, l::DOUBLE FROM {cols}", inline=densities)


def add_kmeans(chain: Chain, tag: str, cells: str, item: str, attr: str, k: int, seed: int) -> str:
    """Labels ``(item, k)`` of k-means with its own start."""
    chain.add(f"x{tag}", f"SELECT {item} AS item, {attr} AS attr, f0, f1 FROM {cells}")

    def distances(name: str, centres: str) -> str:
        chain.add(name, f"SELECT x.item, c.k, sqrt(sum((x.f0 - c.f0) * (x.f0 - c.f0) + (x.f1 - c.f1) * (x.f1 - c.f1))) AS d "
                  f"FROM x{tag} x JOIN {centres} c USING (attr) GROUP BY x.item, c.k")
        return name

    chain.add(f"c{tag}0", f"SELECT 0 AS k, attr, f0, f1 FROM x{tag} WHERE item = (SELECT min(item) FROM x{tag})")
    centres = f"c{tag}0"
    for c in range(1, k):
        d = distances(f"dp{tag}{c}", centres)
        chain.add(f"np{tag}{c}", f"SELECT item, min(d) AS d FROM {d} GROUP BY item")
        chain.add(f"qp{tag}{c}", f"SELECT item, sum(d) OVER (ORDER BY item) AS running, sum(d) OVER () AS total FROM np{tag}{c}")
        u = sql.uniform_sql(sql.text("p"), sql.text(c), sql.text(seed))
        chain.add(f"c{tag}{c}", f"SELECT * FROM {centres} UNION ALL SELECT {c}, attr, f0, f1 FROM x{tag} "
                  f"WHERE item = (SELECT min(item) FROM qp{tag}{c} WHERE running >= {u} * total)")
        centres = f"c{tag}{c}"
    labels = ""
    for r in range(kmeans.ITERATIONS):
        d = distances(f"dr{tag}{r}", centres)
        labels = f"a{tag}{r}"
        chain.add(labels, f"SELECT item, k FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY d, k) AS rn FROM {d}) WHERE rn = 1")
        centres = f"r{tag}{r}"
        chain.add(centres, f"SELECT k, attr, avg(f0) AS f0, avg(f1) AS f1 FROM x{tag} JOIN {labels} USING (item) GROUP BY k, attr")
    return labels


def init_kmeans_sql() -> str:
    fits = Fits()
    chain = fits.chain
    by_column = add_kmeans(chain, "c", "cell", "col_id", "row_id", len(START), 0)
    chain.add("cps", f"SELECT item AS col_id, k AS l FROM {by_column}")
    parts = []
    for l, size in enumerate(START):
        cells = fits.piece(f"in_{l}", "cps", l)
        parts.append(f"SELECT item AS row_id, {l} AS l, k FROM {add_kmeans(chain, f'l{l}', cells, 'row_id', 'col_id', size, 0)}")
    chain.add("rps", " UNION ALL ".join(parts))
    return started_sql(chain, "rps", "cps")


@query("clbm_init_kmeans", init_kmeans_sql())
def clbm_init_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The SQL has no second try: with the ten rows of the smallest tables a cluster is lost and the
    query goes on with another seed."""
    settings = fit.clbm_settings(START, threshold=1.0)
    return started(starts.from_kmeans(measures_matrix(spark, sf_dir), settings, 0), spark)


def init_lbm_sql() -> str:
    fits = Fits()
    outer = fits.add("o", START, True, iterations=2 * starts.LBM_START_ITERATIONS)
    parts = []
    for l, size in enumerate(START):
        cells = fits.piece(f"in_{l}", f"co{outer}", l)
        sql.add_sampled_model(fits.chain, f"si{l}", (size,), starts.SAMPLE_ROWS, 0, cells)
        fits.chain.add(f"ci{l}", f"SELECT DISTINCT col_id, 0 AS l FROM {cells}")
        inner = fits.add(f"i{l}", (size,), False, cells=cells, start=(f"si{l}", f"ci{l}"), iterations=12)
        parts.append(f"SELECT row_id, {l} AS l, k FROM ro{inner}")
    fits.chain.add("rps", " UNION ALL ".join(parts))
    return started_sql(fits.chain, "rps", f"co{outer}", fits.densities)


@query("clbm_init_lbm", init_lbm_sql())
def clbm_init_lbm(spark: SparkSession, sf_dir: str) -> DataFrame:
    settings = fit.clbm_settings(START, threshold=1.0)
    return started(starts.from_lbm(measures_matrix(spark, sf_dir), settings, 0), spark)
