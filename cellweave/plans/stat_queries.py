"""Statistics, k-means, partition comparison and model selection."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellweave.functions.draws import uniform
from cellweave.operators import kmeans, model, partitions, shape, stats
from cellweave.operators.kmeans import Items
from cellweave.plans import sql, tables
from cellweave.plans.catalogue import big, embedding_matrix, pairs_matrix, query, r6
from cellweave.plans.model_queries import (
    CLBM, LBM, MODEL_COLUMNS, balanced, chain_of, estimated, model_columns,
)
from cellweave.plans.shape_queries import add_ari, labels_chain, two_labellings
from cellweave.plans.sql import Chain

DIM = 8
# An arbitrary centre for the covariance of the embedding slices.
CENTRE = [0.01 * i for i in range(DIM)]


def lineitem(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return tables.read(spark, sf_dir, "lineitem").select(*columns)


@query("mean_scalar", f"SELECT vec_id AS row_id, {sql.r6('list_avg(embedding::DOUBLE[])')} AS mean FROM embeddings")
def mean_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = tables.read(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("row_id"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    return stats.mean_scalar(vectors, ["row_id"], "v").select("row_id", r6("mean").alias("mean"))


@query("mean_vector", sql.embedding_chain().select(
    f"SELECT col_id::BIGINT AS col_id, pos::BIGINT AS i, {sql.r6('avg(x)')} AS mean FROM em GROUP BY col_id, pos"))
def mean_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = stats.mean_vector(embedding_matrix(spark, sf_dir).cells, ["col_id"], "feat", DIM)
    return means.select("col_id", F.posexplode("mean").alias("i", "mean")).select(
        "col_id", big("i").alias("i"), r6("mean").alias("mean"))


@query("variance_scalar", f"SELECT event_type, {sql.r6('var_samp(value)')} AS variance FROM events GROUP BY event_type")
def variance_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = stats.variance_scalar(tables.read(spark, sf_dir, "events"), ["event_type"], "value")
    return found.select("event_type", r6("variance").alias("variance"))


@query("covariance_scalar", f"SELECT l_returnflag, {sql.r6('covar_samp(l_quantity, l_extendedprice)')} AS covariance "
       "FROM lineitem GROUP BY l_returnflag")
def covariance_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lineitem(spark, sf_dir, "l_returnflag", "l_quantity", "l_extendedprice")
    found = stats.covariance_scalar(rows, ["l_returnflag"], "l_quantity", "l_extendedprice")
    return found.select("l_returnflag", r6("covariance").alias("covariance"))


def matrix_sql(weight: str | None) -> str:
    """Full and diagonal covariance of the slices, plain or weighted."""
    chain = sql.embedding_chain()
    w = weight or "1.0"
    divisor = f"sum({w})" if weight else "(count(*) - 1)"
    chain.add("pair", f"SELECT a.row_id, a.pos AS i, b.pos AS j, a.x AS x, b.x AS y FROM em a JOIN em b USING (row_id, col_id)")
    chain.add("mu", "SELECT pos, avg(x) AS m FROM em GROUP BY pos")
    full = f"sum({w} * (x - 0.01 * i) * (y - 0.01 * j)) / {divisor}"
    own = f"sum({w} * (x - a.m) * (y - b.m)) / {divisor}"
    return chain.select(
        f"SELECT 'full' AS kind, i::BIGINT AS i, j::BIGINT AS j, {sql.r6(full)} AS cov FROM pair GROUP BY i, j UNION ALL "
        f"SELECT 'diagonal', i, j, CASE WHEN i = j THEN {sql.r6(own)} ELSE 0.0 END FROM pair "
        "JOIN mu a ON a.pos = i JOIN mu b ON b.pos = j GROUP BY i, j")


def both_kinds(full: DataFrame, diagonal: DataFrame) -> DataFrame:
    named = full.select(F.lit("full").alias("kind"), "*").unionByName(
        diagonal.select(F.lit("diagonal").alias("kind"), "*"))
    return named.select("kind", big("i").alias("i"), big("j").alias("j"), r6("cov").alias("cov"))


@query("covariance_matrix", matrix_sql(None))
def covariance_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = embedding_matrix(spark, sf_dir).cells
    return both_kinds(stats.covariance_matrix(cells, "feat", DIM, CENTRE),
                      stats.covariance_matrix(cells, "feat", DIM, CENTRE, independent=True))


@query("weighted_covariance_matrix", matrix_sql("(1.0 + row_id % 7)"))
def weighted_covariance_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = embedding_matrix(spark, sf_dir).cells.withColumn("w", 1.0 + F.col("row_id") % 7)
    return both_kinds(stats.weighted_covariance_matrix(cells, "feat", "w", DIM, CENTRE),
                      stats.weighted_covariance_matrix(cells, "feat", "w", DIM, CENTRE, independent=True))


@query("grouped_covariance", chain_of(CLBM, False).select(
    " UNION ALL ".join(f"SELECT l::BIGINT AS l, k::BIGINT AS k, {i}::BIGINT AS i, {j}::BIGINT AS j, {sql.r6(c)} AS cov FROM mod"
                       for i, j, c in ((0, 0, "c00"), (0, 1, "c01"), (1, 0, "c01"), (1, 1, "c11")))))
def grouped_covariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = balanced(spark, sf_dir, CLBM)
    cells = shape.with_blocks(labels.matrix.cells, labels.row_part, labels.col_part)
    centres = stats.mean_vector(cells, ["l", "k"], "feat", 2)
    found = stats.grouped_covariance(cells, centres, 2)
    return found.select(*[big(c).alias(c) for c in ("l", "k", "i", "j")], r6("cov").alias("cov"))


@query("weighted_mean", f"SELECT l_returnflag, {sql.r6('sum(l_quantity * l_extendedprice) / sum(l_quantity)')} AS weighted_mean "
       "FROM lineitem GROUP BY l_returnflag")
def weighted_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lineitem(spark, sf_dir, "l_returnflag", "l_quantity", "l_extendedprice")
    found = stats.weighted_mean(rows, ["l_returnflag"], "l_extendedprice", "l_quantity")
    return found.select("l_returnflag", r6("weighted_mean").alias("weighted_mean"))


@query("weighted_covariance_scalar", "WITH m AS (SELECT l_returnflag, avg(l_discount) AS mx, avg(l_tax) AS my FROM lineitem GROUP BY l_returnflag) "
       f"SELECT l_returnflag, {sql.r6('sum(l_quantity * (l_discount - mx) * (l_tax - my)) / sum(l_quantity)')} AS weighted_covariance "
       "FROM lineitem JOIN m USING (l_returnflag) GROUP BY l_returnflag")
def weighted_covariance_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lineitem(spark, sf_dir, "l_returnflag", "l_quantity", "l_discount", "l_tax")
    found = stats.weighted_covariance_scalar(rows, ["l_returnflag"], "l_discount", "l_tax", "l_quantity")
    return found.select("l_returnflag", r6("weighted_covariance").alias("weighted_covariance"))


@query("log_sum_exp", "SELECT user_id, " + sql.r6("any_value(m) + ln(sum(exp(-10 * value - m)))") + " AS lse "
       "FROM (SELECT user_id, value, max(-10 * value) OVER (PARTITION BY user_id) AS m FROM events) GROUP BY user_id")
def log_sum_exp(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = tables.read(spark, sf_dir, "events").select("user_id", (-10 * F.col("value")).alias("score"))
    return stats.log_sum_exp_by_key(scores, ["user_id"], "score").select("user_id", r6("lse").alias("lse"))


@query("categorical_draw", sql.pairs_chain()
       .add("wt", "SELECT row_id, col_id AS k, f0 AS w FROM cell")
       .add("run", "SELECT row_id, k, sum(w) OVER (PARTITION BY row_id ORDER BY k) AS running, sum(w) OVER (PARTITION BY row_id) AS total FROM wt")
       .select("SELECT row_id::BIGINT AS row_id, sum(CASE WHEN running < "
               + sql.uniform_sql(sql.text("g"), "row_id", sql.text(0)) + " * total AND k < 4 THEN 1 ELSE 0 END)::BIGINT AS k FROM run GROUP BY row_id"))
def categorical_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = pairs_matrix(spark, sf_dir).cells.select(
        "row_id", F.col("col_id").alias("k"), F.get("feat", F.lit(0)).alias("prob"))
    drawn = stats.categorical_draw(weights, ["row_id"], 5, uniform("g", F.col("row_id"), 0))
    return drawn.select("row_id", big("k").alias("k"))


# -- k-means ----------------------------------------------------------------------------


def first_centres(items: Items, k: int) -> DataFrame:
    """The items of the ``k`` lowest ids as centres."""
    order = Window.orderBy("item")
    chosen = items.cells.select("item").distinct().orderBy("item").limit(k)
    numbered = chosen.withColumn("k", (F.row_number().over(order) - 1).cast("int"))
    return items.cells.join(F.broadcast(numbered), "item").select("k", "attr", "feat")


def kmeans_chain() -> Chain:
    chain = sql.pairs_chain()
    chain.add("lead", "SELECT row_id, row_number() OVER (ORDER BY row_id) - 1 AS k FROM (SELECT DISTINCT row_id FROM cell) ORDER BY row_id LIMIT 2")
    return chain.add("c_0", "SELECT k, col_id, f0, f1 FROM cell JOIN lead USING (row_id)")


def add_distances(chain: Chain, name: str, centres: str) -> Chain:
    return chain.add(name, "SELECT x.row_id, c.k, sqrt(sum((x.f0 - c.f0) * (x.f0 - c.f0) + (x.f1 - c.f1) * (x.f1 - c.f1))) AS d "
                     f"FROM cell x JOIN {centres} c USING (col_id) GROUP BY x.row_id, c.k")


def add_assignment(chain: Chain, name: str, distances: str) -> Chain:
    return chain.add(name, f"SELECT row_id, k FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY d, k) AS rn FROM {distances}) WHERE rn = 1")


def add_centres(chain: Chain, name: str, labels: str) -> Chain:
    return chain.add(name, f"SELECT k, col_id, avg(f0) AS f0, avg(f1) AS f1 FROM cell JOIN {labels} USING (row_id) GROUP BY k, col_id")


CENTRE_COLUMNS = f"k::BIGINT AS k, col_id::BIGINT AS attr, {sql.r6('f0')} AS f0, {sql.r6('f1')} AS f1"


def centre_columns(centres: DataFrame) -> DataFrame:
    return centres.select(big("k").alias("k"), "attr", r6(F.get("feat", F.lit(0))).alias("f0"),
                          r6(F.get("feat", F.lit(1))).alias("f1"))


@query("kmeans_distance", add_distances(kmeans_chain(), "d_1", "c_0").select(
    f"SELECT row_id::BIGINT AS item, {sql.r6('max(CASE WHEN k = 0 THEN d END)')} AS d0, {sql.r6('max(CASE WHEN k = 1 THEN d END)')} AS d1 FROM d_1 GROUP BY row_id"))
def kmeans_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = Items.of_rows(pairs_matrix(spark, sf_dir))
    distances = kmeans.kmeans_distance(items, kmeans.pack_centres(first_centres(items, 2), 2), 2)
    return distances.select("item", r6("d0").alias("d0"), r6("d1").alias("d1"))


@query("kmeans_assign", add_assignment(add_distances(kmeans_chain(), "d_1", "c_0"), "a_1", "d_1").select(
    "SELECT row_id::BIGINT AS item, k::BIGINT AS k FROM a_1"))
def kmeans_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = Items.of_rows(pairs_matrix(spark, sf_dir))
    labels = kmeans.kmeans_assign(items, kmeans.pack_centres(first_centres(items, 2), 2), 2)
    return labels.select("item", big("k").alias("k"))


@query("kmeans_update", add_centres(labels_chain(sql.pairs_chain()).add("a_1", "SELECT row_id, k FROM rp WHERE l = 0"), "c_1", "a_1").select(
    f"SELECT {CENTRE_COLUMNS} FROM c_1"))
def kmeans_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = balanced(spark, sf_dir, CLBM)
    assigned = labels.row_part.filter("l = 0").select(F.col("row_id").alias("item"), "k")
    return centre_columns(kmeans.kmeans_update(Items.of_rows(labels.matrix), assigned))


def init_random_sql() -> str:
    chain = sql.pairs_chain()
    order = sql.uniform_sql(sql.text("k"), "row_id", "k", sql.text(0))
    chain.add("a_1", f"SELECT row_id, k FROM (SELECT row_id, k, row_number() OVER (PARTITION BY k ORDER BY {order}, row_id) AS rn "
              f"FROM (SELECT DISTINCT row_id FROM cell), range(0, 3) c(k)) WHERE rn <= {kmeans.SAMPLE_SIZE}")
    return add_centres(chain, "c_1", "a_1").select(f"SELECT {CENTRE_COLUMNS} FROM c_1")


@query("kmeans_init_random", init_random_sql())
def kmeans_init_random(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centre_columns(kmeans.kmeans_init_random(Items.of_rows(pairs_matrix(spark, sf_dir)), 3, 0))


def init_pp_sql() -> str:
    chain = sql.pairs_chain()
    chain.add("c_0", "SELECT 0 AS k, row_id, col_id, f0, f1 FROM cell WHERE row_id = (SELECT min(row_id) FROM cell)")
    for c in (1, 2):
        add_distances(chain, f"d_{c}", f"c_{c - 1}")
        chain.add(f"n_{c}", f"SELECT row_id, min(d) AS d FROM d_{c} GROUP BY row_id")
        chain.add(f"q_{c}", f"SELECT row_id, sum(d) OVER (ORDER BY row_id) AS running, sum(d) OVER () AS total FROM n_{c}")
        u = sql.uniform_sql(sql.text("p"), sql.text(c), sql.text(0))
        chain.add(f"i_{c}", f"SELECT min(row_id) AS row_id FROM q_{c} WHERE running >= {u} * total")
        chain.add(f"c_{c}", f"SELECT * FROM c_{c - 1} UNION ALL SELECT {c}, row_id, col_id, f0, f1 FROM cell SEMI JOIN i_{c} USING (row_id)")
    return chain.select(f"SELECT {CENTRE_COLUMNS} FROM c_2")


@query("kmeans_init_pp", init_pp_sql())
def kmeans_init_pp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centre_columns(kmeans.kmeans_init_pp(Items.of_rows(pairs_matrix(spark, sf_dir)), 3, 0))


def kmeans_fit_sql(rounds: int) -> str:
    chain = kmeans_chain()
    for r in range(1, rounds + 1):
        add_distances(chain, f"d_{r}", f"c_{r - 1}")
        add_assignment(chain, f"a_{r}", f"d_{r}")
        add_centres(chain, f"c_{r}", f"a_{r}")
    return chain.select(f"SELECT a.row_id::BIGINT AS item, a.k::BIGINT AS k, col_id::BIGINT AS attr, {sql.r6('f0')} AS f0, {sql.r6('f1')} AS f1 "
                        f"FROM a_{rounds} a JOIN c_{rounds} c USING (k)")


@query("kmeans_fit", kmeans_fit_sql(3))
def kmeans_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = Items.of_rows(pairs_matrix(spark, sf_dir))
    found = kmeans.kmeans_fit(items, 2, iterations=3, initial=first_centres(items, 2))
    return found.labels.select("item", big("k").alias("k")).join(centre_columns(found.centers), "k")


# -- partitions -------------------------------------------------------------------------


@query("cond_block_partition", chain_of(CLBM, False).select(
    "SELECT row_id::BIGINT AS row_id, col_id::BIGINT AS col_id, k::BIGINT AS k, l::BIGINT AS l FROM lab"))
def cond_block_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = balanced(spark, sf_dir, CLBM)
    found = partitions.cond_block_partition(labels.matrix.cells, labels.row_part, labels.col_part)
    return found.select("row_id", "col_id", big("k").alias("k"), big("l").alias("l"))


@query("block_partition", chain_of(CLBM, False).select(
    "SELECT row_id::BIGINT AS row_id, col_id::BIGINT AS col_id, (dense_rank() OVER (ORDER BY l, k) - 1)::BIGINT AS block FROM lab"))
def block_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = balanced(spark, sf_dir, CLBM)
    found = partitions.block_partition(labels.matrix.cells, labels.row_part, labels.col_part)
    return found.select("row_id", "col_id", big("block").alias("block"))


@query("entire_row_partition", chain_of(CLBM, False)
       .add("lists", "SELECT row_id, list(k ORDER BY l) AS labels FROM rp GROUP BY row_id")
       .select("SELECT row_id::BIGINT AS row_id, (dense_rank() OVER (ORDER BY labels) - 1)::BIGINT AS label FROM lists"))
def entire_row_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = balanced(spark, sf_dir, CLBM)
    found = partitions.entire_row_partition(
        labels.row_part, min(int(np.prod(CLBM)), labels.matrix.n_rows))
    return found.select("row_id", big("label").alias("label"))


def ari_sql() -> str:
    chain = two_labellings()
    sql.add_labelled(chain, "lab1", "rp", "cp", False)
    sql.add_labelled(chain, "lab2", "rp2", "cp2", False)
    chain.add("both_blocks", "SELECT a.l * 100 + a.k AS a, b.l * 100 + b.k AS b FROM lab1 a JOIN lab2 b USING (row_id, col_id)")
    add_ari(chain, "block_ari", "a", "b", "both_blocks")
    return chain.select(" UNION ALL ".join(
        f"SELECT '{what}' AS what, {sql.r6('ari')} AS ari FROM {name}"
        for what, name in (("rows", "row_ari"), ("columns", "col_ari"), ("blocks", "block_ari"))))


@query("adjusted_rand_index", ari_sql())
def adjusted_rand_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, second = balanced(spark, sf_dir, CLBM, 0), balanced(spark, sf_dir, CLBM, 1)
    scores = partitions.partition_scores(
        first.matrix.cells, (first.row_part, first.col_part), (second.row_part, second.col_part))
    return scores.select("what", r6("ari").alias("ari"))


@query("partitions_equal", two_labellings().select(
    "SELECT 'same' AS what, 1::BIGINT AS equal UNION ALL SELECT 'other', bool_and(a.k = b.k)::BIGINT "
    "FROM rp a JOIN rp2 b USING (row_id, l)"))
def partitions_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, second = balanced(spark, sf_dir, CLBM, 0), balanced(spark, sf_dir, CLBM, 1)
    same = partitions.partitions_equal(first.row_part, first.row_part.select("k", "l", "row_id"), ["row_id", "l"], "k")
    other = partitions.partitions_equal(first.row_part, second.row_part, ["row_id", "l"], "k")
    return same.select(F.lit("same").alias("what"), big("equal").alias("equal")).unionByName(
        other.select(F.lit("other").alias("what"), big("equal").alias("equal")))


# -- model selection --------------------------------------------------------------------


def merge_sql() -> str:
    chain = sql.add_col_labels(sql.pairs_chain(), "cp", 3, 0)
    u = sql.uniform_sql(sql.text("c"), "col_id", sql.text(2))
    chain.add("sub", f"SELECT col_id, (row_number() OVER (ORDER BY {u}, col_id) - 1) % 2 AS l FROM (SELECT col_id FROM cp WHERE l = 0)")
    return chain.select(
        "SELECT col_id::BIGINT AS col_id, (dense_rank() OVER (ORDER BY l) - 1)::BIGINT AS l FROM cp WHERE l <> 0 UNION ALL "
        "SELECT col_id, l + 2 FROM sub")


@query("merge_col_partition", merge_sql())
def merge_col_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    matrix = pairs_matrix(spark, sf_dir)
    former = partitions.balanced_col_partition(matrix.columns(), 3, 0, matrix.n_cols)
    inside = former.filter("l = 0").select("col_id")
    sub = partitions.balanced_col_partition(inside, 2, 2, matrix.n_cols)
    merged = partitions.merge_col_partition(former, 0, sub, 3)
    return merged.select("col_id", big("l").alias("l"))


def update_sql() -> str:
    chain = chain_of(CLBM, False, 0, "_a")
    chain_of((2, 2), False, 1, "_b", chain)
    chain.add("gone", "SELECT any_value(col_prop) AS share FROM mod_a WHERE l = 0")
    chain.add("upd", "SELECT l - 1 AS l, k, m0, m1, c00, c01, c11, row_prop, col_prop FROM mod_a WHERE l > 0 UNION ALL "
              "SELECT l + 1, k, m0, m1, c00, c01, c11, row_prop, col_prop * share FROM mod_b, gone")
    return chain.select(f"SELECT {MODEL_COLUMNS} FROM upd")


@query("update_model", update_sql())
def update_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    former = estimated(balanced(spark, sf_dir, CLBM, 0), CLBM, False).to_frame(spark)
    new = estimated(balanced(spark, sf_dir, (2, 2), 1), (2, 2), False).to_frame(spark)
    return model_columns(model.update_model_table(former, 0, new, len(CLBM)))


@query("lbm_to_clbm", chain_of(LBM, True).select(f"SELECT {MODEL_COLUMNS} FROM mod"))
def lbm_to_clbm(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = estimated(balanced(spark, sf_dir, LBM, 0, True), LBM, True).to_frame(spark)
    parts = found.drop("row_prop", "col_prop")
    row_props = found.filter("l = 0").select("k", "row_prop")
    col_props = found.filter("k = 0").select("l", "col_prop")
    return model_columns(model.lbm_to_clbm_table(parts, row_props, col_props))
