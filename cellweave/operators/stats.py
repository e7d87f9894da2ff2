"""Means, covariances and their weighted forms, all as grouped sums."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.functions.draws import pick_category
from cellweave.functions.kernels import partial_moments
from cellweave.runtime import counted_broadcast

# Up to this many features the moments are plain Spark sums; beyond it the products are
# formed batch by batch in numpy.
NATIVE_DIM = 8
BAND = 300.0
SUMS_SCHEMA = "l int, k int, sums array<double>"


def mean_scalar(df: DataFrame, keys: Sequence[str], vector: str) -> DataFrame:
    """Mean of the entries of each vector, averaged over the entries themselves."""
    entries = df.select(*keys, F.explode(vector).alias("value"))
    return entries.groupBy(*keys).agg(F.avg("value").alias("mean"))


def mean_vector(df: DataFrame, keys: Sequence[str], vector: str, dim: int) -> DataFrame:
    """Mean of the vectors of each group, as an array."""
    means = [F.avg(F.get(vector, F.lit(i))) for i in range(dim)]
    return df.groupBy(*keys).agg(F.array(*means).alias("mean"))


def variance_scalar(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.var_samp(value).alias("variance"))


def covariance_scalar(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.covar_samp(x, y).alias("covariance"))


def weighted_mean(df: DataFrame, keys: Sequence[str], value: str, weight: str) -> DataFrame:
    total = F.sum(F.col(weight) * F.col(value)) / F.sum(weight)
    return df.groupBy(*keys).agg(total.alias("weighted_mean"))


def weighted_covariance_scalar(
    df: DataFrame, keys: Sequence[str], x: str, y: str, weight: str
) -> DataFrame:
    """Weighted mean of the products about the *unweighted* means of the group, from one reading.

    The mean of w (x - mx) (y - my) is the covariance of w x and y less mx times that of w and y, as
    constants beside w and y drop out of both. Spark merges covariances pairwise, so a large mean
    costs few digits. Rows in which one of the three is missing are left out."""
    whole = F.col(x).isNotNull() & F.col(y).isNotNull() & F.col(weight).isNotNull()
    a, b, w = (F.when(whole, F.col(c).cast("double")) for c in (x, y, weight))
    products = F.covar_pop(w * a, b) - F.avg(a) * F.covar_pop(w, b)
    return df.groupBy(*keys).agg((products / F.avg(w)).alias("weighted_covariance"))


def covariance_matrix(
    df: DataFrame, vector: str, dim: int, centre: Sequence[float], independent: bool = False
) -> DataFrame:
    """Covariance ``(i, j, cov)`` of all vectors about a given centre, divided by n - 1.
    ``independent`` keeps the variances about the true mean and zeros elsewhere."""
    weightless = df.select(F.lit(1.0).alias("w"), F.col(vector).alias("v"))
    return centred_products(weightless, dim, centre, independent, F.count(F.lit(1)) - 1)


def weighted_covariance_matrix(
    df: DataFrame, vector: str, weight: str, dim: int, centre: Sequence[float],
    independent: bool = False,
) -> DataFrame:
    """The weighted form, divided by the total weight; with ``independent`` the centre is
    the unweighted mean."""
    weighted = df.select(F.col(weight).cast("double").alias("w"), F.col(vector).alias("v"))
    return centred_products(weighted, dim, centre, independent, F.sum("w"))


def centred_products(
    df: DataFrame, dim: int, centre: Sequence[float], independent: bool, divisor: Column
) -> DataFrame:
    if independent:
        means = df.agg(*[F.avg(F.get("v", F.lit(i))).alias(f"m{i}") for i in range(dim)]).first()
        centre = list(means)
    x = [F.get("v", F.lit(i)) - F.lit(float(c)) for i, c in enumerate(centre)]
    cells = []
    for i in range(dim):
        for j in range(dim):
            cov = F.sum(F.col("w") * x[i] * x[j]) / divisor
            if independent and i != j:
                cov = F.lit(0.0)
            cells.append(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), cov.alias("cov")))
    return df.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))


def whole_entries(dim: int) -> list[Column]:
    """The entries of ``feat``; another number of them, or a missing one, is an error."""
    refused = F.raise_error(F.lit(f"a cell has not {dim} features without a null")).cast("double")
    x = [F.coalesce(F.get("feat", F.lit(i)), refused) for i in range(dim)]
    x[0] = x[0] + F.when(F.size("feat") == dim, F.lit(0.0)).otherwise(refused)
    return x


def block_sums(cells: DataFrame, dim: int, shift: np.ndarray | None = None) -> DataFrame:
    """Count, sums and products of ``feat - shift`` per block, ``(l, k, sums)`` where
    ``sums`` holds n, then the sums, then the upper product triangle.

    Every task adds up its own cells first, so one record per block and task is shuffled
    however large a block is."""
    shift = np.zeros(dim) if shift is None else shift
    if dim <= NATIVE_DIM:
        x = [entry - F.lit(float(shift[i])) for i, entry in enumerate(whole_entries(dim))]
        products = [F.sum(x[i] * x[j]) for i in range(dim) for j in range(i, dim)]
        total = F.array(F.count(F.lit(1)).cast("double"), *[F.sum(v) for v in x], *products)
        return cells.groupBy("l", "k").agg(total.alias("sums"))
    narrow = cells.select(F.col("l").cast("int"), F.col("k").cast("int"), "feat")
    return add_partial_sums(
        narrow.mapInArrow(partial_moments(np.asarray(shift, dtype=float)), SUMS_SCHEMA)
    )


def add_partial_sums(partial: DataFrame, keys: Sequence[str] = ("l", "k")) -> DataFrame:
    """Add up the records of the tasks by position."""
    added = (
        partial.select(*keys, F.posexplode("sums").alias("i", "value"))
        .groupBy(*keys, "i")
        .agg(F.sum("value").alias("value"))
    )
    pairs = F.sort_array(F.collect_list(F.struct("i", "value")))
    return added.groupBy(*keys).agg(F.transform(pairs, lambda p: p["value"]).alias("sums"))


def unpack_sums(values: Sequence[float], dim: int) -> tuple[int, np.ndarray, np.ndarray]:
    """(n, sums, product matrix) of one record of ``block_sums``."""
    flat = np.asarray(values, dtype=float)
    products = np.zeros((dim, dim))
    products[np.triu_indices(dim)] = flat[1 + dim :]
    products = products + np.triu(products, 1).T
    return int(round(flat[0])), flat[1 : 1 + dim], products


def grouped_covariance(cells: DataFrame, centres: DataFrame, dim: int) -> DataFrame:
    """Covariance ``(l, k, i, j, cov)`` of each block about the centre given for it in
    ``centres(l, k, mean)``, divided by its cell count less one.

    Up to ``NATIVE_DIM`` features the cells are read once: counts, means and centred products are
    merged pairwise as Spark's covariances do, so that a large mean costs no digits, and the
    centres, one per block, meet the results. With more, the centre is taken off the cells before
    the products are formed in numpy."""
    if dim <= NATIVE_DIM:
        return moments_about(cells, centres, dim)
    gaps = F.zip_with("feat", "mean", lambda x, m: x - m)
    centred = cells.join(counted_broadcast(centres.select("l", "k", "mean"), 16 + 8 * dim), ["l", "k"])
    sums = block_sums(centred.select("l", "k", gaps.alias("feat")), dim)
    upper = {pair: n for n, pair in enumerate(zip(*np.triu_indices(dim)))}
    entries = []
    for i in range(dim):
        for j in range(dim):
            product = F.get("sums", F.lit(1 + dim + upper[(min(i, j), max(i, j))]))
            cov = product / (F.get("sums", F.lit(0)) - 1)
            entries.append(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), cov.alias("cov")))
    return sums.select("l", "k", F.inline(F.array(*entries)))


def moments_about(cells: DataFrame, centres: DataFrame, dim: int) -> DataFrame:
    """``grouped_covariance`` from the covariances about the true means: a product about c is the one
    about the mean plus the product of what the mean is off."""
    x = whole_entries(dim)
    pairs = [(i, j) for i in range(dim) for j in range(i, dim)]
    found = cells.groupBy("l", "k").agg(
        F.count(F.lit(1)).alias("n"), F.array(*[F.avg(v) for v in x]).alias("true"),
        F.array(*[F.covar_pop(x[i], x[j]) for i, j in pairs]).alias("spread"),
    )
    place = {pair: n for n, pair in enumerate(pairs)}
    off = F.zip_with("true", "mean", lambda a, b: a - b)
    met = found.join(centres.select("l", "k", "mean"), ["l", "k"]).withColumn("off", off)
    entries = [
        F.struct(
            F.lit(i).alias("i"), F.lit(j).alias("j"),
            (F.col("n") * (F.get("spread", F.lit(place[min(i, j), max(i, j)])) + F.get("off", F.lit(i)) * F.get("off", F.lit(j)))
             / (F.col("n") - 1)).alias("cov"),
        )
        for i in range(dim) for j in range(dim)
    ]
    return met.select("l", "k", F.inline(F.array(*entries)))


def log_sum_exp_by_key(df: DataFrame, keys: Sequence[str], score: str) -> DataFrame:
    """log Σ exp(score) per key by sums alone, so a key of any size is added up in parts.

    Scores are grouped into bands of width ``BAND`` (the two about zero are one) and summed
    relative to the band's edge. The highest band and the one below decide the result:
    anything lower is smaller than exp(-BAND) of it, which a double cannot show. Infinite and
    missing scores have no band: a key with plus infinity gives it, one with nothing but
    minus infinity gives that, one without any score gives null, and one with NaN gives NaN.
    The sums, one per key and band, are shuffled by key, where both later steps find them."""
    value = F.col(score).cast("double")
    finite = F.abs(value) < F.lit(float("inf"))
    band = F.when(finite, (value - value % BAND) / BAND)
    sums = df.groupBy(*keys, band.alias("band")).agg(
        F.sum(F.exp(value - band * F.lit(BAND))).alias("total"), F.max(value).alias("most")
    )
    zero, nothing = F.lit(0.0), F.lit(None).cast("double")
    as_own = F.struct("band", F.col("total").alias("own"), zero.alias("below"), "most")
    as_below = F.struct(
        (F.col("band") + 1).alias("band"), zero.alias("own"), F.col("total").alias("below"),
        nothing.alias("most"),
    )
    neighbours = (
        sums.repartition(*keys)
        .select(*keys, F.inline(F.array(as_own, as_below)))
        .groupBy(*keys, "band")
        .agg(F.sum("own").alias("own"), F.sum("below").alias("below"), F.max("most").alias("most"))
    )
    own = F.col("own") > 0
    top = neighbours.groupBy(*keys).agg(
        F.max_by(F.struct("band", "own", "below"), F.when(own, F.col("band"))).alias("top"),
        F.max("most").alias("most"),
    )
    total = F.col("top.own") + F.col("top.below") * F.exp(F.lit(-BAND))
    lse = F.when(F.abs("most") < F.lit(float("inf")), F.col("top.band") * F.lit(BAND) + F.log(total))
    return top.select(*keys, lse.otherwise(F.col("most")).alias("lse"))


def categorical_draw(df: DataFrame, keys: Sequence[str], n: int, u: Column) -> DataFrame:
    """Draw one index per key from ``(keys, k, prob)`` with k in 0..n-1: the first whose
    running probability reaches ``u``, an expression of the keys."""
    columns = [
        F.coalesce(F.sum(F.when(F.col("k") == k, F.col("prob"))), F.lit(0.0)).alias(f"p{k}")
        for k in range(n)
    ]
    wide = df.groupBy(*keys).agg(*columns)
    drawn = pick_category([F.col(f"p{k}") for k in range(n)], u)
    return wide.select(*keys, drawn.alias("k"))
