"""k-means over items whose value is one vector per attribute.

The items are rows with their columns as attributes, or columns with their rows. Cells are
``(item, attr, feat)``; centres are ``(attr, centres)`` with one vector per cluster, so a
cell meets all clusters in a single join. Items may come in groups that share no attribute, such
as the rows inside each column cluster: an attribute then tells the group, and a round serves the
k-means of all groups."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.functions.draws import pick_category, uniform
from cellweave.operators.model import EmptyClusterError
from cellweave.operators.ranks import first_of_each
from cellweave.runtime import broadcast_if_small, checkpoint, run_together

SAMPLE_SIZE = 20
ITERATIONS = 10
TRIES = 10
BANDS = 1024
BAND_ITEMS = 4096


@dataclass(frozen=True)
class Items:
    """Cells read as items with attributes, and the counted sizes joins depend on. In groups an item
    has the keys ``group`` and ``item``, and some groups may have fewer clusters than others."""

    cells: DataFrame
    n_items: int
    n_attrs: int
    dim: int
    keys: tuple[str, ...] = ("item",)

    @staticmethod
    def of_rows(matrix, loadings_dim: int | None = None, cells: DataFrame | None = None) -> Items:
        source = matrix.cells if cells is None else cells
        renamed = source.select(F.col("row_id").alias("item"), F.col("col_id").alias("attr"), "feat")
        return Items(renamed, matrix.n_rows, matrix.n_cols, loadings_dim or matrix.dim)

    @staticmethod
    def of_columns(matrix, loadings_dim: int | None = None, cells: DataFrame | None = None) -> Items:
        source = matrix.cells if cells is None else cells
        renamed = source.select(F.col("col_id").alias("item"), F.col("row_id").alias("attr"), "feat")
        return Items(renamed, matrix.n_cols, matrix.n_rows, loadings_dim or matrix.dim)

    def beside_centres(self, packed: DataFrame, k: int) -> DataFrame:
        return broadcast_if_small(packed, self.n_attrs, 8 * k * self.dim + 64)

    def beside_labels(self, labels: DataFrame) -> DataFrame:
        return broadcast_if_small(labels, self.n_items, 32)


def squared_distance(centre: Column, dim: int) -> Column:
    total = None
    for i in range(dim):
        gap = F.get("feat", F.lit(i)) - F.get(centre, F.lit(i))
        total = gap * gap if total is None else total + gap * gap
    return total


def kmeans_distance(items: Items, packed: DataFrame, k: int) -> DataFrame:
    """``(item, d0, d1, ...)``: square root of the squared differences summed over all
    attributes, for each of ``k`` centres; null for a centre that a group has not."""
    met = items.cells.join(items.beside_centres(packed, k), "attr")
    sums = [
        F.sqrt(F.sum(squared_distance(F.get("centres", F.lit(c)), items.dim))).alias(f"d{c}")
        for c in range(k)
    ]
    return met.groupBy(*items.keys).agg(*sums)


def nearest(k: int) -> Column:
    """Index of the smallest distance, the lowest on ties."""
    known = [F.when(F.col(f"d{c}").isNotNull(), F.struct(F.col(f"d{c}").alias("d"), F.lit(c).alias("k"))) for c in range(k)]
    return F.array_min(F.array(*known))["k"]


def kmeans_assign(items: Items, packed: DataFrame, k: int) -> DataFrame:
    """``(item, k)``."""
    return kmeans_distance(items, packed, k).select(*items.keys, nearest(k).alias("k"))


def kmeans_update(items: Items, labels: DataFrame) -> DataFrame:
    """Mean of the members of each cluster, ``(k, attr, feat)``."""
    means = F.array(*[F.avg(F.get("feat", F.lit(i))) for i in range(items.dim)])
    return (
        items.cells.join(items.beside_labels(labels), list(items.keys))
        .groupBy("attr", "k")
        .agg(means.alias("feat"))
        .select("k", "attr", "feat")
    )


def pack_centres(centres: DataFrame, k: int) -> DataFrame:
    """``(attr, centres)`` from ``(k, attr, feat)``: k vectors per attribute."""
    vectors = [F.max(F.when(F.col("k") == c, F.col("feat"))) for c in range(k)]
    return centres.groupBy("attr").agg(F.array(*vectors).alias("centres"))


def check_sizes(labels: DataFrame, k: int) -> None:
    sizes = {r.k: r["count"] for r in labels.groupBy("k").count().collect()}
    if any(sizes.get(c, 0) <= 1 for c in range(k)):
        raise EmptyClusterError(f"a cluster has fewer than two members: {sizes}")


def kmeans_init_random(items: Items, k: int, seed: int) -> DataFrame:
    """Each centre is the mean of up to 20 random items; ``(k, attr, feat)``."""
    m = min(items.n_items, SAMPLE_SIZE)
    numbers = F.sequence(F.lit(0), F.lit(k - 1))
    spread = items.cells.select("item").distinct().withColumn("k", F.explode(numbers))
    chosen = first_of_each(spread, ["k"], uniform("k", F.col("item"), F.col("k"), seed), "item", m)
    means = F.array(*[F.avg(F.get("feat", F.lit(i))) for i in range(items.dim)])
    return (
        items.cells.join(broadcast_if_small(chosen, m * k, 32), "item")
        .groupBy("k", "attr")
        .agg(means.alias("feat"))
    )


def kmeans_init_pp(items: Items, k: int, seed: int) -> DataFrame:
    """First centre: the item of lowest id. Each next one is drawn with probability
    proportional to the distance to its nearest centre; ``(k, attr, feat)``.

    Each item carries its distance to the nearest centre so far; a round compares it with the
    newest centre only. The draw goes through the items in order of id. Running sums are
    formed over bands of the id in two levels, so no task walks through all items."""

    def centre(item: DataFrame, c: int) -> DataFrame:
        found = items.cells.join(F.broadcast(item), "item").select(F.lit(c).alias("k"), "attr", "feat")
        return checkpoint(found) if k > 1 else found

    newest = centre(items.cells.agg(F.min("item").alias("item")), 0)
    centres, weights = newest, None
    for c in range(1, k):
        alone = pack_centres(newest.withColumn("k", F.lit(0)), 1)
        distances = kmeans_distance(items, alone, 1).withColumnRenamed("d0", "gap")
        if weights is not None:
            distances = distances.join(items.beside_labels(weights), "item")
        nearest_gap = F.col("gap") if weights is None else F.least("gap", "weight")
        weights = checkpoint(distances.select("item", nearest_gap.alias("weight")))
        chosen = draw_item(weights, uniform("p", F.lit(c), seed), items.n_items)
        newest = centre(chosen, c)
        centres = centres.unionByName(newest)
    return centres


def draw_item(weights: DataFrame, u: Column, n_items: int) -> DataFrame:
    """One item ``(item)`` drawn by its weight, items taken in order of id: the first whose
    running weight reaches ``u`` times the total.

    Ids are cut into at most ``BANDS`` ranges of equal width; the range that holds the
    threshold is found from the range totals, then only its items are summed one by one. A
    crowded range is cut again until it is small."""
    edges = weights.agg(F.min("item").alias("lo"), F.max("item").alias("hi"),
                        F.sum("weight").alias("total"), u.alias("u")).first()
    if not edges.total:
        # every item sits on a centre: the reached threshold is zero, so the first item is drawn
        return weights.agg(F.min("item").alias("item"))
    lo, hi, remaining, target = edges.lo, edges.hi, n_items, edges.u * edges.total
    while remaining > BAND_ITEMS and hi > lo:
        width = -(-(hi - lo + 1) // BANDS)
        # Decimals, as the difference of two 64-bit ids may not fit into one.
        band = F.expr(f"(cast(item as decimal(38,0)) - ({lo})) div cast({width} as decimal(38,0))")
        bands = (
            weights.filter(F.col("item").between(lo, hi))
            .groupBy(band.alias("band"))
            .agg(F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("n"))
            .orderBy("band").collect()
        )
        for position, band in enumerate(bands):
            if band.weight >= target or position == len(bands) - 1:
                lo, hi, remaining = lo + band.band * width, min(hi, lo + (band.band + 1) * width - 1), band.n
                break
            target -= band.weight
    rows = weights.filter(F.col("item").between(lo, hi)).orderBy("item").collect()
    for row in rows:
        target -= row.weight
        if target <= 0:
            break
    return weights.filter(F.col("item") == row.item).select("item")


@dataclass
class KMeansResult:
    """``centers(k, attr, feat)`` after the last update and ``labels(item, k)`` from the
    last assignment, which comes before it."""

    centers: DataFrame | None
    labels: DataFrame | None
    status: str


def kmeans_fit(
    items: Items, k: int, iterations: int = ITERATIONS, init: str = "pp", seed: int = 0,
    max_tries: int = TRIES, initial: DataFrame | None = None,
) -> KMeansResult:
    """Exactly ``iterations`` rounds of assignment and update. A start that loses a cluster
    is tried again with another seed."""
    if k < 1 or iterations < 1 or max_tries < 1:
        raise ValueError("k, iterations and max_tries must be positive")
    starts = {"pp": kmeans_init_pp, "random": kmeans_init_random}
    if init not in starts:
        raise ValueError(f"unknown start {init!r}; use one of {sorted(starts)}")
    for attempt in range(max_tries):
        try:
            centres = initial if initial is not None else starts[init](items, k, seed + attempt)
            labels = None
            for _ in range(iterations):
                labels = checkpoint(kmeans_assign(items, pack_centres(centres, k), k))
                check_sizes(labels, k)
                centres = kmeans_update(items, labels)
            return KMeansResult(centres, labels, "ok")
        except EmptyClusterError:
            if initial is not None:
                break
    return KMeansResult(None, None, "failed")


def kmeans_groups(items: Items, sizes: dict[int, int], seed: int = 0, iterations: int = ITERATIONS, max_tries: int = TRIES) -> DataFrame:
    """``(group, item, k)``: the labels of ``kmeans_fit`` inside each group, with as many clusters as
    ``sizes`` says. The rounds of all groups are one; only the draws of new centres are made group
    by group, side by side. A group that loses a cluster is tried again with another seed while
    the others stand."""
    pending, done = dict(sizes), []
    for attempt in range(max_tries):
        own = replace(items, cells=items.cells.filter(F.col("group").isin(list(pending))))
        labels, alive = group_rounds(own, pending, seed + attempt, iterations)
        if alive:
            done.append(labels)
        pending = {g: k for g, k in pending.items() if g not in alive}
        if not pending:
            return reduce(DataFrame.unionByName, done)
    raise EmptyClusterError("k-means found no start without an empty cluster")


def group_rounds(items: Items, sizes: dict[int, int], seed: int, iterations: int) -> tuple[DataFrame, set[int]]:
    """The labels of the groups that keep all their clusters, and which these are."""
    most, alive, labels = max(sizes.values()), set(sizes), None
    centres = group_centres(items, sizes, seed)
    for _ in range(iterations):
        labels = checkpoint(kmeans_assign(items, pack_centres(centres, most), most))
        counted = {(r.group, r.k): r["count"] for r in labels.groupBy("group", "k").count().collect()}
        lost = {g for g in alive if sizes[g] > 1 and any(counted.get((g, c), 0) <= 1 for c in range(sizes[g]))}
        if lost:
            alive -= lost
            labels = labels.filter(F.col("group").isin(list(alive)))
        if not alive:
            break
        centres = kmeans_update(items, labels)
    return labels, alive


def group_centres(items: Items, sizes: dict[int, int], seed: int) -> DataFrame:
    """The start of ``kmeans_init_pp`` in each group, ``(k, attr, feat)``."""

    def centre(chosen: DataFrame, c: int) -> DataFrame:
        met = items.cells.join(broadcast_if_small(chosen, len(sizes), 32), ["group", "item"])
        return checkpoint(met.select(F.lit(c).alias("k"), "attr", "feat"))

    newest = centre(items.cells.groupBy("group").agg(F.min("item").alias("item")), 0)
    centres, weights = newest, None
    for c in range(1, max(sizes.values())):
        alone = pack_centres(newest.withColumn("k", F.lit(0)), 1)
        distances = kmeans_distance(items, alone, 1).withColumnRenamed("d0", "gap")
        if weights is not None:
            distances = distances.join(items.beside_labels(weights), ["group", "item"])
        nearest_gap = F.col("gap") if weights is None else F.least("gap", "weight")
        weights = checkpoint(distances.select("group", "item", nearest_gap.alias("weight")))
        u = uniform("p", F.lit(c), seed)
        drawn = run_together([
            lambda g=g: draw_item(weights.filter(F.col("group") == g), u, items.n_items).first().item
            for g, k in sizes.items() if k > c
        ])
        wanted = [(g, item) for g, item in zip([g for g, k in sizes.items() if k > c], drawn, strict=True)]
        newest = centre(items.cells.sparkSession.createDataFrame(wanted, "group int, item bigint"), c)
        centres = centres.unionByName(newest)
    return centres
