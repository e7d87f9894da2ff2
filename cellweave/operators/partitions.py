"""Row and column partitions: balanced random ones, merging, comparing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellweave.functions.draws import uniform
from cellweave.operators.ranks import dense_index, uniform_rank
from cellweave.operators.shape import with_blocks
from cellweave.runtime import broadcast_if_small, counted_broadcast


def balanced_col_partition(columns: DataFrame, n_groups: int, seed: int, n_cols: int) -> DataFrame:
    """``(col_id, l)`` with group sizes that differ by at most one."""
    u = uniform("c", F.col("col_id"), seed)
    ranked = uniform_rank(columns.select("col_id"), [], u, "col_id", "place", n_cols)
    return ranked.select("col_id", (F.col("place") % n_groups).cast("int").alias("l"))


def balanced_row_partition(
    rows: DataFrame, row_clusters: Sequence[int], seed: int, n_rows: int
) -> DataFrame:
    """``(row_id, l, k)``: for each l an independent balanced labelling into K_l groups."""
    sizes = F.array(*[F.lit(int(k)) for k in row_clusters])
    spread = rows.select("row_id", F.posexplode(sizes).alias("l", "groups"))
    u = uniform("r", F.col("row_id"), F.col("l"), seed)
    ranked = uniform_rank(spread, ["l"], u, "row_id", "place", n_rows)
    return ranked.select("row_id", "l", (F.col("place") % F.col("groups")).cast("int").alias("k"))


def cond_block_partition(cells: DataFrame, row_part: DataFrame, col_part: DataFrame) -> DataFrame:
    """The (k, l) pair of each cell, ``(row_id, col_id, k, l)``."""
    blocks = with_blocks(cells.select("row_id", "col_id"), row_part, col_part)
    return blocks.select("row_id", "col_id", "k", "l")


def block_partition(cells: DataFrame, row_part: DataFrame, col_part: DataFrame) -> DataFrame:
    """One number per block, ``(row_id, col_id, block)``, numbered in the order of (l, k). The
    blocks are listed from the labels, one record per block, not from the cells."""
    pairs = cond_block_partition(cells, row_part, col_part)
    order = Window.orderBy("l", "k")
    listed = row_part.select("l", "k").distinct().join(col_part.select("l").distinct(), "l", "left_semi")
    numbers = listed.withColumn("block", F.row_number().over(order) - 1)
    return pairs.join(counted_broadcast(numbers, 16), ["l", "k"]).select("row_id", "col_id", "block")


def two_block_partitions(
    cells: DataFrame, first: tuple[DataFrame, DataFrame], second: tuple[DataFrame, DataFrame]
) -> DataFrame:
    """``(row_id, col_id, a, b)``: the block of each cell under two pairs of row and column
    partitions, as structs of l and k, from one pass over the cells."""
    met = cells.select("row_id", "col_id")
    for name, (row_part, col_part) in (("a", first), ("b", second)):
        met = with_blocks(met, row_part, col_part).withColumn(name, F.struct("l", "k")).drop("l", "k")
    return met


def row_label_lists(row_part: DataFrame, out: str) -> DataFrame:
    """``(row_id, out)``: the labels of a row in all column clusters, in their order."""
    pairs = F.sort_array(F.collect_list(F.struct("l", "k")))
    return row_part.groupBy("row_id").agg(F.transform(pairs, lambda p: p["k"]).alias(out))


def entire_row_partition(row_part: DataFrame, n_labels: int) -> DataFrame:
    """Rows with the same label in every column cluster share one number,
    ``(row_id, label)``. ``n_labels`` bounds the number of distinct label lists: the product of
    the numbers of clusters, or the number of rows if that is less."""
    lists = row_label_lists(row_part, "labels")
    numbers = dense_index(lists.select("labels").distinct(), ["labels"], "label", n_labels)
    return lists.join(broadcast_if_small(numbers, n_labels, 128), "labels").select(
        "row_id", F.col("label")
    )


def adjusted_rand_index(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Agreement of two labellings of the same items, one record ``(ari)``; null when both
    put everything, or nothing, together. Only the contingency table is kept after the
    first aggregation."""
    table = pairs.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(
        F.count(F.lit(1)).cast("double").alias("n")
    )
    margins = table.cube("a", "b").agg(F.sum("n").alias("n"), F.grouping_id().alias("level"))
    chosen = F.col("n") * (F.col("n") - 1) / 2

    def at_level(level: int, value: Column, out: str) -> Column:
        return F.sum(F.when(F.col("level") == level, value)).alias(out)

    counts = margins.agg(
        at_level(0, chosen, "both"), at_level(1, chosen, "in_a"), at_level(2, chosen, "in_b"),
        at_level(3, F.col("n"), "n"),
    )
    expected = F.try_divide(
        F.col("in_a") * F.col("in_b"), F.col("n") * (F.col("n") - 1) / 2
    )
    most = (F.col("in_a") + F.col("in_b")) / 2
    return counts.select(F.try_divide(F.col("both") - expected, most - expected).alias("ari"))


def partition_scores(
    cells: DataFrame, first: tuple[DataFrame, DataFrame], second: tuple[DataFrame, DataFrame]
) -> DataFrame:
    """``(what, ari)`` of two pairs of row and column partitions: entire rows, columns, blocks."""
    rows = row_label_lists(first[0], "a").join(row_label_lists(second[0], "b"), "row_id")
    columns = first[1].select("col_id", F.col("l").alias("a")).join(
        second[1].select("col_id", F.col("l").alias("b")), "col_id")
    scores = [
        adjusted_rand_index(pairs, "a", "b").select(F.lit(what).alias("what"), "ari")
        for what, pairs in (
            ("rows", rows), ("columns", columns), ("blocks", two_block_partitions(cells, first, second)))
    ]
    return scores[0].unionByName(scores[1]).unionByName(scores[2])


def partitions_equal(left: DataFrame, right: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    """One record ``(equal)``: 1 when both labellings hold the same items with the same
    labels, else 0."""
    keys = list(keys)
    a = left.select(*keys, F.col(label).alias("a"), F.lit(1).alias("in_left"))
    b = right.select(*keys, F.col(label).alias("b"), F.lit(1).alias("in_right"))
    same = (
        F.col("a").eqNullSafe(F.col("b"))
        & F.col("in_left").isNotNull() & F.col("in_right").isNotNull()
    )
    joined = a.join(b, keys, "full_outer")
    return joined.agg(F.coalesce(F.bool_and(same), F.lit(True)).cast("int").alias("equal"))


def merge_col_partition(former: DataFrame, l: int, sub_part: DataFrame, n_groups: int) -> DataFrame:
    """Replace column cluster ``l`` by a partition of its columns. The other clusters are
    ranked anew; the new labels follow them, from the former largest label on.
    ``n_groups`` is the former number of column clusters."""
    others = former.filter(F.col("l") != l).select("l").distinct()
    order = Window.orderBy("l")
    ranks = others.withColumn("rank", (F.row_number().over(order) - 1).cast("int"))
    kept = former.join(F.broadcast(ranks), "l").select("col_id", F.col("rank").alias("l"))
    added = sub_part.select("col_id", (F.col("l") + F.lit(n_groups - 1)).cast("int").alias("l"))
    return kept.unionByName(added)
