"""Packing, slicing, naming and sampling of the cell table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.functions.draws import uniform
from cellweave.operators.ranks import dense_index
from cellweave.runtime import broadcast_if_small, checkpoint, counted_broadcast

# A pack holds this many vectors at most, so its size never depends on the matrix.
PACK_WIDTH = 1024


def row_pack(cells: DataFrame, width: int = PACK_WIDTH) -> DataFrame:
    """Vectors of a row in the order of their columns, ``(row_id, pack, col_ids, feats)``. A
    matrix of up to ``width`` columns makes one pack of each row, a wider one several."""
    return packed(cells, "row_id", "col_id", "col_ids", width)


def col_pack(cells: DataFrame, width: int = PACK_WIDTH) -> DataFrame:
    """The transpose: vectors of a column in the order of their rows, ``width`` rows to a pack,
    ``(col_id, pack, row_ids, feats)``."""
    return packed(cells, "col_id", "row_id", "row_ids", width)


def packed(cells: DataFrame, by: str, along: str, ids: str, width: int) -> DataFrame:
    """Packs are cut by the position of an id among all ids, not by its value."""
    names = checkpoint(cells.select(along).distinct())
    n_names = names.count()
    places = dense_index(names, [along], "place", n_names)
    pack = F.floor(F.col("place") / width).cast("bigint").alias("pack")
    grouped = cells.join(broadcast_if_small(places, n_names, 24), along).groupBy(by, pack).agg(
        F.sort_array(F.collect_list(F.struct(along, "feat"))).alias("entries")
    )
    return grouped.select(
        by, "pack",
        F.transform("entries", lambda e: e[along]).alias(ids),
        F.transform("entries", lambda e: e["feat"]).alias("feats"),
    )


def label_maps(row_part: DataFrame) -> DataFrame:
    """``(row_id, z)``: the labels of a row by column cluster, as many as there are clusters."""
    return row_part.groupBy("row_id").agg(
        F.map_from_entries(F.collect_list(F.struct("l", "k"))).alias("z")
    )


def attach_row_partition(cells: DataFrame, row_part: DataFrame) -> DataFrame:
    """Cells with the row labels of all column clusters, ``(row_id, col_id, feat, z)``. The map
    ``z`` from l to k is attached once to a cell, which stays where it is."""
    return cells.join(label_maps(row_part), "row_id")


def with_blocks(cells: DataFrame, row_part: DataFrame, col_part: DataFrame) -> DataFrame:
    """Cells with the block (l, k) they belong to. The labels of a row travel as one map, so a
    table kept by row is not moved; cells without labels are left out."""
    met = cells.join(counted_broadcast(col_part), "col_id").join(label_maps(row_part), "row_id")
    return met.withColumn("k", F.try_element_at("z", F.col("l"))).where("k is not null").drop("z")


def block_filter(cells: DataFrame, row_part: DataFrame, col_part: DataFrame) -> DataFrame:
    """Size of every block that has cells, ``(l, k, size)``."""
    return (
        with_blocks(cells.select("row_id", "col_id"), row_part, col_part)
        .groupBy("l", "k")
        .agg(F.count(F.lit(1)).alias("size"))
    )


def column_slice(cells: DataFrame, col_part: DataFrame, l: int) -> DataFrame:
    """Cells of the columns of one column cluster."""
    wanted = col_part.filter(F.col("l") == l).select("col_id")
    return cells.join(counted_broadcast(wanted), "col_id", "left_semi")


def id_dictionary(names: DataFrame, name: str, out: str, n_names: int) -> DataFrame:
    """Distinct names numbered 0.. in their order, ``(name, out)``; read backwards it is the
    reverse map."""
    return dense_index(names.select(name).distinct(), [name], out, n_names)


def apply_dictionary(df: DataFrame, dictionary: DataFrame, name: str, n_names: int) -> DataFrame:
    """Add the id of each name, the missing name included; rows of one hot name stay where they
    are as long as the dictionary fits a broadcast."""
    names = broadcast_if_small(dictionary.withColumnRenamed(name, "_name"), n_names, 64)
    return df.join(names, F.col(name).eqNullSafe(F.col("_name"))).drop("_name")


def sample_cells(cells: DataFrame, m: int, row_key: Column, seed: int) -> DataFrame:
    """``m`` distinct rows without replacement and one random column of each,
    ``(row_id, col_id, feat)``. Rows are ordered by the uniform ``row_key``."""
    rows = cells.select("row_id").distinct().withColumn("u", row_key)
    chosen = rows.orderBy("u", "row_id").limit(m).select("row_id")
    pick = F.struct(uniform("s", F.col("row_id"), F.col("col_id"), seed), F.col("col_id"))
    return (
        cells.join(broadcast_if_small(chosen, m, 16), "row_id")
        .groupBy("row_id")
        .agg(F.min_by(F.struct("col_id", "feat"), pick).alias("cell"))
        .select("row_id", "cell.col_id", "cell.feat")
    )
