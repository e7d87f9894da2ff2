"""The cell table as a checked matrix, kept where its rows can be joined without moving it."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.functions.kernels import pack_moments
from cellweave.operators.pca import principal_axes
from cellweave.operators.stats import SUMS_SCHEMA, add_partial_sums, block_sums, unpack_sums
from cellweave.runtime import broadcast_if_small, one_record, partitions_for

LABEL_BYTES = 64
# Rows of up to this size are kept whole, as one record each.
PACK_BYTES = 1 << 20


def matrix_shape(cells: DataFrame) -> DataFrame:
    """One record ``(n_rows, n_cols, n_cells, complete)``. The matrix is complete when each
    row holds every column exactly once."""
    pairs = cells.groupBy("row_id", "col_id").agg(F.count(F.lit(1)).alias("copies"))
    rows = pairs.groupBy("row_id").agg(
        F.count(F.lit(1)).alias("width"),
        F.sum("copies").alias("cells"),
    )
    totals = rows.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min("width").alias("least"),
        F.max("width").alias("most"),
        F.sum("width").alias("pairs"),
        F.sum("cells").alias("n_cells"),
    )
    columns = pairs.select("col_id").distinct().agg(F.count(F.lit(1)).alias("n_cols"))
    return one_record(totals, columns).select(
        "n_rows",
        "n_cols",
        F.coalesce("n_cells", F.lit(0)).alias("n_cells"),
        (
            (F.col("least") == F.col("n_cols"))
            & (F.col("most") == F.col("n_cols"))
            & (F.col("pairs") == F.col("n_cells"))
        ).cast("int").alias("complete"),
    )


class IncompleteMatrixError(ValueError):
    """Some row does not hold every column exactly once."""


@dataclass
class CellMatrix:
    """Checked ``cells(row_id, col_id, feat)`` for the many passes of a fit.

    Rows of bounded size are kept whole: ``packs(row_id, feats)`` holds the features of all
    columns in the order of ``col_ids``. A pass of a fit is then local to each record, and
    a slice of the columns is a list of ``positions``.

    Wider rows stay in long form, hash partitioned by the longer side (``layout``). Labels
    of that side are joined by moving the labels only; labels of the shorter side are
    broadcast when their counted size allows it."""

    cells: DataFrame
    n_rows: int
    n_cols: int
    dim: int
    layout: str = "row_id"
    packs: DataFrame | None = None
    col_ids: np.ndarray | None = None
    positions: np.ndarray | None = None
    _pooled: tuple | None = field(default=None, repr=False)

    @staticmethod
    def prepare(cells: DataFrame, pack_bytes: int = PACK_BYTES) -> CellMatrix:
        """Check and keep the matrix. The source is read once and held only until the
        kept form is filled."""
        source = cells.select("row_id", "col_id", "feat").persist(StorageLevel.MEMORY_AND_DISK)
        try:
            return CellMatrix.kept(source, pack_bytes)
        finally:
            source.unpersist()

    @staticmethod
    def kept(source: DataFrame, pack_bytes: int) -> CellMatrix:
        widths = source.groupBy("row_id").agg(
            F.count(F.lit(1)).alias("width"), F.max(F.size("feat")).alias("dim"),
            F.min(whole_size(F.col("feat"))).alias("least_dim"),
        )
        seen = widths.agg(
            F.count(F.lit(1)).alias("n_rows"), F.min("width").alias("least"),
            F.max("width").alias("most"), F.max("dim").alias("dim"), F.min("least_dim").alias("least_dim"),
        ).first()
        if not seen.n_rows:
            raise ValueError("the matrix has no cells")
        if seen.least != seen.most:
            raise IncompleteMatrixError("rows have different numbers of cells")
        if seen.dim != seen.least_dim or seen.dim < 1:
            raise IncompleteMatrixError("cells have different numbers of features, or missing ones")
        n_bytes = seen.n_rows * seen.most * (8 * seen.dim + 32)
        parts = partitions_for(source.sparkSession, n_bytes)
        if seen.most * seen.dim * 8 <= pack_bytes:
            return CellMatrix.packed(source, seen.n_rows, seen.most, seen.dim, parts)
        columns = source.select("col_id").distinct().count()
        layout = "row_id" if seen.n_rows >= columns else "col_id"
        long = source.repartition(parts, layout).persist(StorageLevel.MEMORY_AND_DISK)
        long.count()
        shape = matrix_shape(long).first()
        if not shape.complete:
            long.unpersist()
            raise IncompleteMatrixError("every row must hold every column exactly once")
        return CellMatrix(long, shape.n_rows, shape.n_cols, seen.dim, layout)

    @staticmethod
    def packed(narrow: DataFrame, n_rows: int, width: int, dim: int, parts: int) -> CellMatrix:
        """Keep whole rows. A row holds at most ``width`` cells, which the caller counted."""
        ids = [r.col_id for r in narrow.select("col_id").distinct().limit(width + 1).collect()]
        if len(ids) != width:
            raise IncompleteMatrixError("rows hold different columns")
        col_ids = np.sort(np.array(ids, dtype=np.int64))
        entries = F.sort_array(F.collect_list(F.struct("col_id", "feat")))
        expected = number_array(col_ids, "bigint")
        complete = F.transform("entries", lambda e: e["col_id"]) == expected
        feats = F.flatten(F.transform("entries", lambda e: e["feat"]))
        packs = (
            narrow.repartition(parts, "row_id")
            .groupBy("row_id").agg(entries.alias("entries"))
            .select("row_id", F.when(complete, feats).alias("feats"))
            .sortWithinPartitions("row_id")
            .persist(StorageLevel.MEMORY_AND_DISK)
        )
        odd = packs.filter(
            F.col("feats").isNull() | (F.size("feats") != width * dim)
        ).count()
        if odd:
            packs.unpersist()
            raise IncompleteMatrixError(f"{odd} rows do not hold every column exactly once")
        positions = np.arange(width)
        view = pack_view(packs, col_ids, positions, dim)
        return CellMatrix(view, n_rows, width, dim, "row_id", packs, col_ids, positions)

    def release(self) -> None:
        (self.cells if self.packs is None else self.packs).unpersist()

    def columns(self) -> DataFrame:
        if self.packs is not None:
            ids = [(int(c),) for c in self.col_ids[self.positions]]
            return self.cells.sparkSession.createDataFrame(ids, "col_id bigint")
        return self.cells.select("col_id").distinct()

    def rows(self) -> DataFrame:
        if self.packs is not None:
            return self.packs.select("row_id")
        return self.cells.select("row_id").distinct()

    def beside_columns(self, col_table: DataFrame) -> DataFrame:
        """A table of one record per column, ready to be joined with the cells."""
        if self.layout == "col_id":
            return col_table.hint("shuffle_hash")
        return broadcast_if_small(col_table, self.n_cols, LABEL_BYTES)

    def beside_rows(self, row_table: DataFrame) -> DataFrame:
        """A table of one record per row, ready to be joined with the cells."""
        if self.layout == "row_id":
            return row_table.hint("shuffle_hash")
        return broadcast_if_small(row_table, self.n_rows, LABEL_BYTES)

    def col_labels(self, col_part: DataFrame) -> np.ndarray:
        """Column labels of a packed matrix in the order of its columns."""
        labels = {r.col_id: r.l for r in col_part.select("col_id", "l").collect()}
        return np.array([labels[int(c)] for c in self.col_ids[self.positions]])

    def col_part(self, labels: np.ndarray) -> DataFrame:
        ids = self.col_ids[self.positions]
        return self.cells.sparkSession.createDataFrame(
            [(int(c), int(l)) for c, l in zip(ids, labels)], "col_id bigint, l int"
        )

    def slice(self, col_part: DataFrame, l: int) -> CellMatrix:
        """Keep the columns of one column cluster; the rows stay where they are. Mean and loadings
        remain those of the whole matrix, so that models of slices have one dimension."""
        pooled = self.pooled()
        if self.packs is not None:
            wanted = [r.col_id for r in col_part.filter(F.col("l") == l).select("col_id").collect()]
            kept = self.positions[np.isin(self.col_ids[self.positions], wanted)]
            view = pack_view(self.packs, self.col_ids, kept, self.dim)
            return replace(self, cells=view, n_cols=len(kept), positions=kept, _pooled=pooled)
        wanted = col_part.filter(F.col("l") == l).select("col_id")
        width = wanted.count()
        kept = self.cells.join(self.beside_columns(wanted), "col_id", "left_semi")
        return replace(self, cells=kept, n_cols=width, _pooled=pooled)

    def pooled(self) -> tuple[np.ndarray, np.ndarray]:
        """Mean and covariance of all cells, from one pass about some first cell."""
        if self._pooled is None:
            if self.packs is not None:
                feats = np.array(self.packs.select("feats").first().feats)
                guess = feats.reshape(-1, self.dim)[self.positions].mean(axis=0)
                run = pack_moments(np.zeros(self.n_cols, dtype=int), guess, self.positions)
                sums = add_partial_sums(self.packs.select("feats").mapInArrow(run, SUMS_SCHEMA))
            else:
                guess = np.array(self.cells.select("feat").first().feat)
                everything = self.cells.select(F.lit(0).alias("l"), F.lit(0).alias("k"), "feat")
                sums = block_sums(everything, self.dim, guess)
            n, total, products = unpack_sums(sums.first().sums, self.dim)
            if n < 2:
                raise ValueError("at least two cells are needed")
            gap = total / n
            self._pooled = (guess + gap, (products - n * np.outer(gap, gap)) / (n - 1))
        return self._pooled

    def pooled_loadings(self, max_k: int = 20, threshold: float = 0.99) -> np.ndarray:
        return principal_axes(self.pooled()[1], max_k, threshold)


def whole_size(vector: Column) -> Column:
    """Number of entries of a vector; -1 if it or one of them is missing."""
    missing = vector.isNull() | F.exists(vector, lambda x: x.isNull())
    return F.when(missing, F.lit(-1)).otherwise(F.size(vector))


def pack_view(packs: DataFrame, col_ids: np.ndarray, positions: np.ndarray, dim: int) -> DataFrame:
    """The chosen columns of whole rows in long form."""
    entries = F.zip_with(
        number_array(col_ids[positions], "bigint"),
        number_array(positions * dim + 1, "int"),
        lambda col_id, start: F.struct(
            col_id.alias("col_id"), F.slice("feats", start, F.lit(dim)).alias("feat")
        ),
    )
    return packs.select("row_id", F.inline(entries))


def number_array(values: np.ndarray, kind: str) -> Column:
    """A constant array. Written as one text that Spark folds into one literal, which keeps
    the plan small for thousands of columns."""
    text = ",".join(str(int(v)) for v in values)
    return F.split(F.lit(text), ",").cast(f"array<{kind}>")


def wide_row_part(row_part: DataFrame, n_groups: int) -> DataFrame:
    """``(row_id, l, k)`` as one label array per row, ordered by l."""
    labels = [F.max(F.when(F.col("l") == l, F.col("k"))) for l in range(n_groups)]
    return row_part.groupBy("row_id").agg(F.array(*labels).alias("z"))


def long_row_part(row_labels: DataFrame) -> DataFrame:
    return row_labels.select("row_id", F.posexplode("z").alias("l", "k"))
