"""Steps of the block models on whole rows, for many fits at once.

Row labels are a pure function of a row's cells, the model, the column labels and the key
of the draw. A pass draws them again instead of storing them, so an iteration moves nothing
but sums: one record per column or block and task.

A fit is a generator that yields what it wants to know of the rows, a pass, and is sent the
answer. ``together`` takes the passes that all its fits wait for and answers them by one job, so
the jobs of a search grow with its iterations and not with its candidates. Fits on slices of
the columns share the rows of the whole matrix and go along."""

from __future__ import annotations

from collections.abc import Generator, Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.functions.draws import uniform, uniform_value
from cellweave.functions.kernels import pack_answers, pack_labels
from cellweave.operators.blocks import BlockMoments, log_or_lowest, moments_found
from cellweave.operators.matrix import CellMatrix
from cellweave.operators.model import BlockModel, EmptyClusterError
from cellweave.operators.ranks import first_of_each, uniform_rank
from cellweave.operators.stats import add_partial_sums, block_sums, unpack_sums
from cellweave.runtime import broadcast_if_small


@dataclass(frozen=True)
class RowDraw:
    """Everything the labels of a draw depend on. ``tags`` number the column clusters in the key of
    the draw, by default by their places."""

    model: BlockModel
    col_labels: np.ndarray
    shared: bool
    iteration: int
    sweep: int
    seed: int
    tags: tuple[int, ...] | None = None

    def arguments(self) -> tuple:
        log_props = [np.array([log_or_lowest(p) for p in props]) for props in self.model.row_props]
        return self.col_labels, self.model.scorers(), log_props, self.shared

    def keys(self) -> list[tuple]:
        """The keys of its uniforms, one for each group of rows."""
        groups = (0,) if self.shared else self.tags or tuple(range(self.model.n_cols))
        return [(l, self.iteration, self.sweep, self.seed) for l in groups]


@dataclass(frozen=True)
class Balanced:
    """Row labels of balanced groups in the order of a hash, for every column cluster."""

    row_clusters: tuple[int, ...]
    seed: int

    def keys(self) -> list[tuple]:
        return [(l, self.seed) for l in range(len(self.row_clusters))]


@dataclass(frozen=True)
class ColumnPass:
    """Asks for new column labels given the row labels of ``draw``."""

    matrix: CellMatrix
    draw: RowDraw

    def answer(self, found: dict) -> np.ndarray:
        """The driver sees one sum per column and column cluster; a packed matrix bounds their
        number. A sweep that empties a column cluster ends the try."""
        draw, matrix = self.draw, self.matrix
        scores = np.array([found[place, -1] for place in range(matrix.n_cols)])
        scores += [log_or_lowest(p) for p in draw.model.col_props]
        running = np.exp(scores - scores.max(axis=1, keepdims=True)).cumsum(axis=1)
        u = np.array([
            uniform_value("e", int(c), draw.iteration, draw.sweep, draw.seed)
            for c in matrix.col_ids[matrix.positions]
        ])
        labels = (running[:, :-1] < u[:, None] * running[:, -1:]).sum(axis=1)
        if len(np.unique(labels)) < draw.model.n_cols:
            raise EmptyClusterError("a column cluster has vanished")
        return labels


@dataclass(frozen=True)
class MomentPass:
    """Asks for the moments of the blocks of some row labels and ``col_labels``."""

    matrix: CellMatrix
    draw: RowDraw | Balanced
    col_labels: np.ndarray
    row_clusters: tuple[int, ...]

    def answer(self, found: dict) -> BlockMoments:
        shift = self.matrix.pooled()[0]
        if isinstance(self.draw, RowDraw) and self.draw.shared:
            expected = [self.row_clusters[0]] * len(self.row_clusters)
        else:
            expected = self.row_clusters
        return moments_found({block: unpack_sums(sums, len(shift)) for block, sums in found.items()}, shift, expected)


@dataclass(frozen=True)
class SamplePass:
    """Asks for count, sums and products of sampled cells of each block: for ``m`` random rows one
    random column of the matrix."""

    matrix: CellMatrix
    blocks: tuple[tuple[int, int], ...]
    m: int
    seed: int


Pass = ColumnPass | MomentPass | SamplePass
Steps = Generator[Pass, Any, Any]


def together(fits: Sequence[Steps]) -> list[Any]:
    """Run generators of passes side by side and return what each returns, in their order. An
    ``EmptyClusterError`` of a pass is raised in the fit that asked for it."""
    results: list[Any] = [None] * len(fits)
    waiting: dict[int, Pass] = {}

    def advance(i: int, go, *value) -> None:
        try:
            waiting[i] = go(*value)
        except StopIteration as end:
            waiting.pop(i, None)
            results[i] = end.value

    for i, steps in enumerate(fits):
        advance(i, next, steps)
    while waiting:
        asked = dict(waiting)
        for i, found in zip(asked, answers(list(asked.values())), strict=True):
            go = fits[i].throw if isinstance(found, EmptyClusterError) else fits[i].send
            advance(i, go, found)
    return results


def answers(passes: Sequence[Pass]) -> list[Any]:
    """The answers to passes, by one job for those over all rows and one for samples."""
    out: list[Any] = [None] * len(passes)
    kinds = {True: sample_answers, False: row_answers}
    for sampled, answer in kinds.items():
        stores: dict[int, list[int]] = {}
        for i, asked in enumerate(passes):
            if isinstance(asked, SamplePass) == sampled:
                stores.setdefault(id(asked.matrix.packs), []).append(i)
        for chosen in stores.values():
            for i, found in zip(chosen, answer([passes[i] for i in chosen]), strict=True):
                out[i] = found
    return out


def row_answers(passes: Sequence[ColumnPass | MomentPass]) -> list[Any]:
    matrix = passes[0].matrix
    u_keys: dict[tuple, int] = {}
    rank_keys: dict[tuple, int] = {}
    asked = []
    for number, wanted in enumerate(passes):
        draw, of_matrix = wanted.draw, wanted.matrix
        known = rank_keys if isinstance(draw, Balanced) else u_keys
        places = [known.setdefault(key, len(known)) for key in draw.keys()]
        labelling = (None, draw.row_clusters, places) if isinstance(draw, Balanced) else (draw.arguments(), None, places)
        if isinstance(wanted, ColumnPass):
            asked.append((number, of_matrix.positions, labelling, None, None))
        else:
            asked.append((number, of_matrix.positions, labelling, wanted.col_labels, of_matrix.pooled()[0]))
    u = [uniform("d", F.col("row_id"), *key) for key in u_keys]
    rows = matrix.packs.select("row_id", "feats", F.array(*u).cast("array<double>").alias("u"))
    if rank_keys:
        rows = rows.join(ranked_rows(matrix, list(rank_keys)).hint("shuffle_hash"), "row_id")
    else:
        rows = rows.withColumn("ranks", F.array().cast("array<bigint>"))
    partial = rows.select("feats", "u", "ranks").mapInArrow(
        pack_answers(asked, matrix.dim), "number int, a int, b int, sums array<double>"
    )
    found: list[dict] = [{} for _ in passes]
    for row in add_partial_sums(partial, ("number", "a", "b")).collect():
        found[row.number][row.a, row.b] = row.sums

    def answer(wanted: ColumnPass | MomentPass, sums: dict) -> Any:
        try:
            return wanted.answer(sums)
        except EmptyClusterError as error:
            return error

    return [answer(wanted, sums) for wanted, sums in zip(passes, found, strict=True)]


def ranked_rows(matrix: CellMatrix, keys: Sequence[tuple[int, int]]) -> DataFrame:
    """``(row_id, ranks)``: the place of every row in the order of each key ``(l, seed)``."""
    numbered = F.array(*[
        F.struct(F.lit(i).alias("i"), F.lit(l).alias("l"), F.lit(seed).alias("seed")) for i, (l, seed) in enumerate(keys)
    ])
    spread = matrix.rows().select("row_id", F.inline(numbered))
    u = uniform("r", F.col("row_id"), F.col("l"), F.col("seed"))
    ranked = uniform_rank(spread, ["i"], u, "row_id", "place", matrix.n_rows)
    places = F.transform(F.sort_array(F.collect_list(F.struct("i", "place"))), lambda x: x["place"])
    return ranked.groupBy("row_id").agg(places.alias("ranks"))


def sample_answers(passes: Sequence[SamplePass]) -> list[dict]:
    """``{(l, k): (n, sums, products)}`` of each pass. Rows are chosen once for every block, seed and
    number of rows; of a row and block each slice takes the column that comes first in it."""
    matrix = passes[0].matrix
    samples: dict[tuple, int] = {}
    slices: dict[bytes, int] = {}
    wanted: dict[int, set[int]] = {}
    views: dict[int, CellMatrix] = {}
    for p in passes:
        number = slices.setdefault(p.matrix.positions.tobytes(), len(slices))
        views.setdefault(number, p.matrix)
        for l, k in p.blocks:
            sample = samples.setdefault((l, k, p.seed, p.m), len(samples))
            wanted.setdefault(number, set()).add(sample)
    names = F.array(*[
        F.struct(*[F.lit(v).alias(n) for n, v in zip(("l", "k", "seed", "m"), key, strict=True)], F.lit(i).alias("sample"))
        for key, i in samples.items()
    ])
    spread = matrix.packs.select("row_id", F.inline(names))
    order = uniform("b", F.col("row_id"), F.col("l"), F.col("k"), F.col("seed"))
    most = max(key[3] for key in samples)
    chosen = first_of_each(spread, ["sample"], order, "row_id", most, "m")
    met = []
    for number, own in wanted.items():
        rows = broadcast_if_small(chosen.where(F.col("sample").isin(sorted(own))), most * len(own), 48)
        met.append(views[number].cells.join(rows, "row_id").withColumn("slice", F.lit(number)))
    cells = reduce(DataFrame.unionByName, met)
    column = F.struct(uniform("s", F.col("row_id"), F.col("col_id"), F.col("l"), F.col("k"), F.col("seed")), F.col("col_id"))
    picked = cells.groupBy("slice", "sample", "row_id").agg(F.min_by("feat", column).alias("feat"))
    sums = block_sums(picked.select(F.col("slice").alias("l"), F.col("sample").alias("k"), "feat"), matrix.dim, matrix.pooled()[0])
    found = {(r.l, r.k): unpack_sums(r.sums, matrix.dim) for r in sums.collect()}
    return [
        {(l, k): found[slices[p.matrix.positions.tobytes()], samples[l, k, p.seed, p.m]] for l, k in p.blocks}
        for p in passes
    ]


def drawn_rows(matrix: CellMatrix, draw: RowDraw) -> DataFrame:
    """``(row_id, z)``."""
    u = F.array(*[uniform("d", F.col("row_id"), *key) for key in draw.keys()])
    labels = pack_labels(draw.arguments(), matrix.positions, matrix.dim)
    return matrix.packs.select("row_id", labels(F.col("feats"), u).alias("z"))


def drawn_columns(matrix: CellMatrix, draw: RowDraw) -> np.ndarray:
    """Column labels given the row labels of ``draw``."""
    return alone(ColumnPass(matrix, draw))


def moments_of(
    matrix: CellMatrix, draw: RowDraw, col_labels: np.ndarray, row_clusters: Sequence[int]
) -> BlockMoments:
    """Block moments for the row labels of ``draw`` and new column labels."""
    return alone(MomentPass(matrix, draw, col_labels, tuple(row_clusters)))


def alone(wanted: Pass) -> Any:
    (found,) = answers([wanted])
    if isinstance(found, EmptyClusterError):
        raise found
    return found


def balanced_col_labels(matrix: CellMatrix, n_groups: int, seed: int) -> np.ndarray:
    """The labels of ``balanced_col_partition`` in the order of the columns of a packed matrix."""
    ids = matrix.col_ids[matrix.positions]
    order = np.lexsort((ids, [uniform_value("c", int(c), seed) for c in ids]))
    labels = np.empty(len(ids), dtype=int)
    labels[order] = np.arange(len(ids)) % n_groups
    return labels


def col_labels_from(matrix: CellMatrix, col_props: Sequence[float], seed: int) -> np.ndarray:
    """Column labels of a packed matrix drawn from the proportions alone."""
    running = np.cumsum([float(p) for p in col_props])
    u = np.array([uniform_value("e", int(c), 0, 0, seed) for c in matrix.col_ids[matrix.positions]])
    return (running[None, :-1] < u[:, None] * running[-1]).sum(axis=1)
