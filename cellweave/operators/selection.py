"""Choosing the numbers of clusters by ICL."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from itertools import combinations_with_replacement, count, product

import numpy as np
from pyspark.sql import DataFrame

from cellweave.operators.blocks import block_moments, draw_rows, likelihood_of
from cellweave.operators.fit import (
    FitResult,
    Settings,
    best_of,
    clbm_settings,
    fit,
    lbm_settings,
    multi_start,
    multi_starts,
    penalties,
)
from cellweave.operators.matrix import CellMatrix
from cellweave.operators.model import BlockModel, EmptyClusterError, lbm_to_clbm, update_model
from cellweave.operators.packed import MomentPass, RowDraw, Steps, drawn_rows, together
from cellweave.runtime import checkpoint

# Fixed values of the searches.
LARGEST_RANGE = 5
GRID = {"update_loadings": 3, "max_tries": 10}
LBM_GRID = {"iterations": 7, "burn_in": 7, "update_loadings": 3, "max_tries": 10}
LBM_FIRST = {"iterations": 7, "burn_in": 7, "update_loadings": "never", "max_tries": 10}
LBM_NEXT = {"iterations": 5, "burn_in": 5, "update_loadings": 4, "max_tries": 10}
FINAL = {"iterations": 7, "burn_in": 7, "update_loadings": 3, "max_tries": 10}


def row_cluster_candidates(range_k: Sequence[int], range_l: Sequence[int]) -> list[tuple[int, ...]]:
    """Every multiset of L numbers from 1..K, for all K and L of the ranges, once each."""
    seen: dict[tuple[int, ...], None] = {}
    for k, l in product(range_k, range_l):
        for combination in combinations_with_replacement(range(1, k + 1), l):
            seen.setdefault(combination)
    return list(seen)


def clbm_grid_searches(
    matrices: Sequence[CellMatrix], range_k: Sequence[int], range_l: Sequence[int], n_starts: int = 1,
    with_security: bool = True, width: int = 4, **options,
) -> list[FitResult]:
    """A grid search on each matrix, all fits of all of them together."""
    candidates = row_cluster_candidates(range_k, range_l)
    if with_security and max(*range_k, *range_l) > LARGEST_RANGE:
        raise ValueError(
            f"{len(candidates)} combinations would be fitted; set with_security=False to do so"
        )
    tasks = [(m, clbm_settings(c, **{**GRID, **options})) for m in matrices for c in candidates]
    found = multi_starts(tasks, n_starts, width)
    size = len(candidates)
    return [best_of(found[i : i + size], lambda r: r.icl) for i in range(0, len(found), size)]


def clbm_grid_search(
    matrix: CellMatrix, range_k: Sequence[int], range_l: Sequence[int], n_starts: int = 1,
    with_security: bool = True, width: int = 4, **options,
) -> FitResult:
    """Fit every combination and keep the greatest ICL, the first on ties. Ranges above 5 are
    refused unless ``with_security`` is turned off."""
    return clbm_grid_searches([matrix], range_k, range_l, n_starts, with_security, width, **options)[0]


def lbm_grid_search(
    matrix: CellMatrix, range_k: Sequence[int], range_l: Sequence[int], n_starts: int = 3,
    width: int = 4, **options,
) -> FitResult:
    """The same over all pairs of numbers of row and column clusters."""
    tasks = [(matrix, lbm_settings(k, l, **{**LBM_GRID, **options})) for k, l in product(range_k, range_l)]
    return best_of(multi_starts(tasks, n_starts, width), lambda r: r.icl)


def lbm_greedy_search(
    matrix: CellMatrix, max_k: int, max_l: int, n_starts: int = 3, width: int = 4, **options
) -> FitResult:
    """From one block, add a row cluster or a column cluster, whichever has the better ICL,
    as long as it improves and the caps allow it."""
    current = multi_start(matrix, lbm_settings(1, 1, **{**LBM_FIRST, **options}), n_starts, width)
    k, l = 1, 1
    while True:
        steps = [(a, b) for a, b in ((k + 1, l), (k, l + 1)) if a <= max_k and b <= max_l]
        if not steps:
            return current
        tasks = [(matrix, lbm_settings(a, b, **{**LBM_NEXT, **options})) for a, b in steps]
        found = multi_starts(tasks, n_starts, width)
        # the column step wins a tie
        best = max(range(len(found)), key=lambda i: (found[i].icl, i))
        if found[best].icl <= current.icl:
            return current
        current, (k, l) = found[best], steps[best]


@dataclass(frozen=True)
class Part:
    """One column cluster of a model put together from parts: its columns, its blocks as a model,
    the number that its rows are drawn under, and the log-likelihood of its cells."""

    columns: frozenset[int]
    model: BlockModel
    tag: int
    loglik: float = 0.0


def column_sets(found: FitResult) -> list[frozenset[int]]:
    sets: list[set[int]] = [set() for _ in range(found.model.n_cols)]
    for row in found.col_part.collect():
        sets[row.l].add(row.col_id)
    return [frozenset(s) for s in sets]


def columns_of(parts: Sequence[Part], matrix: CellMatrix) -> DataFrame:
    """The column partition of some parts, in their order."""
    records = [(int(c), l) for l, part in enumerate(parts) for c in sorted(part.columns)]
    return matrix.cells.sparkSession.createDataFrame(records, "col_id bigint, l int")


def part_steps(matrix: CellMatrix, part: Part, seed: int) -> Steps:
    """The part with the log-likelihood of its cells, on rows drawn once for its blocks. Only its
    columns are read; a part with an empty row cluster has minus infinity."""
    columns = columns_of([part], matrix)
    piece = matrix.slice(columns, 0)
    try:
        if matrix.packs is None:
            rows = checkpoint(draw_rows(piece, columns, part.model, False, 0, 0, seed, [part.tag]))
            moments = block_moments(piece, rows, columns, part.model.row_clusters, False)
        else:
            labels = np.zeros(piece.n_cols, dtype=int)
            draw = RowDraw(part.model, labels, False, 0, 0, seed, (part.tag,))
            moments = yield MomentPass(piece, draw, labels, tuple(part.model.row_clusters))
    except EmptyClusterError:
        return replace(part, loglik=-np.inf)
    return replace(part, loglik=likelihood_of(part.model, moments))


def composed(
    matrix: CellMatrix, settings: Settings, model: BlockModel, parts: Sequence[Part]
) -> FitResult:
    """A model put together from parts, scored by what its parts have: the log-likelihoods of
    column clusters add up, as their rows are drawn independently."""
    loglik = sum(part.loglik for part in parts)
    counted, once = penalties(model, matrix, False)
    columns = columns_of(parts, matrix)
    tags = tuple(part.tag for part in parts)

    def rows() -> DataFrame:
        if matrix.packs is None:
            return draw_rows(matrix, columns, model, False, 0, 0, settings.seed, tags)
        return drawn_rows(matrix, RowDraw(model, matrix.col_labels(columns), False, 0, 0, settings.seed, tags))

    return FitResult(
        matrix.cells.sparkSession, "composed",
        replace(settings, row_clusters=tuple(model.row_clusters)), model, [model], rows,
        columns, [loglik], [loglik - counted], [loglik - once],
    )


def clbm_greedy_search(
    matrix: CellMatrix, range_k: Sequence[int], max_l: int, n_starts: int = 2,
    split_starts: int = 5, **options,
) -> FitResult:
    """From one block, try to cut each column cluster in two and accept the cut of the best
    overall ICL, as long as it improves and there are fewer than ``max_l`` column clusters.
    The best accepted model is returned, with the scores of the accepted ones before it.

    A cut changes the score by what its own columns have, so only they are read, for all new
    clusters at once; cuts of clusters that did not change are kept with their scores."""
    current = clbm_grid_search(matrix, [1], [1], n_starts, **options)
    if current.status == "failed":
        return current
    seed, tags = current.settings.seed, count(1)
    parts = [Part(column_sets(current)[0], current.model, 0)]
    cuts: dict[frozenset[int], tuple[BlockModel, list[Part]] | None] = {}
    while len(parts) < max_l:
        fresh = [part for part in parts if part.columns not in cuts]
        wide = [part for part in fresh if len(part.columns) > 1]
        pieces = [matrix.slice(columns_of([part], matrix), 0) for part in wide]
        found = clbm_grid_searches(pieces, range_k, [2], split_starts, **options) if wide else []
        asked = []
        cuts |= {part.columns: None for part in fresh}
        for part, split in zip(wide, found, strict=True):
            if split.status != "failed":
                new = [Part(c, one_column_model(split.model, l), next(tags)) for l, c in enumerate(column_sets(split))]
                asked.append((part, split.model, new))
        scored = iter(together([part_steps(matrix, p, seed) for _, _, new in asked for p in new]))
        for part, model, new in asked:
            cuts[part.columns] = model, [next(scored) for _ in new]
        best = None
        for l, part in enumerate(parts):
            if cuts[part.columns] is None:
                continue
            model, new = cuts[part.columns]
            whole = update_model(current.model, l, model)
            candidate = composed(matrix, current.settings, whole, parts[:l] + parts[l + 1 :] + new)
            if best is None or candidate.icl > best[0].icl:
                best = candidate, parts[:l] + parts[l + 1 :] + new
        if best is None or best[0].icl <= current.icl:
            return current
        chosen, parts = best
        current = replace(
            chosen, logliks=current.logliks + chosen.logliks, icls=current.icls + chosen.icls,
            icls_blocks=current.icls_blocks + chosen.icls_blocks,
        )
    return current


def one_column_model(model: BlockModel, l: int) -> BlockModel:
    """The blocks of one column cluster as a model of its own."""
    return BlockModel(
        [model.row_props[l]], model.col_props[l : l + 1] / model.col_props[l],
        [model.means[l]], [model.covs[l]], [model.loadings[l]],
    )


def refined_after_lbm(
    matrix: CellMatrix, found: FitResult, range_k: Sequence[int], inner_starts: int,
    inner_tries: int, final_tries: int, **options,
) -> FitResult:
    """Read an LBM as a CLBM, search the row clusters again inside each column cluster, in all of
    them at once, and fit the result once more. A column cluster without a new model keeps its
    own."""
    if found.status == "failed":
        return found
    model = lbm_to_clbm(found.model)
    pieces = [matrix.slice(found.col_part, l) for l in range(model.n_cols)]
    inside = clbm_grid_searches(pieces, range_k, [1], inner_starts, **{**options, "max_tries": inner_tries})
    for inner in inside:
        # replaced clusters go to the end, so the next one to replace is always the first
        part = one_column_model(model, 0) if inner.status == "failed" else inner.model
        model = update_model(model, 0, part)
    final = {**FINAL, **options, "max_tries": final_tries}
    settings = clbm_settings(
        model.row_clusters, init="", model=model, col_part=found.col_part, **final)
    return fit(matrix, settings)


def clbm_after_lbm_grid(
    matrix: CellMatrix, range_k: Sequence[int], range_l: Sequence[int], n_starts: int = 2,
    inner_starts: int = 3, **options,
) -> FitResult:
    """LBM grid search, then the refinement above."""
    found = lbm_grid_search(matrix, range_k, range_l, n_starts, **{"max_tries": 7, **options})
    return refined_after_lbm(matrix, found, range_k, inner_starts, 15, 10, **options)


def clbm_after_lbm_greedy(
    matrix: CellMatrix, max_k: int, max_l: int, n_starts: int = 2, inner_starts: int = 3, **options
) -> FitResult:
    """LBM greedy search, then the refinement above."""
    found = lbm_greedy_search(matrix, max_k, max_l, n_starts, **{"max_tries": 7, **options})
    return refined_after_lbm(
        matrix, found, range(1, max_k + 1), inner_starts, 15, 15, **options)
