"""SEM-Gibbs fits of the latent block model (LBM) and its conditional form (CLBM)."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace
from inspect import isgenerator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.operators import starts
from cellweave.operators.blocks import (
    SWEEPS,
    BlockMoments,
    block_moments,
    draw_cols_from_proportions,
    draw_rows,
    estimate_with_likelihood,
    likelihood_of,
    se_step,
)
from cellweave.operators.matrix import CellMatrix, long_row_part
from cellweave.operators.model import (
    BLOCK_SCHEMA,
    BlockModel,
    EmptyClusterError,
    clbm_penalty,
    lbm_penalty,
    mean_model,
)
from cellweave.operators.packed import (
    ColumnPass,
    MomentPass,
    RowDraw,
    Steps,
    col_labels_from,
    drawn_rows,
    together,
)
from cellweave.runtime import checkpoint, run_together

# The loop stops when the last two changes stay below this.
PRECISION = 1e-5
RETRY_SEED_STEP = 1009
START_SEED_STEP = 7919


@dataclass(frozen=True)
class Settings:
    """Parameters of a fit.

    ``row_clusters`` holds one number of row clusters per column cluster; with ``shared``
    rows (LBM) they are all equal. ``update_loadings`` is 'always', 'never' or the number of
    iterations after which the loadings follow the blocks. ``init`` names the start; with
    ``model`` given it must be empty."""

    row_clusters: tuple[int, ...]
    shared: bool = False
    iterations: int = 6
    burn_in: int = 6
    update_loadings: str | int = 0
    init: str = "random_partition"
    seed: int = 0
    max_tries: int = 20
    full_covariance: bool = True
    method: str = "SEMGibbs"
    max_components: int = 20
    threshold: float = 0.99
    per_block: bool = False
    center_divisor: str = "n"
    model: BlockModel | None = None
    col_part: DataFrame | None = field(default=None, repr=False)

    def __post_init__(self) -> None:
        if not self.row_clusters or any(k < 1 for k in self.row_clusters):
            raise ValueError(f"numbers of row clusters must be positive: {self.row_clusters}")
        if self.shared and len(set(self.row_clusters)) > 1:
            raise ValueError("shared rows need the same number of row clusters everywhere")
        if self.iterations < 1:
            raise ValueError("iterations must be positive")
        if self.burn_in < 0:
            raise ValueError("burn_in must not be negative")
        if not self.full_covariance:
            raise ValueError("only full covariances can be fitted")
        if self.method != "SEMGibbs":
            raise ValueError(f"unknown method {self.method!r}; only 'SEMGibbs' exists")
        if self.max_tries < 1:
            raise ValueError("max_tries must be positive")
        loading_start(self.update_loadings)
        if self.model is not None:
            if self.init:
                raise ValueError("give either a model or the name of a start, not both")
            if tuple(self.model.row_clusters) != tuple(self.row_clusters):
                raise ValueError(
                    f"the model has row clusters {self.model.row_clusters}, "
                    f"not {list(self.row_clusters)}"
                )
        else:
            known = starts.LBM_STARTS if self.shared else starts.CLBM_STARTS
            if self.init not in known:
                raise ValueError(f"unknown start {self.init!r}; use one of {sorted(known)}")


def loading_start(strategy: str | int) -> float:
    """Iteration after which loadings are updated."""
    if strategy == "always":
        return 0.0
    if strategy == "never":
        return float("inf")
    if isinstance(strategy, bool) or not str(strategy).isdigit():
        raise ValueError("update_loadings must be 'always', 'never' or an integer >= 0")
    return float(int(strategy))


def clbm_settings(row_clusters: Sequence[int] = (2, 2), **options) -> Settings:
    return Settings(tuple(row_clusters), **options)


def lbm_settings(k: int = 2, l: int = 2, **options) -> Settings:
    if k < 1 or l < 1:
        raise ValueError("k and l must be positive")
    defaults = {"iterations": 20, "burn_in": 20, "init": "random"}
    return Settings((k,) * l, shared=True, **{**defaults, **options})


@dataclass
class FitResult:
    """A fit as tables. ``status`` is 'converged', 'averaged' or 'failed'; a failed fit has
    scores of minus infinity and no labels. Row labels are drawn when they are asked for: of the
    many fits of a search only the chosen one needs them."""

    spark: SparkSession
    status: str
    settings: Settings
    model: BlockModel | None = None
    history: list[BlockModel] = field(default_factory=list)
    row_labels: DataFrame | Callable[[], DataFrame] | None = None
    col_part: DataFrame | None = None
    logliks: list[float] = field(default_factory=lambda: [-np.inf])
    icls: list[float] = field(default_factory=lambda: [-np.inf])
    icls_blocks: list[float] = field(default_factory=lambda: [-np.inf])

    @property
    def loglik(self) -> float:
        return self.logliks[-1]

    @property
    def icl(self) -> float:
        return self.icls[-1]

    def blocks(self) -> DataFrame:
        records = self.model.records() if self.model else []
        return self.spark.createDataFrame(records, BLOCK_SCHEMA)

    def blocks_history(self) -> DataFrame:
        records = [(i, *r) for i, model in enumerate(self.history) for r in model.records()]
        return self.spark.createDataFrame(records, "iter int, " + BLOCK_SCHEMA)

    def row_part(self) -> DataFrame:
        """``(row_id, l, k)``; with shared rows l is 0."""
        return long_row_part(self.labels())

    def labels(self) -> DataFrame:
        """``(row_id, z)``, stored once."""
        if callable(self.row_labels):
            self.row_labels = checkpoint(self.row_labels())
        return self.row_labels

    def trace(self) -> DataFrame:
        records = [
            (i, float(ll), float(icl), float(blocks))
            for i, (ll, icl, blocks) in enumerate(zip(self.logliks, self.icls, self.icls_blocks))
        ]
        return self.spark.createDataFrame(
            records, "iter int, loglik_cells double, icl double, icl_blocks double"
        )


def penalties(model: BlockModel, matrix: CellMatrix, shared: bool) -> tuple[float, float]:
    n, p, per_block = matrix.n_rows, matrix.n_cols, model.parameters()
    if shared:
        value = lbm_penalty(model.row_clusters[0], model.n_cols, n, p, per_block)
        return value, value
    return (
        clbm_penalty(model.row_clusters, n, p, per_block),
        clbm_penalty(model.row_clusters, n, p, per_block, count_blocks_once=True),
    )


class WholeRowSteps:
    """Passes over whole rows. An iteration is one pass per column draw and one for the block
    moments."""

    def __init__(self, matrix: CellMatrix, settings: Settings, seed: int, columns: np.ndarray | DataFrame):
        self.matrix, self.settings, self.seed = matrix, settings, seed
        self.labels = columns if isinstance(columns, np.ndarray) else matrix.col_labels(columns)
        self.draw: RowDraw | None = None

    def row_draw(self, model: BlockModel, iteration: int, sweep: int) -> RowDraw:
        return RowDraw(model, self.labels, self.settings.shared, iteration, sweep, self.seed)

    def moments(self) -> Steps:
        return (yield MomentPass(self.matrix, self.draw, self.labels, self.settings.row_clusters))

    def first_likelihood(self, model: BlockModel) -> Steps:
        self.draw = self.row_draw(model, 0, 0)
        return likelihood_of(model, (yield from self.moments()))

    def iterate(self, model: BlockModel, iteration: int) -> Steps:
        for sweep in range(1, SWEEPS + 1):
            self.draw = self.row_draw(model, iteration, sweep)
            self.labels = yield ColumnPass(self.matrix, self.draw)
        return (yield from self.moments())

    def result(self) -> tuple[Callable[[], DataFrame], DataFrame]:
        draw = self.draw
        return lambda: drawn_rows(self.matrix, draw), self.matrix.col_part(self.labels)


class LongSteps:
    """Joins and aggregations on the long table, for rows too wide to be kept whole. An
    iteration is three jobs: the chain of draws up to the last rows, the last columns, and
    the block moments."""

    def __init__(self, matrix: CellMatrix, settings: Settings, seed: int, col_part: DataFrame):
        self.matrix, self.settings, self.seed = matrix, settings, seed
        self.col_part = checkpoint(col_part)
        self.rows: DataFrame | None = None

    def moments(self) -> BlockMoments:
        return block_moments(
            self.matrix, self.rows, self.col_part, self.settings.row_clusters, self.settings.shared
        )

    def first_likelihood(self, model: BlockModel) -> Steps:
        yield from ()  # nothing to ask for: these steps run jobs of their own
        shared = self.settings.shared
        self.rows = checkpoint(
            draw_rows(self.matrix, self.col_part, model, shared, 0, 0, self.seed)
        )
        return likelihood_of(model, self.moments())

    def iterate(self, model: BlockModel, iteration: int) -> Steps:
        yield from ()
        self.rows, self.col_part = se_step(
            self.matrix, self.col_part, model, self.settings.shared, iteration, self.seed
        )
        return self.moments()

    def result(self) -> tuple[DataFrame, DataFrame]:
        return self.rows, self.col_part


def sem_gibbs(
    matrix: CellMatrix, model: BlockModel, columns: np.ndarray | DataFrame, settings: Settings, seed: int
) -> Steps:
    """Iterate draws and estimation until the likelihood settles or the iterations end. The
    likelihood of an iteration comes from the moments its model was estimated from."""
    shared = settings.shared
    kind = LongSteps if matrix.packs is None else WholeRowSteps
    steps = kind(matrix, settings, seed, columns)
    logliks, history = [-np.inf, (yield from steps.first_likelihood(model))], [model]
    components = model.dim
    update_after = loading_start(settings.update_loadings)

    def settled() -> bool:
        return (
            len(logliks) > 2
            and abs(logliks[-1] - logliks[-2]) < PRECISION
            and abs(logliks[-1] - logliks[-3]) < PRECISION
        )

    for iteration in range(1, settings.burn_in + settings.iterations + 1):
        moments = yield from steps.iterate(model, iteration)
        loadings = None if iteration > update_after else model.loadings
        model, loglik = estimate_with_likelihood(
            moments, matrix, shared, loadings,
            components, settings.per_block, settings.center_divisor,
        )
        logliks.append(loglik)
        history.append(model)
        if settled():
            break
    converged = settled()
    late = history[1 + settings.burn_in :] or history[-1:]
    penalty, penalty_blocks = penalties(model, matrix, shared)
    scores = logliks[1:]
    rows, col_part = steps.result()
    return FitResult(
        matrix.cells.sparkSession,
        "converged" if converged else "averaged",
        settings,
        history[-1] if converged else mean_model(late),
        history,
        rows,
        col_part,
        scores,
        [ll - penalty for ll in scores],
        [ll - penalty_blocks for ll in scores],
    )


def start(matrix: CellMatrix, settings: Settings, seed: int) -> Steps:
    """Initial model and column labels."""
    if settings.model is not None:
        if settings.col_part is None:
            props = settings.model.col_props
            if matrix.packs is None:
                return settings.model, draw_cols_from_proportions(matrix, props, seed)
            return settings.model, col_labels_from(matrix, props, seed)
        given = settings.col_part.select(F.count_distinct("l").alias("n")).first().n
        if given != len(settings.row_clusters):
            raise ValueError(f"the column partition has {given} clusters")
        return settings.model, settings.col_part
    known = starts.LBM_STARTS if settings.shared else starts.CLBM_STARTS
    begun = known[settings.init](matrix, settings, seed)
    return (yield from begun) if isgenerator(begun) else begun


def attempts(matrix: CellMatrix, settings: Settings) -> Steps:
    """One fit. A start that runs into an empty cluster is tried again with another seed, up
    to ``max_tries``; any other error is raised."""
    for attempt in range(settings.max_tries):
        seed = settings.seed + RETRY_SEED_STEP * attempt
        try:
            model, columns = yield from start(matrix, settings, seed)
            return (yield from sem_gibbs(matrix, model, columns, settings, seed))
        except EmptyClusterError:
            continue
    return FitResult(matrix.cells.sparkSession, "failed", settings)


def fit_all(tasks: Sequence[tuple[CellMatrix, Settings]], width: int = 4) -> list[FitResult]:
    """Independent fits. Those on whole rows go in step, so that all of them, whatever their models
    and columns, share each pass over the rows; those on long tables run from ``width`` threads."""
    for matrix, _ in tasks:
        matrix.pooled()
    found: list[FitResult | None] = [None] * len(tasks)
    packed = [i for i, (matrix, _) in enumerate(tasks) if matrix.packs is not None]
    for i, result in zip(packed, together([attempts(*tasks[i]) for i in packed]), strict=True):
        found[i] = result
    long = [i for i in range(len(tasks)) if i not in packed]
    for i, result in zip(long, run_together([lambda i=i: fit(*tasks[i]) for i in long], width), strict=True):
        found[i] = result
    return found


def fit(matrix: CellMatrix, settings: Settings) -> FitResult:
    return together([attempts(matrix, settings)])[0]


def best_of(results: Sequence[FitResult], score: Callable[[FitResult], float]) -> FitResult:
    """The result of the greatest score, the first on ties."""
    return max(results, key=score)


def started(matrix: CellMatrix, settings: Settings, n_starts: int) -> list[tuple[CellMatrix, Settings]]:
    """The same fit from several seeds."""
    if n_starts < 1:
        raise ValueError("n_starts must be positive")
    return [(matrix, replace(settings, seed=settings.seed + START_SEED_STEP * s)) for s in range(n_starts)]


def multi_starts(tasks: Sequence[tuple[CellMatrix, Settings]], n_starts: int, width: int = 4) -> list[FitResult]:
    """For each task the fit of the greatest last log-likelihood among its starts, all fits together."""
    found = fit_all([one for matrix, settings in tasks for one in started(matrix, settings, n_starts)], width)
    return [best_of(found[i : i + n_starts], lambda r: r.loglik) for i in range(0, len(found), n_starts)]


def multi_start(matrix: CellMatrix, settings: Settings, n_starts: int, width: int = 4) -> FitResult:
    """Several fits from different seeds; the greatest last log-likelihood wins."""
    return multi_starts([(matrix, settings)], n_starts, width)[0]


def clbm_fit(matrix: CellMatrix, row_clusters: Sequence[int] = (2, 2), **options) -> FitResult:
    return fit(matrix, clbm_settings(row_clusters, **options))


def lbm_fit(matrix: CellMatrix, k: int = 2, l: int = 2, **options) -> FitResult:
    return fit(matrix, lbm_settings(k, l, **options))
