"""Arrow batch functions: spectra, block densities and block moments.

Each one is a few numpy array operations on the batch Spark hands over."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql.functions import arrow_udf


def to_matrix(arr: pa.Array) -> np.ndarray:
    """Rows of a list column as a dense matrix; the lists of a batch share one length."""
    lengths = np.diff(arr.offsets.to_numpy())
    if len(lengths) and (arr.null_count or lengths.min() != lengths.max()):
        raise ValueError("all arrays of a table must have one length and no nulls")
    width = int(lengths[0]) if len(lengths) else 0
    values = arr.flatten()
    if values.null_count:
        raise ValueError("array values must not be null")
    return values.to_numpy(zero_copy_only=False).reshape(len(arr), width)


def to_lists(mat: np.ndarray) -> pa.Array:
    n, width = mat.shape
    offsets = np.arange(n + 1, dtype=np.int32) * width
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(mat).ravel()))


def standard_series(series: np.ndarray, threshold: float) -> np.ndarray:
    """(x - mean) / sd per series with the sample sd; a series whose sd does not exceed
    ``threshold`` becomes zeros."""
    if series.shape[1] < 2:
        return np.zeros_like(series)
    sd = series.std(axis=1, ddof=1, keepdims=True)
    flat = sd <= threshold
    centred = series - series.mean(axis=1, keepdims=True)
    return np.where(flat, 0.0, centred / np.where(flat, 1.0, sd))


def fourier() -> Callable:
    """Cosine and sine sums of each series for the bins 0..n/2."""

    @arrow_udf("struct<re:array<double>,im:array<double>>")
    def transform(series: pa.Array) -> pa.Array:
        bins = np.fft.rfft(to_matrix(series), axis=1)
        return pa.StructArray.from_arrays(
            [to_lists(bins.real), to_lists(-bins.imag)], ["re", "im"]
        )

    return transform


def normalised_power(threshold: float) -> Callable:
    """Normalise, transform and square in one pass over the batch."""

    @arrow_udf("array<double>")
    def power(series: pa.Array) -> pa.Array:
        x = to_matrix(series)
        bins = np.fft.rfft(standard_series(x, threshold), axis=1)
        return to_lists((bins.real**2 + bins.imag**2) / max(x.shape[1], 1))

    return power


# A block is scored through (map, offset, constant): the log density of x is
# constant - |map x - offset|^2 / 2.
Scorer = tuple[np.ndarray, np.ndarray, float]


def score(x: np.ndarray, scorer: Scorer) -> np.ndarray:
    linear, offset, constant = scorer
    return constant - 0.5 * ((x @ linear.T - offset) ** 2).sum(axis=1)


def all_block_scores(scorers: list[list[Scorer]]) -> Callable:
    """Log density of a cell under every block, in the order of (l, k)."""

    @arrow_udf("array<double>")
    def scores(feat: pa.Array) -> pa.Array:
        x = to_matrix(feat)
        columns = [score(x, scorer) for row in scorers for scorer in row]
        return to_lists(np.column_stack(columns))

    return scores


def row_block_scores(scorers: list[list[Scorer]]) -> Callable:
    """Log density of a cell under each row cluster of its own column cluster."""
    width = max(len(row) for row in scorers)

    @arrow_udf("array<double>")
    def scores(feat: pa.Array, l: pa.Array) -> pa.Array:
        x, labels = to_matrix(feat), l.to_numpy(zero_copy_only=False)
        out = np.zeros((len(labels), width))
        for label in np.unique(labels):
            rows = labels == label
            for k, scorer in enumerate(scorers[label]):
                out[rows, k] = score(x[rows], scorer)
        return to_lists(out)

    return scores


def column_block_scores(scorers: list[list[Scorer]]) -> Callable:
    """Log density of a cell under each column cluster, given its row's labels. ``z``
    holds one label per column cluster, or a single label shared by all."""

    @arrow_udf("array<double>")
    def scores(feat: pa.Array, z: pa.Array) -> pa.Array:
        x, labels = to_matrix(feat), to_matrix(z)
        out = np.zeros((len(x), len(scorers)))
        for l, row in enumerate(scorers):
            own = labels[:, l if labels.shape[1] > 1 else 0]
            for k in np.unique(own):
                rows = own == k
                out[rows, l] = score(x[rows], row[k])
        return to_lists(out)

    return scores


def own_block_score(scorers: list[list[Scorer]]) -> Callable:
    """Log density of a cell under the block it belongs to."""

    @arrow_udf("double")
    def scores(feat: pa.Array, l: pa.Array, k: pa.Array) -> pa.Array:
        x = to_matrix(feat)
        cols, rows = l.to_numpy(zero_copy_only=False), k.to_numpy(zero_copy_only=False)
        out = np.zeros(len(x))
        for label in np.unique(cols):
            for group in np.unique(rows[cols == label]):
                mask = (cols == label) & (rows == group)
                out[mask] = score(x[mask], scorers[label][group])
        return pa.array(out)

    return scores


def triangle_sums(x: np.ndarray) -> np.ndarray:
    """Count, sums and upper product triangle of the rows of ``x`` in one flat array."""
    products = (x.T @ x)[np.triu_indices(x.shape[1])]
    return np.concatenate([[len(x)], x.sum(axis=0), products])


def moment_record(totals: dict[tuple[int, int], np.ndarray]) -> pa.RecordBatch:
    keys = list(totals)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([key[0] for key in keys], pa.int32()),
            pa.array([key[1] for key in keys], pa.int32()),
            to_lists(np.stack([totals[key] for key in keys])),
        ],
        ["l", "k", "sums"],
    )


def partial_moments(shift: np.ndarray) -> Callable:
    """Sums of the shifted cells per block, added up over a whole partition so that only one
    record per block leaves the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            l = batch.column("l").to_numpy(zero_copy_only=False)
            k = batch.column("k").to_numpy(zero_copy_only=False)
            x = to_matrix(batch.column("feat")) - shift
            for key in set(zip(l.tolist(), k.tolist())):
                sums = triangle_sums(x[(l == key[0]) & (k == key[1])])
                totals[key] = totals[key] + sums if key in totals else sums
        if totals:
            yield moment_record(totals)

    return run


# -- whole rows -------------------------------------------------------------------------
# A pack holds all cells of a row, so everything below is local to a record.


def pack_cells(feats: pa.Array, positions: np.ndarray, dim: int) -> np.ndarray:
    """Rows x chosen columns x features."""
    flat = to_matrix(feats)
    return flat.reshape(len(flat), flat.shape[1] // dim, dim)[:, positions]


def pack_row_labels(
    x: np.ndarray, u: np.ndarray, col_labels: np.ndarray, scorers: list[list[Scorer]],
    log_props: list[np.ndarray], shared: bool,
) -> np.ndarray:
    """Draw the labels of each row: first index whose running weight reaches u."""
    n, _, dim = x.shape
    groups = []
    for l, row in enumerate(scorers):
        own = x[:, col_labels == l].reshape(-1, dim)
        sums = [score(own, scorer).reshape(n, -1).sum(axis=1) for scorer in row]
        groups.append(np.column_stack(sums))
    if shared:
        groups = [sum(groups)]
    labels = []
    for g, scores in enumerate(groups):
        scores = scores + log_props[g]
        running = np.exp(scores - scores.max(axis=1, keepdims=True)).cumsum(axis=1)
        labels.append((running[:, :-1] < u[:, [g]] * running[:, -1:]).sum(axis=1))
    return np.column_stack(labels)


def pack_labels(draw: tuple, positions: np.ndarray, dim: int) -> Callable:
    """Row labels of each pack as an array column."""

    @arrow_udf("array<int>")
    def labels(feats: pa.Array, u: pa.Array) -> pa.Array:
        x = pack_cells(feats, positions, dim)
        return to_lists(pack_row_labels(x, to_matrix(u), *draw).astype(np.int32))

    return labels


def pack_column_totals(x: np.ndarray, z: np.ndarray, scorers: list[list[Scorer]]) -> np.ndarray:
    """Each column's log densities under every column cluster, added up over the rows."""
    n, width, dim = x.shape
    total = np.zeros((width, len(scorers)))
    for l, row in enumerate(scorers):
        own = z[:, l if z.shape[1] > 1 else 0]
        for k in np.unique(own):
            part = x[own == k]
            scores = score(part.reshape(-1, dim), row[k])
            total[:, l] += scores.reshape(len(part), width).sum(axis=0)
    return total


def pack_block_sums(x: np.ndarray, z: np.ndarray, col_labels: np.ndarray, shift: np.ndarray) -> dict:
    """Count, sums and products of each block ``(l, k)``."""
    found = {}
    for l in np.unique(col_labels):
        own = z[:, l if z.shape[1] > 1 else 0]
        for k in np.unique(own):
            part = x[own == k][:, col_labels == l].reshape(-1, len(shift)) - shift
            found[int(l), int(k)] = triangle_sums(part)
    return found


def pack_moments(col_labels: np.ndarray, shift: np.ndarray, positions: np.ndarray) -> Callable:
    """The moments of column clusters whose rows all have label 0, added up over a partition."""
    dim = len(shift)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            if batch.num_rows:
                x = pack_cells(batch.column("feats"), positions, dim)
                add_sums(totals, pack_block_sums(x, np.zeros((len(x), 1), dtype=int), col_labels, shift))
        if totals:
            yield moment_record(totals)

    return run


def add_sums(totals: dict, fresh: dict) -> None:
    for key, sums in fresh.items():
        totals[key] = totals[key] + sums if key in totals else sums


def pack_answers(asked: list[tuple], dim: int) -> Callable:
    """What several passes ask of whole rows, in one pass over them.

    Each pass is ``(number, positions, labelling, col_labels, shift)``. A labelling is a draw with
    the places of its uniforms in the column ``u``, or sizes of balanced groups with the places
    of their ranks in the column ``ranks``. Without ``col_labels`` the answer is the sum of
    every column (records ``number, place, -1``), otherwise the moments of every block
    (``number, l, k``); both are added up over a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple[int, int, int], np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            u, ranks = to_matrix(batch.column("u")), to_matrix(batch.column("ranks"))
            chosen: dict[bytes, np.ndarray] = {}
            for number, positions, (draw, sizes, places), col_labels, shift in asked:
                key = positions.tobytes()
                if key not in chosen:
                    chosen[key] = pack_cells(batch.column("feats"), positions, dim)
                x = chosen[key]
                if draw is None:
                    z = ranks[:, places] % np.array(sizes)
                else:
                    z = pack_row_labels(x, u[:, places], *draw)
                if col_labels is None:
                    sums = pack_column_totals(x, z, draw[1])
                    add_sums(totals, {(number, place, -1): row for place, row in enumerate(sums)})
                else:
                    sums = pack_block_sums(x, z, col_labels, shift)
                    add_sums(totals, {(number, *block): row for block, row in sums.items()})
        if totals:
            yield answer_record(totals)

    return run


def answer_record(totals: dict[tuple[int, int, int], np.ndarray]) -> pa.RecordBatch:
    keys = [pa.array([key[i] for key in totals], pa.int32()) for i in range(3)]
    bounds = np.concatenate([[0], np.cumsum([len(v) for v in totals.values()])]).astype(np.int32)
    sums = pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(list(totals.values()))))
    return pa.RecordBatch.from_arrays([*keys, sums], ["number", "a", "b", "sums"])


# Workers receive these functions with the job, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
