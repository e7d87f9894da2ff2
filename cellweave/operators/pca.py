"""Principal components of feature vectors."""

from __future__ import annotations

import numpy as np
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.operators.spectral import column_scale

MAX_K = 20
THRESHOLD = 0.99


def kept_components(explained: np.ndarray, threshold: float) -> int:
    """Smallest count whose explained variance reaches the threshold, else all."""
    reached = np.flatnonzero(np.cumsum(explained) >= threshold)
    return int(reached[0]) + 1 if len(reached) else len(explained)


def fixed_signs(axes: np.ndarray) -> np.ndarray:
    """Axes as rows, each turned so that its largest entry is positive."""
    largest = np.abs(axes).argmax(axis=1)
    signs = np.sign(axes[np.arange(len(axes)), largest])
    return axes * np.where(signs == 0, 1.0, signs)[:, None]


def principal_axes(
    cov: np.ndarray, max_k: int = MAX_K, threshold: float = THRESHOLD, count: int | None = None
) -> np.ndarray:
    """Loadings (components x features) of a covariance matrix. ``count`` fixes the number
    of components instead of the threshold."""
    values, vectors = np.linalg.eigh((cov + cov.T) / 2)
    values, axes = values[::-1].clip(min=0.0), vectors[:, ::-1].T
    total = values.sum()
    explained = values / total if total > 0 else values
    limit = min(max_k, len(values))
    kept = count if count is not None else kept_components(explained[:limit], threshold)
    return fixed_signs(axes[:kept])


def pca_threshold(
    df: DataFrame, vector: str, out: str, dim: int,
    max_k: int = MAX_K, threshold: float = THRESHOLD,
) -> tuple[DataFrame, np.ndarray]:
    """Scores in column ``out`` and loadings (components x features). The components are
    fitted once for the largest count and then cut."""
    fitted = (
        PCA(k=min(max_k, dim), inputCol="features", outputCol="scores")
        .fit(df.select(array_to_vector(vector).alias("features")))
    )
    kept = kept_components(fitted.explainedVariance.toArray(), threshold)
    loadings = fixed_signs(fitted.pc.toArray().T[:kept])
    return df.withColumn(out, project_column(vector, loadings)), loadings


def pooled_pca_loadings(
    df: DataFrame, vector: str, out: str, dim: int,
    max_k: int = MAX_K, threshold: float = THRESHOLD,
) -> tuple[DataFrame, np.ndarray]:
    """Standardised scores in ``out`` and the loadings."""
    scored, loadings = pca_threshold(df, vector, out, dim, max_k, threshold)
    return column_scale(scored, out, out, len(loadings)), loadings


def project_column(vector: str, loadings: np.ndarray) -> Column:
    """``loadings · vector``, not centred."""
    rows = []
    for row in loadings:
        terms = [F.get(vector, F.lit(i)) * F.lit(float(w)) for i, w in enumerate(row)]
        total = terms[0]
        for term in terms[1:]:
            total = total + term
        rows.append(total)
    return F.array(*rows)


def project_loadings(df: DataFrame, vector: str, out: str, loadings: np.ndarray) -> DataFrame:
    return df.withColumn(out, project_column(vector, loadings))
