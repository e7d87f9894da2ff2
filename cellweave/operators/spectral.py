"""From series to spectral feature vectors. Each step works inside a row, so none of them
shuffles; only the table-wide statistics are aggregated."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.functions.kernels import fourier, normalised_power
from cellweave.runtime import checkpoint

# Fixed values of the feature chain.
FLAT_SERIES_SD = 0.0001
GRID_POINTS = 30
LOG_OFFSET = 1.0
EDGE_SLACK = 1e-9


# A lambda runs once per element, and so would anything the optimizer folds into it. Values
# that belong to the whole series are therefore passed as a repeated second array.


def with_each(array: Column | str, value: Column, combine) -> Column:
    """Combine every element of ``array`` with one value that is computed once."""
    return F.zip_with(array, F.array_repeat(value, F.size(array)), combine)


def z_normalize(df: DataFrame, series: str, out: str, threshold: float = FLAT_SERIES_SD) -> DataFrame:
    """(x - mean) / sample sd per series; zeros when the sd does not exceed ``threshold``."""
    zero = F.lit(0.0)
    size = F.size(series)
    mean = F.aggregate(series, zero, lambda a, x: a + x) / size
    centred = df.withColumn("_centred", with_each(series, mean, lambda x, m: x - m))
    squares = F.aggregate("_centred", zero, lambda a, x: a + x * x)
    spread = F.when(size > 1, F.sqrt(squares / (size - 1))).otherwise(zero)
    scaled = with_each(
        "_centred", spread, lambda x, sd: F.when(sd > threshold, x / sd).otherwise(zero)
    )
    return centred.withColumn(out, scaled).drop("_centred")


def dft(df: DataFrame, series: str, out: str) -> DataFrame:
    """Discrete Fourier transform, struct ``(re, im)`` of the sums against cosine and sine
    for the bins 0..n/2."""
    return df.withColumn(out, fourier()(F.col(series)))


def dft_frequencies(df: DataFrame, series: str, step: str, out: str) -> DataFrame:
    """Frequency k / (n · step) of each bin."""
    bins = F.sequence(F.lit(0), F.floor(F.size(series) / 2).cast("int"))
    return df.withColumn(out, with_each(bins, F.size(series) * F.col(step), lambda k, d: k / d))


def periodogram(df: DataFrame, transformed: str, series: str, out: str) -> DataFrame:
    """Power (re² + im²) / n per bin, n being the length of the series."""
    re, im = F.col(transformed)["re"], F.col(transformed)["im"]
    squares = F.zip_with(re, im, lambda a, b: a * a + b * b)
    return df.withColumn(out, with_each(squares, F.size(series), lambda s, n: s / n))


def mean_frequency_step(df: DataFrame, freq: str) -> DataFrame:
    step = F.get(freq, F.lit(1)) - F.get(freq, F.lit(0))
    return df.agg(F.avg(step).alias("mean_step"))


def frequency_grid(df: DataFrame, freq: str, points: int = GRID_POINTS) -> DataFrame:
    """Common grid ``(i, frequency)``: multiples of the mean step strictly between the
    largest first and the smallest last frequency of the table. A point that differs from a
    bound by rounding only counts as lying on it."""
    step = F.get(freq, F.lit(1)) - F.get(freq, F.lit(0))
    bounds = df.agg(
        F.avg(step).alias("mean_step"),
        F.min(F.array_max(freq)).alias("upper"),
        F.max(F.array_min(freq)).alias("lower"),
    )
    candidates = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: i * F.col("mean_step"))
    return (
        bounds.withColumn("slack", F.col("mean_step") * EDGE_SLACK)
        .select("upper", "lower", "slack", F.posexplode(candidates).alias("i", "frequency"))
        .filter(
            (F.col("frequency") < F.col("upper") - F.col("slack"))
            & (F.col("frequency") > F.col("lower") + F.col("slack"))
        )
        .select("i", "frequency")
    )


def grid_values(df: DataFrame, freq: str, points: int = GRID_POINTS) -> list[float]:
    """The grid on the driver: at most ``points`` numbers."""
    rows = frequency_grid(df, freq, points).orderBy("i").collect()
    if not rows:
        raise ValueError("no grid frequency lies inside the range of every series")
    return [row.frequency for row in rows]


def linear_interpolation(
    df: DataFrame, freq: str, values: str, grid: Sequence[float], out: str
) -> DataFrame:
    """Values at the grid frequencies, between the two nearest of the ascending frequencies of a
    cell; null outside their range. A cell's frequencies need not be even nor begin at zero."""
    last = F.size(freq) - 2

    # Each step is bound to a lambda of its own, so a frequency is looked for once for each point.
    def place(g: Column) -> Column:
        return F.struct(g.alias("g"), (F.size(F.filter(freq, lambda f: f <= g)) - 1).alias("left"))

    def ends(s: Column) -> Column:
        at = F.least(s["left"], last)
        return F.struct(
            s["g"].alias("g"), s["left"].alias("left"), F.get(freq, at).alias("low"), F.get(freq, at + 1).alias("high"),
            F.get(values, at).alias("a"), F.get(values, at + 1).alias("b"),
        )

    def between(s: Column) -> Column:
        share = (s["g"] - s["low"]) / (s["high"] - s["low"])
        return F.when((s["left"] >= 0) & (s["g"] <= s["high"]), s["a"] * (1 - share) + s["b"] * share)

    points = F.array(*[F.lit(float(g)) for g in grid])
    return df.withColumn(out, F.transform(F.transform(F.transform(points, place), ends), between))


def log_scale(df: DataFrame, values: str, out: str, offset: float = LOG_OFFSET) -> DataFrame:
    return df.withColumn(out, F.transform(values, lambda x: F.log10(x + F.lit(offset))))


def column_scale(
    df: DataFrame, vector: str, out: str, dim: int, with_mean: bool = True, with_sd: bool = True
) -> DataFrame:
    """Standardise each vector position over the table (sample sd; a constant position is
    only centred). The two numbers per position come from one aggregation."""
    wanted = []
    for i in range(dim):
        x = F.get(vector, F.lit(i))
        wanted += [F.avg(x).alias(f"m{i}"), F.stddev_samp(x).alias(f"s{i}")]
    stats = df.agg(*wanted).first()

    def scaled(i: int) -> Column:
        value = F.get(vector, F.lit(i))
        mean, sd = stats[f"m{i}"], stats[f"s{i}"]
        if with_mean and mean is not None:
            value = value - F.lit(mean)
        return value / F.lit(sd) if with_sd and sd else value

    return df.withColumn(out, F.array(*[scaled(i) for i in range(dim)]))


def spectral_features(table: DataFrame) -> DataFrame:
    """Series table ``(decorators, time_from, time_to, time_step, series)`` to feature cells
    ``(row_id, col_id, feat)``: normalise, transform, power, common grid, log, standardise.

    The series are stored once, as both the grid and the powers read them, and so are the log
    powers, a few numbers per cell, as the scale is taken from them before they are scaled."""
    table = checkpoint(table)
    with_freq = dft_frequencies(table, "series", "time_step", "freq")
    grid = grid_values(with_freq, "freq")
    powered = with_freq.withColumn("power", normalised_power(FLAT_SERIES_SD)(F.col("series")))
    resampled = linear_interpolation(powered, "freq", "power", grid, "resampled")
    logged = checkpoint(log_scale(resampled, "resampled", "logged").select(
        F.element_at("decorators", "row_id").cast("bigint").alias("row_id"),
        F.element_at("decorators", "col_id").cast("bigint").alias("col_id"),
        "logged",
    ))
    return column_scale(logged, "logged", "feat", len(grid)).select("row_id", "col_id", "feat")
