"""A matrix with known clusters, made by Spark from ids and hashed noise."""

from pyspark.sql import functions as F

from cellweave.functions.draws import uniform


def noise(*parts):
    """Roughly normal: the sum of twelve uniforms less six."""
    total = uniform(*parts, 0)
    for i in range(1, 12):
        total = total + uniform(*parts, i)
    return total - 6


def label(index, sizes):
    """Cluster of an index when clusters of the given sizes follow each other."""
    column, edge = F.lit(0), 0
    for size in sizes[:-1]:
        edge += size
        column = column + (index >= edge).cast("int")
    return column


def planted(spark, row_sizes, col_sizes):
    """``(row_id, col_id, l, k)`` of every cell."""
    n, p = sum(row_sizes[0]), sum(col_sizes)
    grid = spark.range(n * p).select(
        F.floor(F.col("id") / p).cast("bigint").alias("row_id"), (F.col("id") % p).alias("col_id"))
    labelled = grid.withColumn("l", label(F.col("col_id"), col_sizes))
    k = F.lit(None).cast("int")
    for l, sizes in enumerate(row_sizes):
        k = F.when(F.col("l") == l, label(F.col("row_id"), sizes)).otherwise(k)
    return labelled.withColumn("k", k)


def feature_cells(spark, row_sizes, col_sizes, spread=0.4):
    """Two features around a centre per block."""
    cells = planted(spark, row_sizes, col_sizes)
    x = 4.0 * F.col("k") + spread * noise("x", F.col("row_id"), F.col("col_id"))
    y = 5.0 * F.col("l") - 2.0 * F.col("k") + spread * noise("y", F.col("row_id"), F.col("col_id"))
    return cells.withColumn("feat", F.array(x, y))


def series_cells(spark, row_sizes, col_sizes, points, noise_level):
    """Series whose frequency depends on the block."""
    cells = planted(spark, row_sizes, col_sizes)
    block = F.col("l") * 3 + F.col("k")
    noisy = F.array(*[
        F.sin((2 * block + 2) * (2 * 3.141592653589793 * t / points))
        + noise_level * noise("z", F.col("row_id"), F.col("col_id"), t)
        for t in range(points)
    ])
    times = F.array(*[F.lit((t + 1) / 100.0) for t in range(points)])
    return cells.withColumn("t", times).withColumn("x", noisy)
