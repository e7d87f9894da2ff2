"""Connected components of a table of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.llm.common import discard, stored


def components(links: DataFrame, left: str, right: str) -> DataFrame:
    """``node, root`` for every node that has a link; ``root`` is the least node it reaches.

    A large star hangs the greater neighbours of a node on the least node it knows, a small
    star the lesser ones; both in turn, until nothing changes (about log n rounds). Only the
    links are shuffled. Minima are added up before the shuffle and stored before they are joined
    back to the links, so Spark may split the partitions of a hot node; after a large star a
    node has few lesser neighbours. Each round is stored and the one before deleted. Links with a null end and
    loops are passed over; repeated links count once."""
    a, b = F.col(left), F.col(right)
    edges = stored(
        links.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(),
        "links",
    )
    seen = signature(edges)
    while seen[0]:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Stored, so that the join is one of two plain tables, whose hot nodes Spark splits.
        nearest = stored(both.groupBy("u").agg(F.min("v").alias("m")), "nearest")
        large = (
            both.join(nearest, "u")
            .where("v > u")
            .select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
            .distinct()
        )
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(least, "u")
        small = (
            hung.select("u", F.col("m").alias("v"))
            .unionAll(hung.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")))
            .distinct()
        )
        fresh = stored(small, "links")
        now = signature(fresh)
        discard(edges)
        discard(nearest)
        edges = fresh
        if now == seen:
            break
        seen = now
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(roots)


def signature(edges: DataFrame) -> tuple[int, int]:
    """Number of links and a sum over them that tells two sets of links apart."""
    mixed = F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40))
    row = edges.agg(F.count(F.lit(1)), F.coalesce(F.sum(mixed), F.lit(0))).first()
    return int(row[0]), int(row[1])
