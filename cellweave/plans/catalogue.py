"""Every operator as a query over the given tables, with its SQL where SQL can say it."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.operators.matrix import CellMatrix
from cellweave.operators.spectral import spectral_features
from cellweave.plans import tables
from cellweave.plans.sql import MEASURES

Query = Callable[[SparkSession, str], DataFrame]

#: Matrices that a session keeps.
HELD_MATRICES = 4
PREPARED: OrderedDict[tuple[str, str, str], CellMatrix] = OrderedDict()
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def r6(column: Column | str) -> Column:
    value = F.col(column) if isinstance(column, str) else column
    return F.round(value, 6) + F.lit(0.0)


def big(column: Column | str) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast("bigint")


def entry_of(vector: str, i: int) -> Column:
    return F.get(vector, F.lit(i))


# Prepared matrices are kept per session: many queries read the same one.


def pairs_matrix(spark: SparkSession, sf_dir: str) -> CellMatrix:
    return prepared(spark.sparkContext.applicationId, sf_dir, "pairs", spark)


def spectral_matrix(spark: SparkSession, sf_dir: str) -> CellMatrix:
    return prepared(spark.sparkContext.applicationId, sf_dir, "spectral", spark)


def embedding_matrix(spark: SparkSession, sf_dir: str) -> CellMatrix:
    return prepared(spark.sparkContext.applicationId, sf_dir, "embedding", spark)


def measures_matrix(spark: SparkSession, sf_dir: str) -> CellMatrix:
    return prepared(spark.sparkContext.applicationId, sf_dir, "measures", spark)


def prepared(app: str, sf_dir: str, kind: str, spark: SparkSession) -> CellMatrix:
    """The matrix of a session, made on first use; the one not used for longest is released."""
    key = (app, sf_dir, kind)
    if key not in PREPARED:
        PREPARED[key] = prepare(sf_dir, kind, spark)
        if len(PREPARED) > HELD_MATRICES:
            (old_app, *_), oldest = PREPARED.popitem(last=False)
            if old_app == app:  # those of a session that has ended are gone with it
                oldest.release()
    PREPARED.move_to_end(key)
    return PREPARED[key]


def prepare(sf_dir: str, kind: str, spark: SparkSession) -> CellMatrix:
    sources = {
        "pairs": lambda: tables.events_pairs(spark, sf_dir),
        "spectral": lambda: spectral_features(tables.events_series(spark, sf_dir)),
        "embedding": lambda: tables.embedding_cells(spark, sf_dir),
        "measures": lambda: tables.measure_pairs(spark, sf_dir, MEASURES),
    }
    return CellMatrix.prepare(sources[kind]())
