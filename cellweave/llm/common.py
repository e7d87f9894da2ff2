"""What the operators share: tables stored in the shared folder, partition counts, words."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.runtime import ensure_checkpoint_dir

#: White space of the operators that count words: the blank and \x09 to \x0D.
WORD = r"[^\x20\x09-\x0D]+"


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the folder of ``spark.checkpoint.dir``, which all executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, schema: str | None = None) -> DataFrame:
    """Write ``df`` as a table of the shared folder and read it from there: later steps see
    the same rows whichever executors are lost, and the table is computed once."""
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a table made by ``stored`` that nothing reads any more."""
    spark = df.sparkSession
    for folder in {file.rpartition("/")[0] for file in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def id_remainder(column: Column | str, modulus: int) -> Column:
    """crc32 of an id written as text, modulo ``modulus``; null ids count as empty text."""
    value = F.col(column) if isinstance(column, str) else column
    return F.crc32(F.coalesce(value.cast("string"), F.lit(""))) % modulus


def id_fraction(column: Column | str, salt: str) -> Column:
    """A number in [0, 1) that depends on the id and the salt alone."""
    value = F.col(column) if isinstance(column, str) else column
    spread = F.xxhash64(F.coalesce(value.cast("string"), F.lit("")), F.lit(salt))
    return F.pmod(spread, F.lit(1 << 52)).cast("double") / float(1 << 52)


def by_batch(
    function: Callable[[pa.RecordBatch], pa.RecordBatch],
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Lift a function of one Arrow batch to ``mapInArrow``; empty batches are passed over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield function(batch)

    return run


def text_slices(
    texts: pa.Array, limit: int = 1_000_000
) -> Iterator[tuple[int, int, list[str | None]]]:
    """Begin, end and values of slices of ``texts`` with about ``limit`` bytes each; a longer text
    stands alone. Only one slice at a time is turned into Python strings."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy()
    begin, size = 0, 0
    for i, n in enumerate(sizes):
        if i > begin and size + n > limit:
            yield begin, i, texts.slice(begin, i - begin).to_pylist()
            begin, size = i, 0
        size += n
    if begin < len(sizes):
        yield begin, len(sizes), texts.slice(begin).to_pylist()
