"""A corpus made ready for training in five stages, each by an operator of ``cellweave.llm``.

Near copies are grouped by the sets of their shingles, with candidates from SimHash balls, which
hold few of the pairs of similarity 0.8 (see README), and from least hashes for the rest. Every stage takes the documents its predecessor kept, written as Parquet and read again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.llm import decontaminate, language, mixing, simhash, suffixes
from cellweave.llm.common import stored

#: A text is rejected if no language has this much of it (score of ``label_languages``).
MIN_LANGUAGE = 0.3
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents with a recognised language; the model is learned from all labelled
    ones. Null texts and texts without letters go."""
    model = language.fit_language_model(docs, F.col("text"), F.col("lang"), F.col("doc_id"))
    return language.with_language(docs, model, min_score=MIN_LANGUAGE)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least id of each group of near copies, once. Documents
    without an id belong to no group and stay."""
    return simhash.one_of_each_group(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of 50 words or more that an earlier document, or an earlier place, already
    has. Documents of which nothing is left go; ``n_chars`` follows the text."""
    spans = suffixes.repeated_passages(docs, min_words=50)
    return suffixes.cut_passages(docs, spans)


def decontaminate_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold an item of the benchmark. Null and empty texts hold none and
    stay; rows that are alike share their fate; an empty benchmark drops nothing."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.without_contaminated(docs, decontaminate.Benchmark.of(items))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of training, mixed as flat as two readings of the rarest source
    allow: the columns of documents with tokens, epoch, block and position. Null and empty texts
    cost one token, a null source is a source, rows that are alike are read as often as they are
    there, and an empty table gives an empty result."""
    return mixing.mixed_documents(docs, max_repetition=2.0, block_tokens=200_000, seed=42)


STAGES: list[tuple[str, Stage]] = [
    ("language identification", identify_language),
    ("near duplicates", drop_near_duplicates),
    ("repeated passages", cut_repeated_passages),
    ("benchmark decontamination", decontaminate_documents),
    ("source mixing", mix_sources),
]

#: SQL cannot state the stages on languages, fingerprints and edit distances.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each one keeps is stored in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES = {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
