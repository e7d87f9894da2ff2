"""Temperature mixing of sources.

Shares of tokens are raised to an exponent between 0 (all sources alike) and 1 (as they are),
which is bisected to meet a target; the weights become budgets of tokens, and each source is
read in seeded permutations until its budget is used, in blocks of the same mixture."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellweave.llm.common import WORD
from cellweave.llm.manifest import field
from cellweave.runtime import broadcast_if_small

#: Places of the exponent, and documents of one source that are ordered together.
PLACES, ROWS_PER_BAND = 6, 1024
#: 13 hex digits of an md5 make a number below 2^52.
HEX_DIGITS, SPAN = 13, float(1 << 52)


def word_tokens(text: Column) -> Column:
    """Words, and one for the end of the document: no document costs nothing."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint") + 1


def weights_at(tokens: Sequence[int], exponent: float) -> list[float]:
    """Normalised weights of sources with so many tokens."""
    total = sum(tokens)
    raised = [math.pow(n / total, exponent) for n in tokens]
    return [value / sum(raised) for value in raised]


def entropy(weights: Sequence[float]) -> float:
    return -sum(w * math.log(w) for w in weights if w > 0)


def whole_budget(tokens: Sequence[int], weights: Sequence[float]) -> float:
    """The least budget that uses every source whole at least once."""
    return max(n / w for n, w in zip(tokens, weights, strict=True))


def repetition(tokens: Sequence[int], weights: Sequence[float], budget: float | None) -> float:
    """How often the most repeated source is read."""
    size = whole_budget(tokens, weights) if budget is None else budget
    return max(size * w / n for n, w in zip(tokens, weights, strict=True))


def bisect_exponent(meets: Callable[[float], bool]) -> float:
    """The least exponent in [0, 1], to six places, from which on ``meets`` holds; 1 if it never
    does. ``meets`` turns from false to true once."""
    low, high = 0, 10**PLACES
    while low < high:
        middle = (low + high) // 2
        if meets(middle / 10**PLACES):
            high = middle
        else:
            low = middle + 1
    return low / 10**PLACES


def mixing_exponent(
    tokens: Sequence[int],
    target_entropy: float | None = None,
    max_repetition: float | None = None,
    budget: float | None = None,
) -> float:
    """The flattest mixture with at most ``target_entropy`` nats, or in which no source is read
    more than ``max_repetition`` times. A target out of reach gives the nearest mixture."""
    if (target_entropy is None) == (max_repetition is None):
        raise ValueError("give either target_entropy or max_repetition")
    if target_entropy is not None:
        return bisect_exponent(lambda a: entropy(weights_at(tokens, a)) <= target_entropy)
    return bisect_exponent(lambda a: repetition(tokens, weights_at(tokens, a), budget) <= max_repetition)


def drawn(*parts: Column) -> Column:
    """A number in [0, 1) that depends on the parts alone."""
    digits = F.substring(F.md5(F.concat_ws("|", *[part.cast("string") for part in parts])), 1, HEX_DIGITS)
    return F.conv(digits, 16, 10).cast("double") / SPAN


def source_budgets(
    docs: DataFrame,
    target_entropy: float | None,
    max_repetition: float | None,
    budget: float | None,
    block_tokens: int,
) -> DataFrame:
    """One row per source of ``docs(source, tokens)``: its number, name and tokens, the tokens it
    gets, epochs, bands and the number of blocks. Only these rows, one per source, reach the
    driver."""
    spark = docs.sparkSession
    rows = docs.groupBy("source").agg(F.sum("tokens").alias("n"), F.count(F.lit(1)).alias("docs")).collect()
    rows.sort(key=lambda row: (row["source"] is not None, row["source"]))
    kind = docs.schema["source"].dataType.simpleString()
    schema = f"number int, named {kind}, n bigint, budget bigint, weight double, epochs int, bands int, blocks int"
    if not rows:
        return spark.createDataFrame([], schema)
    tokens = [row["n"] for row in rows]
    weights = weights_at(tokens, mixing_exponent(tokens, target_entropy, max_repetition, budget))
    size = whole_budget(tokens, weights) if budget is None else budget
    blocks = max(1, math.ceil(size / block_tokens))
    table = []
    for number, (row, weight) in enumerate(zip(rows, weights, strict=True)):
        share = math.floor(size * weight + 0.5)
        epochs, bands = -(-share // row["n"]), -(-row["docs"] // ROWS_PER_BAND)
        table.append((number, row["source"], row["n"], share, weight, epochs, bands, blocks))
    return broadcast_if_small(spark.createDataFrame(table, schema), len(table), 128)


def mixture(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    tokens: Column | None = None,
    carried: Sequence[str] = (),
    target_entropy: float | None = None,
    max_repetition: float | None = None,
    budget: float | None = None,
    block_tokens: int = 1_000_000,
    seed: int = 42,
) -> DataFrame:
    """``id_col, source_col, tokens, epoch, block, position`` and the ``carried`` columns: the documents
    in the order of training, a row for each time one is read.

    ``tokens`` is what a document costs (by default its words and one). Without ``budget`` every
    document is read at least once; with it, a source may end before its last document, which
    is the feature, and one whose budget comes to less than half a token is not read at all. In an epoch each source has a new seeded order; a document belongs to the
    block that its first token falls into, and blocks hold the sources in the same proportion,
    mixed by ``position``.

    A null source is a source of its own; null and empty texts cost one token; repeated rows and
    null ids are documents like any other, equal draws being ordered by id and tokens; clashing
    names are not read; an empty table gives an empty result. A large source is ordered in
    bands of about a thousand documents, whose sums are added up first, so no task sees more
    of it than a few bands."""
    cost = word_tokens(F.col("text")) if tokens is None else tokens
    rows = docs.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"), cost.alias("tokens"), *carried
    )
    budgets = source_budgets(rows, target_entropy, max_repetition, budget, block_tokens)
    read = rows.join(budgets, F.col("source").eqNullSafe(F.col("named")))
    epochs = read.where("epochs > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("epochs") - 1)))
    key = F.coalesce(F.col("id").cast("string"), F.lit(""))
    ordered = epochs.withColumn("u", drawn(F.lit(seed), F.col("epoch"), key)).withColumn(
        "band", F.floor(F.col("u") * F.col("bands")).cast("int")
    )
    band = ["number", "epoch", "band"]
    before = (
        Window.partitionBy("number", "epoch").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    )
    starts = (
        ordered.groupBy(*band)
        .agg(F.sum("tokens").alias("sum"))
        .select(*band, F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("start"))
    )
    inside = (
        Window.partitionBy(*band).orderBy("u", "id", "tokens", *carried).rowsBetween(Window.unboundedPreceding, -1)
    )
    placed = (
        ordered.withColumn("inside", F.coalesce(F.sum("tokens").over(inside), F.lit(0)))
        .join(starts, band)
        .withColumn("at", F.col("epoch") * F.col("n") + F.col("start") + F.col("inside"))
        .where(F.col("at") < F.col("budget"))
        .withColumn("block", F.floor(F.col("at") / (F.col("budget") / F.col("blocks"))).cast("int"))
        .withColumn("v", drawn(F.lit(seed), F.lit("block"), F.col("epoch"), key))
    )
    within = Window.partitionBy("block").orderBy("v", "id", "tokens", "epoch", *carried)
    return placed.select(
        F.col("id").alias(id_col),
        F.col("source").alias(source_col),
        "tokens",
        "epoch",
        "block",
        (F.row_number().over(within) - 1).cast("int").alias("position"),
        *carried,
    )


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` as often and in the order that ``mixture`` says, with its ``tokens, epoch,
    block, position``. The plan is made of ids, sizes and a 128-bit digest of each row; whole rows
    are moved once. Rows that are alike in all columns are read as often as they are there."""
    key = F.md5(F.concat(*[field(F.col(name)) for name in docs.columns]))
    plan = mixture(docs.withColumn("_row", key), id_col, carried=["_row"], **options)
    rows = docs.withColumn("_row", key).dropDuplicates(["_row"])
    added = plan.select("_row", "tokens", "epoch", "block", "position")
    return rows.join(added, "_row").drop("_row")
