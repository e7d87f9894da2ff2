"""Document fingerprints as Merkle trees over sections and paragraphs.

A section ends at a blank line, a paragraph at a line feed. A paragraph's node is the SHA-256
of its text, a section's node that of its paragraphs' nodes, the root that of its sections'
nodes. Each paragraph also has the digests of its phrases, so that two versions of a paragraph
can be compared. Everything is a column expression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellweave.llm.common import shuffle_partitions, stored
from cellweave.runtime import broadcast_if_small

SECTION, PARAGRAPH = "\n\n", "\n"
#: A phrase ends after one of these signs.
PHRASE = r"(?<=[.,;:!?|])"
ROWS_PER_BAND = (256, 16_384)


def node(children: Column) -> Column:
    """The node over an array of nodes; each has the same length, so the join is unambiguous."""
    return F.sha2(F.array_join(children, ""), 256)


def tree(text: Column) -> Column:
    """``root, sections, paragraphs, leaves``: the root, the nodes of the sections and, by
    section, of the paragraphs, and the distinct phrase digests of the whole text. A null text
    is an empty one, which has one empty section with one empty paragraph. Splitting keeps
    every character, so only equal texts have equal nodes."""
    value = F.coalesce(text, F.lit(""))
    sections = F.split(value, SECTION, -1)
    paragraphs = F.transform(
        sections, lambda s: F.transform(F.split(s, PARAGRAPH, -1), lambda p: F.sha2(p, 256))
    )
    above = F.transform(paragraphs, node)
    lines = F.split(value, PARAGRAPH, -1)
    leaves = F.flatten(
        F.transform(
            lines, lambda p: F.transform(F.split(p, PHRASE, -1), lambda x: F.xxhash64(F.trim(x)))
        )
    )
    return F.struct(
        node(above).alias("root"),
        above.alias("sections"),
        paragraphs.alias("paragraphs"),
        F.array_except(leaves, F.array(F.xxhash64(F.lit("")))).alias("leaves"),
    )


def likeness(left: Column, right: Column) -> Column:
    """1 if the roots are equal; otherwise the Dice share of the roots and distinct phrases that
    two trees have in common, which is below 1."""
    a = F.concat(F.array(F.xxhash64(left["root"])), left["leaves"])
    b = F.concat(F.array(F.xxhash64(right["root"])), right["leaves"])
    common = F.size(F.array_intersect(a, b))
    dice = 2.0 * common / (F.size(a) + F.size(b))
    return F.when(left["root"] == right["root"], 1.0).otherwise(dice)


def first_difference(left: Column, right: Column) -> Column:
    """``section, paragraph`` (from 0) where two trees first differ: the root is compared, then
    the sections, then the paragraphs of the first section that differs; null if equal."""

    def first(a: Column, b: Column) -> Column:
        differs = F.transform(F.arrays_zip(a.alias("a"), b.alias("b")), lambda x: ~x["a"].eqNullSafe(x["b"]))
        return F.array_position(differs, True).cast("int") - 1

    section = first(left["sections"], right["sections"])
    paragraph = first(
        F.coalesce(F.get(left["paragraphs"], section), F.array().cast("array<string>")),
        F.coalesce(F.get(right["paragraphs"], section), F.array().cast("array<string>")),
    )
    return F.when(
        left["root"] != right["root"],
        F.struct(section.alias("section"), paragraph.alias("paragraph")),
    )


def with_next(docs: DataFrame, id_col: str, columns: dict[str, Column]) -> DataFrame:
    """``docs`` with ``columns`` added, and with the same columns of the row that follows in the
    order of ``id_col`` under the prefix ``next_``; the last row is followed by the first.

    Ids are cut into bands of equal width, of some hundred to some thousand rows each. The
    first row of every band is also sent to the band before it, so one shuffle brings each row
    together with its successor. Rows without an id follow no row and have null there; they
    are spread by the hash of the row. Rows that share an id stay together."""
    spark = docs.sparkSession
    low, high, n = docs.agg(F.min(id_col), F.max(id_col), F.count(id_col)).first()
    rows = min(max(n // (16 * shuffle_partitions(spark)), ROWS_PER_BAND[0]), ROWS_PER_BAND[1])
    bands = max(1, n // rows)
    low, width = (low, (high - low) // bands + 1) if n else (0, 1)
    # Decimals, as the difference of two 64-bit ids may not fit into one.
    band = f"(cast(`{id_col}` as decimal(38,0)) - {low}) div cast({width} as decimal(38,0))"
    placed = docs.withColumn("_band", F.expr(band))
    everywhere = Window.partitionBy()
    firsts = stored(
        placed.where("_band is not null")
        .groupBy("_band")
        .agg(F.min(id_col).alias("_first"))
        .select(
            "_band",
            "_first",
            F.coalesce(
                F.lag("_band").over(Window.orderBy("_band")), F.max("_band").over(everywhere)
            ).alias("_to"),
        ),
        "bands",
    )
    here = F.struct(
        F.coalesce("_band", -1 - F.pmod(F.xxhash64(*docs.columns), F.lit(1 << 20))).alias("band"),
        F.lit(False).alias("guest"),
    )
    guest = F.struct(F.col("_to").alias("band"), F.lit(True).alias("guest"))
    sent = placed.join(broadcast_if_small(firsts, bands, 24), "_band", "left").select(
        *docs.columns,
        F.explode(
            F.when(F.col(id_col) == F.col("_first"), F.array(here, guest)).otherwise(F.array(here))
        ).alias("_at"),
    )
    met = sent.select(*docs.columns, "_at.band", "_at.guest").repartition("band")
    made = met.withColumns(columns)
    order = Window.partitionBy("band").orderBy("guest", id_col, *docs.columns)
    following = {
        f"next_{name}": F.when(F.col(id_col).isNotNull(), F.lead(name).over(order)) for name in columns
    }
    return made.withColumns(following).where("not guest").drop("band", "guest")


def edited(text: Column, following: Column) -> Column:
    """``text`` with the last half of its characters replaced by as many (or all) from the start
    of ``following``."""
    size = F.char_length(text)
    half = F.floor(size / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), size - half), F.substring(following, F.lit(1), half))


def fingerprint_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: ``id_col, n_chars``, the ``tree`` of its text, the ``edited``
    text (see ``edited``) with its tree, the likeness of the tree to that of the edited text
    (``near_edited``) and of the next row's text (``near_next``), and the place of the first
    difference from the edited text (``changed``).

    Null texts count as empty. A row without an id is followed by an empty text. Among rows
    that share an id the order is that of their texts; a table of one row is its own next.
    Texts are read whole; other columns are not read; an empty table gives an empty result."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    following = with_next(rows, "id", {"body": F.col("text"), "tree": tree(F.col("text"))})
    empty = F.coalesce("next_body", F.lit(""))
    changed = following.withColumn("edited", edited(F.col("text"), empty)).withColumn(
        "edited_tree", tree(F.col("edited"))
    )
    next_tree = F.coalesce("next_tree", tree(F.lit("")))
    return changed.select(
        F.col("id").alias(id_col),
        F.char_length("text").cast("bigint").alias("n_chars"),
        "tree",
        "edited",
        "edited_tree",
        likeness(F.col("tree"), F.col("edited_tree")).alias("near_edited"),
        likeness(F.col("tree"), next_tree).alias("near_next"),
        first_difference(F.col("tree"), F.col("edited_tree")).alias("changed"),
    )
