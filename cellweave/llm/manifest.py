"""A Merkle manifest of a dataset: a tree over the rows of every group, and one over the groups.

Rows are put in order and cut into blocks of a power of the fanout, so that every block is a
whole subtree. The blocks then get the rest of the tree by a butterfly exchange: in each round
aligned sets of fanout blocks swap the roots they have, and each of them hashes the common
parent itself and notes what it was given. After the last round each block has the root of its
group and the upper part of the proofs of its rows; nothing is sent back down. Everything is a
column expression."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellweave.llm.common import discard, stored
from cellweave.runtime import counted_broadcast

#: Rows of a block; a block is one record of about 0.2 MB while its subtree is made.
BLOCK_ROWS = 1024
#: Rounds of the exchange after which the blocks are stored and the plan begins anew.
ROUNDS_PER_PLAN = 8
STEP = "array<struct<before: string, after: string>>"


def digest(value: Column) -> Column:
    return F.sha2(value, 256)


def field(value: Column) -> Column:
    """``-`` for null, otherwise the number of UTF-8 bytes of the value as text, a colon and the
    text, so that fields side by side can be told apart."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    """The leaf of a row: the digest of its fields one after the other."""
    return digest(F.concat(*map(field, values)))


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf and the siblings on its path come to."""
    return F.aggregate(path, start, lambda node, s: digest(F.concat(s["before"], node, s["after"])))


def proof_digest(path: Column) -> Column:
    """The digest of all siblings of a path, level by level and from left to right."""
    return digest(F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), ""))


def in_order(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``at``, the place among the rows of the same ``key`` in the given order, and
    ``n``, their number, as a stored table.

    Rows are dealt out by ranges of key and order, so neither a large key nor repeated rows meet
    in one task (what ties in all columns is dealt out at random). Only one record per range
    and key is added up to find where a range begins."""
    keys = ["key", *order, "_spread"]
    dealt = rows.withColumn("_spread", F.rand(7)).repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = stored(dealt.drop("_spread").withColumn("_place", F.monotonically_increasing_id()), "in-order")
    part = F.shiftrightunsigned("_place", 33)  # the upper bits are the number of the partition
    counts = placed.groupBy("key", part.alias("part")).agg(F.min("_place").alias("first"), F.count(F.lit(1)).alias("rows"))
    same = Window.partitionBy("key")
    before = F.sum("rows").over(same.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("rows")
    starts = counts.select("key", "part", (before - F.col("first")).alias("shift"), F.sum("rows").over(same).alias("n"))
    starts = counted_broadcast(stored(starts, "ranges"), 96)
    return placed.withColumn("part", part).join(starts, ["key", "part"]).select(
        *rows.columns, (F.col("_place") + F.col("shift")).alias("at"), "n"
    )


def levels(fanout: int, rows: int) -> int:
    """The number of levels above ``rows`` leaves that make a whole subtree."""
    depth = 0
    while fanout**depth < rows:
        depth += 1
    if fanout < 2 or fanout**depth != rows:
        raise ValueError("a block holds a power of the fanout, which is at least 2")
    return depth


def with_levels(blocks: DataFrame, fanout: int, depth: int) -> DataFrame:
    """``blocks(items, whole)`` with the nodes of every level as ``nodes0`` to the root of the block
    in the last. A block that is a ``whole`` group ends with its single node; in others the last
    run of a level may be a single node, which is hashed by itself."""

    def parents(nodes: Column) -> Column:
        def parent(i: Column) -> Column:
            return digest(F.concat(*[F.coalesce(F.get(nodes, i * fanout + j), F.lit("")) for j in range(fanout)]))

        runs = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / fanout).cast("int"))
        return F.transform(runs, parent)

    made = blocks.withColumn("nodes0", F.col("items.leaf"))
    for k in range(depth):
        nodes = F.col(f"nodes{k}")
        ends = F.col("whole") & (F.size(nodes) == 1)
        made = made.withColumn(f"nodes{k + 1}", F.when(ends, nodes).otherwise(parents(nodes)))
    return made


def inner_path(i: Column, fanout: int, depth: int) -> Column:
    """The path of row ``i`` of a block to the block's root."""

    def step(k: int) -> Column:
        nodes, at = F.col(f"nodes{k}"), F.floor(i / fanout**k).cast("int")
        digit = at % fanout
        other = [F.coalesce(F.get(nodes, at - digit + j), F.lit("")) for j in range(fanout)]
        before = [F.when(digit > j, other[j]).otherwise("") for j in range(fanout - 1)]
        after = [F.when(digit < j, other[j]).otherwise("") for j in range(1, fanout)]
        made = F.struct(F.concat(*before).alias("before"), F.concat(*after).alias("after"))
        return F.when(~(F.col("whole") & (F.size(nodes) == 1)), made)

    return F.array_compact(F.array(*[step(k) for k in range(depth)])) if depth else F.array().cast(STEP)


def exchanged(blocks: DataFrame, fanout: int) -> DataFrame:
    """``key, block, path, root`` of ``blocks(key, block, n_blocks, node)``: the path of every block's
    node to the root of its key, by the butterfly exchange.

    In round r the blocks whose numbers differ in digit r alone, to the base of the fanout, swap
    their nodes, which are the roots of neighbouring subtrees of that level: at most fanout
    records meet, whatever the size of a key. Numbers up to the next power are filled with
    blocks without a node, which take part and carry on what they are given, so that every
    block finds a partner in each round. A round moves one small record per block."""
    most = blocks.agg(F.max("n_blocks")).first()[0] or 1
    powers = [1]
    while powers[-1] < most:
        powers.append(powers[-1] * fanout)
    full = F.element_at(F.filter(F.array(*[F.lit(p).cast("bigint") for p in powers]), lambda p: p >= F.col("n_blocks")), 1)
    state = blocks.withColumn("at", F.explode(F.sequence(F.col("block"), full - 1, F.col("n_blocks")))).select(
        "key", "block", "n_blocks", "at",
        F.when(F.col("at") == F.col("block"), F.col("node")).alias("node"),
        F.array().cast(STEP).alias("path"),
    )
    last = None
    for number, stride in enumerate(powers[:-1]):
        digit = F.floor(F.col("at") / stride) % fanout
        met = Window.partitionBy("key", F.floor(F.col("at") / (stride * fanout)), F.col("at") % stride)
        state = state.withColumn("digit", digit).withColumn(
            "met", F.sort_array(F.collect_list(F.struct("digit", "node")).over(met))
        )

        def joined(keep) -> Column:  # null nodes are passed over
            return F.array_join(F.transform(F.filter("met", keep), lambda m: m["node"]), "")

        every = joined(lambda m: F.lit(True))
        step = F.struct(
            joined(lambda m: m["digit"] < F.col("digit")).alias("before"),
            joined(lambda m: m["digit"] > F.col("digit")).alias("after"),
        )
        going = F.col("n_blocks") > stride
        state = state.select(
            "key", "block", "n_blocks", "at",
            F.when(~going, F.col("node")).when(every != "", digest(every)).alias("node"),
            F.when(going, F.concat("path", F.array(step))).otherwise(F.col("path")).alias("path"),
        )
        if number % ROUNDS_PER_PLAN == ROUNDS_PER_PLAN - 1:
            state = stored(state, "exchange")
            if last is not None:
                discard(last)
            last = state
    return state.where("at = block").select("key", "block", "path", F.col("node").alias("root"))


def paths(rows: DataFrame, order: list[str], fanout: int, block_rows: int) -> tuple[DataFrame, DataFrame]:
    """The blocks of ``rows(key, leaf, ...)`` in their order, with the items and the nodes of every
    level, and ``key, block, path, root`` of each block."""
    depth = levels(fanout, block_rows)
    placed = in_order(rows, order)
    item = F.struct("at", "leaf", *[c for c in rows.columns if c not in ("key", "leaf")])
    blocks = stored(
        placed.groupBy("key", F.floor(F.col("at") / block_rows).alias("block")).agg(
            F.max("n").alias("n"), F.sort_array(F.collect_list(item)).alias("items")
        ),
        "blocks",
    ).withColumn("whole", F.col("n") <= block_rows)
    made = with_levels(blocks, fanout, depth)
    n_blocks = F.floor((F.col("n") - 1) / block_rows) + 1
    nodes = made.select("key", "block", n_blocks.alias("n_blocks"), F.element_at(f"nodes{depth}", 1).alias("node"))
    return made, stored(exchanged(stored(nodes, "block-roots"), fanout), "upper-paths")


def manifest(
    docs: DataFrame,
    leaf_value: Column,
    id_col: str = "doc_id",
    group_col: str = "lang",
    carried: dict[str, Column] | None = None,
    fanout: int = 2,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``id_col, group_col, leaf, subroot, root, path`` and the ``carried`` columns for every row of
    ``docs``. ``path`` has the siblings of a node to its left and right on every level, up to the
    root; ``folded(leaf, path)`` is the root.

    The leaves of a group ascend by id (null first, ties by leaf, so that the tree does not depend
    on the order of the rows); while more than one node remains, every ``fanout`` of them become
    the digest of their hex digits side by side. What remains is the group's subroot. Subroots
    in the order of the group (null first, then by UTF-8 bytes) come to the root in the same way.
    Repeated rows are leaves each; null groups are one group; clashing names are not read; an
    empty table gives an empty result. ``block_rows`` is a power of the fanout and does not
    change the result."""
    extra = carried or {}
    key = F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit("-"))
    rows = docs.select(
        key.alias("key"), F.col(id_col).alias("id"), leaf_value.alias("leaf"),
        F.struct(F.col(group_col).alias("group"), *[value.alias(name) for name, value in extra.items()]).alias("with"),
    )
    blocks, upper = paths(rows, ["id", "leaf"], fanout, block_rows)
    groups = upper.where("block = 0").select(F.lit("").alias("key"), F.col("root").alias("leaf"), F.col("key").alias("group"))
    top_blocks, top_upper = paths(groups, ["group"], fanout, block_rows)
    tops = met(top_blocks, top_upper, fanout, levels(fanout, block_rows), group="group")
    tops = counted_broadcast(stored(tops, "group-paths"), 4096)
    above = upper.join(tops.select(F.col("group").alias("key"), F.col("path").alias("top"), F.col("root").alias("whole_root")), "key")
    above = above.select("key", "block", F.col("root").alias("subroot"), F.col("whole_root").alias("root"), F.concat("path", "top").alias("path"))
    found = met(
        blocks, above, fanout, levels(fanout, block_rows), id="id", group="with.group", leaf="leaf",
        **{f"with_{i}": f"with.{name}" for i, name in enumerate(extra)},
    )
    return found.select(
        F.col("id").alias(id_col), F.col("group").alias(group_col), "leaf", "subroot", "root", "path",
        *[F.col(f"with_{i}").alias(name) for i, name in enumerate(extra)],
    )


def met(blocks: DataFrame, above: DataFrame, fanout: int, depth: int, **named: str) -> DataFrame:
    """One record per item of ``blocks``, with the fields ``named``, its whole path, and the columns
    of ``above(key, block, path, ...)`` but for these."""

    def read(item: Column, name: str) -> Column:
        return reduce(lambda value, part: value[part], name.split("."), item)

    given = [c for c in above.columns if c not in ("key", "block", "path")]
    joined = blocks.join(above.withColumnRenamed("path", "upper"), ["key", "block"])
    items = F.transform(
        "items",
        lambda x, i: F.struct(
            *[read(x, name).alias(alias) for alias, name in named.items()],
            F.concat(inner_path(i, fanout, depth), F.col("upper")).alias("path"),
        ),
    )
    return joined.select(F.explode(items).alias("item"), *given).select("item.*", *given)
