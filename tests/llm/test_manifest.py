"""The Merkle manifest against a plain tree, with any fanout and size of blocks."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from cellweave.llm import manifest
from llm_tables import documents


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def slow_field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def slow_tree(nodes, fanout):
    """The root and, for every leaf, its siblings to the left and right by level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for path, i in zip(paths, at, strict=True):
            begin = i - i % fanout
            path.append(("".join(nodes[begin:i]), "".join(nodes[i + 1 : begin + fanout])))
        at = [i // fanout for i in at]
        nodes = [sha("".join(nodes[i : i + fanout])) for i in range(0, len(nodes), fanout)]
    return nodes[0], paths


def slow_manifest(rows, fanout):
    """``(id, group, leaf, subroot, root, path)`` of rows ``(id, text, group)``, in any order."""
    groups = {}
    for i, text, group in rows:
        groups.setdefault(group, []).append((i is not None, i or 0, sha(slow_field(i) + slow_field(text)), i))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: slow_tree([r[2] for r in sorted(groups[g], key=lambda r: r[:3])], fanout) for g in order}
    root, tops = slow_tree([trees[g][0] for g in order], fanout)
    found = []
    for g, top in zip(order, tops, strict=True):
        for r, path in zip(sorted(groups[g], key=lambda r: r[:3]), trees[g][1], strict=True):
            found.append((r[3], g, r[2], trees[g][0], root, tuple(path + top)))
    return found


def made(docs, fanout, block_rows):
    leaf = manifest.leaf(F.col("doc_id"), F.col("text"))
    return manifest.manifest(docs, leaf, carried={"claimed": F.col("text")}, fanout=fanout, block_rows=block_rows)


@pytest.mark.parametrize(("fanout", "block_rows"), [(2, 1), (2, 4), (3, 3), (5, 25), (2, 1024)])
def test_paths_and_roots_equal_those_of_a_plain_tree(spark, fanout, block_rows):
    rng = random.Random(block_rows)
    langs = [None, "", "-", "=", "en", "é", "zz", *["big"] * 9]
    rows = [(i, f"text {i}" * rng.randrange(3), rng.choice(langs)) for i in rng.sample(range(-500, 5000), 150)]
    rows += [(7000, None, "one"), (7001, "x" * 200_000, "big"), *[(7002, "same", "big")] * 5]
    rows += [(7003, "b", "big"), (7003, "a", "big"), (None, "no id", "big"), (None, None, None)]
    docs = documents(spark, [(i, t) for i, t, _ in rows]).drop("lang")
    by_text = spark.createDataFrame([(i, t, g) for i, t, g in rows], "doc_id bigint, text string, lang string")
    found = made(by_text.withColumns({c: F.lit("clash") for c in docs.columns if c not in by_text.columns}), fanout, block_rows)
    found = found.withColumn("up", manifest.folded(F.col("leaf"), F.col("path")))
    got = [
        (r.doc_id, r.lang, r.leaf, r.subroot, r.root, tuple((s.before, s.after) for s in r.path)) for r in found.collect()
    ]
    assert sorted(got, key=repr) == sorted(slow_manifest(rows, fanout), key=repr)
    assert all(r.up == r.root for r in found.collect())
    assert sorted(map(repr, (r.claimed for r in found.collect()))) == sorted(repr(t) for _, t, _ in rows)


def test_a_changed_row_folds_to_another_root(spark):
    docs = documents(spark, [(i, f"t{i}") for i in range(20)])
    found = made(docs, 2, 4).withColumn("wrong", manifest.folded(manifest.leaf(F.col("doc_id"), F.lit("?")), F.col("path")))
    assert all(r.wrong != r.root for r in found.collect())


def test_order_and_partitions_of_the_rows_do_not_matter(spark):
    rows = [(i % 30, f"t{i % 31}") for i in range(90)]
    random.Random(1).shuffle(rows)
    one = made(documents(spark, rows).repartition(5), 2, 8)
    other = made(documents(spark, rows[::-1]).coalesce(1), 2, 8)
    assert sorted(map(repr, one.collect())) == sorted(map(repr, other.collect()))


def test_one_row_and_no_rows(spark):
    (row,) = made(documents(spark, [(1, "a")]), 2, 4).collect()
    assert row.leaf == row.subroot == row.root == sha("1:11:a") and row.path == []
    assert manifest_digest(spark, row) == sha("")
    assert made(documents(spark, [(1, "a")]).limit(0), 2, 4).collect() == []


def manifest_digest(spark, row):
    step = spark.createDataFrame([(row.path,)], f"path {manifest.STEP}")
    return step.select(manifest.proof_digest(F.col("path"))).first()[0]


def test_blocks_hold_a_power_of_the_fanout(spark):
    with pytest.raises(ValueError, match="power"):
        made(documents(spark, [(1, "a")]), 2, 6)
    assert [manifest.levels(3, n) for n in (1, 3, 27)] == [0, 1, 3]
