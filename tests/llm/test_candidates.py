"""Candidates of near copies come from SimHash balls too."""

import random

from test_duplicates import edits, found_groups, prose, slow_components, slow_groups

from cellweave.llm import simhash


def test_near_copies_are_looked_for_by_simhash_balls(spark, monkeypatch):
    asked = []
    links = simhash.ball_links
    monkeypatch.setattr(simhash, "ball_links", lambda fps, radius: asked.append(radius) or links(fps, radius))
    rng = random.Random(11)
    texts = []
    for i in range(0, 20, 2):
        words = prose(rng, 400).split()
        texts += [(i, " ".join(words)), (i + 1, " ".join(edits(rng, words, 1)))]
    expected, near = slow_groups(texts)
    assert near and found_groups(spark, texts) == expected
    assert asked == [2]


def test_what_simhash_links_meets_in_one_bucket(spark):
    prints = [(b"a", 0b0), (b"b", 0b11), (b"c", 0b1111), (b"d", 0b111 << 20), (b"e", 0b0), (b"e", 0b111 << 40)]
    table = spark.createDataFrame([(bytearray(n), fp) for n, fp in prints], "node binary, fp bigint")
    buckets = {}
    for row in simhash.ball_buckets(table).collect():
        buckets.setdefault(row.key, set()).add(bytes(row.node))
    assert sorted(map(sorted, buckets.values())) == [[b"a", b"b", b"c", b"e"], [b"d"], [b"e"]]


def test_edited_copies_of_one_set_are_dealt_out_in_proportion(spark, monkeypatch):
    """Copies on both sides of the threshold meet their original in one bucket and each other in more."""
    rows = {}

    def counted(df, name, schema=None, store=simhash.stored):
        table = store(df, name, schema)
        rows[name] = rows.get(name, 0) + table.count()
        return table

    monkeypatch.setattr(simhash, "stored", counted)
    rng = random.Random(12)
    sets = {b"hub": frozenset(range(200))}
    for i in range(120):
        gone = 1 + i % 40
        sets[b"%03d" % i] = frozenset(rng.sample(range(200), 200 - gone)) | set(range(1000 * i + 1000, 1000 * i + 1000 + gone))
    sets[b"120"] = sets[b"039"] - {39001} | {1}
    keys = {0: list(sets)} | {k: sorted({*rng.sample(sorted(sets), 60), b"039", b"120"} - {b"hub"}) for k in range(1, 6)}
    members = spark.createDataFrame(
        [(k, bytearray(n), len(sets[n])) for k, nodes in keys.items() for n in nodes], "key bigint, node binary, size bigint"
    )
    table = spark.createDataFrame([(bytearray(n), sorted(s)) for n, s in sets.items()], "node binary, shingles array<bigint>")
    found = {bytes(r.node): bytes(r.root) for r in simhash.bucket_links(members, table, 0.8).collect()}
    near = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9]
    assert {n: n for n in sets} | found == slow_components(sets, near)
    assert found[b"039"] == found[b"120"] == b"039"
    assert rows["lists"] <= 50 * len(sets)


def test_copies_without_their_original_are_dealt_out_in_proportion(spark, monkeypatch):
    """Some copies have nearly all their edits in common, and none is the text that all were made of."""
    rows = []

    def counted(df, name, schema=None, store=simhash.stored):
        table = store(df, name, schema)
        if name == "lists":
            rows.append(table.count())
        return table

    monkeypatch.setattr(simhash, "stored", counted)
    rng = random.Random(13)
    sets = {}
    for i in range(150):
        gone = set(rng.sample(range(200), 8 + i % 40))
        sets[b"%03d" % i] = frozenset(set(range(200)) - gone | {1000 + 1000 * e + rng.randrange(1000) for e in gone})
    for i in range(5):
        sets[b"twin%d" % i] = sets[b"%03d" % (35 + i)] - {max(sets[b"%03d" % (35 + i)])} | {10**6 + i}
    members = spark.createDataFrame([(1, bytearray(n), len(s)) for n, s in sets.items()], "key bigint, node binary, size bigint")
    table = spark.createDataFrame([(bytearray(n), sorted(s)) for n, s in sets.items()], "node binary, shingles array<bigint>")
    found = {bytes(r.node): bytes(r.root) for r in simhash.bucket_links(members, table, 0.8).collect()}
    near = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9]
    assert near and {n: n for n in sets} | found == slow_components(sets, near)
    assert sum(rows) <= 10 * len(sets)
