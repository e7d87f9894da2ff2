"""SimHash, components and repeated passages against brute force."""

import random

import numpy as np
import pytest
import xxhash

from cellweave.llm import simhash, suffixes
from cellweave.llm.components import components
from llm_tables import documents

WORDS = ["ab", "cde", "f", "ghi", "jk", "lmno", "p", "Qr", "stu", "vw", "é", "x,"]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(60)) for _ in range(n))


def slow_fingerprint(text, size=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    runs = [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(run, 42) for run in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(nodes, linked):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in linked:
        low, high = sorted((find(a), find(b)))
        root[high] = low
    return {n: find(n) for n in nodes}


def test_fingerprint_in_chunks_equals_bit_counts(monkeypatch):
    rng = random.Random(1)
    texts = [None, "", " \t\n", "One", "one two", "A\x0bb\x1cc", "a b", *[prose(rng, n) for n in (3, 7, 50, 400)]]
    expected = [slow_fingerprint(t) for t in texts]
    assert [simhash.fingerprint(t) for t in texts] == expected
    monkeypatch.setattr(simhash, "CHUNK", 16)
    assert [simhash.fingerprint(t) for t in texts] == expected


@pytest.mark.parametrize("radius", [0, 1, 2, 3])
def test_links_connect_all_pairs_within_the_radius(spark, radius):
    rng = random.Random(radius)
    base = [rng.getrandbits(64) for _ in range(4)]
    values = set(base)
    for value in base:
        for n in (1, 2, 3, 4, 5):
            values.add(value ^ sum(1 << b for b in rng.sample(range(64), n)))
            value ^= 1 << rng.randrange(64)
            values.add(value)
    signed = np.array(sorted(values), np.uint64).view(np.int64).tolist()
    fps = spark.createDataFrame([(v,) for v in signed], "fp bigint")
    links = [(r.fp, r.other) for r in simhash.ball_links(fps, radius).collect()]
    near = [(a, b) for a in signed for b in signed if a < b and bin((a ^ b) & (2**64 - 1)).count("1") <= radius]
    assert {tuple(sorted(p)) for p in links} <= set(near)
    assert slow_components(signed, links) == slow_components(signed, near)


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(2)
    long = prose(rng, 300).split()
    texts = [(0, None), (1, ""), (2, "  "), (3, "a b"), (3, "a b"), (4, "A  B"), (None, "a b"), (9, None)]
    for i in range(12):
        edited = list(long)
        if i % 2:
            edited[rng.randrange(300)] = "changed"
        texts.append((20 + i, " ".join(edited)))
    texts += [(50 + i, prose(rng, 40)) for i in range(10)]
    rows = simhash.near_duplicates(documents(spark, texts)).collect()
    assert len(rows) == len(texts)
    value = {i: slow_fingerprint(t) for i, t in texts if i is not None}
    near = [(a, b) for a in value for b in value if bin(value[a] ^ value[b]).count("1") <= 2]
    expected = slow_components(value, near)
    for row in rows:
        if row.doc_id is not None:
            assert row.fingerprint == f"{value[row.doc_id]:016x}"
            assert row.component_id == expected[row.doc_id]
    assert {r.component_id for r in rows if r.doc_id is None} == {3}
    assert simhash.near_duplicates(documents(spark, [])).collect() == []


def test_one_of_each_group_keeps_clean_and_unnamed_rows(spark):
    rng = random.Random(3)
    base = prose(rng, 200).split()
    copy = base[:100] + ["other"] + base[101:]
    texts = [(1, " ".join(base)), (2, " ".join(base).encode().upper().decode()), (3, " ".join(copy)), (3, " ".join(copy)),
             (4, prose(rng, 200)), (4, "twice"), (5, "single"), (5, "single"), (None, "x"), (None, "x"), (6, None), (7, "")]
    kept = simhash.one_of_each_group(documents(spark, texts))
    assert kept.columns == documents(spark, texts).columns
    ids = sorted((r.doc_id for r in kept.collect()), key=lambda i: (i is None, i))
    assert ids == [1, 4, 5, 6, None, None]


def shingle_set(text, size=5):
    words = tuple((text or "").encode().lower().split())
    return {words[i : i + size] for i in range(max(1, len(words) - size + 1))} if words else set()


def slow_groups(texts, similarity=0.8):
    sets = {i: shingle_set(t) for i, t in texts}
    near = [
        (a, b) for a in sets for b in sets
        if a < b and len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]) - 1e-9
    ]
    return slow_components(sets, near), near


def found_groups(spark, texts):
    return {r.doc_id: r.component_id for r in simhash.similar_groups(documents(spark, texts)).collect()}


def edits(rng, words, n):
    """``words`` with ``n`` changed ones, so far apart that each changes five shingles."""
    out = list(words)
    for at in rng.sample(range(5, len(words) - 5, 6), n):
        out[at] = f"new{rng.randrange(10**6)}"
    return out


def test_copies_in_a_bucket_of_other_orders_are_found(spark):
    rng = random.Random(5)
    texts = []
    for base in range(0, 40, 10):
        orders = [prose(rng, 200).split()]
        orders += [rng.sample(orders[0], 200) for _ in range(2)]
        near = edits(rng, orders[1], 2)
        texts += [(base + i, " ".join(orders[k])) for i, k in ((1, 0), (2, 1), (4, 2))]
        texts += [(base + 3, "  ".join(orders[1])), (base + 5, " ".join(near)), (base + 6, " ".join(orders[0][:150]))]
    expected, near = slow_groups(texts)
    assert expected[3] == 2 and expected[5] == 2 and len({expected[i] for i in (1, 2, 4, 6)}) == 4
    assert found_groups(spark, texts) == expected


@pytest.mark.parametrize("similarity", [0.3, 0.5, 0.8])
def test_all_links_of_one_bucket_are_kept(spark, similarity):
    """Whatever its hubs: sets of one bucket in chains, copies and strangers."""
    rng = random.Random(6)
    sets = {}
    for chain in range(5):
        for i in range(12):
            begin, width = chain * 1000 + i * rng.choice([1, 3]), rng.choice([10, 11, 14])
            sets[rng.randbytes(4)] = frozenset(range(begin, begin + width))
    sets |= {rng.randbytes(4): frozenset(rng.sample(range(9000), 12)) for _ in range(30)}
    members = spark.createDataFrame(
        [(key, bytearray(n), len(s)) for n, s in sets.items() for key in (1, 2)], "key bigint, node binary, size bigint"
    )
    table = spark.createDataFrame([(bytearray(n), sorted(s)) for n, s in sets.items()], "node binary, shingles array<bigint>")
    rows = simhash.bucket_links(members, table, similarity).collect()
    near = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]) - 1e-9]
    found = {n: n for n in sets} | {bytes(r.node): bytes(r.root) for r in rows}
    assert near and found == slow_components(sets, near)


def test_near_copies_at_the_threshold_are_found(spark):
    rng = random.Random(7)
    texts = []
    for i in range(60):
        words = prose(rng, rng.randrange(80, 200)).split()
        n = 1
        while (len(words) - 4 - 5 * (n + 1)) / (len(words) - 4 + 5 * (n + 1)) >= 0.8:
            n += 1
        texts += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(edits(rng, words, n)))]
    expected, near = slow_groups(texts)
    assert len(near) == 60
    assert found_groups(spark, texts) == expected


def test_texts_below_the_threshold_are_kept(spark):
    rng = random.Random(8)
    texts = []
    for i in range(60):
        words = prose(rng, 300).split()
        n = 7 + i % 5
        texts += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(edits(rng, words, n)))]
    line = prose(rng, 12) + " "
    texts += [(200 + i, line * 40 + prose(rng, 100)) for i in range(6)]
    expected, near = slow_groups(texts)
    assert near == []
    assert found_groups(spark, texts) == expected
    assert simhash.one_of_each_group(documents(spark, texts)).count() == len(texts)


def test_components_of_a_chain_a_star_and_loops(spark):
    chain = [(i, i + 1) for i in range(100, 140)]
    star = [(7, i) for i in range(8, 60)]
    links = [*chain, *star, (1, 1), (2, 3), (3, 2), (None, 4)]
    rows = components(spark.createDataFrame(links, "a bigint, b bigint"), "a", "b").collect()
    found = {r.node: r.root for r in rows}
    assert len(found) == len(rows)
    nodes = {n for link in [*chain, *star, (2, 3)] for n in link}
    assert found == slow_components(nodes, [*chain, *star, (2, 3)])


def slow_passages(texts, size):
    first, spans = {}, []
    for i, text in sorted({(i, t) for i, t in texts if i is not None and t is not None}):
        words, current = text.encode().split(), None
        for at in range(len(words) - size + 1):
            source = first.setdefault(tuple(words[at : at + size]), (i, at))
            if source != (i, at):
                if current and at <= current[2]:
                    current[2], current[3] = at + size, min(current[3], source[0])
                else:
                    current = [i, at, at + size, source[0]]
                    spans.append(current)
    return sorted(map(tuple, spans))


@pytest.mark.parametrize("size", [2, 5, 12, 50])
def test_repeated_passages_equal_brute_force(spark, size):
    rng = random.Random(size)
    parts = [prose(rng, n) for n in (size - 1, size, size + 1, 3 * size, 70)]
    texts = [(None, parts[3]), (1, None), (2, ""), (3, parts[3]), (3, parts[3]), (4, "a " * 150)]
    for i in range(5, 40):
        chosen = [rng.choice(parts) if rng.random() < 0.5 else prose(rng, rng.randrange(60)) for _ in range(4)]
        texts.append((i, "\n ".join(chosen)))
    rows = suffixes.repeated_passages(documents(spark, texts), min_words=size).collect()
    assert sorted(map(tuple, rows)) == slow_passages(texts, size)


def test_passages_are_cut_once(spark):
    passage = " ".join(f"w{i}" for i in range(60))
    texts = [(1, f"start {passage} end"), (2, f"é {passage}  tail\n"), (3, passage), (4, None), (5, ""), (None, passage)]
    docs = documents(spark, texts)
    cut = suffixes.cut_passages(docs, suffixes.repeated_passages(docs))
    assert cut.columns == docs.columns
    kept = {r.doc_id: (r.text, r.n_chars) for r in cut.collect()}
    assert kept == {
        1: (texts[0][1], len(texts[0][1])), 2: ("é   tail", 8), 4: (None, None), 5: ("", 0), None: (passage, len(passage)),
    }
    assert suffixes.repeated_passages(documents(spark, [])).collect() == []
