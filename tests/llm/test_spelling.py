"""Spelling variants and the FM-index against all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest

from cellweave.llm import fmindex, spelling
from llm_tables import documents


def one_apart(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def slow_pairs(queries, words, first_half):
    found = set()
    for i, q in enumerate(queries):
        half = len(q) // 2
        for j, w in enumerate(words):
            if first_half:
                fits = w.startswith(q[:half]) and one_apart(q[half:], w[half:])
            else:
                rest = len(w) - (len(q) - half)
                fits = rest >= 0 and w.endswith(q[half:]) and one_apart(q[:half], w[:rest])
            if fits:
                found.add((i, j))
    return found


def slow_variants(counts, factor):
    near = {w: [x for x in counts if one_apart(w, x)] for w in counts}
    best = {w: min(near[w], key=lambda x: (-counts[x], x), default=None) for w in counts}
    form = {w: b if b is not None and counts[b] >= factor * counts[w] else None for w, b in best.items()}

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted((w, form[w], root(w), n, len(near[w]), counts[form[w]] if form[w] else None) for w, n in counts.items())


def some_words(rng, letters, n, longest):
    return sorted({"".join(rng.choice(letters) for _ in range(rng.randrange(1, longest))) for _ in range(n)})


@pytest.mark.parametrize("letters", ["a", "ab", "abcé", "ab日😀"])
def test_index_finds_all_words_with_one_half_and_one_error(letters):
    rng = random.Random(len(letters))
    for longest in (2, 4, 7, 12):
        words = some_words(rng, letters, 120, longest)
        rng.shuffle(words)
        queries = words + ["zab", "abz", "z", "", "q" * 5, "aab" * 3]
        index = fmindex.WordIndex(words)
        for first_half in (True, False):
            a, b = index.one_error(queries, first_half)
            assert set(zip(a.tolist(), b.tolist(), strict=True)) == slow_pairs(queries, words, first_half)


def test_both_searches_find_every_word_one_error_away():
    words = some_words(random.Random(5), "abc", 300, 9)
    index = fmindex.WordIndex(words)
    found = {pair for half in (True, False) for pair in zip(*map(list, index.one_error(words, half)), strict=True)}
    assert found == {(i, j) for i, a in enumerate(words) for j, b in enumerate(words) if one_apart(a, b)}


def test_rotations_of_a_ring_are_sorted():
    rng = random.Random(2)
    for text in ("0", "01", "0111111111", "0" + "12" * 40 + "0" + "12" * 41, "0" + "".join(rng.choice("123") for _ in range(300))):
        ring = fmindex.np.array(list(map(int, text)))
        order = fmindex.rotations(ring).tolist()
        assert [text[i:] + text[:i] for i in order] == sorted(text[i:] + text[:i] for i in range(len(text)))


def test_very_long_words():
    long = "ab" * 2500
    words = [long, long[:3000] + "c" + long[3000:], long[:100] + long[101:], "other"]
    index = fmindex.WordIndex(words)
    found = {pair for half in (True, False) for pair in zip(*map(list, index.one_error(words, half)), strict=True)}
    assert found == {(0, 1), (1, 0), (0, 2), (2, 0)}


def test_portions_bound_the_size_of_an_index(monkeypatch):
    monkeypatch.setattr(spelling, "INDEX_CELLS", 100)
    words = ["abc", "abd", "a" * 50, "b", "c"] * 3
    cut = list(spelling.portions(words))
    assert [i for a, b in cut for i in range(a, b)] == list(range(len(words)))
    assert all(b - a == 1 or sum(len(w) + 1 for w in words[a:b]) * 6 <= 100 for a, b in cut) and len(cut) > 3
    assert list(spelling.portions([])) == []


@pytest.mark.parametrize(("bits", "searches"), [(13, 1 << 16), (4, 1 << 16), (5, 20)])
def test_variants_equal_those_of_all_pairs(spark, monkeypatch, bits, searches):
    monkeypatch.setattr(spelling, "SHARD_BITS", bits)
    monkeypatch.setattr(spelling, "SEARCHES", searches)
    rng = random.Random(bits)
    words = some_words(rng, "abé", 250, 9) + some_words(rng, "xy", 60, 8) + ["pre" + w for w in some_words(rng, "ab", 80, 7)]
    counts = {w: int(10 ** rng.uniform(0.4, 5)) for w in words}
    counts |= {"chainab": 5, "chainabc": 50, "chainabcd": 500, "chainabcde": 5000, "tieword": 2, "tiewora": 20, "tieworz": 20}
    table = spark.createDataFrame([(n, w, "clash") for w, n in counts.items()], "n bigint, word string, near string")
    found = spelling.spelling_variants(table.select("word", "n"), factor=10).collect()
    assert sorted(map(tuple, found), key=repr) == sorted(slow_variants(counts, 10), key=repr)
    by_word = {r.word: r for r in found}
    assert by_word["chainab"].root == "chainabcde" and by_word["tieword"].form == "tiewora"


def test_null_empty_and_repeated_words(spark):
    rows = [(None, 5), ("", 5), ("abcdefg", 1), ("abcdefg", 1), ("abcdefh", 20), ("lone", None)]
    found = spelling.spelling_variants(spark.createDataFrame(rows, "word string, n bigint")).collect()
    assert sorted(map(tuple, found)) == [
        ("abcdefg", "abcdefh", "abcdefh", 2, 1, 20), ("abcdefh", None, "abcdefh", 20, 1, None), ("lone", None, "lone", None, 0, None),
    ]
    empty = spark.createDataFrame([], "word string, n bigint")
    assert spelling.spelling_variants(empty).collect() == []


def test_words_are_counted_with_planted_errors(spark, monkeypatch):
    rng = random.Random(9)
    words = ["Straßens", "CAFÉTERIA", "naïvement", "example", "Example", "x×y÷zabc", "short", "ÀÉÎÕÜÿ", "abcdefgh"]
    texts = [(i, " ".join(rng.choice(words) + rng.choice(["", ",", "1", "日"]) for _ in range(rng.randrange(60)))) for i in range(80)]
    texts += [(None, "example example"), (81, None), (82, ""), (83, "example"), (83, "example"), (84, "y" * 100_000 + " " + "y" * 100_000)]
    expected = Counter()
    for i, text in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            expected[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 3 == 0 else run] += 1
    expected = {w: n for w, n in expected.items() if len(w) >= 7 and n >= 2}
    found = spelling.word_counts(documents(spark, texts), drop_one_in=3)
    assert {r.word: r.n for r in found.collect()} == expected
    assert spelling.word_counts(documents(spark, texts).limit(0)).collect() == []
