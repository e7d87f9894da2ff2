"""Language, toxicity, extraction and decontamination."""

import random
from itertools import product

import numpy as np
import pytest

from cellweave.llm import chargrams, decontaminate, html_text, language, toxicity
from llm_tables import documents
from pyspark.sql import functions as F

ENGLISH = "the and of that with this from have which would there their about".split()
GERMAN = "der und nicht mit sich auf eine dass wird über für zwischen".split()
RUSSIAN = "это что как была который после только если время".split()


def line(rng, words, n):
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture(scope="module")
def model(spark):
    rng = random.Random(1)
    texts = [(i, line(rng, (ENGLISH, GERMAN, RUSSIAN)[i % 3], 40)) for i in range(60)]
    lang = {i: ("en", "de", "ru")[i % 3] for i in range(60)} | {99: None}
    docs = documents(spark, [*texts, (99, "nobody knows")], lang)
    return language.fit_language_model(docs, F.col("text"), F.col("lang"), F.col("doc_id"))


def test_languages_and_spans(spark, model):
    rng = random.Random(2)
    mixed = line(rng, ENGLISH, 20) + ". " + line(rng, GERMAN, 10) + " " + line(rng, RUSSIAN, 5)
    texts = [(1, line(rng, ENGLISH, 9)), (2, line(rng, GERMAN, 9)), (3, line(rng, RUSSIAN, 9)), (4, mixed), (4, mixed),
             (5, None), (6, ""), (7, "123 !? \n"), (None, line(rng, GERMAN, 8)), (8, line(rng, ENGLISH, 30_000)), (9, "漢字")]
    rows = language.label_languages(documents(spark, texts), model).collect()
    assert len(rows) == len(texts)
    found = {r.doc_id: r for r in rows}
    assert [found[i].lang_pred for i in (1, 2, 3, 4, 5, 6, 7, None, 8)] == ["en", "de", "ru", "en", "und", "und", "und", "de", "en"]
    assert found[9].lang_pred in model.languages
    assert all(0 <= r.score <= 1 for r in rows) and found[5].score == 0
    assert [s.lang for s in found[4].spans] == ["en", "de", "ru"]
    first, second, third = found[4].spans
    assert mixed[first.begin : first.end].split()[-1] in ENGLISH and mixed[third.begin : third.end].split()[0] in RUSSIAN
    kept = language.with_language(documents(spark, texts), model, min_score=0.7)
    assert kept.columns == documents(spark, texts).columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in rows if r.score >= 0.7)


def test_nothing_learned_gives_und(spark):
    docs = documents(spark, [(1, "some text"), (2, None)], {1: None, 2: None})
    empty = language.fit_language_model(docs, F.col("text"), F.col("lang"), F.col("doc_id"))
    rows = language.label_languages(docs, empty).collect()
    assert [(r.lang_pred, r.score, r.spans) for r in rows] == [("und", 0.0, [])] * 2
    assert language.label_languages(documents(spark, []), empty).collect() == []


def test_viterbi_equals_all_paths():
    rng = np.random.default_rng(3)
    sizes = [0, 1, 5, 3, 0, 6]
    scores = rng.normal(size=(sum(sizes), 3))
    first = np.cumsum(sizes) - sizes
    labels = language.viterbi(scores, first, np.array(sizes), 0.7)
    for begin, size in zip(first, sizes):
        def total(path):
            return sum(scores[begin + i, k] for i, k in enumerate(path)) - 0.7 * sum(a != b for a, b in zip(path, path[1:]))
        if size:
            best = max(product(range(3), repeat=size), key=total)
            assert total(labels[begin : begin + size]) == pytest.approx(total(best))


def test_grams_lie_in_words():
    hashes, owner = toxicity.word_grams(["Ab, cd", None, "", "x"])
    expected = []
    for number, words in ((0, ["ab", "cd"]), (3, ["x"])):
        for n in toxicity.GRAMS:
            for word in words:
                padded = f" {word} "
                for i in range(len(padded) - n + 1):
                    codes = np.array([ord(c) for c in padded[i : i + n]], np.uint64)
                    expected.append((number, int(chargrams.gram_hashes(codes, n)[0])))
    assert sorted(zip(owner.tolist(), map(int, hashes))) == sorted(expected)


def test_toxicity_is_learned(spark):
    rng = random.Random(4)
    texts, labels = [], []
    for i in range(200):
        words = line(rng, ENGLISH, 60).split()
        if i % 4 == 0:
            words[rng.randrange(60)] = "Wurzbold!"
        texts.append((i, " ".join(words)))
        labels.append((i, int(i % 4 == 0)))
    docs = documents(spark, [*texts, (None, "x"), (300, None), (301, ""), (0, texts[0][1])])
    marked = spark.createDataFrame([*labels, (None, 1), (5, None), (1000, 1)], "id bigint, label int")
    fitted = toxicity.fit_toxicity_model(docs.select(F.col("doc_id").alias("id"), "text"), marked.where("id is null or id % 5 != 0"))
    rows = toxicity.score_toxicity(docs, fitted).collect()
    assert len(rows) == 204
    seen = {r.doc_id: r for r in rows}
    assert all(seen[i].predicted == label for i, label in labels)
    assert seen[300].score == seen[301].score and seen[300].predicted == 0
    one_class = toxicity.fit_toxicity_model(docs.select(F.col("doc_id").alias("id"), "text"), marked.where("label = 0"))
    assert {r.predicted for r in toxicity.score_toxicity(docs, one_class).collect()} == {0}


PAGES = [
    ("<p>a<p>b", "a\n\nb"),
    ("<title>t</title><body>x &amp; y<br>z<br></body>", "x & y\nz"),
    ("<ul><li>a<li>b<ol start=9><li>c<li>d</ol></ul>", "- a\n- b\n  9. c\n  10. d"),
    ("<table><tr><th>Name<th>n<tr><td>x<td align=right>10</table>", "Name  n\nx     10"),
    ("<table><tr><td rowspan=2>long<td>b<tr><td>c</table>", "long  b\n      c"),
    ("<div hidden>no</div><span style='display:none'>no</span><script>if (a<b) '</p>'</script>yes", "yes"),
    ("<pre> a\n  b</pre>c", " a\n  b\n\nc"),
    ("<b>one<i> two</b> three", "one two three"),
    ("<details>hidden<summary>shown</summary></details><!-- no -->", "shown"),
    ("a<", "a<"), ("<a href='x>y'>z</a>", "z"), ("", ""), ("<dl><dt>t<dd>d</dl>", "t\n  d"),
    ("<div>" * 3000 + "deep", "deep"),
]


@pytest.mark.parametrize("page, text", PAGES)
def test_pages(page, text):
    assert html_text.text_of(page) == text


def test_extraction_keeps_every_row(spark):
    rows = [(1, "<p>a"), (1, "<p>a"), (None, "b"), (2, None), (3, "")]
    pages = spark.createDataFrame(rows, "page_id bigint, html string").withColumn("text", F.lit("clash"))
    found = html_text.extract_text(pages).collect()
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(map(tuple, found), key=key) == [(1, "a"), (1, "a"), (2, None), (3, ""), (None, "b")]


def edit_distance_inside(pattern, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(pattern, 1):
        fresh = [i]
        for j, b in enumerate(text, 1):
            fresh.append(min(row[j] + 1, fresh[-1] + 1, row[j - 1] + (a != b)))
        row = fresh
    return min(row)


def test_contamination_equals_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    letters = "abcdefgh "
    items = [(i, "".join(rng.choice(letters) for _ in range(rng.randrange(40, 120)))) for i in range(12)]
    items += [(20, items[0][1]), (21, None), (22, ""), (23, "the")]
    texts = [(None, items[0][1]), (1, None), (2, "")]
    for i in range(3, 60):
        text = list(rng.choice(items[:12])[1])
        for _ in range(rng.randrange(0, 14)):
            at = rng.randrange(len(text))
            text[at : at + rng.randrange(2)] = rng.choice(letters) * rng.randrange(2)
        filling = ["".join(rng.choice(letters) for _ in range(rng.randrange(80))) for _ in range(2)]
        texts.append((i, filling[0] + "".join(text).upper() + "\n" + filling[1]))
    docs = documents(spark, texts)
    expected = set()
    for i, text in texts:
        for item, pattern in items:
            pattern = decontaminate.plain(pattern)
            if len(pattern) >= 30:
                distance = edit_distance_inside(pattern, decontaminate.plain(text))
                if distance <= int(0.08 * len(pattern)):
                    expected.add((i, item, distance))
    table = spark.createDataFrame(items, "item_id bigint, text string").withColumn("doc_id", F.lit("clash"))
    for chars in (decontaminate.BLOCK_CHARS, 300):
        monkeypatch.setattr(decontaminate, "BLOCK_CHARS", chars)
        benchmark = decontaminate.Benchmark.of(table)
        assert (benchmark.n_blocks > 1) == (chars == 300)
        found = decontaminate.find_contamination(docs, benchmark).collect()
        assert {(r.doc_id, r.item_id, r.distance) for r in found} == expected
        clean = decontaminate.without_contaminated(docs, benchmark)
        assert sorted(r.doc_id for r in clean.collect()) == sorted({i for i, _ in texts} - {e[0] for e in expected})
    none = decontaminate.Benchmark.of(table.limit(0))
    assert decontaminate.find_contamination(docs, none).count() == 0
