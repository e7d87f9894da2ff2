"""Awkward input to the operators: many languages, short items, empty budgets, hostile pages, long blanks."""

import random
import re
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave.llm import decontaminate, html_text, language, mixing, tokens
from llm_tables import documents


def test_labels_of_many_languages_do_not_wrap():
    kinds, sizes = 300, np.array([4, 6, 1])
    first = np.cumsum(sizes) - sizes
    scores = np.full((sizes.sum(), kinds), -5.0)
    wanted = [150, 150, 299, 299, 0, 0, 255, 255, 128, 128, 200]
    scores[np.arange(len(wanted)), wanted] = 5.0
    assert language.viterbi(scores, first, sizes, 0.1).tolist() == wanted
    assert language.viterbi(scores[:4], first[:1], sizes[:1], 100.0).tolist() == [150] * 4


def substrings(item, text):
    """The least distance of ``item`` to a part of ``text``, and all (begin, end) that have it."""
    best, places = len(item), {}
    for begin in range(len(text) + 1):
        row = list(range(len(item) + 1))
        for end in range(begin, len(text) + 1):
            if end > begin:
                fresh = [row[0] + 1]
                for i, a in enumerate(item, 1):
                    fresh.append(min(row[i] + 1, fresh[-1] + 1, row[i - 1] + (a != text[end - 1])))
                row = fresh
            places.setdefault(row[-1], []).append((begin, end))
            best = min(best, row[-1])
    return best, places[best]


def test_places_of_matches_equal_brute_force():
    rng = random.Random(3)
    for _ in range(60):
        unit = "".join(rng.choice("ab ") for _ in range(rng.randrange(2, 6)))
        item = decontaminate.plain((unit * 20)[: rng.randrange(30, 50)] if rng.random() < 0.5 else "".join(rng.choice("abc d") for _ in range(40)))
        if len(item) < 20:
            continue
        text = list(item)
        for _ in range(rng.randrange(4)):
            text[rng.randrange(len(text))] = rng.choice(["", "x", "ab"])
        text = decontaminate.plain("".join(rng.choice("ab x") for _ in range(rng.randrange(12))) + "".join(text)[rng.choice([0, 0, 2]) :] + " end")
        budget = int(0.08 * len(item))
        matcher = decontaminate.Matcher([decontaminate.Item(1, item, budget)])
        best, places = substrings(item, text)
        found = matcher.find(text)
        assert bool(found) == (best <= budget)
        if found:
            (row,) = found
            assert row["distance"] == best and 0 <= row["begin"] < row["end"]
            assert (row["begin"], row["end"]) in places
            assert row["end"] == min(end for begin, end in places if begin == row["begin"])


def test_short_items_are_found_as_whole_words(spark):
    items = spark.createDataFrame(
        [(1, "What is 2+2?"), (2, "yes"), (3, ""), (4, None), (5, "e"), (6, "what  IS 2+2?")], "item_id bigint, text string"
    )
    texts = [(1, "Q: what is\n2+2? Yes!"), (2, "yesterday eyes"), (3, "What is 2+2"), (4, ""), (5, None), (6, "the e"), (7, "yes" + " no" * 100_000 + " yes")]
    rows = decontaminate.find_contamination(documents(spark, texts), decontaminate.Benchmark.of(items)).collect()
    assert sorted((r.doc_id, r.item_id, r.distance, r.begin, r.end) for r in rows) == [
        (1, 1, 0, 3, 15), (1, 2, 0, 16, 19), (1, 6, 0, 3, 15), (6, 5, 0, 4, 5), (7, 2, 0, 0, 3),
    ]


def test_a_source_without_a_budget_is_not_read(spark):
    docs = documents(spark, [(i, "word " * 50) for i in range(30)] + [(100, "x")]).withColumn(
        "source", F.when(F.col("doc_id") == 100, "tiny").otherwise("large")
    )
    rows = mixing.mixture(docs, target_entropy=0.0, budget=200).collect()
    assert rows and all(r.epoch >= 0 for r in rows) and {r.source for r in rows} == {"large"}


def test_rows_that_differ_in_nulls_are_told_apart(spark):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    rows = [(1, "a", None, "s", None), (1, None, "a", "s", None), (1, None, None, "s", 1), (1, "a", None, "s", None)]
    found = mixing.mixed_documents(spark.createDataFrame(rows, schema), max_repetition=1.0).collect()
    assert sorted(((r.text, r.lang, r.n_chars) for r in found), key=repr) == sorted(((r[1], r[2], r[4]) for r in rows), key=repr)


def test_hidden_text_below_any_depth_stays_hidden():
    deep = "<span>" * 160
    assert html_text.text_of(f"{deep}a<div hidden>secret<b>more</b></div>b") == "ab"
    assert html_text.text_of(f"<p hidden>{deep}secret</p>seen") == "seen"
    assert html_text.text_of(f"{deep}<i>x</i>y" + "</span>" * 160 + "<p>z") == "xy\n\nz"


def test_visible_elements_in_hidden_ones_are_seen():
    assert html_text.text_of("<div style='visibility:hidden'>a<b style='visibility: visible'>b</b>c</div>d") == "b\nd"
    assert html_text.text_of("<ul><li style='visibility:hidden'>a<li>b</ul>") == "- b"
    assert html_text.text_of("<div style='display:none'>a<b style='visibility:visible'>b</b></div>d") == "d"


def test_wide_columns_are_aligned_and_spans_are_bounded():
    wide = "x" * 80
    page = f"<table><tr><td>{wide}<td>a<tr><td>b<td>c</table>"
    assert html_text.text_of(page) == f"{wide}  a\nb{' ' * 81}c"
    hostile = "<table>" + "<tr><td colspan=1000 rowspan=1000>x" * 300 + "</table>"
    text = html_text.text_of(hostile)
    assert len(text) < 200_000 and text.split() == ["x"] * 300
    long = "<table>" + f"<tr><td>{'y' * 200_000}<td>1" + "<tr><td>a<td>2" * 2000 + "</table>"
    text = html_text.text_of(long)
    assert len(text) < 1_000_000 and text.split()[-2:] == ["a", "2"]


def plain_layout(page):
    """Visible words of a page by the standard parser, in order."""
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__()
            self.hidden, self.words = 0, []

        def handle_starttag(self, tag, attrs):
            self.hidden += bool(self.hidden) or "hidden" in dict(attrs)

        def handle_endtag(self, tag):
            self.hidden -= bool(self.hidden)

        def handle_data(self, data):
            if not self.hidden:
                self.words += data.split()

    reader = Reader()
    reader.feed(page)
    return reader.words


def test_words_of_well_formed_pages_equal_those_of_a_plain_reader():
    rng = random.Random(8)

    def element(depth):
        if depth == 0 or rng.random() < 0.2:
            return f" w{rng.randrange(1000)} "
        tag = rng.choice(["div", "p", "b", "section", "blockquote", "pre", "i", "ul", "table"])
        inner = "".join(element(depth - 1) for _ in range(rng.randrange(4)))
        if tag == "p":
            inner = f" w{rng.randrange(1000)} <b> x </b>"
        if tag == "ul":
            inner = "".join(f"<li>{element(depth - 1)}</li>" for _ in range(2))
        if tag == "table":
            inner = "".join(f"<tr><td>{element(0)}</td><td>{element(0)}</td></tr>" for _ in range(2))
        return f"<{tag}{' hidden' * (rng.random() < 0.1)}>{inner}</{tag}>"

    for _ in range(200):
        page = "".join(element(5) for _ in range(3))
        found = [w for w in html_text.text_of(page).split() if w not in {"-", ">"}]
        assert found == plain_layout(page)


def test_a_long_page_keeps_all_its_text(spark):
    page = "".join(f"<p>w{i}</p>" for i in range(60_000))
    (row,) = html_text.extract_text(spark.createDataFrame([(1, page)], "page_id bigint, html string")).collect()
    assert row.text.split() == [f"w{i}" for i in range(60_000)]


def test_long_blanks_change_no_token(spark, monkeypatch):
    ranks = Path(tokens.VOCABULARY).read_bytes()
    plain = tokens.encoder(ranks, tokens.PATTERN)[0]
    rng = random.Random(4)
    monkeypatch.setattr(tokens, "LONG_BLANKS", re.compile(r"[^\S\x1c-\x1f]{3,}"))
    for _ in range(500):
        text = "".join(rng.choice(["a", "b1", "!", " ", "  ", "\n", "\t", "　", "\x1c", "\xa0"]) * rng.randrange(1, 6) for _ in range(12))
        assert tokens.encoded(text, ranks, tokens.PATTERN).tolist() == plain.encode(text, disallowed_special=())


@pytest.mark.parametrize("blanks", [" " * 1_000_000, "\n" * 400_000 + " \t" * 400_000])
def test_a_million_blanks_are_counted(spark, blanks):
    (row,) = tokens.token_counts(
        spark.createDataFrame([(1, "a" + blanks + "b")], "doc_id bigint, text string"),
        sections=F.array(F.struct(F.lit("all").alias("name"), F.lit(0).alias("begin"), F.lit(2_000_000).alias("end"))),
    ).collect()
    assert row.n_tokens > 2
