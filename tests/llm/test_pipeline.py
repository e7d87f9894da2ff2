"""The corpus pipeline against a plain version of its stages on planted documents."""

import random

import corpus_pipeline
from test_duplicates import slow_components, slow_passages
from test_text import ENGLISH, GERMAN, line


def shingles(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def plain_pipeline(rows, items):
    """What the stages keep, for documents whose language is beyond doubt."""
    kept = {i: t for i, t in rows.items() if t is not None and any(c.isalpha() for c in t)}
    sets = {i: shingles(t) for i, t in kept.items()}
    near = [(a, b) for a in kept for b in kept if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    kept = {i: kept[i] for i, root in slow_components(kept, near).items() if i == root}
    for i, begin, end, _ in sorted(slow_passages(list(kept.items()), 50), reverse=True):
        words = kept[i].split(" ")
        kept[i] = " ".join(words[:begin] + words[end:])
    squeezed = {i: " ".join(t.split()) for i, t in kept.items()}
    return {i: t for i, t in squeezed.items() if t and not any(item in t for item in items)}


def test_pipeline_on_planted_documents(spark, tmp_path):
    rng = random.Random(1)

    def text(n, words=ENGLISH):
        return " ".join(w + str(rng.randrange(900)) * (rng.random() < 0.3) for w in line(rng, words, n).split())

    items = [text(20) for _ in range(5)]
    passage = text(70)
    rows = {i: text(120, (ENGLISH, GERMAN)[i % 2]) for i in range(40)}
    rows |= {40: None, 41: "", 42: "12 34 !", 43: rows[3], 44: rows[3], 45: rows[4].replace("a", "a", 1) + " more"}
    rows |= {46: f"{text(30)} {items[0]} {text(30)}", 47: f"{text(40)} {passage} {text(5)}", 48: f"{text(9)} {passage} {text(90)}"}
    rows |= {49: passage, 50: f"{passage} {items[1]}", 51: items[2], 52: text(3), 53: text(3000)}
    table = spark.createDataFrame(
        [(i, t, None if t is None else "de" if i % 2 and i < 40 else "en", f"s{i % 4 // 3}", len(t or "")) for i, t in rows.items()],
        "doc_id bigint, text string, lang string, source string, n_chars bigint",
    )
    table.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    texts = {r.doc_id: " ".join(r.text.split()) for r in found}
    assert texts == plain_pipeline(rows, items)
    assert {0, 1, 2, 3, 4, 47, 48, 52, 53} <= set(texts) and not {40, 41, 42, 43, 44, 45, 46, 49, 50, 51} & set(texts)
    first = [r for r in found if r.epoch == 0]
    assert len(first) == len(texts) == len({r.doc_id for r in first})
    assert all(r.tokens == len(r.text.split()) + 1 for r in found)


def test_stages_take_empty_tables_and_keep_columns(spark, tmp_path):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    empty = spark.createDataFrame([], schema)
    odd = spark.createDataFrame([(None, None, None, None, None), (None, "ab cd", None, None, 5), (1, "ab cd", "xx", None, 5)] * 2, schema)
    for docs in (empty, odd):
        for name, stage in corpus_pipeline.STAGES:
            result = stage(spark, docs, str(tmp_path))
            if name != "source mixing":
                assert result.columns == docs.columns
            assert result.count() <= 2 * docs.count()
