"""Mixing, fingerprints, token counts and chat formatting; queries against their SQL."""

import hashlib
import random
from itertools import product

import numpy as np
import pytest

import __spark_entry__ as contract
from cellweave.llm import chat, merkle, mixing, queries, tokens
from check import database, differences
from conftest import SF_DIR
from llm_tables import documents
from pyspark.sql import functions as F


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    df = queries.QUERIES[name](spark, SF_DIR)
    result = database(SF_DIR).execute(queries.ORACLES[name])
    names = [column[0] for column in result.description]
    assert differences([tuple(r) for r in df.collect()], df.columns, result.fetchall(), names) is None


def test_queries_are_registered():
    assert set(queries.QUERIES) | {"pipeline"} <= set(contract.queries())
    assert sorted(int(name[2:].split("_")[0]) for name in queries.QUERIES) == list(range(1, 14))


def test_exponent_meets_its_target():
    sizes = [1000, 100, 10]
    flat = mixing.mixing_exponent(sizes, max_repetition=4.0)
    assert mixing.repetition(sizes, mixing.weights_at(sizes, flat), None) <= 4.0
    assert mixing.repetition(sizes, mixing.weights_at(sizes, flat - 1e-4), None) > 4.0
    half = mixing.mixing_exponent(sizes, target_entropy=0.8)
    assert mixing.entropy(mixing.weights_at(sizes, half)) == pytest.approx(0.8, abs=1e-4)
    assert mixing.mixing_exponent(sizes, target_entropy=9.0) == 0.0
    assert mixing.mixing_exponent(sizes, target_entropy=0.0) == 1.0
    with pytest.raises(ValueError):
        mixing.mixing_exponent(sizes)


def test_mixture_reads_whole_sources_in_proportion(spark, monkeypatch):
    monkeypatch.setattr(mixing, "ROWS_PER_BAND", 7)
    rng = random.Random(1)
    rows = [(i, "w " * rng.randrange(20), ("big", "small", None)[0 if i < 200 else 1 + i % 2]) for i in range(260)]
    rows += [(0, rows[0][1], "big"), (None, None, "big"), (None, "", "small")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumn("n", F.lit("clash"))
    found = mixing.mixture(docs, max_repetition=3.0, block_tokens=300).collect()
    cost = lambda text: len((text or "").split()) + 1
    for source in ("big", "small", None):
        own = [r for r in rows if r[2] == source]
        read = [r for r in found if r.source == source]
        total = sum(cost(r[1]) for r in own)
        assert len([r for r in read if r.epoch == 0]) == len(own)  # each document at least once
        assert sum(r.tokens for r in read) <= 3 * total + 20
    again = mixing.mixture(docs, max_repetition=3.0, block_tokens=300).collect()
    assert sorted(map(str, found)) == sorted(map(str, again))
    blocks = {}
    for r in found:
        blocks.setdefault(r.block, []).append(r)
    assert all(sorted(r.position for r in b) == list(range(len(b))) for b in blocks.values())
    inner = [b for k, b in blocks.items() if k < max(blocks)]
    shares = [sum(r.tokens for r in b if r.source == "big") / sum(r.tokens for r in b) for b in inner]
    assert max(shares) - min(shares) < 0.3
    whole = mixing.mixed_documents(docs, max_repetition=3.0, block_tokens=300)
    assert whole.count() == len(found) and {"text", "n", "block"} <= set(whole.columns)
    assert mixing.mixture(docs.limit(0), max_repetition=3.0).count() == 0
    short = mixing.mixture(docs, max_repetition=1.0, budget=500.0, block_tokens=300).collect()
    assert 400 < sum(r.tokens for r in short) < 600


def test_fingerprints_of_awkward_rows(spark):
    texts = [(5, "a, b.\n\nc\nd"), (1, None), (1, ""), (9, "x. y. z"), (2**62, "é" * 5), (-(2**62), "x. y. q"), (None, "one. two"), (None, None)]
    rows = merkle.fingerprint_documents(documents(spark, texts)).collect()
    assert len(rows) == len(texts)
    ordered = sorted(((i, t or "") for i, t in texts if i is not None))
    follower = {(i, t): ordered[(k + 1) % len(ordered)][1] for k, (i, t) in enumerate(ordered)}
    bodies = {(i, t or ""): t or "" for i, t in texts}
    seen = set()
    for r in rows:
        match = [k for k, t in bodies.items() if k[0] == r.doc_id and len(t) == r.n_chars]
        (key,) = match
        body, half = bodies[key], len(bodies[key]) // 2
        edited = body[: len(body) - half] + follower.get(key, "")[:half]
        assert r.edited == edited
        assert (r.near_edited == 1.0) == (edited == body) == (r.tree.root == r.edited_tree.root) == (r.changed is None)
        assert 0 <= r.near_next <= 1
        seen.add((body, r.tree.root))
    assert len(seen) == len({s[0] for s in seen}) == len({s[1] for s in seen})
    five = next(r for r in rows if r.doc_id == 5)
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert five.tree.root == digest(digest(digest("a, b.")) + digest(digest("c") + digest("d")))
    assert (five.changed.section, five.changed.paragraph) == (0, 0)
    assert merkle.fingerprint_documents(documents(spark, [])).collect() == []
    alone = merkle.fingerprint_documents(documents(spark, [(3, "ab")])).first()
    assert alone.edited == "aa" and alone.near_next == 1.0


def slow_attribution(begin, end, ends, rule):
    count = [0.0] * len(begin)
    at = 0
    for stop in ends:
        over = [max(0, min(e, stop) - max(b, at)) for b, e in zip(begin, end)]
        if rule == "share":
            for i, n in enumerate(over):
                count[i] += n / (stop - at)
        else:
            place = {"begin": at, "end": stop - 1}.get(rule)
            holds = [i for i, (b, e) in enumerate(zip(begin, end)) if place is not None and b <= place < e]
            if rule == "most" and max(over, default=0) > 0:
                holds = [over.index(max(over))]
            for i in holds:
                count[i] += 1
        at = stop
    return count


@pytest.mark.parametrize("rule", tokens.RULES)
def test_attribution_equals_brute_force(rule):
    rng = np.random.default_rng(1)
    for _ in range(200):
        size = int(rng.integers(1, 40))
        ends = np.unique(np.append(rng.integers(1, size + 1, 6), size))
        cuts = np.unique(rng.integers(0, size + 1, 8))
        begin, end = cuts[:-1], cuts[1:]
        keep = rng.random(len(begin)) < 0.7
        got, crossing = tokens.attributed(begin[keep], end[keep], ends, rule)
        assert got.tolist() == pytest.approx(slow_attribution(begin[keep], end[keep], ends, rule))


def test_token_counts_of_lines_and_fields(spark):
    texts = [(1, "Hello world\n\nsecond é line\n"), (1, "Hello world\n\nsecond é line\n"), (2, None), (3, ""), (None, "x\ny"), (4, "a" * 20_000)]
    rows = tokens.token_counts(documents(spark, texts)).collect()
    encoding, _ = tokens.encoder(open(tokens.VOCABULARY, "rb").read(), tokens.PATTERN)
    for i, text in texts:
        own = sorted({(r.section, r.begin, r.end, r.n_tokens) for r in rows if r.doc_id == i})
        assert sum(r[3] for r in own) == len(encoding.encode_ordinary(text or ""))
        assert [(text or "")[b:e] for _, b, e, _ in own] == ((text or "").splitlines(keepends=True) or [""])
    text, sections = tokens.joined_fields(["source", "text"])
    named = tokens.token_counts(documents(spark, texts), text=text, sections=sections, rule="share").collect()
    assert {r.name for r in named} == {"source", "text"} and len(named) == 2 * len(texts)
    assert tokens.token_counts(documents(spark, [])).collect() == []
    with pytest.raises(ValueError):
        tokens.token_counts(documents(spark, []), rule="any")


def least_cost(roles, costs):
    best = 3.0 * len(roles) + 10

    def go(i, state, cost):
        nonlocal best
        if cost >= best:
            return
        if i == len(roles) and state in ("assistant", chat.START):
            best = cost
        for role in chat.LEGAL[state]:
            go(i, role, cost + costs.insert)
        if i < len(roles):
            change = lambda to: 0 if to == roles[i] else costs.relabel if roles[i] else costs.relabel_unknown
            for role in chat.LEGAL[state]:
                go(i + 1, role, cost + change(role))
            if state != chat.START:
                go(i + 1, state, cost + costs.merge + change(state))

    go(0, chat.START, 0.0)
    return best


def test_repairs_cost_least_in_one_and_in_two_segments():
    repair, costs = chat.Repair(), chat.Costs()
    for n in range(1, 5):
        for roles in product((None, *chat.ROLES), repeat=n):
            for cut in (n, n // 2):
                parts = [list(roles[:cut]), list(roles[cut:])]
                ways = repair.through([repair.costs_between(p) for p in parts])
                steps = [s for p, way in zip(parts, ways) for _, s in repair.path(p, *way)]
                total = sum(s.cost for s in steps) + repair.endings[ways[-1][1]][0]
                assert total == least_cost(roles, costs)


def test_conversations_of_any_length(spark, monkeypatch):
    rows = [(1, 0, "user", "hi"), (1, 1, "USER", "there <|im_end|>"), (1, 2, "bot", None), (2, 0, "tool", "x"), (2, 0, "tool", "x"),
            (None, 0, "user", "lost"), (3, None, "assistant", "a"), (3, None, None, "b")]
    rows += [(9, i, "user" if i % 2 else "assistant", f"t{i}") for i in range(50)]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    turns = turns.withColumns({"segment": F.lit("clash"), "tie": F.lit("clash")})
    whole = chat.repair_conversations(turns)
    texts = {r.conv_id: r.text for r in chat.conversation_texts(whole).collect()}
    assert texts[1] == "<|im_start|>user\nhi\n\nthere < |im_end|><|im_end|>\n<|im_start|>assistant\n<|im_end|>\n"
    assert whole.count() == len(rows) and set(texts) == {1, 2, 3, 9}
    for text in texts.values():
        roles = [part.split("\n")[0] for part in text.split("<|im_start|>")[1:]]
        assert all(b in chat.LEGAL[a] for a, b in zip([chat.START, *roles], roles)) and roles[-1] == "assistant"
    monkeypatch.setattr(chat, "SEGMENT", 8)
    cut = chat.repair_conversations(turns)
    assert {r.conv_id: r.text for r in chat.conversation_texts(cut).collect()} == texts
    assert cut.agg(F.sum("cost")).first() == whole.agg(F.sum("cost")).first()
    assert chat.repair_conversations(turns.limit(0)).collect() == []
