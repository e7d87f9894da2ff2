"""Byte-level BPE against the library that reads the same ranks, and round trips."""

import hashlib
import random
import re
from pathlib import Path

import pytest
import regex
import tiktoken
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from tokenizers import Regex
from tokenizers.pre_tokenizers import Split

from cellweave.llm import bpe, queries
from cellweave.llm.tokens import PATTERN, VOCABULARY
from llm_tables import documents

RANKS = Path(VOCABULARY).read_bytes()
HARD = [
    "", " ", "  ", "\n", " \n ", "a  b", "a \n\n b ", "it's we'll I'd 'S", "12,345.6 x²", "<|endoftext|> x", "naïve café Ünï",
    "日本語のテキスト", "😀👩‍👩‍👧 é", " x y　z", "\x00\x1c\x1fa", "﻿a​b", "ա՘՗֊ ౜ ₏", "\U0003fffe\U0010ffff", "a" * 5000, "ab" * 3000,
    " " * 3000 + "x", "x" + "\n" * 3000, "\t" * 50 + "y", "!?" * 700, "… “q” — €5",
]


@pytest.fixture(scope="module")
def plain():
    return tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


def test_every_byte_has_a_character_of_its_own():
    chars = bpe.byte_characters()
    assert sorted(chars) == list(range(256)) and len(set(chars.values())) == 256
    assert chars[ord("A")] == "A" and chars[0x20] == "Ġ" and chars[0x0A] == "Ċ"


def test_ids_equal_those_of_the_plain_library(plain, monkeypatch):
    coder = bpe.Encoder(RANKS, PATTERN)
    rng = random.Random(3)
    mixed = ["".join(rng.choice("ab cdé1 2,.\n\t'sሴ😀ﬀΩ  ") for _ in range(rng.randrange(300))) for _ in range(300)]
    for longest in (bpe.LONGEST, 7):
        monkeypatch.setattr(bpe, "LONGEST", longest)
        for text in HARD + mixed:
            assert coder.encode([text])[0][0].tolist() == plain.encode_ordinary(text)


@settings(max_examples=300, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(text=st.text(max_size=60))
def test_any_text_is_encoded_and_decoded(plain, text):
    coder = bpe.encoder(RANKS, PATTERN)
    ids = coder.encode([text])[0][0].tolist()
    assert ids == plain.encode_ordinary(text)
    assert b"".join(coder.table[i].as_py() for i in ids) == text.encode()


def test_the_quick_cut_equals_the_library_on_all_settled_characters():
    settled = [chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000 and not re.search(f"[^{bpe.SETTLED}]", chr(c))]
    assert len(settled) > 1300
    cut, quick = Split(Regex(PATTERN), "isolated"), regex.compile(PATTERN)
    for c in settled:
        text = f"a{c}1{c}! {c} {c}\n{c}{c}"
        assert quick.findall(text) == [piece for piece, _ in cut.pre_tokenize_str(text)]


def test_a_million_blanks_are_one_piece():
    coder = bpe.Encoder(RANKS, PATTERN)
    for text in (" " * 1_000_000 + "x", "\n" * 1_000_000, "y" * 300_000):
        ids = coder.encode([text])[0][0].tolist()
        assert b"".join(coder.table[i].as_py() for i in ids) == text.encode()


def test_forgetting_pieces_and_small_portions_change_nothing(monkeypatch):
    texts = [None, "", *[f"word{i} other{i % 7} é" * 3 for i in range(200)], *HARD]
    expected, counts = bpe.Encoder(RANKS, PATTERN).encode(texts)
    monkeypatch.setattr(bpe, "REMEMBERED", 10)
    monkeypatch.setattr(bpe, "HELD", 25)
    monkeypatch.setattr(bpe, "LONGEST", 9)
    found, other = bpe.Encoder(RANKS, PATTERN).encode(texts)
    assert found.tolist() == expected.tolist() and counts.tolist() == other.tolist()
    ids, other = bpe.Encoder(RANKS, PATTERN).encode(texts, offsets=False)
    assert ids.tolist() == expected[:1].tolist() and counts.tolist() == other.tolist()


def test_offsets_are_characters_and_split_ones_are_counted(spark):
    texts = [(1, "héé😀 x"), (2, None), (3, ""), (4, "日本 a  b"), (4, "日本 a  b"), (None, "no id"), *enumerate(HARD, 10)]
    rows = bpe.encode(documents(spark, texts)).collect()
    assert len(rows) == len(texts)
    by_text = dict(texts)
    table = bpe.encoder(RANKS, PATTERN).table
    for r in rows:
        text = by_text[r.doc_id] or ""
        assert len(r.ids) == len(r.begins) == len(r.ends)
        covered, at = set(), 0
        for i, a, b in zip(r.ids, r.begins, r.ends, strict=True):
            data = table[i].as_py()
            first = len(text.encode()[:at].decode("utf-8", "ignore"))
            assert a == first and text[a:b].encode().find(data) >= 0
            at += len(data)
            covered.update(range(a, b))
        assert covered == set(range(len(text)))
        assert r.n_split == sum(a < b for a, b in zip(r.begins[1:], r.ends, strict=False))
    assert {r.doc_id: r.n_split for r in rows}[1] == 1


def test_windows_of_ids_join_at_split_characters(spark):
    text = "日本語のテキスト 😀👩‍👩‍👧 naïve ሴ𐍈"
    (row,) = bpe.encode(documents(spark, [(1, text)])).collect()
    windows = [(i, row.ids[i : i + 2]) for i in range(0, len(row.ids), 2)]
    found = bpe.decode(spark.createDataFrame(windows, "doc_id int, ids array<int>")).orderBy("doc_id").collect()
    assert b"".join(r.decoded for r in found).decode() == text
    joined, pending = "", b""
    for r in found:
        joined += (pending + r.head).decode("utf-8") if pending or r.head else ""
        joined, pending = joined + r.text, r.tail
    assert joined == text and any(r.tail for r in found)


def test_decoding_null_unknown_and_empty_ids(spark):
    rows = [(1, None), (2, []), (3, [1, None]), (4, [50_256]), (5, [-1]), (6, [0, 1]), (6, [0, 1]), (None, [0])]
    found = bpe.decode(spark.createDataFrame(rows, "doc_id bigint, ids array<int>")).collect()
    assert [(r.doc_id, r.decoded, r.text) for r in found] == [
        (1, None, None), (2, b"", ""), (3, None, None), (4, None, None), (5, None, None),
        (6, b'!"', '!"'), (6, b'!"', '!"'), (None, b"!", "!"),
    ]
    assert bpe.whole_characters(b"\x9f\x98\x80a\xffb\xf0\x9f") == ("a�b", b"\x9f\x98\x80", b"\xf0\x9f")


def test_query_equals_the_plain_library_on_all_documents(spark, plain):
    sf_dir = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.op13_bpe(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = plain.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_empty_table(spark):
    coded = bpe.encode(documents(spark, [(1, "a")]).limit(0))
    assert coded.collect() == [] and bpe.decode(coded).collect() == []
