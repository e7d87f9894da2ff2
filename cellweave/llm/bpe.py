"""Byte-level BPE: texts to token ids with their places in the text, and ids back to bytes.

A file of ranks gives the vocabulary. The tokenizers library knows tokens as text, so every byte
is written as one character, after a table; decoding reads the table backwards. A token may
begin or end inside a character, so ids are decoded to bytes first and to text afterwards."""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex
from tokenizers.models import BPE
from tokenizers.pre_tokenizers import Split

from cellweave.llm.common import text_slices
from cellweave.llm.tokens import PATTERN, VOCABULARY, read_ranks

#: Characters whose classes are the same in every version of Unicode that the libraries hold, so
#: that ``regex`` cuts them as the library does, in a third of the time.
SETTLED = r"\x00-ԯ‐-‧€"
#: A piece ends before a blank that follows no white space, whatever comes later: longer texts are
#: cut there, so that few pieces are held at a time.
LONGEST = 1 << 20
#: Pieces that are looked up together.
HELD = 1 << 17
#: Ids of the pieces that a worker remembers; beyond it begins anew. No result depends on it.
REMEMBERED = 1 << 20


def byte_characters() -> dict[int, str]:
    """The character of every byte: itself if it is a visible one of Latin-1, otherwise one from
    U+0100 on, in the order of the bytes."""
    visible = {b for b in range(256) if chr(b).isprintable() and b != 0x20 and b != 0xAD}
    others = (b for b in range(256) if b not in visible)
    return {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(others)}


def merges_of(ranks: dict[bytes, int]) -> list[tuple[bytes, bytes]]:
    """The merges that a table of ranks allows, best first: every pair of tokens of lower rank that
    make up a token has the rank of that token."""
    found = []
    for token in sorted(ranks, key=ranks.__getitem__):
        cuts = ((token[:i], token[i:]) for i in range(1, len(token)))
        found += [(a, b) for a, b in cuts if max(ranks.get(a, ranks[token]), ranks.get(b, ranks[token])) < ranks[token]]
    return found


@dataclass
class Pieces:
    """The pieces of texts that have been encoded, and the tokens of all of them side by side."""

    known: dict[str, int] = field(default_factory=dict)
    first: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    #: How many tokens of a piece begin inside a character.
    split: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    #: Id, and first and last character (plus one) of each token in its piece.
    tokens: np.ndarray = field(default_factory=lambda: np.zeros((3, 0), np.int32))


class Encoder:
    """The encoding of a file of ranks by the tokenizers library."""

    def __init__(self, ranks_file: bytes, pattern: str) -> None:
        ranks, chars = read_ranks(ranks_file), byte_characters()
        named = {token: "".join(map(chars.__getitem__, token)) for token in ranks}
        merges = [(named[a], named[b]) for a, b in merges_of(ranks)]
        self.model = BPE({named[t]: i for t, i in ranks.items()}, merges, ignore_merges=True, cache_capacity=0)
        self.characters = {byte: ord(char) for byte, char in chars.items()}
        self.cut = Split(Regex(pattern), "isolated")
        self.quick = regex.compile(pattern)
        self.unsettled = re.compile(f"[^{SETTLED}]")
        self.pieces = Pieces()
        octets = {char: byte for byte, char in chars.items()}
        table: list[bytes | None] = [None] * (max(ranks.values(), default=-1) + 1)
        for token, i in ranks.items():
            table[i] = bytes(map(octets.__getitem__, named[token]))
        self.table = pa.array([*table, None], pa.binary())  # the last stands for ids that are not known
        self.lengths = np.array([len(token or b"") for token in table], np.int64)

    def parts(self, text: str) -> Iterator[tuple[int, list[str]]]:
        """The pieces of a text, some at a time, and the character where they begin."""
        begin, ends = 0, re.compile(r"(?<=\S) ")
        while begin < len(text):
            end = ends.search(text, begin + LONGEST)
            part = text[begin : end.start() if end else len(text)]
            if self.unsettled.search(part):
                yield begin, [piece for piece, _ in self.cut.pre_tokenize_str(part)]
            else:
                yield begin, self.quick.findall(part)
            begin += len(part)

    def written(self, piece: str) -> str:
        """A piece with one character for every byte."""
        return piece.encode().decode("latin-1").translate(self.characters)

    def places(self, pieces: list[str]) -> np.ndarray:
        """The number of each piece among those that are known; new ones are encoded."""
        store = self.pieces
        fresh = list(set(pieces).difference(store.known))
        if fresh:
            made = [self.model.tokenize(self.written(piece)) for piece in fresh]
            counts = np.fromiter(map(len, made), np.int64, len(made))
            ids = np.fromiter((token.id for m in made for token in m), np.int32, counts.sum())
            ends = np.cumsum(self.lengths[ids])
            data = np.frombuffer("".join(fresh).encode(), np.uint8)
            character = np.cumsum((data & 0xC0) != 0x80) - 1  # of every byte, over all new pieces
            first, last = character[ends - self.lengths[ids]], character[ends - 1] + 1
            sizes = np.fromiter(map(len, fresh), np.int64, len(fresh))
            inside = np.concatenate([[False], first[1:] < last[:-1]])
            split = np.bincount(np.repeat(np.arange(len(fresh)), counts)[inside], minlength=len(fresh))
            begin = np.repeat(np.cumsum(sizes) - sizes, counts)
            store.known.update(zip(fresh, range(len(store.known), len(store.known) + len(fresh)), strict=True))
            store.first = np.concatenate([store.first, store.first[-1] + np.cumsum(counts)])
            store.split = np.concatenate([store.split, split])
            store.tokens = np.concatenate([store.tokens, np.stack([ids, first - begin, last - begin]).astype(np.int32)], axis=1)
        return np.fromiter(map(store.known.__getitem__, pieces), np.int64, len(pieces))

    def tokens_of(self, parts: list[tuple[int, list[str]]], offsets: bool) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of parts of texts, and how many each part has and how many of these begin
        inside a character. The tokens are one row of ids or, with ``offsets``, three rows."""
        if self.pieces.first[-1] > REMEMBERED:
            self.pieces = Pieces()
        pieces = list(chain.from_iterable(part for _, part in parts))
        at = self.places(pieces)
        first = self.pieces.first[at]
        sizes = self.pieces.first[at + 1] - first
        ends = np.concatenate([[0], np.cumsum(sizes)])
        rows = self.pieces.tokens if offsets else self.pieces.tokens[:1]
        tokens = rows[:, np.arange(ends[-1]) + np.repeat(first - ends[:-1], sizes)]
        counts = np.array([len(part) for _, part in parts])
        bounds = np.concatenate([[0], np.cumsum(counts)])
        if offsets:
            chars = np.concatenate([[0], np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))])
            shift = np.array([begin for begin, _ in parts]) - chars[bounds[:-1]]
            tokens[1:] += np.repeat(chars[:-1] + np.repeat(shift, counts), sizes).astype(np.int32)
        split = np.concatenate([[0], np.cumsum(self.pieces.split[at])])
        return tokens, np.stack([np.diff(ends[bounds]), np.diff(split[bounds])])

    def encode(self, texts: list[str | None], offsets: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the tokens of all texts as one row or, with ``offsets``, with their first and
        last character (plus one) as three; and how many tokens each text has and how many of
        these begin inside a character, as two rows."""
        counts = np.zeros((2, len(texts)), np.int64)
        found, held, owners, size = [np.zeros((3 if offsets else 1, 0), np.int32)], [], [], 0

        def look_up() -> None:
            tokens, of_part = self.tokens_of(held, offsets)
            np.add.at(counts, (slice(None), owners), of_part)
            found.append(tokens)

        for i, text in enumerate(texts):
            for begin, part in self.parts(text or ""):
                held.append((begin, part))
                owners.append(i)
                size += len(part)
                if size >= HELD:
                    look_up()
                    held, owners, size = [], [], 0
        if held:
            look_up()
        return np.concatenate(found, axis=1), counts


@lru_cache(maxsize=2)
def encoder(ranks_file: bytes, pattern: str) -> Encoder:
    return Encoder(ranks_file, pattern)


def list_of(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values))


def encode(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    offsets: bool = True,
    vocabulary: str = VOCABULARY,
    pattern: str = PATTERN,
) -> DataFrame:
    """``id_col, ids, n_split`` and, with ``offsets``, ``begins, ends`` for every row of ``docs``.

    ``ids`` are the tokens of the whole text, as each match of ``pattern`` gives them by itself;
    strings of special tokens are ordinary text. ``begins`` and ``ends`` are their characters; a
    token that stands for a part of a character has the whole one, and ``n_split`` counts those
    that begin inside one. A null or empty text has no tokens; repeated rows and null ids are
    encoded like any other; other columns are not read; an empty table gives an empty result.
    The driver reads the file of ranks, whose size the vocabulary bounds."""
    ranks_file = docs.sparkSession.sparkContext.broadcast(Path(vocabulary).read_bytes())
    names = ["id", "ids", "n_split", *(["begins", "ends"] if offsets else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end, texts in text_slices(batch.column(1), LONGEST):
                tokens, (counts, split) = encoder(ranks_file.value, pattern).encode(texts, offsets)
                bounds = np.concatenate([[0], np.cumsum(counts)])
                lists = [list_of(values, bounds) for values in tokens]
                columns = [batch.column(0).slice(begin, end - begin), lists[0], pa.array(split.astype(np.int32)), *lists[1:]]
                yield pa.RecordBatch.from_arrays(columns, names)

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    spans = ", begins array<int>, ends array<int>" if offsets else ""
    return rows.mapInArrow(run, f"id {kind}, ids array<int>, n_split int{spans}").withColumnRenamed("id", id_col)


def whole_characters(data: bytes) -> tuple[str, bytes, bytes]:
    """The text of some bytes, with the bytes before it that end a character and those after it
    that begin one. Other bytes that are no UTF-8 become U+FFFD."""
    head = 0
    while head < min(3, len(data)) and data[head] & 0xC0 == 0x80:
        head += 1
    decoder = codecs.getincrementaldecoder("utf-8")("replace")
    text = decoder.decode(data[head:])
    return text, data[:head], decoder.getstate()[0]


def decode(
    rows: DataFrame,
    id_col: str = "doc_id",
    ids_col: str = "ids",
    text: bool = True,
    carried: tuple[str, ...] = (),
    vocabulary: str = VOCABULARY,
) -> DataFrame:
    """``id_col, decoded`` and, with ``text``, ``text, head, tail`` for every row of ``rows``, beside
    its columns ``carried``.

    ``decoded`` are the bytes of ``ids_col``; ``text`` their whole characters; ``head`` and ``tail``
    the bytes of a character that the first or last id shares with ids outside the list, so
    that the tail of one list and the head of the next make up what was split. Null ids and a
    list with null or an id that the vocabulary has not give null; an empty list gives empty
    bytes; repeated rows are decoded like any other; an empty table gives an empty result."""
    ranks_file = rows.sparkSession.sparkContext.broadcast(Path(vocabulary).read_bytes())
    given = rows.select(F.col(id_col).alias("_id"), F.col(ids_col).cast("array<int>").alias("_ids"), *carried)
    extra = ", ".join(f"`{name}` {given.schema[name].dataType.simpleString()}" for name in ("_id", *carried))
    names = ["_id", *carried, "decoded", *(["text", "head", "tail"] if text else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = encoder(ranks_file.value, PATTERN).table
            sizes = np.diff(batch.column(1).offsets.to_numpy())
            step = max(1, LONGEST // max(1, int(sizes.max(initial=1))))
            for begin in range(0, batch.num_rows, step):
                part = batch.slice(begin, step)
                columns = [part.column(0), *(part.column(2 + i) for i in range(len(carried))), joined(part.column(1), table)]
                if text:
                    made = [(None,) * 3 if d is None else whole_characters(d) for d in columns[-1].to_pylist()]
                    texts, heads, tails = zip(*made, strict=True)
                    columns += [pa.array(texts, pa.string()), pa.array(heads, pa.binary()), pa.array(tails, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names)

    kinds = ", decoded binary" + (", text string, head binary, tail binary" if text else "")
    return given.mapInArrow(run, extra + kinds).withColumnRenamed("_id", id_col)


def joined(lists: pa.ListArray, table: pa.Array) -> pa.Array:
    """The bytes of the tokens of each list one after the other; null where one has none."""
    ids = lists.flatten().fill_null(-1).to_numpy()
    none = len(table) - 1
    parts = table.take(pa.array(np.where((ids >= 0) & (ids < none), ids, none)))
    bounds = np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy())])
    whole = pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), parts), b"")
    return pc.if_else(lists.is_valid(), whole, pa.scalar(None, pa.binary()))
