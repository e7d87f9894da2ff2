"""Token counts of the fields or sections of documents.

A document is encoded once and whole. Its tokens get the byte spans they stand for, which are
joined to the spans of its sections; a token over a boundary is given away by a stated rule."""

from __future__ import annotations

import base64
import re
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.llm.common import by_batch

#: Fixed value: how byte-level BPE vocabularies of 50,257 entries cut texts, as published.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Longer stretches of white space are encoded by themselves: searching them for the place where the
#: pattern ends them would exhaust the stack of the library.
MAX_BLANKS = 10_000
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The white space of the pattern, which is that of Unicode without the separators U+001C to U+001F.
LONG_BLANKS = re.compile(rf"[^\S\x1c-\x1f]{{{MAX_BLANKS},}}")
RULES = ("begin", "end", "most", "share")


def read_ranks(ranks_file: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks_file.splitlines())}


@lru_cache(maxsize=2)
def encoder(ranks_file: bytes, pattern: str) -> tuple[tiktoken.Encoding, np.ndarray]:
    """The encoding of a file of ranks, and the number of bytes of every token."""
    ranks = read_ranks(ranks_file)
    lengths = np.zeros(max(ranks.values()) + 1, np.int64)
    lengths[list(ranks.values())] = [len(token) for token in ranks]
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), lengths


@lru_cache(maxsize=2)
def encoder_of_blanks(ranks_file: bytes) -> tiktoken.Encoding:
    """The encoding that takes any stretch of white space as one piece."""
    return tiktoken.Encoding("blanks", pat_str=r"\s+", mergeable_ranks=read_ranks(ranks_file), special_tokens={})


def encoded(body: str, ranks_file: bytes, pattern: str) -> np.ndarray:
    """The tokens of a whole text. The published pattern ends a piece before white space; a stretch of
    it is a piece but for its last character, which goes with what follows, or whole at the
    end of a text. Long stretches are therefore cut out without changing any token."""
    encoding = encoder(ranks_file, pattern)[0]
    found, at = [], 0
    for stretch in LONG_BLANKS.finditer(body) if pattern == PATTERN else ():
        last = stretch.end() if stretch.end() == len(body) else stretch.end() - 1
        found.append(encoding.encode_to_numpy(body[at : stretch.start()], disallowed_special=()))
        blanks = body[stretch.start() : last]
        found.append(encoder_of_blanks(ranks_file).encode_to_numpy(blanks, disallowed_special=()))
        at = last
    return np.concatenate([*found, encoding.encode_to_numpy(body[at:], disallowed_special=())])


def attributed(
    begin: np.ndarray, end: np.ndarray, tokens: np.ndarray, rule: str
) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section and how many of them lie over a boundary. ``begin`` and ``end`` are
    the sections in order, ``tokens`` the ends of the tokens, all in bytes."""
    count, crossing = np.zeros(len(begin)), np.zeros(len(begin), np.int64)
    if not len(tokens) or not len(begin):
        return count, crossing
    start = np.concatenate([[0], tokens[:-1]])
    first = np.searchsorted(end, start, side="right")  # the first section that ends after it
    last = np.searchsorted(begin, tokens, side="left") - 1  # the last one that begins before its end
    inside = (first == last) & (begin[np.minimum(first, len(begin) - 1)] <= start)
    inside &= end[np.maximum(last, 0)] >= tokens
    count += np.bincount(first[inside], minlength=len(begin))
    for i in np.flatnonzero(~inside & (first <= last)):
        near = np.arange(first[i], last[i] + 1)
        common = np.minimum(end[near], tokens[i]) - np.maximum(begin[near], start[i])
        if rule == "share":
            count[near] += common / (tokens[i] - start[i])
            crossing[near] += 1
            continue
        if rule == "most":
            section = near[common.argmax()]
        else:
            section, outside = (
                (near[0], begin[near[0]] > start[i]) if rule == "begin" else (near[-1], end[near[-1]] < tokens[i])
            )
            if outside:
                continue
        count[section] += 1
        crossing[section] += 1
    return count, crossing


def lines(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the lines of a text in bytes; a line holds its line feed."""
    end = np.flatnonzero(data == 10) + 1
    if not len(end) or end[-1] < len(data):
        end = np.append(end, len(data))
    return np.concatenate([[0], end[:-1]]), end


def joined_fields(columns: list[str], separator: str = "\n") -> tuple[Column, Column]:
    """The text of several columns joined by ``separator`` (null: empty) and their sections."""
    values = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    sections, at = [], F.lit(0)
    for name, value in zip(columns, values, strict=True):
        end = at + F.char_length(value)
        sections.append(F.struct(F.lit(name).alias("name"), at.alias("begin"), end.alias("end")))
        at = end + len(separator)
    return F.concat_ws(separator, *values), F.array(*sections)


def token_counts(
    docs: DataFrame,
    id_col: str = "doc_id",
    text: Column | None = None,
    sections: Column | None = None,
    rule: str = "begin",
    vocabulary: str = VOCABULARY,
    pattern: str = PATTERN,
) -> DataFrame:
    """``id_col, section, name, begin, end, n_tokens, n_crossing``: a row for every section of every
    row of ``docs``. ``begin`` and ``end`` are characters, ``n_crossing`` counts the tokens of the
    section that lie over one of its boundaries.

    ``sections`` is an array of name, begin and end in order and without overlap; without it
    every line with its line feed is a section (with a null name). A token over a boundary
    goes to the section that holds its first byte (``begin``) or last byte (``end``), to the one
    with most of its bytes, the earlier if equal (``most``), or to each in proportion
    (``share``); tokens outside all sections are not counted. With lines, counts add up to the
    document's tokens.

    A null or empty text has one empty line; null sections are an empty list; repeated rows
    and null ids are counted like any other; clashing names are not read. Texts are encoded
    whole, one at a time; very long white space is no exception. The driver reads the file of ranks, whose size the vocabulary bounds."""
    if rule not in RULES:
        raise ValueError(f"rule is one of {', '.join(RULES)}")
    ranks_file = docs.sparkSession.sparkContext.broadcast(Path(vocabulary).read_bytes())
    spans = sections if sections is not None else F.lit(None)
    kind = "array<struct<name: string, begin: int, end: int>>"
    own_lines = sections is None

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        lengths = encoder(ranks_file.value, pattern)[1]
        given = batch.column(2)
        owners, begins, ends, counts, crossings, names = [], [], [], [], [], []
        for i, value in enumerate(batch.column(1)):
            body = value.as_py() or ""
            data = np.frombuffer(body.encode(), np.uint8)
            chars = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
            tokens = np.cumsum(lengths[encoded(body, ranks_file.value, pattern)])
            if own_lines:
                begin, end = lines(data)
            else:
                rows = given[i].as_py() or []
                places = np.array([[r["begin"], r["end"]] for r in rows], np.int64).reshape(-1, 2)
                begin, end = chars[np.clip(places, 0, len(chars) - 1)].T
                names += [r["name"] for r in rows]
            count, crossing = attributed(begin, end, tokens, rule)
            owners.append(np.full(len(begin), i))
            begins.append(np.searchsorted(chars, begin))
            ends.append(np.searchsorted(chars, end))
            counts.append(count)
            crossings.append(crossing)
        owner = np.concatenate(owners)
        first = np.searchsorted(owner, owner)
        columns = [
            batch.column(0).take(pa.array(owner)),
            pa.array((np.arange(len(owner)) - first).astype(np.int32)),
            pa.nulls(len(owner), pa.string()) if own_lines else pa.array(names, pa.string()),
            *[pa.array(np.concatenate(c).astype(np.int32)) for c in (begins, ends)],
            pa.array(np.concatenate(counts)),
            pa.array(np.concatenate(crossings).astype(np.int32)),
        ]
        return pa.RecordBatch.from_arrays(
            columns, ["id", "section", "name", "begin", "end", "n_tokens", "n_crossing"]
        )

    value = F.col("text") if text is None else text
    rows = docs.select(F.col(id_col).alias("id"), value.alias("text"), spans.cast(kind).alias("sections"))
    id_kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(
        by_batch(run),
        f"id {id_kind}, section int, name string, begin int, end int, n_tokens double, n_crossing int",
    ).withColumnRenamed("id", id_col)
