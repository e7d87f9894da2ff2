"""Benchmark decontamination by pigeonhole edit matching.

A text within e edits of a test item holds at least one of the item's e + 1 pieces unchanged.
Exact hits of pieces are found for all items at once; around each hit the item's edit distance
is computed with Myers' bit-parallel recurrence."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.llm.common import by_batch, stored, text_slices

#: Characters of the items that one pass over the documents looks for.
BLOCK_CHARS = 2_000_000
HIT = {"item_id": pa.int64(), "distance": pa.int32(), "begin": pa.int32(), "end": pa.int32()}


def plain(text: str | None) -> str:
    """Lower case, with one blank for every stretch of white space."""
    return " ".join((text or "").lower().split())


@dataclass(frozen=True)
class Item:
    """A test item; a ``short`` one is looked for as whole words without any edit."""

    item_id: int
    text: str
    budget: int
    short: bool = False

    def pieces(self) -> list[tuple[int, str]]:
        """The item in ``budget`` + 1 pieces of nearly equal length, with their offsets."""
        size, n = len(self.text), self.budget + 1
        cuts = [size * i // n for i in range(n + 1)]
        return [(a, self.text[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def best_match(pattern: str, text: str) -> tuple[int, int]:
    """The least edit distance between ``pattern`` and any part of ``text``, and where the first
    such part ends. One bit of an integer for each character of the pattern."""
    size = len(pattern)
    top, full = 1 << (size - 1), (1 << size) - 1
    places: dict[str, int] = defaultdict(int)
    for i, char in enumerate(pattern):
        places[char] |= 1 << i
    places = dict(places)
    up, down, distance = full, 0, size
    best, end = size, 0
    for at, char in enumerate(text, 1):
        equal = places.get(char, 0)
        across = (((equal & up) + up) ^ up) | equal | down
        higher = down | (full & ~(across | up))
        lower = up & across
        if higher & top:
            distance += 1
        elif lower & top:
            distance -= 1
        higher, lower = higher << 1, lower << 1
        vertical = equal | down
        up = full & (lower | ~(vertical | higher))
        down = full & higher & vertical
        if distance < best:
            best, end = distance, at
    return best, end


class Matcher:
    """Finds the items of one block in texts."""

    def __init__(self, items: list[Item]) -> None:
        self.items = items
        pieces: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for number, item in enumerate(items):
            for offset, piece in item.pieces():
                pieces[piece].append((number, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, uses in pieces.items():
            self.automaton.add_word(piece, (len(piece), uses))
        self.automaton.make_automaton()

    def starts(self, text: str) -> dict[int, set[int]]:
        """By item, where it would have to begin for its pieces to lie where they were hit."""
        found: dict[int, set[int]] = defaultdict(set)
        for last, (size, uses) in self.automaton.iter(text):
            for number, offset in uses:
                found[number].add(last + 1 - size - offset)
        return found

    def find(self, raw: str | None) -> list[dict[str, int]]:
        text = plain(raw)
        rows = []
        if not text or not self.items:
            return rows
        for number, starts in sorted(self.starts(text).items()):
            item = self.items[number]
            best = min(
                (self.verify(item, text, low, high) for low, high in stretches(starts, item)),
                default=None,
            )
            if best and best[0] <= item.budget:
                distance, begin, end = best
                rows.append({"item_id": item.item_id, "distance": distance, "begin": begin, "end": end})
        return rows

    def verify(self, item: Item, text: str, low: int, high: int) -> tuple[int, int, int]:
        """Distance, begin and end of the best match that begins about ``low`` to ``high``."""
        if item.short:
            end = low + len(item.text)
            inside = text[max(low - 1, 0) : low + 1], text[end - 1 : end + 1]
            return (1, 0, 0) if any(len(x) == 2 and x.isalnum() for x in inside) else (0, low, end)
        if low == high and low >= 0 and text.startswith(item.text, low):
            return 0, low, low + len(item.text)
        first = max(0, low - item.budget)
        distance, end = best_match(item.text, text[first : high + len(item.text) + item.budget])
        if distance > item.budget:
            return distance, 0, 0
        end += first
        # Backwards from the end: where the match of that distance begins.
        back = text[max(0, end - len(item.text) - item.budget) : end][::-1]
        return distance, end - best_match(item.text[::-1], back)[1], end


def stretches(starts: set[int], item: Item) -> list[tuple[int, int]]:
    """Begins that one edited copy can explain, put together."""
    if item.short:
        return [(start, start) for start in sorted(starts)]
    joined: list[tuple[int, int]] = []
    for start in sorted(starts):
        if joined and start - joined[-1][1] <= item.budget:
            joined[-1] = joined[-1][0], start
        else:
            joined.append((start, start))
    return joined


@dataclass(frozen=True)
class Benchmark:
    """Test items as blocks of about ``BLOCK_CHARS`` characters by a hash of the id. The driver
    reads one block at a time and sends it to the tasks."""

    rows: DataFrame
    n_blocks: int
    rate: float
    min_chars: int

    @staticmethod
    def of(
        items: DataFrame, id_col: str = "item_id", text_col: str = "text", rate: float = 0.08, min_chars: int = 30
    ) -> Benchmark:
        rows = items.select(F.col(id_col).alias("item_id"), F.col(text_col).alias("text")).where(
            "item_id is not null and text is not null"
        )
        total = rows.agg(F.coalesce(F.sum(F.char_length("text")), F.lit(0))).first()[0]
        return Benchmark(rows, total // BLOCK_CHARS + 1, rate, min_chars)

    def block(self, number: int) -> list[Item]:
        mine = F.pmod(F.xxhash64("item_id"), F.lit(self.n_blocks)) == number
        texts = {(row["item_id"], plain(row["text"])) for row in self.rows.where(mine).collect()}
        whole = self.min_chars
        return [Item(i, t, int(self.rate * len(t)) if len(t) >= whole else 0, len(t) < whole) for i, t in sorted(texts) if t]


def matcher_of(block: list[Item]) -> Callable[[], Matcher]:
    """Makes the matcher of a block once in each task."""
    made: list[Matcher] = []

    def get() -> Matcher:
        if not made:
            made.append(Matcher(block))
        return made[0]

    return get


def find_contamination(
    docs: DataFrame, benchmark: Benchmark, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``id_col, item_id, distance, begin, end``: one row for each document and item it holds, with
    the best match (begin and end in the ``plain`` text).

    An item of m characters may differ by ``rate`` * m edits. One of fewer than ``min_chars``
    characters, too short to tell an edited copy from chance, must be there exactly and as whole
    words; null and empty items are left out; items with equal texts are each reported. Of
    matches with the least distance the one that begins first is given, of those that end in one
    place the shortest; none begins before the text. Documents are read whole and never moved; null and empty ones hold
    nothing; repeated rows and null ids are reported like any other; an empty table on either
    side gives an empty result. Blocks of items are looked for one after another."""
    found = []
    for number in range(benchmark.n_blocks):
        hits = hits_of_block(docs, benchmark.block(number), id_col, text_col)
        found.append(stored(hits, "contamination") if benchmark.n_blocks > 1 else hits)
    return reduce(DataFrame.unionAll, found)


def hits_of_block(docs: DataFrame, block: list[Item], id_col: str, text_col: str) -> DataFrame:
    matcher = matcher_of(block)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found, owner = [], []
        for begin, _, texts in text_slices(batch.column(1)):
            for i, text in enumerate(texts, begin):
                rows = matcher().find(text)
                found += rows
                owner += [i] * len(rows)
        columns = [pa.array([row[name] for row in found], kind) for name, kind in HIT.items()]
        ids = batch.column(0).take(pa.array(owner, pa.int64()))
        return pa.RecordBatch.from_arrays([ids, *columns], ["id", *HIT])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(
        by_batch(run), f"id {kind}, item_id bigint, distance int, begin int, end int"
    ).withColumnRenamed("id", id_col)


def without_contaminated(docs: DataFrame, benchmark: Benchmark, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no item; the same rules as ``find_contamination``."""
    place = docs.columns.index(text_col)

    def clean(docs: DataFrame, matcher: Callable[[], Matcher]) -> DataFrame:
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            kept = [
                not matcher().find(text) for _, _, texts in text_slices(batch.column(place)) for text in texts
            ]
            return batch.filter(pa.array(kept))

        return docs.mapInArrow(by_batch(run), docs.schema)

    for number in range(benchmark.n_blocks):
        docs = stored(docs, "clean") if number else docs
        docs = clean(docs, matcher_of(benchmark.block(number)))
    return docs
