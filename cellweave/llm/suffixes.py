"""Repeated passages by a sparse suffix array over words.

A passage is a run of ``min_words`` words that has occurred before, in the order of ids and
positions. Suffixes are kept at minimiser positions only: the least of the hashed word runs
in a window is the same wherever the window's words occur, so every occurrence of a passage
keeps the suffix at the same place. The kept suffixes are sorted by their first words over
the whole cluster and compared with their neighbours; those that equal a neighbour are
extended to the left and the right, window by window, back in their documents."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.llm.common import by_batch, shuffle_partitions, stored, text_slices
from cellweave.llm.wordhash import words_of


@dataclass(frozen=True)
class Lengths:
    """The lengths that follow from the least passage: ``window`` run starts compete for a
    minimiser, ``gram`` words make a run, and ``prefix`` words of a suffix always lie inside
    the passage that selected it."""

    passage: int

    @property
    def window(self) -> int:
        return 1 << ((2 * self.passage // 3).bit_length() - 1)

    @property
    def prefix(self) -> int:
        return self.passage - self.window + 1

    @property
    def gram(self) -> int:
        return min(8, self.prefix)


def least_of_windows(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` (a power of two) neighbouring values, by doubling."""
    step = 1
    while step < width:
        values = np.minimum(values[:-step], values[step:])
        step *= 2
    return values


def kept_suffixes(texts: list[str | None], lengths: Lengths) -> tuple[np.ndarray, ...]:
    """For each kept suffix: number of its text, prefix hash, its word, and the first and last
    passage start that selected it (words count from the start of the text)."""
    words = words_of(texts)
    n = len(words.starts)
    empty = np.zeros(0, np.int64)
    if n < lengths.passage:
        return empty, empty, empty, empty, empty
    grams = words.grams(np.arange(n - lengths.gram + 1), lengths.gram)
    ranked = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    chosen = least_of_windows(ranked, lengths.window) & np.uint64(0xFFFFFFFF)
    sizes = np.diff(words.text_at)
    owner = np.repeat(np.arange(len(texts)), sizes)
    begin = np.arange(n)
    begin = begin[begin + lengths.passage <= words.text_at[owner + 1]]
    at = chosen[begin].astype(np.int64)
    new = np.flatnonzero(np.diff(at, prepend=-1))
    last = np.append(new[1:], len(at)) - 1
    at, low, high = at[new], begin[new], begin[last]
    owner = owner[at]
    first = words.text_at[owner]
    keys = words.grams(at, lengths.prefix).view(np.int64)
    return owner, keys, at - first, low - first, high - first


def suffix_table(docs: DataFrame, lengths: Lengths) -> DataFrame:
    """``key, id, at, low, high`` for every kept suffix of ``docs(id, text)``."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        parts = []
        for begin, _, texts in text_slices(batch.column(1)):
            owner, *columns = kept_suffixes(texts, lengths)
            parts.append((owner + begin, *columns))
        owner, keys, *places = (np.concatenate(column) for column in zip(*parts, strict=True))
        columns = [pa.array(keys), batch.column(0).take(pa.array(owner))]
        columns += [pa.array(place.astype(np.int32)) for place in places]
        return pa.RecordBatch.from_arrays(columns, ["key", "id", "at", "low", "high"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(by_batch(run), f"key bigint, id {kind}, at int, low int, high int")


def beside_equals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of one sorted partition, the suffixes whose prefix equals a neighbour's, and the first
    and last suffix, whose other neighbour is in another partition (``edge``)."""
    held: pa.Table | None = None
    last_key, began = None, False

    def decided(rows: pa.Table, follower: int | None, final: bool) -> list[pa.RecordBatch]:
        nonlocal last_key, began
        keys = rows.column("key").to_numpy()
        same = keys[1:] == keys[:-1]
        before = np.append([last_key is not None and keys[0] == last_key], same)
        after = np.append(same, [follower is not None and keys[-1] == follower])
        edge = np.zeros(len(keys), bool)
        edge[0], edge[-1] = not began, final
        began, last_key = True, keys[-1]
        marked = rows.append_column("repeated", pa.array(before | after)).append_column(
            "edge", pa.array(edge)
        )
        return marked.filter(pa.array(before | after | edge)).combine_chunks().to_batches()

    for batch in batches:
        if not batch.num_rows:
            continue
        if held is not None:
            yield from decided(held, batch.column(0)[0].as_py(), False)
        held = pa.Table.from_batches([batch])
    if held is not None:
        yield from decided(held, None, True)


def repeated_suffixes(suffixes: DataFrame) -> DataFrame:
    """Sort all suffixes and keep those with an equal neighbour. The position is part of the
    sort key, so a prefix that very many documents share spreads over several partitions; the
    two edge rows of each partition are settled among themselves."""
    spark = suffixes.sparkSession
    order = ["key", "id", "at"]
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in suffixes.schema)
    found = stored(
        suffixes.repartitionByRange(shuffle_partitions(spark), *order)
        .sortWithinPartitions(*order)
        .mapInArrow(beside_equals, f"{kinds}, repeated boolean, edge boolean"),
        "repeated-suffixes",
    )
    at_edges = found.where("edge").groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    lonely = found.where("edge and not repeated").join(at_edges.select("key"), "key", "left_semi")
    return found.where("repeated").unionByName(lonely).drop("repeated", "edge")


def extended(docs: DataFrame, repeated: DataFrame, lengths: Lengths) -> DataFrame:
    """``hash, id, at``: the passage windows around the repeated suffixes."""
    ranges = repeated.groupBy("id").agg(F.collect_set(F.struct("low", "high")).alias("ranges"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ranges, owners, hashes, places = batch.column(2), [], [], []
        for begin, end, texts in text_slices(batch.column(1)):
            words = words_of(texts)
            for i in range(begin, end):
                pairs = ranges[i].values
                low, high = (pairs.field(k).to_numpy().astype(np.int64) for k in (0, 1))
                spread = high - low + 1
                at = np.arange(spread.sum()) + np.repeat(low - (np.cumsum(spread) - spread), spread)
                hashes.append(words.grams(at + words.text_at[i - begin], lengths.passage))
                places.append(at)
                owners.append(np.full(len(at), i))
        columns = [
            pa.array(np.concatenate(hashes).view(np.int64)),
            batch.column(0).take(pa.array(np.concatenate(owners))),
            pa.array(np.concatenate(places).astype(np.int32)),
        ]
        return pa.RecordBatch.from_arrays(columns, ["hash", "id", "at"])

    kind = docs.schema["id"].dataType.simpleString()
    # Rows that share an id are one document: its longest text is read.
    texts = docs.join(ranges, "id")
    return texts.mapInArrow(by_batch(run), f"hash bigint, id {kind}, at int")


def repeated_passages(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50
) -> DataFrame:
    """``id_col, begin, end, source_id``: maximal stretches of words (``begin`` inclusive, ``end``
    exclusive, counted from 0) in which every run of ``min_words`` words has occurred before,
    in a document of lesser id or earlier in the same one. ``source_id`` is the least id that
    holds a part of the stretch first. First occurrences are not listed.

    Words are separated by ASCII white space and compared as they are. Null, empty and short
    texts hold no passage; rows with a null id are left out; repeated rows with one id and
    text are one document; other columns are not read. Texts are read whole. Equal prefixes
    of a hot passage are spread by position, counted before the shuffle, and never listed in
    one place; the lists that do occur are bounded by the length of one document."""
    lengths = Lengths(min_words)
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(
        "id is not null and text is not null"
    )
    suffixes = stored(suffix_table(docs, lengths), "suffixes")
    windows = stored(extended(docs, repeated_suffixes(suffixes), lengths), "windows")
    # Stored, so that the join below is one of two plain tables, whose hot keys Spark splits.
    firsts = stored(
        windows.groupBy("hash")
        .agg(F.min(F.struct("id", "at")).alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1"),
        "first-windows",
    )
    again = windows.join(firsts, "hash").where("struct(id, at) != first")
    per_doc = again.groupBy("id").agg(
        F.sort_array(F.collect_set(F.struct("at", F.col("first.id").alias("source")))).alias("hits")
    )

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        owners, begins, ends, sources = [], [], [], []
        for i in range(batch.num_rows):
            hits = batch.column(1)[i].values
            at, source = hits.field(0).to_numpy(), hits.field(1).to_numpy()
            new = np.flatnonzero(np.diff(at, prepend=at[0] - min_words - 1) > min_words)
            begins.append(at[new])
            ends.append(at[np.append(new[1:], len(at)) - 1] + min_words)
            sources.append(np.minimum.reduceat(source, new))
            owners.append(np.full(len(new), i))
        columns = [
            batch.column(0).take(pa.array(np.concatenate(owners))),
            pa.array(np.concatenate(begins).astype(np.int32)),
            pa.array(np.concatenate(ends).astype(np.int32)),
            pa.array(np.concatenate(sources)),
        ]
        return pa.RecordBatch.from_arrays(columns, ["id", "begin", "end", "source_id"])

    kind = docs.schema["id"].dataType.simpleString()
    spans = per_doc.mapInArrow(by_batch(run), f"id {kind}, begin int, end int, source_id {kind}")
    return spans.withColumnRenamed("id", id_col)


def cut(text: str, spans: list[dict[str, int]]) -> str:
    """A text without the given stretches of words; the rest stays as it is."""
    words, data = words_of([text]), text.encode()
    kept, at = [], 0
    for begin, end in sorted((span["begin"], span["end"]) for span in spans):
        kept.append(data[at : words.starts[begin]])
        at = int(words.ends[end - 1])
    return b"".join([*kept, data[at:]]).decode().strip()


def cut_passages(
    docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text", size_col: str = "n_chars"
) -> DataFrame:
    """``docs`` with the stretches of ``spans`` cut from their texts; ``size_col``, if there is one,
    is the length of what is left. Rows that lose words and have none left are dropped; rows
    without a stretch stay as they are, null ids and empty texts included."""
    lists = spans.groupBy(F.col(id_col).alias("_id")).agg(
        F.collect_set(F.struct("begin", "end")).alias("_cuts")
    )
    joined = docs.join(lists, docs[id_col] == lists["_id"], "left").select(*docs.columns, "_cuts")
    names, width = docs.columns, len(docs.columns)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, cuts, changed = batch.column(names.index(text_col)), batch.column(width), {}
        for i in np.flatnonzero(cuts.is_valid().to_numpy(zero_copy_only=False)):
            changed[int(i)] = cut(texts[i].as_py(), cuts[i].as_py())
        columns = {name: batch.column(i) for i, name in enumerate(names)}
        if changed:
            columns[text_col] = replaced(texts, changed)
            if size_col in columns:
                columns[size_col] = replaced(columns[size_col], {i: len(t) for i, t in changed.items()})
        keep = pa.array([changed.get(i) != "" for i in range(batch.num_rows)])
        return pa.RecordBatch.from_arrays(list(columns.values()), names).filter(keep)

    return joined.mapInArrow(by_batch(run), docs.schema)


def replaced(column: pa.Array, values: dict[int, object]) -> pa.Array:
    """``column`` with some of its values replaced."""
    marked = np.zeros(len(column), bool)
    marked[list(values)] = True
    fresh = pa.array([values[i] for i in sorted(values)], column.type)
    return pc.replace_with_mask(column, pa.array(marked), fresh)
