"""Groups of spelling variants: words that differ by one letter, and the form they point to.

One error leaves either the first or the second half of a word as it is. The vocabulary is
therefore dealt out twice, in the order of the words and in that of the reversed words, in
shards of a fixed number of words; a word is sent to the shards that hold words with its first
half, or with its second. Every shard has a bidirectional FM-index over its delimited words."""

from __future__ import annotations

import math
import re
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.llm.common import discard, stored, text_slices
from cellweave.llm.fmindex import WordIndex

#: Fixed value: a word is a run of these characters.
RUN = r"[A-Za-zÀ-ÿ]+"
#: Words of a shard, as a power of two, and searches that one task makes in it.
SHARD_BITS = 13
SEARCHES = 1 << 16
#: Letters of an index times its distinct letters, so that it takes about 130 MB; a shard of long words
#: or of many different letters has several indexes.
INDEX_CELLS = 1 << 24
#: Words that a worker counts before it hands them on.
COUNTED = 400_000


def word_counts(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    run: str = RUN,
    min_length: int = 7,
    min_count: int = 2,
    drop_one_in: int | None = None,
) -> DataFrame:
    """``word, n``: the words of all texts that have ``min_length`` characters or more and occur
    ``min_count`` times or more.

    Words are the longest runs that match ``run``, with A-Z in lower case. With ``drop_one_in`` some
    are planted as misspelt: where it divides the crc32 of id, colon and word, every occurrence
    in that document loses the character whose number is the crc32 modulo the word's length.
    Null texts have no words, a null id counts as empty text, repeated rows are counted each, and
    other columns are not read. Counts are added up in the tasks before they are shuffled."""
    found = re.compile(run)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for begin, end, texts in text_slices(batch.column(1).cast(pa.binary())):
                for i, text in zip(ids[begin:end], texts, strict=True):
                    words = Counter(found.findall((text or b"").lower().decode()))
                    start = zlib.crc32(f"{i}:".encode())
                    for word, n in words.items():
                        if len(word) < min_length:
                            continue
                        if drop_one_in and (h := zlib.crc32(word.encode(), start)) % drop_one_in == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                            if len(word) < min_length:
                                continue
                        total[word] += n
                if len(total) > COUNTED:
                    yield counted(total)
                    total = Counter()
        yield counted(total)

    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).alias("text"))
    counts = rows.mapInArrow(count, "word string, n bigint")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def counted(total: Counter[str]) -> pa.RecordBatch:
    columns = [pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())]
    return pa.RecordBatch.from_arrays(columns, ["word", "n"])


def searched(words: DataFrame, first_half: bool) -> DataFrame:
    """``word, near, near_n``: for every word of ``words(word, n)`` those that have its first half, or
    else its second half, and differ by one error in the other.

    The bounds of the shards, one word for every 8,192, are all that the driver holds. A shard that
    many words are sent to, as where many begin alike, takes them in several groups, each with
    its own copy of the shard, so that no group has more than some 65,000 searches."""
    key = F.col("word") if first_half else F.reverse("word")
    dealt = words.withColumn("key", key).repartitionByRange("key").sortWithinPartitions("key")
    shard = F.shiftright(F.monotonically_increasing_id(), SHARD_BITS)
    sharded = stored(dealt.withColumn("shard", shard), "shards")
    starts = sharded.groupBy("shard").agg(F.min("key").alias("key")).orderBy("key").collect()
    bounds, numbers = [r.key for r in starts], np.array([r.shard for r in starts], np.int64)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_pylist()
            first, last = [], []
            for word in keys:
                half = word[: len(word) // 2 if first_half else (len(word) + 1) // 2]
                first.append(max(0, bisect_right(bounds, half) - 1))
                last.append(bisect_right(bounds, half, key=lambda bound, n=len(half): bound[:n]))
            counts = np.array(last, np.int64) - first
            at = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts - first, counts)
            owners = pa.array(np.repeat(np.arange(len(keys)), counts))
            yield pa.RecordBatch.from_arrays([pa.array(numbers[at]), batch.column(1).take(owners)], ["shard", "word"])

    sent = sharded.select("key", "word").mapInArrow(send, "shard bigint, word string")
    sent = stored(sent, "searches")
    groups = sent.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / SEARCHES).cast("int").alias("groups"))
    groups = stored(groups, "groups")
    part = F.pmod(F.xxhash64("word"), F.col("groups")).cast("int")
    queries = sent.join(groups, "shard").select("shard", part.alias("part"), "word")
    held = sharded.join(groups, "shard").select(
        "shard", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("part"), "word", "n"
    )

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        words, asked = right.column("word").to_pylist(), left.column("word").to_pylist()
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for begin, end in portions(words) if asked else []:
            query, place = WordIndex(words[begin:end]).one_error(asked, first_half)
            found.append((query, place + begin))
        query, place = (pa.array(np.concatenate(c)) for c in zip(*found, strict=True))
        near = right.select(["word", "n"]).combine_chunks().take(place)
        return pa.table([left.column("word").combine_chunks().take(query), *near.columns], names=["word", "near", "near_n"])

    cut = ["shard", "part"]
    return queries.groupBy(*cut).cogroup(held.groupBy(*cut)).applyInArrow(search, "word string, near string, near_n bigint")


def portions(words: list[str]) -> Iterator[tuple[int, int]]:
    """Begin and end of runs of words that make an index of bounded size; a longer word stands alone."""
    letters = len(set().union(*words)) + 2
    begin, size = 0, 0
    for i, word in enumerate(words):
        if i > begin and (size + len(word) + 1) * letters > INDEX_CELLS:
            yield begin, i
            begin, size = i, 0
        size += len(word) + 1
    if words:
        yield begin, len(words)


def near_words(words: DataFrame) -> DataFrame:
    """``word, near, near_n`` for every pair of ``words(word, n)`` that differ by exactly one inserted,
    deleted or replaced character, in both directions. A pair that both searches find, as where a
    letter is doubled in the middle, comes twice. Words are distinct, not null and not empty."""
    return searched(words, True).unionAll(searched(words, False))


def spelling_variants(words: DataFrame, factor: int = 10) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for every row of ``words(word, n)``.

    ``n_near`` counts the words one error away. ``form`` is the most frequent of them, ties to the
    first in code-point order, if it is at least ``factor`` times as frequent as the word, with its
    count ``form_n``; otherwise both are null. ``root`` is the last word that forms lead to from the
    word, itself if it has none. Null and empty words are left out; a word that is there twice
    counts once, with the sum of its counts; an empty table gives an empty result."""
    given = words.where("word != ''").groupBy("word").agg(F.sum(F.col("n").cast("bigint")).alias("n"))
    vocabulary = stored(given, "vocabulary")
    none = F.lit(None)
    own = vocabulary.select("word", none.cast("string").alias("near"), none.cast("bigint").alias("near_n"), "n")
    rows = own.unionByName(near_words(vocabulary).withColumn("n", none.cast("bigint")))
    near = F.collect_set(F.when(F.col("near").isNotNull(), F.struct("near_n", "near")))
    best = F.array_min(F.transform("all_near", lambda x: F.struct((-x["near_n"]).alias("less"), x["near"].alias("near"))))
    formed = rows.groupBy("word").agg(F.max("n").alias("n"), near.alias("all_near")).select(
        "word", "n", F.size("all_near").cast("bigint").alias("n_near"), best.alias("best")
    )
    has_form = -F.col("best.less") >= factor * F.col("n")
    formed = stored(
        formed.select(
            "word", "n", "n_near", F.when(has_form, F.col("best.near")).alias("form"), F.when(has_form, -F.col("best.less")).alias("form_n")
        ),
        "forms",
    )
    last = roots(formed, factor)
    return formed.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def roots(formed: DataFrame, factor: int) -> DataFrame:
    """``word, root`` of the words that have a form. Each form is ``factor`` times as frequent, so a
    chain has few steps; every round doubles the steps that are taken."""
    if factor < 2:
        raise ValueError("a form is at least twice as frequent")
    least, most = formed.agg(F.min("n"), F.max("n")).first()
    steps = math.floor(math.log(most / max(1, least), factor) + 1e-9) if least else 0
    state = stored(formed.where("form is not null").select("word", F.col("form").alias("root")), "roots")
    for _ in range(math.ceil(math.log2(steps)) if steps > 1 else 0):
        further = state.select(F.col("word").alias("root"), F.col("root").alias("next"))
        fresh = stored(state.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
        discard(state)
        state = fresh
    return state
