"""Language identification by words.

Script ranges narrow the languages a word can have, hashed character n-grams score them, and
a Viterbi pass with a penalty for every change of language labels spans of mixed text."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.llm.chargrams import N_SCRIPTS, code_points, code_tables, gram_hashes
from cellweave.llm.common import by_batch, id_fraction, text_slices

UNKNOWN = "und"
#: Bits of a gram's bucket and lengths of the grams, which see one blank on either side of a word.
BUCKET_BITS, GRAMS = 16, (3, 4)
#: Share of the background in every language's gram frequencies, and a bound of one gram's score.
BACKGROUND, MOST = 0.05, 4.0
#: Least share of a script in a language's letters that makes the language its candidate.
SCRIPT_SHARE = 0.005


@dataclass
class TextWords:
    """The words of several texts: owner, first and last character, letters, script, and the
    bucket of each gram with the word it belongs to."""

    owner: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    letters: np.ndarray
    script: np.ndarray
    grams: list[tuple[np.ndarray, np.ndarray]]
    text_at: np.ndarray


def words_in(texts: list[str | None]) -> TextWords:
    lower, letter, part, script = code_tables()
    codes, text_at = code_points(texts)
    inside = part[codes]
    change = np.diff(inside.astype(np.int8), prepend=0)
    begin, end = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
    letters = np.concatenate([[0], np.cumsum(letter[codes])])
    count = letters[end] - letters[begin]
    keep = count > 0
    begin, end, count = begin[keep], end[keep], count[keep]
    plain = np.where(inside, lower[codes], np.uint32(32)).astype(np.uint64)
    plain = np.concatenate([[np.uint64(32)], plain])
    grams = []
    for n in GRAMS:
        hashes = gram_hashes(plain, n) >> np.uint64(64 - BUCKET_BITS)
        # A word of m characters and its two blanks have m + 3 - n grams, at least one.
        size = np.maximum(end - begin + 3 - n, 1)
        word = np.repeat(np.arange(len(begin)), size)
        place = np.arange(size.sum()) + np.repeat(begin - (np.cumsum(size) - size), size)
        grams.append((hashes[np.minimum(place, max(len(hashes) - 1, 0))].astype(np.int64), word))
    owner = np.searchsorted(text_at, begin, side="right") - 1
    return TextWords(owner, begin, end, count, script[codes[begin]], grams, text_at)


@dataclass
class LanguageModel:
    """``scores``: by bucket, how much more usual a gram is in each language than on average;
    ``scripts``: by script, which languages use it."""

    languages: list[str]
    scores: np.ndarray
    scripts: np.ndarray

    def word_scores(self, words: TextWords) -> np.ndarray:
        total = np.zeros((len(words.begin), len(self.languages)), np.float32)
        for bucket, word in words.grams:
            if len(word):
                first = np.flatnonzero(np.diff(word, prepend=-1))
                total += np.add.reduceat(self.scores[bucket], first, axis=0)
        allowed = self.scripts[words.script]
        total[~allowed & allowed.any(axis=1, keepdims=True)] -= 1000
        return total


def fit_language_model(
    docs: DataFrame, text: Column, lang: Column, key: Column, fit_rows: int = 20_000
) -> LanguageModel:
    """Count grams and scripts of a sample of the labelled rows of ``docs``.

    ``fit_rows`` bounds the sample; rows are taken by a hash of ``key``, so the sample is the
    same on every run. The counts have at most languages x (2^16 + scripts) rows."""
    labelled = docs.select(key.alias("key"), text.alias("text"), lang.alias("lang")).where(
        "lang is not null"
    )
    share = fit_rows / max(1, labelled.count())
    sample = labelled if share >= 1 else labelled.where(id_fraction("key", "language") < share)

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        names = batch.column(1).dictionary_encode()
        kinds, size = len(names.dictionary), (1 << BUCKET_BITS) + N_SCRIPTS
        which = names.indices.to_numpy()
        sums = np.zeros(kinds * size, np.int64)
        for begin, end, texts in text_slices(batch.column(0)):
            words = words_in(texts)
            at = which[begin:end][words.owner].astype(np.int64) * size
            for bucket, word in words.grams:
                sums += np.bincount(at[word] + bucket, minlength=len(sums))
            script = at + (1 << BUCKET_BITS) + words.script
            sums += np.bincount(script, words.letters, len(sums)).astype(np.int64)
        seen = np.flatnonzero(sums)
        columns = [names.dictionary.take(pa.array(seen // size)), pa.array((seen % size).astype(np.int32)), pa.array(sums[seen])]
        return pa.RecordBatch.from_arrays(columns, ["lang", "slot", "n"])

    counted = (
        sample.select("text", F.col("lang").cast("string").alias("lang"))
        .mapInArrow(by_batch(count), "lang string, slot int, n bigint")
        .groupBy("lang", "slot")
        .agg(F.sum("n").alias("n"))
        .toPandas()
    )
    languages = sorted(counted["lang"].unique())
    table = np.zeros(((1 << BUCKET_BITS) + N_SCRIPTS, len(languages)))
    table[counted["slot"], counted["lang"].map({l: i for i, l in enumerate(languages)})] = counted["n"]
    grams, scripts = table[: 1 << BUCKET_BITS], table[1 << BUCKET_BITS :]
    own = grams / np.maximum(grams.sum(axis=0), 1)
    usual = own.mean(axis=1, keepdims=True) if languages else own
    tiny = 1e-7
    ratio = np.log(((1 - BACKGROUND) * own + BACKGROUND * usual + tiny) / (usual + tiny))
    scores = np.clip(ratio, -MOST, MOST).astype(np.float32)
    return LanguageModel(languages, scores, scripts >= SCRIPT_SHARE * scripts.sum(axis=0) if languages else scripts > 0)


def one_language(
    scores: np.ndarray, first: np.ndarray, size: np.ndarray, penalty: float
) -> tuple[np.ndarray, np.ndarray]:
    """The best single language of each text, and whether no path with changes can be better: no
    stretch of words gains more than half a penalty from another language. Then s stretches
    of other languages gain at most s/2 penalties and cost s, or s - 1 if they fill the text."""
    full = np.flatnonzero(size)
    best, settled = np.zeros(len(size), np.int64), np.ones(len(size), bool)
    if not len(full):
        return best, settled
    wide = scores.astype(np.float64)
    best[full] = np.add.reduceat(wide, first[full], axis=0).argmax(axis=1)
    owner = np.repeat(np.arange(len(size)), size)
    gains = wide - wide[np.arange(len(wide)), best[owner]][:, None]
    sums = np.cumsum(gains, axis=0)
    # Texts are set apart by more than any sum, so that each has a running minimum of its own.
    apart = owner[:, None] * (2 * np.abs(sums).max() + 1)
    lowest = np.minimum.accumulate(sums - gains - apart, axis=0)
    most = np.maximum.reduceat((sums - apart - lowest).max(axis=1), first[full])
    settled[full] = most <= penalty / 2
    return best, settled


def viterbi(scores: np.ndarray, first: np.ndarray, size: np.ndarray, penalty: float) -> np.ndarray:
    """The best language of each word when every change costs ``penalty``. Texts of one language
    are told at once; the others advance word by word together, the longest first, so that
    those that have ended drop out."""
    single, settled = one_language(scores, first, size, penalty)
    kind = np.int16 if scores.shape[1] < 1 << 15 else np.int32
    labels = np.repeat(single, size).astype(kind)
    order = np.argsort(-size, kind="stable")
    order = order[~settled[order]]
    first, size = first[order], size[order]
    longest = int(size[0]) if len(size) else 0
    if not longest:
        return labels
    active = np.searchsorted(-size, -np.arange(longest + 1), side="left")  # texts with word t
    back = np.zeros(scores.shape, kind)
    own = np.arange(scores.shape[1], dtype=kind)
    at_end = np.zeros(len(size), kind)
    best = scores[first[: active[0]]]
    for t in range(longest):
        n = active[t]
        if t:
            best, word = best[:n], first[:n] + t
            top = best.argmax(axis=1)
            switched = best[np.arange(n), top][:, None] - penalty
            back[word] = np.where(best >= switched, own, top[:, None].astype(kind))
            best = np.maximum(best, switched) + scores[word]
        if active[t + 1] < n:
            at_end[active[t + 1] : n] = best[active[t + 1] :].argmax(axis=1)
    label = at_end
    for t in range(longest - 1, -1, -1):
        n = active[t]
        word = first[:n] + t
        labels[word] = label[:n]
        label[:n] = back[word, label[:n]]
    return labels


def labelled(model: LanguageModel, texts: list[str | None], penalty: float) -> tuple[np.ndarray, ...]:
    """For each text the number of its language and its score, and the spans: how many each text
    has, and of all of them begin, end and language."""
    kinds = len(model.languages)
    n = len(texts)
    words = words_in(texts if kinds else [None] * n)
    scores = model.word_scores(words)
    size = np.bincount(words.owner, minlength=n)
    labels = viterbi(scores, np.cumsum(size) - size, size, penalty)
    cell = words.owner * max(kinds, 1) + labels
    letters = np.bincount(cell, words.letters, n * max(kinds, 1)).reshape(n, -1)
    total = letters.sum(axis=1)
    chosen = letters.argmax(axis=1)
    mine = labels == chosen[words.owner]
    sums = np.stack(
        [np.bincount(words.owner[mine], scores[mine, k], n) for k in range(kinds)], axis=1
    ) if kinds else np.zeros((n, 1))
    ahead = sums - sums[np.arange(n), chosen][:, None]
    likely = 1 / np.exp(np.clip(ahead, -700, 50)).sum(axis=1)
    share = letters.max(axis=1) / np.maximum(total, 1)
    new = np.flatnonzero((np.diff(words.owner, prepend=-1) != 0) | (np.diff(labels, prepend=-1) != 0))
    last = np.append(new[1:], len(labels))[: len(new)] - 1
    offset = words.text_at[words.owner[new]]
    return (
        np.where(total > 0, chosen, kinds),
        np.where(total > 0, share * likely, 0.0),
        np.bincount(words.owner[new], minlength=n),
        words.begin[new] - offset,
        words.end[last] - offset,
        labels[new],
    )


def with_language(
    docs: DataFrame, model: LanguageModel, text_col: str = "text", min_score: float = 0.0, penalty: float = 10.0
) -> DataFrame:
    """The rows of ``docs`` whose language is recognised with at least ``min_score``, by the rules
    of ``label_languages``; rows are judged where they are."""
    place, unknown = docs.columns.index(text_col), len(model.languages)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        kept = []
        for _, _, texts in text_slices(batch.column(place), 250_000):
            chosen, score = labelled(model, texts, penalty)[:2]
            kept.append((chosen != unknown) & (score >= min_score))
        return batch.filter(pa.array(np.concatenate(kept)))

    return docs.mapInArrow(by_batch(run), docs.schema)


def label_languages(
    docs: DataFrame,
    model: LanguageModel,
    id_col: str = "doc_id",
    text_col: str = "text",
    penalty: float = 10.0,
) -> DataFrame:
    """``id_col, lang_pred, score, spans`` for every row of ``docs``.

    ``lang_pred`` is the language with most letters; ``score`` is its share of the letters
    times the likelihood that its words are of that language rather than another; ``spans``
    lists begin, end (characters) and language of the stretches of one language. A text that
    is null, empty or has no letters, and any text if no language was learned, is ``und``
    with score 0 and no spans. Equal counts go to the language first in the alphabet.
    Repeated rows are labelled alike; null ids are kept; other columns are not read."""
    names = pa.array([*model.languages, UNKNOWN])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        parts = [labelled(model, texts, penalty) for _, _, texts in text_slices(batch.column(1))]
        chosen, score, n_spans, begin, end, lang = map(np.concatenate, zip(*parts, strict=True))
        spans = pa.StructArray.from_arrays(
            [pa.array(begin), pa.array(end), names.take(pa.array(lang.astype(np.int32)))],
            ["begin", "end", "lang"],
        )
        starts = pa.array(np.concatenate([[0], np.cumsum(n_spans)]).astype(np.int32))
        columns = [
            batch.column(0),
            names.take(pa.array(chosen.astype(np.int32))),
            pa.array(score),
            pa.ListArray.from_arrays(starts, spans),
        ]
        return pa.RecordBatch.from_arrays(columns, ["id", "lang_pred", "score", "spans"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(
        by_batch(run),
        f"id {kind}, lang_pred string, score double, "
        "spans array<struct<begin: bigint, end: bigint, lang: string>>",
    ).withColumnRenamed("id", id_col)
