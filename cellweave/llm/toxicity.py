"""Toxicity: a linear classifier over character n-grams, each scaled by its naive Bayes
log-count ratio, trained on labelled texts."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.llm.chargrams import code_points, code_tables, gram_hashes
from cellweave.llm.common import by_batch, id_fraction, shuffle_partitions, stored, text_slices

#: Lengths of the grams; a gram lies in one word, with a blank for the word's begin or end.
GRAMS = (3, 4, 5, 6)
BLANK = np.uint64(32)
#: Bits of the table that tells quickly which hashes cannot be in the vocabulary.
SIEVE_BITS = 20


def word_grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every gram of the texts and the number of the text it is in."""
    lower, _, part, _ = code_tables()
    codes, text_at = code_points(texts)
    owner = np.repeat(np.arange(len(texts)), np.diff(text_at))
    plain = np.where(part[codes], lower[codes], np.uint32(32)).astype(np.uint64)
    blank = plain == BLANK
    kept = ~(blank & np.concatenate([[True], blank[:-1]]))
    plain, owner, blank = (
        np.concatenate([first, values[kept]])
        for first, values in (([BLANK], plain), (owner[:1], owner), ([True], blank))
    )
    blanks = np.concatenate([[0], np.cumsum(blank)])
    hashes, owners = [], []
    for n in GRAMS:
        value = gram_hashes(plain, n)
        at = np.arange(len(value))
        inside = np.flatnonzero(blanks[at + n - 1] == blanks[np.minimum(at + 1, len(blanks) - 1)])
        hashes.append(value[inside])
        owners.append(owner[inside + 1])
    return np.concatenate(hashes), np.concatenate(owners)


@dataclass
class ToxicityModel:
    """Sorted hashes of the chosen grams, their log-count ratios and weights, and the bias."""

    grams: np.ndarray
    ratios: np.ndarray
    weights: np.ndarray
    bias: float

    def present(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The chosen grams of each text, once each: numbers of text and gram, in order."""
        if not len(self.grams):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        shift = np.uint64(64 - SIEVE_BITS)
        sieve = np.zeros(1 << SIEVE_BITS, bool)
        sieve[self.grams >> shift] = True
        hashes, owner = word_grams(texts)
        maybe = np.flatnonzero(sieve[hashes >> shift])
        hashes, owner = hashes[maybe], owner[maybe]
        at = np.minimum(np.searchsorted(self.grams, hashes), len(self.grams) - 1)
        hit = self.grams[at] == hashes
        pairs = np.unique(owner[hit] * len(self.grams) + at[hit])
        return pairs // len(self.grams), pairs % len(self.grams)

    def score(self, texts: list[str | None]) -> np.ndarray:
        owner, gram = self.present(texts)
        total = np.bincount(owner, (self.ratios * self.weights)[gram], len(texts)) + self.bias
        return 1 / (1 + np.exp(-np.clip(total, -700, 700)))


def gram_counts(sample: DataFrame) -> DataFrame:
    """``gram, p, q``: toxic and other texts of ``sample(text, label)`` that hold each gram."""

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        label, parts = batch.column(1).to_numpy(), []
        for begin, end, texts in text_slices(batch.column(0)):
            hashes, owner = word_grams(texts)
            if not len(hashes):
                continue
            order = np.lexsort((owner, hashes))
            hashes, owner = hashes[order], owner[order]
            once = np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])])
            hashes, toxic = hashes[once], label[begin:end][owner[once]] == 1
            new = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
            both = np.add.reduceat(np.ones(len(hashes), np.int64), new)
            p = np.add.reduceat(toxic.astype(np.int64), new)
            parts.append((hashes[new].view(np.int64), p, both - p))
        columns = [np.concatenate(c) for c in zip(*parts, strict=True)] or [np.zeros(0, np.int64)] * 3
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["gram", "p", "q"])

    counted = sample.mapInArrow(by_batch(count), "gram bigint, p bigint, q bigint")
    return counted.groupBy("gram").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))


def fit_toxicity_model(
    docs: DataFrame,
    labels: DataFrame,
    fit_rows: int = 20_000,
    n_grams: int = 4096,
    min_texts: int = 5,
    smoothing: float = 1.0,
    penalty: float = 1e-3,
) -> ToxicityModel:
    """Train on the rows of ``docs(id, text)`` that ``labels(id, label)`` marks 0 or 1.

    ``fit_rows`` bounds the sample of labelled rows, taken by a hash of the id; ``n_grams``
    bounds the vocabulary: of the grams in ``min_texts`` texts or more, those whose shares of
    toxic and other texts differ most for their size. Weights are a penalised logistic
    regression on presence times log-count ratio. Without two classes every text gets the
    share of toxic rows (0 without any)."""
    labels = labels.where("label in (0, 1) and id is not null").select("id", "label").distinct()
    share = fit_rows / max(1, labels.count())
    chosen = labels if share >= 1 else labels.where(id_fraction("id", "toxicity") < share)
    # At most about fit_rows rows of two numbers, so the broadcast has a fixed bound.
    rows = docs.join(F.broadcast(chosen), "id").select("text", F.col("label").cast("int"))
    sample = stored(rows.repartition(shuffle_partitions(docs.sparkSession)), "labelled")
    total, toxic = sample.agg(F.count("label"), F.coalesce(F.sum("label"), F.lit(0))).first()
    if not 0 < toxic < total:
        rate = min(max(toxic / max(total, 1), 1e-9), 1 - 1e-9)
        none = np.zeros(0)
        return ToxicityModel(none.astype(np.uint64), none, none, float(np.log(rate / (1 - rate))))
    p = (F.col("p") + smoothing) / (toxic + 2 * smoothing)
    q = (F.col("q") + smoothing) / (total - toxic + 2 * smoothing)
    spread = p * (1 - p) / toxic + q * (1 - q) / (total - toxic)
    best = (
        gram_counts(sample)
        .where(F.col("p") + F.col("q") >= min_texts)
        .select("gram", F.log(p / q).alias("ratio"), ((p - q) * (p - q) / spread).alias("weight"))
        .orderBy(F.desc("weight"), "gram")
        .limit(n_grams)
        .collect()
    )
    grams = np.array([row["gram"] for row in best], np.int64).view(np.uint64)
    order = np.argsort(grams)
    ratios = np.array([row["ratio"] for row in best], float)[order]
    model = ToxicityModel(grams[order], ratios, np.zeros(len(best)), 0.0)
    return trained(model, sample, penalty)


def trained(model: ToxicityModel, sample: DataFrame, penalty: float) -> ToxicityModel:
    """The model with the weights of a logistic regression on the sample."""
    size = len(model.grams)

    def features(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = []
        for begin, end, texts in text_slices(batch.column(0)):
            owner, gram = model.present(texts)
            lists += np.split(gram, np.searchsorted(owner, np.arange(1, end - begin)))
        return pa.RecordBatch.from_arrays(
            [batch.column(1).cast("double"), pa.array(lists, pa.list_(pa.int64()))], ["label", "grams"]
        )

    ratios = model.ratios
    vector = F.udf(lambda grams: Vectors.sparse(size, grams, ratios[grams]), VectorUDT())
    rows = sample.mapInArrow(by_batch(features), "label double, grams array<bigint>")
    data = stored(rows, "features").select("label", vector("grams").alias("features"))
    fitted = LogisticRegression(maxIter=60, regParam=penalty, standardization=False).fit(data)
    return ToxicityModel(model.grams, ratios, fitted.coefficients.toArray(), fitted.intercept)


def score_toxicity(
    docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``id_col, score, predicted`` for every row: likelihood of label 1, and whether it is at
    least one half. Null and empty texts get the score of a text without any known gram.
    Texts are read whole; repeated rows are scored alike; null ids are kept; other columns
    are not read."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        score = np.concatenate([model.score(texts) for _, _, texts in text_slices(batch.column(1))])
        columns = [batch.column(0), pa.array(score), pa.array((score >= 0.5).astype(np.int32))]
        return pa.RecordBatch.from_arrays(columns, ["id", "score", "predicted"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(by_batch(run), f"id {kind}, score double, predicted int").withColumnRenamed(
        "id", id_col
    )
