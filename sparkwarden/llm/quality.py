"""A quality classifier on supervised subword embeddings, trained with numpy and applied in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkwarden.llm.common import batch_of, free_name, slices

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
MIX = np.uint64(0xD6E8FEB86659FD93)


@dataclass(frozen=True)
class Settings:
    """Sizes of the model and of the bounded sample of labelled rows that it is fitted on."""

    sample: int = 4000
    word_bits: int = 15
    gram_bits: int = 16
    grams: tuple[int, ...] = (2, 3, 4)
    lags: int = 4
    width: int = 8
    epochs: int = 6
    rate: float = 4.0
    seed: int = 7

    @property
    def plain(self) -> int:
        """Features but for those of repeated words, which come after them."""
        return (1 << self.word_bits) + (1 << self.gram_bits)


@dataclass(frozen=True)
class Model:
    """``table[f]`` is feature f's vector times the difference of the two softmax rows; ``bias`` likewise."""

    settings: Settings
    table: np.ndarray
    bias: float


# ---- features -------------------------------------------------------------------------------------


def features(texts: list[bytes], settings: Settings) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (feature numbers, index of the text of each): words, repeated words, character grams of each length.

    A word equal to the one ``lag`` words before has a feature for that, whatever the word. A gram lies in one word; white space may be its first or last byte and marks the word's edge.
    """
    data = np.frombuffer(b"\n" + b"\n".join(texts) + b"\n", np.uint8)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    owner = np.repeat(np.arange(len(texts)), lengths + 1)  # of each byte from the second on, separators included
    owner = np.append(owner[:1], owner) if len(texts) else owner
    space = SPACE[data]
    folded = np.where(space, np.uint8(32), data).astype(np.uint64)
    words, of = _words(folded, space), owner[np.flatnonzero(space[:-1] & ~space[1:]) + 1]
    yield (words >> np.uint64(64 - settings.word_bits)).astype(np.int64), of
    for lag in range(1, settings.lags + 1):
        again = np.flatnonzero((words[lag:] == words[:-lag]) & (of[lag:] == of[:-lag]))
        yield np.full(len(again), lag - 1 + settings.plain), of[again]
    shift, first = np.uint64(64 - settings.gram_bits), 1 << settings.word_bits
    for n in settings.grams:
        count = len(data) - n + 1
        if count <= 0:
            continue
        value = folded[:count].copy()
        for k in range(1, n):
            value *= np.uint64(257)
            value += folded[k : count + k]
        inner = range(1, n - 1) if n > 2 else range(0)
        good = np.ones(count, bool) if inner else ~(space[:count] & space[n - 1 :])
        for k in inner:
            good &= ~space[k : count + k]
        at = np.flatnonzero(good)
        value = (value[at] + np.uint64(n << 56)) * BASE
        yield first + (value >> shift).astype(np.int64), owner[at + 1]


def _words(folded: np.ndarray, space: np.ndarray) -> np.ndarray:
    """A polynomial hash of each word, from differences of prefix sums; all arithmetic modulo 2**64."""
    begins = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
    size = (ends - begins).astype(np.uint64)
    # a byte counts BASE to the power of its place in the buffer; the inverse takes a word's own place out again
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((folded + np.uint64(1)) * _powers(BASE, len(folded)))])
    value = (sums[ends] - sums[begins]) * _powers(INVERSE, len(folded))[begins] * MIX + size
    value ^= value >> np.uint64(29)
    return value * MIX


def _powers(base: np.uint64, count: int) -> np.ndarray:
    out = np.full(count, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


# ---- training -------------------------------------------------------------------------------------


def train(texts: list[bytes], labels: list[int], settings: Settings = Settings()) -> Model:
    """Stochastic gradient descent on the cross entropy of a softmax over averaged feature vectors."""
    rows = [_counted([t], settings) for t in texts]
    random = np.random.default_rng(settings.seed)
    size = settings.plain + settings.lags
    vectors = ((random.random((size, settings.width)) - 0.5) / settings.width).astype(np.float32)
    output, bias = np.zeros((settings.width, 2), np.float32), np.zeros(2, np.float32)
    steps, step = settings.epochs * len(rows), 0
    for _ in range(settings.epochs):
        for i in random.permutation(len(rows)).tolist():
            rate = settings.rate * (1 - step / steps)
            step += 1
            numbers, share = rows[i]
            mean = share @ vectors[numbers]
            logits = mean @ output + bias
            wrong = np.exp(logits - logits.max())
            wrong /= wrong.sum()
            wrong[labels[i]] -= 1
            back = output @ wrong
            output -= rate / 10 * np.outer(mean, wrong)
            bias -= rate / 100 * wrong
            vectors[numbers] -= np.outer(rate * share, back)  # a text's numbers are distinct
    apart = output[:, 1] - output[:, 0]
    return Model(settings, (vectors @ apart).astype(np.float32), float(bias[1] - bias[0]))


def _counted(texts: list[bytes], settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    numbers = np.concatenate([f for f, _ in features(texts, settings)])
    found, counts = np.unique(numbers, return_counts=True)
    return found.astype(np.int32), (counts / max(1, len(numbers))).astype(np.float32)


def scores(texts: list[bytes], model: Model) -> np.ndarray:
    """The softmax probability of label 1 for every text; without features the bias alone decides."""
    total, count = np.zeros(len(texts)), np.zeros(len(texts))
    for numbers, owner in features(texts, model.settings):
        total += np.bincount(owner, model.table[numbers], len(texts))
        count += np.bincount(owner, minlength=len(texts))
    return 1 / (1 + np.exp(-(total / np.maximum(count, 1) + model.bias)))


# ---- tables ---------------------------------------------------------------------------------------


def held_out() -> Column:
    """Whether a document's label must not be learned from."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 3 == 1


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """Fit on at most ``settings.sample`` labelled documents, the first in the order of a hash of their ids.

    Only rows that are not held out, have a text and one undisputed label 0 or 1 are used. The list of
    sampled ids has that bound, so it is safe to send to all tasks; texts are not moved but for the sample.
    Without a row of each label the model gives 1, the label of all that is known, or 0.5 where none is known.
    """
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
        .filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"), F.max("quality").alias("most"))
        .filter("quality = most")
    )
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(settings.sample).select(F.col("doc_id").alias("id"), "quality")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("text IS NOT NULL")
    sample = texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("id")).groupBy("doc_id").agg(
        F.min(F.struct("text", "quality")).alias("row")
    )
    rows = sorted((r.doc_id, r.row.quality, r.row.text.encode()) for r in sample.collect())
    found = {quality for _, quality, _ in rows}
    if len(found) < 2:
        return Model(settings, np.zeros(settings.plain + settings.lags, np.float32), {frozenset([0]): -20.0, frozenset([1]): 20.0}.get(frozenset(found), 0.0))
    return train([t for _, _, t in rows], [q for _, q, _ in rows], settings)


def quality_scores(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row for each row of ``docs(doc_id, text)``.

    ``score`` is the probability of label 1 from the text alone; a null text counts as empty, which gives the
    bias's score. Repeated rows give repeated rows with equal scores, an empty table an empty result, a null
    doc_id stays null (and counts as the empty text in ``held_out``); other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, 2):
                found = scores(texts, model)
                yield batch_of([("doc_id", part.column(0), None), ("held_out", part.column(1), None), ("score", found, pa.float64())])

    scored = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text")
    ).mapInArrow(run, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` predicted as label 1, with all their columns and in place."""
    name = free_name(docs, "scored_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, batch.num_columns - 1):
                yield part.filter(pa.array(scores(texts, model) >= 0.5)).select(list(range(batch.num_columns - 1)))

    return docs.withColumn(name, F.col("text").cast("string")).mapInArrow(run, docs.schema)
