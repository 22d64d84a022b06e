"""Toxicity by a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

The features of a document are the n-grams of its distinct words, each word with its edges marked. Over a
bounded sample of labelled documents, of whose words those up to `LONGEST` characters, Spark counts in how many toxic and other
documents the n-grams of toxic ones occur; the `features` whose shares differ most clearly are kept, each scaled by the log of the ratio of its shares.
A logistic regression over the scaled features is fitted in numpy, and all texts are scored in one pass
without a shuffle, words looked up in the worker's cache.

Scores are of whole texts. Words over `KEPT_CHARS` characters are read n-gram by n-gram and not kept, so one word may be as long
as a text may be.

Defined results: a null or empty text has no features and gets the score of the intercept. Without labelled
rows of both classes nothing can be told apart: every score is the smoothed share of toxic rows, 0.25 if
there are none. Rows are independent, so ties, repeats and null ids pass through. Other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterlens.llm.common import slices, staged

SIZES = (3, 4, 5, 6, 7)
CACHE_ENTRIES = 200_000
KEPT_CHARS = 64  # of a word in the cache
LONGEST = 256  # characters of a word that n-grams are learnt from
GRAMS_HELD = 1 << 19  # counts that a task holds
NO_LETTERS = "".join(map(chr, [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]))


def each_gram(word: str) -> Iterator[str]:
    """The n-grams of a word between its edge marks, in lower case and without signs around it."""
    marked = f"<{word.strip(NO_LETTERS).lower()}>"
    return (marked[i : i + n] for n in SIZES for i in range(len(marked) - n + 1))


def grams(word: str) -> set[str]:
    return set(each_gram(word))


def learnt_words(text: str | None) -> set[str]:
    return {w for w in (text or "").split() if len(w) <= LONGEST}


class FeaturesOf(dict):
    """Word -> numbers of its features, kept for the words that come again."""

    def __init__(self, numbers: dict[str, int]):
        super().__init__()
        self.numbers = numbers

    def __missing__(self, word: str) -> tuple[int, ...]:
        numbers = self.numbers
        got = tuple({numbers[g] for g in each_gram(word) if g in numbers})
        if len(word) <= KEPT_CHARS:
            if len(self) > CACHE_ENTRIES:
                self.clear()
            self[word] = got
        return got

    def text(self, text: str | None) -> set[int]:
        return set().union(*map(self.__getitem__, set((text or "").split())))


@dataclass
class ToxicityModel:
    intercept: float
    numbers: dict[str, int] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))


def _grams_of_texts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many texts of the task each n-gram occurs, in parts that add up."""
    counts: Counter = Counter()

    def part() -> pa.RecordBatch:
        return pa.record_batch([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["gram", "n"])

    for batch in slices(batches, "text"):
        for text in batch.column("text").to_pylist():
            counts.update(set().union(*map(grams, learnt_words(text))))
            if len(counts) > GRAMS_HELD:
                yield part()
                counts.clear()
    yield part()


def _rows_with(numbers: dict[str, int]):
    """In how many texts of the task, by label, each of the numbered n-grams occurs."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, counts = FeaturesOf(numbers), np.zeros((2, len(numbers)), np.int64)
        for batch in slices(batches, "text"):
            for label, text in zip(batch.column("label").to_pylist(), batch.column("text").to_pylist()):
                counts[label, list(of.text(text))] += 1
        yield pa.record_batch([pa.array(np.arange(len(numbers))), *map(pa.array, counts)], ["number", "other", "toxic"])

    return run


def logistic(rows: list[list[int]], labels: np.ndarray, scale: np.ndarray, ridge: float, steps: int) -> tuple[float, np.ndarray]:
    """(intercept, weights) over presence times scale, by accelerated gradient descent."""
    lengths = np.array([len(r) for r in rows])
    column = np.concatenate([np.array(r, np.int64) for r in rows]) if lengths.sum() else np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(rows)), lengths)
    value = scale[column]
    weights, intercept = np.zeros(len(scale)), float(np.log((labels.sum() + 0.5) / (len(labels) - labels.sum() + 0.5)))
    # An upper bound of the curvature: a quarter of the largest squared row norm of the data.
    step = 1 / (0.25 * (np.percentile(np.bincount(row, value**2, len(rows)), 99) + 1) / 4 + ridge)
    ahead, ahead_b, w, b = weights.copy(), intercept, weights, intercept
    for t in range(steps):
        p = 1 / (1 + np.exp(-(np.bincount(row, ahead[column] * value, len(rows)) + ahead_b)))
        error = (p - labels) / len(rows)
        grad = np.bincount(column, error[row] * value, len(scale)) + ridge / len(rows) * ahead
        new_w, new_b = ahead - step * grad, ahead_b - step * error.sum()
        speed = t / (t + 3)
        ahead, ahead_b = new_w + speed * (new_w - w), new_b + speed * (new_b - b)
        w, b = new_w, new_b
    return b, w


def fit_toxicity(
    sample: DataFrame, features: int = 1024, least_rows: int = 3, ridge: float = 0.5, steps: int = 400
) -> ToxicityModel:
    """A model from a bounded sample (label, text).

    Candidates are all n-grams of `least_rows` toxic rows or more. What the driver sees is bounded by the
    sample and `features`.
    """
    sample = staged(sample)
    totals = {r.label: r["count"] for r in sample.groupBy("label").count().collect()}
    toxic, other = totals.get(1, 0), totals.get(0, 0)
    if not toxic or not other:
        share = (toxic + 0.5) / (toxic + other + 2)
        return ToxicityModel(float(np.log(share / (1 - share))))
    rows = sample.repartition(8)
    frequent = (
        rows.where("label = 1").mapInArrow(_grams_of_texts, "gram string, n long").groupBy("gram")
        .agg(F.sum("n").alias("n")).where(F.col("n") >= least_rows).orderBy("gram")
    )
    names = [r.gram for r in frequent.collect()]
    counted = rows.mapInArrow(
        _rows_with({g: i for i, g in enumerate(names)}), "number long, other long, toxic long"
    ).groupBy("number").agg(F.sum("other").alias("other"), F.sum("toxic").alias("toxic"))
    p, q = (F.col("toxic") + 1) / (toxic + 2), (F.col("other") + 1) / (other + 2)
    pooled = (F.col("toxic") + F.col("other") + 2) / (toxic + other + 4)
    clear = F.abs(p - q) / F.sqrt(pooled * (1 - pooled) * (1 / (toxic + 2) + 1 / (other + 2)))
    kept = (
        counted.select("number", F.log(p / q).alias("ratio"), clear.alias("clear")).where("clear > 4")
        .orderBy(F.desc("clear"), "number").limit(features).collect()
    )
    numbers = {names[r.number]: i for i, r in enumerate(kept)}
    scale = np.array([r.ratio for r in kept], float)

    def present(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = FeaturesOf(numbers)
        for batch in slices(batches, "text"):
            found = [sorted(of.text(t)) for t in batch.column("text").to_pylist()]
            yield pa.record_batch([batch.column("label"), pa.array(found, pa.list_(pa.int32()))], ["label", "found"])

    rows = sample.mapInArrow(present, "label int, found array<int>").collect()
    intercept, weights = logistic(
        [r.found for r in rows], np.array([r.label for r in rows], float), scale, ridge, steps
    )
    return ToxicityModel(intercept, numbers, weights * scale)


def toxicity_scores(docs: DataFrame, model: ToxicityModel, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """`docs` with a score from 0 to 1 for each text, in place of a column that has its name."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        of, weights = FeaturesOf(shared.value.numbers), shared.value.weights
        for array in texts:
            raw = [sum(weights[i] for i in of.text(t)) for t in array.to_pylist()]
            yield pa.array(1 / (1 + np.exp(-(np.array(raw, float) + shared.value.intercept))))

    return docs.withColumn(score_col, F.arrow_udf(score, "double")(F.col(text_col).cast("string")))
