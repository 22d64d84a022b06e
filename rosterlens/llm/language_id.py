"""Language of a text by a bidirectional gated recurrent network over its bytes.

The bytes of a text are cut into windows; one network reads each window forwards and one backwards, and from
both states every position is labelled with a probability for each language. A document's probabilities
are the means over all its positions, of whole texts. The networks are trained in numpy by
backpropagation through time on a bounded sample of documents per language; texts are scored in one pass
without a shuffle, thousands of windows side by side.

Defined results: a text that is null or has no letter is `und`, with score 0. Without any language to learn
from, every text is `und`. Equal probabilities go to the language that sorts first. Rows are independent, so
repeats and null ids pass through. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rosterlens.llm.common import slices, staged

WINDOW = 96  # bytes that are read together
BATCH = 4096  # windows side by side
SLOPE = np.float32(0.2)  # of the gates, which are straight between 0 and 1
PAD = 256  # the number of the byte that is none
LETTER = regex.compile(r"\p{L}")


def windows_of(text: bytes) -> np.ndarray:
    """The bytes in rows of WINDOW, the last one padded."""
    data = np.frombuffer(text, np.uint8).astype(np.int16)
    out = np.full((-(-len(data) // WINDOW), WINDOW), PAD, np.int16)
    out.reshape(-1)[: len(data)] = data
    return out


@dataclass
class ByteGRU:
    """Two gated recurrent networks of `size` units whose states stand side by side: forwards, backwards.

    Gates are (update, reset, candidate); the first two are piecewise linear. `table` is what a byte adds to them, 2 x 257 x 3 x size; `turn`
    what the state adds, 2 x size x 3 x size; `out` maps both states to the languages.
    """

    languages: list[str]
    table: np.ndarray
    turn: np.ndarray
    out: np.ndarray
    bias: np.ndarray

    @classmethod
    def fresh(cls, languages: list[str], size: int, seed: int = 3) -> ByteGRU:
        random = np.random.default_rng(seed)
        draw = lambda *shape: (random.standard_normal(shape) * 0.3).astype(np.float32)
        return cls(
            languages, draw(2, 257, 3 * size), draw(2, size, 3 * size), draw(2 * size, len(languages)),
            np.zeros(len(languages), np.float32),
        )

    @property
    def parameters(self) -> list[np.ndarray]:
        return [self.table, self.turn, self.out, self.bias]

    def states(self, rows: np.ndarray, way: int, trace: list) -> np.ndarray:
        """(position, window, size) states of one way, with what backpropagation needs."""
        table, turn = self.table[way], self.turn[way]
        size = turn.shape[0]
        states = np.empty((rows.shape[1], len(rows), size), np.float32)
        h = np.zeros((len(rows), size), np.float32)
        for t in range(rows.shape[1]) if way == 0 else range(rows.shape[1] - 1, -1, -1):
            given = table[rows[:, t]]
            g = np.clip(SLOPE * (h @ turn[:, : 2 * size] + given[:, : 2 * size]) + 0.5, 0, 1)
            z, r = g[:, :size], g[:, size:]
            back = h @ turn[:, 2 * size :]
            n = np.tanh(r * back + given[:, 2 * size :])
            trace.append((t, h, z, r, n, back))
            h = n + z * (h - n)
            states[t] = h
        return states

    def probabilities(self, rows: np.ndarray) -> np.ndarray:
        """(position, language, window) labels of every position.

        The same as `states` of both ways at once, windows last, so that every step works on whole runs of
        memory.
        """
        size, (n, width) = self.turn.shape[1], rows.shape
        table = self.table.transpose(0, 2, 1).copy()
        turn = self.turn.transpose(0, 2, 1).copy()
        table[:, : 2 * size] = table[:, : 2 * size] * SLOPE + 0.5
        turn[:, : 2 * size] *= SLOPE
        gates, candidate = turn[:, : 2 * size], turn[:, 2 * size :]
        columns = np.ascontiguousarray(rows.T)
        states = np.empty((2, width, size, n), np.float32)
        h = np.zeros((2, size, n), np.float32)
        given = np.empty((2, 3 * size, n), np.float32)
        g, c = np.empty((2, 2 * size, n), np.float32), np.empty((2, size, n), np.float32)
        for t in range(width):
            for way, column in ((0, columns[t]), (1, columns[width - 1 - t])):
                np.take(table[way], column, axis=1, out=given[way], mode="clip")
            np.matmul(gates, h, out=g)
            g += given[:, : 2 * size]
            np.clip(g, 0, 1, out=g)
            np.matmul(candidate, h, out=c)
            c *= g[:, size:]
            c += given[:, 2 * size :]
            np.tanh(c, out=c)
            h -= c
            h *= g[:, :size]
            h += c
            states[0, t], states[1, width - 1 - t] = h
        logits = self.out[:size].T @ states[0]
        logits += self.out[size:].T @ states[1]
        logits += self.bias[:, None]
        logits -= logits.max(axis=1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=1, keepdims=True)
        return logits

    def gradients(self, rows: np.ndarray, label: np.ndarray) -> list[np.ndarray]:
        """Of the mean loss over positions that are not padding, by backpropagation through time."""
        size = self.turn.shape[1]
        traces: tuple[list, list] = ([], [])
        both = np.concatenate([self.states(rows, way, traces[way]) for way in (0, 1)], axis=2)
        logits = both @ self.out + self.bias
        logits -= logits.max(axis=2, keepdims=True)
        error = np.exp(logits)
        error /= error.sum(axis=2, keepdims=True)
        error[:, np.arange(len(rows)), label] -= 1
        valid = (rows != PAD).T[:, :, None]
        error *= valid / np.float32(valid.sum())
        d_out = np.tensordot(both, error, ((0, 1), (0, 1)))
        d_states = error @ self.out.T
        d_table, d_turn = np.zeros_like(self.table), np.zeros_like(self.turn)
        for way in (0, 1):
            turn = self.turn[way]
            dh = np.zeros((len(rows), size), np.float32)
            for t, before, z, r, n, back in reversed(traces[way]):
                dh = dh + d_states[t, :, way * size : (way + 1) * size]
                d_z = dh * (before - n) * SLOPE * ((z > 0) & (z < 1))
                d_n = dh * (1 - z) * (1 - n * n)
                d_r = d_n * back * SLOPE * ((r > 0) & (r < 1))
                d_gates = np.concatenate([d_z, d_r, d_n], axis=1)
                np.add.at(d_table[way], rows[:, t], d_gates)
                d_back = d_n * r
                through = np.concatenate([d_z, d_r, d_back], axis=1)
                d_turn[way] += before.T @ through
                dh = dh * z + through @ turn.T
        return [d_table, d_turn, d_out, error.sum(axis=(0, 1))]


def train(languages: list[str], rows: np.ndarray, label: np.ndarray, size: int, passes: int, step: float = 0.02) -> ByteGRU:
    """Adam over shuffled batches of windows, each language weighing what its windows do."""
    model, random = ByteGRU.fresh(languages, size), np.random.default_rng(5)
    means = [np.zeros_like(p) for p in model.parameters]
    squares = [np.zeros_like(p) for p in model.parameters]
    steps = 0
    for _ in range(passes):
        order = random.permutation(len(rows))
        for i in range(0, len(order), 256):
            some = order[i : i + 256]
            steps += 1
            rate = step * np.sqrt(1 - 0.99**steps) / (1 - 0.9**steps) * min(1, 40 / steps) ** 0.5
            for p, g, m, s in zip(model.parameters, model.gradients(rows[some], label[some]), means, squares):
                m += 0.1 * (g - m)
                s += 0.01 * (g * g - s)
                p -= (rate * m / (np.sqrt(s) + 1e-6)).astype(np.float32)
    return model


def fit_language(
    docs: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    per_language: int = 300, windows_each: int = 8, size: int = 8, passes: int = 6,
) -> ByteGRU:
    """A network from at most `per_language` documents of each language, and `windows_each` windows of each.

    The documents are those whose ids hash lowest; the windows are spread over the whole text.
    """
    rows = docs.where(F.col(lang_col).isNotNull() & usable)
    keys = rows.select(F.col(id_col).alias("key"), F.col(lang_col).alias("lang"), F.xxhash64(id_col).alias("order"))
    ranked = keys.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("order", "key")))
    chosen = ranked.where(F.col("rank") <= per_language).select("key", "lang").distinct()

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = []
            for text in batch.column("text").to_pylist():
                every = windows_of((text or "").encode())
                spread = np.unique(np.linspace(0, max(len(every) - 1, 0), windows_each).astype(int))
                found.append(every[spread].tobytes() if len(every) else b"")
            yield pa.record_batch([batch.column("key"), batch.column("lang"), pa.array(found, pa.binary())], ["key", "lang", "found"])

    # As many keys as languages times `per_language`: bounded by what there is to learn.
    picked = rows.select(
        F.col(id_col).alias("key"), F.col(lang_col).alias("lang"), F.col(text_col).cast("string").alias("text")
    ).join(F.broadcast(chosen), ["key", "lang"])
    kind = picked.schema["key"].dataType.simpleString()
    # In the order of ids, so that a run can be repeated.
    sample = sorted(
        (r for r in staged(picked.mapInArrow(cut, f"key {kind}, lang string, found binary")).collect() if r.found),
        key=lambda r: (r.lang, str(r.key), bytes(r.found)),
    )
    languages = sorted({r.lang for r in sample})
    data = [np.frombuffer(r.found, np.int16).reshape(-1, WINDOW) for r in sample]
    if not data:
        return ByteGRU.fresh([], size)
    label = np.repeat([languages.index(r.lang) for r in sample], [len(d) for d in data])
    return train(languages, np.concatenate(data), label, size, passes)


def pooled(model: ByteGRU, texts: list[str | None]) -> np.ndarray:
    """(text, language): means of the probabilities of all positions; zeros where there is no letter."""
    out = np.zeros((len(texts), len(model.languages)))
    lettered = [i for i, t in enumerate(texts) if t and LETTER.search(t)]
    if not lettered or not model.languages:
        return out
    cut = [windows_of(texts[i].encode()) for i in lettered]
    owner = np.repeat(lettered, [len(c) for c in cut])
    rows = np.concatenate(cut)
    for i in range(0, len(rows), BATCH):
        some = rows[i : i + BATCH]
        labels = model.probabilities(some)
        labels *= (some != PAD).T[:, None, :]
        sums = labels.sum(axis=0)
        for k in range(out.shape[1]):
            out[:, k] += np.bincount(owner[i : i + BATCH], sums[k], len(texts))
    total = out.sum(axis=1, keepdims=True)
    return np.divide(out, total, out=out, where=total > 0)


def languages(docs: DataFrame, model: ByteGRU, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def label(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in slices(batches, "text"):
            share = pooled(model, batch.column("text").to_pylist())
            best = share.argmax(axis=1) if share.size else np.zeros(len(share), int)
            score = share.max(axis=1) if share.size else np.zeros(len(share))
            names = [model.languages[b] if s > 0 else "und" for b, s in zip(best, score)]
            yield pa.record_batch(
                [batch.column("id"), pa.array(names, pa.string()), pa.array(np.minimum(score, 1.0))],
                ["id", "lang_pred", "score"],
            )

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(label, f"id {kind}, lang_pred string, score double")
