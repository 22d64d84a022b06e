"""Benchmark passages in documents, found by a prefix-filtered set join.

Each benchmark item is cut into windows of `window` words; a window must occur whole, so of its word
shingles (three words) one is a necessary prefix: the rarest, by counts over all documents. A document's
shingles meet only those prefixes. A hit gives a position, which bounds where the window could start and
end; what is left is verified word by word over the whole window.

The items are taken in blocks of about `block_bytes` of text, so that what is broadcast stays bounded
however large the benchmark is: one block is one pass over the documents, more blocks are more passes with
the documents staged between them. Documents are never shuffled.

Defined results: a null or wordless text has no words and no hits. An item of fewer words than a window,
but not none, is one window; an item without words has none. Items that repeat an id count once; a null id
is the text `null`. An empty benchmark hits nothing; empty documents give no rows. Rows are independent, so
repeats and null ids pass through, and so do all columns.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterlens.llm.common import slices, staged

# Every byte as itself if it is part of a word, A-Z in lower case, all others as a space.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)
RUNS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
CHECKED_AT_ONCE = 100_000


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(WORD_BYTES).split()


class Windows:
    """The distinct windows of a block of items as word numbers, and the items that each belongs to."""

    def __init__(self, items: list[tuple[str, str | None]], size: int):
        self.vocab: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            ids = [self.vocab.setdefault(w, len(self.vocab)) for w in words(text)]
            for i in range(max(len(ids) - size + 1, min(len(ids), 1))):
                owners.setdefault(tuple(ids[i : i + size]), set()).add(item)
        self.owners = [sorted(o) for o in owners.values()]
        self.length = np.array([len(w) for w in owners], np.int64)
        self.ids = np.full((len(owners), size), -1, np.int64)
        for row, w in zip(self.ids, owners):
            row[: len(w)] = w
        self.width = 3 if len(self.vocab) < 1 << 20 else 2
        # All shingles of the windows: (window, offset) for each, by shingle width and key.
        self.shingles: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for width in range(1, self.width + 1):
            rows = np.flatnonzero(np.minimum(self.length, self.width) == width)
            key, window, offset = [], [], []
            for o in range(size - width + 1 if len(rows) else 0):
                inside = rows[self.length[rows] >= o + width]
                key.append(self.keys(self.ids[inside, o : o + width].T))
                window.append(inside)
                offset.append(np.full(len(inside), o))
            if key:
                self.shingles[width] = tuple(map(np.concatenate, (key, window, offset)))

    def keys(self, columns) -> np.ndarray:
        out = columns[0].astype(np.int64)
        for c in columns[1:]:
            out = out * len(self.vocab) + c
        return out

    def distinct(self, width: int) -> np.ndarray:
        return np.unique(self.shingles[width][0])


class Prefixes:
    """The rarest shingle of each window, sorted by key."""

    def __init__(self, windows: Windows, counts: dict[tuple[int, int], int]):
        self.of = {}
        for width, (key, window, offset) in windows.shingles.items():
            known, at = np.unique(key, return_inverse=True)
            rarity = np.array([counts.get((width, int(k)), 0) for k in known])[at]
            order = np.lexsort((offset, key, rarity, window))
            first = order[np.r_[True, window[order][1:] != window[order][:-1]]]
            first = first[np.argsort(key[first], kind="stable")]
            self.of[width] = key[first], window[first], offset[first]


def numbered(texts: list[str | None], vocab: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """(word numbers of all texts, -1 for other words and after each text; where each text begins)."""
    every, begins = [], [0]
    for text in texts:
        every += words(text)
        every.append(b"")
        begins.append(len(every))
    return np.fromiter(map(vocab.get, every, repeat(-1)), np.int64, len(every)), np.array(begins)


def probes(ids: np.ndarray, windows: Windows, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, key) of the shingles that consist of benchmark words."""
    n = len(ids) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    known = ids >= 0
    all_known = known[:n].copy()
    for o in range(1, width):
        all_known &= known[o : n + o]
    at = np.flatnonzero(all_known)
    return at, windows.keys([ids[at + o] for o in range(width)])


def shingle_counts(docs: DataFrame, windows: Windows) -> dict[tuple[int, int], int]:
    """How often each shingle of the windows occurs in all documents; as many rows at most as shingles."""
    shared = docs.sparkSession.sparkContext.broadcast(windows)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = shared.value
        tables = {w: windows.distinct(w) for w in windows.shingles}
        totals = {w: np.zeros(len(t), np.int64) for w, t in tables.items()}
        for batch in slices(batches, "text"):
            ids, _ = numbered(batch.column("text").to_pylist(), windows.vocab)
            for width, table in tables.items():
                _, keys = probes(ids, windows, width)
                at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
                totals[width] += np.bincount(at[table[at] == keys], minlength=len(table))
        for width, table in tables.items():
            some = totals[width] > 0
            yield pa.record_batch(
                [pa.array(np.full(some.sum(), width)), pa.array(table[some]), pa.array(totals[width][some])],
                ["width", "key", "n"],
            )

    rows = docs.select("text").mapInArrow(count, "width long, key long, n long")
    return {(r.width, r.key): r.n for r in rows.groupBy("width", "key").agg(F.sum("n").alias("n")).collect()}


def occurrences(ids: np.ndarray, windows: Windows, prefixes: Prefixes) -> tuple[np.ndarray, np.ndarray]:
    """(start, window) of every window that occurs in `ids`."""
    starts, found = [], []
    for width, (keys, window, offset) in prefixes.of.items():
        at, probe = probes(ids, windows, width)
        low, high = np.searchsorted(keys, probe, "left"), np.searchsorted(keys, probe, "right")
        at, low, n = at[high > low], low[high > low], (high - low)[high > low]
        bounds = np.r_[0, np.cumsum(n)]
        i = 0
        while i < len(n):
            j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + CHECKED_AT_ONCE, "right")) - 1)
            entry = np.repeat(low[i:j] - (bounds[i:j] - bounds[i]), n[i:j]) + np.arange(bounds[j] - bounds[i])
            w = window[entry]
            start = np.repeat(at[i:j], n[i:j]) - offset[entry]
            inside = (start >= 0) & (start + windows.length[w] <= len(ids))
            start, w = start[inside], w[inside]
            same = np.ones(len(w), bool)
            for o in range(windows.ids.shape[1]):
                expected = windows.ids[w, o]
                same &= (expected < 0) | (ids[np.minimum(start + o, len(ids) - 1)] == expected)
            starts.append(start[same])
            found.append(w[same])
            i = j
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *starts]), np.concatenate([none, *found])


def _matched(spark, windows: Windows, prefixes: Prefixes, text_col: str):
    """Adds what a block of items hits; `row` holds the document's columns and passes through."""
    shared = spark.sparkContext.broadcast((windows, prefixes))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows, prefixes = shared.value
        for batch in slices(batches, "row", text_col):
            texts = batch.column("row").field(text_col).to_pylist()
            ids, begins = numbered(texts, windows.vocab)
            start, window = occurrences(ids, windows, prefixes)
            edge = np.zeros(len(ids) + 1, np.int64)
            np.add.at(edge, start, 1)
            np.add.at(edge, start + windows.length[window], -1)
            doc = np.searchsorted(begins, start, "right") - 1
            n_docs = batch.num_rows
            items: list[set[str]] = [set() for _ in range(n_docs)]
            for d, w in set(zip(doc.tolist(), window.tolist())):
                items[d].update(windows.owners[w])
            hit = np.cumsum(edge)[:-1] > 0
            runs: list[list[dict]] = [[] for _ in range(n_docs)]
            for d in np.unique(doc).tolist():
                flags = hit[begins[d] : begins[d + 1]]
                for r in (batch.column("runs")[d].as_py() or []):
                    flags[r["start"] : r["end"]] = True
                turns = np.flatnonzero(np.diff(np.r_[False, flags, False])).tolist()
                runs[d] = [{"start": a, "end": b} for a, b in zip(turns[::2], turns[1::2])]
            for d, old in enumerate(batch.column("runs").to_pylist()):
                runs[d] = runs[d] or old or []
            for d, old in enumerate(batch.column("items").to_pylist()):
                items[d].update(old or ())
            yield pa.record_batch(
                [
                    batch.column("row"), pa.array(np.diff(begins) - 1),
                    pa.array(runs, RUNS), pa.array([sorted(i) for i in items], pa.list_(pa.string())),
                ],
                ["row", "n_words", "runs", "items"],
            )

    return run


def contamination(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", window: int = 10, block_bytes: int = 4 << 20,
) -> DataFrame:
    """(row, n_words, n_hit, runs of hit words, ids of the items hit); `row` holds the columns of `docs`."""
    items = benchmark.select(
        F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("item"),
        F.col(item_text_col).cast("string").alias("text"),
    )
    size = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    docs = docs.withColumn(text_col, F.col(text_col).cast("string"))
    state = docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.lit(0).cast("long").alias("n_words"),
        F.lit(None).cast("array<struct<start:long,end:long>>").alias("runs"),
        F.lit(None).cast("array<string>").alias("items"),
    )
    texts = docs.select(F.col(text_col).alias("text"))
    for block in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block).collect()
        windows = Windows([(r.item, r.text) for r in rows], window)
        prefixes = Prefixes(windows, shingle_counts(texts, windows) if len(windows.length) else {})
        state = state.mapInArrow(_matched(docs.sparkSession, windows, prefixes, text_col), state.schema)
        if blocks > 1:
            state = staged(state)
    n_hit = F.aggregate("runs", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["start"])
    return state.select("row", "n_words", n_hit.alias("n_hit"), "runs", "items")
