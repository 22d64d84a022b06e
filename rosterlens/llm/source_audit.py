"""How far sources of a language diverge in their terms, from stripes folded in the mapper.

Each task folds whole documents into hash stripes, (lang, term) -> per source, the count and the documents with the term. The terms of a
batch are numbered and counted as arrays, and its stripes are added to those the task holds. When these take `held_bytes`, they are
spilled and begun anew. A stripe is laid out as a row per source, its cells. Spilled stripes are dealt and sorted by key, and a stream over
each partition merges them; a term in fewer than `least_docs` documents ends there. So a frequent word travels once per
task and spill, not once per occurrence.

Of the merged stripes, `term` rows come from each cell alone: its smoothed share in the source against the one in the
whole language. `pair` rows are sums over all kept terms, most of which a source may lack. With p0 the share of a term that
a source lacks, sum f(pa, pb) = V f(p0a, p0b) + sum over the terms of a [f(pa, p0b) - f(p0a, p0b)] + the same for b
+ sum over shared terms [f(pa, pb) - f(pa, p0b) - f(p0a, pb) + f(p0a, p0b)]. The last sum is folded in the mapper over
merged stripes again, in numbers per pair of sources; the ones before need only how often each count occurs in a source.
All sums are of whole numbers, so the regrouping changes nothing.

The result has a row for every ordered pair of sources of a language, as asked, and sources are joined by language for it;
that join is salted. All other work goes with the cells of the stripes. No table is broadcast by this module.

Defined results: null text, lang and source are ''. Rows are documents, also where ids repeat or are null. A source without
terms has its rows too; a language without kept terms has pairs of value 0 and no terms. An empty table gives no rows. Other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rosterlens.llm.common import slices, staged

# Of UTF-8, terms are runs of ASCII letters and of all bytes that are not ASCII; A-Z are lower-cased, the rest parts them.
TERM_BYTES = bytes(c if c >= 0x80 or chr(c).islower() else c + 32 if chr(c).isupper() else 32 for c in range(256))
SCALE = 1_000_000_000
HELD_BYTES = 96 << 20
BATCH = 1 << 14
SALTS = 16
PAIRS = 1 << 20  # sums of pairs that a task holds
KEY, SUMS = ["lang", "term", "source"], ["n", "docs"]
CELLS_SQL = "lang string, term string, source string, n long, docs long"
MERGED_SQL = "lang string, term string, source string, n long, n_lang long, first boolean"


def _firsts(values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1]))) if len(values) else np.zeros(0, np.int64)


def stripes_of(batch: pa.RecordBatch) -> pa.Table:
    """The cells of the stripes of some documents (lang, source, text without nulls)."""
    texts = batch.column("text").cast(pa.binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    apart = data[int(offsets[0]) : int(offsets[-1])].to_pybytes().translate(TERM_BYTES) if data else b""
    texts = pa.Array.from_buffers(
        pa.string(), len(texts), [None, pa.py_buffer((offsets - offsets[0]).tobytes()), pa.py_buffer(apart)])
    split = pc.split_pattern(texts, " ")
    terms = split.flatten().dictionary_encode()
    term = terms.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    doc = np.repeat(np.arange(len(texts)), split.value_lengths().to_numpy(zero_copy_only=False))
    some = term != pc.index(terms.dictionary, "").as_py()
    v = max(len(terms.dictionary), 1)
    places = np.sort(doc[some] * v + term[some])
    first = _firsts(places)
    counts = np.diff(np.append(first, len(places)))
    doc, term = np.divmod(places[first], v)
    langs, sources = (batch.column(c).dictionary_encode() for c in ("lang", "source"))
    group = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64) * len(sources.dictionary) + sources.indices.to_numpy(zero_copy_only=False)
    cell = group[doc] * v + term
    order = np.argsort(cell, kind="stable")
    cell = cell[order]
    first = _firsts(cell)
    group, term = np.divmod(cell[first], v)
    lang, source = np.divmod(group, max(len(sources.dictionary), 1))
    return pa.table({
        "lang": langs.dictionary.take(pa.array(lang)), "term": terms.dictionary.take(pa.array(term)),
        "source": sources.dictionary.take(pa.array(source)),
        "n": pa.array(np.add.reduceat(counts[order], first) if len(first) else first, pa.int64()),
        "docs": pa.array(np.diff(np.append(first, len(cell))), pa.int64()),
    })


def _fold(held_bytes: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        size = 0
        for batch in slices(batches, "text"):
            held.append(stripes_of(batch))
            size += held[-1].nbytes
            if size > held_bytes:
                added = pa.concat_tables(held).group_by(KEY, use_threads=False).aggregate([(c, "sum") for c in SUMS])
                held = [added.rename_columns([*KEY, *SUMS])]
                if (size := held[0].nbytes) > held_bytes // 2:
                    yield from held[0].to_batches(max_chunksize=BATCH)
                    held, size = [], 0
        if held:
            added = pa.concat_tables(held).group_by(KEY, use_threads=False).aggregate([(c, "sum") for c in SUMS])
            yield from added.rename_columns([*KEY, *SUMS]).to_batches(max_chunksize=BATCH)

    return run


def _cells_added(rows: pa.RecordBatch, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """(where each cell of the groups begins in `order`, the order, sources, counts) of rows numbered by stripe."""
    sources = rows.column("source").dictionary_encode()
    code = sources.indices.to_numpy(zero_copy_only=False)
    order = np.lexsort((code, group))
    first = _firsts(group[order] * len(sources.dictionary) + code[order])
    counts = np.add.reduceat(rows.column("n").to_numpy(zero_copy_only=False)[order], first)
    return first, order, sources.dictionary.take(pa.array(code[order][first])), counts


def _merge(least_docs: int):
    """Cells sorted by stripe, merged; stripes of rare terms are left out."""

    def kept(rows: pa.RecordBatch, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        sizes = np.diff(np.append(starts, rows.num_rows))
        enough = np.add.reduceat(rows.column("docs").to_numpy(zero_copy_only=False), starts) >= least_docs
        if not enough.any():
            return
        rows = rows.filter(pa.array(np.repeat(enough, sizes)))
        sizes = sizes[enough]
        group = np.repeat(np.arange(len(sizes)), sizes)
        first, order, sources, counts = _cells_added(rows, group)
        of = group[order][first]
        begins = _firsts(of)
        total = np.add.reduceat(counts, begins)
        at = pa.array(order[first])
        flags = np.zeros(len(of), bool)
        flags[begins] = True
        yield pa.record_batch(
            [rows.column("lang").take(at), rows.column("term").take(at), sources, pa.array(counts), pa.array(total[of]), pa.array(flags)],
            ["lang", "term", "source", "n", "n_lang", "first"])

    def folded(rows: pa.RecordBatch) -> pa.RecordBatch:
        """Rows of one stripe as its cells."""
        first, order, sources, counts = _cells_added(rows, np.zeros(rows.num_rows, np.int64))
        docs = np.add.reduceat(rows.column("docs").to_numpy(zero_copy_only=False)[order], first)
        at = pa.array(order[first])
        return pa.record_batch([rows.column("lang").take(at), rows.column("term").take(at), sources, pa.array(counts), pa.array(docs)], schema=rows.schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_rows: pa.RecordBatch | None = None  # of the last key, which may go on
        folds = BATCH
        for rows in batches:
            if not rows.num_rows:
                continue
            if open_rows is not None:
                rows = pa.concat_batches([open_rows, rows])
            lang, term = rows.column("lang"), rows.column("term")
            differs = pc.or_(pc.not_equal(term[1:], term[:-1]), pc.not_equal(lang[1:], lang[:-1])).to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.concatenate(([True], differs)))
            last = int(starts[-1])
            if last:
                yield from kept(rows.slice(0, last), starts[:-1])
                folds = BATCH
            open_rows = rows.slice(last)
            if open_rows.num_rows > folds:
                open_rows = folded(open_rows)
                folds = 2 * open_rows.num_rows + BATCH
        if open_rows is not None:
            yield from kept(open_rows, np.zeros(1, np.int64))

    return run


def merged_stripes(docs: DataFrame, least_docs: int = 10, held_bytes: int = HELD_BYTES) -> DataFrame:
    """(lang, term, source, n, n_lang, first): the cells of terms in at least `least_docs` documents of a language.

    `n_lang` is the sum of the stripe; `first` is true for one of its cells.
    """
    spilled = docs.select("lang", "source", "text").mapInArrow(_fold(held_bytes), CELLS_SQL)
    # Sorted by a number first, which is quicker to compare; equal keys come together all the same.
    dealt = spilled.withColumn("number", F.xxhash64("lang", "term")).repartition("number").sortWithinPartitions("number", "lang", "term")
    return dealt.drop("number").mapInArrow(_merge(least_docs), MERGED_SQL)


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (n + 2) / (total + 2 * terms)), exactly."""
    return F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * (n + 2), total + 2 * terms) + 1


def far(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)); p and q are at most SCALE + 1."""
    return F.call_function("div", (p - q) * (p - q), p + q)


@cache
def _triangle(k: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(k, 1)


def _pairs_of(k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All i < j below k, in bounded parts."""
    if k <= 256:
        yield _triangle(k)
        return
    for i in range(k - 1):
        j = np.arange(i + 1, k)
        yield np.full(len(j), i), j


def _apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


class PairSums:
    """Whole-number sums per pair of numbered names."""

    def __init__(self) -> None:
        self.keys: list[np.ndarray] = []
        self.values: list[np.ndarray] = []
        self.n = 0

    def add(self, a: np.ndarray, b: np.ndarray, values: np.ndarray) -> None:
        self.keys.append((np.minimum(a, b) << 31) | np.maximum(a, b))
        self.values.append(values)
        self.n += len(values)
        if self.n > 2 * PAIRS:
            self.compress()

    def compress(self) -> None:
        if self.n:
            keys, values = np.concatenate(self.keys), np.concatenate(self.values)
            order = np.argsort(keys, kind="stable")
            keys, values = keys[order], values[order]
            first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            self.keys, self.values, self.n = [keys[first]], [np.add.reduceat(values, first)], len(first)


PAIR = "lang string, a string, b string, value long"


def _shared(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What terms that both have add to their pair, over stripes of (source, p, p0)."""
    ids: dict[tuple[str, str], int] = {}
    sums = PairSums()

    def emitted() -> Iterator[pa.RecordBatch]:
        names = list(ids)
        for keys, values in zip(sums.keys, sums.values):
            for i in range(0, len(keys), BATCH):
                a, b = keys[i : i + BATCH] >> 31, keys[i : i + BATCH] & ((1 << 31) - 1)
                pairs = [(names[x], names[y]) for x, y in zip(a.tolist(), b.tolist())]
                yield pa.record_batch(
                    [pa.array([x[0] for x, _ in pairs]), pa.array([x[1] for x, _ in pairs]), pa.array([y[1] for _, y in pairs]),
                     pa.array(values[i : i + BATCH])], ["lang", "a", "b", "value"])
        sums.__init__()

    for batch in batches:
        cells = batch.column("cells")
        flat = cells.flatten()
        p, zero = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("p", "p0"))
        sources = flat.field("source").to_pylist()
        ends = np.cumsum(cells.value_lengths().to_numpy(zero_copy_only=False)).tolist()
        start = 0
        for lang, end in zip(batch.column("lang").to_pylist(), ends):
            number = np.array([ids.setdefault((lang, s), len(ids)) for s in sources[start:end]], np.int64)
            of, none = p[start:end], zero[start:end]
            for i, j in _pairs_of(end - start):
                sums.add(
                    number[i], number[j],
                    _apart(of[i], of[j]) - _apart(of[i], none[j]) - _apart(none[i], of[j]) + _apart(none[i], none[j]),
                )
            start = end
            if sums.n > PAIRS:
                sums.compress()
                if sums.n > PAIRS:
                    yield from emitted()
    sums.compress()
    yield from emitted()


def _each_of_lang(one: DataFrame, other: DataFrame) -> DataFrame:
    """Rows of one language side by side, both of them dealt over SALTS parts of it."""
    salted = one.withColumn("salt", F.pmod(F.xxhash64("source"), F.lit(SALTS)))
    return salted.join(other.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<long>"))), ["lang", "salt"])


def source_divergence(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = 10,
    best: int = 10, held_bytes: int = HELD_BYTES,
) -> DataFrame:
    """(lang, source, part, item, value, rank): how far each other source is, and the `best` terms a source has more of."""
    rows = docs.select(*[
        F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name)
        for name, c in (("lang", lang_col), ("source", source_col), ("text", text_col))
    ])
    kept = staged(merged_stripes(rows, least_docs, held_bytes))
    sizes = kept.groupBy("lang").agg(F.count_if("first").alias("v"), F.sum("n").alias("lang_total"))
    groups = staged(
        rows.select("lang", "source").distinct()
        .join(kept.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left")
        .join(sizes, "lang", "left").fillna(0, ["total", "v", "lang_total"])
    )
    none = F.when(F.col("v") > 0, share(F.lit(0).cast("long"), F.col("total"), F.col("v")))
    cells = staged(
        kept.join(groups, ["lang", "source"])
        .select(
            "lang", "term", "source", share(F.col("n"), F.col("total"), F.col("v")).alias("p"), none.alias("p0"),
            share(F.col("n_lang"), F.col("lang_total"), F.col("v")).alias("q"),
        )
    )
    of_source = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = (
        cells.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), far(F.col("p"), F.col("q")).alias("value"))
        .withColumn("rank", F.row_number().over(of_source)).where(F.col("rank") <= best)
    )

    other = groups.select("lang", F.col("source").alias("other"), none.alias("other_p0"), "v")
    base = _each_of_lang(groups.select("lang", "source", none.alias("p0")), other).where("source < other").select(
        "lang", F.col("source").alias("a"), F.col("other").alias("b"),
        F.when(F.col("v") > 0, F.col("v") * far(F.col("p0"), F.col("other_p0"))).otherwise(0).alias("value"))
    counted = cells.groupBy("lang", "source", "p", "p0").agg(F.count(F.lit(1)).alias("times"))
    p, p0, other_p0 = map(F.col, ("p", "p0", "other_p0"))
    lone = _each_of_lang(counted, other).where("source <> other").select(
        "lang", F.least("source", "other").alias("a"), F.greatest("source", "other").alias("b"),
        (F.col("times") * (far(p, other_p0) - far(p0, other_p0))).alias("value"))
    shared = (
        cells.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "p", "p0")).alias("cells")).where(F.size("cells") > 1)
        .select("lang", "cells").mapInArrow(_shared, PAIR)
        .select("lang", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "value")
    )
    sums = base.unionByName(lone).unionByName(shared).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    ways = F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))
    pairs = sums.select("lang", "value", F.inline(ways)).withColumn("rank", F.row_number().over(of_source)).withColumn("part", F.lit("pair"))
    return terms.unionByName(pairs)
