"""Documents packed into few sequences by matching large pieces and fitting small ones best.

Documents become token ids, an end id after each; only those longer than a sequence are cut, at every `size` ids.
How the pieces are packed depends on nothing but how many there are of each length, at most `size` numbers whatever
the corpus holds. From these `bins_of` works out all bins: pieces above a third of a sequence, of which no three
fit together, are matched greedily, the longest left with the longest left that fits beside it, so two at most share a
bin; shorter pieces, longest first, fill the smallest gap that takes them, and open bins once there is none. Bins alike
are one run of bins, so the plan is a short list of moves: pieces a to b of a length go to a run of bins.

Which piece is the how-manieth of its length follows from its place in its task and from the counts of the tasks
before, a prefix sum over (length, task). Each piece then looks up its own bin; nothing is gathered by length or bin,
and one length may hold most pieces.

Token ids are those of the whole text. This vocabulary drops white space and case and no token spans a space, or a letter
and a sign, so the distinct words of a batch are encoded alone and kept by the worker, in a table bounded by bytes; texts
that may hold a special string are encoded whole.

Defined results: a null or empty text is its end id alone. Rows are independent documents, so repeats and null ids
are packed like any other; pieces alike may swap bins between runs. An empty table gives no rows. Columns besides id and
text are not read.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, bisect_right, insort
from collections import Counter
from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

from rosterlens.llm.common import slices, staged

KEPT_BYTES = 160 << 20  # of words and their ids that a worker keeps, with what Python adds to them
KEPT_CHARS = 64  # longer words are not kept
ENTRY_BYTES = 200
BATCH_BYTES = 16 << 20
LETTER = "[a-z\u00e0-\u00f6\u00f8-\u00ff]"
LETTERS = re.compile(f"{LETTER}+\\Z")
LETTER_SIGN = f"({LETTER})([.,!?;:])"
RANK_BITS = 48


def _parts(words: list[str], most_chars: int = 1 << 20) -> Iterator[list[str]]:
    some, chars = [], 0
    for word in words:
        if some and chars + len(word) > most_chars:
            yield some
            some, chars = [], 0
        some.append(word)
        chars += len(word)
    if some:
        yield some


class SpacedIds:
    """Ids of texts, by distinct words of a batch."""

    def __init__(self, name: str):
        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
        special = [(t.content, i) for i, t in self.tokenizer.get_added_tokens_decoder().items()]
        self.special = "|".join(re.escape(start) for start in sorted({s[:2] for s, _ in special}))
        self.mark, self.mark_id = special[-1]
        # Words of lower-case letters are in their final form and one pre-token: only the model and its alphabet are needed.
        self.letters = Tokenizer(self.tokenizer.model)
        self.letters.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        suffix = self.tokenizer.model.end_of_word_suffix
        names = map(self.tokenizer.id_to_token, range(self.tokenizer.get_vocab_size()))
        self.is_end = np.array([(t or "").endswith(suffix) for t in names])
        self.table: dict[str, bytes] = {}
        self.held = 0

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _encoded(self, words: list[str]) -> Iterator[bytes]:
        """One call for many words, with a special token between them that no word has."""
        joined = f" {self.mark} ".join(words)
        ids = np.array(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, np.uint32)
        cuts = np.flatnonzero(ids == self.mark_id)
        data = ids.tobytes()
        for a, b in zip([0, *(4 * cuts + 4).tolist()], [*(4 * cuts).tolist(), len(data)], strict=True):
            yield data[a:b]

    def _encoded_letters(self, words: list[str]) -> Iterator[bytes]:
        """The same for words of lower-case letters, whose last token shows that it ends a word."""
        ids = np.array(self.letters.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, np.uint32)
        ends = (4 * np.flatnonzero(self.is_end[ids]) + 4).tolist()
        data = ids.tobytes()
        for a, b in zip([0, *ends[:-1]], ends, strict=True):
            yield data[a:b]

    def _learn(self, words: list[str]) -> dict[str, bytes]:
        """Keeps what is short; returns the ids of what is too long to keep."""
        long: dict[str, bytes] = {}
        letters = LETTERS.match
        for only_letters, encoded in ((True, self._encoded_letters), (False, self._encoded)):
            for some in _parts([w for w in words if (letters(w) is not None) == only_letters]):
                some_ids = list(encoded(some))
                short = {w: ids for w, ids in zip(some, some_ids, strict=True) if len(w) <= KEPT_CHARS}
                self.table.update(short)
                self.held += ENTRY_BYTES * len(short) + sum(map(len, short)) + sum(map(len, short.values()))
                if len(short) < len(some):
                    long.update((w, ids) for w, ids in zip(some, some_ids) if len(w) > KEPT_CHARS)
        return long

    def __call__(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """Ids of each text of a column of strings without nulls."""
        odd = pc.match_substring_regex(texts, self.special).to_numpy(zero_copy_only=False)
        plain = pc.if_else(pa.array(odd), "", texts) if odd.any() else texts
        # Neither the case of A-Z nor a space between a letter and a sign makes a difference, but for distinct words.
        plain = pc.replace_substring_regex(pc.ascii_lower(plain), LETTER_SIGN, r"\1 \2")
        split = pc.split_pattern(pc.replace_substring(plain, "\n", " "), " ")
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        if self.held > KEPT_BYTES:
            self.table, self.held = {}, 0
        found = list(map(self.table.get, words))
        new = [w for w, ids in zip(words, found) if ids is None]
        if new:
            long = self._learn(new)
            found = [long[w] if w in long else self.table[w] for w in words] if long else list(map(self.table.__getitem__, words))
        ids = np.frombuffer(b"".join(found), np.uint32)
        size = np.fromiter(map(len, found), np.int32, len(found)) // 4
        start = np.cumsum(size, dtype=np.int32) - size
        codes = coded.indices.to_numpy(zero_copy_only=False)
        sizes = size[codes]
        ends = np.cumsum(sizes, dtype=np.int32)  # batches are far from 2^31 bytes
        at = np.repeat(start[codes] - ends + sizes, sizes)
        at += np.arange(len(at), dtype=np.int32)
        flat = ids[at]
        cuts = np.concatenate(([0], ends))[np.cumsum(np.concatenate(([0], split.value_lengths().to_numpy(zero_copy_only=False))))]
        for i, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
            yield self.whole(texts[i].as_py()) if odd[i] else flat[a:b]


@cache
def encoder(name: str) -> SpacedIds:
    """One for all tasks of a worker, so that what it has learnt stays."""
    return SpacedIds(name)


@dataclass(frozen=True)
class Move:
    """Pieces `first` to `first + n` of a length: `each` per bin from bin `bin` on, the first of a bin at `offset`."""

    length: int
    first: int
    n: int
    bin: int
    each: int
    offset: int


class Bins:
    """Runs of bins alike, by gap, and the moves that filled them."""

    def __init__(self, size: int, counts: Mapping[int, int]):
        self.size, self.left, self.bins = size, dict(counts), 0
        self.taken: Counter[int] = Counter()
        self.moves: list[Move] = []
        self.runs: dict[int, list[tuple[int, int]]] = {}  # gap -> (first bin, how many)
        self.gaps: list[int] = []

    def put(self, length: int, n: int, first_bin: int, each: int, offset: int) -> None:
        self.moves.append(Move(length, self.taken[length], n, first_bin, each, offset))
        self.taken[length] += n
        self.left[length] -= n

    def open(self, n: int) -> int:
        self.bins += n
        return self.bins - n

    def leave(self, gap: int, first_bin: int, n: int) -> None:
        if gap and n:
            if gap not in self.runs:
                self.runs[gap] = []
                insort(self.gaps, gap)
            self.runs[gap].append((first_bin, n))

    def match(self) -> None:
        """Pieces above a third of a bin: the longest left, and the longest left that fits beside it."""
        large = sorted(s for s, n in self.left.items() if 3 * s > self.size and n)
        while large:
            a = large[-1]
            most = min(bisect_right(large, self.size - a), len(large)) - 1
            if most >= 0 and large[most] == a and self.left[a] < 2:
                most -= 1
            if most < 0:
                n = self.left[a]
                at = self.open(n)
                self.put(a, n, at, 1, 0)
                self.leave(self.size - a, at, n)
            elif (b := large[most]) == a:
                n = self.left[a] // 2
                at = self.open(n)
                self.put(a, 2 * n, at, 2, 0)
                self.leave(self.size - 2 * a, at, n)
            else:
                n = min(self.left[a], self.left[b])
                at = self.open(n)
                self.put(a, n, at, 1, 0)
                self.put(b, n, at, 1, a)
                self.leave(self.size - a - b, at, n)
                if not self.left[b]:
                    large.pop(most)
            if not self.left[a]:
                large.remove(a)

    def fit(self) -> None:
        """The others, longest first: the smallest gap takes as many as it can, for what is tightest stays tightest."""
        for s in sorted((s for s, n in self.left.items() if n), reverse=True):
            while n := self.left[s]:
                at = bisect_left(self.gaps, s)
                if at < len(self.gaps):
                    gap = self.gaps[at]
                    first, bins = self.runs[gap].pop()
                    if not self.runs[gap]:
                        del self.runs[gap], self.gaps[at]
                else:
                    gap, bins = self.size, -(-n // (self.size // s))
                    first = self.open(bins)
                each = min(gap // s, n)
                some = min(bins, n // each)
                self.put(s, some * each, first, each, self.size - gap)
                self.leave(gap - each * s, first, some)
                self.leave(gap, first + some, bins - some)


def bins_of(counts: Mapping[int, int], size: int) -> list[Move]:
    """Where `counts` (length -> pieces) go, for lengths from 1 to `size`."""
    bins = Bins(size, counts)
    bins.match()
    bins.fit()
    return bins.moves


class Lookup:
    """(bin, offset) of the how-manieth piece of a length."""

    def __init__(self, moves: list[Move]):
        moves = sorted(moves, key=lambda m: (m.length, m.first))
        self.keys = np.array([(m.length << RANK_BITS) + m.first for m in moves], np.int64)
        self.bin, self.each, self.offset = (np.array([getattr(m, f) for m in moves], np.int64) for f in ("bin", "each", "offset"))

    def __call__(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = (length << RANK_BITS) + rank
        at = np.searchsorted(self.keys, key, "right") - 1
        nth = key - self.keys[at]
        return self.bin[at] + nth // self.each[at], self.offset[at] + nth % self.each[at] * length


PIECES = [
    ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
    ("ids", pa.list_(pa.int32())), ("task", pa.int32()), ("nth", pa.int64()),
]


def _cut(vocabulary: str, size: int, end_id: int, with_ids: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task = encoder(vocabulary), TaskContext.get().partitionId()
        end = np.array([end_id], np.uint32)
        seen: Counter[int] = Counter()
        for batch in slices(batches, "text", most_bytes=BATCH_BYTES):
            schema = pa.schema([("id", batch.schema.field("id").type), *PIECES])
            out = []
            for key, ids in zip(batch.column("id").to_pylist(), encode(pc.fill_null(batch.column("text"), "")), strict=True):
                ids = np.concatenate((ids, end)).astype("<u4", copy=False)
                for piece, at in enumerate(range(0, len(ids), size)):
                    part = ids[at : at + size]
                    n = len(part)
                    out.append((key, piece, at, n, zlib.crc32(part), part.view(np.int32) if with_ids else None, task, seen[n]))
                    seen[n] += 1
            yield pa.record_batch(list(map(list, zip(*out))), schema=schema)

    return run


def _placed(lookup: Lookup, keep: list[str]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
                bins, offsets = lookup(length, rank)
                yield pa.record_batch([*(batch.column(c) for c in keep), pa.array(bins), pa.array(offsets)], [*keep, "sequence_id", "offset"])

    return run


def best_fit_packed(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "word_bpe_49k.json",
    size: int = 4096, end_id: int = 1, with_ids: bool = True,
) -> DataFrame:
    """(id, piece, start, length, ids_crc32, ids, sequence_id, offset) of every piece; ids are null without `with_ids`."""
    if not 0 < size < 1 << 14:
        raise ValueError("sequences have 1 to 16383 tokens")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    out = f"id {kind}, piece int, start long, length long, ids_crc32 long, ids array<int>"
    pieces = staged(rows.mapInArrow(_cut(vocabulary, size, end_id, with_ids), f"{out}, task int, nth long"))
    counts = pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    total = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # `size` at most
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    ranked = pieces.join(first, ["length", "task"]).withColumn("rank", F.col("first") + F.col("nth"))
    keep = ["id", "piece", "start", "length", "ids_crc32", "ids"]
    return ranked.select(*keep, "rank").mapInArrow(_placed(Lookup(bins_of(total, size)), keep), f"{out}, sequence_id long, offset long")
