"""Exact duplicates found by radix tries over length and content hash.

Equal texts have one length and one hash, so texts are dealt by length and a short hash prefix. A task first folds what it
reads in tries of its own, one for each (length, prefix), and hands on each text it has met once, with the id that stays and
the number of rows; when those tries hold `held_bytes`, they are handed on and begun anew. A partition of the shuffle is sorted by length,
prefix and hash. The full byte strings of a subtree (a length and a prefix) are inserted into one compressed radix trie, whose
terminal nodes hold the id that stays and the rows; which strings are equal is decided there, byte by byte, and texts that merely share
a prefix or a hash are different terminals. A subtree that outgrows `held_bytes` is written out and freed at the next
change of the hash, behind which no equal text can come; what does not fit memory before that spills in Spark's sort, subtree by
subtree. Members then meet their group by SHA-256 in a plain join, which adaptive execution splits where one text holds many rows.

Defined results: a null text counts as empty; empty texts are equal to each other. A null id never stays
unless its group has no other; rows that repeat both id and text are one document and carry the same
verdict. An empty table gives no rows. Ids must be whole numbers. Columns besides id and text are not read.
"""

from __future__ import annotations

import hashlib
import string
from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterlens.llm.common import slices

HELD_BYTES = 48 << 20  # of texts in tries of one task
NODE_BYTES = 700  # what Python needs for a terminal and its edge
PREFIX_BITS = 16


class RadixTrie:
    """Byte strings in a compressed trie: an edge holds a run of bytes, a terminal [owner, rows]."""

    def __init__(self) -> None:
        self.edges: dict[int, list] = {}  # first byte -> [run of bytes, child trie]
        self.terminal: list | None = None

    def node(self, key: bytes) -> RadixTrie:
        """The node of `key`, made if it is new."""
        at, start = self, 0
        while start < len(key):
            edge = at.edges.get(key[start])
            if edge is None:
                child = RadixTrie()
                at.edges[key[start]] = [key[start:], child]
                return child
            run, child = edge
            if not key.startswith(run, start):
                same = shared_length(run, key, start)
                middle = RadixTrie()
                middle.edges[run[same]] = [run[same:], child]
                edge[:] = [run[:same], middle]
                at, start = middle, start + same
            else:
                at, start = child, start + len(run)
        return at

    def terminals(self) -> Iterator[tuple[bytes, list]]:
        """Every string with its terminal."""
        waiting: list[tuple[RadixTrie, tuple]] = [(self, ())]  # a node, and its runs as (runs before, run)
        while waiting:
            at, runs = waiting.pop()
            if at.terminal:
                parts = []
                rest = runs
                while rest:
                    rest, run = rest
                    parts.append(run)
                yield b"".join(reversed(parts)), at.terminal
            waiting.extend((child, (runs, run)) for run, child in at.edges.values())


def shared_length(run: bytes, key: bytes, start: int) -> int:
    """Bytes that `run` and `key[start:]` begin with in common, by halving."""
    low, high = 0, min(len(run), len(key) - start)
    while low < high:
        middle = (low + high + 1) // 2
        if run[:middle] == key[start : start + middle]:
            low = middle
        else:
            high = middle - 1
    return low


def folded(text: str | None) -> bytes:
    """UTF-8 with A-Z, and nothing else, in lower case."""
    return (text or "").encode().lower()


def folded_column(text: Column) -> Column:
    """The same as an expression; texts of ASCII alone are lower-cased the short way."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def content_hash(content: bytes) -> int:
    return xxhash.xxh64_intdigest(content) - (1 << 63)


def _better(largest: bool):
    def choose(a, b):
        if a is None or b is None:
            return b if a is None else a
        return max(a, b) if largest else min(a, b)

    return choose


class Subtrees:
    """Tries by (length, hash prefix), and about how many bytes they hold."""

    def __init__(self, largest: bool):
        self.choose = _better(largest)
        self.tries: dict[tuple[int, int], RadixTrie] = {}
        self.held = 0

    def add(self, key: tuple[int, int], content: bytes, owner: int | None, rows: int) -> None:
        trie = self.tries.get(key)
        if trie is None:
            trie = self.tries[key] = RadixTrie()
        node = trie.node(content)
        if node.terminal is None:
            node.terminal = [owner, rows]
            self.held += NODE_BYTES + len(content)
        else:
            node.terminal[:] = [self.choose(node.terminal[0], owner), node.terminal[1] + rows]

    def finished(self) -> Iterator[tuple[tuple[int, int], bytes, list]]:
        for key, trie in self.tries.items():
            for content, terminal in trie.terminals():
                yield key, content, terminal
        self.tries, self.held = {}, 0


ROWS = pa.schema([
    ("size", pa.int64()), ("prefix", pa.int32()), ("hash", pa.int64()), ("content", pa.binary()), ("owner", pa.int64()), ("rows", pa.int64()),
])
OWNERS = pa.schema([("sha", pa.binary()), ("owner", pa.int64()), ("rows", pa.int64())])


def _batches(rows: Iterable[tuple], schema: pa.Schema, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    some, size = [], 0
    for row in rows:
        some.append(row)
        size += 64 + sum(len(v) for v in row if isinstance(v, bytes))
        if size > most_bytes:
            yield pa.record_batch(list(map(list, zip(*some))), schema=schema)
            some, size = [], 0
    if some:
        yield pa.record_batch(list(map(list, zip(*some))), schema=schema)


def _folded_in_task(largest: bool, prefix_bits: int, held_bytes: int, hash_of):
    """Each text that the task meets, once while its tries hold it."""

    def handed(subtrees: Subtrees) -> Iterator[tuple]:
        for (size, prefix), content, (owner, rows) in subtrees.finished():
            yield size, prefix, hash_of(content), content, owner, rows

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        subtrees = Subtrees(largest)
        for batch in slices(batches, "text"):
            for owner, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                content = folded(text)
                prefix = hash_of(content) >> (64 - prefix_bits)
                subtrees.add((len(content), prefix), content, owner, 1)
                if subtrees.held > held_bytes:
                    yield from _batches(handed(subtrees), ROWS)
        yield from _batches(handed(subtrees), ROWS)

    return run


def _owners(largest: bool, held_bytes: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        subtrees, last = Subtrees(largest), None

        def finished() -> Iterator[tuple]:
            for _, content, (owner, rows) in subtrees.finished():
                yield hashlib.sha256(content).digest(), owner, rows

        for batch in slices(batches, "content"):
            for size, prefix, hash, content, owner, rows in zip(*(c.to_pylist() for c in batch.columns)):
                key = size, prefix
                if last and (key != last[0] or (subtrees.held > held_bytes and hash != last[1])):
                    if subtrees.held > held_bytes or len(subtrees.tries) > 1 << 10:
                        yield from _batches(finished(), OWNERS)
                last = key, hash
                subtrees.add(key, content, owner, rows)
        yield from _batches(finished(), OWNERS)

    return run


def exact_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", largest: bool = False, prefix_bits: int = PREFIX_BITS,
    held_bytes: int = HELD_BYTES, hash_of=content_hash,
) -> DataFrame:
    """(id, keep_id, group_size, sha) of every row; of equal texts the smallest id stays, or the largest."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    once = rows.mapInArrow(
        _folded_in_task(largest, prefix_bits, held_bytes, hash_of),
        "size long, prefix int, hash long, content binary, owner long, rows long",
    )
    owners = (
        once.repartition("size", "prefix").sortWithinPartitions("size", "prefix", "hash")
        .mapInArrow(_owners(largest, held_bytes), "sha binary, owner long, rows long")
    )
    members = rows.select("id", F.unhex(F.sha2(folded_column(F.coalesce("text", F.lit(""))), 256)).alias("sha"))
    return members.join(owners, "sha").select(
        "id", F.col("owner").alias("keep_id"), F.col("rows").alias("group_size"), "sha"
    )
