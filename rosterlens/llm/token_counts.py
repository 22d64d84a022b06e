"""Token counts by a two-tier lookup on the map side.

Pieces of the vocabulary never join a character with a space after it, so a text falls apart at its spaces
into pre-tokens that are encoded alone. A first pass counts the pre-tokens of every text within its task;
each task hands on its most frequent ones, and the most frequent of those become one table of lengths, of
at most `table_size` entries, broadcast to all tasks. The second pass adds up lengths: from the table, then
from the worker's own cache, then by encoding. No pre-token of a document is ever shuffled; only the top
counts of each task (at most `task_top` rows) are merged. The table changes speed, never a count.

Defined results: a null text counts as empty, with no bytes and no tokens. Rows are independent, so ties,
repeats and null ids pass through. Columns besides id and text are not read. A vocabulary with pieces
across spaces is handled by encoding each text whole.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import cache

import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterlens.llm.common import slices

SPACE = "▁"  # how the vocabulary spells a space
CACHE_ENTRIES = 600_000
LONGEST = 64  # characters of a pre-token in the table or a cache; longer ones are encoded each time


@cache
def processor(model: str) -> tuple[sentencepiece.SentencePieceProcessor, bool]:
    """The model, and whether texts may be cut before their spaces."""
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(model))
    pieces = map(sp.id_to_piece, range(sp.get_piece_size()))
    apart = not any(SPACE in p.lstrip(SPACE) for p in pieces)
    plain = sp.encode("a  b ", out_type=str)
    return sp, apart and "".join(plain) == f"{SPACE}a{SPACE * 2}b{SPACE}"


def pre_tokens(text: str) -> list[str]:
    """The text, which ends in no space, cut before each run of spaces, the first space of a run left out.

    Encoding sets one space before what it is given, so each part is encoded as it stands in the text.
    """
    parts = text.split(" ")
    if "" not in parts:
        return parts
    out, gap = [], ""
    for part in parts:
        if part:
            out.append(gap + part)
            gap = ""
        else:
            gap += " "
    return out


class Lengths(dict):
    """Pre-token -> tokens; misses are encoded, kept up to LONGEST characters, and the cache begins anew when it is full."""

    def __init__(self, model: str, table: dict[str, int]):
        super().__init__(table)
        self.sp, self.table = processor(model)[0], table

    def __missing__(self, part: str) -> int:
        if len(part) > LONGEST:
            return len(self.sp.encode(part))
        if len(self) > CACHE_ENTRIES + len(self.table):
            self.clear()
            self.update(self.table)
        n = self[part] = len(self.sp.encode(part))
        return n


def count_text(text: str, lengths: Lengths, apart: bool) -> int:
    if not text:
        return 0
    if not apart or SPACE in text or text[-1] == " ":
        return len(lengths.sp.encode(text))
    return sum(map(lengths.__getitem__, pre_tokens(text)))


def frequent_lengths(docs: DataFrame, text_col: str, model: str, table_size: int, task_top: int) -> dict[str, int]:
    """The lengths of the most frequent pre-tokens, counted over all texts."""

    def top(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in slices(batches, "text"):
            for text in batch.column("text").to_pylist():
                counts.update(p for p in (text or "").split(" ") if len(p) <= LONGEST)
            if len(counts) > CACHE_ENTRIES:  # lossy counting: rare ones go, and count afresh
                least = sorted(counts.values())[len(counts) // 2]
                counts = Counter({k: n for k, n in counts.items() if n > least})
        best = heapq.nlargest(task_top, counts.items(), key=lambda x: (x[1], x[0]))
        yield pa.record_batch(
            [pa.array([k for k, _ in best], pa.string()), pa.array([n for _, n in best], pa.int64())], ["part", "n"]
        )

    rows = (
        docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(top, "part string, n long")
        .groupBy("part").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "part").limit(table_size).collect()
    )
    sp = processor(model)[0]
    return {r.part: len(sp.encode(r.part)) for r in rows if r.part}


def token_counts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = "piece_bpe_32k.model",
    table_size: int = 32_768, task_top: int = 2_048,
) -> DataFrame:
    """(id, n_bytes, n_tokens) of every row."""
    spark = docs.sparkSession
    table = spark.sparkContext.broadcast(
        frequent_lengths(docs, text_col, model, table_size, task_top) if processor(model)[1] else {}
    )

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, apart = Lengths(model, table.value), processor(model)[1]
        for batch in slices(batches, "text"):
            texts = batch.column("text")
            tokens = [count_text(t, lengths, apart) for t in texts.to_pylist()]
            size = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
            yield pa.record_batch([batch.column("id"), size, pa.array(tokens, pa.int64())], ["id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(count, f"id {kind}, n_bytes long, n_tokens long")
