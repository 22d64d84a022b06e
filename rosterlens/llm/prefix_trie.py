"""The trie of conversations that begin alike, by van Emde Boas recursion.

A conversation is a sequence of turns. Sequences are cut at half their depth; the parts before the cut get names, the
smallest conversation that begins so, which are the leaves of an upper trie and the roots of a forest of lower ones. Upper and
lower parts are cut again, all ranges of depths at once, until every depth has been a cut. So depth d, whose
lowest set bit is b, is named in the round of b from the name at d - b and a digest of the turns between, and a conversation of n
turns takes log2(n) rounds, one grouping each, whether it has three turns or a third of the table. The same ranges are
put together again from the smallest: the totals of a lower trie are known once its own ranges are done, and its root hands them
to the b nodes above it in the upper trie. A chain of n nodes costs n log n rows, not n^2.

Turns are numbered over sorted ranges, counts carried over their borders, so no conversation has to fit one task. Digests of
segments are sums over their turns, combined before the shuffle. The hash over the conversations that end in a node is
taken from chunks of sorted ids, which each range writes for itself.

Defined results: null conversation ids are left out. Null roles and texts are empty. Turns go by number, nulls first, turns of one
number by the first 128 characters of role, NUL and text, then by a digest of both; rows that repeat are turns of
their own. A conversation without turns is a member of the root alone. An empty table gives no rows. Turns and segments are told
apart by 128 bits. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rosterlens.llm.common import staged

WORDS = r"[^\x20\x09-\x0D]+"
TIE_CHARS = 128
CHUNK_CHARS = 1 << 18


def _runs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows with their place among those of their conversation in this range, from 1."""
    part = TaskContext.get().partitionId()
    last, n = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        conv = batch.column("conv").to_numpy(zero_copy_only=False)
        new = np.concatenate(([last is None or conv[0] != last], conv[1:] != conv[:-1]))
        at = np.arange(len(conv))
        start = np.maximum.accumulate(np.where(new, at, 0))
        place = at - start + 1
        if not new[0]:
            place[: len(place) if new.sum() == 0 else int(new.argmax())] += n
        last, n = conv[-1], int(place[-1])
        yield pa.record_batch(
            [*batch.columns, pa.array(np.full(len(conv), part)), pa.array(place)], [*batch.schema.names, "part", "place"])


def numbered_turns(
    conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """(conv, i, turn, words) of every turn: its number from 1, a digest of role and text, the words of the text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    both = F.concat(role, F.lit("\0"), text)
    rows = conversations.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("no"), F.substring(both, 1, TIE_CHARS).alias("tie"),
        F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))).alias("turn"),
        F.regexp_count(text, F.lit(WORDS)).cast("long").alias("words"), F.monotonically_increasing_id().alias("row"),
    )
    order = [F.col("conv"), F.col("no").asc_nulls_first(), F.col("tie"), F.col("turn"), F.col("row")]
    placed = staged(
        rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv", "turn", "words")
        .mapInArrow(_runs, "conv long, turn binary, words long, part long, place long")
    )
    # Ranges are ordered by conversation, so one at most goes on from the range before: a row per range.
    before = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        placed.groupBy("conv", "part").agg(F.max("place").alias("n"))
        .select("conv", "part", F.sum("n").over(before).alias("carry")).where("carry > 0")
    )
    return placed.join(F.broadcast(carried), ["conv", "part"], "left").select(
        "conv", (F.col("place") + F.coalesce("carry", F.lit(0))).alias("i"), "turn", "words")


def with_shared_openings(turns: DataFrame, every: int = 20, most: int = 3) -> tuple[DataFrame, DataFrame]:
    """((conv, d, turn, words, len), (conv, len)) of conversations that open with turns of the first of their block.

    Conversation c takes the first h turns of conversation c - c % every, h = crc32(c as text) % (most + 1), in place of its own.
    """
    head = turns.where((F.col("conv") % every == 0) & (F.col("i") <= most)).withColumnRenamed("conv", "base")
    convs = turns.groupBy("conv").agg(F.max("i").alias("own")).select(
        "conv", "own", (F.col("conv") - F.col("conv") % every).alias("base"),
        (F.crc32(F.col("conv").cast("string").cast("binary")) % (most + 1)).alias("h"),
    )
    heads = head.groupBy("base").agg(F.max("i").alias("there"))
    convs = convs.join(heads, "base", "left").withColumn("m", F.least("h", F.coalesce("there", F.lit(0))))
    convs = staged(convs.select("conv", "base", "h", "m", (F.col("m") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("len")))
    opening = convs.join(head, "base").where("i <= h").select("conv", F.col("i").alias("d"), "turn", "words", "len")
    own = turns.join(convs, "conv").where("i > h").select("conv", (F.col("i") - F.col("h") + F.col("m")).alias("d"), "turn", "words", "len")
    return opening.union(own), convs.select("conv", "len")


def segments(turns: DataFrame) -> DataFrame:
    """(conv, d, one, two, words, b): a digest of the b turns up to d, for the lowest set bit b of each depth d."""
    halves = """filter(
        transform(sequence(0, CAST(log2(len) AS INT)), j -> named_struct('b', shiftleft(1L, j), 'q', shiftright(d - 1, j))),
        s -> s.q % 2 = 0 AND (s.q + 1) * s.b <= len)"""
    rows = turns.select("conv", "d", "turn", "words", F.explode(F.expr(halves)).alias("s")).select(
        "conv", F.expr("(s.q + 1) * s.b").alias("to"), F.col("s.b").alias("b"), "d", "turn", "words")
    return rows.groupBy("conv", "to", "b").agg(
        F.bit_xor(F.xxhash64("d", "turn")).alias("one"), F.bit_xor(F.xxhash64("turn", F.lit(7), "d")).alias("two"),
        F.max(F.when(F.col("d") == F.col("to"), F.col("words"))).alias("words"),
    ).select("conv", F.col("to").alias("d"), "one", "two", "words", "b")


def _all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def named_prefixes(turns: DataFrame, convs: DataFrame) -> tuple[DataFrame, int]:
    """((conv, d, name, words) for every depth of every conversation, the largest depth)."""
    deepest, root = convs.agg(F.max("len"), F.min("conv")).first()
    names = [convs.select("conv", F.lit(0).cast("long").alias("d"), F.lit(root).cast("long").alias("name"), F.lit(0).cast("long").alias("words"))]
    if deepest:
        parts = staged(segments(turns), "b")
        for b in (1 << j for j in reversed(range(deepest.bit_length()))):
            here = parts.where(F.col("b") == b).drop("b").withColumn("above", F.col("d") - b)
            up = _all(names).select("conv", F.col("d").alias("above"), F.col("name").alias("up"))
            keyed = here.join(up, ["conv", "above"])
            key = ["d", "up", "one", "two"]
            named = keyed.groupBy(*key).agg(F.min("conv").alias("name"))
            names.append(staged(keyed.join(named, key).select("conv", "d", "name", "words")))
    return _all(names), deepest or 0


def _chunks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (d, name, conv) as runs of ids of one node, joined by commas."""
    key, first, ids, size = None, 0, [], 0
    out: list[tuple] = []
    for batch in batches:
        for d, name, conv in zip(*(c.to_pylist() for c in batch.columns)):
            if (d, name) != key or size > CHUNK_CHARS:
                if key:
                    out.append((*key, first, ",".join(ids)))
                key, first, ids, size = (d, name), conv, [], 0
            ids.append(str(conv))
            size += len(ids[-1]) + 1
        if out:
            yield pa.record_batch(list(map(list, zip(*out))), ["d", "name", "first", "ids"])
            out = []
    if key:
        yield pa.record_batch([[key[0]], [key[1]], [first], [",".join(ids)]], ["d", "name", "first", "ids"])


def _hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One hash over the chunks of a node, which come in order."""
    key, digest = None, None
    out: list[tuple] = []
    for batch in batches:
        for d, name, ids in zip(*(c.to_pylist() for c in batch.columns)):
            if (d, name) == key:
                digest.update(b",")
            else:
                if key:
                    out.append((*key, digest.hexdigest()))
                key, digest = (d, name), hashlib.sha256()
            digest.update(ids.encode())
        if out:
            yield pa.record_batch(list(map(list, zip(*out))), ["d", "name", "ends"])
            out = []
    if key:
        yield pa.record_batch([[key[0]], [key[1]], [digest.hexdigest()]], ["d", "name", "ends"])


def ends_of(names: DataFrame, convs: DataFrame) -> DataFrame:
    """(d, name, ends): SHA-256 of the ids that end in each node, ascending, comma-joined."""
    ends = names.join(convs.select("conv", F.col("len").alias("d")), ["conv", "d"]).select("d", "name", "conv")
    chunks = ends.repartitionByRange("d", "name", "conv").sortWithinPartitions("d", "name", "conv").mapInArrow(
        _chunks, "d long, name long, first long, ids string")
    dealt = chunks.repartition("d", "name").sortWithinPartitions("d", "name", "first").select("d", "name", "ids")
    return dealt.mapInArrow(_hashed, "d long, name long, ends string")


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of every node.

    `turns` has (conv, d, turn, words, len) of every turn, d from 1 to len; `convs` has (conv, len), also those without turns.
    """
    turns, convs = staged(turns), staged(convs)
    names, deepest = named_prefixes(turns, convs)
    nodes = names.groupBy("d", "name").agg(F.count(F.lit(1)).alias("n_convs"), F.max("words").alias("words")).select(
        "d", "name", "n_convs", ((F.col("n_convs") - 1) * F.col("words")).alias("saved"))
    up = names.select(F.col("conv").alias("name"), (F.col("d") + 1).alias("d"), F.col("name").alias("parent"))
    nodes = staged(nodes.join(up, ["name", "d"], "left"))
    children = nodes.where("d > 0").groupBy((F.col("d") - 1).alias("d"), F.col("parent").alias("name")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = staged(nodes.join(children, ["d", "name"], "left").fillna(0, ["n_children"]).withColumn(
        "leaves", (F.col("n_children") == 0).cast("long")))

    totals = [nodes.select("d", "name", "leaves", "saved")]
    above = names.select(F.col("conv").alias("member"), "d", "name")
    for b in (1 << j for j in range(deepest.bit_length())):
        roots = _all(totals).where(F.col("d") % (2 * b) == b).groupBy("d", "name").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
        handed = roots.select(
            F.col("name").alias("member"), F.explode(F.sequence(F.col("d") - b, F.col("d") - 1)).alias("d"), "leaves", "saved")
        totals.append(staged(
            handed.join(above, ["member", "d"]).groupBy("d", "name").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))))
    summed = _all(totals).groupBy("d", "name").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    return (
        nodes.join(summed, ["d", "name"]).join(ends_of(names, convs), ["d", "name"], "left")
        .select(
            F.col("name").alias("conv_id"), F.col("d").alias("depth"), F.col("parent").alias("parent_conv_id"), "n_convs", "n_children",
            "n_leaves", "saved_tokens", F.coalesce("ends", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
        )
    )


def conversation_trie(conversations: DataFrame, every: int = 20, most: int = 3, **columns: str) -> DataFrame:
    """`prefix_trie` of conversations that share openings (`with_shared_openings`); columns as for `numbered_turns`."""
    return prefix_trie(*with_shared_openings(numbered_turns(conversations, **columns), every, most))
