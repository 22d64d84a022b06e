"""Near-duplicate documents by b-bit minhash.

A document is the set of its five-word shingles, as 64-bit hashes. Documents with the same words are one
node, named by a 64-bit digest of them, so copies take part once however many there are. Each node has 128
minima: bands of four make its buckets, and of each minimum the low two bits are kept, packed in four longs.
Nodes that share a bucket are candidates; from the number of equal packed values, corrected for those that
are equal by chance, their similarity is estimated, and only pairs well below the threshold are let go. The
others are compared as full sets, so every link is confirmed. A pair at the threshold shares no bucket with
probability (1 - 0.75^4)^32 = 5e-6, and fails the estimate with less.

No bucket is expanded into all its pairs. First every node is compared with the best centre of its buckets,
which gives components; then with centres that are still in other components; last, in buckets that
still hold several components, nodes of different components meet in a join whose condition holds the estimate
and the comparison of the full sets, so that it emits links and nothing else. All tables that are used twice are
staged, so joins on hot buckets and nodes are plain joins of two shuffles that adaptive execution splits.

Defined results: documents of fewer than five words have one shingle, the whole sequence, and link only with
equal ones. Documents without words, and null texts, have no shingles and stand alone. The component of a
document is the smallest id linked with it, null ids ignored unless there is no other. Rows that repeat id
and text get the same result each. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterlens.llm.common import components, slices, staged

SHINGLE = 5
BANDS, BAND_ROWS = 32, 4
MINIMA = BANDS * BAND_ROWS
BITS = 2
PER_LONG = 64 // BITS
MARGIN = 0.2  # over four standard errors of the estimate
LOW_OF_PAIR = 0x5555555555555555
MULTIPLIERS = np.random.default_rng(20).integers(1, 2**31, MINIMA, dtype=np.int64).astype(np.uint32) * np.uint32(2) + np.uint32(1)
ADDENDS = np.random.default_rng(21).integers(0, 2**32, MINIMA, dtype=np.int64).astype(np.uint32)
ODD = np.uint64(0x9E3779B97F4A7C15)
CACHE_ENTRIES = 500_000
KEPT_BYTES = 64  # of a word in the cache
MARKS, CHUNK = 1 << 27, 1 << 15  # bits in all, and bits of one bitmap of Spark's
AT_ONCE = 1 << 16


def words(text: str | None) -> list[bytes]:
    """Words between the white space of ASCII, with A-Z and nothing else in lower case."""
    return (text or "").encode().lower().split()


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= KEPT_BYTES:
            if len(self) > CACHE_ENTRIES:
                self.clear()
            self[word] = h
        return h


def shingle_set(tokens: list[bytes], hashes: WordHashes) -> np.ndarray:
    """The distinct shingles as sorted 64-bit hashes."""
    if not tokens:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, tokens), np.uint64, len(tokens))
    n = max(len(h) - SHINGLE + 1, 1)
    out = np.full(n, min(len(h), SHINGLE), np.uint64)
    for i in range(min(len(h), SHINGLE)):
        out = (out ^ h[i : i + n]) * ODD
        out ^= out >> np.uint64(29)
    return np.unique(out)


def node_of(tokens: list[bytes]) -> int | None:
    if not tokens:
        return None
    return int.from_bytes(blake2b(b" ".join(tokens), digest_size=8).digest(), "little", signed=True)


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, MINIMA) minima; the sets are not empty."""
    out = np.empty((len(sets), MINIMA), np.uint32)
    i = 0
    while i < len(sets):
        j, size = i, 0
        while j < len(sets) and (j == i or size + len(sets[j]) <= AT_ONCE):
            size += len(sets[j])
            j += 1
        h = (np.concatenate(sets[i:j]) >> np.uint64(32)).astype(np.uint32)
        begins = np.cumsum([0, *map(len, sets[i : j - 1])])
        for k in range(MINIMA):
            out[i:j, k] = np.minimum.reduceat(h * MULTIPLIERS[k] + ADDENDS[k], begins)
        i = j
    return out


def packed_bits(least: np.ndarray) -> np.ndarray:
    """The low bits of the (mixed) minima, as longs."""
    low = ((least * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.uint64) & np.uint64(2**BITS - 1)
    low = low.reshape(len(least), -1, PER_LONG)
    return np.bitwise_or.reduce(low << np.arange(0, 64, BITS, dtype=np.uint64), axis=2).view(np.int64)


def buckets(least: np.ndarray) -> np.ndarray:
    rows = least.reshape(len(least), BANDS, BAND_ROWS).astype(np.uint64)
    out = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), rows.shape[:2]).copy()
    for r in range(BAND_ROWS):
        out = (out ^ rows[:, :, r]) * ODD
        out ^= out >> np.uint64(31)
    return out.view(np.int64)


def lists(values: np.ndarray) -> pa.Array:
    flat = pa.array(values.reshape(-1))
    return pa.ListArray.from_arrays(np.arange(0, values.size + 1, values.shape[1], dtype=np.int32), flat)


def _signed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in slices(batches, "text"):
        tokens = [words(t) for t in batch.column("text").to_pylist()]
        sets = [shingle_set(t, hashes) for t in tokens]
        least = np.zeros((len(sets), MINIMA), np.uint32)
        some = [i for i, s in enumerate(sets) if len(s)]
        if some:
            least[some] = minima([sets[i] for i in some])
        yield pa.record_batch(
            [
                batch.column("id"), batch.column("version"), pa.array([node_of(t) for t in tokens], pa.int64()),
                pa.array([len(s) for s in sets], pa.int64()), lists(packed_bits(least)), lists(buckets(least)),
                pa.array([len(t) >= SHINGLE for t in tokens]),
            ],
            ["id", "version", "node", "n", "bits", "buckets", "long"],
        )


def _marks(nodes: DataFrame) -> np.ndarray:
    """A bit for each of MARKS residues of node numbers, set if some node has it: 16 MB at any size."""
    at = F.col("node").bitwiseAND(MARKS - 1) + 1
    rows = (
        nodes.select(at.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("chunk"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")).collect()
    )
    out = np.zeros((MARKS // CHUNK, CHUNK // 8), np.uint8)
    for r in rows:
        out[r.chunk - 1] = np.frombuffer(r.bits, np.uint8)
    return out.reshape(-1)


def _sets_of_marked(spark, nodes: DataFrame):
    """The full sets of texts whose node may be among `nodes`; without a shuffle of texts."""
    shared = spark.sparkContext.broadcast(_marks(nodes))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, marks = WordHashes(), shared.value
        for batch in slices(batches, "text"):
            found: dict[int, np.ndarray] = {}
            for text in batch.column("text").to_pylist():
                tokens = words(text)
                node = node_of(tokens)
                if node is None or node in found:
                    continue
                bit = node & (MARKS - 1)
                if marks[bit >> 3] >> (bit & 7) & 1:
                    found[node] = shingle_set(tokens, hashes).view(np.int64)
            yield pa.record_batch(
                [pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.list_(pa.int64()))], ["node", "set"]
            )

    return run


def estimate(a: Column, b: Column) -> Column:
    """Similarity from the share of equal packed values, less those equal by chance."""
    unlike = F.lit(0)
    for i in range(MINIMA // PER_LONG):
        x = a[i].bitwiseXOR(b[i])
        for shift in range(1, BITS):
            x = x.bitwiseOR(F.shiftrightunsigned(x, shift))
        unlike = unlike + F.bit_count(x.bitwiseAND(F.lit(LOW_OF_PAIR)))
    chance = 2.0**-BITS
    return ((1 - unlike / MINIMA) - chance) / (1 - chance)


def _may_link(x: str, y: str, percent: int) -> Column:
    """The estimate is not far below the threshold, and the sizes allow it."""
    near = estimate(F.col(f"{x}.bits"), F.col(f"{y}.bits")) >= percent / 100 - MARGIN
    sizes = 100 * F.least(f"{x}.n", f"{y}.n") >= percent * F.greatest(f"{x}.n", f"{y}.n")
    return sizes & near


def _alike(a: Column, b: Column, percent: int) -> Column:
    """Two full sets reach the threshold: 100 * shared >= percent * (all - shared)."""
    return (100 + percent) * F.size(F.array_intersect(a, b)) >= percent * (F.size(a) + F.size(b))


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""
    both = (
        pairs.join(sets.select(F.col("node").alias("b"), F.col("set").alias("set_b")), "b")
        .join(sets.select(F.col("node").alias("a"), F.col("set").alias("set_a")), "a")
    )
    return both.where(_alike(F.col("set_a"), F.col("set_b"), percent)).select("a", "b")


def _merged(links: DataFrame, found: DataFrame, more: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All links and their components."""
    if more.isEmpty():
        return links, found
    links = links.union(more)
    return links, components(links)


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75) -> DataFrame:
    """(id, version, n_shingles, component, group) of every row; documents are linked from `percent` similarity.

    The group tells components apart whatever their ids are, null for documents without words. The version, a hash of the text, tells apart rows that share an id but not a text.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    signed = staged(rows.withColumn("version", F.xxhash64("text")).mapInArrow(
        _signed, "id long, version long, node long, n long, bits array<long>, buckets array<long>, long boolean"
    ))
    nodes = staged(
        signed.where("node IS NOT NULL").groupBy("node")
        .agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("bits").alias("bits"),
             F.first("buckets").alias("buckets"), F.first("long").alias("long"))
    )
    placed = staged(nodes.where("long").select("node", F.explode("buckets").alias("bucket")))
    shared = staged(placed.groupBy("bucket").agg(F.count("node").alias("size")).where("size > 1"))
    members = staged(placed.join(shared, "bucket"))
    bits = nodes.select("node", "n", "bits")

    # The centre of a bucket is its node with the most company: what copies were made of, rather than a copy.
    company = staged(members.groupBy("node").agg(F.sum("size").alias("company")))
    centres = staged(
        members.join(company, "node").groupBy("bucket")
        .agg(F.max_by("node", "company").alias("centre"), F.max("company").alias("company"))
    )
    stars = (
        members.join(centres, "bucket").where("node <> centre")
        .groupBy(F.col("centre").alias("a"), F.col("node").alias("b")).agg(F.max("company").alias("company"))
    )
    stars = staged(
        stars.join(bits.alias("y"), F.col("b") == F.col("y.node"))
        .join(bits.alias("x"), F.col("a") == F.col("x.node")).where(_may_link("x", "y", percent))
        .select("a", "b", "company")
    )
    # Every node that a pair may name: those of the stars, and those of buckets with more than two.
    named = (
        stars.select(F.col("a").alias("node")).union(stars.select("b"))
        .union(members.where("size > 2").select("node")).distinct()
    )
    wanted = staged(named)
    sets = staged(
        rows.select("text").mapInArrow(_sets_of_marked(docs.sparkSession, wanted), "node long, set array<long>")
        .join(wanted, "node", "left_semi").dropDuplicates(["node"])
    )

    # Each node with its best centre, then with the centres that are still in another component.
    best = staged(stars.groupBy("b").agg(F.max_by("a", "company").alias("a")).select("a", "b"))
    links = staged(_confirmed(best, sets, percent))
    found = components(links)
    of_a, of_b = (
        found.select(F.col("id").alias(x), F.col("component").alias(f"component_{x}")) for x in ("a", "b")
    )
    apart = ~F.col("component_a").eqNullSafe(F.col("component_b")) | F.col("component_a").isNull()
    others = stars.select("a", "b").join(of_b, "b", "left").join(of_a, "a", "left").where(apart).select("a", "b")
    more = staged(_confirmed(others.join(best, ["a", "b"], "left_anti"), sets, percent))
    links, found = _merged(links, found, more)

    # Last, nodes of different components that share a bucket. Their sets come along, so that the join
    # itself confirms a link and hands on nothing else.
    labelled = staged(
        members.where("size > 2").join(found.withColumnRenamed("id", "node"), "node", "left")
        .select("bucket", "node", F.coalesce("component", "node").alias("component"))
    )
    mixed = labelled.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    open_ = staged(labelled.join(mixed.where("low < high").select("bucket"), "bucket"))
    open_ = open_.join(bits.join(sets, "node"), "node")
    x, y = open_.alias("x"), open_.alias("y")
    across = x.join(
        y,
        (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.node") < F.col("y.node"))
        & (F.col("x.component") != F.col("y.component")) & _may_link("x", "y", percent)
        & _alike(F.col("x.set"), F.col("y.set"), percent),
    )
    more = staged(across.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct())
    links, found = _merged(links, found, more)

    linked = found.withColumnRenamed("id", "node").join(nodes.select("node", "id"), "node")
    least = linked.groupBy("component").agg(F.min("id").alias("least"))
    named = nodes.select("node", "id").join(
        linked.select("node", "component").join(least, "component").select("node", "least", F.col("component").alias("group")), "node", "left"
    ).select("node", F.coalesce("least", "id").alias("component"), F.coalesce("group", "node").alias("group"))
    return signed.select("id", "version", "node", "n").join(staged(named), "node", "left").select(
        "id", "version", F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component"), "group"
    )
