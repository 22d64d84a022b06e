"""Near-duplicate lines by a segment-partition edit join, in DataFrame operations only.

Lines of at least `least_chars` characters that differ by at most `threshold` edits are linked. A line of
length L is cut into threshold + 1 even segments; of two linked lines, the shorter has a segment that the
longer contains unchanged, at a place the lengths allow. So each line is indexed under its segments, keyed
by (length, segment number, content), and probes for every length within reach the substrings at those
places. Candidates that share a key are compared in the join by the counts of sixteen letters and pairs of digits, which
edits change by two at most each. Those that are left lose what they begin and end with in common and are verified by a
bit-parallel edit distance whose bits are a band of the matrix around the diagonal.

With a threshold of one, a key with more than `BUCKET` indexed lines (a template, say, in which a number changes) is not
joined as it is: one half of its lines is equal, so what is left must be within one edit, and is cut in halves again, under
that key. After a logarithm of the length at most, what is left is one unit, and lines that differ in nothing else are linked
with the first of them instead of with each other. So work and links stay in proportion to the lines.

With `edit_words`, lines of so many words that differ by one word edit are linked as well, by the same join over words
instead of characters: the longer a line, the more characters may differ, and a passage with a replaced word goes.

`threshold` may also grow with length: (from so many characters, edits) classes such as `BY_LENGTH`, of which the shorter
line of a pair has its threshold. Classes of more than `SEGMENTED` edits would need too many probes, and meet in word
pairs instead: an edit takes at most three of them from a line, so two lines have one of their 3 * threshold + 1 first
pairs in common, in any order of all pairs; the order puts rare ones first. Lines with fewer pairs than that meet
among themselves by segments. These candidates are verified by Spark's own banded edit distance.

Equal lines are one node however often they occur. Linked lines are a class; the first occurrence in a class
stays, by document id, then a hash of the text, then line number, and all others are dropped.

Defined results: a null text counts as empty and is one empty line. Shorter lines are never dropped, except that
with `least_words` equal lines of so many words are, however short. A document may lose all its lines
and stays, with an empty text. Rows that repeat both id and text are one document, with the same result for
each. Null ids come first. An empty table gives no rows. Lines are told apart by 128 bits. Extra
columns, of any name, are kept by `without_repeated_lines` and not read otherwise.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterlens.llm.common import components, quoted, staged

COUNTED = (*"etaoinshrdl", "01", "23", "45", "67", "89")  # letters and pairs of digits, counted to compare candidates
COUNT_BITS = 4
LEAST_CHARS = 24
THRESHOLD = 1
BY_LENGTH = ((24, 1), (48, 2), (96, 4), (192, 8), (384, 12))  # the last ones let a word be replaced
EDIT_WORDS = 12  # lines of so many words may differ by one word
LEAST_WORDS = 3  # of shorter lines that go when they are repeated as they are
BUCKET = 256  # indexed lines of a key that are joined as they are
SEGMENTED = 2
SLOTS, SLOT_SHARE = 1 << 16, 8  # counters of word pairs, and of how many lines one is counted


def _segment(length: Column, i: int | Column, threshold: int) -> tuple[Column, Column]:
    """(start from 1, length) of segment i of a line: even, the longer ones last."""
    base = F.floor(length / (threshold + 1)).cast("int")
    short = threshold + 1 - length % (threshold + 1)  # how many are not longer
    return i * base + F.greatest(F.lit(0), F.lit(i) - short) + 1, base + (F.lit(i) >= short).cast("int")


def _key(length: Column, i: int | Column, line: Column, start: Column, size: Column) -> Column:
    return F.xxhash64(length, F.lit(i), F.substring(line, start, size))


def index_keys(line: Column, threshold: int) -> Column:
    length = F.length(line)
    return F.array(*[_key(length, i, line, *_segment(length, i, threshold)) for i in range(threshold + 1)])


def probe_keys(line: Column, threshold: int) -> Column:
    """For every shorter or equal length, the substrings where a segment of it may be found unchanged."""
    keys = []
    for shorter in range(threshold + 1):
        length = F.length(line) - shorter
        for i in range(threshold + 1):
            start, size = _segment(length, i, threshold)
            # Few enough edits before it, seen from the left end and from the right end.
            low, high = max(-i, shorter - threshold + i), min(i, shorter + threshold - i)
            keys += [_key(length, i, line, start + shift, size) for shift in range(low, high + 1)]
    return F.array(*keys)


def many_keys(line: Column, threshold: int) -> tuple[Column, Column]:
    """`index_keys` and `probe_keys` of a large threshold, whose expressions would be too many to write out."""
    numbers = F.sequence(F.lit(0), F.lit(threshold))

    def of_length(shorter: Column) -> Column:
        length = F.length(line) - shorter

        def of_segment(i: Column) -> Column:
            start, size = _segment(length, i, threshold)
            low, high = F.greatest(-i, shorter - threshold + i), F.least(i, shorter + threshold - i)
            return F.transform(F.sequence(low, high), lambda shift: _key(length, i, line, start + shift, size))

        return F.flatten(F.transform(numbers, of_segment))

    length = F.length(line)
    index = F.transform(numbers, lambda i: _key(length, i, line, *_segment(length, i, threshold)))
    return index, F.flatten(F.transform(numbers, of_length))


def letter_counts(line: Column) -> Column:
    """The counts of the letters, modulo 16, side by side in a long."""
    out = F.lit(0).cast("long")
    for i, letters in enumerate(COUNTED):
        n = F.lit(0)
        for letter in letters:
            n = n + F.octet_length(line) - F.octet_length(F.replace(line, F.lit(letter), F.lit("")))
        n = n.cast("long")
        out = out.bitwiseOR(F.shiftleft(n.bitwiseAND(2**COUNT_BITS - 1), COUNT_BITS * i))
    return out


def counts_apart(a: Column, b: Column) -> Column:
    """How far the counts are apart at least."""
    out, whole = F.lit(0), 2**COUNT_BITS
    for i in range(len(COUNTED)):
        x, y = (F.shiftrightunsigned(c, COUNT_BITS * i).bitwiseAND(whole - 1) for c in (a, b))
        out = out + F.least(F.abs(x - y), whole - F.abs(x - y))
    return out


def shared_ends(a: Column, b: Column) -> Column:
    """How many characters two lines begin with in common, by halving: (a, b may be of any length)."""
    least = F.least(F.length(a), F.length(b))
    steps = F.transform(F.sequence(F.lit(30), F.lit(0), F.lit(-1)), lambda k: F.pow(F.lit(2), k).cast("int"))
    start = F.struct(a.alias("a"), b.alias("b"), least.alias("least"), F.lit(0).alias("same"))

    def further(state: Column, step: Column) -> Column:
        at = state["same"]
        equal = (at + step <= state["least"]) & (
            F.substring(state["a"], at + 1, step) == F.substring(state["b"], at + 1, step)
        )
        return F.struct(
            state["a"].alias("a"), state["b"].alias("b"), state["least"].alias("least"),
            F.when(equal, at + step).otherwise(at).alias("same"),
        )

    return F.aggregate(F.filter(steps, lambda s: s <= least), start, further, lambda s: s["same"])


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """`then` of a value that is computed once, however often `then` uses it."""
    return F.transform(F.array(value), then)[0]


def cut_pair(a: Column, b: Column) -> Column:
    """The two lines, as a struct, without what they begin and end with in common, which edits need not touch."""

    def pair(x: Column, y: Column) -> Column:
        return F.struct(x.alias("a"), y.alias("b"))

    def without_front(p: Column) -> Column:
        return let(shared_ends(p["a"], p["b"]), lambda n: pair(*(F.substring(p[x], n + 1, F.lit((1 << 31) - 1)) for x in "ab")))

    def reversed_pair(p: Column) -> Column:
        return pair(F.reverse(p["a"]), F.reverse(p["b"]))

    return let(let(let(pair(a, b), without_front), reversed_pair), lambda p: let(let(p, without_front), reversed_pair))


def trimmed(df: DataFrame, a: str, b: str) -> DataFrame:
    """`df` with the two lines cut as by `cut_pair`."""
    cut = df.withColumn("_cut", cut_pair(F.col(a), F.col(b)))
    return cut.withColumns({a: F.col("_cut.a"), b: F.col("_cut.b")}).drop("_cut")


def edit_distance(a: Column, b: Column, threshold: int) -> Column:
    """The edit distance of two lines whose lengths differ by `threshold` at most; over it, some value over it."""
    units = F.struct(*(F.regexp_extract_all(x, F.lit("(?s)."), F.lit(0)).alias(name) for x, name in ((a, "a"), (b, "b"))))
    return let(units, lambda u: units_distance(u["a"], u["b"], threshold))


def units_distance(rows: Column, columns: Column, threshold: int) -> Column:
    """The same for arrays of characters, or of words.

    Column j of the matrix is seen through the 2 * threshold + 1 rows around row j. Their vertical differences
    are the bits of `up` and `down`, already moved to the rows of the next column; `score` is the value
    in the lowest of those rows while it runs down the diagonal, then along the last row.
    """
    width = 2 * threshold + 1
    full = F.lit((1 << width) - 1).cast("long")
    bottom = 1 << (width - 1)

    def step(state: Column, j: Column) -> Column:
        pattern, text = state["pattern"], F.element_at(state["text"], j)
        same = F.lit(0).cast("long")
        for bit in range(width):
            i = j - threshold + bit
            inside = (i >= 1) & (i <= F.size(pattern))
            same = same.bitwiseOR(F.when(inside & (F.get(pattern, i - 1) == text), F.lit(1 << bit)).otherwise(0))
        return F.struct(pattern, state["text"], state["up"], state["down"], state["score"], same.alias("same"), j.alias("j"))

    def advance(state: Column) -> Column:
        up, down, same, j = state["up"], state["down"], state["same"], state["j"]
        level = (((same.bitwiseAND(up)) + up).bitwiseXOR(up)).bitwiseOR(same).bitwiseOR(down).bitwiseAND(full)
        right = down.bitwiseOR(full.bitwiseXOR(level.bitwiseOR(up).bitwiseAND(full)))
        left = level.bitwiseAND(up)
        last = F.size(state["pattern"]) - j + threshold  # bit of the last row, once it is in the band
        diagonal = F.when(level.bitwiseAND(bottom) == 0, 1).otherwise(0)
        along = F.getbit(right, last) - F.getbit(left, last)
        score = state["score"] + F.when(last >= width - 1, diagonal).otherwise(along.cast("int"))
        lowered = F.shiftrightunsigned(level, 1)
        return F.struct(
            state["pattern"].alias("pattern"), state["text"].alias("text"),
            left.bitwiseOR(full.bitwiseXOR(lowered.bitwiseOR(right))).alias("up"),
            lowered.bitwiseAND(right).alias("down"), score.alias("score"),
        )

    start = F.struct(
        rows.alias("pattern"), columns.alias("text"),
        F.lit(((1 << (threshold + 1)) - 1) << threshold).cast("long").alias("up"),
        F.lit(0).cast("long").alias("down"), F.least(F.size(rows), F.lit(threshold)).alias("score"),
    )
    end = F.aggregate(
        F.sequence(F.lit(1), F.size(columns)), start, lambda s, j: F.transform(F.array(step(s, j)), advance)[0],
        lambda s: s["score"],
    )
    return F.when(F.size(columns) == 0, F.size(rows)).otherwise(end)


def near_links(lines: DataFrame, threshold: int) -> DataFrame:
    """(a, b) of the distinct lines (node, line) within the threshold of each other."""
    if threshold == 1:
        letters = F.col("letters") if "letters" in lines.columns else letter_counts(F.col("line"))
        counted = lines.select("node", F.col("line").alias("rest"), letters.alias("letters"))
        return verified(lines, one_edit_candidates(counted, CHARACTERS), 1)
    sized = lines.select("node", "line", letter_counts(F.col("line")).alias("letters"))
    index = sized.select(F.col("node").alias("x"), F.col("letters").alias("lx"), F.explode(index_keys(F.col("line"), threshold)).alias("key"))
    probe = sized.select(F.col("node").alias("y"), F.col("letters").alias("ly"), F.explode(probe_keys(F.col("line"), threshold)).alias("key"))
    apart = counts_apart(F.col("lx"), F.col("ly"))
    pairs = (
        index.join(probe, (index["key"] == probe["key"]) & (F.col("x") != F.col("y")) & (apart <= 2 * threshold))
        .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    )
    return verified(lines, pairs, threshold)


def with_lines(lines: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, line_a, line_b); only lines of some pair are moved."""
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    found = staged(lines.select("node", "line").join(nodes, "node", "left_semi"))
    return (
        pairs.join(found.select(F.col("node").alias("a"), F.col("line").alias("line_a")), "a")
        .join(found.select(F.col("node").alias("b"), F.col("line").alias("line_b")), "b")
    )


def verified(lines: DataFrame, candidates: DataFrame, threshold: int) -> DataFrame:
    """Those of the candidates (a, b) that are within the threshold."""
    near = F.abs(F.length("line_a") - F.length("line_b")) <= threshold
    texts = staged(with_lines(lines, staged(candidates)).where(near))
    distance = let(cut_pair(F.col("line_a"), F.col("line_b")), lambda cut: edit_distance(cut["a"], cut["b"], threshold))
    return texts.where(distance <= threshold).select("a", "b")


def word_marks(words: Column) -> Column:
    """A bit for each of 64 kinds of words, set if their number is odd: an edit changes two of them at most."""
    def add(marks: Column, word: Column) -> Column:
        return marks.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(word, F.lit(64)).cast("int")))

    return F.aggregate(words, F.lit(0).cast("long"), add)


@dataclass(frozen=True)
class Units:
    """What lines consist of: how many there are in a column, a part of it, from 1, and how many edits two marks are apart, twice."""

    length: Callable[[Column], Column]
    part: Callable[[Column, Column, Column], Column]
    apart: Callable[[Column, Column], Column]


CHARACTERS = Units(F.length, F.substring, counts_apart)
WORDS = Units(F.size, F.slice, lambda a, b: F.bit_count(a.bitwiseXOR(b)))


def _halves(units: Units, probing: bool, lines: bool, with_rest: bool) -> Column:
    """Keys of the halves of `rest` under `group`, and with them, where asked for, what is left of `rest` without that half.

    Of one unit there are no halves: it is the key, and the longer line probes what is left without either of its units. Whole
    `lines` have more.
    """
    rest, group = F.col("rest"), F.col("group")
    whole = units.length(rest)
    out = []
    for shorter in (0, 1) if probing else (0,):
        length = whole - shorter
        base = F.floor(length / 2).cast("int")

        def keyed(kind: int, part: Column, left: Column, length: Column = length) -> Column:
            key = F.xxhash64(group, length, F.lit(kind), part)
            return F.struct(key.alias("key"), left.alias("rest")) if with_rest else key

        halves = [
            keyed(0, units.part(rest, F.lit(1), base), units.part(rest, base + 1, whole - base)),
            keyed(1, units.part(rest, base + shorter + 1, length - base), units.part(rest, F.lit(1), base + shorter)),
        ]
        if lines:
            out += halves
            continue
        none = F.slice(F.array(*halves), 1, 0)
        # Lines of equal length with one unit left are linked as a star, not here.
        starts = (1, 2) if shorter else () if probing else (1,)
        few = F.array(*[keyed(2, units.part(rest, F.lit(at), length), rest) for at in starts]) if starts else none
        out.append(F.when(length >= 2, F.array(*halves)).when(length >= 0, few).otherwise(none))
    return F.explode(F.array(*out) if lines else F.concat(*out))


def one_edit_candidates(lines: DataFrame, units: Units) -> DataFrame:
    """(a, b) of lines (node, rest, letters) of three units or more that may be one edit apart.

    No pair is missing, but for those whose lines are both linked to a third one.
    """
    index = probe = lines.withColumn("group", F.lit(0).cast("long"))
    links, whole = [], True
    while True:
        keyed = {
            probing: rows.select("node", "letters", _halves(units, probing, whole, False).alias("key"))
            for probing, rows in ((False, index), (True, probe))
        }
        hot = staged(keyed[False].groupBy("key").count().where(F.col("count") > BUCKET).select("key"))
        some = not hot.isEmpty()
        x, y = (keyed[probing].join(hot, "key", "left_anti") if some else keyed[probing] for probing in (False, True))
        apart = units.apart(F.col("lx"), F.col("ly"))
        links.append(
            x.select("key", F.col("node").alias("x"), F.col("letters").alias("lx"))
            .join(y.select("key", F.col("node").alias("y"), F.col("letters").alias("ly")), "key")
            .where((F.col("x") != F.col("y")) & (apart <= 2)).select("x", "y")
        )
        if not some:
            break
        index, probe = (
            staged(
                rows.select("node", "letters", _halves(units, probing, whole, True).alias("half")).select("node", "letters", "half.*")
                .join(hot, "key").select("node", "letters", "rest", F.col("key").alias("group"))
            )
            for probing, rows in ((False, index), (True, probe))
        )
        whole = False
        single = index.where(units.length(F.col("rest")) == 1)
        firsts = single.groupBy("group").agg(F.min("node").alias("x"))
        links.append(single.join(firsts, "group").where("x <> node").select("x", F.col("node").alias("y")))
    every = reduce(DataFrame.unionByName, links)
    return every.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def without_shared_words(pair: Column) -> Column:
    """A struct of two arrays without the words they begin with in common."""
    same = F.zip_with(pair["a"], pair["b"], lambda x, y: F.coalesce(x == y, F.lit(False)))
    first = F.array_position(F.concat(same, F.array(F.lit(False))), False).cast("int")
    return let(first, lambda at: F.struct(*(F.slice(pair[x], at, F.greatest(F.size(pair[x]) - at + 1, F.lit(0))).alias(x) for x in "ab")))


def word_links(lines: DataFrame, least: int) -> DataFrame:
    """(a, b) of the distinct lines (node, line) of at least `least` words that are one word edit apart."""
    words = F.split("line", " ")
    counted = lines.where(F.size(words) >= least).select("node", "line")
    coded = counted.select("node", F.transform(words, lambda w: F.xxhash64(w)).alias("rest"))
    coded = staged(coded.withColumn("letters", word_marks(F.col("rest"))))
    texts = with_lines(counted, staged(one_edit_candidates(coded, WORDS)))
    near = F.abs(F.size(F.split("line_a", " ")) - F.size(F.split("line_b", " "))) <= 1
    texts = staged(texts.where(near))
    # Words that lines begin and end with in common need not be touched by edits.
    pair = F.struct(F.split("line_a", " ").alias("a"), F.split("line_b", " ").alias("b"))
    reversed_pair = let(let(pair, without_shared_words), lambda p: F.struct(F.reverse(p["a"]).alias("a"), F.reverse(p["b"]).alias("b")))
    distance = let(let(reversed_pair, without_shared_words), lambda cut: units_distance(cut["a"], cut["b"], 1))
    return texts.where(distance <= 1).select("a", "b")


def word_pairs(lines: DataFrame) -> DataFrame:
    """`lines` with the distinct hashes of each word and the next one; the last word stands alone."""
    lines = lines.withColumn("words", F.split("line", " "))
    pairs = F.transform("words", lambda word, i: F.xxhash64(word, F.get("words", i + 1)))
    return lines.withColumn("pairs", F.array_distinct(pairs)).drop("words")


def slot_ranks(paired: DataFrame) -> bytearray:
    """A byte for each slot of word pairs that grows with how often they occur, counted over a share of the lines."""
    out = bytearray(SLOTS)
    some = paired.where(F.pmod("node", F.lit(SLOT_SHARE)) == 0).select(F.explode("pairs").alias("pair"))
    for r in some.groupBy(F.pmod("pair", F.lit(SLOTS)).alias("slot")).count().collect():
        out[r.slot] = min(127, int(4 * math.log2(r["count"] + 1)))
    return out


def rare_first(pairs: Column, ranks: bytearray) -> Column:
    """The pairs as longs that sort by the rank of their slot, then by hash."""
    table = F.lit(ranks)

    def ranked(pair: Column) -> Column:
        rank = F.ascii(F.substring(table, (F.pmod(pair, F.lit(SLOTS)) + 1).cast("int"), F.lit(1)).cast("string"))
        return F.shiftleft(rank.cast("long"), 56).bitwiseOR(F.shiftrightunsigned(pair, 8))

    return F.sort_array(F.transform(pairs, ranked))


def threshold_of(length: Column, classes: tuple[tuple[int, int], ...]) -> Column:
    out = F.lit(0)
    for start, threshold in classes:
        out = F.when(length >= start, threshold).otherwise(out)
    return out


def near_links_by_length(lines: DataFrame, classes: tuple[tuple[int, int], ...]) -> DataFrame:
    """(a, b) of the distinct lines (node, line) within the threshold that the shorter one's length has."""
    sized = lines.select("node", "line", F.length("line").alias("length"))
    segmented = [c for c in classes if c[1] <= SEGMENTED]
    paired = word_pairs(sized.where(F.col("length") >= min((c[0] for c in classes if c not in segmented), default=1 << 30)))
    most = (3 * threshold_of(F.col("length"), classes) + 1).cast("int")
    paired = staged(
        paired.select("node", "length", F.slice(rare_first(F.col("pairs"), slot_ranks(paired)), 1, most).alias("keys"), most.alias("most"))
    )
    few = sized.join(paired.where(F.size("keys") < F.col("most")).select("node"), "node", "left_semi")
    keyed = paired.select("node", "length", F.explode("keys").alias("key"))
    links = keyed.alias("x").join(keyed.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.node") < F.col("y.node")) & (
        F.abs(F.col("x.length") - F.col("y.length")) <= threshold_of(F.least("x.length", "y.length"), classes)
    )).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
    for (start, threshold), end in zip(classes, [*(c[0] for c in classes[1:]), None]):
        here = sized if threshold <= SEGMENTED else few
        keys = many_keys if threshold > SEGMENTED else lambda line, t: (index_keys(line, t), probe_keys(line, t))
        index_of, probe_of = keys(F.col("line"), threshold)
        shorter = F.lit(True) if end is None else F.col("length") < end
        reach = F.lit(True) if end is None else F.col("length") < end + threshold
        index = here.where((F.col("length") >= start) & shorter).select(
            F.col("node").alias("x"), F.explode(index_of).alias("key"))
        probe = here.where((F.col("length") >= start) & reach).select(
            F.col("node").alias("y"), F.explode(probe_of).alias("key"))
        found = index.join(probe, "key").where("x <> y")
        links = links.union(found.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")))
    texts = (
        links.distinct().join(lines.select(F.col("node").alias("a"), F.col("line").alias("line_a")), "a")
        .join(lines.select(F.col("node").alias("b"), F.col("line").alias("line_b")), "b")
    )
    shorter, near = F.least(F.length("line_a"), F.length("line_b")), F.lit(False)
    for start, threshold in classes:
        near = F.when(shorter >= start, F.levenshtein("line_a", "line_b", threshold) >= 0).otherwise(near)
    return texts.where(near).select("a", "b")


def repeated_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int | tuple[tuple[int, int], ...] = THRESHOLD,
    least_chars: int = LEAST_CHARS, least_words: int | None = None, edit_words: int | None = None,
) -> DataFrame:
    """(id, version, dropped line numbers from 0, n_near of them whose own text occurs here first)."""
    classes = ((least_chars, threshold),) if isinstance(threshold, int) else threshold
    if any(start < max(least_chars, 2 * edits + 2) for start, edits in classes):
        raise ValueError("lines must be longer than the threshold allows to differ")
    if list(classes) != sorted(classes) or sorted(c[1] for c in classes) != [c[1] for c in classes]:
        raise ValueError("thresholds must grow with length")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("version"), F.posexplode(F.split(text, "\n")).alias("no", "line"))
    enough = F.length("line") >= least_chars
    if least_words is not None:
        enough = enough | (F.size(F.regexp_extract_all("line", F.lit(r"\S+"), F.lit(0))) >= least_words)
    rows = rows.where(enough)
    lines = staged(
        rows.where(F.length("line") >= least_chars).select("line").distinct()
        .select(F.xxhash64("line").alias("node"), "line", letter_counts(F.col("line")).alias("letters"))
    )
    links = near_links(lines, threshold) if isinstance(threshold, int) else near_links_by_length(lines, threshold)
    if edit_words is not None:
        links = links.union(word_links(lines, edit_words))
    links = staged(links)

    places = staged(rows.select(F.xxhash64("line").alias("node"), F.unhex(F.md5("line")).alias("line"), F.struct("id", "version", "no").alias("place")))
    firsts = staged(places.groupBy("node", "line").agg(F.min("place").alias("place"), F.count(F.lit(1)).alias("n")))
    linked = components(links).withColumnRenamed("id", "node").join(firsts, "node")
    keepers = linked.groupBy("component").agg(F.min("place").alias("keeper"))
    linked = staged(linked.join(keepers, "component").select("node", "line", "keeper", F.col("place").alias("own")))
    alone = firsts.where("n > 1").join(linked.select("node", "line"), ["node", "line"], "left_anti")
    classes = staged(
        linked.union(alone.select("node", "line", F.col("place").alias("keeper"), F.col("place").alias("own")))
    )
    dropped = places.join(classes, ["node", "line"]).where(~F.col("place").eqNullSafe(F.col("keeper")))
    # A document's own lines only.
    return dropped.groupBy(F.col("place.id").alias("id"), F.col("place.version").alias("version")).agg(
        F.sort_array(F.collect_set("place.no")).alias("dropped"),
        F.count_if(F.col("place").eqNullSafe(F.col("own"))).alias("n_near"),
    )


def line_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(id, n_lines, dropped, n_near) of every row."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("version"), F.size(F.split(text, "\n")).alias("n_lines"))
    found = repeated_lines(docs, id_col, text_col, **options)
    same = rows["id"].eqNullSafe(found["id"]) & (rows["version"] == found["version"])
    return rows.join(found, same, "left").select(
        rows["id"], F.col("n_lines").cast("long"), F.coalesce("dropped", F.array().cast("array<int>")).alias("dropped"),
        F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
    )


def without_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """`docs` with its columns, the dropped lines gone from the text; texts that lose none are as they were."""
    found = repeated_lines(docs, id_col, text_col, **options).select("id", "version", "dropped")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("row"), F.col(id_col).alias("key"), F.xxhash64(text).alias("hash"))
    joined = rows.join(found, F.col("key").eqNullSafe(F.col("id")) & (F.col("hash") == F.col("version")), "left")
    own = F.col("row")[text_col]
    kept = F.filter(F.split(F.coalesce(own.cast("string"), F.lit("")), "\n"), lambda line, i: ~F.array_contains("dropped", i))
    return joined.select(*[
        (F.when(F.col("dropped").isNull(), own).otherwise(F.array_join(kept, "\n")) if c == text_col else F.col("row")[c]).alias(c)
        for c in docs.columns
    ])
