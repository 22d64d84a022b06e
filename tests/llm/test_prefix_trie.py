"""The trie of conversations against one built node by node."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from rosterlens.llm import prefix_trie as trie
from rosterlens.llm.prefix_trie import conversation_trie, numbered_turns, segments

SCHEMA = "conv_id long, turn long, role string, text string, d long, words string, name string"


def rebuilt(rows):
    turns = defaultdict(list)
    for c, no, role, text in rows:
        if c is not None:
            turns[c].append(((no is not None, no or 0), role or "", text or ""))
    own = {c: [t[1:] for t in sorted(ts)] for c, ts in turns.items()}
    out = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - int(np.fmod(c, 20))
        out[c] = own.get(base, [])[:h] + ts[h:]
    return out


def plain(rows):
    sequences = rebuilt(rows)
    members = defaultdict(list)
    for c, s in sequences.items():
        for d in range(len(s) + 1):
            members[d, tuple(s[:d])].append(c)
    out = []
    for (d, prefix), convs in members.items():
        below = [(k, m) for k, m in members.items() if k[0] >= d and k[1][:d] == prefix]
        children = [k for k, _ in below if k[0] == d + 1]
        leaves = sum(not any(k[0] == d2 + 1 and k[1][:d2] == p2 for k, _ in below) for (d2, p2), _ in below)
        saved = sum((len(m) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", k[1][-1][1])) for k, m in below if k[0])
        ends = sorted(c for c in convs if len(sequences[c]) == d)
        out.append((
            min(convs), d, min(members[d - 1, prefix[:-1]]) if d else None, len(convs), len(children), leaves, saved,
            hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def got(spark, rows, parts=5):
    df = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], SCHEMA).repartition(parts)
    return sorted(map(tuple, conversation_trie(df).collect()), key=str)


ODD = [
    (None, 1, "user", "no conversation"), (7, None, None, None), (7, 1, "user", "hi there"), (7, 1, "user", "hi there"), (7, 1, "bot", "tie"),
    (-3, 2, "user", ""), (-3, 1, "user", " \t "), (-20, 1, "user", "base of negatives"), (0, 0, "user", "zero"), (0, 5, "bot", "one  two\nthree"),
    (1, 0, "user", "zero"), (2, 0, "u", "serzero"), (3, 0, "us", "erzero"), (45, 0, "user", "no base"), (46, 3, "user", "no base"),
    (2**62, 1, "user", "x"), (60, None, "user", "é 🙂"), (61, 9, "a", "b"), (62, 9, "a", "b"), (63, 9, "a", "b"), (64, 9, "a", "b"),
]


def made(seed, n, most=9):
    rng = np.random.default_rng(seed)
    rows = []
    for c in rng.choice(n * 2, n, replace=False).tolist():
        for no in range(rng.integers(1, most)):
            rows.append((c, no, "user" if no % 2 == 0 else "bot", str(rng.choice(["yes", "no", "go on now"]))))
    return rows


@pytest.mark.parametrize("rows", [ODD, made(1, 150), ODD + made(2, 60, 20), [(5, i, "r", f"t{i}") for i in range(70)], [(21, 0, "r", "t")]])
def test_against_a_trie_built_node_by_node(spark, rows):
    assert got(spark, rows) == plain(rows)


def test_no_rows(spark):
    assert got(spark, [], 1) == []


def test_turnless_conversation_is_a_member_of_the_root(spark):
    c = next(c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4 == 3)
    rows = [(c, 0, "r", "t"), (c, 1, "r", "t")]
    assert got(spark, rows) == plain(rows) == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


def test_one_conversation_over_many_ranges(spark):
    rows = [(40, i % 300 if i % 3 else None, "r", f"t{i}") for i in range(1000)] + [(c, 0, "r", "a") for c in (3, 39, 41, 90)]
    df = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], SCHEMA).repartition(4)
    turns = numbered_turns(df)
    found = turns.where("conv = 40").select("i").collect()
    assert sorted(r.i for r in found) == list(range(1, 1001))
    wide = 3 * max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))) // 4
    spread = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        in_parts = numbered_turns(df)
        assert sorted(r.i for r in in_parts.where("conv = 40").collect()) == list(range(1, 1001))
        ordered = in_parts.where("conv = 40").orderBy("i").select("turn").collect()
        assert ordered == turns.where("conv = 40").orderBy("i").select("turn").collect()
        assert wide >= 1
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", spread)
    expected = [(no is not None, no or 0, f"r\0{text}") for _, no, _, text in rows[:1000]]
    digests = [hashlib.md5(b"1:" + t[2].replace("\0", "").encode()).digest() for t in sorted(expected)]
    assert [bytes(r.turn) for r in ordered] == digests


def test_segments_are_told_apart_by_order(spark):
    def of(texts):
        rows = [(1, i + 1, t.encode(), 1, len(texts)) for i, t in enumerate(texts)]
        df = spark.createDataFrame(rows, "conv long, d long, turn binary, words long, len long")
        return {(r.d, r.one, r.two) for r in segments(df).collect()}

    a, b = of(["x", "y", "x", "y"]), of(["y", "x", "x", "y"])
    assert {d for d, *_ in a} == {1, 2, 3, 4}
    assert {d for d, *_ in a - b} == {1, 2, 4}
    assert not {d for d, *_ in a & b} & {1, 2, 4}


def test_ends_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(trie, "CHUNK_CHARS", 10)
    rows = [(c, 0, "r", "same") for c in range(1, 400) if zlib.crc32(str(c).encode()) % 4 == 0]
    assert got(spark, rows) == plain(rows)
