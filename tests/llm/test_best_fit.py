"""Packing by matching and best fit: bins against plain best fit over pieces, ids against the tokenizer, whole rows."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from rosterlens.llm import best_fit
from rosterlens.llm.best_fit import Lookup, SpacedIds, best_fit_packed, bins_of

TOKENIZER = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def expand(counts, size):
    lookup = Lookup(bins_of(counts, size))
    bins = defaultdict(list)
    for length, n in counts.items():
        if n:
            places = lookup(np.full(n, length), np.arange(n))
            for b, offset in zip(*map(np.ndarray.tolist, places)):
                bins[b].append((offset, length))
    return {b: sorted(rows) for b, rows in bins.items()}


def plain(counts, size):
    """The same rules piece by piece: gaps of the bins."""
    pieces = sorted((s for s, n in counts.items() for _ in range(n)), reverse=True)
    large, gaps = [s for s in pieces if 3 * s > size], []
    while large:
        a = large.pop(0)
        beside = next((b for b in large if a + b <= size), 0)
        if beside:
            large.remove(beside)
        gaps.append(size - a - beside)
    for s in (s for s in pieces if 3 * s <= size):
        fits = [g for g in gaps if g >= s]
        if fits:
            gaps.remove(min(fits))
        gaps.append((min(fits) if fits else size) - s)
    return sorted(gaps)


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 24), st.integers(0, 12), max_size=16))
def test_bins_are_those_of_plain_best_fit(counts):
    bins = expand(counts, 24)
    for rows in bins.values():
        at = 0
        for offset, length in rows:
            assert offset == at
            at += length
        assert at <= 24
    assert sorted(24 - sum(n for _, n in rows) for rows in bins.values()) == plain(counts, 24)
    assert sorted(bins) == list(range(len(bins)))


def test_large_counts_need_few_moves():
    rng = np.random.default_rng(3)
    counts = {s: int(n) for s, n in enumerate(rng.integers(1, 10**9, 4096), 1)}
    moves = bins_of(counts, 4096)
    assert len(moves) < 100_000
    taken = defaultdict(int)
    for m in moves:
        taken[m.length] += m.n
    assert taken == counts


ODD = [
    "plain words, in a row.", "", " ", "\n\n a\t b\x1c c\x85d  e", "don't we'll I'VE", "ÄÖÜ straße ΣΑΣ ΟΔΟΣ", "é ́e ́",
    "12 345,678", "a <|endoftext|> b <|startoftext|>c", "<| x |>", "日本語 の テキスト", "x" * 5000, " nb sp", "🙂🙂 🙂",
]


@pytest.mark.parametrize("limit", [best_fit.KEPT_BYTES, 300])
def test_ids_are_those_of_whole_texts(monkeypatch, limit):
    monkeypatch.setattr(best_fit, "KEPT_BYTES", limit)
    encode = SpacedIds("word_bpe_49k.json")
    rng = np.random.default_rng(1)
    letters = list("ab cé\n\t'Σ1,ß́ ŉẞs.!T:")
    texts = ODD + ["".join(rng.choice(letters, rng.integers(0, 60))) for _ in range(3000)]
    for start in range(0, len(texts), 50):
        some = texts[start : start + 50]
        for text, ids in zip(some, encode(pa.array(some)), strict=True):
            assert ids.tolist() == TOKENIZER.encode(text, add_special_tokens=False).ids, text
    assert all(len(w) <= best_fit.KEPT_CHARS for w in encode.table)


def test_words_kept_are_bounded_by_bytes(monkeypatch):
    monkeypatch.setattr(best_fit, "KEPT_BYTES", 1 << 20)
    encode = SpacedIds("word_bpe_49k.json")
    for i in range(40):
        list(encode(pa.array([" ".join(f"w{i}x{j}" for j in range(1000))])))
        assert encode.held < (1 << 20) + 1000 * 400


def check(docs, packed, size):
    """Every id of every document once, in order; sequences without gaps, not longer than `size`."""
    rows = packed.collect()
    places = defaultdict(list)
    got = defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
        got[r.id].append(r)
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= size
    expected = defaultdict(list)
    for key, text in docs:
        ids = TOKENIZER.encode(text or "", add_special_tokens=False).ids + [1]
        for piece, at in enumerate(range(0, len(ids), size)):
            part = ids[at : at + size]
            expected[key].append((piece, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), part))
    assert {k: sorted((r.piece, r.start, r.length, r.ids_crc32, list(r.ids)) for r in v) for k, v in got.items()} == {
        k: sorted(v) for k, v in expected.items()
    }
    return len(places)


def test_rows_of_odd_tables(spark):
    rng = np.random.default_rng(7)
    docs = [(i, " ".join(rng.choice(["a", "of", "thing", "Zebra"], rng.integers(0, 70)))) for i in range(120)]
    docs += [(None, "null id"), (5, docs[5][1]), (200, None), (201, ""), (202, "long " * 999)] + [(300 + i, t) for i, t in enumerate(ODD)]
    df = spark.createDataFrame([(k, t, "x", 1) for k, t in docs], "doc_id long, text string, length string, rank int").repartition(7)
    n = check(docs, best_fit_packed(df, size=32), 32)
    total = sum(len(TOKENIZER.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in docs)
    assert n <= 1.03 * total / 32 + 1
    assert best_fit_packed(df.limit(0)).count() == 0


def test_one_length_in_every_task(spark):
    docs = [(i, "of of") for i in range(1000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(9)
    assert check(docs, best_fit_packed(df, size=8), 8) == 500
