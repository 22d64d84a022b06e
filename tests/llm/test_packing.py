import zlib
from collections import defaultdict
from itertools import product

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from rosterlens.llm.packing import TextEncoder, cheapest_cuts, packed, places, tokenizer

VOCABULARY = "byte_bpe_50k.json"
PARTS = ["a", "Word", " ", "  ", "\n", "\n\n", "\t", "'s", "don't", "ü", "日本", "🙂", "12", ".", "!?", "$$$", "\xa0", "\x1c", "\x85",
         "<|endoftext|>", "-", "_"]
encoder = TextEncoder(VOCABULARY)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=10).map("".join), min_size=1, max_size=4))
def test_ids_are_those_of_the_whole_text(texts):
    for text, (ids, ends) in zip(texts, encoder(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == tokenizer(VOCABULARY).encode(text, add_special_tokens=False).ids
        assert all(0 < e <= len(ids) // 4 for e in ends)


def test_signs_after_letters_and_marks_are_those_of_the_whole_text():
    texts = ["Wort, wort.wort é;\nLast.\n.x don't. a\x01b a. \x01. end<|endoftext|>. x|y |z", "\x01", "", "a.\nb., c", "ŝ. 日. a日. 2. a2.b"]
    for text, (ids, _) in zip(texts, encoder(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == tokenizer(VOCABULARY).encode(text, add_special_tokens=False).ids


def test_words_kept_by_a_worker_are_bounded():
    syllables = ["ba", "de", "fi", "go", "lu", "mar", "nes", "tik", "vor", "zul"]
    words = ["".join(w) for w in product(syllables, repeat=6)]
    one = TextEncoder(VOCABULARY)
    for i in range(0, 700_000, 50_000):
        list(one([" ".join(words[i : i + 50_000])]))
        assert sum(map(len, one.words.tables.values())) < 300_000


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 9), st.sampled_from([0, 2, 5])), min_size=1, max_size=12))
def test_cuts_are_the_cheapest(steps):
    size = 10
    at, cost, here = [], [], 0
    for length, price in steps:
        here += length
        at.append(here)
        cost.append(price)

    def price_of(cuts):
        begin = total = 0
        for c in cuts:
            if at[c] - begin > size:
                return None
            total += size - (at[c] - begin) + cost[c]
            begin = at[c]
        return total

    every = [[i for i in range(len(at) - 1) if mask >> i & 1] + [len(at) - 1] for mask in range(1 << (len(at) - 1))]
    assert price_of(cheapest_cuts(at, cost, size)) == min(p for p in map(price_of, every) if p is not None)


def test_places_leave_no_wide_gap():
    at, cost = places(1000, np.array([3, 700, 1000]), 128, 8, 32)
    assert np.diff(np.r_[0, at]).max() <= 128 and at[-1] == 1000 and cost[-1] == 0
    assert dict(zip(at.tolist(), cost.tolist()))[700] == 8


def check(df, pairs, size):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in df.collect():
        assert zlib.crc32(np.array(r["ids"], "<i4").tobytes()) == r.ids_crc32 and len(r["ids"]) == r.length
        by_doc[r.id].append(r)
        by_sequence[r.sequence_id].append(r)
    for pieces in by_sequence.values():
        offset = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == offset
            offset += r.length
        assert offset <= size
    for key, text in pairs:
        expected = [*tokenizer(VOCABULARY).encode(text or "", add_special_tokens=False).ids, 1]
        mine = sorted(by_doc[key], key=lambda r: r.start)
        assert [i for r in mine for i in r["ids"]] == expected
        assert {r.doc_tokens for r in mine} == {len(expected)}
    return by_sequence


def test_round_trip(odd, odd_pairs, none):
    single = [(i, t) for i, t in odd_pairs if i not in (None, 7)]
    by_sequence = check(packed(odd.where("doc_id <> 7"), size=64, block_tokens=1000), single, 64)
    filled = sum(r.length for pieces in by_sequence.values() for r in pieces)
    assert filled / (64 * len(by_sequence)) > 0.75
    assert packed(odd).groupBy("id").count().count() == 13
    assert packed(none).count() == 0


def test_little_padding(make):
    pairs = [(i, "A short sentence here. " * (1 + i % 90)) for i in range(300)]
    by_sequence = check(packed(make(pairs).coalesce(1), block_tokens=20_000), pairs, 2048)
    filled = sum(r.length for pieces in by_sequence.values() for r in pieces)
    assert filled / (2048 * len(by_sequence)) > 0.95
