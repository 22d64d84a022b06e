import re

import pytest

from rosterlens.llm.decontaminate import Windows, contamination, words

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def tokens(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, items, size=10):
    out = {}
    for i, text in docs:
        w, hit, found = tokens(text), set(), set()
        for item, passage in items:
            b = tokens(passage)
            n = min(len(b), size)
            for s in range(len(b) - n + 1 if n else 0):
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == b[s : s + n]:
                        hit.update(range(p, p + n))
                        found.add(str(item) if item is not None else "null")
        out[i] = (len(w), len(hit), sorted(found))
    return out


def run(docs, bench, **more):
    found = contamination(docs, bench, **more)
    return {r.row.doc_id: (r.n_words, r.n_hit, sorted(r["items"])) for r in found.collect()}


PASSAGE = "The quick-brown fox jumps over 13 lazy dogs in Łódź while reading a long book about benchmarks."
ITEMS = [(1, PASSAGE), (2, "tiny item"), (3, ""), (4, None), (None, "solo"), (1, PASSAGE), (5, PASSAGE.upper()), (6, "a a a a a a a a a a a a")]
TEXTS = [
    PASSAGE, "x " + PASSAGE[:60] + " and on", f"before {PASSAGE} {PASSAGE} after", None, "", "a tiny, ITEM here", "Solo!",
    "the quick brown fox jumps over 13 lazy dogs", "a " * 30, "nothing of that kind", "...", PASSAGE.replace("ó", "o"),
]


@pytest.fixture
def bench(spark):
    return spark.createDataFrame(ITEMS, "item_id long, text string")


def test_same_as_brute_force(make, bench):
    docs = list(enumerate(TEXTS))
    expected = brute(docs, ITEMS)
    assert expected[0][1] > 10 and run(make(docs), bench) == expected


def test_many_blocks_are_one_benchmark(make, bench):
    docs = list(enumerate(TEXTS))
    assert run(make(docs), bench, block_bytes=60) == brute(docs, ITEMS)


def test_runs_name_the_words_hit(make, bench):
    row = contamination(make([(1, f"one two {PASSAGE} three")]), bench).first()
    assert [(r.start, r.end) for r in row.runs] == [(2, 2 + len(tokens(PASSAGE)))]


def test_odd_rows(odd, odd_pairs, none, bench, spark):
    found = contamination(odd, bench)
    assert found.count() == len(odd_pairs)
    assert found.select("row.*").schema.names == odd.schema.names
    assert contamination(none, bench).count() == 0
    assert run(odd.where("doc_id < 5"), spark.createDataFrame([], bench.schema))[1] == (10, 0, [])


def test_words_and_windows():
    assert words("Ab-c9 É.ñ") == ["ab".encode(), b"c9", "É".encode(), "ñ".encode()]
    w = Windows([("1", "a b c"), ("2", "b c")], 2)
    assert sorted(map(tuple, w.owners)) == [("1",), ("1", "2")]
