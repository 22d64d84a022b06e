"""Divergence of sources against plain loops over all terms."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from rosterlens.llm import source_audit
from rosterlens.llm.source_audit import merged_stripes, source_divergence

TERMS = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def plain(docs, least, best):
    rows = [tuple(x or "" for x in d) for d in docs]
    df, groups, langs = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        terms = TERMS.findall(lowered(text))
        df[lang].update(set(terms))
        groups[lang, source].update(terms)
        langs[lang].update(terms)
    out = []
    for (lang, source), counts in groups.items():
        kept = [t for t, n in df[lang].items() if n >= least]

        def shares(c):
            total = sum(c[t] for t in kept) + 2 * len(kept)
            return {t: 1 + 10**9 * (c[t] + 2) // total for t in kept}

        p, q = shares(counts), shares(langs[lang])
        found = [("pair", other, sum((p[t] - r[t]) ** 2 // (p[t] + r[t]) for t in kept))
                 for (l, other), c in groups.items() if l == lang and other != source for r in [shares(c)]]
        found.sort(key=lambda x: (-x[2], x[1].encode()))
        terms = [("term", t, (p[t] - q[t]) ** 2 // (p[t] + q[t])) for t in kept if counts[t] and p[t] > q[t]]
        terms.sort(key=lambda x: (-x[2], x[1].encode()))
        for some in (found, terms[:best]):
            out += [(lang, source, *row, rank) for rank, row in enumerate(some, 1)]
    return sorted(out)


def made(n, sources, seed=0):
    rng = np.random.default_rng(seed)
    words = [f"Wörd{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(150)] + ["THE", "of", "日本", "x_y", "a1b"]
    docs = []
    for _ in range(n):
        source = sources[min(rng.geometric(0.3) - 1, len(sources) - 1)]
        lang = ["en", "de", None][rng.integers(0, 3)]
        some = rng.choice(len(words), rng.integers(0, 40), p=(w := 1 / np.arange(2, len(words) + 2)) / w.sum())
        docs.append((lang, source, " ".join(words[i] for i in some)))
    return docs + [("en", "quiet", None), ("en", "quiet", ""), ("xx", "alone", "once"), ("yy", "a", "one"), ("yy", "b", "two"), (None, None, None)]


@pytest.mark.parametrize("held", [source_audit.HELD_BYTES, 2000])
def test_against_plain_loops(spark, held):
    docs = made(400, ["a", "b", "ß", None, "c", "z"])
    df = spark.createDataFrame(docs, "lang string, source string, text string").repartition(5)
    df = df.selectExpr("*", "1 AS term", "2 AS value", "3 AS p")
    got = sorted(map(tuple, source_divergence(df, least_docs=4, best=5, held_bytes=held).select(
        "lang", "source", "part", "item", "value", "rank").collect()))
    assert got == plain(docs, 4, 5)


def test_many_sources_and_spilled_sums(spark, monkeypatch):
    monkeypatch.setattr(source_audit, "PAIRS", 50)
    docs = [("en", f"s{i % 300:03}", "the of " + "word " * (i % 7)) for i in range(900)]
    df = spark.createDataFrame(docs, "lang string, source string, text string").repartition(3)
    got = source_divergence(df).select("lang", "source", "part", "item", "value", "rank")
    assert sorted(map(tuple, got.collect())) == plain(docs, 10, 10)


def test_pair_sums_hold_little(monkeypatch):
    monkeypatch.setattr(source_audit, "PAIRS", 100)
    sums, expected = source_audit.PairSums(), Counter()
    rng = np.random.default_rng(2)
    for _ in range(100):
        a, b, v = rng.integers(0, 5, 30), rng.integers(5, 9, 30), rng.integers(-(10**17), 10**17, 30)
        sums.add(b, a, v)
        for key, value in zip(zip(a.tolist(), b.tolist()), v.tolist()):
            expected[key] += value
        assert sums.n <= 230
    sums.compress()
    assert {(k >> 31, k & (2**31 - 1)): v for k, v in zip(sums.keys[0].tolist(), sums.values[0].tolist())} == expected


def test_one_cell_per_term_and_task(spark):
    """A very frequent word travels once per task, and stripes are spilled in bounded parts."""
    docs = [("en", "a", "the " * 50 + f"w{chr(97 + i % 26)}") for i in range(400)]
    df = spark.createDataFrame(docs, "lang string, source string, text string").repartition(4)
    for held, most in ((source_audit.HELD_BYTES, 4), (100, 400)):
        spilled = df.mapInArrow(source_audit._fold(held), source_audit.CELLS_SQL).where("term = 'the'")
        assert spilled.count() <= most
        assert spilled.selectExpr("sum(n)", "sum(docs)").first() == (20_000, 400)
    assert merged_stripes(df).where("term = 'the'").first()[2:] == ("a", 20_000, 20_000, True)
    long = spark.createDataFrame([("en", "a", "é" * 2_000_000)] * 10, "lang string, source string, text string")
    assert merged_stripes(long).selectExpr("length(term) AS n").collect() == [(2_000_000,)]


def test_a_hot_stripe_is_folded_as_it_comes(monkeypatch):
    """A key with very many spilled cells is merged in bounded parts."""
    import pyarrow as pa

    monkeypatch.setattr(source_audit, "BATCH", 8)

    def batches():
        for i in range(200):
            yield pa.record_batch({
                "lang": ["en"] * 5, "term": ["the"] * 4 + ["thf" if i == 199 else "the"], "source": [f"s{(i + j) % 3}" for j in range(5)],
                "n": [1] * 5, "docs": [1] * 5})

    [out] = list(source_audit._merge(10)(batches()))
    got = {r["source"]: r for r in out.to_pylist()}
    assert set(got) == {"s0", "s1", "s2"} and sum(r["n"] for r in got.values()) == 999
    assert {r["n_lang"] for r in got.values()} == {999} and sum(r["first"] for r in got.values()) == 1


def test_empty(spark):
    assert source_divergence(spark.createDataFrame([], "lang string, source string, text string")).collect() == []
