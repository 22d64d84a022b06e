import random
from collections import defaultdict

import numpy as np

from .conftest import prose
from rosterlens.llm.common import components
from rosterlens.llm.minhash import BITS, MARKS, MINIMA, WordHashes, _marks, buckets, estimate, minima, near_groups, packed_bits, shingle_set, words


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def brute(pairs):
    sets = [shingles(t) for _, t in pairs]
    root = list(range(len(pairs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(pairs)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if shared and 100 * shared >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = defaultdict(lambda: None)
    for i, (key, _) in enumerate(pairs):
        r = find(i)
        if key is not None:
            least[r] = key if least[r] is None else min(least[r], key)
    return sorted((str(k), len(sets[i]), str(least[find(i)])) for i, (k, _) in enumerate(pairs))


def rows(df):
    return sorted((str(r.id), r.n_shingles, str(r.component)) for r in df.collect())


def altered(text, n, seed):
    random.seed(seed)
    w = text.split()
    for _ in range(n):
        w[random.randrange(len(w))] = f"new{random.randrange(10**6)}"
    return " ".join(w)


def test_same_as_brute_force(make, odd, odd_pairs):
    assert rows(near_groups(odd)) == brute(odd_pairs)
    base = [prose(s, 150) for s in range(3)]
    texts = []
    for b, text in enumerate(base):
        texts += [altered(text, n, 100 * b + k) for k, n in enumerate([0, 0, 1, 2, 3, 3, 4, 5, 6, 7, 8, 10, 14])]
    texts += [base[0].upper(), base[1] + " tail", "a b c d", "A  B c\td", "a b c", "", None]
    pairs = [(1000 - i, t) for i, t in enumerate(texts)]
    assert rows(near_groups(make(pairs))) == brute(pairs)


def test_group_of_copies_around_a_centre(make):
    """Copies that are close to what they were made of, not to each other; the centre has the largest id."""
    centre = prose(9, 140)
    pairs = [(i, altered(centre, 5, i)) for i in range(80)] + [(999, centre)] + [(500 + i, centre) for i in range(40)]
    assert rows(near_groups(make(pairs))) == brute(pairs)


def test_no_rows(none, make):
    assert near_groups(none).count() == 0
    assert rows(near_groups(make([(1, "all alone here in this text")]))) == [("1", 2, "1")]


def test_repeated_ids_with_other_texts(make):
    text = prose(3, 50)
    got = near_groups(make([(5, text), (5, prose(4, 50)), (2, text + " more")])).collect()
    assert sorted((r.id, r.component) for r in got) == [(2, 2), (5, 2), (5, 5)]


def test_estimate_is_near_the_truth(spark):
    random.seed(1)
    a, b = prose(1, 400), None
    b = altered(a, 20, 2)
    hashes = WordHashes()
    sets = [shingle_set(words(t), hashes) for t in (a, b)]
    least = minima(sets)
    assert least.shape == (2, MINIMA) and buckets(least).shape == (2, 32)
    bits = packed_bits(least)
    assert bits.shape == (2, MINIMA * BITS // 64)
    df = spark.createDataFrame([(bits[0].tolist(), bits[1].tolist())], "a array<long>, b array<long>")
    truth = len(np.intersect1d(*sets)) / len(np.union1d(*sets))
    assert abs(df.select(estimate(df["a"], df["b"])).first()[0] - truth) < 0.2


def test_components_of_chains_and_stars(spark):
    random.seed(0)
    nodes = random.sample(range(10**6), 120)
    edges = [(nodes[i], nodes[i + 1]) for i in range(60)] + [(nodes[70], n) for n in nodes[71:]] + [(nodes[0], nodes[0])]
    random.shuffle(edges)
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: min(nodes[:61]) for n in nodes[:61]} | {n: min(nodes[70:]) for n in nodes[70:]}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_marks_are_those_of_the_nodes(spark):
    nodes = [0, 1, 7, 8, 32767, 32768, -1, -(2**63), 2**63 - 1, MARKS + 5]
    marks = _marks(spark.createDataFrame([(n,) for n in nodes], "node long"))
    assert np.flatnonzero(np.unpackbits(marks, bitorder="little")).tolist() == sorted({n & (MARKS - 1) for n in nodes})
