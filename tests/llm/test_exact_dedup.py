from collections import defaultdict
from hashlib import sha256

from rosterlens.llm.exact_dedup import RadixTrie, Subtrees, exact_groups, folded


def brute(pairs, choose):
    groups = defaultdict(list)
    for i, t in pairs:
        groups[folded(t)].append(i)
    out = []
    for content, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = choose(known) if known else None
        out += [(i, keep, len(ids), sha256(content).digest()) for i in ids]
    return out


def rows(df):
    key = lambda r: (r[0] is None, r[0] or 0, r[3])
    return sorted(((r.id, r.keep_id, r.group_size, bytes(r.sha)) for r in df.collect()), key=key)


def test_same_as_brute_force(odd, odd_pairs, make):
    key = lambda r: (r[0] is None, r[0] or 0, r[3])
    assert rows(exact_groups(odd, largest=True)) == sorted(brute(odd_pairs, max), key=key)
    pairs = [(i, t) for i, t in enumerate(["Abc", "aBC", "äbc", "Äbc", "abc ", "abd", "ab", "İ", "i̇"] * 3)]
    assert rows(exact_groups(make(pairs))) == sorted(brute(pairs, min), key=key)


def test_hot_group_and_empty_table(make, none):
    got = rows(exact_groups(make([(i, "hot" if i % 3 else f"t{i}") for i in range(900)]), largest=True))
    assert {r[1:3] for r in got if r[0] % 3} == {(899, 600)}
    assert exact_groups(none).count() == 0


def test_trie_keeps_what_it_is_given():
    trie = RadixTrie()
    words = [b"", b"a", b"ab", b"abc", b"abd", b"b", b"abcabc", bytes(1000), bytes(999)]
    for w in words + words:
        node = trie.node(w)
        node.terminal = [w, (node.terminal or [0, 0])[1] + 1]
    assert sorted((content, *terminal) for content, terminal in trie.terminals()) == sorted((w, w, 2) for w in words)


def test_texts_that_share_a_hash_are_told_apart_by_the_trie(odd, odd_pairs, make):
    def few_hashes(content):
        return (len(content) % 2) - 1

    key = lambda r: (r[0] is None, r[0] or 0, r[3])
    pairs = [(i, f"text {i % 50:02}" if i % 4 else "other " + "abc"[i % 3]) for i in range(400)]
    for held in (48 << 20, 2000):
        assert rows(exact_groups(make(pairs), hash_of=few_hashes, held_bytes=held)) == sorted(brute(pairs, min), key=key)
    assert rows(exact_groups(odd, largest=True, hash_of=few_hashes)) == sorted(brute(odd_pairs, max), key=key)


def test_one_trie_holds_texts_that_share_a_prefix():
    trees = Subtrees(False)
    for text in (b"same start, one", b"same start, two", b"same start, one"):
        trees.add((len(text), 7), text, 1, 1)
    [trie] = trees.tries.values()
    [(run, child)] = trie.edges.values()
    assert run == b"same start, " and len(child.edges) == 2
    assert sorted((c, t) for _, c, t in trees.finished()) == [(b"same start, one", [1, 2]), (b"same start, two", [1, 1])]
    assert trees.held == 0


def test_tries_are_handed_on_when_they_are_full(make):
    """Small tries, so that most texts are handed on several times: the same result."""
    key = lambda r: (r[0] is None, r[0] or 0, r[3])
    pairs = [(i, f"text {(i * 7) % 90}" * (i % 5)) for i in range(600)]
    assert rows(exact_groups(make(pairs), held_bytes=1500, prefix_bits=1)) == sorted(brute(pairs, min), key=key)
