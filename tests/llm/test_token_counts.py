from hypothesis import given, settings
from hypothesis import strategies as st

from rosterlens.llm import token_counts as tc

MODEL = "piece_bpe_32k.model"
PARTS = ["a", "Word", " ", "  ", "\n", "\t", "▁", "<s>", "ü", "日本", "🙂", "12", ".", "\xa0", "　", "'s"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=14).map("".join) | st.text(max_size=20))
def test_count_is_that_of_the_whole_text(text):
    text = text.encode("utf-8", "ignore").decode()
    sp, apart = tc.processor(MODEL)
    assert tc.count_text(text, tc.Lengths(MODEL, {}), apart) == len(sp.encode(text))


def test_rows(odd, odd_pairs, none):
    sp, _ = tc.processor(MODEL)
    got = sorted((str(r.id), r.n_bytes, r.n_tokens) for r in tc.token_counts(odd, table_size=5, task_top=3).collect())
    assert got == sorted((str(i), len((t or "").encode()), len(sp.encode(t or ""))) for i, t in odd_pairs)
    assert tc.token_counts(none).count() == 0


def test_full_cache_starts_anew(monkeypatch):
    monkeypatch.setattr(tc, "CACHE_ENTRIES", 3)
    sp, apart = tc.processor(MODEL)
    lengths = tc.Lengths(MODEL, {"of": 1})
    text = " ".join(f"word{i} of" for i in range(50))
    assert tc.count_text(text, lengths, apart) == len(sp.encode(text))
    assert len(lengths) <= 6


def test_long_parts_are_not_counted_for_the_table(make, monkeypatch):
    seen = []
    monkeypatch.setattr(tc, "processor", lambda model: (type("P", (), {"encode": lambda self, t: seen.append(t) or [t]})(), True))
    docs = make([(i, "日" * 65 + " short " + "x" * 64) for i in range(3)])
    assert set(tc.frequent_lengths(docs, "text", MODEL, 9, 9)) == {"short", "x" * 64}
    assert set(tc.frequent_lengths(make([(1, "日" * 65 + " a")]), "text", MODEL, 1, 1)) == {"a"}
