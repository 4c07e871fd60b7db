import hashlib
from collections import Counter

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from page_fixtures import hard, pages, with_clashes  # noqa: F401
from leafscribe.llm.passages import without_repeats


def expected(texts, window):
    cut = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in cut for i in range(len(w) - window + 1))
    out = []
    for w in cut:
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((len(w), len(gone), hashlib.sha256(kept).hexdigest(), kept.decode()))
    return out


def run(df, window, **more):
    rows = sorted(without_repeats(df, window, **more).collect(), key=lambda r: str(r))
    return sorted((r.n_words, r.n_removed, r.kept_sha256, r.kept_text) for r in rows)


def test_hard_rows(pages, hard, with_clashes):
    ids = [None, 5, 5, *range(7, 7 + len(hard) - 3)]
    assert run(with_clashes(pages(hard, ids).repartition(3), "node", "edges"), 4) == sorted(expected(hard, 4))


def test_passage_in_many_pages(pages):
    formula = " ".join(f"ord{i}" for i in range(40))
    texts = [f"a{i} b{i} {formula} c{i} d{i}" if i % 3 else f"e{i} " * 50 for i in range(200)]
    assert run(pages(texts).repartition(7), 35) == sorted(expected(texts, 35))


def test_no_pages(pages):
    assert without_repeats(pages([])).collect() == []


word = st.sampled_from("a b c d e f g".split())
text = st.lists(word, max_size=30).map(" ".join)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(text, min_size=1, max_size=25), st.integers(1, 7), st.integers(1, 4))
def test_any_texts(pages, texts, window, kmer):
    assert run(pages(texts), window, kmer=kmer) == sorted(expected(texts, window))
