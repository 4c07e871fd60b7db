import hashlib
from collections import defaultdict

import numpy as np
from hypothesis import given
from hypothesis import strategies as st

from page_fixtures import hard, pages, with_clashes  # noqa: F401
from leafscribe.llm.exact import exact_copies, golomb, golomb_values


@given(st.lists(st.integers(0, 2**64 - 1), unique=True, max_size=300), st.integers(0, 56))
def test_golomb_round_trip(values, shift):
    sent = np.unique(np.array(values, np.uint64) >> np.uint64(shift))
    assert golomb_values(golomb(sent)).tolist() == sent.tolist()


def test_golomb_is_smaller():
    values = np.unique(np.random.default_rng(1).integers(0, 2**63, 100_000).astype(np.uint64))
    assert len(golomb(values)) < 0.8 * values.nbytes


def expected(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[text or ""].append(doc_id)
    out = []
    for doc_id, text in rows:
        ids = groups[text or ""]
        keep = max((i for i in ids if i is not None), default=None)
        out.append((doc_id, keep, len(ids), doc_id == keep, hashlib.sha256((text or "").encode()).hexdigest()))
    return sorted(out, key=str)


def result(df):
    return sorted(map(tuple, df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=str)


def test_hard_rows(pages, hard, with_clashes):
    ids = [None, 5, 5, *range(7, 7 + len(hard) - 3)]
    df = pages(hard, ids)
    assert result(exact_copies(with_clashes(df))) == expected(list(zip(ids, hard)))
    # Tiny senders and owners give the same groups.
    assert result(exact_copies(df.repartition(3), sender_rows=1, owner_rows=2)) == expected(list(zip(ids, hard)))


def test_one_text_holds_most_rows(pages):
    texts = [f"page {i}" if i % 3 == 0 else "Blank page" for i in range(300)]
    assert result(exact_copies(pages(texts).repartition(5))) == expected(list(enumerate(texts, 1)))


def test_no_pages(pages):
    assert exact_copies(pages([])).collect() == []
