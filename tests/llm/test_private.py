import hashlib
import itertools
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from page_fixtures import hard, pages, with_clashes  # noqa: F401
import numpy as np
import pytest

from leafscribe.llm import private
from leafscribe.llm.private import Field, base_spans, learn_shapes, private_data

PATTERNS = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
]


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def expected(text):
    def right(kind, m):
        digits = "".join(c for c in m if c.isdigit())
        if kind == 1:
            return all(int(p) <= 255 for p in m.split("."))
        if kind == 2:
            return 13 <= len(digits) <= 19 and luhn(digits)
        return kind == 0 or 9 <= len(digits) <= 15

    return [[m.span() for m in re.finditer(p, text) if right(k, m.group())] for k, p in enumerate(PATTERNS)]


@settings(max_examples=1500)
@given(st.text("a@.1290+- ()%_é", max_size=40))
def test_base_is_the_patterns(text):
    assert base_spans(text) == expected(text)


@given(st.text("0123456789 -", min_size=12, max_size=30))
def test_cards(text):
    assert base_spans(text) == expected(text)


def test_long_texts_take_linear_time():
    for text in ["a" * 300_000 + "@", "1" * 300_000, "1." * 150_000, "+1" + "(" * 300_000, "@a" * 100_000]:
        base_spans(text)
        private._tokens(text)
    assert private._tokens("x" * 3_000_000) == []


@given(st.text("a@.1 \t\u2003\x1c\x85é(", max_size=30))
def test_tokens_hold_a_digit_or_at(text):
    want = []
    for token in re.finditer(r"\S+", text):
        own = token.group()
        kept = own.strip(private._EDGE)
        if kept and re.search("[0-9@]", own):
            start = token.start() + len(own) - len(own.lstrip(private._EDGE))
            want.append((start, start + len(kept)))
    assert private._tokens(text) == want


def test_field_makes_repeated_tokens_agree():
    """A number without country code is only found because the same digits stand elsewhere with it."""
    text = "Call +46812345678 now; " + "ord " * 50 + "again 46812345678 and 17"
    added = Field().added(text, base_spans(text))
    assert [[text[s:e] for s, e in own] for own in added] == [[], [], [], ["46812345678"]]
    other = text.replace("again 46812345678", "again 46812345679")
    assert Field().added(other, base_spans(other)) == [[], [], [], []]


def exact_marginals(field, text, tokens, labels):
    """Sums over all labellings."""
    own = [text[s:e] for s, e in tokens]
    unary = np.array([field.shapes[private.bucket(private.shape(t))] for t in own], float)
    for i, label in enumerate(labels):
        unary[i, label] += private.MATCHED * (label > 0)
    kinds, total = unary.shape[1], np.zeros(unary.shape)
    for given_labels in itertools.product(range(kinds), repeat=len(own)):
        weight = sum(unary[i, k] for i, k in enumerate(given_labels))
        weight += private.CHAIN * sum(a == b for a, b in itertools.pairwise(given_labels))
        last = {}
        for i, t in enumerate(own):
            key = private._same(t)
            if key in last:
                weight += private.SKIP * (given_labels[last[key]] == given_labels[i])
            last[key] = i
        for i, k in enumerate(given_labels):
            total[i, k] += np.exp(weight)
    return total / total.sum(axis=1, keepdims=True)


@pytest.mark.parametrize(
    "text, off",
    [
        ("7 a.b@c.se 19", 0.001),
        ("1 22 10.0.0.1 333 4444 5", 0.001),
        ("+46812345678 x1 46812345678", 0.02),
        ("a.b@c.se 1 2 a.b@c.se_ 3 A.B@C.SE", 0.02),
    ],
)
def test_messages_give_the_marginals(text, off):
    counts = np.zeros((private.BUCKETS, 5))
    counts[private.bucket(private.shape("a.b@c.se"))] = [1, 30, 0, 0, 0]
    counts[private.bucket("0")] = [40, 0, 0, 1, 2]
    field, tokens = Field(counts), private._tokens(text)
    labels = private._labels(tokens, base_spans(text))
    found = field.marginals(text, tokens, labels)
    assert np.abs(found - exact_marginals(field, text, tokens, labels)).max() < off


def test_shapes_of_all_pages_count(pages):
    texts = ["a.b@c.se 12", "12 c.d@e.se 12", None, ""] * 700 + ["x1;"]
    field = learn_shapes(pages(texts, ids=[1] * len(texts)))
    seen = np.flatnonzero((field.shapes != Field().shapes).any(axis=1))
    assert set(seen) == {private.bucket(private.shape(t)) for t in ["a.b@c.se", "12", "x1"]}
    smooth = np.array([1, 1400.02, 0.02, 0.02, 0.02])
    assert np.allclose(field.shapes[private.bucket("a.a@a.aa")], np.log(smooth / smooth.sum()), atol=1e-4)


def test_pages(pages, hard, with_clashes):
    texts = [*hard, "a.b@c.se 10.0.0.1 4111 1111 1111 1111 +46 (8) 123-45-67", "+4681234567 and 46-8-1234567"]
    ids = [None, 5, 5, *range(7, 4 + len(texts))]
    rows = private_data(with_clashes(pages(texts, ids), "spans")).collect()
    assert len(rows) == len(texts)
    got = sorted((str(r.doc_id), r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in rows)
    want = []
    for i, t in zip(ids, texts):
        found = expected(t or "") if len(t or "") < 1000 else [[]] * 4
        written = ",".join(f"{k}:{s}:{e}" for k, own in zip(["email", "ip", "card", "phone"], found) for s, e in own)
        want.append((str(i), *map(len, found), hashlib.sha256(written.encode()).hexdigest()))
    assert got == sorted(want)
    last = max(rows, key=lambda r: r.doc_id or 0)
    assert last.spans == "phone:0:11,phone:16:28"


def test_no_pages(pages):
    assert private_data(pages([])).collect() == []


def test_field_runs_without_base_spans(pages):
    known = [f"kort 4111-1111-1111-1111 nummer{i}" for i in range(30)]
    rows = private_data(pages([*known, "kort 4111-1111-1111-1112", "a.b@c.se kort 4111-1111-1111-1112", "år 1917"]))
    found = [r.spans for r in rows.orderBy("doc_id").collect()][-3:]
    assert found == ["card:5:24", "email:0:8,card:14:33", ""]
