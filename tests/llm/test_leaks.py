import hashlib
import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Row

from page_fixtures import pages, with_clashes  # noqa: F401
from leafscribe.llm.leaks import benchmark_leaks, words

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def plain_words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def expected(texts, items, window):
    out = []
    for text in texts:
        own, hit, found, longest = plain_words(text), set(), set(), 0
        for item_id, item in items:
            w = plain_words(item)
            n = min(window, len(w))
            for i in range(len(w) - n + 1 if n else 0):
                for p in range(len(own) - n + 1):
                    if own[p : p + n] == w[i : i + n]:
                        hit.update(range(p, p + n))
                        found.add("" if item_id is None else str(item_id))
                        more = n
                        while i + more < len(w) and p + more < len(own) and w[i + more] == own[p + more]:
                            more += 1
                        longest = max(longest, more)
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((len(own), len(hit), len(found), digest, bool(hit), longest))
    return out


def run(spark, pages, texts, items, window, **more):
    benchmark = spark.createDataFrame([Row(*r) for r in items], "item_id long, text string")
    rows = benchmark_leaks(pages(texts), benchmark, window, **more).orderBy("doc_id").collect()
    return [(r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated, r.longest) for r in rows]


def test_words():
    text = "Ärlig A1-b\n\x00Ñ__ü\x85z é́ 9"
    assert [w.decode() for w in words(text)] == plain_words(text)


ITEMS = [(3, "The quick brown fox, jumps"), (20, "over a dog"), (7, ""), (7, None), (5, "a"), (20, "fox jumps over")]
TEXTS = [
    "the QUICK brown fox jumps over a dog",
    "quick brown fox jumps! The quick",
    None,
    "",
    "über a",
    "no match",
    "a a a",
    "x " * 5000 + "the quick brown fox jumps over a dog " + "y " * 5000,
]


def test_hard_rows(spark, pages):
    want = expected(TEXTS, ITEMS, 3)
    assert run(spark, pages, TEXTS, ITEMS, 3) == want
    # The same in many blocks.
    got = run(spark, pages, TEXTS, ITEMS, 3, block_bytes=16)
    assert [r[:5] for r in got] == [r[:5] for r in want]


def test_empty_tables(spark, pages):
    assert run(spark, pages, [], ITEMS, 3) == []
    assert run(spark, pages, ["a b"], [], 3) == [(2, 0, 0, hashlib.sha256(b"").hexdigest(), False, 0)]


text = st.lists(st.sampled_from("a b c d".split()), max_size=14).map(" ".join)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(text, min_size=1, max_size=30), st.lists(text, max_size=5))
def test_any_texts(spark, pages, texts, items):
    items = list(enumerate(items))
    got, want = run(spark, pages, texts, items, 3), expected(texts, items, 3)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    # Windows may join across items, so a stretch is at least as long as within one.
    assert all(g[5] >= w[5] for g, w in zip(got, want))


def test_other_columns(spark, pages, with_clashes):
    benchmark = spark.createDataFrame([(1, "a b", "x")], "item_id long, text string, hits string")
    df = with_clashes(pages(["a b", "c"]), "hits", "n_words", "items")
    assert [r.contaminated for r in benchmark_leaks(df, benchmark).orderBy("doc_id").collect()] == [True, False]
