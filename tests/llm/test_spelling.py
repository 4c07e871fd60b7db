"""Spelling variants against a comparison of all pairs in plain Python."""

import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from page_fixtures import hard, pages, with_clashes  # noqa: F401
from leafscribe.llm.spelling import WORD, Acceptor, composed, spelling_variants, word_counts


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def expected(counts, ratio=2):
    forms = {}
    for w, n in counts.items():
        found = sorted((-m, x) for x, m in counts.items() if near(w, x))
        good = found and -found[0][0] >= ratio * n
        forms[w] = (found[0][1] if good else None, n, len(found), -found[0][0] if good else None)
    out = []
    for w, (form, n, n_near, form_n) in forms.items():
        root = w
        while forms[root][0] is not None:
            root = forms[root][0]
        out.append((w, form, root, n, n_near, form_n))
    return sorted(out)


def found(df, **options):
    rows = spelling_variants(df, **options).select("word", "form", "root", "n", "n_near", "form_n").collect()
    return sorted(tuple(r) for r in rows)


def vocabulary(size, letters="abé", least=1, most=7, seed=5):
    draw = random.Random(seed)
    words = {"".join(draw.choices(letters, k=draw.randint(least, most))) for _ in range(size)}
    return {w: draw.choice([1, 2, 3, 7, 20, 100]) for w in words}


@pytest.mark.parametrize("seed", range(6))
def test_composition_gives_each_pair_once(seed):
    words = sorted(vocabulary(120, seed=seed, most=6))
    acceptor = Acceptor(words)
    for size in range(7):
        got = [tuple(sorted(p)) for p in composed(acceptor, size, False)]
        wanted = [
            (a, b) for a in words for b in words
            if a < b and near(a, b) and min(len(a), len(b)) == size
        ]
        assert sorted(got) == sorted(wanted)


def test_acceptor_is_minimal():
    acceptor = Acceptor(sorted(["ab", "cb", "abb", "cbb"]))
    # Start, after the first letter, after b, the end.
    assert len(acceptor.arcs) == 4
    assert acceptor.count[acceptor.start] == 4


@pytest.mark.parametrize("state_words", [2, 5, 20_000])
def test_equals_all_pairs(spark, state_words):
    counts = vocabulary(500)
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert found(df, state_words=state_words) == expected(counts)


def test_one_first_half_on_most_words(spark):
    # A hot initial state: it is parted by the letters that follow, whatever their place.
    counts = {"åbcdef" + w: n for w, n in vocabulary(300, "abcd", 4, 7).items()} | {"xbcdefabcd": 3, "bcdefabcda": 9}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert found(df, state_words=7) == expected(counts)


def test_forms_follow_each_other(spark):
    counts = {"kyrka": 1, "kyrkan": 2, "kyrkans": 4, "kyrkanse": 8, "kyrkansen": 16, "socken": 5, "sockem": 5}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    rows = found(df)
    assert rows == expected(counts)
    assert {r[0]: r[2] for r in rows}["kyrka"] == "kyrkansen"


def test_hard_words(spark):
    long = "x" * 3000
    counts = {"": 1, "a": 4, "b": 9, long: 1, long + "y": 2, "y" + long: 2, "🙂aaaa": 2, "åaaaa": 2, "aaaa": 1}
    df = spark.createDataFrame([*counts.items(), (None, 5)], "word string, n long")
    clash = df.withColumns({c: F.lit("x") for c in ["form", "root", "prefix", "tail", "size", "near", "best"]})
    assert found(clash) == expected(counts)
    assert found(df.limit(0)) == []
    assert found(spark.createDataFrame([("abcde", None)], "word string, n long")) == [("abcde", None, "abcde", 0, 0, None)]
    with pytest.raises(ValueError):
        spelling_variants(df, ratio=1)


def counted(rows, fault):
    total = Counter()
    for name, text in rows:
        for w in WORD.findall(text or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{name}:{w}".encode())
            if fault and name is not None and h % fault == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= 5:
                total[w] += 1
    return {w: n for w, n in total.items() if n >= 3}


@pytest.mark.parametrize("fault", [None, 3])
def test_word_counts(pages, hard, with_clashes, fault):
    texts = [*hard, "Socken SOCKEN socken, Ålesund ålesund Ålesund", "abc×def abc×def abc×def", "word " * 9, "Kyrka\nkyrka KYRKA kyrkan"]
    ids = [*range(1, len(texts) - 1), None, 3]
    df = with_clashes(pages(texts, ids), "n")
    got = {r.word: r.n for r in word_counts(df, fault=fault).collect()}
    assert got == counted(zip(ids, texts, strict=True), fault)
    assert "ålesund" not in got


def test_no_pages(pages):
    assert word_counts(pages(["x"]).limit(0)).collect() == []


def test_texts_to_variants(pages):
    texts = ["kyrkan " * 8 + "kyrkam " * 3, "Kyrkan socken " * 4 + "sokken sokken sokken", None]
    rows = found(word_counts(pages(texts)))
    assert rows == expected({"kyrkan": 12, "kyrkam": 3, "socken": 4, "sokken": 3})
    assert [r[1] for r in rows] == ["kyrkan", None, None, None]
