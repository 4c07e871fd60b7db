import numpy as np
import pytest
from pyspark.sql import functions as F

from page_fixtures import hard, pages, with_clashes  # noqa: F401
from leafscribe.llm import language
from leafscribe.llm.language import (
    Prototypes,
    bound_vectors,
    page_languages,
    predict_languages,
    profiles,
    spoken_pages,
)

SWEDISH = ["Anno 1702 den 3 februari hölls ordinarie ting", "Samma dag framkom för rätten drängen", "Så blev och upplyst"]
LATIN = ["Anno domini millesimo quingentesimo", "Notum sit omnibus quorum interest", "In nomine patris et filii"]


def slow_profile(text, letters, dimensions, seed):
    """Bundles the n-grams of a text one after the other."""
    from leafscribe.llm.language import letter

    cleaned = " " + " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split()) + " "
    total = np.zeros(dimensions)
    for i in range(len(cleaned) - letters + 1):
        bound = np.ones(dimensions)
        for place, c in enumerate(reversed(cleaned[i : i + letters])):
            bound = bound * np.roll(letter(ord(c), dimensions, seed), place)
        total += bound
    return total / np.linalg.norm(total)


def test_profiles_are_bundles_of_bound_letters():
    texts = [*SWEDISH, "Ñandú, 1 ö!", "a"]
    for text, found in zip(texts, profiles(texts, 3, 256, 5)):
        assert np.allclose(found, slow_profile(text, 3, 256, 5), atol=1e-5)
    assert not profiles(["", "12 - 7"], 3, 256, 5).any()


def test_binding_keeps_order():
    key = lambda s: np.array([(ord(s[0]) << 42) | (ord(s[1]) << 21) | ord(s[2])])
    a, b = bound_vectors(key("abc"), 3, 2048, 1), bound_vectors(key("cba"), 3, 2048, 1)
    assert abs((a.astype(int) @ b.T.astype(int)).item()) < 300


def test_learns_and_predicts(pages, hard, with_clashes):
    texts = [*SWEDISH, *LATIN] * 20 + hard
    lang = F.when(F.col("page_number") > 120, None).otherwise(
        F.when((F.col("page_number") - 1) % 6 < 3, "sv").otherwise("la")
    )
    df = with_clashes(pages(texts).withColumn("lang", lang), "lang_pred", "held_out")
    rows = page_languages(df).orderBy("doc_id").collect()
    assert len(rows) == len(texts)
    assert [r.lang_pred for r in rows[:120]] == ["sv", "sv", "sv", "la", "la", "la"] * 20
    assert all(0 <= r.score <= 1 for r in rows)
    none = [not any(c.isalpha() for c in t or "") for t in texts]
    assert [r.lang_pred == "und" for r in rows] == none
    assert {r.held_out for r in rows} == {True, False}


def test_nothing_to_learn(pages):
    df = pages(["a", None], ids=[None, 4]).withColumn("lang", F.lit(None).cast("string"))
    assert {(r.doc_id, r.lang_pred, r.score) for r in page_languages(df).collect()} == {(None, "und", 0), (4, "und", 0)}
    assert page_languages(pages([]).withColumn("lang", F.lit("sv"))).collect() == []


def test_same_row_same_answer(pages):
    prototypes = Prototypes(["la", "sv"], profiles([" ".join(LATIN), " ".join(SWEDISH)]), 3, 17)
    rows = predict_languages(pages(["rätten den samma"] * 3, ids=[1, 1, 1]), prototypes).collect()
    assert len({tuple(r) for r in rows}) == 1 and rows[0].lang_pred == "sv"


def test_prediction_is_the_nearest_bundle(pages):
    """Against prototypes and cosines added up one text after the other."""
    groups = {"la": LATIN, "sv": SWEDISH}
    sums = np.array([sum(slow_profile(t, 3, 256, 5) for t in own) for own in groups.values()])
    prototypes = Prototypes(list(groups), sums.copy(), 3, 5)
    unit = sums / np.linalg.norm(sums, axis=1, keepdims=True)
    centred = unit - unit.mean(axis=0)
    texts = [*SWEDISH, *LATIN, "ting och domini", "ö", "Rex et regina", "drottning och konung"]
    rows = predict_languages(pages(texts), prototypes).orderBy("doc_id").collect()
    for text, row in zip(texts, rows):
        own = slow_profile(text, 3, 256, 5) - unit.mean(axis=0)
        cosine = centred @ own / np.linalg.norm(centred, axis=1) / np.linalg.norm(own)
        weights = np.exp(language.SHARPNESS * cosine)
        assert row.lang_pred == list(groups)[cosine.argmax()]
        assert abs(row.score - weights.max() / weights.sum()) < 1e-4


def test_spoken_pages_predict_and_reject_rows(pages, hard, with_clashes):
    texts = [*SWEDISH, *LATIN] * 20 + hard
    lang = F.when(F.col("page_number") > 120, None).otherwise(
        F.when((F.col("page_number") - 1) % 6 < 3, "sv").otherwise("la")
    )
    df = with_clashes(pages(texts).withColumn("lang", lang), "score", "lettered")
    found = spoken_pages(df)
    assert found.columns == [*df.columns, "lang_pred"]
    wanted = {r.doc_id: r.lang_pred for r in page_languages(df).collect() if r.lang_pred != "und"}
    assert {r.doc_id: r.lang_pred for r in found.collect()} == wanted


def test_too_many_languages_are_refused(pages, monkeypatch):
    monkeypatch.setattr(language, "LANGUAGES", 2)
    three = pages(["en", "två", "tre", "fyra"] * 5).withColumn("lang", (F.col("doc_id") % 3).cast("string"))
    with pytest.raises(ValueError, match="more than 2"):
        page_languages(three)
    assert page_languages(three.where("lang <> '0'")).count() > 0
