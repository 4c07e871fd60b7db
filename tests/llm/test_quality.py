import numpy as np
from pyspark.sql import Row

from page_fixtures import hard, pages, with_clashes  # noqa: F401
from leafscribe.llm.quality import features, fit_grades, page_quality


def made(n, seed):
    """Texts whose share of scrambled words falls with the grade (0 to 3)."""
    random = np.random.default_rng(seed)
    grades = random.integers(0, 4, n)
    texts = []
    for g in grades:
        bad = random.random(60) < (3 - g) / 4
        texts.append(" ".join(f"#{random.integers(50)}%!" if b else f"ord{random.integers(200)}" for b in bad))
    return texts, grades


def test_ordered_grades():
    texts, grades = made(1500, 1)
    rows = {g: [features(t) for t, h in zip(texts, grades) if h == g] for g in range(4)}
    model = fit_grades(rows)
    assert (np.diff(model.thresholds) > 0).all()
    more, truth = made(400, 2)
    tails = model.tails(more)
    assert (np.diff(tails, axis=1) <= 0).all()
    assert np.abs(tails[:, 1:].sum(1) - truth).mean() < 0.5


def test_pages(spark, pages, hard, with_clashes):
    texts, grades = made(600, 3)
    df = with_clashes(pages(texts + hard, [*range(600), None, 7, 7, *range(900, 897 + len(hard))]), "grade", "tail")
    ratings = spark.createDataFrame([Row(i, int(g > 1)) for i, g in enumerate(grades)] + [Row(None, 1), Row(3, None)], "doc_id long, grade int")
    rows = page_quality(df, ratings).collect()
    assert len(rows) == len(texts) + len(hard)
    assert all(0 <= r.tail <= 1 and r.kept == (r.tail >= 0.5) for r in rows)
    right = np.mean([r.kept == (grades[r.doc_id] > 1) for r in rows if r.held_out and r.doc_id < 600])
    assert right > 0.9


def test_empty_tables(spark, pages):
    none = spark.createDataFrame([], "doc_id long, grade int")
    assert page_quality(pages([]), none).collect() == []
    assert {(r.expected_grade, r.kept) for r in page_quality(pages(["a", None]), none).collect()} == {(0.0, True)}


def test_every_grade_of_a_long_scale_is_learnt(spark, pages, monkeypatch):
    import pytest

    from leafscribe.llm import quality

    n = 150
    texts = [f"ord{i % 7} sida{i}" for i in range(n)]
    ratings = spark.createDataFrame([(i, i - 1) for i in range(1, n + 1)], "doc_id long, grade int")
    assert quality.learn_grades(pages(texts), ratings).grades == list(range(n))
    monkeypatch.setattr(quality, "GRADES", n - 1)
    with pytest.raises(ValueError, match="different grades"):
        quality.learn_grades(pages(texts), ratings)
