import numpy as np
import pytest
from pyspark.sql import Row

from page_fixtures import hard, pages, with_clashes  # noqa: F401
from leafscribe.llm.features import Hashed, sigmoid
from leafscribe.llm.toxicity import features, fit_nnpu, learn_toxicity, page_toxicity, score_toxicity

PLAIN = "och den som till drängen ting rätten sade dom gård by kyrka socken häradet pigan bonden".split()
RUDE = "skälm hundsfott tjuvaktig skökan".split()


def made(n, seed, share=0.2):
    random = np.random.default_rng(seed)
    toxic = random.random(n) < share
    texts = []
    for t in toxic:
        own = list(random.choice(PLAIN, random.integers(5, 40)))
        if t:
            own[:: max(1, len(own) // 3)] = random.choice(RUDE, len(own[:: max(1, len(own) // 3)]))
        texts.append(" ".join(own))
    return texts, toxic.astype(int)


def test_fit_finds_hidden_positives():
    texts, toxic = made(3000, 1)
    rows = [features(t) for t in texts]
    confirmed = [r for r, t in zip(rows, toxic) if t][:150]
    model = fit_nnpu(confirmed, rows, 0.2)
    score = model.scores(texts)
    assert (score[toxic == 1] >= 0.7).mean() > 0.95 and (score[toxic == 0] >= 0.7).mean() < 0.01


def test_scores_are_sums_of_telling_features():
    texts, toxic = made(600, 2)
    rows = [features(t) for t in texts]
    model = fit_nnpu([r for r, t in zip(rows, toxic) if t], rows, 0.2, epochs=3)
    dense = np.zeros(model.size)
    dense[list(model.weight)] = list(model.weight.values())
    want = sigmoid(Hashed(rows, model.size).dot(dense) + model.constant)
    assert np.allclose(model.scores(texts), want)


def test_prior_without_examples():
    assert fit_nnpu([], [features("a")], 0.25).scores(["", "a b"]).tolist() == pytest.approx([0.25, 0.25])


def test_pages(spark, pages, hard, with_clashes):
    texts, toxic = made(900, 3)
    df = with_clashes(pages(texts + hard, [*range(900), None, 7, 7, *range(1000, 997 + len(hard))]), "toxic", "predicted")
    ratings = spark.createDataFrame(
        [Row(i, int(t), "x") for i, t in enumerate(toxic) if i % 2] + [Row(None, 1, "x"), Row(1, None, "x"), Row(3, int(toxic[3]), "x")],
        "doc_id long, toxic int, text string",
    )
    rows = page_toxicity(df, ratings).collect()
    assert len(rows) == len(texts) + len(hard)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id < 900]
    right = np.mean([r.predicted == toxic[r.doc_id] for r in held])
    assert right > 0.95 and len(held) > 200


def test_empty_tables(spark, pages):
    ratings = spark.createDataFrame([], "doc_id long, toxic int")
    assert page_toxicity(pages([]), ratings).collect() == []
    assert {round(r.score, 6) for r in page_toxicity(pages(["a", None, "a"]), ratings).collect()} == {0.1}


def test_same_text_same_score(pages, spark):
    texts, toxic = made(300, 5)
    ratings = spark.createDataFrame([Row(i + 1, int(t)) for i, t in enumerate(toxic)], "doc_id long, toxic int")
    model = learn_toxicity(pages(texts), ratings)
    rows = score_toxicity(pages([texts[0]] * 3, [1, 1, 2]), model).collect()
    assert len({r.score for r in rows}) == 1
