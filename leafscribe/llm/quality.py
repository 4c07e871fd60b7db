"""Expected grade of page texts by ordinal regression on ratings."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafscribe.llm.common import copied, held_out, learning_fold, per_slice, plain
from leafscribe.llm.features import Adam, Hashed, Sparse, hashed_ids, sample_features, sigmoid

#: Size of the hashed feature space, and the bound of the sample: pages of each grade.
FEATURES, SAMPLE = 1 << 18, 4000
#: Most different grades of a scale; ratings with more are refused.
GRADES = 200
#: Pages are kept whose chance of at least `GOOD` (the highest grade, if None) is this or more.
LEAST_CHANCE = 0.5
EPOCHS, BATCH, RATE, DECAY = 20, 500, 0.02, 1e-5

_DIGIT, _LETTER, _RUN = re.compile(rb"[0-9]+"), re.compile(rb"[a-z\x80-\xff]+"), re.compile(rb"[A-Z]+")


def _kinds(word: bytes) -> list[bytes]:
    return [word.lower(), _RUN.sub(b"A", _LETTER.sub(b"a", _DIGIT.sub(b"0", word)))]


def features(text: str, size: int = FEATURES) -> Sparse:
    """Shares of the text's words, of their shapes, and how often words repeat, as a unit vector."""
    own = text.encode("utf-8", "surrogatepass").split()
    if not own:
        return np.zeros(0, np.int64), np.zeros(0)
    counts: dict[bytes, int] = {}
    for word in own:
        counts[word] = counts.get(word, 0) + 1
    repeated = sum(a == b for a, b in zip(own, own[1:], strict=False)) / len(own)
    marks = [b"\x00repeated %d" % int(10 * repeated), b"\x00distinct %d" % int(10 * len(counts) / len(own))]
    ids = hashed_ids([*counts, *marks], _kinds, size)
    value = np.concatenate([np.array(list(counts.values())) / len(own), [0.3, 0.3]])
    ids, where = np.unique(ids.ravel(), return_inverse=True)
    value = np.sqrt(np.bincount(where.ravel(), np.repeat(value, 2)))
    return ids, value / np.linalg.norm(value)


class GradeModel:
    """Chance of a grade above k: the logistic function of the shared score less the k-th threshold."""

    def __init__(self, grades: list[int], weights: np.ndarray, thresholds: np.ndarray):
        self.grades, self.weights, self.thresholds = grades, weights.astype(np.float32), thresholds

    def tails(self, texts: list[str]) -> np.ndarray:
        """One column per grade: the chance of this grade or a higher one."""
        rows = Hashed([features(t, len(self.weights)) for t in texts], len(self.weights))
        above = sigmoid(rows.dot(self.weights)[:, None] - self.thresholds)
        return np.concatenate([np.ones((len(texts), 1)), above], 1)


def fit_grades(rows: dict[int, list[Sparse]], size: int = FEATURES, epochs: int = EPOCHS, seed: int = 7) -> GradeModel:
    """Cumulative-link regression: one weight vector for all grades, and ascending thresholds between them.

    Thresholds are a first one and positive steps (exponentials), so they stay ordered while all are learnt.
    """
    grades = sorted(g for g, found in rows.items() if found)
    weights = np.zeros(size)
    if len(grades) < 2:
        return GradeModel(grades or [0], weights, np.zeros(0))
    texts = [r for g in grades for r in rows[g]]
    level = np.repeat(np.arange(len(grades)), [len(rows[g]) for g in grades])
    # Start at the thresholds that give each grade its share.
    share = np.clip(1 - np.cumsum(np.bincount(level))[:-1] / len(level), 1e-3, 1 - 1e-3)
    start = -np.log(share / (1 - share))
    steps = np.concatenate([start[:1], np.log(np.maximum(np.diff(start), 1e-3))])
    random, optimiser, optimiser_s = np.random.default_rng(seed), Adam(size, RATE), Adam(len(steps), RATE)
    for _ in range(epochs):
        for own in np.array_split(random.permutation(len(texts)), max(1, len(texts) // BATCH)):
            batch = Hashed([texts[i] for i in own], size)
            thresholds = steps[0] + np.concatenate([[0], np.cumsum(np.exp(steps[1:]))])
            edge = np.concatenate([[-np.inf], thresholds, [np.inf]])
            score = batch.dot(weights)
            # P(grade) is the difference of two logistic functions; slopes of its logarithm.
            high, low = sigmoid(edge[level[own] + 1] - score), sigmoid(edge[level[own]] - score)
            chance = np.maximum(high - low, 1e-9)
            up, down = high * (1 - high) / chance / len(own), low * (1 - low) / chance / len(own)
            optimiser.step(weights, batch.gradient(up - down) + DECAY * weights)
            slope = np.bincount(level[own], -up, len(edge))[: len(thresholds)]
            slope += np.bincount(level[own], down, len(edge))[1 : len(thresholds) + 1]
            later = np.cumsum(slope[::-1])[::-1]
            optimiser_s.step(steps, later * np.concatenate([[1], np.exp(steps[1:])]))
    return GradeModel(grades, weights, steps[0] + np.concatenate([[0], np.cumsum(np.exp(steps[1:]))]))


def learn_grades(pages: DataFrame, ratings: DataFrame, sample: int = SAMPLE) -> GradeModel:
    """Fits the model on about `sample` rated pages of each grade (all, where there are fewer).

    pages: `doc_id`, `text`. ratings: `doc_id`, `grade` (a scale of integers, up to `GRADES` different ones; more are an error. Nulls are left
    out, of several the largest counts).
    """
    rated = ratings.groupBy("doc_id").agg(F.max("grade").alias("grade")).where("grade is not null")
    grades = [r["grade"] for r in rated.select("grade").distinct().orderBy("grade").limit(GRADES + 1).collect()]
    if len(grades) > GRADES:
        raise ValueError(f"the ratings have more than {GRADES} different grades")
    if not grades:
        return fit_grades({})
    named = copied(rated.select(F.col("doc_id").alias("__rated"), "grade"))
    graded = pages.select("doc_id", "text").join(named, F.col("doc_id") == F.col("__rated")).drop("__rated")
    return fit_grades(sample_features(graded, "grade", features, dict.fromkeys(grades, sample), "grades"))


def page_quality(pages: DataFrame, ratings: DataFrame, least_chance: float = LEAST_CHANCE, **bounds: int) -> DataFrame:
    """Expected grade of every page, and the chance of the highest one, for selection.

    pages: `doc_id`, `text` (null: empty); ratings: `doc_id`, `grade`. Learns only on pages whose crc32 of the doc_id as text
    leaves a remainder other than 1 when divided by 3. Returns per page `doc_id`, `held_out`, `expected_grade`, `tail`
    (chance of the highest grade) and `kept` (tail at least `least_chance`). Repeated rows give a row each; without
    ratings every page has grade 0 and is kept; no pages give no rows.
    """
    fold = learning_fold(F.col("doc_id"))
    model = learn_grades(pages.select("doc_id", "text").where(fold), ratings.where(fold), **bounds)
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def work(doc_ids: pa.Array, texts: list[str]) -> pa.RecordBatch:
        tails = shared.value.tails(texts)
        grades = np.array(shared.value.grades, np.float64)
        expected = grades[0] + tails[:, 1:] @ np.diff(grades)
        return pa.record_batch([doc_ids, pa.array(expected), pa.array(tails[:, -1])], ["doc_id", "expected_grade", "tail"])

    rows = plain(pages)
    kind = dict(rows.dtypes)["doc_id"]
    scored = rows.mapInArrow(per_slice(work), f"doc_id {kind}, expected_grade double, tail double")
    kept = F.col("tail") >= least_chance
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "expected_grade", "tail", kept.alias("kept"))
