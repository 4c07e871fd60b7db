"""Toxic page texts, learnt from confirmed examples and unlabelled text."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafscribe.llm.common import held_out, learning_fold, only, per_slice, plain
from leafscribe.llm.features import Adam, Hashed, Sparse, hashed_ids, sample_features, sigmoid
from leafscribe.llm.leaks import words

#: Size of the hashed feature space.
FEATURES = 1 << 20
#: Bounds of the sample that the model is fitted on: confirmed toxic pages, and unlabelled pages.
CONFIRMED, UNLABELLED = 3000, 9000
#: Share of toxic pages taken as the class prior where no labels tell it.
PRIOR = 0.1
THRESHOLD = 0.7
EPOCHS, BATCH, RATE, DECAY = 30, 1000, 0.05, 1e-6
#: A feature is used if so many confirmed pages have it, and so many deviations more (or fewer) than unlabelled ones do.
LEAST_PAGES, DEVIATIONS = 5, 4.0
#: Words that a worker remembers as telling nothing.
REMEMBERED = 500_000


def _kinds(word: bytes) -> list[bytes]:
    return [word, word[:4], word[:6]]


def features(text: str, size: int = FEATURES) -> Sparse:
    """Which hashed features the text has: its words, and their first four and first six bytes."""
    distinct = sorted(set(words(text)))
    ids = np.unique(hashed_ids(distinct, _kinds, size)) if distinct else np.zeros(0, np.int64)
    return ids, None


class ToxicityModel:
    """Weights of the features that are used, and a constant; the score is the logistic function of their sum."""

    def __init__(self, ids: np.ndarray, weights: np.ndarray, constant: float, size: int):
        self.weight = dict(zip(ids.tolist(), weights.tolist(), strict=True))
        self.constant, self.size = constant, size
        self.telling: dict[bytes, list[int]] = {}
        self.other: set[bytes] = set()

    def _look(self, new: list[bytes]) -> None:
        for word, ids in zip(new, hashed_ids(new, _kinds, self.size).tolist(), strict=True):
            used = [i for i in ids if i in self.weight]
            if used:
                self.telling[word] = used
            else:
                self.other.add(word)

    def scores(self, texts: list[str]) -> np.ndarray:
        """Score of each text."""
        result = np.full(len(texts), self.constant)
        for row, text in enumerate(texts):
            # Loops over the words of the text, never over what is remembered.
            own = set(words(text))
            new = [w for w in own if w not in self.other and w not in self.telling]
            if len(new) + len(self.other) + len(self.telling) > REMEMBERED:
                self.other.clear()
                self.telling.clear()
                new = list(own)
            self._look(new)
            found = {i for w in own for i in self.telling.get(w, ())}
            result[row] += sum(self.weight[i] for i in sorted(found))
        return sigmoid(result)


def _telling(positive: list[Sparse], unlabelled: list[Sparse], size: int) -> np.ndarray:
    """Features on which confirmed and unlabelled pages differ beyond chance."""
    of_p, of_u = np.zeros(size), np.zeros(size)
    for counts, rows in ((of_p, positive), (of_u, unlabelled)):
        for ids, _ in rows:
            counts[ids] += 1
    expected = of_u * (len(positive) / len(unlabelled))
    return np.flatnonzero((of_p >= LEAST_PAGES) & (np.abs(of_p - expected) > DEVIATIONS * np.sqrt(expected + 1)))


def fit_nnpu(
    positive: list[Sparse],
    unlabelled: list[Sparse],
    prior: float,
    size: int = FEATURES,
    epochs: int = EPOCHS,
    batch: int = BATCH,
    rate: float = RATE,
    seed: int = 11,
) -> ToxicityModel:
    """Non-negative positive-unlabelled learning of a logistic model.

    The risk is prior * E+[loss(+)] + max(0, Eu[loss(-)] - prior * E+[loss(-)]): the last term is the risk of the
    unseen negatives, estimated from the unlabelled rows less the positives among them. Where a batch's
    estimate falls below zero the step goes against it instead, so that the model cannot fit it away. The loss is
    the sigmoid of the margin, whose bound keeps single rows from ruling the estimate.
    """
    constant = np.array([np.log(prior / (1 - prior))])
    if not positive or not unlabelled:
        return ToxicityModel(np.zeros(0, np.int64), np.zeros(0), float(constant[0]), size)
    used = _telling(positive, unlabelled, size)
    positive, unlabelled = (
        [(np.searchsorted(used, i[np.isin(i, used, kind="sort")]), None) for i, _ in rows]
        for rows in (positive, unlabelled)
    )
    n = max(len(used), 1)
    random, weights = np.random.default_rng(seed), np.zeros(n)
    optimiser, optimiser_c = Adam(n, rate), Adam(1, rate)
    steps = max(1, -(-len(unlabelled) // batch))
    for _ in range(epochs):
        of_p = np.array_split(random.permutation(max(len(positive), steps)) % len(positive), steps)
        of_u = np.array_split(random.permutation(len(unlabelled)), steps)
        for p, u in zip(of_p, of_u, strict=True):
            p_rows, u_rows = Hashed([positive[i] for i in p], n), Hashed([unlabelled[i] for i in u], n)
            p_score = p_rows.dot(weights) + constant
            u_score = u_rows.dot(weights) + constant
            negative_risk = sigmoid(u_score).mean() - prior * sigmoid(p_score).mean()
            # loss(+) = sigmoid(-g) and loss(-) = sigmoid(g) have opposite slopes.
            p_slope, u_slope = (sigmoid(g) * sigmoid(-g) for g in (p_score, u_score))
            if negative_risk >= 0:
                per_p, per_u = -2 * prior * p_slope / len(p), u_slope / len(u)
            else:
                per_p, per_u = prior * p_slope / len(p), -u_slope / len(u)
            optimiser.step(weights, p_rows.gradient(per_p) + u_rows.gradient(per_u) + DECAY * weights)
            optimiser_c.step(constant, np.array([per_p.sum() + per_u.sum()]))
    return ToxicityModel(used, weights[: len(used)], float(constant[0]), size)


def learn_toxicity(
    pages: DataFrame, ratings: DataFrame, confirmed: int = CONFIRMED, unlabelled: int = UNLABELLED
) -> ToxicityModel:
    """Fits the model on a bounded sample: about `confirmed` pages rated toxic and `unlabelled` pages of any kind.

    pages: `doc_id`, `text`. ratings: `doc_id`, `toxic` (1, 0 or null), at most one row per page (a repeated one counts by
    its largest value). The class prior is the share of toxic pages among the rated ones.
    """
    rated = ratings.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where("toxic is not null")
    counts = rated.agg(F.avg("toxic").alias("prior"), F.count(F.lit(1)).alias("n")).first()
    prior = min(max(counts["prior"], 0.001), 0.999) if counts["n"] else PRIOR
    toxic = rated.where("toxic = 1").select("doc_id")
    known = only(pages.select("doc_id", "text"), toxic).withColumn("part", F.lit(1))
    p = sample_features(known, "part", features, {1: confirmed}, "confirmed toxic")[1]
    anyone = pages.select("doc_id", "text").withColumn("part", F.lit(0))
    u = sample_features(anyone, "part", features, {0: unlabelled}, "unlabelled")[0]
    return fit_nnpu(p, u, prior)


def score_toxicity(pages: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD) -> DataFrame:
    """Score of each page text by its whole text, and nothing else.

    pages: `doc_id`, `text` (null: empty, scored by the constant alone); other columns are not looked at. Returns per page
    `doc_id`, `score` (0 to 1) and `predicted` (1 if the score is at least `threshold`). Repeated rows give a row each.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def work(doc_ids: pa.Array, texts: list[str]) -> pa.RecordBatch:
        score = shared.value.scores(texts)
        predicted = pa.array((score >= threshold).astype(np.int32))
        return pa.record_batch([doc_ids, pa.array(score), predicted], ["doc_id", "score", "predicted"])

    rows = plain(pages)
    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(per_slice(work), f"doc_id {kind}, score double, predicted int")


def page_toxicity(pages: DataFrame, ratings: DataFrame, **bounds: int) -> DataFrame:
    """Learns on the pages of the learning fold and scores every page.

    pages: `doc_id`, `text`. ratings: `doc_id`, `toxic`. The learning fold are the pages whose crc32 of the doc_id as text
    leaves a remainder other than 1 when divided by 3. Returns `score_toxicity` with `held_out` (false for a null
    doc_id, which is never learnt from either). No pages give no rows; without ratings every page gets the prior.
    """
    fold = learning_fold(F.col("doc_id"))
    model = learn_toxicity(pages.select("doc_id", "text").where(fold), ratings.where(fold), **bounds)
    scored = score_toxicity(pages, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
