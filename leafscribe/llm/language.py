"""Language of page texts by hyperdimensional letter profiles."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafscribe.llm.common import bound_batches, hashed_fraction, held_out, learning_fold, per_slice, plain, slices

#: Length of the vectors, letters of one n-gram, and seed of the random letter vectors.
DIMENSIONS = 1024
LETTERS = 3
SEED = 17
#: Learning texts per language: the bound of the sample that prototypes are made of.
SAMPLE = 2000
#: Tasks that add up the sample.
TASKS = 12
#: Languages that are told apart at most, as prototypes are one small matrix; more are refused.
LANGUAGES = 1000
#: Sharpness of the score: it is the softmax of the cosines times this number.
SHARPNESS = 25.0
UNKNOWN = "und"
_COLUMNS = ["doc_id", "lang_pred", "score"]


@lru_cache(maxsize=100_000)
def letter(code: int, dimensions: int, seed: int) -> np.ndarray:
    """The random vector of +1 and -1 that stands for a character, the same in every task."""
    return (np.random.default_rng([seed, code]).integers(0, 2, dimensions, np.int8) * 2 - 1).astype(np.int8)


def _letters(text: str) -> np.ndarray:
    """Lower-case letters of the text as code points, one space (32) between words and at both ends."""
    lower = text.lower()
    codes = np.frombuffer(lower.encode("utf-32-le", "surrogatepass"), np.uint32)
    ascii_letter = (codes >= 97) & (codes <= 122)
    is_letter = ascii_letter.copy()
    # Beyond ASCII there are few different characters in a text.
    others = np.flatnonzero(codes >= 128)
    if len(others):
        kinds, inverse = np.unique(codes[others], return_inverse=True)
        is_letter[others] = np.array([chr(k).isalpha() for k in kinds.tolist()])[inverse]
    padded = np.zeros(len(codes) + 2, np.int64)
    padded[1:-1] = np.where(is_letter, codes, 32)
    padded[0] = padded[-1] = 32
    space = padded == 32
    return padded[~(space & np.concatenate([[False], space[:-1]]))]


def _grams(text: str, letters: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams (21 bits a letter) and their counts; none if the text has no letter."""
    codes = _letters(text)
    if len(codes) == 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    codes = np.concatenate([codes, np.full(max(0, letters - len(codes)), 32)])
    keys = np.zeros(len(codes) - letters + 1, np.int64)
    for i in range(letters):
        keys = (keys << 21) | codes[i : i + len(keys)]
    return np.unique(keys, return_counts=True)


def bound_vectors(keys: np.ndarray, letters: int, dimensions: int, seed: int) -> np.ndarray:
    """One vector per n-gram: the product of its letters' vectors, each rotated by its distance from the end."""
    result = np.ones((len(keys), dimensions), np.int8)
    for place in range(letters):
        codes = (keys >> np.int64(21 * place)) & np.int64((1 << 21) - 1)
        kinds, inverse = np.unique(codes, return_inverse=True)
        table = [np.roll(letter(int(k), dimensions, seed), place) for k in kinds]
        result *= np.array(table, np.int8).reshape(-1, dimensions)[inverse]
    return result


def profiles(texts: list[str], letters: int = LETTERS, dimensions: int = DIMENSIONS, seed: int = SEED) -> np.ndarray:
    """Bundled n-gram vectors of each text, as unit vectors; zero for a text without letters."""
    found = [_grams(t, letters) for t in texts]
    keys = np.unique(np.concatenate([k for k, _ in found])) if found else np.zeros(0, np.int64)
    result = np.zeros((len(texts), dimensions), np.float32)
    step = 4096
    for low in range(0, len(keys), step):
        own = keys[low : low + step]
        counts = np.zeros((len(texts), len(own)), np.float32)
        for row, (k, n) in enumerate(found):
            a, b = np.searchsorted(k, own[0]), np.searchsorted(k, own[-1], side="right")
            counts[row, np.searchsorted(own, k[a:b])] = n[a:b]
        result += counts @ bound_vectors(own, letters, dimensions, seed).astype(np.float32)
    length = np.linalg.norm(result, axis=1, keepdims=True)
    return np.divide(result, length, out=result, where=length > 0)


class Prototypes:
    """Learnt languages and their vectors; the mean over languages is taken off, as it tells nothing."""

    def __init__(self, languages: list[str], sums: np.ndarray, letters: int, seed: int):
        self.languages, self.letters, self.seed = languages, letters, seed
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        unit = np.divide(sums, length, out=np.zeros_like(sums), where=length > 0)
        self.mean = unit.mean(axis=0) if len(languages) > 1 else np.zeros(sums.shape[1])
        centred = unit - self.mean
        length = np.linalg.norm(centred, axis=1, keepdims=True)
        self.vectors = np.divide(centred, length, out=centred, where=length > 0).astype(np.float32)

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text."""
        found = profiles(texts, self.letters, self.vectors.shape[1], self.seed)
        known = found.any(axis=1)
        found -= np.where(known[:, None], self.mean, 0).astype(np.float32)
        length = np.linalg.norm(found, axis=1, keepdims=True)
        cosine = np.divide(found, length, out=found, where=length > 0) @ self.vectors.T
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        best = cosine.argmax(axis=1)
        weights = np.exp(SHARPNESS * (cosine - cosine.max(axis=1, keepdims=True)).astype(np.float64))
        score = np.where(known, weights.max(axis=1) / weights.sum(axis=1), 0.0)
        return [self.languages[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)], score


def learn_languages(
    pages: DataFrame,
    letters: int = LETTERS,
    dimensions: int = DIMENSIONS,
    seed: int = SEED,
    sample: int = SAMPLE,
) -> Prototypes:
    """Prototype of each value of `lang`: the bundle of the profiles of its pages.

    pages: `doc_id`, `text`, `lang`; rows without a text or a language are not learnt from. About `sample` pages of each
    language are used, chosen by a hash of doc_id (all of them where there are fewer): that bounds the sample. Their
    profiles are added up in the tasks, so one vector per language and task comes back. More than `LANGUAGES` values
    are refused with an error: none is left out silently.
    """
    known = pages.select("doc_id", "text", "lang").where("text is not null and lang is not null")
    totals = known.groupBy("lang").count().limit(LANGUAGES + 1).collect()
    if len(totals) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} values of lang")
    share = F.lit(0.0)
    for row in totals:
        share = F.when(F.col("lang") == row["lang"], F.lit(sample / row["count"])).otherwise(share)
    chosen = known.where(hashed_fraction(F.col("doc_id"), "languages") < share).select("lang", "text")

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            languages = batch["lang"].to_pylist()
            for start, texts in slices(batch["text"]):
                own = languages[start : start + len(texts)]
                for language, vector in zip(own, profiles(texts, letters, dimensions, seed), strict=True):
                    sums[language] = sums.get(language, 0) + vector.astype(np.float64)
        if sums:
            values = pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))
            yield pa.record_batch([pa.array(list(sums)), values], ["lang", "sums"])

    # A bounded number of rows: few tasks, so few sums come back.
    parts = chosen.repartition(TASKS).mapInArrow(add_up, "lang string, sums array<double>").collect()
    languages = sorted({r["lang"] for r in parts})
    sums = np.zeros((len(languages), dimensions))
    for r in sorted(parts, key=lambda r: r["sums"]):
        sums[languages.index(r["lang"])] += r["sums"]
    return Prototypes(languages, sums, letters, seed)


def predict_languages(pages: DataFrame, prototypes: Prototypes) -> DataFrame:
    """Language of each page text by the largest cosine with a prototype.

    pages: `doc_id`, `text`; nothing else is looked at. Returns per page `doc_id`, `lang_pred` (`und` for a null text or
    one without a letter) and `score` (0 to 1: the softmax of the cosines; 0 for `und`). Ties go to the language that
    comes first in the alphabet. Repeated rows give a row each, no pages no rows, and very long texts are read whole.
    """
    shared = pages.sparkSession.sparkContext.broadcast(prototypes)

    def work(doc_ids: pa.Array, texts: list[str]) -> pa.RecordBatch:
        languages, score = shared.value.predict(texts)
        return pa.record_batch([doc_ids, pa.array(languages, pa.string()), pa.array(score)], _COLUMNS)

    rows = plain(pages)
    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(per_slice(work), f"doc_id {kind}, lang_pred string, score double")


def language_of(text: Column, prototypes: Prototypes) -> Column:
    """Struct of `lang_pred`, `score` and `lettered` (the text has a letter) of a text column.

    `lang_pred` and `score` are those of `predict_languages`. Where no language was learnt all texts are `und`, but
    `lettered` still tells those apart that can have a language. For tables whose rows have no key of their own.
    """

    @F.arrow_udf("lang_pred string, score double, lettered boolean")
    def predicted(texts: pa.Array) -> pa.Array:
        languages, scores, lettered = [], [], []
        for _, own in slices(texts):
            names, score = prototypes.predict(own)
            languages += names
            scores += score.tolist()
            lettered += [any(map(str.isalpha, t)) for t in own]
        columns = [pa.array(languages, pa.string()), pa.array(scores, pa.float64()), pa.array(lettered, pa.bool_())]
        return pa.StructArray.from_arrays(columns, ["lang_pred", "score", "lettered"])

    return predicted(text)


def spoken_pages(pages: DataFrame, into: str = "lang_pred", **options) -> DataFrame:
    """Pages, with all their columns, whose text can have a language, and that language in the column `into`.

    pages: `doc_id`, `text`, `lang`. Languages are learnt as in `page_languages` and predicted row by row, so null and
    repeated ids do not matter. A row is rejected if its text is null or has no letter; one whose language is only
    unknown (as no language was learnt) stays, with `und`. No pages give no rows, very long texts are read whole, and
    other columns may have any names; one named `into` is replaced.
    """
    bound_batches(pages.sparkSession)
    fold = pages.select("doc_id", "text", "lang").where(learning_fold(F.col("doc_id")))
    found = language_of(F.col("text"), learn_languages(fold, **options))
    rows = pages.withColumn(into, F.when(found["lettered"], found["lang_pred"]))
    return rows.where(F.col(into).isNotNull())


def page_languages(pages: DataFrame, **options) -> DataFrame:
    """Learns from the pages of the learning fold that have a `lang` and predicts it for every page.

    pages: `doc_id`, `text`, `lang` (null where unknown). The learning fold are the pages whose crc32 of the doc_id
    as text leaves a remainder other than 1 when divided by 3. Options are those of `learn_languages`.
    Returns `predict_languages` with `held_out` (true outside the learning fold; false for a null doc_id, which
    is never learnt from either).
    """
    fold = pages.select("doc_id", "text", "lang").where(learning_fold(F.col("doc_id")))
    predicted = predict_languages(pages, learn_languages(fold, **options))
    return predicted.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
