"""Hashed features of whole texts for the linear models."""

from __future__ import annotations

from collections.abc import Callable
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafscribe.llm.common import hashed_fraction, per_slice, plain

#: A text as sparse features: ids and as many values (None: all are 1).
Sparse = tuple[np.ndarray, np.ndarray | None]


class Hashed:
    """Rows of sparse features over `size` hashed ids."""

    def __init__(self, rows: list[Sparse], size: int):
        lengths = np.array([len(ids) for ids, _ in rows], np.int64)
        self.size = size
        self.row = np.repeat(np.arange(len(rows)), lengths)
        self.ids = np.concatenate([np.zeros(0, np.int64), *(i.astype(np.int64) for i, _ in rows)])
        self.values = np.concatenate([np.zeros(0), *(np.ones(len(i)) if v is None else v.astype(np.float64) for i, v in rows)])
        self.n = len(rows)

    def dot(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights[self.ids] * self.values, self.n)

    def gradient(self, per_row: np.ndarray) -> np.ndarray:
        """Sum of rows, each times its number."""
        return np.bincount(self.ids, per_row[self.row] * self.values, self.size)


def hashed_ids(words: list[bytes], kinds: Callable[[bytes], list[bytes]], size: int) -> np.ndarray:
    """Feature ids of each word, one column per kind."""
    return np.array([[crc32(k, i) % size for i, k in enumerate(kinds(w), 1)] for w in words], np.int64)


def sample_features(pages: DataFrame, label: str, extract, caps: dict, salt: str) -> dict:
    """Features of a bounded sample of labelled pages: about `caps[value]` pages of each value of `label`.

    Pages are chosen by a hash of doc_id (all, where there are fewer). Only features come to the driver.
    """
    known = pages.select("doc_id", "text", label).where(F.col(label).isin(list(caps)))
    totals = {r[label]: r["count"] for r in known.groupBy(label).count().collect()}
    share = F.lit(0.0)
    for value, cap in caps.items():
        share = F.when(F.col(label) == value, F.lit(cap / max(totals.get(value, 0), 1))).otherwise(share)
    chosen = known.where(hashed_fraction(F.col("doc_id"), salt) < share)
    rows = plain(chosen.select(F.col(label).alias("doc_id"), "text"))

    def work(labels: pa.Array, texts: list[str]) -> pa.RecordBatch:
        found = [extract(t) for t in texts]
        ids = pa.array([i.astype("<i4").tobytes() for i, _ in found], pa.binary())
        values = pa.array([None if v is None else v.astype("<f4").tobytes() for _, v in found], pa.binary())
        return pa.record_batch([labels, ids, values], ["doc_id", "ids", "vals"])

    kind = dict(rows.dtypes)["doc_id"]
    result: dict = {value: [] for value in caps}
    for r in rows.mapInArrow(per_slice(work), f"doc_id {kind}, ids binary, vals binary").collect():
        values = None if r["vals"] is None else np.frombuffer(r["vals"], "<f4")
        result[r["doc_id"]].append((np.frombuffer(r["ids"], "<i4"), values))
    for found in result.values():
        # The same order whatever task came first.
        found.sort(key=lambda r: (len(r[0]), r[0].tobytes(), b"" if r[1] is None else r[1].tobytes()))
    return result


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class Adam:
    """Adam steps over one weight vector."""

    def __init__(self, size: int, rate: float):
        self.m, self.v, self.t, self.rate = np.zeros(size), np.zeros(size), 0, rate

    def step(self, weights: np.ndarray, gradient: np.ndarray) -> None:
        self.t += 1
        self.m += 0.1 * (gradient - self.m)
        self.v += 0.001 * (gradient * gradient - self.v)
        rate = self.rate * np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t)
        weights -= rate * self.m / (np.sqrt(self.v) + 1e-8)
