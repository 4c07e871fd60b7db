"""Exact cosine search for many query vectors at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leafscribe.session import bound_batches

#: Queries that meet the table in one pass, numbers of a score table held at once, rows of the first step of a task.
PASS, SCORES, FIRST = 4096, 1 << 19, 64
#: Share of the dimensions that is multiplied for every pair; the rest only where the bound allows a hit.
HEAD = 0.25
SLACK = 1e-9


def _vectors(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, matrix) of the vectors that have this size, no null or non-finite component and are not all zero."""
    lengths = np.array(pc.fill_null(pc.list_value_length(column), -1))
    at = np.flatnonzero(lengths == size)
    kept = column.take(pa.array(at))
    flat = kept.flatten() if len(at) else pa.array([], pa.float64())
    matrix = flat.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(at), size)
    good = np.isfinite(matrix).all(1) & (matrix != 0).any(1)
    return at[good], np.ascontiguousarray(matrix[good])


class _Queries:
    """Query vectors of unit length, cut into head and tail; the largest possible rest of a product is that of the tails' lengths."""

    def __init__(self, names: list, matrix: np.ndarray, k: int):
        self.names, self.k = names, k
        self.norms = np.sqrt((matrix**2).sum(1))
        self.matrix = matrix
        self.cut = max(1, int(matrix.shape[1] * HEAD))
        unit = matrix / self.norms[:, None]
        self.head, self.tail = unit[:, : self.cut], np.sqrt((unit[:, self.cut :] ** 2).sum(1))

    def near(self, unit: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(queries, rows) of the pairs whose cosine may reach the query's least score."""
        # Cauchy-Schwarz on the tails bounds the cosine from above.
        bound = self.head @ unit[:, : self.cut].T
        bound += self.tail[:, None] * np.sqrt((unit[:, self.cut :] ** 2).sum(1))[None, :]
        open_ = bound >= (least - SLACK)[:, None]
        i, j = np.flatnonzero(open_.any(1)), np.flatnonzero(open_.any(0))
        # Rows and queries with open pairs are multiplied as a whole: pairs are listed only if they reach the score.
        product = (self.matrix[i] / self.norms[i, None]) @ unit[j].T
        x, y = np.nonzero(product >= (least[i] - SLACK)[:, None])
        return i[x], j[y]


class _Best:
    """The `k` best rows so far of each query."""

    def __init__(self, queries: int, k: int):
        self.k = k
        #: Score and key of each query's k-th best row.
        self.least, self.last = np.full(queries, -np.inf), None
        self.row, self.score, self.keys = np.zeros(0, np.int64), np.zeros(0), None

    def add(self, row: np.ndarray, score: np.ndarray, keys: np.ndarray) -> None:
        if self.keys is None:
            self.last, self.keys = np.zeros(len(self.least), keys.dtype), keys[:0]
        # Of rows as good as the k-th best only those with smaller keys come in.
        kept = ~(score < self.least[row])
        tied = np.flatnonzero(score == self.least[row])
        kept[tied] = (keys[tied] < self.last[row[tied]]).astype(bool)
        row, score, keys = row[kept], score[kept], keys[kept]
        if not len(row):
            return
        # Only queries with new rows are ranked again.
        again = np.zeros(len(self.least), bool)
        again[row] = True
        old = again[self.row]
        row, score = np.concatenate([self.row[old], row]), np.concatenate([self.score[old], score])
        keys = np.concatenate([self.keys[old], keys])
        order = np.lexsort([np.unique(keys, return_inverse=True)[1], -score, row])
        row, score, keys = row[order], score[order], keys[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        end, kept = rank == self.k - 1, rank < self.k
        self.least[row[end]], self.last[row[end]] = score[end], keys[end]
        self.row, self.score = np.concatenate([self.row[~old], row[kept]]), np.concatenate([self.score[~old], score[kept]])
        self.keys = np.concatenate([self.keys[~old], keys[kept]])


def _steps(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """The rows in slices of at most `most`; a short first one raises the least scores before the long ones."""
    step = FIRST
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            yield batch.slice(at, step)
            at, step = at + step, most


def _searched(queries: _Queries, kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The `k` best rows of this task for each query. Besides `k` rows a query, tables of `SCORES` numbers are held."""
        m, size = queries.matrix.shape
        best = _Best(m, queries.k)
        pairs = SCORES // size + 1
        for part in _steps(batches, max(FIRST, SCORES // max(m, size))):
            at, matrix = _vectors(part["vector"], size)
            names = part["key"].take(pa.array(at))
            whole = pa.types.is_integer(names.type)
            names = names.to_numpy().astype(np.int64) if whole else np.array(names.to_pylist(), object)
            norms = np.sqrt((matrix**2).sum(1))
            i, j = queries.near(matrix / norms[:, None], best.least)
            for x in range(0, len(i), pairs):
                a, b = i[x : x + pairs], j[x : x + pairs]
                dot = np.einsum("ij,ij->i", queries.matrix[a], matrix[b])
                best.add(a, dot / (norms[b] * queries.norms[a]), names[b])
        named = [queries.names[i] for i in best.row]
        keys = [] if best.keys is None else best.keys.tolist()
        yield pa.record_batch([pa.array(named, pa.string()), pa.array(keys, kind), pa.array(best.score)], ["query", "key", "score"])

    return run


def _passes(queries: DataFrame, most: int) -> Iterator[pa.Table]:
    """The queries in tables of at most `most` rows, by ranges of their names."""
    last = None
    while True:
        rest = queries if last is None else queries.where(F.col("query") > last)
        table = rest.orderBy("query").limit(most).toArrow()
        if table.num_rows:
            yield table
        if table.num_rows < most:
            return
        last = table["query"][-1].as_py()


def vector_search_batch(
    table: DataFrame, queries: DataFrame, k: int, vector: str = "embedding", key: str = "vec_id", most: int = PASS
) -> DataFrame:
    """The `k` rows with the largest cosine for each query of a table, exactly.

    queries: `query` (unique text) and `vector`. Up to `most` of them go to every task and meet the whole table in one pass; more
    queries take more passes. A slice of rows is multiplied with all queries at once, over the first quarter of the
    dimensions; the lengths of the rest bound the cosine, and only queries and rows with a bound that reaches a k-th best so far are multiplied
    out. Each task returns `k` rows a query, and these are merged. A task holds one pass' queries, `k` rows for each and tables of
    `SCORES` numbers, however large the table is.

    Null and zero vectors, and those with null or non-finite components or another size than the query, have no cosine. Ties go to the smaller key.
    Returns `query`, `rank`, the key and `score`.
    """
    bound_batches(table.sparkSession)
    rows = table.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(vector).alias("vector"))
    field = rows.schema["key"]
    schema = f"query string, key {field.dataType.simpleString()}, score double"
    found = table.sparkSession.createDataFrame([], schema)
    asked = queries.where("query IS NOT NULL AND vector IS NOT NULL").select("query", "vector")
    for part in _passes(asked, most):
        sizes = np.array(pc.list_value_length(part["vector"].combine_chunks()))
        for size in np.unique(sizes[sizes > 0]).tolist():
            at, matrix = _vectors(part["vector"].combine_chunks(), size)
            if len(at):
                names = part["query"].combine_chunks().take(pa.array(at)).to_pylist()
                kind = pa.string() if field.dataType.simpleString() == "string" else pa.int64()
                found = found.unionByName(rows.mapInArrow(_searched(_Queries(names, matrix, k), kind), schema))
    best = Window.partitionBy("query").orderBy(F.desc("score"), F.asc("key"))
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query", "rank", F.col("key").alias(key), "score")
