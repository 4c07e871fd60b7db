"""Exact most similar catalog records by a Voronoi join of their embeddings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from leafscribe.llm.common import bound_batches, pin

#: Pivots, drawn by a hash of the records; every record belongs to the cell of its closest pivot.
PIVOTS = 96
#: Queries of a group that are held together in a task.
GROUP_QUERIES = 8192
#: Records of a block that meet a group of queries in one task, at least.
BLOCK_RECORDS = 16_384
#: Numbers of a score table that is held at once.
SCORES = 1 << 21
#: Relative slack of distances in doubles; the scores themselves are exact.
SLACK = 1e-9


def _packed(units: np.ndarray) -> bytes:
    """Integers in the fewest bytes: 2, 4 or 8 each; the first byte tells how many."""
    most = int(np.abs(units).max(initial=0))
    width = 2 if most < 1 << 15 else 4 if most < 1 << 31 else 8
    return bytes([width]) + units.astype(f"<i{width}").tobytes()


def _matrix(column, size: int) -> np.ndarray:
    """The packed vectors as rows; shorter ones are padded with zeros."""
    out = np.zeros((len(column), size), np.int64)
    for i, value in enumerate(column.to_pylist()):
        units = np.frombuffer(value, f"<i{value[0]}", offset=1)
        out[i, : len(units)] = units
    return out


def _coded(scale: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Valid vectors as integers."""
        for batch in batches:
            keep, units, sizes, squares, most = [], [], [], [], []
            for i, vector in enumerate(batch["embedding"]):
                if not vector.is_valid or vector.values.null_count:
                    continue
                scaled = vector.values.to_numpy(zero_copy_only=False).astype(np.float64) * scale
                if not np.isfinite(scaled).all():
                    continue
                if np.abs(scaled).max(initial=0) >= 2.0**62:
                    raise ValueError("a component times the scale must fit a 64-bit integer")
                whole = np.floor(scaled).astype(np.int64)
                keep.append(i)
                units.append(_packed(whole))
                sizes.append(len(whole))
                squares.append(float((whole.astype(np.float64) ** 2).sum()))
                most.append(int(np.abs(whole).max(initial=0)))
            rows = batch.take(pa.array(keep, pa.int64()))
            columns = [rows["reference_code"], rows["wanted"], pa.array(units, pa.binary())]
            columns += [pa.array(sizes, pa.int32()), pa.array(squares, pa.float64()), pa.array(most, pa.int64())]
            yield pa.record_batch(columns, ["reference_code", "wanted", "units", "size", "square", "most"])

    return run


def _distances(points: np.ndarray, lift: np.ndarray, centres: np.ndarray, raised: np.ndarray) -> np.ndarray:
    """Distances between points and centres that have one further coordinate, `lift` and `raised`."""
    points, centres = points.astype(np.float64), centres.astype(np.float64)
    square = (points**2).sum(1)[:, None] + (centres**2).sum(1)[None, :] - 2 * points @ centres.T
    return np.sqrt(np.maximum(square + (lift[:, None] - raised[None, :]) ** 2, 0))


class Space:
    """Records with a further coordinate that brings them all to the length of the longest; queries have zero there.

    The closer a record is to a query there, the larger is their inner product.
    """

    def __init__(self, pivots: np.ndarray, square: float):
        self.pivots, self.size, self.square = pivots, pivots.shape[1], square
        self.raised = self.lift(pivots)
        self.slack = 1.0 + SLACK * square

    def lift(self, points: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(self.square - (points.astype(np.float64) ** 2).sum(1), 0))

    def to_pivots(self, records: np.ndarray) -> np.ndarray:
        return _distances(records, self.lift(records), self.pivots, self.raised)

    def to_centres(self, records: np.ndarray) -> np.ndarray:
        """From records to the pivots taken as queries."""
        return _distances(records, self.lift(records), self.pivots, np.zeros(len(self.pivots)))

    def queries_to_pivots(self, queries: np.ndarray) -> np.ndarray:
        return _distances(queries, np.zeros(len(queries)), self.pivots, self.raised)

    def queries_to_centres(self, queries: np.ndarray) -> np.ndarray:
        zero = np.zeros(len(queries))
        return _distances(queries, zero, self.pivots, np.zeros(len(self.pivots)))


def _chunks(batch: pa.RecordBatch, size: int) -> Iterator[pa.RecordBatch]:
    step = max(1, SCORES // max(size, 1))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


def _cells(space: Space):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The cell of each record and its distance to the pivot."""
        for batch in batches:
            for rows in _chunks(batch, max(space.size, len(space.pivots))):
                far = space.to_pivots(_matrix(rows["units"], space.size))
                cell = far.argmin(1)
                found = [pa.array(cell.astype(np.int32)), pa.array(far[np.arange(len(cell)), cell])]
                yield pa.record_batch([*rows.columns, *found], [*rows.schema.names, "cell", "distance"])

    return run


def _products(queries: np.ndarray, records: np.ndarray) -> np.ndarray:
    """Exact inner products."""
    most = int(np.abs(queries).max(initial=0)) * int(np.abs(records).max(initial=0)) * queries.shape[1]
    if most < 1 << 53:
        return (queries.astype(np.float64) @ records.astype(np.float64).T).astype(np.int64)
    if most < 1 << 63:
        return queries @ records.T
    raise ValueError("scores do not fit a 64-bit integer")


def _reached(space: Space, known: np.ndarray, names: np.ndarray, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The cell of each query, a bound on the distance of its k-th record, and how far that is from the cell's centre."""
        for batch in batches:
            for rows in _chunks(batch, max(space.size, len(space.pivots), len(known))):
                queries = _matrix(rows["units"], space.size)
                own = np.array(rows["reference_code"].to_pylist(), object)
                score = _products(queries, known).astype(np.float64)
                score[own[:, None] == names[None, :]] = -np.inf
                if score.shape[1] < k:
                    reach = np.full(len(queries), np.inf)
                else:
                    least = np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k]
                    square = (queries.astype(np.float64) ** 2).sum(1) + space.square - 2 * least
                    reach = np.sqrt(np.maximum(square, 0) + space.slack)
                far = space.queries_to_centres(queries)
                cell = far.argmin(1)
                limit = far[np.arange(len(cell)), cell] + reach
                found = [pa.array(cell.astype(np.int32)), pa.array(reach), pa.array(limit)]
                yield pa.record_batch([*rows.columns, *found], [*rows.schema.names, "cell", "reach", "limit"])

    return run


def _bins(counts: np.ndarray, room: int, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First bin and number of bins of each cell: neighbours share a bin up to `room` rows, a larger cell has several."""
    first, parts = np.zeros(len(counts), np.int64), np.ones(len(counts), np.int64)
    at, held = 0, 0
    for cell in order:
        n = int(counts[cell])
        if n > room:
            at += held > 0
            parts[cell] = -(-n // room)
            first[cell] = at
            at, held = at + int(parts[cell]), 0
            continue
        if held + n > room:
            at, held = at + 1, 0
        first[cell] = at
        held += n
    return first, parts


def _walk(pivots: np.ndarray) -> np.ndarray:
    """The pivots in an order in which each is followed by the closest one that is left."""
    points = pivots.astype(np.float64)
    left, order = list(range(1, len(points))), [0] if len(points) else []
    while left:
        far = ((points[left] - points[order[-1]]) ** 2).sum(1)
        order.append(left.pop(int(far.argmin())))
    return np.array(order, np.int64)


class Layout:
    """Which groups of queries and which blocks of records there are, and which of them must meet."""

    def __init__(self, space: Space, limits, queries, records, radii, group_queries: int, block_records: int):
        order = _walk(space.pivots)
        self.space, self.limits, self.radii = space, limits, radii
        self.group, self.group_parts = _bins(queries, group_queries, order)
        self.block, self.block_parts = _bins(records, block_records, order)
        self.used = np.flatnonzero(queries)

    def groups_of(self, records: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, group) for each group with a query that may have the record among its best."""
        near = self.space.to_centres(records)[:, self.used] <= self.limits[self.used] + self.space.slack**0.5
        return _spread(near, self.group[self.used], self.group_parts[self.used])

    def blocks_of(self, queries: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, block) for each block that may hold one of the best records of the query."""
        far = self.space.queries_to_pivots(queries) - self.radii[None, :]
        near = (far <= reach[:, None] + self.space.slack**0.5) & (self.radii >= 0)
        return _spread(near, self.block, self.block_parts)


def _spread(near: np.ndarray, first: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    bins = np.repeat(first, parts) + np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    row, at = np.nonzero(np.repeat(near, parts, axis=1))
    pairs = np.unique(np.stack([row, bins[at]], 1), axis=0) if len(row) else np.zeros((0, 2), np.int64)
    return pairs[:, 0], pairs[:, 1]


def _own_bin(cell: np.ndarray, salt: np.ndarray, first: np.ndarray, parts: np.ndarray) -> np.ndarray:
    return first[cell] + salt % parts[cell]


def _sent(layout: Layout, query: bool):
    """Rows (group, block, is_record) of queries or records, one for each pair of group and block where they may match."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = max(layout.space.size, len(layout.space.pivots))
        for batch in batches:
            for rows in _chunks(batch, width):
                points = _matrix(rows["units"], layout.space.size)
                cell, salt = rows["cell"].to_numpy(), rows["salt"].to_numpy()
                if query:
                    row, block = layout.blocks_of(points, rows["reach"].to_numpy())
                    group = _own_bin(cell, salt, layout.group, layout.group_parts)[row]
                else:
                    row, group = layout.groups_of(points)
                    block = _own_bin(cell, salt, layout.block, layout.block_parts)[row]
                sent = rows.select(["reference_code", "units"]).take(pa.array(row))
                numbers = [pa.array(group.astype(np.int64)), pa.array(block.astype(np.int64))]
                kind = pa.array(np.full(len(row), 0 if query else 1, np.int32))
                yield pa.record_batch([*numbers, kind, *sent.columns], ["group", "block", "is_record", "reference_code", "units"])

    return run


class _Best:
    """The best records so far of the queries of a group."""

    def __init__(self, names: list, units: list[bytes], size: int, k: int):
        self.names, self.units, self.k = np.array(names, object), units, k
        self.queries = _matrix(pa.array(units, pa.binary()), size)
        self.least = np.full(len(names), np.iinfo(np.int64).min)
        self.row, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.name = np.zeros(0, object)

    def add(self, names: list, records: np.ndarray) -> None:
        names = np.array(names, object)
        step = max(64, SCORES // len(self.names))
        # A short first step raises the least scores before the long ones.
        cuts = [0, *range(min(64, len(names)), len(names), step), len(names)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            score = _products(self.queries, records[a:b])
            row, at = np.nonzero(score >= self.least[:, None])
            other = self.names[row] != names[a + at]
            row, at = row[other], at[other]
            self._merge(row, score[row, at], names[a + at])

    def _merge(self, row, score, name) -> None:
        row, score = np.concatenate([self.row, row]), np.concatenate([self.score, score])
        name = np.concatenate([self.name, name])
        if not len(row):
            return
        order = np.lexsort([np.unique(name, return_inverse=True)[1], -score, row])
        row, score, name = row[order], score[order], name[order]
        start = np.searchsorted(row, row)
        rank = np.arange(len(row)) - start
        kept = rank < self.k
        last = rank == self.k - 1
        self.least[row[last]] = score[last]
        self.row, self.score, self.name = row[kept], score[kept], name[kept]

    def rows(self, kind: pa.DataType) -> pa.RecordBatch:
        found = [
            pa.array(self.names[self.row].tolist(), kind),
            pa.array([self.units[i] for i in self.row], pa.binary()),
            pa.array(self.name.tolist(), kind),
            pa.array(self.score),
        ]
        return pa.record_batch(found, ["query_code", "query_units", "reference_code", "score"])


def _solved(size: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The best records of each query in each block. Rows come by group and block, the queries first, then the records."""
        place, names, units, best, kind = None, [], [], None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            kind = batch["reference_code"].type
            marks = np.stack([batch[c].to_numpy().astype(np.int64) for c in ("group", "block", "is_record")], 1)
            cuts = np.flatnonzero((marks[1:] != marks[:-1]).any(1)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(marks)], strict=True):
                part = batch.slice(int(a), int(b - a))
                if place != tuple(marks[a, :2]):
                    if best is not None:
                        yield best.rows(kind)
                    place, names, units, best = tuple(marks[a, :2]), [], [], None
                if marks[a, 2] == 0:
                    names += part["reference_code"].to_pylist()
                    units += part["units"].to_pylist()
                elif names:
                    best = best or _Best(names, units, size, k)
                    for rows in _chunks(part, size):
                        best.add(rows["reference_code"].to_pylist(), _matrix(rows["units"], size))
        if best is not None:
            yield best.rows(kind)

    return run


def similar_records(
    records: DataFrame,
    wanted: Column,
    k: int = 10,
    scale: float = 1024.0,
    pivots: int = PIVOTS,
    group_queries: int = GROUP_QUERIES,
    block_records: int = BLOCK_RECORDS,
    key: str = "reference_code",
    embedding: str = "embedding",
) -> DataFrame:
    """The `k` catalog records with the largest integer inner product with each wanted record, exactly.

    Every component x counts as floor(scale * x), x as a double. With one further coordinate that brings all records to one length
    (queries have zero there) the largest product is the smallest distance. Pivots, a bounded sample drawn by hash, part records
    and queries into Voronoi cells. The summary of a cell is its number of records, its radius and the k + 1 records closest to its pivot.
    From the summaries' records each query gets a bound on the distance of its k-th best one, and each group of
    query cells the largest reach from its centres. A record is sent only to groups within whose reach it lies, and a query only
    to blocks of records that its bound can touch. Each task compares one group with one block and keeps k records for each query;
    these are merged. Cells with many rows are dealt over several groups or blocks. Pivots and summaries depend on the
    parameters only, not on the number of records; a block has as many records as there are queries, `block_records` at least.

    records: `key` (any type with an order) and `embedding` (array of numbers); `wanted` is true for the queries. Other
    columns are not looked at. Vectors that are null or hold null or non-finite components take no part, neither do records without
    a key. A shorter vector counts as padded with zeros; scores must fit 64 bits, else the job fails. A query's own key is left out;
    repeated rows of other records each take a rank, repeated rows of a query are one query (rows of one key with different vectors are
    queries of their own). Ties go to the smaller key. No records or no queries give no rows.
    Returns `query_code`, `rank` (from 1), `reference_code` and `score` (long); fewer than `k` rows where there are fewer records.
    """
    bound_batches(records.sparkSession)
    rows = records.select(
        F.col(key).alias("reference_code"), F.coalesce(wanted, F.lit(False)).alias("wanted"), F.col(embedding).alias("embedding")
    )
    kind = rows.schema["reference_code"].dataType.simpleString()
    schema = f"reference_code {kind}, wanted boolean, units binary, size int, square double, most long"
    coded = pin(rows.where("reference_code IS NOT NULL").mapInArrow(_coded(scale), schema))
    most = coded.agg(F.max("size").alias("size"), F.max("square").alias("square")).first()
    size, square = most["size"] or 0, most["square"] or 0.0
    drawn = coded.select("units").orderBy(F.xxhash64("reference_code", "units")).limit(pivots).distinct().toArrow()
    centres = np.unique(_matrix(drawn["units"], size), axis=0) if drawn.num_rows else np.zeros((1, size), np.int64)
    space = Space(centres, square)
    codes = coded.select("reference_code", "wanted", "units")
    celled = pin(codes.mapInArrow(_cells(space), StructType.fromDDL(f"reference_code {kind}, wanted boolean, units binary, cell int, distance double")))
    by_distance = Window.partitionBy("cell").orderBy("distance", "reference_code")
    closest = celled.withColumn("n", F.row_number().over(by_distance)).where(F.col("n") <= k + 1)
    closest = closest.select("reference_code", "units").toArrow()
    # One entry of a key: bounds count different records.
    names, at = np.unique(np.array(closest["reference_code"].to_pylist(), object), return_index=True)
    known = _matrix(closest["units"].combine_chunks().take(pa.array(at)), size) if len(names) else np.zeros((0, size), np.int64)
    queries = celled.where("wanted").select("reference_code", "units").dropDuplicates()
    reached = f"reference_code {kind}, units binary, cell int, reach double, limit double"
    queries = pin(queries.mapInArrow(_reached(space, known, names, k), reached))
    cells = len(centres)
    counts, radii = np.zeros(cells, np.int64), np.full(cells, -1.0)
    for r in celled.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("radius")).collect():
        counts[r["cell"]], radii[r["cell"]] = r["n"], r["radius"]
    asked, limits = np.zeros(cells, np.int64), np.full(cells, -np.inf)
    for r in queries.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("limit").alias("limit")).collect():
        asked[r["cell"]], limits[r["cell"]] = r["n"], r["limit"]
    layout = Layout(space, limits, asked, counts, radii, group_queries, max(block_records, int(asked.sum())))
    salt = F.pmod(F.xxhash64("reference_code", "units"), F.lit(1 << 30).cast("long")).alias("salt")
    # Repeated rows of one record are dealt apart by where they lie.
    apart = F.pmod(F.xxhash64("reference_code", "units", F.monotonically_increasing_id()), F.lit(1 << 30).cast("long")).alias("salt")
    sent = f"group long, block long, is_record int, reference_code {kind}, units binary"
    asked_rows = queries.select("reference_code", "units", "cell", "reach", salt).mapInArrow(_sent(layout, True), sent)
    record_rows = celled.select("reference_code", "units", "cell", apart).mapInArrow(_sent(layout, False), sent)
    met = asked_rows.unionByName(record_rows).repartition("group", "block").sortWithinPartitions("group", "block", "is_record")
    result = f"query_code {kind}, query_units binary, reference_code {kind}, score long"
    found = met.mapInArrow(_solved(size, k), result)
    ranked = Window.partitionBy("query_code", "query_units").orderBy(F.desc("score"), F.asc("reference_code"))
    found = found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
    return found.select("query_code", "rank", "reference_code", "score")
