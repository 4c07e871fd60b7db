"""Benchmark passages in page texts, found with suffix arrays over the pages."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafscribe.llm.common import bound_batches, pin, slices

#: Consecutive words of one window; an item of fewer words is one window itself.
WINDOW = 10
#: UTF-8 bytes of benchmark text that are searched at once; more is searched block after block.
BLOCK_BYTES = 8 << 20

# ASCII letters are lower-cased; every other ASCII character that is no digit parts words.
_WORDS = bytes(
    b if b >= 128 or chr(b).isdigit() or chr(b).islower() else b + 32 if 65 <= b <= 90 else 32 for b in range(256)
)


def words(text: str) -> list[bytes]:
    """Words of a text: runs of ASCII letters and digits (lower-cased) and of characters beyond ASCII."""
    return text.encode("utf-8", "surrogatepass").translate(_WORDS).split()


@dataclass
class Benchmark:
    """One block of items: numbered words and, by length, the distinct windows and the items that hold them."""

    item_ids: list
    number: dict[bytes, int] = field(default_factory=dict)
    windows: dict[int, np.ndarray] = field(default_factory=dict)
    #: By length, (window, item) pairs sorted by window, and codes of windows that follow each other in an item.
    holders: dict[int, np.ndarray] = field(default_factory=dict)
    following: dict[int, np.ndarray] = field(default_factory=dict)

    @classmethod
    def of(cls, rows: list[tuple], window: int) -> Benchmark:
        self = cls([r[0] for r in rows])
        listed: dict[int, list] = {}
        for item, (_, text) in enumerate(rows):
            ids = [self.number.setdefault(w, len(self.number) + 1) for w in words(text or "")]
            width = min(window, len(ids))
            if width:
                own = np.lib.stride_tricks.sliding_window_view(np.array(ids, np.int32), width)
                listed.setdefault(width, []).append((item, own))
        for width, parts in listed.items():
            distinct, inverse = np.unique(np.concatenate([w for _, w in parts]), axis=0, return_inverse=True)
            inverse = inverse.ravel()
            item = np.repeat([i for i, _ in parts], [len(w) for _, w in parts])
            self.windows[width] = distinct
            self.holders[width] = np.unique(np.stack([inverse, item], 1), axis=0)
            next_to = item[:-1] == item[1:]
            self.following[width] = np.unique((inverse[:-1] * len(distinct) + inverse[1:])[next_to])
        return self


class SuffixArray:
    """The suffixes of a shard's word numbers in order, by their first `depth` words.

    Number 0 ends a document and stands for every word that no item has. Stretches between zeros with fewer than
    `shortest` words cannot hold a match and are left out.
    """

    def __init__(self, numbers: np.ndarray, shortest: int, depth: int):
        held = np.diff((numbers != 0).astype(np.int8), prepend=0, append=0)
        begin, end = np.flatnonzero(held == 1), np.flatnonzero(held == -1)
        long_enough = end - begin >= max(shortest, 1)
        begin, end = begin[long_enough], end[long_enough]
        size = end - begin + 1  # with the zero behind
        total = int(size.sum())
        first = np.cumsum(size) - size
        self.position = np.arange(total) + np.repeat(begin - first, size)
        self.numbers = np.concatenate([numbers[self.position], np.zeros(depth, numbers.dtype)])
        room = np.repeat(first + size - 1, size) - np.arange(total)
        starts = np.flatnonzero(room >= max(shortest, 1))
        self.order = starts
        if not len(starts):
            return
        # Ranks of 1, 2, 4, ... words; the words left over by an overlapping rank of the same width.
        rank, covered = self.numbers.astype(np.int64), 1
        while covered * 2 <= depth:
            pair = rank[:-covered] * (int(rank.max()) + 1) + rank[covered:]
            rank = np.concatenate([np.unique(pair, return_inverse=True)[1], np.zeros(covered, np.int64)])
            covered *= 2
        self.order = starts[np.lexsort([rank[starts + depth - covered], rank[starts]])]

    def ranges(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each pattern the range of suffixes that begin with it: a binary search for all at once."""
        low = np.zeros(len(patterns), np.int64)
        high = np.full(len(patterns), len(self.order), np.int64)
        for at in range(patterns.shape[1]):
            # Suffixes in the range agree so far and are in the order of the word at `at`.
            low, high = (self._bound(low, high, at, patterns[:, at], after) for after in (False, True))
        return low, high

    def _bound(self, low, high, at, wanted, after) -> np.ndarray:
        low, high = low.copy(), high.copy()
        active = np.flatnonzero(low < high)
        while len(active):
            middle = (low[active] + high[active]) // 2
            seen = self.numbers[self.order[middle] + at]
            right = seen <= wanted[active] if after else seen < wanted[active]
            low[active[right]] = middle[right] + 1
            high[active[~right]] = middle[~right]
            active = active[low[active] < high[active]]
        return low

    def occurrences(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pattern, position) of every place where a pattern begins."""
        low, high = self.ranges(patterns)
        found = high - low
        pattern = np.repeat(np.arange(len(patterns)), found)
        step = np.arange(len(pattern)) - np.repeat(np.cumsum(found) - found, found)
        return pattern, self.position[self.order[low[pattern] + step]]


def _runs(pattern: np.ndarray, at: np.ndarray, following: np.ndarray, n_patterns: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and numbers of windows of the stretches in which window follows window as in an item."""
    order = np.argsort(at)
    pattern, at = pattern[order], at[order]
    code = pattern[:-1] * n_patterns + pattern[1:]
    joined = (np.diff(at) == 1) & np.isin(code, following)
    first = np.flatnonzero(np.concatenate([[True], ~joined]))
    return at[first], np.diff(first, append=len(at))


def _search_shard(benchmark: Benchmark, window: int, texts: list[str]):
    """Per text: number of words, words hit, items found, and the longest stretch taken from an item."""
    cut = [words(t) for t in texts]
    counts = np.array([len(c) for c in cut], np.int64)
    starts = np.concatenate([[0], np.cumsum(counts + 1)])
    numbers = np.zeros(int(starts[-1]), np.int32)
    get = benchmark.number.get
    for own, s in zip(cut, starts, strict=False):
        numbers[s : s + len(own)] = [get(w, 0) for w in own]
    array = SuffixArray(numbers, min(benchmark.windows, default=1), window)
    hit = np.zeros(len(numbers) + 1, np.int64)
    longest = np.zeros(len(texts), np.int64)
    pairs = []
    for width, patterns in benchmark.windows.items():
        pattern, at = array.occurrences(patterns)
        if not len(at):
            continue
        np.add.at(hit, at, 1)
        np.add.at(hit, at + width, -1)
        first, run = _runs(pattern, at, benchmark.following[width], len(patterns))
        np.maximum.at(longest, np.searchsorted(starts, first, side="right") - 1, run + width - 1)
        # Items of each document: distinct (document, window), then the items that hold the window.
        seen = np.unique(np.stack([np.searchsorted(starts, at, side="right") - 1, pattern], 1), axis=0)
        holders = benchmark.holders[width]
        low = np.searchsorted(holders[:, 0], seen[:, 1], side="left")
        size = np.searchsorted(holders[:, 0], seen[:, 1], side="right") - low
        step = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        item = holders[np.repeat(low, size) + step, 1]
        pairs.append(np.unique(np.stack([np.repeat(seen[:, 0], size), item], 1), axis=0))
    covered = np.cumsum(hit[:-1]) > 0
    maps = [covered[s : s + n] for s, n in zip(starts, counts, strict=False)]
    items: list[set] = [set() for _ in texts]
    for doc, item in np.concatenate(pairs).tolist() if pairs else []:
        items[doc].add(benchmark.item_ids[item])
    return counts, maps, items, longest


_STATE = "n_words long, hits binary, items array<string>, longest long"


def _search(block, window: int, first: bool, last: bool):
    """Arrow-batch function that adds one block's finds to those of the blocks before."""
    held: list[Benchmark] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not held:
            held.append(Benchmark.of(block.value, window))
        for batch in batches:
            for start, texts in slices(batch["text"]):
                counts, maps, items, longest = _search_shard(held[0], window, texts)
                rows = batch.slice(start, len(texts))
                if not first:
                    for i, (old, names) in enumerate(zip(rows["hits"].to_pylist(), rows["items"].to_pylist(), strict=True)):
                        maps[i] = maps[i] | np.unpackbits(np.frombuffer(old, np.uint8))[: counts[i]].astype(bool)
                        items[i].update(names)
                    longest = np.maximum(longest, rows["longest"].to_numpy())
                columns = {"doc_id": rows["doc_id"]} | ({} if last else {"text": pa.array(texts)})
                columns |= {
                    "n_words": pa.array(counts),
                    "hits": pa.array([np.packbits(m).tobytes() for m in maps], pa.binary()),
                    "items": pa.array([sorted(i) for i in items], pa.list_(pa.string())),
                    "longest": pa.array(longest),
                }
                if last:
                    columns["hits"] = pa.array([int(m.sum()) for m in maps], pa.int64())
                yield pa.record_batch(list(columns.values()), list(columns))

    return run


def benchmark_leaks(
    pages: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """Pages that repeat passages of benchmark items, word for word.

    Each shard of pages (a bounded run of whole texts) gets a suffix array over its words. Every window of `window`
    words of an item, or a whole shorter item, is looked up there by binary search, which gives all places
    where it begins; adjoining windows join to the longest verbatim match. A page is a whole in one shard, so no
    page is shuffled. The benchmark goes to the shards in blocks of about `block_bytes` of text, one after another.

    Words are runs of ASCII letters (lower-cased), digits and characters beyond ASCII.
    pages: `doc_id`, `text` (null: no words). benchmark: `item_id`, `text`; items without words match nothing, rows
    that repeat an item_id count as one item, a null item_id is named by an empty string. Other columns are not
    looked at. Repeated pages give a row each. Returns per page `doc_id`, `n_words`, `n_hit` (words inside any
    occurrence of a window), `n_items` (items with occurring windows), `items_sha256` (of the item ids, sorted
    as strings and joined by commas), `contaminated` (n_hit > 0), `items` (those ids), `longest` (words of the longest
    verbatim match).
    """
    spark = pages.sparkSession
    bound_batches(spark)
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = 1 + size // block_bytes
    kind = dict(pages.dtypes)["doc_id"]
    found = pages.select("doc_id", "text")
    for k in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k)
        block = spark.sparkContext.broadcast([tuple(r) for r in own.collect()])
        last = k == blocks - 1
        schema = f"doc_id {kind}, " + ("" if last else "text string, ") + _STATE
        if last:
            schema = schema.replace("hits binary", "hits long")
        # One block at a time: an executor never holds two.
        found = found.mapInArrow(_search(block, window, k == 0, last), schema)
        found = found if last else pin(found)
    joined = F.array_join("items", ",")
    return found.select(
        "doc_id",
        "n_words",
        F.col("hits").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(joined, 256).alias("items_sha256"),
        (F.col("hits") > 0).alias("contaminated"),
        "items",
        "longest",
    )
