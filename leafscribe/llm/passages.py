"""Long passages that page texts share, found in a de Bruijn graph of their words."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafscribe.llm.common import bound_batches, copied, pin, slices

#: Words of the shortest repeated passage, and words of the k-mers by which the graph is dealt out.
WINDOW = 35
KMER = 8

#: Repeated k-mers (one number each) that may be copied to every executor; more of them are joined by a shuffle.
COPIED_NODES = 2_000_000

_PLACE = 24  # bits of a k-mer's place that stand beside its hash
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One 64-bit hash of two, in order."""
    x = (a * _A) ^ ((b * _B) + (a >> np.uint64(29)))
    x ^= x >> np.uint64(32)
    x *= _B
    return x ^ (x >> np.uint64(29))


def joined_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of `width` words, from the hashes of runs of 1, 2, 4, ... words."""
    result, done, power, size = None, 0, hashes, 1
    while True:
        if width & size:
            n = len(hashes) - width + 1
            own = power[done : done + n]
            result = own.copy() if result is None else mix(result[:n], own)
            done += size
        if done == width:
            return result
        power = mix(power[:-size], power[size:])
        size *= 2


def _lowest(keys: np.ndarray, width: int) -> np.ndarray:
    """Least key of every run of `width` keys."""
    n, size = len(keys) - width + 1, 1
    while 2 * size <= width:
        keys = np.minimum(keys[:-size], keys[size:])
        size *= 2
    return np.minimum(keys[:n], keys[width - size : width - size + n])


def word_hashes(texts: list[str], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts one after the other, and the number of words of each."""
    number: dict[bytes, int] = {}
    found, counts = [], []
    for text in texts:
        data = text.encode("utf-8", "surrogatepass")
        own = (data.lower() if lower else data).split()
        counts.append(len(own))
        found.append(np.array([number.setdefault(w, len(number)) for w in own], np.int64))
    table = np.array([xxhash.xxh64_intdigest(w) for w in number], np.uint64)
    return table[np.concatenate(found)] if number else np.zeros(0, np.uint64), np.array(counts, np.int64)


def paths(texts: list[str], window: int, kmer: int):
    """Cuts each text's walk through the graph into paths that share one lowest k-mer.

    An edge of the graph is a run of `window` words. Equal edges hold the same lowest k-mer at the same place, so all
    edges that can be equal meet under that k-mer's hash. Returns per path: row of its text, first word, number of
    edges, hash of the k-mer, hash of the whole path; and the hashes of all edges, path after path.
    """
    hashes, counts = word_hashes(texts)
    inside = np.maximum(counts - window + 1, 0)
    if not inside.sum():
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, empty.view(np.uint64), empty.view(np.uint64), empty.view(np.uint64)
    first_word = np.cumsum(counts) - counts
    row = np.repeat(np.arange(len(texts)), inside)
    at = np.arange(len(row)) - np.repeat(np.cumsum(inside) - inside, inside) + first_word[row]
    kmers, edges = joined_hashes(hashes, kmer), joined_hashes(hashes, window)[at]
    mask = np.uint64((1 << _PLACE) - 1)
    keys = (kmers & ~mask) | (np.arange(len(kmers), dtype=np.uint64) & mask)
    lowest = (_lowest(keys, window - kmer + 1)[at] & mask).astype(np.int64)
    place = at + ((lowest - at) & int(mask))
    starts = np.flatnonzero(np.concatenate([[True], (np.diff(place) != 0) | (np.diff(row) != 0)]))
    size = np.diff(starts, append=len(at))
    # A path is never longer than two edges overlap, so its first and last edge tell all its words.
    whole = mix(mix(edges[starts], edges[starts + size - 1]), size.astype(np.uint64))
    return row[starts], at[starts] - first_word[row[starts]], size, kmers[place[starts]], whole, edges


def _cut(window: int, kmer: int, with_edges: bool, with_place: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in slices(batch["text"]):
                row, start, size, key, whole, edges = paths(texts, window, kmer)
                columns = {"node": pa.array(key.view(np.int64))}
                if with_edges or with_place:
                    columns |= {"path": pa.array(whole.view(np.int64)), "size": pa.array(size)}
                if with_place:
                    own, row = batch.slice(first, len(texts)), pa.array(row)
                    columns |= {"doc_id": own["doc_id"].take(row), "digest": own["digest"].take(row)}
                    columns["start"] = pa.array(start)
                if with_edges:
                    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
                    columns["edges"] = pa.ListArray.from_arrays(pa.array(offsets), pa.array(edges.view(np.int64)))
                yield pa.record_batch(list(columns.values()), list(columns))

    return run


def repeated_paths(pages: DataFrame, window: int, kmer: int) -> DataFrame:
    """Places of repeated edges: `doc_id`, `digest`, `start`, `size` and `hits` (null: the whole path).

    Paths that meet under one k-mer and are all equal do not branch: they stay whole, whatever their number.
    Where different paths meet, the distinct ones are taken apart into edges, which are counted one by one.
    """
    kind = dict(pages.dtypes)["doc_id"]
    nodes = pages.select("text").mapInArrow(_cut(window, kmer, False, False), "node long")
    again = pin(nodes.groupBy("node").count().where("count > 1").select("node"))
    places = pages.mapInArrow(
        _cut(window, kmer, False, True), f"node long, path long, size long, doc_id {kind}, digest long, start long"
    )
    paths_ = pages.mapInArrow(_cut(window, kmer, True, False), "node long, path long, size long, edges array<long>")
    again_few = copied(again, COPIED_NODES)
    # Texts are cut once more instead of keeping the edges of every path on disk.
    distinct = paths_.join(again_few, "node", "left_semi").groupBy("node", "path")
    distinct = pin(distinct.agg(F.count(F.lit(1)).alias("n"), F.first("edges").alias("edges")))
    # A path that occurs twice is repeated as a whole; the edges of a single one may be in other paths of its node.
    branching = distinct.groupBy("node").count().where("count > 1").select("node")
    edges = distinct.join(branching, "node").select("node", "path", "n", F.posexplode("edges").alias("i", "edge"))
    twice = edges.groupBy("node", "edge").agg(F.sum("n").alias("n")).where("n > 1").select("node", "edge")
    single = edges.where("n = 1").join(twice, ["node", "edge"])
    hits = single.groupBy("node", "path").agg(F.collect_list("i").alias("hits"))
    whole = distinct.where("n > 1").select("node", "path", F.lit(None).cast("array<int>").alias("hits"))
    marked = pin(whole.unionByName(hits))
    return places.join(again_few, "node", "left_semi").join(copied(marked), ["node", "path"])


def _ranges(window: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """First words and ends of the stretches that a page's repeated edges cover."""
        for batch in batches:
            found = []
            for spans in batch["spans"]:
                at = []
                for span in spans.as_py():
                    at += [span["start"] + i for i in (range(span["size"]) if span["hits"] is None else span["hits"])]
                at = np.unique(np.array(at, np.int64))
                new = np.flatnonzero(np.diff(at, prepend=-window - 2) > window)
                ends = np.concatenate([at[new[1:] - 1], at[-1:]]) + window
                found.append(np.stack([at[new], ends], 1).ravel().tolist())
            yield pa.record_batch(
                [batch["doc_id"], batch["digest"], pa.array(found, pa.list_(pa.int64()))], ["doc_id", "digest", "ranges"]
            )

    return work


def _strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_words, n_removed, digests, kept_texts = [], [], [], []
        for text, ranges in zip(batch["text"], batch["ranges"], strict=True):
            own = (text.as_py() or "").encode("utf-8", "surrogatepass").split()
            n_words.append(len(own))
            bounds = ranges.as_py() or []
            for begin, end in zip(reversed(bounds[::2]), reversed(bounds[1::2]), strict=True):
                del own[begin:end]
            kept = b" ".join(own)
            n_removed.append(n_words[-1] - len(own))
            digests.append(hashlib.sha256(kept).hexdigest())
            kept_texts.append(kept.decode("utf-8", "surrogatepass"))
        columns = [batch["doc_id"], pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())]
        yield pa.record_batch(
            [*columns, pa.array(digests, pa.string()), pa.array(kept_texts, pa.string())],
            ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"],
        )


def without_repeats(pages: DataFrame, window: int = WINDOW, kmer: int = KMER) -> DataFrame:
    """Page texts without the words of passages that occur again, in another page or the same one.

    A passage is `window` consecutive words of one page; every word covered by one whose word sequence also starts
    anywhere else is removed, all occurrences alike. The passages are the edges of a de Bruijn graph. Each text's
    walk is cut into paths under their lowest k-mer (`kmer` words), and paths under a k-mer that occurs only once are
    dropped. Paths that repeat without branching are compacted, only branching ones are taken apart, and the joins
    back to the source coordinates (page and word) give the spans. Edges are equal if two 64-bit hashes, of the k-mer
    and of all words, are.

    pages: `doc_id`, `text` (null: no words); other columns are not looked at. Words are what ASCII white space parts.
    Returns per page `doc_id`, `n_words`, `n_removed`, `kept_sha256` (of the kept words joined by one space) and
    `kept_text`. Repeated rows give a row each and count as copies of each other; no pages give no rows.
    """
    bound_batches(pages.sparkSession)
    kmer = min(kmer, window)
    rows = pages.select("doc_id", "text", F.xxhash64("text").alias("digest"))
    found = repeated_paths(rows, window, kmer)
    # A page's own spans, no more than it has words, joined to few ranges.
    spans = found.groupBy("doc_id", "digest").agg(F.collect_list(F.struct("start", "size", "hits")).alias("spans"))
    kind = dict(rows.dtypes)["doc_id"]
    ranges = pin(spans.mapInArrow(_ranges(window), f"doc_id {kind}, digest long, ranges array<long>"))
    ranges = ranges.withColumnsRenamed({"doc_id": "_doc_id", "digest": "_digest"})
    longest = ranges.agg(F.sum(F.size("ranges"))).first()[0] or 0
    side = copied(ranges) if longest <= COPIED_NODES else ranges
    same = rows["doc_id"].eqNullSafe(side["_doc_id"]) & (rows["digest"] == side["_digest"])
    joined = rows.join(side, same, "left").select("doc_id", "text", "ranges")
    schema = f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string, kept_text string"
    return joined.mapInArrow(_strip, schema)
