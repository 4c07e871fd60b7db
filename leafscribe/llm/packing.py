"""Packing page texts into token sequences of one length, best fit first."""

from __future__ import annotations

import json
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafscribe.llm.common import per_slice, pin, plain

#: Tokens of one sequence, and the id put after each text.
LENGTH = 2048
END_ID = 1
#: Pieces that one task packs on average.
SHARD_PIECES = 20_000

#: Characters of a very long text that are encoded at once.
LONG_CHARS = 1 << 18

#: A space alone between two other characters: no token reaches across it from the left.
_SAFE = re.compile(r"(?<=\S) (?=\S)")
#: How byte-level vocabularies of this family cut texts before merging (fixed by the public vocabulary).
_CUT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_of() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary file: itself if printable."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class TokenIds:
    """Ids of whole texts for a byte-level vocabulary file, as the tokenizers library gives them.

    Such a file lists its merges in the order of the ids, so its ids are the ranks by which the (faster) tiktoken
    merges the same pieces; a file in another order is refused. Strings of added tokens are single ids.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        merged = [m if isinstance(m, str) else " ".join(m) for m in model["merges"]]
        ids = [model["vocab"][m.replace(" ", "")] for m in merged]
        if ids != sorted(ids):
            raise ValueError(f"{path}: the merges are not in the order of their ids")
        byte_of = _byte_of()
        ranks = {bytes(byte_of[c] for c in t): i for t, i in model["vocab"].items() if t not in self.special}
        self.merger = tiktoken.Encoding("file", pat_str=_CUT, mergeable_ranks=ranks, special_tokens={})

    def _plain(self, text: str) -> bytes:
        parts, start = [], 0
        while len(text) - start > LONG_CHARS:
            space = _SAFE.search(text, start + LONG_CHARS)
            if space is None:
                break
            parts.append(text[start : space.start()])
            start = space.start()
        parts.append(text[start:])
        return b"".join(map(self._ids, parts))

    def _ids(self, text: str) -> bytes:
        try:
            ids = self.merger.encode_to_numpy(text, disallowed_special=())
        except ValueError:
            # Very long runs of white space exceed its pattern's stack.
            ids = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids)
        return ids.astype("<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if not any(s in text for s in self.special):
            return self._plain(text)
        special = {s: np.array([i], "<u4").tobytes() for s, i in self.special.items()}
        return b"".join(special.get(p) or self._plain(p) for p in self.split_special.split(text))


class TightestWindow:
    """Open windows by remaining capacity: a segment tree over 0..size finds the smallest that is enough."""

    def __init__(self, size: int):
        self.leaves = 1 << (size + 1).bit_length()
        self.count = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(size + 1)]

    def _add(self, capacity: int, step: int) -> None:
        node = self.leaves + capacity
        while node:
            self.count[node] += step
            node >>= 1

    def put(self, capacity: int, window: int) -> None:
        self.open[capacity].append(window)
        self._add(capacity, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """The capacity and number of a window with the smallest capacity of at least `need`, if any."""
        count, node = self.count, self.leaves + need
        if not count[node]:
            # Up until a right neighbour holds an open window, then down to its leftmost.
            while node > 1 and (node & 1 or not count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if count[2 * node] else 2 * node + 1
        capacity = node - self.leaves
        window = self.open[capacity].pop()
        self._add(capacity, -1)
        return capacity, window


def best_fit(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Window and offset of each piece; pieces go longest first into the tightest open window."""
    window, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    tree, opened = TightestWindow(size), 0
    for i in np.argsort(-lengths, kind="stable"):
        need = int(lengths[i])
        found = tree.take(need)
        if found is None:
            found = (size, opened)
            opened += 1
        capacity, window[i] = found
        offset[i] = size - capacity
        if capacity > need:
            tree.put(capacity - need, int(window[i]))
    return window, offset


def _pieces(vocabulary: str, length: int, end_id: int):
    end = np.array([end_id], "<u4").tobytes()
    encoder: list[TokenIds] = []

    def work(doc_ids: pa.Array, texts: list[str]) -> pa.RecordBatch:
        if not encoder:
            encoder.append(TokenIds(vocabulary))
        rows = []
        for row, text in enumerate(texts):
            ids = encoder[0](text) + end
            total = len(ids) // 4
            for start in range(0, total, length):
                cut = ids[4 * start : 4 * (start + length)]
                rows.append((row, start, len(cut) // 4, zlib.crc32(cut), total))
        row, *columns = (np.array(c, np.int64) for c in zip(*rows, strict=True))
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
        return pa.record_batch([doc_ids.take(pa.array(row)), *map(pa.array, columns)], names)

    return work


def token_pieces(pages: DataFrame, vocabulary: str, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """Each page text as token ids and `end_id`, cut into full windows and a rest.

    Returns per piece `doc_id`, `start`, `length`, `ids_crc32` (unsigned 32-bit little-endian ids) and `doc_tokens`.
    """
    pages = plain(pages)
    kind = dict(pages.dtypes)["doc_id"]
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long"
    return pages.mapInArrow(per_slice(_pieces(vocabulary, length, end_id)), schema)


def packed(
    pages: DataFrame,
    vocabulary: str,
    length: int = LENGTH,
    end_id: int = END_ID,
    shard_pieces: int = SHARD_PIECES,
) -> DataFrame:
    """Page texts packed into sequences of at most `length` tokens by best fit, longest pieces first.

    A text is its token ids and `end_id`. One longer than a window is first cut into full windows; only its
    rest is packed with others. Pieces are dealt by hash into shards of about `shard_pieces`; in a shard a segment
    tree over the remaining capacities gives the tightest open window for each piece. Only piece
    sizes move, never ids or texts.

    pages: `doc_id`, `text` (null or empty: only `end_id`); other columns are not looked at. `vocabulary` is the
    path of a tokenizer file that every executor can read. Rows that repeat a doc_id are packed each for itself.
    Ties go to the piece that comes first by (doc_id, start). No pages give no rows.
    Returns per piece `doc_id`, `start` (ids of its text before it), `length`, `ids_crc32`, `doc_tokens`,
    `sequence_id` and `offset` (its place there; gapless from 0).
    """
    pieces = pin(token_pieces(pages, vocabulary, length, end_id))
    shards = 1 + pieces.count() // shard_pieces
    where = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(shards).cast("long"))
    kind = dict(pieces.dtypes)["doc_id"]

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["doc_id", "start", "ids_crc32", "doc_tokens"], kind="stable")
        window, offset = best_fit(frame["length"].to_numpy(np.int64), length)
        return frame.assign(sequence_id=(frame["shard"].to_numpy(np.int64) << 32) + window, offset=offset).drop(
            columns="shard"
        )

    schema = (
        f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    )
    return pieces.withColumn("shard", where).groupBy("shard").applyInPandas(pack, schema)
