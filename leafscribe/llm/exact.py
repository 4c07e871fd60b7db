"""Exact copies of page texts, found by exchanging Golomb-coded fingerprints."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafscribe.llm.common import copied, few, pin, plain

#: Fingerprints that one sender message covers, and that one owner receives on average.
SENDER_ROWS = 1 << 17
OWNER_ROWS = 1 << 16


def golomb(values: np.ndarray) -> bytes:
    """Sorted distinct unsigned 64-bit values as Golomb-coded gaps (divisor a power of two).

    Head: first value, number of values, remainder width. Then the quotients in unary (zeros ended by a one),
    and the remainders with a fixed width.
    """
    n = len(values)
    if n == 0:
        return b""
    gaps = np.diff(values)
    mean = float(values[-1] - values[0]) / max(n - 1, 1)
    width = max(0, min(63, int(math.log2(mean * math.log(2))) if mean > 2 else 0))
    head = np.array([values[0], n, width], dtype="<u8").tobytes()
    quotients = (gaps >> np.uint64(width)).astype(np.int64)
    unary = np.zeros(int(quotients.sum()) + n - 1, np.uint8)
    unary[np.cumsum(quotients + 1) - 1] = 1
    shifts = np.arange(width, dtype=np.uint64)
    rest = ((gaps[:, None] >> shifts) & np.uint64(1)).astype(np.uint8)
    return head + np.packbits(unary).tobytes() + np.packbits(rest.ravel()).tobytes()


def golomb_values(coded: bytes) -> np.ndarray:
    """The values that `golomb` coded."""
    if not coded:
        return np.zeros(0, np.uint64)
    first, n, width = np.frombuffer(coded, "<u8", 3)
    n, width, bits = int(n), int(width), np.frombuffer(coded, np.uint8, offset=24)
    rest_bytes = ((n - 1) * width + 7) // 8
    ones = np.flatnonzero(np.unpackbits(bits[: len(bits) - rest_bytes]))[: n - 1]
    gaps = np.diff(ones, prepend=-1).astype(np.uint64) - np.uint64(1)
    gaps = gaps << np.uint64(width)
    if width:
        rest = np.unpackbits(bits[len(bits) - rest_bytes :])[: (n - 1) * width]
        powers = np.uint64(1) << np.arange(width, dtype=np.uint64)
        gaps = gaps + rest.reshape(-1, width).astype(np.uint64) @ powers
    return np.concatenate([[first], first + np.cumsum(gaps, dtype=np.uint64)])


def owner_of(values: np.ndarray, owners: int) -> np.ndarray:
    """Owner of each fingerprint: equal ranges of the 64-bit space, in order."""
    return ((values >> np.uint64(32)) * np.uint64(owners) >> np.uint64(32)).astype(np.int64)


def _messages(owners: int, sender_rows: int):
    def message(prints: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        values, counts = np.unique(np.concatenate(prints), return_counts=True)
        owner = owner_of(values, owners)
        for o in np.unique(owner):
            own = owner == o
            row = [[int(o)], [golomb(values[own])], [np.packbits(counts[own] > 1).tobytes()]]
            yield pa.record_batch([pa.array(x) for x in row], ["owner", "coded", "twice"])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One message per owner: the sender's distinct fingerprints, and which of them it holds twice."""
        held, rows = [], 0
        for batch in batches:
            held.append(batch.column("print").to_numpy().view(np.uint64))
            rows += len(held[-1])
            if rows >= sender_rows:
                yield from message(held)
                held, rows = [], 0
        if rows:
            yield from message(held)

    return send


_REPLY = "owner long, coded binary, bitmap binary"


def _answer(frame: pd.DataFrame) -> pd.DataFrame:
    """An owner's reply to each sender: its message with a bitmap, set where a copy exists somewhere.

    The message goes back with the reply, so a sender keeps nothing that could be lost with its executor.
    """
    sent = [golomb_values(c) for c in frame["coded"]]
    twice = [
        np.unpackbits(np.frombuffer(t, np.uint8))[: len(s)].astype(bool)
        for s, t in zip(sent, frame["twice"], strict=True)
    ]
    values, inverse, counts = np.unique(np.concatenate(sent), return_inverse=True, return_counts=True)
    more = counts > 1
    more[inverse[np.concatenate(twice)]] = True
    maps = [np.packbits(more[np.searchsorted(values, s)]).tobytes() for s in sent]
    return frame.drop(columns="twice").assign(bitmap=maps)


def _suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fingerprints marked by the bitmaps that came back."""
    for batch in batches:
        for coded, bitmap in zip(batch["coded"], batch["bitmap"], strict=True):
            values = golomb_values(coded.as_py())
            marked = np.unpackbits(np.frombuffer(bitmap.as_py(), np.uint8))[: len(values)]
            hit = values[marked.astype(bool)].view(np.int64)
            yield pa.record_batch([pa.array(hit)], ["print"])


def exact_copies(pages: DataFrame, sender_rows: int = SENDER_ROWS, owner_rows: int = OWNER_ROWS) -> DataFrame:
    """Groups of pages whose texts are identical, byte for byte.

    Pages are cut into senders (rows of one input partition, at most `sender_rows`). A sender hashes its texts
    to 64 bits, sorts the distinct hashes and sends each owner of a hash range its share, Golomb coded.
    The owner answers with a bitmap over the hashes it was sent. Texts with marked hashes are suspects;
    only these are shuffled and compared whole.

    pages: `doc_id`, `text` (null counts as empty); other columns are not looked at.
    Returns one row per page: `doc_id`, `keep_id` (largest doc_id of the group, null below all others),
    `group_size` (rows with this text), `kept` (doc_id is keep_id), `text_sha256` (lower-case hex, UTF-8).
    Rows that repeat a doc_id and a text are one page repeated: all count in `group_size` and share `kept`.
    Ties cannot occur otherwise. No pages give no rows; very long texts are hashed where they lie.

    A sender's messages hold each hash once, so a text with a third of all rows adds one hash per sender.
    Such a text is counted before the shuffle; only counts of it move.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = plain(pages).select("doc_id", text.alias("text"))
    fingerprint = F.xxhash64("text")
    prints = pin(
        rows.select(
            "doc_id",
            fingerprint.alias("print"),
            F.sha2("text", 256).alias("text_sha256"),
        )
    )
    owners = 1 + prints.count() // owner_rows
    send = _messages(owners, sender_rows)
    messages = prints.select("print").mapInArrow(send, "owner long, coded binary, twice binary")
    replies = messages.groupBy("owner").applyInPandas(_answer, _REPLY)
    suspects = pin(replies.mapInArrow(_suspects, "print long").distinct())
    verified = _verified(rows.withColumn("print", fingerprint), suspects)
    joined = prints.join(copied(verified), "text_sha256", "left")
    keep = F.when(F.col("copies").isNull(), F.col("doc_id")).otherwise(F.col("largest"))
    return joined.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("copies", F.lit(1).cast("long")).alias("group_size"),
        keep.eqNullSafe(F.col("doc_id")).alias("kept"),
        "text_sha256",
    )


def _verified(rows: DataFrame, suspects: DataFrame) -> DataFrame:
    """Suspect texts compared whole: size and largest doc_id of each text that really occurs twice."""
    if few(suspects):
        suspects = F.broadcast(suspects)
    held = rows.join(suspects, "print", "left_semi")
    # Copies meet by their whole bytes, counted inside each partition first.
    groups = held.groupBy("text").agg(F.count(F.lit(1)).alias("copies"), F.max("doc_id").alias("largest"))
    groups = groups.where("copies > 1")
    return pin(groups.select(F.sha2("text", 256).alias("text_sha256"), "copies", "largest"))
