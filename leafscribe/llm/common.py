"""Helpers shared by the operators on page texts.

The operators work on *page texts*: one row per page document with `doc_id` and `text` (its lines
joined by newlines, as the plain-text export writes them). Other columns of a page (`name`,
`manifest_id`, `page_number`, ...) may be there and are not looked at, so none of their names can clash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafscribe.session import bound_batches, use_shared_checkpoints
from leafscribe.sinks.exports import export_text

#: Rows of a narrow key table that may be copied to every executor; larger ones are shuffled.
COPIED_ROWS = 500_000
#: Characters that one numpy step of a text operator works on.
SLICE_CHARS = 1 << 20
SLICE_ROWS = 512


def page_texts(pages: DataFrame, lines: DataFrame) -> DataFrame:
    """Page texts (`doc_id`, `text`) of the page and line tables, as the plain-text export joins them."""
    return export_text(pages, lines).select("doc_id", F.col("content").alias("text"))


def plain(pages: DataFrame) -> DataFrame:
    """Only `doc_id` and `text` of the pages."""
    bound_batches(pages.sparkSession)
    return pages.select("doc_id", "text")


def pin(df: DataFrame) -> DataFrame:
    """Write the rows once to the shared checkpoint folder; later steps see the same rows and partitions."""
    use_shared_checkpoints(df.sparkSession)
    return df.checkpoint()


def few(df: DataFrame, rows: int = COPIED_ROWS) -> bool:
    """True if the (pinned or cheap) table has at most so many rows."""
    return df.limit(rows + 1).count() <= rows


def copied(df: DataFrame, rows: int = COPIED_ROWS) -> DataFrame:
    """The table marked for a broadcast if it was counted to be small, else as it is (shuffled)."""
    return F.broadcast(df) if few(df, rows) else df


def keyed(df: DataFrame, table: DataFrame, keys: dict[str, Column], how: str) -> DataFrame:
    """Semi or anti join of `df` with a key table: `keys` maps its columns to expressions on `df`.

    The table's columns are renamed, so whatever else `df` has cannot clash. Nulls equal nulls.
    """
    renamed = table.select(*[F.col(k).alias(f"__key_{i}") for i, k in enumerate(keys)])
    renamed = copied(renamed)
    condition = F.lit(True)
    for i, value in enumerate(keys.values()):
        condition = condition & value.eqNullSafe(renamed[f"__key_{i}"])
    return df.join(renamed, condition, how)


def only(pages: DataFrame, decided: DataFrame) -> DataFrame:
    """Pages, with all their columns, whose `doc_id` is in the table `decided`."""
    return keyed(pages, decided, {"doc_id": pages["doc_id"]}, "left_semi")


def without(pages: DataFrame, decided: DataFrame) -> DataFrame:
    """Pages, with all their columns, whose `doc_id` is not in the table `decided`."""
    return keyed(pages, decided, {"doc_id": pages["doc_id"]}, "left_anti")


def learning_fold(doc_id: Column) -> Column:
    """True for the documents that a model may learn from: crc32 of the id as text, mod 3, is not 1."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 != 1, F.lit(False))


def held_out(doc_id: Column) -> Column:
    """True for the documents kept for evaluation."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def hashed_fraction(doc_id: Column, salt: str) -> Column:
    """A reproducible number in [0, 1) per document, the same wherever and whenever it is computed."""
    digest = F.xxhash64(F.lit(salt), doc_id)
    return F.pmod(digest, F.lit(1 << 30)) / F.lit(float(1 << 30))


def slices(texts: pa.Array, chars: int = SLICE_CHARS) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of runs of a few rows with about so many characters; null texts are empty."""
    start, run, size = 0, [], 0
    for i, value in enumerate(texts):
        text = value.as_py() or ""
        if run and (size + len(text) > chars or len(run) == SLICE_ROWS):
            yield start, run
            start, run, size = i, [], 0
        run.append(text)
        size += len(text)
    if run:
        yield start, run


def per_slice(work: Callable[[list, list[str]], pa.RecordBatch]):
    """Arrow-batch function over (doc_id, text) rows: `work(doc_ids, texts)` per slice of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in slices(batch.column("text")):
                yield work(batch.column("doc_id").slice(start, len(texts)), texts)

    return run
