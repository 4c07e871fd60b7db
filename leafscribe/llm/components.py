"""Connected components of links between pages, as Spark joins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafscribe.llm.common import bound_batches, pin

#: Links that one task reduces to a star of each of their components.
BLOCK = 200_000


def _all(edges: DataFrame) -> DataFrame:
    """Links in both directions, without loops."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return both.where("a <> b")


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of one task with every number linked to the smallest one that it reaches within them."""
    parts = [(batch["a"].to_numpy(), batch["b"].to_numpy()) for batch in batches if batch.num_rows]
    if not parts:
        return
    a, b = (np.concatenate(side) for side in zip(*parts, strict=True))
    # Numbers are sorted, so the smallest index is the smallest number.
    numbers, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = at[: len(a)], at[len(a) :]
    least = np.arange(len(numbers))
    while True:
        one, other = least[left], least[right]
        if (one == other).all():
            break
        np.minimum.at(least, np.maximum(one, other), np.minimum(one, other))
        while (least[least] != least).any():
            least = least[least]
    yield pa.record_batch([pa.array(numbers[least]), pa.array(numbers)], ["a", "b"])


def components(links: DataFrame, block: int = BLOCK) -> DataFrame:
    """Smallest number that each linked number can reach.

    links: `a`, `b` (long, not null). Each task first reduces about `block` links to stars. Where one task held them all, these are
    the components. Else two steps alternate until nothing changes: every number links its larger neighbours
    to its smallest one, then its smaller neighbours to the smallest. Each step halves the distances, so chains end
    after a few rounds. Neighbours are never gathered: a group only needs its minimum, which is combined before the
    shuffle. Returns `id`, `component` for every number of a link.
    """
    bound_batches(links.sparkSession)
    edges = pin(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b"))
    blocks = max(1, -(-edges.count() // block))
    stars = edges.coalesce(blocks).mapInArrow(_stars, "a long, b long")
    if blocks == 1:
        return stars.select(F.col("b").alias("id"), F.col("a").alias("component"))
    edges = pin(stars.where("a <> b").distinct())
    before = None
    while True:
        # Larger neighbours of each number go to the smallest of its neighbourhood.
        around = _all(edges)
        least = around.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = around.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b")
        large = large.where("a <> b").distinct()
        # Smaller neighbours, and the number itself, go to the smallest of these.
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(low, "b").select(F.col("m").alias("x"), F.col("a").alias("y"))
        small = small.unionByName(low.select(F.col("m").alias("x"), F.col("b").alias("y")))
        edges = pin(small.where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct())
        # Done when the same links come back: every number hangs on its smallest one.
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    leaves = edges.select(F.col("b").alias("id"), F.col("a").alias("component"))
    roots = edges.select(F.col("a").alias("id"), F.col("a").alias("component")).distinct()
    return leaves.unionByName(roots)
