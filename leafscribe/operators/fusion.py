"""Reciprocal rank fusion of two rankings without ranking either as a whole."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A record at rank r of a list gets 1 / (FUSION + r).
FUSION = 60


def depth(k: int) -> int:
    """How far down each list the `k` best fused records can lie.

    The first `k` records of a list have 1 / (FUSION + k) at least. A record below rank FUSION + 2k in both lists has less than
    2 / (2 FUSION + 2k), which is no more.
    """
    return FUSION + 2 * k


def _ordered(scored: DataFrame, key: str) -> DataFrame:
    return scored.where("score IS NOT NULL").select((-F.col("score")).alias("down"), F.col(key).alias("key"))


def first_ranks(scored: DataFrame, key: str, n: int, name: str) -> DataFrame:
    """The first `n` records by falling score (ties: the smaller key) with their ranks; every task keeps `n` rows only."""
    first = _ordered(scored, key).orderBy("down", "key").limit(n)
    rank = F.row_number().over(Window.orderBy("down", "key"))
    return first.select("key", rank.cast("long").alias(name))


def _place(row: Column, marks: Column, n: int) -> Column:
    """Index of the first of up to `n` ascending marks that comes after the row, by halving."""
    both = lambda low, high: F.struct(low.alias("low"), high.alias("high"))

    def halve(s: Column, _: Column) -> Column:
        middle = F.floor((s["low"] + s["high"]) / 2).cast("int")
        after = F.get(marks, middle) > row
        closer = both(F.when(after, s["low"]).otherwise(middle + 1), F.when(after, middle).otherwise(s["high"]))
        return F.when(s["low"] < s["high"], closer).otherwise(s)

    steps = F.array(*[F.lit(i) for i in range(math.ceil(math.log2(n + 1)) + 1)])
    return F.aggregate(steps, both(F.lit(0), F.size(marks)), halve, lambda s: s["low"])


def exact_ranks(scored: DataFrame, key: str, wanted: DataFrame, n: int, name: str) -> DataFrame:
    """Ranks in the whole list of the records in `wanted` (one column `key`, up to `n` rows).

    Every row of the list falls between two wanted ones; the rows in each gap are counted, and the counts added up. Nothing is sorted
    but the wanted records, and only counts are shuffled.
    """
    rows = _ordered(scored, key)
    # A list of at most `n` keys, so it may be copied.
    held = rows.join(F.broadcast(wanted), "key", "left_semi").select(F.struct("down", "key").alias("row"))
    marks = held.agg(F.array_sort(F.collect_list("row")).alias("m"))
    gaps = rows.withColumn("_marks", marks.scalar())
    gaps = gaps.select(_place(F.struct("down", "key"), F.col("_marks"), n).alias("gap"))
    gaps = gaps.groupBy("gap").agg(F.count(F.lit(1)).alias("rows"))
    at = marks.select(F.posexplode("m").alias("at", "row")).select("at", "row.key")
    # At most `n` + 1 gaps and `n` marks.
    before = at.join(F.broadcast(gaps), F.col("gap") <= F.col("at"), "left").groupBy("key")
    return before.agg((F.coalesce(F.sum("rows"), F.lit(0)) + 1).alias(name))


def fused(left: DataFrame, right: DataFrame, key: str, k: int, names=("text_rank", "vector_rank")) -> DataFrame:
    """The `k` records with the largest sum of reciprocal ranks, with their exact rank in each list (null where they are not in it).

    left, right: `key` (unique and not null) and `score`; null scores are not in the list. Only the first 60 + 2k records of each list can win
    (`depth`); they are ranked, and only their ranks in the other list are counted. Ties go to the smaller key.
    """
    n = depth(k)
    first = first_ranks(left, key, n, names[0]).select("key")
    second = first_ranks(right, key, n, names[1]).select("key")
    wanted = first.unionByName(second).distinct()
    one = exact_ranks(left, key, wanted, 2 * n, names[0])
    two = exact_ranks(right, key, wanted, 2 * n, names[1])
    part = lambda c: F.coalesce(1.0 / (FUSION + F.col(c)), F.lit(0.0))
    both = one.join(two, "key", "full_outer").withColumn("score", part(names[0]) + part(names[1]))
    return both.withColumnRenamed("key", key).orderBy(F.desc("score"), F.asc(key)).limit(k)
