"""Order-dependent work that holds up when one group has a large share of all rows.

A plain window sends a whole group through one task. That is the best plan while every
group is small, so the size is checked first. Otherwise the rows are spread by range over
(group, order), numbered, and cut into blocks of a bounded number of rows; the
work then runs per block and only block summaries cross from one block to the next.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leafscribe.session import pin

# Rows of one group that a single task may hold.
GROUP_ROWS = 200_000
# Rows of a (narrow) lookup table that may be copied to every executor.
LOOKUP_ROWS = 200_000

_RUNNING = {
    "sum": (F.sum, lambda a, b: a + b),
    "max": (F.max, lambda a, b: F.greatest(a, b)),
    "min": (F.min, lambda a, b: F.least(a, b)),
}


def same(left: DataFrame, right: DataFrame, keys: Sequence[str], renamed: str = "") -> Column:
    """Null-safe equality on the keys; on the right they carry the prefix `renamed`."""
    condition = F.lit(True)
    for key in keys:
        condition = condition & left[key].eqNullSafe(right[renamed + key])
    return condition


def _prefixed(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.withColumnsRenamed({key: "_r_" + key for key in keys})


def _attach(df: DataFrame, side: DataFrame, keys: Sequence[str], broadcast=False) -> DataFrame:
    side = _prefixed(side, keys)
    if broadcast:
        side = F.broadcast(side)
    joined = df.join(side, same(df, side, keys, "_r_"), "left")
    return joined.drop(*["_r_" + key for key in keys])


def _large(df: DataFrame, keys: Sequence[str], limit: int) -> DataFrame:
    # Counts are combined before the shuffle.
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return sizes.where(F.col("_n") > limit).drop("_n")


def has_large_group(df: DataFrame, keys: Sequence[str], limit: int) -> bool:
    """True if some group has more than `limit` rows."""
    return not _large(df, keys, limit).isEmpty()


def large_groups(df: DataFrame, keys: Sequence[str], limit: int) -> DataFrame | None:
    """Keys of the groups with more than `limit` rows, None if there are none."""
    found = _large(df, keys, limit)
    return None if found.isEmpty() else pin(found)


def divided(df: DataFrame, large: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows of ordinary groups and rows of the large ones."""
    side = _prefixed(large, keys)
    if side.limit(LOOKUP_ROWS + 1).count() <= LOOKUP_ROWS:
        side = F.broadcast(side)
    match = same(df, side, keys, "_r_")
    return df.join(side, match, "left_anti"), df.join(side, match, "left_semi")


def _numbered_by_range(df: DataFrame, keys, order, name: str) -> DataFrame:
    """1-based position inside the group, no task holding more than one range partition."""
    # The range bounds are sampled, so the placement is pinned before it is used twice.
    spread = pin(
        df.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id())
    )
    chunk = [*keys, "_part"]
    local = F.row_number().over(Window.partitionBy(*chunk).orderBy(*order)).cast("long")
    # At most one row per partition for each group that spans partitions.
    sizes = spread.groupBy(*chunk).agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carry = sizes.select(*chunk, F.sum("_n").over(earlier).alias("_before")).where("_before > 0")
    # A group that started in an earlier partition is the first group of its partition, so
    # there is at most one such row per partition: safe to broadcast.
    numbered = _attach(spread.withColumn("_local", local), carry, chunk, broadcast=True)
    position = F.col("_local") + F.coalesce(F.col("_before"), F.lit(0).cast("long"))
    return numbered.withColumn(name, position).drop("_part", "_local", "_before")


def ordinal(
    df: DataFrame, keys, order, name: str, limit: int = GROUP_ROWS, small: bool | None = None
) -> DataFrame:
    """Adds the 1-based position of each row inside its group. `order` must be unique in it.

    Only the rows of large groups take the longer way. `small` skips the look at group sizes
    where they are known to be within the limit.
    """
    keys, order = list(keys), list(order)
    if not keys:
        return _numbered_by_range(df, keys, order, name)
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long")
    large = None if small else large_groups(df, keys, limit)
    if large is None:
        return df.withColumn(name, number)
    few, many = divided(df, large, keys)
    return few.withColumn(name, number).unionByName(_numbered_by_range(many, keys, order, name))


class _Rows:
    """Rows in order inside each group. Rows of large groups are `blocked`: they carry a block
    number, windows see one block, and block summaries are joined back."""

    def __init__(self, df: DataFrame, keys: list[str], order: list[str], blocked: bool):
        self.df, self.keys, self.order, self.blocked = df, keys, order, blocked
        self.chunk = [*keys, "_block"] if blocked else keys

    def _window(self):
        return Window.partitionBy(*self.chunk).orderBy(*self.order)

    def running(self, name: str, kind: str, value: Column, before: bool) -> None:
        agg, combine = _RUNNING[kind]
        frame = self._window().rowsBetween(Window.unboundedPreceding, -1 if before else 0)
        df = self.df.withColumn(name, agg(value).over(frame))
        if self.blocked:
            totals = self.df.groupBy(*self.chunk).agg(agg(value).alias("_total"))
            earlier = (
                Window.partitionBy(*self.keys)
                .orderBy("_block")
                .rowsBetween(Window.unboundedPreceding, -1)
            )
            carry = totals.select(*self.chunk, agg("_total").over(earlier).alias("_carry"))
            df = _attach(df, carry, self.chunk)
            both = combine(F.col("_carry"), F.col(name))
            df = df.withColumn(name, F.coalesce(both, name, "_carry")).drop("_carry")
        self.df = df

    def neighbour(self, name: str, value: Column, step: int) -> None:
        window = self._window()
        shift = F.lead if step == 1 else F.lag
        df = self.df.withColumn(name, shift(value).over(window))
        if self.blocked:
            df = df.withColumn("_inside", shift(F.lit(1)).over(window))
            edge = F.min_by if step == 1 else F.max_by
            edges = self.df.groupBy(*self.chunk).agg(
                edge(F.struct(value.alias("v")), F.struct(*self.order)).alias("_edge")
            )
            edges = edges.withColumn("_block", F.col("_block") - step)
            df = _attach(df, edges, self.chunk)
            inside = F.col("_inside").isNotNull()
            df = df.withColumn(name, F.when(inside, F.col(name)).otherwise(F.col("_edge.v")))
            df = df.drop("_inside", "_edge")
        self.df = df

    def collected(self, value: Column, name: str) -> DataFrame:
        item = F.struct(*[F.col(c) for c in self.order], value.alias("_value"))
        packed = self.df.groupBy(*self.chunk).agg(
            F.array_sort(F.collect_list(item)).alias("_items")
        )
        values = F.transform("_items", lambda i: i["_value"])
        part = F.col("_block") if self.blocked else F.lit(0)
        return packed.select(*self.keys, part.cast("int").alias("part"), values.alias(name))


class Ordered:
    """Rows in ascending `order` (unique column names) inside each group.

    Ordinary groups use plain windows. Large ones are cut into blocks of at most `limit` rows.
    """

    def __init__(
        self, df: DataFrame, keys, order, limit: int = GROUP_ROWS, small: bool | None = None
    ):
        keys, order = list(keys), list(order)
        large = None if small or not keys else large_groups(df, keys, limit)
        self.parts: list[_Rows] = []
        if keys:
            few, many = (df, None) if large is None else divided(df, large, keys)
            self.parts.append(_Rows(few, keys, order, False))
        else:
            many = df
        if many is not None:
            numbered = _numbered_by_range(many, keys, order, "_pos")
            block = F.floor((F.col("_pos") - 1) / limit)
            blocks = numbered.withColumn("_block", block).drop("_pos")
            self.parts.append(_Rows(blocks, keys, order, True))

    def with_columns(self, columns: dict[str, Column]) -> "Ordered":
        for part in self.parts:
            part.df = part.df.withColumns(columns)
        return self

    def running(self, name: str, kind: str, value: Column, before: bool = False) -> "Ordered":
        """Running sum, max or min up to this row, or up to the row before it."""
        for part in self.parts:
            part.running(name, kind, value, before)
        return self

    def neighbour(self, name: str, value: Column, step: int) -> "Ordered":
        """The value on the next row (`step` 1) or on the previous row (`step` -1)."""
        for part in self.parts:
            part.neighbour(name, value, step)
        return self

    def collected(self, value: Column, name: str) -> DataFrame:
        """Per group and block (bounded) the values in order, with the block number `part`."""
        return _united([part.collected(value, name) for part in self.parts])

    def each(self, make) -> DataFrame:
        """`make(rows, blocked)` for ordinary and large groups, put together."""
        return _united([make(part.df, part.blocked) for part in self.parts])

    def done(self) -> DataFrame:
        return _united([part.df.drop("_block") for part in self.parts])


def _united(frames: list[DataFrame]) -> DataFrame:
    whole, *rest = frames
    for frame in rest:
        whole = whole.unionByName(frame)
    return whole


def lookup(
    big: DataFrame,
    small: DataFrame,
    keys: Sequence[str],
    how: str = "left",
    max_rows: int = LOOKUP_ROWS,
    salts: int = 32,
) -> DataFrame:
    """Join with a table that has one row per key.

    A table of at most `max_rows` rows is broadcast. A larger one is repeated `salts` times,
    so that rows of one hot key are spread over that many tasks.
    """
    keys = list(keys)
    if small.limit(max_rows + 1).count() <= max_rows:
        return big.join(F.broadcast(small), keys, how)
    # Hashed, not drawn: a recomputed task must send each row to the same place again.
    salted = big.withColumn("_salt", F.pmod(F.xxhash64(*big.columns), F.lit(salts).cast("long")))
    repeated = small.withColumn(
        "_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long")))
    )
    return salted.join(repeated, [*keys, "_salt"], how).drop("_salt")


def without(df: DataFrame, keys_table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key is not listed."""
    return lookup(df, keys_table.select(*keys).distinct(), keys, "left_anti")


def within(df: DataFrame, keys_table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key is listed."""
    return lookup(df, keys_table.select(*keys).distinct(), keys, "left_semi")
