"""Merkle manifest of the pages of all volumes, with a witness for every page."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType
from pyspark.sql.window import Window

from leafscribe.llm.common import bound_batches, pin

#: Consecutive nodes that become one node above them.
ARITY = 3
#: Levels of a block: so many leaves (or roots of lower blocks) are appended in one task.
LEVELS = 8
#: Type of a witness: for each level, from the leaf up, the siblings before and after the node.
WITNESS = "array<struct<before:string,after:string>>"


def record_digest(*fields: Column) -> Column:
    """Digest of a record: of each field its byte count, a colon and its text, or a dash for null, concatenated."""
    parts = []
    for field in fields:
        text = field.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def witness_digest(witness: Column) -> Column:
    """Digest of all siblings of a witness, from the leaf up, left to right."""
    return F.sha2(F.array_join(F.transform(witness, lambda s: F.concat(s["before"], s["after"])), ""), 256)


def folded(leaf: Column, witness: Column) -> Column:
    """The root that follows from a leaf's digest and its siblings."""
    return F.aggregate(witness, leaf, lambda node, s: F.sha2(F.concat(s["before"], node, s["after"]), 256))


class Subtree:
    """A node with the part of its witness that is known so far."""

    __slots__ = ("digest", "parent", "before", "after")

    def __init__(self, digest: str):
        self.digest, self.parent, self.before, self.after = digest, None, "", ""


class Append:
    """Aligned append of digests; the witness of every open subtree grows as its siblings complete."""

    def __init__(self, levels: int):
        self.open: list[list[Subtree]] = [[] for _ in range(levels + 1)]
        self.leaves: list[Subtree] = []

    def add(self, digest: str) -> None:
        leaf = Subtree(digest)
        self.leaves.append(leaf)
        self._place(leaf, 0)

    def _place(self, node: Subtree, level: int) -> None:
        run = self.open[level]
        for earlier in run:
            node.before += earlier.digest
            earlier.after += node.digest
        run.append(node)
        if len(run) == ARITY and level + 1 < len(self.open):
            self._complete(level)

    def _complete(self, level: int) -> None:
        run, self.open[level] = self.open[level], []
        parent = Subtree(hashlib.sha256("".join(n.digest for n in run).encode()).hexdigest())
        for node in run:
            node.parent = parent
        self._place(parent, level + 1)

    def close(self, alone: bool) -> str:
        """Root of the block. A block that is a whole tree ends at its single node, others at full height."""
        for level in range(len(self.open) - 1):
            if alone and sum(map(len, self.open[level:])) == 1:
                break
            if self.open[level]:
                self._complete(level)
        (root,) = [node for run in self.open for node in run]
        return root.digest


def _appended(digests: list[str], first: bool, levels: int) -> tuple[Append, str]:
    tree = Append(levels)
    for digest in digests:
        tree.add(digest)
    return tree, tree.close(first and len(digests) < ARITY**levels)


def _by_block(batches: Iterator[pa.RecordBatch], starts: Callable, work: Callable) -> Iterator[pa.RecordBatch]:
    """`work` per table of one whole block. Rows come sorted; a block, bounded in size, may go on in the next batch."""
    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = table if rest is None else pa.concat_tables([rest, table]).combine_chunks()
        at = np.flatnonzero(starts(table["pos"].to_numpy())).tolist()
        for a, b in zip(at, at[1:], strict=False):
            yield work(table.slice(a, b - a))
        rest = table.slice(at[-1])
    if rest is not None:
        yield work(rest)


def _root_rows(levels: int):
    size = ARITY**levels

    def work(table: pa.Table) -> pa.RecordBatch:
        block = table["pos"][0].as_py() // size
        _, root = _appended(table["digest"].to_pylist(), block == 0, levels)
        row = [table["volume"].slice(0, 1).combine_chunks(), pa.array([block]), pa.array([root])]
        return pa.record_batch(row, ["volume", "pos", "digest"])

    return lambda batches: _by_block(batches, lambda pos: pos % size == 0, work)


def _witness_rows(levels: int):
    def work(table: pa.Table) -> pa.RecordBatch:
        # The first row is the block's own witness; the leaves follow.
        above = [(s["before"], s["after"]) for s in table["witness"][0].as_py()]
        leaves = table.slice(1).combine_chunks()
        tree, _ = _appended(leaves["digest"].to_pylist(), table["block"][0].as_py() == 0, levels)
        before, after, ends = [], [], [0]
        for node in tree.leaves:
            while node.parent is not None:
                before.append(node.before)
                after.append(node.after)
                node = node.parent
            before += [b for b, _ in above]
            after += [a for _, a in above]
            ends.append(len(before))
        sides = pa.StructArray.from_arrays([pa.array(before, pa.string()), pa.array(after, pa.string())], ["before", "after"])
        witness = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), sides)
        n = leaves.num_rows
        same = [pa.array([table[c][0].as_py()] * n, pa.string()) for c in ("subroot", "root")]
        kept = [leaves[c].combine_chunks() for c in ("volume", "pos", "digest", "kept")]
        return pa.record_batch([*kept, witness, *same], ["volume", "pos", "digest", "kept", "witness", "subroot", "root"])

    return lambda batches: _by_block(batches, lambda pos: pos < 0, work)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the position of each row among the rows of its volume in this partition, which come sorted."""
    last, held = None, 0
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        volume = batch["volume"]
        codes = volume.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        new = np.concatenate([[True], codes[1:] != codes[:-1]])
        start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        local = np.arange(n) - start
        if held and volume[0].as_py() == last:
            local += np.where(start == 0, held, 0)
        last, held = volume[n - 1].as_py(), int(local[-1]) + 1
        yield pa.record_batch([*batch.columns, pa.array(local)], [*batch.schema.names, "local"])


def _numbered(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """Adds `pos`, the position from 0 of each row of (volume, digest, kept) inside its volume, spread by range."""
    # Equal rows are told apart by where they were read, so that they can be spread, too.
    rows = rows.withColumn("salt", F.monotonically_increasing_id())
    place = ["volume", *order, "digest", "salt"]
    spread = rows.repartitionByRange(*place).sortWithinPartitions(*place)
    spread = spread.select("volume", "digest", "kept", F.spark_partition_id().alias("part"))
    schema = StructType([*spread.schema.fields, StructField("local", LongType())])
    spread = pin(spread.mapInArrow(_counted, schema))
    sizes = spread.groupBy("part", "volume").agg((F.max("local") + 1).alias("n"))
    earlier = Window.partitionBy("volume").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carry = sizes.select(F.col("part").alias("p"), F.col("volume").alias("v"), F.sum("n").over(earlier).alias("earlier"))
    # A volume that began in an earlier partition is the first one of its partition: at most one row for each.
    carry = F.broadcast(carry.where("earlier > 0"))
    joined = spread.join(carry, (F.col("part") == F.col("p")) & F.col("volume").eqNullSafe(F.col("v")), "left")
    pos = F.col("local") + F.coalesce("earlier", F.lit(0).cast("long"))
    return joined.select("volume", pos.alias("pos"), "digest", "kept")


def _grown(leaves: DataFrame, levels: int) -> list[DataFrame]:
    """The leaves, the roots of their blocks, the roots of blocks of those, and so on, up to one node a volume."""
    found = [leaves]
    schema = StructType([*leaves.select("volume", "pos", "digest").schema.fields])
    while len(found) == 1 or not found[-1].where("pos > 0").isEmpty():
        blocks = _dealt(found[-1].select("volume", "pos", "digest"), levels)
        found.append(pin(blocks.select("volume", "pos", "digest").mapInArrow(_root_rows(levels), schema)))
    return found


def _dealt(nodes: DataFrame, levels: int) -> DataFrame:
    """Nodes by blocks, in order; a row with `pos` -1 comes first in its block."""
    if "block" not in nodes.columns:
        nodes = nodes.withColumn("block", F.expr(f"pos div {ARITY**levels}"))
    return nodes.repartition("volume", "block").sortWithinPartitions("volume", "block", "pos")


def _witnessed(grown: list[DataFrame], above: DataFrame, levels: int) -> DataFrame:
    """Leaves with witnesses. `above` has a row (volume, block, witness, subroot, root) for the last node of each volume."""
    nothing = F.lit(None)
    for nodes in reversed(grown[:-1]):
        if "kept" not in nodes.columns:
            nodes = nodes.withColumn("kept", F.struct(nothing.cast("string").alias("none")))
        empty = {c: nothing.cast(WITNESS if c == "witness" else "string") for c in ("witness", "subroot", "root")}
        own = nodes.withColumn("block", F.expr(f"pos div {ARITY**levels}")).withColumns(empty)
        first = above.select(
            "volume", "block", F.lit(-1).cast("long").alias("pos"), nothing.cast("string").alias("digest"),
            nothing.cast(own.schema["kept"].dataType).alias("kept"), "witness", "subroot", "root",
        )
        rows = _dealt(own.unionByName(first), levels)
        names = ["volume", "pos", "digest", "kept", "witness", "subroot", "root"]
        fields = [StructField(f.name, f.dataType, True) for f in rows.select(*names).schema.fields]
        found = rows.mapInArrow(_witness_rows(levels), StructType(fields))
        above = found.select("volume", F.col("pos").alias("block"), "witness", "subroot", "root")
        if nodes is not grown[0]:
            above = pin(above)
    return found


def volume_manifest(
    pages: DataFrame,
    fields: Sequence[str] = ("manifest_id", "page_number", "name", "text"),
    carried: Sequence[str] = (),
    volume: str = "manifest_id",
    page: str = "page_number",
    levels: int = LEVELS,
) -> DataFrame:
    """Merkle tree of the pages of each volume, and of the volumes; every page gets its witness.

    A page's leaf is the digest of its `fields` (`record_digest`). The leaves of a volume ascend by page number; every three
    consecutive nodes (the last run: fewer) become the digest of their concatenated hex digests, until one node, the subroot,
    is left. The subroots, ordered by volume (null first), give the root in the same way.

    The leaves are numbered over range partitions, dealt to aligned blocks of 3 ** `levels` and appended there in order. An open
    subtree carries the part of its witness that is known; each sibling that completes later extends it. The roots of blocks are
    appended as the leaves of further blocks. Then witnesses go down: a block's own one is put before its leaves, which are appended
    again and extend it. So no witness is shuffled with a page, and a volume of any size is spread over its blocks.

    pages: one row per page with the columns `volume` and `page`, those in `fields` and those in `carried`; other columns are
    not looked at. Nulls in any of them are values of their own. Very long texts are digested where they lie. Pages with equal
    numbers are ordered by leaf; repeated rows are leaves of their own. No pages give no rows.
    Returns one row per page: `manifest_id`, `page_number`, the carried columns, `leaf`, `subroot`, `root`, and `witness`, an array
    of structs (`before`, `after`: the digests of the siblings, concatenated) from the leaf's run up to the root's.
    """
    bound_batches(pages.sparkSession)
    kept = F.struct(F.col(page).alias("page_number"), F.struct(F.lit(0).alias("none"), *carried).alias("carried"))
    leaf = record_digest(*[F.col(f) for f in fields])
    rows = pages.select(F.col(volume).alias("volume"), leaf.alias("digest"), kept.alias("kept"))
    ordered = rows.withColumn("page", F.col("kept.page_number"))
    grown = _grown(_numbered(ordered, ["page"]), levels)
    last = grown[-1]
    kind = rows.schema["volume"].dataType
    subroots = last.select(F.lit(None).cast(kind).alias("volume"), "digest", F.struct(F.col("volume").alias("of")).alias("kept"))
    top = _grown(_numbered(subroots.withColumn("of", F.col("kept.of")), ["of"]), levels)
    none = F.array().cast(WITNESS)
    root = top[-1].select(
        "volume", F.col("pos").alias("block"), none.alias("witness"), F.lit(None).cast(StringType()).alias("subroot"),
        F.col("digest").alias("root"),
    )
    first = F.lit(0).cast("long")
    above = _witnessed(top, root, levels).select(
        F.col("kept.of").alias("volume"), first.alias("block"), "witness", F.col("digest").alias("subroot"), "root"
    )
    found = _witnessed(grown, pin(above), levels)
    return found.select(
        F.col("volume").alias("manifest_id"), "kept.page_number", *[F.col("kept.carried")[c].alias(c) for c in carried],
        F.col("digest").alias("leaf"), "subroot", "root", "witness",
    )
