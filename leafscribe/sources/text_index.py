"""Full-text index of catalog records: stored posting blocks by term, appended batch by batch."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leafscribe.functions.text import query_terms, terms
from leafscribe.session import bound_batches

K1, B = 1.2, 0.75
#: Postings of a block, and postings that a task gathers before it writes its blocks.
BLOCK, GATHERED = 128, 2_000_000
BUCKETS = 64

#: A block holds the postings of one term: keys, occurrences, text lengths, and what bounds their scores.
_BLOCK = "term string, n int, occurrences long, max_tf int, min_len int, keys array<{key}>, tfs array<int>, lens array<int>"


def _written(held: dict[str, list], block: int) -> pa.RecordBatch:
    """Blocks of each term, postings with the largest share of their text first, so that bounds fall from block to block."""
    names, sizes, sums, most, least, keys, tfs, lens = [], [], [], [], [], [], [], []
    for term, postings in held.items():
        postings.sort(key=lambda p: -p[0] / (p[0] + p[1]))
        for at in range(0, len(postings), block):
            part = postings[at : at + block]
            names.append(term)
            sizes.append(len(part))
            sums.append(sum(p[0] for p in part))
            most.append(max(p[0] for p in part))
            least.append(min(p[1] for p in part))
            keys.append([p[2] for p in part])
            tfs.append([p[0] for p in part])
            lens.append([p[1] for p in part])
    numbers = [pa.array(v, t) for v, t in ((sizes, pa.int32()), (sums, pa.int64()), (most, pa.int32()), (least, pa.int32()))]
    lists = [pa.array(keys), pa.array(tfs, pa.list_(pa.int32())), pa.array(lens, pa.list_(pa.int32()))]
    columns = ["term", "n", "occurrences", "max_tf", "min_len", "keys", "tfs", "lens"]
    return pa.record_batch([pa.array(names, pa.string()), *numbers, *lists], columns)


def _gathered(held: list[tuple], block: int) -> pa.RecordBatch:
    """As `_written`, of postings in arrays: (terms, keys, term number, row, occurrences, text length)."""
    terms = pa.concat_arrays([h[0] for h in held]).dictionary_encode()
    number = terms.indices.to_numpy()
    firsts, bases = (np.cumsum([0, *(len(h[c]) for h in held)]) for c in (0, 1))
    term = np.concatenate([number[first:][h[2]] for first, h in zip(firsts, held, strict=False)])
    row = np.concatenate([(base + h[3]).astype(np.int32) for base, h in zip(bases, held, strict=False)])
    tf, length = (np.concatenate([h[c] for h in held]) for c in (4, 5))
    order = np.lexsort([-tf / (tf + length), term])
    term, row, tf, length = term[order], row[order], tf[order], length[order]
    starts = np.flatnonzero((np.arange(len(term)) - np.searchsorted(term, term)) % block == 0)
    cuts = pa.array(np.append(starts, len(term)).astype(np.int32))
    lists = [pa.concat_arrays([h[1] for h in held]).take(pa.array(row)), pa.array(tf), pa.array(length)]
    numbers = [np.diff(np.append(starts, len(term))).astype(np.int32), np.add.reduceat(tf, starts, dtype=np.int64)]
    numbers += [np.maximum.reduceat(tf, starts), np.minimum.reduceat(length, starts)]
    columns = ["term", "n", "occurrences", "max_tf", "min_len", "keys", "tfs", "lens"]
    names = terms.dictionary.take(pa.array(term[starts]))
    return pa.record_batch([names, *map(pa.array, numbers), *(pa.ListArray.from_arrays(cuts, v) for v in lists)], columns)


def _cut(block: int, gathered: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks of the postings of a task, as many as it gathers at once."""
        held, rows = [], 0
        for batch in batches:
            lengths = np.array(pc.fill_null(pc.list_value_length(batch["terms"]), 0), np.int64)
            # Parts of a batch hold about so many words.
            part = (np.cumsum(lengths) - lengths) // gathered
            at = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
            for a, b in zip(at, at[1:], strict=False):
                words = batch["terms"].slice(a, b - a).flatten().dictionary_encode()
                if not len(words):
                    continue
                size = len(words.dictionary)
                pair, tf = np.unique(np.repeat(np.arange(b - a), lengths[a:b]) * size + words.indices.to_numpy(), return_counts=True)
                row, term = np.divmod(pair, size)
                numbers = [v.astype(np.int32) for v in (term, row, tf, lengths[a:b][row])]
                held.append((words.dictionary, batch["key"].slice(a, b - a), *numbers))
                rows += len(pair)
                if rows >= gathered:
                    yield _gathered(held, block)
                    held, rows = [], 0
        if held:
            yield _gathered(held, block)

    return run


def _joined(block: int, gathered: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks of equal terms that lie next to each other become one list and are cut again."""
        last, held = None, []
        for batch in batches:
            for row in batch.to_pylist():
                if held and (row["term"] != last or len(held) >= gathered):
                    yield _written({last: held}, block)
                    held = []
                last = row["term"]
                held += zip(row["tfs"], row["lens"], row["keys"], strict=True)
        if held:
            yield _written({last: held}, block)

    return run


class TextIndex:
    """Posting blocks in a folder that all executors reach, parted by batch and term bucket.

    `key_type` and `buckets` belong to the folder: use the same ones whenever it is opened. A batch is written as a whole; writing it
    again replaces it, so a failed append is repeated safely. Keys are unique over all batches; a repeated key is refused.
    """

    def __init__(self, spark: SparkSession, path: str, key_type: str = "string", buckets: int = BUCKETS):
        self.spark, self.path, self.key_type, self.buckets = spark, path.rstrip("/"), key_type, buckets

    # Building ------------------------------------------------------------------------------

    @classmethod
    def create(cls, spark: SparkSession, path: str, key_type: str = "string", buckets: int = BUCKETS) -> "TextIndex":
        """An empty index in a new folder."""
        index = cls(spark, path, key_type, buckets)
        for name, schema in index._tables().items():
            below = "batch=-1/bucket=0" if name == "postings" else "batch=-1"
            spark.createDataFrame([], schema).write.parquet(f"{index.path}/{name}/{below}")
        return index

    def _tables(self) -> dict[str, str]:
        return {
            "postings": _BLOCK.format(key=self.key_type),
            "lengths": f"key {self.key_type}, len int",
            "totals": "n long, texts long, total long",
        }

    def append(self, records: DataFrame, key: str, text: str, batch: int, block: int = BLOCK, gathered: int = GATHERED) -> None:
        """Add the records (unique non-null `key`, `text` or null) as one batch, numbered from 0.

        Every task cuts its texts once and gathers posting blocks; only blocks are shuffled, to the files of their bucket.
        A bucket with a very frequent term is split over several files.
        """
        bound_batches(self.spark)
        cut = records.select(F.col(key).alias("key"), terms(F.col(text)).alias("terms"))
        earlier = self._read("lengths").where(F.col("batch") != batch).select("key", F.lit(False).alias("new"))
        keys = records.select(F.col(key).alias("key"), F.lit(True).alias("new")).unionByName(earlier)
        seen = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("new").alias("new"))
        bad = seen.where(F.col("new") & ((F.col("n") > 1) | F.col("key").isNull())).limit(1).collect()
        if bad:
            raise ValueError(f"the key {bad[0]['key']!r} is null or indexed already")
        blocks = cut.mapInArrow(_cut(block, gathered), _BLOCK.format(key=self.key_type))
        self._write(blocks, cut.select("key", F.size("terms").alias("len")), batch)

    def _write(self, blocks: DataFrame, lengths: DataFrame, batch: int) -> None:
        placed = blocks.withColumn("bucket", (F.crc32("term") % self.buckets).cast("int")).hint("rebalance", "bucket")
        placed.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/postings/batch={batch}")
        lengths.write.mode("overwrite").parquet(f"{self.path}/lengths/batch={batch}")
        own = self._read("lengths").where(F.col("batch") == batch)
        total = F.coalesce(F.sum("len"), F.lit(0)).alias("total")
        counted = own.agg(F.count(F.lit(1)).alias("n"), F.count("len").alias("texts"), total)
        counted.write.mode("overwrite").parquet(f"{self.path}/totals/batch={batch}")

    def compact(self, path: str, block: int = BLOCK, gathered: int = GATHERED) -> "TextIndex":
        """The same index as one batch in another folder: blocks of one term are put together, sorted anew and cut to full ones.

        The blocks of a frequent term stay spread: they meet by ranges of their keys.
        """
        whole = TextIndex.create(self.spark, path, self.key_type, self.buckets)
        near = self.blocks().select("bucket", "term", "keys", "tfs", "lens")
        near = near.repartitionByRange("bucket", "term", "keys").sortWithinPartitions("bucket", "term")
        joined = near.select("term", "keys", "tfs", "lens").mapInArrow(_joined(block, gathered), _BLOCK.format(key=self.key_type))
        whole._write(joined, self._read("lengths").select("key", "len"), 0)
        return whole

    # Reading -------------------------------------------------------------------------------

    def _read(self, name: str) -> DataFrame:
        schema = self._tables()[name] + ", batch int" + (", bucket int" if name == "postings" else "")
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def blocks(self) -> DataFrame:
        """All posting blocks."""
        return self._read("postings")

    def vocabulary(self) -> DataFrame:
        """Every term with the number of its records and occurrences, from the blocks' heads alone."""
        return self.blocks().groupBy("term").agg(F.sum("n").alias("n_records"), F.sum("occurrences").alias("n_occurrences"))

    def _wanted(self, query: str) -> tuple[list[str], DataFrame]:
        """The query's terms and their blocks: only their buckets are read."""
        wanted = sorted(set(query_terms(query)))
        buckets = sorted({zlib.crc32(t.encode()) % self.buckets for t in wanted})
        return wanted, self.blocks().where(F.col("bucket").isin(buckets) & F.col("term").isin(wanted))

    def _statistics(self, wanted: list[str], blocks: DataFrame) -> tuple[Column, Column]:
        """One row of corpus totals and one of the terms' record counts."""
        totals = self._read("totals").agg(
            F.struct(F.sum("n").alias("n"), F.try_divide(F.sum("total"), F.sum("texts")).alias("mean")).alias("s")
        )
        seen = [F.coalesce(F.sum(F.when(F.col("term") == t, F.col("n"))), F.lit(0)).alias(f"df{i}") for i, t in enumerate(wanted)]
        return totals.scalar(), blocks.agg(F.struct(*seen).alias("s")).scalar()

    def _with_idf(self, wanted: list[str], blocks: DataFrame) -> DataFrame:
        totals, seen = self._statistics(wanted, blocks)
        rows = blocks.withColumns({"_totals": totals, "_seen": seen})
        df = F.coalesce(*[F.when(F.col("term") == t, F.col(f"_seen.df{i}")) for i, t in enumerate(wanted)])
        idf = F.log(1 + (F.col("_totals.n") - df + 0.5) / (df + 0.5))
        return rows.withColumns({"idf": idf, "mean": F.col("_totals.mean")}).drop("_totals", "_seen")

    @staticmethod
    def _weight(tf: Column, length: Column) -> Column:
        norm = tf + K1 * (1 - B + B * length / F.col("mean"))
        return F.col("idf") * tf * (K1 + 1) / norm

    def _scores(self, rows: DataFrame) -> DataFrame:
        posting = F.explode(F.arrays_zip("keys", "tfs", "lens")).alias("p")
        each = rows.select("idf", "mean", posting)
        weighted = each.select(F.col("p.keys").alias("key"), self._weight(F.col("p.tfs"), F.col("p.lens")).alias("w"))
        return weighted.groupBy("key").agg(F.sum("w").alias("score"))

    def search(self, query: str) -> DataFrame:
        """Every record with a term of the query, as `key` and its BM25 `score`."""
        wanted, blocks = self._wanted(query)
        if not wanted:
            return self._read("lengths").select("key", F.lit(0.0).alias("score")).limit(0)
        return self._scores(self._with_idf(wanted, blocks))

    def top(self, query: str, k: int) -> DataFrame:
        """The `k` best records (ties: the smaller key), as `search` scores them, from as few blocks as their bounds allow.

        A block's best possible weight follows from its largest number of occurrences and its shortest text. The blocks with the
        largest bounds of each term are scored first; the k-th score so far is a lower bound of the final one. Then only
        blocks are opened whose bound, with the largest bounds of the other terms, reaches it: no record of the others can.
        """
        wanted, blocks = self._wanted(query)
        if not wanted:
            return self._read("lengths").select("key", F.lit(0.0).alias("score")).limit(0)
        rows = self._with_idf(wanted, blocks)
        rows = rows.withColumn("bound", self._weight(F.col("max_tf"), F.col("min_len")))
        heads = rows.select("term", "bound")
        most = [F.coalesce(F.max(F.when(F.col("term") == t, F.col("bound"))), F.lit(0.0)).alias(f"m{i}") for i, t in enumerate(wanted)]
        most = heads.agg(F.struct(*most).alias("s")).scalar()
        best = Window.partitionBy("term").orderBy(F.desc("bound"))
        leading = rows.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= -(-k // BLOCK) + 1)
        first = self._scores(leading).orderBy(F.desc("score")).limit(k)
        least = first.agg(F.when(F.count(F.lit(1)) == k, F.min("score")).otherwise(0.0)).scalar()
        others = F.coalesce(
            *[
                F.when(F.col("term") == t, sum([F.col(f"_most.m{j}") for j in range(len(wanted)) if j != i], F.lit(0.0)))
                for i, t in enumerate(wanted)
            ]
        )
        # The slack covers sums in another order.
        rows = rows.withColumns({"_most": most, "_least": least})
        opened = rows.where(F.col("bound") + others >= F.col("_least") * (1 - 1e-9))
        return self._scores(opened).orderBy(F.desc("score"), F.asc("key")).limit(k)
