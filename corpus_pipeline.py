"""From page texts to packed training sequences, stage by stage."""

from __future__ import annotations

import os
import uuid

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafscribe.llm.common import keyed, pin
from leafscribe.llm.exact import exact_copies
from leafscribe.llm.language import spoken_pages
from leafscribe.llm.leaks import benchmark_leaks
from leafscribe.llm.near import near_copies
from leafscribe.llm.packing import packed
from leafscribe.session import use_shared_checkpoints


def _text_hash(docs: DataFrame) -> Column:
    return F.unhex(F.sha2(F.coalesce(docs["text"], F.lit("")), 256))


def _named(docs: DataFrame) -> DataFrame:
    """`doc_id` and `text`, with (doc_id, hash of the text) as doc_id: null and repeated ids stand for one text each."""
    name = F.struct(docs["doc_id"].isNull().alias("no_id"), docs["doc_id"], _text_hash(docs).alias("text_hash"))
    return docs.select(name.alias("doc_id"), "text")


def _without(docs: DataFrame, decided: DataFrame) -> DataFrame:
    """Documents, with all their columns, that are not in the table `decided` of named ones."""
    keys = {"doc_id": docs["doc_id"], "text_hash": _text_hash(docs)}
    return keyed(docs, decided.select("doc_id.doc_id", "doc_id.text_hash"), keys, "left_anti")


def _once(docs: DataFrame) -> DataFrame:
    """`doc_id` and `text`, one row for each two of them. Keys are counted first; only texts of repeated ones move."""
    keys = {"doc_id": docs["doc_id"], "text_hash": _text_hash(docs)}
    counts = docs.groupBy(*[value.alias(k) for k, value in keys.items()]).agg(F.count(F.lit(1)).alias("n"))
    repeated = pin(counts.where("n > 1"))
    single = keyed(docs, repeated, keys, "left_anti").select("doc_id", "text")
    # Repeats meet inside each task first.
    return single.unionByName(keyed(docs, repeated, keys, "left_semi").select("doc_id", "text").distinct())


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text can have a language; those without one (null or without a letter) are rejected, row by row.

    Languages are learnt and predicted by `spoken_pages`; a text whose language was not learnt stays. `lang` is not
    replaced by the prediction: it stays what the source says. No rows give no rows; other columns pass, whatever
    their names.
    """
    return spoken_pages(docs, into="__lang_pred").drop("__lang_pred")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of identical texts: the one with the largest doc_id. Its repeated rows stay until `pack`."""
    dropped = exact_copies(docs).where(~F.col("kept"))
    text = F.coalesce(docs["text"], F.lit(""))
    keys = {"doc_id": docs["doc_id"], "text_sha256": F.sha2(text, 256)}
    return keyed(docs, dropped, keys, "left_anti")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest doc_id, null above all others.

    Texts of the group that share this doc_id are told apart by their hashes; the smallest stays, with its repeated rows.
    """
    return _without(docs, near_copies(_named(docs)).where(~F.col("kept")))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    benchmark = spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet")
    return _without(docs, benchmark_leaks(_named(docs), benchmark).where("contaminated"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2048 tokens; rows that repeat a doc_id and a text are packed once."""
    return packed(_once(docs), public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language", language),
    ("exact", exact),
    ("near", near),
    ("decontaminate", decontaminate),
    ("pack", pack),
]

#: Packing needs the tokenizer, which SQL has not; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each stage's rows are written to the shared folder and read again."""
    use_shared_checkpoints(spark)
    shared = spark.sparkContext.getCheckpointDir()
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        path = os.path.join(shared, f"{name}-{uuid.uuid4().hex}.parquet")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
