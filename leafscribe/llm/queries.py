"""Registered queries: thin steps from the given tables to the operators and back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafscribe.llm.exact import exact_copies
from leafscribe.llm.hosts import judge_image_urls
from leafscribe.llm.language import page_languages
from leafscribe.llm.leaks import benchmark_leaks
from leafscribe.llm.manifest import folded, record_digest, volume_manifest, witness_digest
from leafscribe.llm.near import near_copies
from leafscribe.llm.packing import packed
from leafscribe.llm.passages import without_repeats
from leafscribe.llm.private import private_data
from leafscribe.llm.quality import page_quality
from leafscribe.llm.similar import similar_records
from leafscribe.llm.spelling import spelling_variants, word_counts
from leafscribe.llm.toxicity import page_toxicity

#: Verdict, host and path of the stated address rules.
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@query
def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_copies(table(spark, sf_dir, "documents"))


@query
def op2_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packed(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = benchmark_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


@query
def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_languages(table(spark, sf_dir, "documents"))


@query
def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.col("url").alias("image_url"))
    return judge_image_urls(pages, RULES).withColumnRenamed("doc_id", "page_id")


@query
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents")).drop("kept_text")


@query
def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(table(spark, sf_dir, "documents"))


@query
def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return private_data(table(spark, sf_dir, "documents"))


@query
def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    ratings = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("grade"))
    return page_quality(table(spark, sf_dir, "documents"), ratings)


@query
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = ["page_number", "manifest_id", "lang", "n_chars", "text"]
    documents = table(spark, sf_dir, "documents")
    renamed = [F.col("doc_id").alias("page_number"), F.col("source").alias("manifest_id"), "lang", "n_chars", "text"]
    pages = documents.select(*renamed)
    # Tampering deletes the line breaks of the text of some pages.
    tampered = F.crc32(F.col("page_number").cast("string")) % 2 == 0
    text = F.when(tampered, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    claimed = record_digest(*[F.col(f) for f in fields[:-1]], text)
    found = volume_manifest(pages.withColumn("claimed", claimed), fields, ["claimed"])
    found = found.withColumn("folded_root", folded(F.col("claimed"), F.col("witness")))
    return found.select(
        F.col("page_number").alias("doc_id"), "leaf", "subroot", "root", witness_digest(F.col("witness")).alias("proof_sha256"),
        "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"),
    )


@query
def op12_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("reference_code"), "embedding")
    found = similar_records(records, F.col("reference_code") % 100 == 0, k=10, scale=1024.0)
    return found.select(F.col("query_code").alias("query_id"), "rank", F.col("reference_code").alias("vec_id"), "score")


@query
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(word_counts(table(spark, sf_dir, "documents"), fault=97))
