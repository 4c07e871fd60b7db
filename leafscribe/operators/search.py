"""One search over the catalog, and the way from its results to new pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leafscribe.operators.catalog import catalog_filter, cosine
from leafscribe.operators.fusion import fused
from leafscribe.sources.text_index import TextIndex
from leafscribe.sources.volumes import expand_pages, new_pages, page_name, route_sources

MODES = ("fts", "vector", "hybrid")
#: Records of a page where no limit is given, and the last position that a page may reach: every task keeps so many records.
PAGE, DEEPEST = 200, 100_000

RECORD = [
    "reference_code", "archive_code", "fonds_title", "fonds_description", "creator", "series_title", "volume_id",
    "date_text", "description",
]


def search_catalog(
    catalog: DataFrame,
    index: TextIndex,
    vectors: DataFrame | None = None,
    q: str | None = None,
    query_vector: Sequence[float] | None = None,
    mode: str | None = None,
    date_start: int | None = None,
    date_end: int | None = None,
    archive: str | None = None,
    limit: int | None = None,
    offset: int | None = None,
) -> DataFrame:
    """One page of catalog records, best first, with their `position` in the whole result, `score` and the `total` of matches.

    catalog: records with `reference_code` (unique), `year_start`, `archive_code` and the other record columns. `index` holds the texts by
    reference code, `vectors` has `reference_code` and `embedding`. An absent or empty parameter does not filter; a limit of 0 counts as absent. Pages
    beyond position `DEEPEST` are refused.
    Mode `fts` (the default) finds the records with a term of `q`, `vector` all with an embedding by cosine with `query_vector`, `hybrid` either,
    by reciprocal ranks among the records that pass the filters. Without `q` in mode `fts` every record matches, with score 0. Term
    weights are those of the whole catalog. Ties go to the smaller reference code.
    """
    mode = mode or "fts"
    if mode not in MODES:
        raise ValueError(f"mode {mode!r} is none of {', '.join(MODES)}")
    if mode != "fts" and (vectors is None or query_vector is None):
        raise ValueError(f"mode {mode} needs vectors and a query vector")
    limit, offset = limit or PAGE, offset or 0
    if offset + limit > DEEPEST:
        raise ValueError(f"a page ends at position {DEEPEST} at most; narrow the search, or take all matches from the index")
    records = catalog_filter(catalog, date_start, date_end, archive)
    passed = records.select("reference_code")
    filtered = date_start is not None or date_end is not None or bool(archive)

    def kept(hits: DataFrame) -> DataFrame:
        return hits.join(passed, "reference_code", "left_semi") if filtered else hits

    if q and mode != "vector":
        texts = kept(index.search(q).withColumnRenamed("key", "reference_code"))
    elif mode == "fts":
        texts = passed.withColumn("score", F.lit(0.0))
    else:
        texts = passed.withColumn("score", F.lit(None).cast("double")).limit(0)
    hits = texts
    if mode != "fts":
        near = vectors.select("reference_code", cosine(F.col("embedding"), query_vector).alias("score"))
        hits = kept(near.where("score IS NOT NULL"))
    if mode == "hybrid":
        both = texts.select("reference_code").unionByName(hits.select("reference_code")).distinct()
        total = both.agg(F.count(F.lit(1))).scalar()
        best = fused(texts, hits, "reference_code", offset + limit).select("reference_code", "score")
    else:
        total = hits.agg(F.count(F.lit(1))).scalar()
        best = hits.select("reference_code", "score")
    order = [F.desc("score"), F.asc("reference_code")]
    page = best.orderBy(*order).offset(offset).limit(limit)
    # A page has `limit` rows at most.
    page = page.withColumn("position", (F.row_number().over(Window.orderBy(*order)) + offset).cast("long"))
    found = records.select(*RECORD).join(F.broadcast(page), "reference_code")
    return found.select("position", *RECORD, "score").withColumn("total", total)


def open_records(found: DataFrame, resolved: DataFrame, manifests: DataFrame, known: DataFrame) -> DataFrame:
    """Pages that opening the found records adds to the workspace: each new page with its name, or the record's error.

    found: `reference_code`; resolved: `code`, `manifest_id`, `error`, a row for each code; manifests: `manifest_id`, `n_pages`;
    known: the workspace's pages (`manifest_id`, `page_number`). Two records of one volume add its pages once, under the smaller code.
    """
    routed = route_sources(found.select(F.col("reference_code").alias("code")), resolved)
    failed = routed.where("error IS NOT NULL").select("code", "manifest_id", F.lit(None).cast("int").alias("page_number"), "error")
    volumes = routed.where("error IS NULL").groupBy("manifest_id").agg(F.min("code").alias("code"))
    counted = volumes.join(manifests.select("manifest_id", "n_pages"), "manifest_id", "left")
    count = F.coalesce(F.col("n_pages"), F.lit(0)).cast("int")
    pages = expand_pages(counted, count).select("code", "manifest_id", "page_number", "error")
    fresh = new_pages(pages.where("error IS NULL"), known)
    every = fresh.unionByName(pages.where("error IS NOT NULL")).unionByName(failed)
    name = F.when(F.col("error").isNull(), page_name(F.col("manifest_id"), F.col("page_number")))
    return every.select(F.col("code").alias("reference_code"), "manifest_id", "page_number", name.alias("name"), "error")
