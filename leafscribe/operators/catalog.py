"""Catalog search: filters, full text, vectors, fused ranks, pages of results and the tree."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leafscribe.functions.text import or_else, query_terms, terms
from leafscribe.operators.scale import lookup
from leafscribe.session import pin
from leafscribe.sources.text_index import K1, B



def catalog_filter(
    catalog: DataFrame,
    date_start: int | None = None,
    date_end: int | None = None,
    archive: str | None = None,
) -> DataFrame:
    """Absent parameters do not filter; an empty archive code counts as absent."""
    if date_start is not None:
        catalog = catalog.where(F.col("year_start") >= date_start)
    if date_end is not None:
        catalog = catalog.where(F.col("year_start") <= date_end)
    if archive:
        catalog = catalog.where(F.col("archive_code") == archive)
    return catalog


def full_text(docs: DataFrame, text: str, query: str) -> DataFrame:
    """Rows that hold any query term, without their text and with their BM25 `score`, from the texts themselves.

    For texts that are searched once; `sources.text_index` keeps posting lists for those that are searched often.
    Term counts come from each row's own array, so nothing is exploded or shuffled. The
    texts are cut once: the counts are pinned, as both the corpus statistics (one row) and
    the scores need them.
    """
    wanted = sorted(set(query_terms(query)))
    kept = [c for c in docs.columns if c != text]
    if not wanted:
        return docs.select(*kept, F.lit(0.0).alias("score")).limit(0)
    cut = docs.select(*kept, terms(F.col(text)).alias("_terms"))
    counts = [_occurrences("_terms", q).alias(f"_t{i}") for i, q in enumerate(wanted)]
    counted = pin(cut.select(*kept, F.size("_terms").alias("_len"), *counts))
    tfs = [F.col(f"_t{i}") for i in range(len(wanted))]
    seen = [F.count_if(tf > 0).alias(f"df{i}") for i, tf in enumerate(tfs)]
    stats = counted.agg(
        F.struct(F.count(F.lit(1)).alias("n"), F.avg("_len").alias("mean"), *seen).alias("s")
    )
    hits = counted.where(F.greatest(*tfs, F.lit(0)) > 0).withColumn("_stats", stats.scalar())
    total = F.lit(0.0)
    for i, tf in enumerate(tfs):
        df = F.col(f"_stats.df{i}")
        idf = F.log(1 + (F.col("_stats.n") - df + 0.5) / (df + 0.5))
        norm = tf + K1 * (1 - B + B * F.col("_len") / F.col("_stats.mean"))
        total = total + F.when(tf > 0, idf * tf * (K1 + 1) / norm).otherwise(0.0)
    return hits.select(*kept, total.alias("score"))


def _occurrences(column: str, term: str) -> Column:
    return F.size(column) - F.size(F.array_remove(column, term))


def top(df: DataFrame, score: str, key: str, k: int) -> DataFrame:
    return df.orderBy(F.desc(score), F.asc(key)).limit(k)


def cosine(vector: Column, query: Sequence[float]) -> Column:
    """Cosine with a fixed query vector, in doubles; null for a zero vector."""
    target = F.array(*[F.lit(float(q)) for q in query])
    dot = F.aggregate(
        F.zip_with(vector, target, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, p: s + p
    )
    square = F.aggregate(
        vector, F.lit(0.0), lambda s, a: s + a.cast("double") * a.cast("double")
    )
    size = math.sqrt(sum(float(q) ** 2 for q in query))
    return F.try_divide(dot, F.sqrt(square) * size)


def vector_search(
    table: DataFrame, queries: Mapping[str, Sequence[float]], k: int, vector="embedding", key="vec_id"
) -> DataFrame:
    """Exact top-k per query. Each row scores all queries in one pass over the table.

    The rank filter lets every task drop all but its own best k before the shuffle.
    """
    scores = F.array(
        *[
            F.struct(F.lit(name).alias("query"), cosine(F.col(vector), q).alias("score"))
            for name, q in queries.items()
        ]
    )
    scored = table.select(F.col(key), F.explode(scores).alias("s")).select(key, "s.*")
    window = Window.partitionBy("query").orderBy(F.desc("score"), F.asc(key))
    ranked = scored.where("score IS NOT NULL").withColumn("rank", F.row_number().over(window))
    return ranked.where(F.col("rank") <= k)


def result_page(hits: DataFrame, key: str, limit: int, offset: int = 0) -> DataFrame:
    """One page by falling score, with the total match count on every row."""
    total = hits.agg(F.count(F.lit(1))).scalar()
    page = hits.orderBy(F.desc("score"), F.asc(key)).offset(offset).limit(limit)
    return page.withColumn("total", total)


def append_page(held: DataFrame, hits: DataFrame, key: str, limit: int) -> DataFrame:
    """The held results and the next page after them, with `has_more`.

    The next page starts behind the last held (score, key): nothing is skipped over again.
    """
    last = F.struct(F.col("score").alias("s"), F.col(key).alias("k"))
    end = held.agg(F.max_by(last, F.struct((-F.col("score")).alias("d"), F.col(key)))).scalar()
    rest = hits.where(
        end.isNull()
        | (F.col("score") < end["s"])
        | ((F.col("score") == end["s"]) & (F.col(key) > end["k"]))
    )
    following = rest.orderBy(F.desc("score"), F.asc(key)).limit(limit)
    shown = held.select(*hits.columns).unionByName(following)
    counted = shown.agg(F.count(F.lit(1))).scalar() < hits.agg(F.count(F.lit(1))).scalar()
    return shown.withColumn("has_more", counted)


def catalog_tree(catalog: DataFrame, seq: str) -> DataFrame:
    """Tree nodes of fonds and series, plus the records as leaves, as an adjacency table.

    Children are not packed into arrays, so a fonds of any size stays spread. `first_seen`
    is the order inside the parent.
    """
    keyed = catalog.withColumns(
        {
            "fonds": or_else(F.col("fonds_title"), F.col("reference_code")),
            "series": F.coalesce("series_title", F.lit("")),
        }
    )
    first = F.struct("fonds_description", "creator", "archive_code")
    per_series = keyed.groupBy("fonds", "series").agg(
        F.count(F.lit(1)).alias("n_volumes"),
        F.min(seq).alias("first_seen"),
        F.min_by(first, seq).alias("f"),
    )
    per_fonds = per_series.groupBy("fonds").agg(
        F.sum("n_volumes").alias("n_volumes"),
        F.min("first_seen").alias("_seen"),
        F.min_by("f", "first_seen").alias("f"),
    )
    nothing = F.lit(None).cast("string")
    fonds = per_fonds.select(
        F.lit("fonds").alias("level"),
        "fonds",
        nothing.alias("series"),
        nothing.alias("reference_code"),
        F.col("_seen").alias("first_seen"),
        "n_volumes",
        F.coalesce("f.fonds_description", F.lit("")).alias("description"),
        F.coalesce("f.creator", F.lit("")).alias("creator"),
        F.coalesce("f.archive_code", F.lit("")).alias("archive_code"),
    )
    series = per_series.select(
        F.lit("series").alias("level"),
        "fonds",
        "series",
        nothing.alias("reference_code"),
        "first_seen",
        "n_volumes",
        *[nothing.alias(c) for c in ("description", "creator", "archive_code")],
    )
    volumes = keyed.select(
        F.lit("volume").alias("level"),
        "fonds",
        "series",
        "reference_code",
        F.col(seq).alias("first_seen"),
        F.lit(1).cast("long").alias("n_volumes"),
        *[nothing.alias(c) for c in ("description", "creator", "archive_code")],
    )
    return fonds.unionByName(series).unionByName(volumes)


def catalog_counts(catalog: DataFrame) -> DataFrame:
    """Volumes per fonds (`series` null) and per series. The fonds sums the series counts."""
    keyed = catalog.select(
        or_else(F.col("fonds_title"), F.col("reference_code")).alias("fonds"),
        F.coalesce("series_title", F.lit("")).alias("series"),
    )
    per_series = keyed.groupBy("fonds", "series").agg(F.count(F.lit(1)).alias("n"))
    rolled = per_series.rollup("fonds", "series").agg(
        F.sum("n").alias("n_volumes"), F.grouping_id().alias("g")
    )
    return rolled.where("g < 3").select(
        "fonds", "series", "n_volumes", (F.col("g") == 1).alias("is_fonds")
    )


def highlight(text: Column, query: str) -> Column:
    """Text before, in and after the first case-insensitive match of the query."""
    wanted = query.strip()
    at = F.instr(F.lower(text), wanted.lower()) if wanted else F.lit(0)
    hit = F.coalesce(at > 0, F.lit(False))
    empty = F.lit("")
    end = at + len(wanted)
    return F.struct(
        F.when(hit, F.substr(text, F.lit(1), at - 1)).otherwise(text).alias("before"),
        F.when(hit, F.substr(text, at, F.lit(len(wanted)))).otherwise(empty).alias("match"),
        F.when(hit, F.substr(text, end)).otherwise(empty).alias("after"),
    )


def random_volume(catalog: DataFrame, seed: int, n_pages: Column) -> DataFrame:
    """One record and one of its pages, the same for the same seed."""
    draw = F.md5(F.concat_ws(":", F.lit(str(seed)), "reference_code").cast("binary"))
    chosen = catalog.withColumn("_draw", draw).orderBy("_draw", "reference_code").limit(1)
    number = F.conv(F.substr("_draw", F.lit(1), F.lit(8)), 16, 10).cast("long")
    page = F.when(n_pages > 0, number % n_pages.cast("long") + 1)
    return chosen.withColumn("page_number", page).drop("_draw")


def titles(catalog: DataFrame) -> DataFrame:
    """Heading and `series / vol. id (date)` with empty parts left out."""
    series = or_else(F.col("series_title"), F.lit(None))
    date = or_else(F.col("date_text"), F.lit(None))
    volume = F.concat(F.lit("vol. "), F.col("volume_id"))
    place = F.concat_ws(" / ", series, volume)
    return catalog.select(
        "reference_code",
        or_else(F.col("fonds_title"), F.col("reference_code")).alias("title"),
        F.concat_ws(" ", place, F.concat(F.lit("("), date, F.lit(")"))).alias("subtitle"),
    )


def latest_metadata(loads: DataFrame, seq: str, columns: Sequence[str]) -> DataFrame:
    """The catalog record loaded last for each volume."""
    newest = loads.groupBy("manifest_id").agg(F.max_by(F.struct(*columns), seq).alias("m"))
    return newest.select("manifest_id", "m.*")


def with_metadata(pages: DataFrame, metadata: DataFrame) -> DataFrame:
    """Pages with the record of their volume, if there is one."""
    return lookup(pages, metadata, ["manifest_id"])

