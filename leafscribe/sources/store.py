"""The saved transcriptions: serialise, compare, save, read, list and delete."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafscribe.functions.text import contains_folded, not_blank
from leafscribe.operators.scale import GROUP_ROWS, Ordered, ordinal, within, without
from leafscribe.session import pin

GROUP_KEY = ["manifest_id", "page_number", "group_pos"]
LINE_KEY = [*GROUP_KEY, "line_index"]


def serialize_for_save(
    lines: DataFrame,
    groups: DataFrame,
    first_volume_only: bool = False,
    limit: int = GROUP_ROWS,
) -> DataFrame:
    """Complete lines with text, numbered inside their group, with the group's name and box."""
    usable = lines.where(
        "manifest_id IS NOT NULL AND group_pos IS NOT NULL AND complete"
    ).where(not_blank(F.col("text")))
    if first_volume_only:
        owners = lines.where("manifest_id IS NOT NULL AND group_pos IS NOT NULL")
        first = owners.agg(F.min_by("manifest_id", "doc_id")).scalar()
        usable = usable.where(F.col("manifest_id") == first)
    numbered = ordinal(usable, ["doc_id", "group_pos"], ["line_pos", "line_id"], "_n", limit)
    named = numbered.join(groups, ["doc_id", "group_pos"])
    zero = F.lit(0.0)
    return named.select(
        "manifest_id",
        F.coalesce("page_number", F.lit(0)).alias("page_number"),
        "doc_id",
        "group_pos",
        F.col("name").alias("group_name"),
        *[F.coalesce(c, zero).alias("group_" + c) for c in ("rx", "ry", "rw", "rh")],
        (F.col("_n") - 1).cast("int").alias("line_index"),
        "x",
        "y",
        "w",
        "h",
        "text",
        "confidence",
        F.lit("htr").alias("source"),
        F.lit("").alias("contributor"),
    )


def digests(saved: DataFrame) -> DataFrame:
    """One fingerprint per volume, independent of row order, combined before the shuffle."""
    columns = [c for c in saved.columns if c != "manifest_id"]
    # Hashes skip nulls, so the rows are written out with them.
    written = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    row = F.xxhash64(written)
    other = F.xxhash64(F.lit("second"), written)
    return saved.groupBy("manifest_id").agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.sum(row.cast("decimal(20,0)")).alias("digest_sum"),
        F.bit_xor(other).alias("digest_xor"),
    )


def changed_volumes(current: DataFrame, saved_digests: DataFrame) -> DataFrame:
    """Volumes whose rows differ from the saved ones, with their new fingerprint."""
    keys = ["manifest_id", "n_lines", "digest_sum", "digest_xor"]
    return digests(current).join(saved_digests.select(*keys), keys, "left_anti")


def save(rows: DataFrame, path: str, keys=GROUP_KEY) -> None:
    """Upsert: the new rows of a group replace all its saved rows; other groups and volumes stay untouched."""
    spark = rows.sparkSession
    # Read several times, and it may come from the folder that is written.
    rows = pin(rows)
    merged = rows
    if _exists(spark, path):
        old = spark.read.schema(rows.schema).parquet(path)
        touched = within(old, rows, ["manifest_id"])
        merged = rows.unionByName(touched.join(rows.select(*keys).distinct(), keys, "left_anti"))
    # Pages of a volume stay together, but an outsized volume, page or group is spread.
    place = [
        F.floor(F.col(c) / n)
        for c, n in (("page_number", 1000), ("group_pos", 1000), ("line_index", 100_000))
    ]
    (
        merged.repartition("manifest_id", *place)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("manifest_id")
        .parquet(path)
    )


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def saved_rows(spark: SparkSession, path: str, manifest_id: str | None = None) -> DataFrame:
    """Saved lines; naming a volume reads only its partition."""
    rows = spark.read.parquet(path)
    return rows if manifest_id is None else rows.where(F.col("manifest_id") == manifest_id)


def read_transcriptions(
    saved: DataFrame, query: str = "", limit: int = GROUP_ROWS
) -> DataFrame:
    """Saved groups with their lines in order; `part` counts blocks of an oversized group."""
    kept = saved.where(contains_folded(F.col("text"), query))
    line = F.struct("line_index", "x", "y", "w", "h", "text", "confidence", "source", "contributor")
    keys = ["manifest_id", "page_number", "group_pos", "group_name"]
    keys += ["group_rx", "group_ry", "group_rw", "group_rh"]
    return Ordered(kept, keys, ["line_index"], limit).collected(line, "lines")


def list_saved(saved: DataFrame, query: str = "") -> DataFrame:
    """Line, group and page counts per volume, through two small pre-aggregates."""
    kept = saved.where(contains_folded(F.col("text"), query))
    groups = kept.groupBy("manifest_id", "page_number", "group_pos").agg(
        F.count(F.lit(1)).alias("n"), F.max("saved_at").alias("t"), F.max("reference_code").alias("r")
    )
    pages = groups.groupBy("manifest_id", "page_number").agg(
        F.sum("n").alias("n"),
        F.count(F.lit(1)).alias("g"),
        F.max("t").alias("t"),
        F.max("r").alias("r"),
    )
    return pages.groupBy("manifest_id").agg(
        F.max("r").alias("reference_code"),
        F.sum("n").alias("lines"),
        F.sum("g").alias("groups"),
        F.count(F.lit(1)).alias("pages"),
        F.max("t").alias("last_saved"),
    )


def delete_volumes(saved: DataFrame, volumes: DataFrame) -> DataFrame:
    """The saved rows without the listed volumes."""
    return without(saved, volumes, ["manifest_id"])


def drop_saved_volume(spark: SparkSession, table: str, manifest_id: str) -> None:
    """Removes one volume from a catalog table partitioned by `manifest_id`."""
    value = manifest_id.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(f"ALTER TABLE {table} DROP IF EXISTS PARTITION (manifest_id='{value}')")
