"""From files, harvest records and manifests to the pages of a volume."""

from __future__ import annotations

import re
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafscribe.functions.text import pad_number, trimmed
from leafscribe.operators.scale import GROUP_ROWS, ordinal

# Link patterns that carry a volume id, and error texts.
VIEWER_LINK = re.compile("bildvisning/([A-Za-z0-9]+)")
MANIFEST_LINK = re.compile("arkis[%!]21?([A-Z0-9]+)/manifest", re.IGNORECASE | re.ASCII)
VOLUME_ID = "(?i)^[A-Z][0-9]{5,}$"
NO_VOLUME = "Could not find IIIF manifest ID in OAI-PMH response"
NO_PAGES = "No pages found in this volume"
UNKNOWN_ERROR = "Unknown error"
SMALLEST_IMAGE = 100

IMAGE_TYPE = "image/"
# Types of common image file endings; other files have none.
FILE_TYPES = {
    "jpg": "image/jpeg",
    "jpeg": "image/jpeg",
    "png": "image/png",
    "gif": "image/gif",
    "webp": "image/webp",
    "tif": "image/tiff",
    "tiff": "image/tiff",
    "bmp": "image/bmp",
    "avif": "image/avif",
    "svg": "image/svg+xml",
}


def image_upload(files: DataFrame, order: str, upload: int = 1, limit: int = GROUP_ROWS):
    """Files (name, ctype, ...) whose type is an image, as the pages of one new volume."""
    kept = files.where(F.col("ctype").startswith(IMAGE_TYPE))
    kept = kept.withColumn("manifest_id", F.lit(f"upload-{upload}"))
    numbered = ordinal(kept, ["manifest_id"], [order], "page_number", limit)
    return numbered.withColumn("page_number", F.col("page_number").cast("int"))


def scan_folder(spark: SparkSession, folder: str, upload: int = 1) -> DataFrame:
    """The image files of a folder by path, as a new volume. File contents are not read."""
    found = spark.read.format("binaryFile").load(folder).select("path", "length")
    ending = F.lower(F.regexp_extract("path", r"\.(\w+)$", 1))
    types = F.create_map(*[F.lit(v) for pair in FILE_TYPES.items() for v in pair])
    typed = found.select(
        "path",
        F.element_at(F.split("path", "/"), -1).alias("name"),
        F.try_element_at(types, ending).alias("ctype"),
        F.col("length").alias("n_bytes"),
    )
    return image_upload(typed, "path", upload)


def _volume_in(link: str) -> str | None:
    found = VIEWER_LINK.search(link)
    if not found and "/manifest" in link:
        found = MANIFEST_LINK.search(link)
    return found and found.group(1)


class _Record:
    """Reads one harvest record element by element; keeps only its first volume and its first error."""

    def __init__(self):
        self.volume = self.code = None
        self.texts: list[str] | None = None
        self.depth = 0
        self.inside = False

    def opened(self, tag: str, attributes: dict[str, str]) -> None:
        name = tag.rpartition(":")[2]
        if self.inside:
            self.depth += 1
        elif name == "error" and self.texts is None:
            self.texts, self.code, self.inside = [], attributes.get("code"), True
        # A link inside an error counts for nothing, as the error decides.
        if name == "dao" and self.volume is None:
            links = [v for k, v in attributes.items() if k.endswith(":href")]
            self.volume = _volume_in(attributes.get("xlink:href") or (links[0] if links else ""))

    def closed(self, tag: str) -> None:
        if self.inside:
            self.inside = self.depth > 0
            self.depth -= 1 if self.inside else 0

    def characters(self, text: str) -> None:
        if self.inside:
            self.texts.append(text)

    def result(self) -> tuple[str | None, str | None]:
        if self.texts is not None:
            return None, "".join(self.texts) or self.code or UNKNOWN_ERROR
        return (self.volume, None) if self.volume else (None, NO_VOLUME)


def read_record(xml: str | None) -> tuple[str | None, str | None]:
    """(volume id, error) of a harvest record, one of the two is None.

    Entities, character references, character data and comments are XML's. A record that is not well formed (broken off,
    empty, with entities that grow too large) has no volume, whatever stands before the break.
    """
    record = _Record()
    # Names keep their prefixes, so that one without a declaration is no fault.
    parser = expat.ParserCreate()
    parser.StartElementHandler, parser.EndElementHandler = record.opened, record.closed
    parser.CharacterDataHandler = record.characters
    try:
        parser.Parse(xml or "", True)
    except expat.ExpatError:
        return None, NO_VOLUME
    return record.result()


def _read_records(records: pa.Array) -> pa.Array:
    found = [read_record(r.as_py()) for r in records]
    columns = [pa.array([f[i] for f in found], pa.string()) for i in range(2)]
    return pa.StructArray.from_arrays(columns, ["manifest_id", "error"])


def resolve_harvest(records: DataFrame, xml: str = "xml") -> DataFrame:
    """Adds `manifest_id` and `error`, one of the two is null; records are read in Arrow batches.

    The link elements may sit at any depth; the first link that holds a volume id wins. An error element decides alone. A
    broken record never stops the job: it is an error row.
    """
    found = records.withColumn("_found", F.arrow_udf(_read_records, "manifest_id string, error string")(xml))
    return found.withColumns({"manifest_id": F.col("_found.manifest_id"), "error": F.col("_found.error")}).drop("_found")


def page_count(manifest: Column) -> Column:
    items = F.json_array_length(F.get_json_object(manifest, "$.items"))
    return F.coalesce(items, F.lit(0))


def page_url(base: str, manifest_id: Column, page: Column) -> Column:
    return F.concat(
        F.lit(f"{base}/arkis!"), manifest_id, F.lit("_"), pad_number(page),
        F.lit("/full/max/0/default.jpg"),
    )


def page_name(manifest_id: Column, page: Column) -> Column:
    return F.concat(manifest_id, F.lit("_"), pad_number(page), F.lit(".jpg"))


def valid_fetches(fetches: DataFrame) -> DataFrame:
    return fetches.where(
        F.col("status").between(200, 299)
        & F.col("ctype").startswith("image/")
        & (F.col("n_bytes") >= SMALLEST_IMAGE)
    )


def expand_pages(
    volumes: DataFrame, count: Column, first: Column | None = None, last: Column | None = None
) -> DataFrame:
    """One row per requested page; a volume without pages gives one error row."""
    start = F.lit(1) if first is None else F.greatest(F.lit(1), first)
    end = count if last is None else F.least(last, count)
    sized = volumes.withColumns({"_n": count, "_start": start, "_end": end})
    pages = F.when(F.col("_end") >= F.col("_start"), F.sequence("_start", "_end"))
    rows = F.when(F.col("_n") == 0, F.array(F.lit(None).cast("int"))).otherwise(pages)
    return (
        sized.withColumn("page_number", F.explode(rows))
        .withColumn("error", F.when(F.col("_n") == 0, F.lit(NO_PAGES)))
        .drop("_n", "_start", "_end")
    )


def looks_like_volume(code: Column) -> Column:
    return trimmed(code).rlike(VOLUME_ID)


def route_sources(requests: DataFrame, resolved: DataFrame) -> DataFrame:
    """Requests `code` that already are volume ids pass, the others take the resolved id.

    `resolved` has one row (code, manifest_id, error) per reference code.
    """
    direct = requests.where(looks_like_volume(F.col("code"))).select(
        "code", trimmed(F.col("code")).alias("manifest_id"), F.lit(None).cast("string").alias("error")
    )
    other = requests.where(~looks_like_volume(F.col("code")))
    answered = other.join(resolved.select("code", "manifest_id", "error"), "code", "left")
    unanswered = F.col("manifest_id").isNull() & F.col("error").isNull()
    answered = answered.select(
        "code",
        "manifest_id",
        F.when(unanswered, F.lit(NO_VOLUME)).otherwise(F.col("error")).alias("error"),
    )
    return direct.unionByName(answered)


def new_pages(wanted: DataFrame, known: DataFrame) -> DataFrame:
    """Wanted pages (manifest_id, page_number) that the workspace does not hold."""
    keys = ["manifest_id", "page_number"]
    return wanted.join(known.select(*keys), keys, "left_anti")
