"""Whole pages from raw detector output to saved lines, as one plan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafscribe.functions.numbers import half_up
from leafscribe.operators.geometry import (
    INPUT_SIZE,
    crop_clamp,
    decode_lines,
    decode_regions,
    mask_to_page,
    reading_order,
    region_shape,
    simplify_polygons,
)
from leafscribe.operators.masks import MASK, mask_polygons
from leafscribe.operators.scale import has_large_group, ordinal
from leafscribe.operators.suppression import IMAGE_BOXES, nms
from leafscribe.operators.tokens import error_sentinel, place_reader, read_lines
from leafscribe.session import pin
from leafscribe.sources.store import serialize_for_save

PAGE_WIDTH, PAGE_HEIGHT = 1200.0, 1600.0
CROP = ["image_id", "region_id"]


def regions_of(raw_regions: DataFrame) -> DataFrame:
    """Regions of each page in reading order, with the name of the group they become."""
    # Every later step only has fewer rows per page than the raw output: one look is enough.
    small = not has_large_group(raw_regions, ["image_id"], IMAGE_BOXES)
    kept = region_shape(nms(decode_regions(raw_regions), key="anchor_idx", small=small))
    placed = reading_order(kept, group="image_id", key="anchor_idx", small=small or None)
    percent = half_up(F.col("score") * 100).cast("string")
    return placed.withColumn("region_id", F.col("position").cast("int")).withColumn(
        "group_name", F.concat("label", F.lit(" ("), percent, F.lit("%)"))
    )


def crop_lines(raw_lines: DataFrame, regions: DataFrame) -> DataFrame:
    """The raw boxes that lie on a crop of `regions`, kept: suppression, outlines and size looks all read them."""
    # Pages first: boxes that were numbered by page are not shuffled for this, and fewer go on to the crops.
    of_pages = raw_lines.join(regions.select("image_id").distinct(), "image_id", "left_semi")
    return pin(of_pages.join(regions.select(*CROP), CROP, "left_semi"))


def lines_of(raw_lines: DataFrame, regions: DataFrame, small: bool | None = None) -> DataFrame:
    """Line boxes on the page. raw_lines are the detector's output per region crop
    (image_id, region_id); a crop takes the place of the image in suppression."""
    cropped = crop_clamp(regions, PAGE_WIDTH, PAGE_HEIGHT)
    origin = [F.col("cx").alias("crop_x"), F.col("cy").alias("crop_y")]
    held = cropped.select("image_id", "region_id", "group_name", *origin)
    # What belongs to the crop rides along in its key, so regions are joined only once.
    crop = F.struct("image_id", "region_id", "group_name", "crop_x", "crop_y")
    keyed = raw_lines.join(held, ["image_id", "region_id"])
    kept = nms(decode_lines(keyed.withColumn("image_id", crop)), small=small)
    return kept.select(
        "image_id.image_id",
        "image_id.region_id",
        "image_id.group_name",
        "image_id.crop_x",
        "image_id.crop_y",
        "det_id",
        F.col("score").alias("det_confidence"),
        (F.col("x") + F.col("image_id.crop_x")).alias("x"),
        (F.col("y") + F.col("image_id.crop_y")).alias("y"),
        "w",
        "h",
    )


def outlines_of(
    lines: DataFrame, raw_lines: DataFrame, prototypes: DataFrame, mask: int = MASK, small: bool | None = None
) -> DataFrame:
    """Simplified outlines of the kept lines on the page: `image_id`, `region_id`, `det_id`, `polygon`."""
    half = lambda c, d, sign: F.col(c) + sign * F.col(d) / 2
    corners = {"x1": half("cx", "bw", -1), "y1": half("cy", "bh", -1), "x2": half("cx", "bw", 1), "y2": half("cy", "bh", 1)}
    frame = ["orig_w", "orig_h", "scale", "pad_x", "pad_y"]
    raw = raw_lines.select(*CROP, "det_id", "coefficients", *frame, *[v.alias(c) for c, v in corners.items()])
    wanted = lines.select(*CROP, "det_id", "crop_x", "crop_y").join(raw, [*CROP, "det_id"])
    # What the outline needs later rides along in its key.
    name = F.struct("det_id", "crop_x", "crop_y", *frame).alias("det")
    drawn = mask_polygons(wanted.withColumn("det", name), prototypes, CROP, "det", mask, small=small)
    drawn = drawn.select(*CROP, "det.*", "polygon", F.lit(0.0).alias("mask_x"), F.lit(0.0).alias("mask_y"))
    placed = mask_to_page(drawn, mask / INPUT_SIZE)
    moved = F.transform("polygon", lambda p: F.struct((p["x"] + F.col("crop_x")).alias("x"), (p["y"] + F.col("crop_y")).alias("y")))
    return simplify_polygons(placed.withColumn("polygon", moved)).select(*CROP, "det_id", "polygon")


def transcribe_pages(
    raw_regions: DataFrame,
    raw_lines: DataFrame,
    prototypes: DataFrame | None = None,
    make_reader: Callable | None = None,
    mask: int = MASK,
    regions: DataFrame | None = None,
) -> DataFrame:
    """Regions, lines, outlines, order and read text of every page; one row per line.

    raw_lines: boxes per region crop, with `coefficients` where `prototypes` (per crop and tile, `operators.masks`) are given; else lines have
    no outline. The reader gets boxes (x, y, w, h) and returns text and confidence; lines that it fails on hold the failure text with
    confidence 0 and are complete. `regions` may be given where the caller keeps them, then with the `crop_lines` of them as raw_lines.
    """
    if regions is None:
        regions = pin(regions_of(raw_regions))
        raw_lines = crop_lines(raw_lines, regions)
    small = not has_large_group(raw_lines, CROP, IMAGE_BOXES)
    lines = lines_of(raw_lines, regions, small)
    order = ["y", "x", "det_id"]
    numbered = ordinal(lines, CROP, order, "_n", small=small or None)
    numbered = numbered.withColumn("line_index", (F.col("_n") - 1).cast("int")).drop("_n")
    if prototypes is None:
        numbered = numbered.drop("crop_x", "crop_y").withColumn("polygon", F.lit(None).cast("array<struct<x:double,y:double>>"))
    else:
        # Suppression is not run again for the outlines.
        numbered = pin(numbered)
        numbered = numbered.join(outlines_of(numbered, raw_lines, prototypes, mask, small), [*CROP, "det_id"], "left")
    boxed = numbered.withColumn("_box", F.array("x", "y", "w", "h"))
    read = read_lines(boxed, make_reader or place_reader(), ["_box"], [[4]])
    read = read.withColumn("text_confidence", F.col("confidence"))
    return error_sentinel(read).select(
        "image_id", "region_id", "group_name", "det_id", "line_index", "x", "y", "w", "h", "polygon", "text",
        "det_confidence", "text_confidence", "confidence", "complete",
    )


def saved_pages(lines: DataFrame, regions: DataFrame, pages: DataFrame) -> DataFrame:
    """The lines of `transcribe_pages` as rows for the store: numbered in their group, with the group's box.

    pages: `image_id`, `manifest_id`, `page_number`.
    """
    placed = lines.join(pages.select("image_id", "manifest_id", "page_number"), "image_id")
    # Kept: numbering looks at group sizes first, and the reader shall not run again for that.
    shaped = pin(placed.select(
        "manifest_id", "page_number", F.col("image_id").alias("doc_id"), F.col("region_id").alias("group_pos"),
        F.col("line_index").alias("line_pos"), F.col("det_id").alias("line_id"), "text", "x", "y", "w", "h", "confidence", "complete",
    ))
    rect = [F.col(c).alias("r" + c) for c in ("x", "y", "w", "h")]
    groups = regions.select(F.col("image_id").alias("doc_id"), F.col("region_id").alias("group_pos"), F.col("group_name").alias("name"), *rect)
    return serialize_for_save(shaped, groups)
