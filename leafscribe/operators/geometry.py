"""Decoding of raw boxes, contours, reading order and spatial joins."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafscribe.functions.boxes import (
    box,
    crop_extent,
    crop_origin,
    in_shape,
    iou,
    shifted,
    sigmoid,
)
from leafscribe.functions.numbers import half_up
from leafscribe.operators.scale import (
    GROUP_ROWS,
    Ordered,
    divided,
    has_large_group,
    large_groups,
    ordinal,
)

# Anchor strides, input size and thresholds of the two detectors.
STRIDES = (8, 16, 32)
INPUT_SIZE = 640
REGION_SCORE = 0.3
LINE_SCORE = 0.25
MAX_IOU = 0.45
SIMPLIFY_DISTANCE = 2.0
COPY_PAD = 8
PREVIEW_PAD = 12
REGION_LABEL = "text_region"

# Edge of the square cells that spatial joins meet in.
CELL = 128.0

POLYGON = T.ArrayType(
    T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
)


# Decoding ---------------------------------------------------------------------------------


def anchors(spark: SparkSession, size: int = INPUT_SIZE) -> DataFrame:
    """Anchor points: the strides in turn, each grid row by row. 8 400 rows at size 640."""
    parts, offset = [], 0
    for stride in STRIDES:
        grid = size // stride
        parts.append(
            spark.range(grid * grid).select(
                (F.col("id") + offset).cast("int").alias("anchor_idx"),
                ((F.col("id") % grid) * stride).cast("double").alias("ax"),
                (F.floor(F.col("id") / grid) * stride).cast("double").alias("ay"),
            )
        )
        offset += grid * grid
    first, *rest = parts
    for part in rest:
        first = first.unionByName(part)
    return first


def decode_regions(
    raw: DataFrame,
    size: int = INPUT_SIZE,
    resize_scale: float = 1.0,
    min_score: float = REGION_SCORE,
) -> DataFrame:
    """Boxes from distances around anchors. The anchor is arithmetic on its index: no join."""
    index = F.col("anchor_idx").cast("long")
    ax = ay = None
    offset = 0
    for stride in STRIDES:
        grid = size // stride
        here = index.between(offset, offset + grid * grid - 1)
        x = ((index - offset) % grid) * stride
        y = F.floor((index - offset) / grid) * stride
        ax = F.when(here, x) if ax is None else ax.when(here, x)
        ay = F.when(here, y) if ay is None else ay.when(here, y)
        offset += grid * grid
    scored = raw.withColumn("score", sigmoid(F.col("logit"))).where(F.col("score") >= min_score)
    placed = scored.withColumns({"_ax": ax.cast("double"), "_ay": ay.cast("double")})
    inverse = 1.0 / resize_scale
    corners = placed.withColumns(
        {
            "x1": (F.col("_ax") - F.col("l")) * inverse,
            "y1": (F.col("_ay") - F.col("t")) * inverse,
            "x2": (F.col("_ax") + F.col("r")) * inverse,
            "y2": (F.col("_ay") + F.col("b")) * inverse,
        }
    )
    return corners.where("_ax IS NOT NULL").select(
        "image_id",
        "anchor_idx",
        "score",
        F.col("x1").alias("x"),
        F.col("y1").alias("y"),
        (F.col("x2") - F.col("x1")).alias("w"),
        (F.col("y2") - F.col("y1")).alias("h"),
    )


def region_shape(boxes: DataFrame) -> DataFrame:
    """Clips the origin to the page without changing the size; sizes are not negative."""
    zero = F.lit(0.0)
    clipped = {c: F.greatest(zero, F.col(c)) for c in ("x", "y", "w", "h")}
    label = F.col("label") if "label" in boxes.columns else F.lit(None).cast("string")
    return boxes.withColumns({**clipped, "label": F.coalesce(label, F.lit(REGION_LABEL))})


def decode_lines(raw: DataFrame, min_score: float = LINE_SCORE) -> DataFrame:
    """Centre boxes in padded space to boxes in page space; the first best class wins, NaN never does.

    The size is limited by the page edge seen from the unclipped origin, so it may be negative.
    """
    best = F.array_max(F.filter("scores", lambda s: ~F.isnan(s)))
    scored = raw.withColumn("score", best).where(F.col("score") >= min_score)
    x = (F.col("cx") - F.col("bw") / 2 - F.col("pad_x")) / F.col("scale")
    y = (F.col("cy") - F.col("bh") / 2 - F.col("pad_y")) / F.col("scale")
    placed = scored.withColumns({"_x": x, "_y": y})
    zero = F.lit(0.0)
    return placed.select(
        "image_id",
        "det_id",
        (F.array_position("scores", F.col("score")) - 1).cast("int").alias("class_id"),
        "score",
        F.greatest(zero, F.least("_x", "orig_w")).alias("x"),
        F.greatest(zero, F.least("_y", "orig_h")).alias("y"),
        F.least(F.col("bw") / F.col("scale"), F.col("orig_w") - F.col("_x")).alias("w"),
        F.least(F.col("bh") / F.col("scale"), F.col("orig_h") - F.col("_y")).alias("h"),
    )


def iou_with_best(boxes: DataFrame) -> DataFrame:
    """IoU of every box with the highest-scored box of its image: linear, not all pairs."""
    order = F.struct((-F.col("score")).alias("s"), F.col("det_id"))
    best = boxes.groupBy("image_id").agg(
        F.min_by(F.struct("det_id", "x", "y", "w", "h"), order).alias("best")
    )
    joined = boxes.join(best, "image_id")
    mine = box(F.col("x"), F.col("y"), F.col("w"), F.col("h"))
    return joined.select(
        "image_id",
        "det_id",
        F.col("best.det_id").alias("best_det_id"),
        iou(mine, F.col("best")).alias("iou"),
    )


# Contours ---------------------------------------------------------------------------------


def mask_contour(logits: DataFrame) -> DataFrame:
    """Outline points of each mask in order: left edge downwards, then right edge upwards.

    A mask pixel is set at logit >= 0 (sigmoid 0.5). One row per point, so a mask of any
    size stays spread; `position` is the sort key inside the mask. Masks with fewer than
    two rows set have no outline.
    """
    edges = (
        logits.where("logit >= 0")
        .groupBy("det_id", "y")
        .agg(F.min("x").alias("left"), (F.max("x") + 1).alias("right"))
    )
    spans = edges.groupBy("det_id").agg(F.min("y").alias("first"), F.max("y").alias("last"))
    usable = edges.join(spans.where("last > first").select("det_id"), "det_id", "left_semi")
    sides = F.array(
        F.struct(F.lit(0).alias("side"), F.col("y").alias("position"), F.col("left").alias("x")),
        F.struct(F.lit(1).alias("side"), (-F.col("y")).alias("position"), F.col("right").alias("x")),
    )
    return usable.select("det_id", "y", F.explode(sides).alias("e")).select(
        "det_id", "e.side", "e.position", "e.x", "y"
    )


def outline_polygons(contour: DataFrame, limit: int = GROUP_ROWS) -> DataFrame:
    """Outline points packed into one polygon per mask (`part` > 0 only beyond `limit` points)."""
    point = F.struct(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    return Ordered(contour, ["det_id"], ["side", "position"], limit).collected(point, "polygon")


def mask_to_page(polygons: DataFrame, mask_scale: float = 160 / INPUT_SIZE) -> DataFrame:
    """Outline points from mask space to page space, clipped to the page.

    Needs polygon, mask_x, mask_y, pad_x, pad_y, scale, orig_w and orig_h.
    """

    def place(value, origin, pad, extent):
        moved = ((value + F.col(origin)) / mask_scale - F.col(pad)) / F.col("scale")
        return F.greatest(F.lit(0.0), F.least(F.col(extent), moved))

    moved = F.transform(
        "polygon",
        lambda p: F.struct(
            place(p["x"], "mask_x", "pad_x", "orig_w").alias("x"),
            place(p["y"], "mask_y", "pad_y", "orig_h").alias("y"),
        ),
    )
    return polygons.withColumn("polygon", moved)


def _point_picker(epsilon: float):
    """Douglas-Peucker with the distance to the segment, for all polygons of an Arrow batch
    at once: each pass splits every segment that still has a far point. Nested, so that it
    travels to the Python workers by value and they need no copy of this package."""

    def pick(xs: pa.Array, ys: pa.Array) -> pa.Array:
        sizes = np.array(pc.fill_null(pc.list_value_length(xs), 0), np.int64)
        ends = np.cumsum(sizes)
        starts = ends - sizes
        numbers = [v.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False) for v in (xs, ys)]
        points = np.column_stack(numbers)
        keep = np.zeros(len(points), bool)
        lo, hi = starts[sizes > 0], ends[sizes > 0] - 1
        keep[lo] = keep[hi] = True
        while len(lo):
            # Two or three points stay as they are.
            short = hi - lo <= 2
            middle = lo[short] + 1
            keep[middle[middle < hi[short]]] = True
            lo, hi = lo[~short], hi[~short]
            if not len(lo):
                break
            inner = hi - lo - 1
            first = np.cumsum(inner) - inner
            owner = np.repeat(np.arange(len(lo)), inner)
            index = np.arange(inner.sum()) - first[owner] + lo[owner] + 1
            span = points[hi] - points[lo]
            square = (span**2).sum(axis=1)
            away = points[index] - points[lo][owner]
            along = (away * span[owner]).sum(axis=1)
            share = np.clip(along / np.where(square == 0, 1, square)[owner], 0, 1)
            gap = np.hypot(*(away - share[:, None] * span[owner]).T)
            widest = np.maximum.reduceat(gap, first)
            is_widest = np.flatnonzero(gap == widest[owner])
            at = index[is_widest[np.unique(owner[is_widest], return_index=True)[1]]]
            split = widest > epsilon
            at, lo, hi = at[split], lo[split], hi[split]
            keep[at] = True
            lo, hi = np.concatenate([lo, at]), np.concatenate([at, hi])
        chosen = np.flatnonzero(keep)
        local = chosen - np.repeat(starts, sizes)[chosen]
        cuts = np.searchsorted(chosen, np.append(0, ends)).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(cuts), pa.array(local.astype(np.int32)), mask=xs.is_null())

    return pick


def simplify_polygons(
    polygons: DataFrame, column: str = "polygon", epsilon: float = SIMPLIFY_DISTANCE
) -> DataFrame:
    """Drops polygon points nearer than `epsilon` to the kept outline; a null polygon stays null."""

    kept_points = F.arrow_udf(_point_picker(epsilon), T.ArrayType(T.IntegerType()))
    points = F.col(column)
    chosen = kept_points(F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"]))
    return polygons.withColumn("_keep", chosen).withColumn(
        column, F.transform("_keep", lambda i: F.get(points, i))
    ).drop("_keep")


# Order and crops --------------------------------------------------------------------------


def reading_order(
    boxes: DataFrame, group="doc_id", key="line_id", limit: int = GROUP_ROWS, small=None
) -> DataFrame:
    """0-based position by y, then x; the id keeps equal places stable."""
    numbered = ordinal(boxes, [group], ["y", "x", key], "_n", limit, small)
    return numbered.withColumn("position", F.col("_n") - 1).drop("_n")


def start_index(lines: DataFrame, limit: int = GROUP_ROWS) -> DataFrame:
    """Per region the number of lines in the earlier regions of its image."""
    sizes = lines.groupBy("image_id", "region_id").agg(F.count(F.lit(1)).alias("n_lines"))
    ordered = Ordered(sizes, ["image_id"], ["region_id"], limit)
    ordered.running("start_index", "sum", F.col("n_lines"), before=True)
    return ordered.done().withColumn("start_index", F.coalesce("start_index", F.lit(0).cast("long")))


def crop_clamp(boxes: DataFrame, width: float, height: float) -> DataFrame:
    """Whole-pixel crop inside a page of the given size, at least one pixel."""
    placed = boxes.withColumns({"cx": crop_origin(F.col("x")), "cy": crop_origin(F.col("y"))})
    return placed.withColumns(
        {
            "cw": crop_extent(F.col("w"), F.lit(width), F.col("cx")),
            "ch": crop_extent(F.col("h"), F.lit(height), F.col("cy")),
        }
    )


def padded_crop(boxes: DataFrame, width: float, height: float, pad: float = COPY_PAD) -> DataFrame:
    zero = F.lit(0.0)
    placed = boxes.withColumns(
        {"px": F.greatest(zero, F.col("x") - pad), "py": F.greatest(zero, F.col("y") - pad)}
    )
    return placed.withColumns(
        {
            "pw": F.least(F.lit(width) - F.col("px"), F.col("w") + 2 * pad),
            "ph": F.least(F.lit(height) - F.col("py"), F.col("h") + 2 * pad),
        }
    )


def to_page_coords(lines: DataFrame, regions: DataFrame, keys=("image_id", "region_id")):
    """Adds the whole-pixel region origin (cx, cy) to boxes and polygon points. Further
    columns of the regions come along."""
    joined = lines.join(regions, list(keys))
    moved = {"x": F.col("x") + F.col("cx"), "y": F.col("y") + F.col("cy")}
    if "polygon" in lines.columns:
        moved["polygon"] = shifted(F.col("polygon"), F.col("cx"), F.col("cy"))
    return joined.withColumns(moved).drop("cx", "cy")


def letterbox(sizes: DataFrame, target: int = INPUT_SIZE, centred: bool = True) -> DataFrame:
    """Scale, new size and padding that fit width x height into a square."""
    side = F.lit(float(target))
    scaled = sizes.withColumn("scale", F.least(side / F.col("width"), side / F.col("height")))
    sized = scaled.withColumns(
        {
            "new_w": half_up(F.col("width") * F.col("scale")),
            "new_h": half_up(F.col("height") * F.col("scale")),
        }
    )
    pad = (lambda c: (side - F.col(c)) / 2) if centred else (lambda c: F.lit(0.0))
    return sized.withColumns({"pad_x": pad("new_w"), "pad_y": pad("new_h")})


# Spatial joins ----------------------------------------------------------------------------


def _cells(low, high):
    return F.sequence(F.floor(low / CELL), F.floor(high / CELL))


def _in_front(shapes: DataFrame, cell: list[str], key: str, has_polygon: bool) -> DataFrame:
    """Shapes that can be first in their cell: none is behind a box that covers the cell."""
    left, top = F.col("_cx") * CELL, F.col("_cy") * CELL
    covers = shapes.where(
        (F.col("x") <= left)
        & (F.col("y") <= top)
        & (F.col("x") + F.col("w") >= left + CELL)
        & (F.col("y") + F.col("h") >= top + CELL)
    )
    if has_polygon:
        covers = covers.where(~F.coalesce(F.size("polygon") >= 3, F.lit(False)))
    front = covers.groupBy(*cell).agg(F.min(key).alias("_front"))
    kept = shapes.join(front, cell, "left")
    return kept.where(F.col("_front").isNull() | (F.col(key) <= F.col("_front"))).drop("_front")


def hit_test(
    points: DataFrame,
    lines: DataFrame,
    group: str = "doc_id",
    key: str = "line_id",
    limit: int = GROUP_ROWS,
    salts: int = 32,
) -> DataFrame:
    """For each point the first line that contains it, else -1.

    Copies of the same shape keep only their first line and copies of the same point are
    asked once. Points and shapes then meet in grid cells. In cells with more than `limit`
    points or shapes, shapes behind a box that covers the whole cell are left out (they can
    never be first), and the cell is split over `salts` tasks.
    """
    has_polygon = "polygon" in lines.columns
    shape = ["x", "y", "w", "h"] + (["polygon"] if has_polygon else [])
    first = lines.groupBy(group, *shape).agg(F.min(key).alias(key))
    if has_polygon:
        usable = F.coalesce(F.size("polygon") >= 3, F.lit(False))
        pick = lambda f, c: f(F.transform("polygon", lambda p: p[c]))
        bounds = {
            "_x1": F.when(usable, pick(F.array_min, "x")).otherwise(F.col("x")),
            "_x2": F.when(usable, pick(F.array_max, "x")).otherwise(F.col("x") + F.col("w")),
            "_y1": F.when(usable, pick(F.array_min, "y")).otherwise(F.col("y")),
            "_y2": F.when(usable, pick(F.array_max, "y")).otherwise(F.col("y") + F.col("h")),
        }
    else:
        bounds = {
            "_x1": F.col("x"),
            "_x2": F.col("x") + F.col("w"),
            "_y1": F.col("y"),
            "_y2": F.col("y") + F.col("h"),
        }
    shapes = (
        first.withColumns(bounds)
        .where("_x2 >= _x1 AND _y2 >= _y1")
        .withColumn("_cx", F.explode(_cells(F.col("_x1"), F.col("_x2"))))
        .withColumn("_cy", F.explode(_cells(F.col("_y1"), F.col("_y2"))))
    )
    asked = points.select(group, "px", "py").distinct()
    cell = [group, "_cx", "_cy"]
    placed = asked.withColumns(
        {"_cx": F.floor(F.col("px") / CELL), "_cy": F.floor(F.col("py") / CELL)}
    )
    crowded = large_groups(placed, cell, limit)
    if has_large_group(lines, [group], limit):
        stacked = large_groups(shapes, cell, limit)
        if crowded is None or stacked is None:
            crowded = stacked if crowded is None else crowded
        else:
            crowded = crowded.union(stacked).distinct()
    if crowded is None:
        met = placed.join(shapes, cell)
    else:
        placed, many_points = divided(placed, crowded, cell)
        shapes, many_shapes = divided(shapes, crowded, cell)
        many_shapes = _in_front(many_shapes, cell, key, has_polygon)
        salt = F.pmod(F.xxhash64("px", "py"), F.lit(salts)).cast("int")
        every = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
        spread = many_points.withColumn("_salt", salt).join(
            many_shapes.withColumn("_salt", every), [*cell, "_salt"]
        )
        met = placed.join(shapes, cell).unionByName(spread.drop("_salt"))
    polygon = F.col("polygon") if has_polygon else F.lit(None).cast(POLYGON)
    inside = in_shape(
        F.col("px"), F.col("py"), polygon, box(F.col("x"), F.col("y"), F.col("w"), F.col("h"))
    )
    hits = met.where(inside).groupBy(group, "px", "py").agg(F.min(key).alias("hit"))
    answered = points.join(hits, [group, "px", "py"], "left")
    return answered.withColumn("hit", F.coalesce("hit", F.lit(-1)))


def lines_in_rect(rectangles: DataFrame, lines: DataFrame, group: str = "doc_id", key="line_id"):
    """(rect_id, line) for every line whose centre lies in the rectangle, borders included."""
    low = {"_x1": F.least("x1", "x2"), "_y1": F.least("y1", "y2")}
    high = {"_x2": F.greatest("x1", "x2"), "_y2": F.greatest("y1", "y2")}
    areas = (
        rectangles.withColumns({**low, **high})
        .select("rect_id", group, "_x1", "_y1", "_x2", "_y2")
        .withColumn("_cx", F.explode(_cells(F.col("_x1"), F.col("_x2"))))
        .withColumn("_cy", F.explode(_cells(F.col("_y1"), F.col("_y2"))))
    )
    centres = lines.select(
        group,
        key,
        (F.col("x") + F.col("w") / 2).alias("_px"),
        (F.col("y") + F.col("h") / 2).alias("_py"),
    ).withColumns({"_cx": F.floor(F.col("_px") / CELL), "_cy": F.floor(F.col("_py") / CELL)})
    met = areas.join(centres, [group, "_cx", "_cy"])
    return met.where("_px BETWEEN _x1 AND _x2 AND _py BETWEEN _y1 AND _y2").select(
        "rect_id", group, key
    )


def bounding_box(lines: DataFrame, keys) -> DataFrame:
    """Smallest box around the lines of each group."""
    right, bottom = F.col("x") + F.col("w"), F.col("y") + F.col("h")
    ends = lines.groupBy(*keys).agg(
        F.min("x").alias("x"),
        F.min("y").alias("y"),
        F.max(right).alias("_right"),
        F.max(bottom).alias("_bottom"),
    )
    return ends.select(
        *keys,
        "x",
        "y",
        (F.col("_right") - F.col("x")).alias("w"),
        (F.col("_bottom") - F.col("y")).alias("h"),
    )
