"""Greedy non-maximum suppression.

Boxes are taken by falling score; a box is dropped if its overlap with a kept box is above the
threshold. Images of ordinary size are folded in one go inside the JVM. For larger images
the same result is reached in rounds over grid cells, without ever gathering the image.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafscribe.functions.boxes import box, can_suppress, iou
from leafscribe.operators.geometry import MAX_IOU
from leafscribe.operators.scale import LOOKUP_ROWS, divided, has_large_group, large_groups
from leafscribe.session import pin

# Boxes of one image that one task may fold: one model run yields at most 8 400.
IMAGE_BOXES = 8_400


def _distinct_boxes(boxes: DataFrame, key: str) -> DataFrame:
    """Exact copies: only the best-scored one can be kept, so the others go before the shuffle."""
    best = boxes.groupBy("image_id", "x", "y", "w", "h").agg(
        F.min(F.struct((-F.col("score")).alias("s"), F.col(key).alias("k"))).alias("best")
    )
    return best.select(
        "image_id",
        "x",
        "y",
        "w",
        "h",
        (-F.col("best.s")).alias("score"),
        F.col("best.k").alias(key),
    )


def _folded(boxes: DataFrame, key: str, max_iou: float) -> DataFrame:
    """All boxes of an image, best first, folded over the list of kept ones."""
    x, y, w, h = (F.col(c) for c in ("x", "y", "w", "h"))
    item = F.struct(
        (-F.col("score")).alias("s"),
        F.col(key).alias("k"),
        "x",
        "y",
        "w",
        "h",
        (x + w).alias("x2"),
        (y + h).alias("y2"),
    )
    packed = boxes.groupBy("image_id").agg(F.array_sort(F.collect_list(item)).alias("items"))

    def covers(kept: Column, one: Column) -> Column:
        # Most pairs do not touch; four comparisons settle them before any arithmetic.
        touch = (
            (kept["y"] < one["y2"])
            & (one["y"] < kept["y2"])
            & (kept["x"] < one["x2"])
            & (one["x"] < kept["x2"])
        )
        return touch & (iou(kept, one) > max_iou)

    def keep(kept: Column, one: Column) -> Column:
        hit = F.exists(kept, lambda k: covers(k, one))
        return F.when(hit, kept).otherwise(F.concat(kept, F.array(one)))

    kept = F.aggregate("items", F.slice("items", 1, 0), keep)
    flat = packed.select("image_id", F.explode(kept).alias("b"))
    return flat.select(
        "image_id",
        F.col("b.k").alias(key),
        (-F.col("b.s")).alias("score"),
        "b.x",
        "b.y",
        "b.w",
        "b.h",
    )


def _cell_range(centre: Column, reach: Column, edge: Column) -> Column:
    return F.sequence(
        F.floor((centre - reach) / edge).cast("long"), F.floor((centre + reach) / edge).cast("long")
    )


def _in_rounds(boxes: DataFrame, key: str, max_iou: float, limit: int) -> DataFrame:
    """Rounds for images too large to gather.

    Boxes live in buckets: size class of width and height (two boxes above the threshold differ
    at most by one class) and grid cell of the centre. Each bucket names its best open box,
    its champion, and every box meets the champions that reach its bucket, a bounded number. A
    champion that no better open box covers is kept, and the boxes it covers are dropped.
    What is open then depends on open boxes only, so the rounds end with a fold as soon as
    no image has more than `limit` of them.
    """
    # A little slack on classes and reach against rounding at their borders.
    base = 1.001 / max_iou
    size_class = lambda c: F.floor(F.log(c) / math.log(base)).cast("int")
    edge = lambda cls: F.pow(F.lit(base), cls + 1)
    placed = boxes.withColumns(
        {
            "mx": F.col("x") + F.col("w") / 2,
            "my": F.col("y") + F.col("h") / 2,
            "cw": size_class(F.col("w")),
            "ch": size_class(F.col("h")),
        }
    ).withColumns(
        {
            "gx": F.floor(F.col("mx") / edge(F.col("cw"))).cast("long"),
            "gy": F.floor(F.col("my") / edge(F.col("ch"))).cast("long"),
        }
    )
    bucket = ["image_id", "cw", "ch", "gx", "gy"]
    order = F.struct((-F.col("score")).alias("s"), F.col(key).alias("k"))
    full = F.struct(order.alias("o"), *[F.col(c) for c in ("x", "y", "w", "h", "mx", "my")])
    mine = box(F.col("x"), F.col("y"), F.col("w"), F.col("h"))
    open_boxes = pin(placed)
    kept = None
    while has_large_group(open_boxes, ["image_id"], limit):
        champions = open_boxes.groupBy(*bucket).agg(F.min_by(full, order).alias("c"))
        reached = champions.select("image_id", "c", "cw", "ch")
        for cls, ext, mid, cell in (("cw", "w", "mx", "gx"), ("ch", "h", "my", "gy")):
            near = F.explode(F.sequence(F.col(cls) - 1, F.col(cls) + 1))
            reach = (F.col("c." + ext) + 1.001 * edge(F.col(cls))) / 2
            cells = _cell_range(F.col("c." + mid), reach, edge(F.col(cls)))
            reached = reached.withColumn(cls, near).withColumn(cell, F.explode(cells))
        if reached.limit(LOOKUP_ROWS + 1).count() <= LOOKUP_ROWS:
            reached = F.broadcast(reached)
        met = open_boxes.join(reached, bucket).where(iou(mine, F.col("c")) > max_iou)
        met = pin(met.select("image_id", key, "c", (order < F.col("c.o")).alias("better")))
        safe = met.groupBy("image_id", "c").agg(F.bool_or("better").alias("beaten"))
        safe = safe.where("NOT beaten").select("image_id", "c")
        winners = pin(
            safe.select(
                "image_id",
                F.col("c.o.k").alias(key),
                (-F.col("c.o.s")).alias("score"),
                "c.x",
                "c.y",
                "c.w",
                "c.h",
            )
        )
        kept = winners if kept is None else kept.unionByName(winners)
        # A kept box meets itself too, and leaves with the boxes it covers.
        by = winners.select("image_id", F.col(key).alias("_by"))
        covered = met.withColumn("_by", F.col("c.o.k")).join(by, ["image_id", "_by"], "left_semi")
        marks = covered.select("image_id", key).distinct()
        open_boxes = pin(open_boxes.join(marks, ["image_id", key], "left_anti"))
    rest = _folded(open_boxes, key, max_iou)
    return rest if kept is None else kept.unionByName(rest)


def nms(
    boxes: DataFrame,
    max_iou: float = MAX_IOU,
    min_score: float | None = None,
    key: str = "det_id",
    limit: int = IMAGE_BOXES,
    small: bool | None = None,
) -> DataFrame:
    """Kept boxes (image_id, key, score, x, y, w, h); classes are not told apart.

    `small` skips the look at image sizes where they are known to be within the limit.
    """
    if max_iou <= 0:
        raise ValueError("max_iou must be above 0")
    wanted = boxes.select("image_id", key, "score", "x", "y", "w", "h")
    if min_score is not None:
        wanted = wanted.where(F.col("score") >= min_score)
    if max_iou >= 1:
        return wanted
    large = None if small else large_groups(wanted, ["image_id"], limit)
    if large is None:
        return _folded(wanted, key, max_iou)
    few, many = divided(wanted, large, ["image_id"])
    mine = box(F.col("x"), F.col("y"), F.col("w"), F.col("h"))
    # Boxes without area overlap nothing: kept without a look at the others.
    flat = many.where(~can_suppress(mine))
    single = _distinct_boxes(many.where(can_suppress(mine)), key)
    spread = _in_rounds(single, key, max_iou, limit)
    return _folded(few, key, max_iou).unionByName(flat).unionByName(spread)
