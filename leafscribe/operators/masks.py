"""Polygons of detected lines from dense mask output: coefficients of a line times the prototypes of its image."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafscribe.operators.geometry import INPUT_SIZE
from leafscribe.operators.scale import divided, large_groups

#: Fixed value: rows and columns of a prototype.
MASK = 160
#: Mask rows of a prototype tile, detections whose products are held together, and detections of a tile in one task.
TILE, TOGETHER, TILE_DETECTIONS = 16, 256, 20_000


def _clamped(value: Column, mask: int) -> Column:
    """Far values come close enough to stay outside, so that they fit an integer."""
    return F.greatest(F.lit(-2.0), F.least(F.lit(mask + 1.0), value))


def _cropped(detections: DataFrame, mask: int, size: int, tile: int) -> DataFrame:
    """Detections with their box in mask cells, one row for each tile that it touches."""
    scale = mask / size
    low = {c: F.greatest(F.lit(0), F.floor(_clamped(F.col(v) * scale, mask))) for c, v in (("mx1", "x1"), ("my1", "y1"))}
    high = {c: F.least(F.lit(mask - 1), F.ceil(_clamped(F.col(v) * scale, mask))) for c, v in (("mx2", "x2"), ("my2", "y2"))}
    known = detections.where(" AND ".join(f"{c} IS NOT NULL AND NOT isnan({c})" for c in ("x1", "y1", "x2", "y2")))
    boxed = known.withColumns({c: v.cast("int") for c, v in {**low, **high}.items()}).where("mx2 >= mx1 AND my2 >= my1")
    first, last = (F.floor(F.col(c) / tile).cast("int") for c in ("my1", "my2"))
    return boxed.withColumn("tile", F.explode(F.sequence(first, last)))


def _edges(mask: int, tile: int):
    def product(rows: pa.RecordBatch, depths: np.ndarray, which: np.ndarray, tiles: np.ndarray, prototype) -> pa.RecordBatch:
        """Leftmost and rightmost set cell of each mask row of each detection, within its box."""
        n, ends = rows.num_rows, np.append(0, np.cumsum(depths))
        flat = rows["coefficients"].flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        # Detections of a prototype come one after the other: one product for all of them.
        cuts = [0, *(np.flatnonzero(np.diff(which)) + 1).tolist(), n]
        found = []
        for a, b in zip(cuts, cuts[1:], strict=False):
            own = prototype(which[a])
            found.append(flat[ends[a] : ends[b]].reshape(b - a, -1) @ own.reshape(-1, own.shape[2]).T)
        # A tile of fewer rows has no set cell in those that it lacks.
        values = np.full((n, max(f.shape[1] // mask for f in found), mask), -1.0)
        for a, b, f in zip(cuts, cuts[1:], found, strict=False):
            values[a:b, : f.shape[1] // mask] = f.reshape(b - a, -1, mask)
        box = {c: rows[c].to_numpy()[:, None] for c in ("mx1", "my1", "mx2", "my2")}
        across, down = np.arange(mask)[None, :], tiles[:, None] * tile + np.arange(values.shape[1])[None, :]
        # The sigmoid is at least one half where its argument is not negative.
        on = (values >= 0) & ((across >= box["mx1"]) & (across <= box["mx2"]))[:, None, :]
        on &= ((down >= box["my1"]) & (down <= box["my2"]))[:, :, None]
        i, y = np.nonzero(on.any(2))
        left, right = on.argmax(2), mask - on[:, :, ::-1].argmax(2)
        numbers = [pa.array(v.astype(np.int32)) for v in (down[i, y], left[i, y], right[i, y])]
        return pa.record_batch([rows["place"].take(pa.array(i)), rows["det"].take(pa.array(i)), *numbers], ["place", "det", "y", "left", "right"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come tile by tile, its prototype first. The products of many tiles are looked at together."""
        # The last prototype of the batch before, for detections that follow here.
        kept, kept_group, kept_tile = None, 0, 0
        for batch in batches:
            heads = np.flatnonzero(~batch["is_det"].to_numpy(zero_copy_only=False))
            group, number = (batch[c].to_numpy(zero_copy_only=False) for c in ("group", "tile"))
            starts, values = batch["values"].offsets.to_numpy(), batch["values"].values.to_numpy(zero_copy_only=False)
            depth = batch["depth"].to_numpy(zero_copy_only=False)
            sizes, cells = np.diff(starts)[heads], mask * depth[heads]
            if (cells < 1).any() or (sizes % cells).any():
                raise ValueError("a prototype tile does not hold whole mask rows")

            def prototype(at, kept=kept, heads=heads, starts=starts, values=values, depth=depth):
                """The one before head `at`, which is 0 for that of the batch before."""
                if at == 0:
                    return kept
                head = heads[at - 1]
                return values[starts[head] : starts[head + 1]].astype(np.float64).reshape(-1, mask, depth[head])

            groups, tiles = np.append(kept_group, group[heads]), np.append(kept_tile, number[heads])
            depths = np.append(-2 if kept is None else kept.shape[2], depth[heads])
            which = np.searchsorted(heads, np.arange(batch.num_rows), "right")
            lengths = pc.fill_null(pc.list_value_length(batch["coefficients"]), -1).to_numpy(zero_copy_only=False)
            # Detections of a tile without a prototype have no mask. A prototype itself has no coefficients.
            own = np.flatnonzero((group == groups[which]) & (lengths == depths[which]))
            for at in range(0, len(own), TOGETHER):
                some = own[at : at + TOGETHER]
                yield product(batch.take(pa.array(some)), lengths[some], which[some], tiles[which[some]], prototype)
            if len(heads):
                kept, kept_group, kept_tile = prototype(len(heads)), group[heads[-1]], number[heads[-1]]

    return run


def mask_polygons(
    detections: DataFrame,
    prototypes: DataFrame,
    keys: Sequence[str] = ("image_id",),
    key: str = "det_id",
    mask: int = MASK,
    size: int = INPUT_SIZE,
    tile: int = TILE,
    most: int = TILE_DETECTIONS,
    small: bool | None = None,
) -> DataFrame:
    """Outline of each detection's mask, in mask cells: left edge downwards, then right edge upwards.

    detections: `keys`, `key` (unique together), `coefficients` and the box `x1`, `y1`, `x2`, `y2` in input space.
    prototypes: `keys`, `tile` and `values`: the `tile` mask rows from there, row by row, cell by cell, all coefficients of a cell together.
    A prototype tile goes once to each task that needs it, not once a detection; there one matrix product gives the
    logits of many detections, and only the two edges of each mask row leave the task. Tiles with more than `most` detections
    are dealt to several tasks; `small` skips that look. An outline has at most 2 * `mask` points. Masks with fewer than two rows set, boxes
    outside the mask or with unknown corners, and tiles without a prototype give none.
    Returns `keys`, `key` and `polygon`.
    """
    place = F.struct(*keys).alias("place")
    pieces = _cropped(detections, mask, size, tile)
    pieces = pieces.select(place, F.col(key).alias("det"), "tile", "coefficients", "mx1", "my1", "mx2", "my2")
    depth = F.expr(f"size(values) div (least({tile}, {mask} - tile * {tile}) * {mask})")
    tiles = prototypes.where("values IS NOT NULL AND size(values) > 0").select(place, "tile", depth.cast("int").alias("depth"), "values")
    pieces, tiles = pieces.withColumn("salt", F.lit(0)), tiles.withColumn("salt", F.lit(0))
    large = None if small else large_groups(pieces, ["place", "tile"], most)
    if large is not None:
        salts = 64
        few, many = divided(pieces, large, ["place", "tile"])
        spread = (F.pmod(F.xxhash64("det"), F.lit(salts).cast("long")) + 1).cast("int")
        pieces = few.unionByName(many.withColumn("salt", spread))
        repeated = divided(tiles, large, ["place", "tile"])[1]
        tiles = tiles.unionByName(repeated.withColumn("salt", F.explode(F.sequence(F.lit(1), F.lit(salts)))))
    pieces = pieces.withColumns({"is_det": F.lit(True), "depth": F.lit(0)})
    tiles = tiles.withColumn("is_det", F.lit(False))
    rows = pieces.unionByName(tiles, allowMissingColumns=True)
    order = ["place", "tile", "salt"]
    rows = rows.withColumn("group", F.xxhash64(*order)).repartition(*order).sortWithinPartitions(*order, "is_det")
    names = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = f"place {names['place']}, det {names['det']}, y int, left int, right int"
    edges = rows.drop("salt").mapInArrow(_edges(mask, tile), schema)
    # At most `mask` rows of a mask are gathered.
    sides = edges.groupBy("place", "det").agg(F.array_sort(F.collect_list(F.struct("y", "left", "right"))).alias("e"))
    point = lambda e, c: F.struct(e[c].cast("double").alias("x"), e["y"].cast("double").alias("y"))
    left = F.transform("e", lambda e: point(e, "left"))
    right = F.reverse(F.transform("e", lambda e: point(e, "right")))
    return sides.where(F.size("e") >= 2).select("place.*", F.col("det").alias(key), F.concat(left, right).alias("polygon"))
