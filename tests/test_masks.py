"""Outlines from dense masks against loops over all cells, and the whole page with a reader that fails."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from leafscribe.operators.masks import _edges, mask_polygons
from leafscribe.operators.tokens import error_sentinel, read_lines
from leafscribe.plans.page_transcription import crop_lines, regions_of, saved_pages, transcribe_pages
from leafscribe.session import pin
from leafscribe.sources.views import Views

DET = "image_id int, det_id long, coefficients array<double>, x1 double, y1 double, x2 double, y2 double"
MASK, TILE, SIZE, DEPTH = 20, 8, 80, 3


def outline(coefficients, prototype, box):
    scale = MASK / SIZE
    if any(v is None or math.isnan(v) for v in box):
        return None
    x1, y1 = (max(0, math.floor(max(-9, v * scale))) for v in box[:2])
    x2, y2 = (min(MASK - 1, math.ceil(min(99, v * scale))) for v in box[2:])
    left, right = [], []
    for y in range(y1, y2 + 1):
        on = [x for x in range(x1, x2 + 1) if sum(c * p for c, p in zip(coefficients, prototype[y][x])) >= 0]
        if on:
            left.append((on[0], y))
            right.append((on[-1] + 1, y))
    return left + right[::-1] if len(left) >= 2 else None


@pytest.mark.parametrize("most", [5, 20_000])
def test_outlines(spark, most):
    rng = np.random.default_rng(5)
    # Small whole numbers: sums are exact, some are zero.
    protos = {i: rng.integers(-2, 3, (MASK, MASK, DEPTH)) for i in range(3)}
    dets = []
    for d in range(150):
        image = int(rng.choice([0, 0, 0, 1, 2]))
        x, y = rng.uniform(-10, 85, 2)
        dets.append((image, d, [float(c) for c in rng.integers(-2, 3, DEPTH)], float(x), float(y), float(x + rng.uniform(0, 60)), float(y + rng.uniform(0, 30))))
    nan, far = float("nan"), 1e300
    odd = [(0, 900, [1.0, 0.0, 0.0], nan, 0.0, 9.0, 9.0), (0, 901, [1.0, 0.0, 0.0], -far, -far, far, far), (0, 902, [1.0], 0.0, 0.0, 9.0, 9.0)]
    odd += [(0, 903, None, 0.0, 0.0, 9.0, 9.0), (9, 904, [0.0, 0.0, 0.0], 0.0, 0.0, 9.0, 9.0), (0, 905, [0.0] * 3, 50.0, 50.0, 40.0, 40.0)]
    tiles = [
        (i, t, [float(v) for v in p[t * TILE : (t + 1) * TILE].ravel()]) for i, p in protos.items() for t in range(-(-MASK // TILE))
    ]
    found = mask_polygons(
        spark.createDataFrame(dets + odd, DET).repartition(3),
        spark.createDataFrame([*tiles, (7, 0, None)], "image_id int, tile int, values array<float>"),
        mask=MASK, size=SIZE, tile=TILE, most=most,
    ).collect()
    got = {r["det_id"]: [(p["x"], p["y"]) for p in r["polygon"]] for r in found}
    wanted = {d[1]: outline(d[2], protos[d[0]], d[3:]) for d in [*dets, odd[0], odd[1], odd[5]]}
    assert len(got) > 50 and got == {d: p for d, p in wanted.items() if p}


def test_tiles_are_looked_at_together():
    rng = np.random.default_rng(6)
    # Tiles 0 and 1 of 60 places, each with its own prototype and two detections; the last ones have none.
    protos = {(p, t): rng.integers(-2, 3, (TILE, MASK, DEPTH)).astype(float) for p in range(59) for t in (0, 1)}
    kinds = {"place": pa.struct([("image_id", pa.int64())]), "det": pa.int64(), "tile": pa.int32(), "is_det": pa.bool_(), "group": pa.int64(),
             "depth": pa.int32(), "values": pa.list_(pa.float32()), "coefficients": pa.list_(pa.float64()), **dict.fromkeys(("mx1", "my1", "mx2", "my2"), pa.int32())}
    rows, wanted = [], set()
    for p in range(60):
        for t in (0, 1):
            same = {"place": {"image_id": p}, "tile": t, "group": 2 * p + t}
            if (p, t) in protos:
                rows.append({**same, "is_det": False, "depth": DEPTH, "values": protos[p, t].ravel().tolist()})
            for d in (2 * p, 2 * p + 1):
                c = rng.integers(-2, 3, DEPTH).astype(float)
                rows.append({**same, "det": d, "is_det": True, "depth": 0, "coefficients": c.tolist(), "mx1": 3, "my1": 2, "mx2": 15, "my2": 12})
                for y in range(TILE) if (p, t) in protos else []:
                    on = [x for x in range(3, 16) if protos[p, t][y, x] @ c >= 0]
                    if on and 2 <= t * TILE + y <= 12:
                        wanted.add((p, d, t * TILE + y, on[0], on[-1] + 1))
    table = pa.Table.from_pylist(rows, pa.schema(kinds))
    for size, most in ((1000, 1), (7, 60)):
        made = list(_edges(MASK, TILE)(iter(table.to_batches(max_chunksize=size))))
        got = [(r["place"]["image_id"], r["det"], r["y"], r["left"], r["right"]) for b in made for r in b.to_pylist()]
        assert len(made) <= most and len(got) == len(wanted) and set(got) == wanted


def test_a_failure_stays_with_its_line(spark):
    calls = spark.sparkContext.accumulator(0)

    def reader():
        def predict(boxes):
            if len(boxes) > 8:
                raise AssertionError("too many lines at once")
            if (boxes[:, 0] == 3).any() or (boxes[:, 0] == 12).any():
                calls.add(1)
                raise RuntimeError("no text")
            return [{"text": f"t{int(x)}", "confidence": x / 100} for x, _ in boxes]

        return predict

    lines = spark.range(30).select("id", F.array(F.col("id").cast("double"), F.lit(1.0)).alias("b")).coalesce(1)
    rows = {r["id"]: (r["text"], r["confidence"]) for r in read_lines(lines, reader, ["b"], [[2]]).collect()}
    assert rows == {i: (None, None) if i in (3, 12) else (f"t{i}", i / 100) for i in range(30)}
    done = error_sentinel(read_lines(lines, reader, ["b"], [[2]])).where("id IN (3, 4)").orderBy("id").collect()
    assert [(r["text"], r["confidence"], r["complete"]) for r in done] == [("[error]", 0.0, True), ("t4", 0.04, True)]
    assert read_lines(lines.limit(0), reader, ["b"], [[2]]).collect() == []


def test_pages_without_prototypes_have_no_outlines(spark):
    v = Views(spark, "/root/testdata/sf0.001")
    lines = transcribe_pages(v.anchors_out(), v.masked_boxes())
    texts = lines.groupBy((F.col("text") == "[error]").alias("failed")).agg(F.count("polygon").alias("n"), F.max("confidence").alias("c"))
    rows = {r["failed"]: (r["n"], r["c"]) for r in texts.collect()}
    assert rows[True] == (0, 0.0) and rows[False][0] == 0 and rows[False][1] > 0


@pytest.mark.parametrize("given", [False, True])
def test_boxes_are_made_once_and_lines_read_once(spark, given):
    made, read = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def reader():
        def predict(boxes):
            read.add(len(boxes))
            return [{"text": f"t{int(x)}", "confidence": 0.5} for x, *_ in boxes]

        return predict

    def counted(values):
        made.add(1)
        return values

    # Two regions a page on ten pages; pages 10 to 14 have boxes only.
    sides = ["15D AS l", "10D AS t", "90D AS r", "20D AS b"]
    raw_regions = spark.range(20).selectExpr("id div 2 AS image_id", "CAST(id % 2 * 3000 AS INT) AS anchor_idx", "3D AS logit", *sides)
    boxes = spark.range(120).selectExpr(
        "id div 8 AS image_id", "CAST(id % 4 AS INT) AS region_id", "CAST(id % 8 AS INT) AS det_id", "array(0.5D, 0.9D) AS scores",
        "CAST(90 + id % 8 * 40 AS DOUBLE) AS cx", "CAST(20 + id % 8 * 50 AS DOUBLE) AS cy", "30D AS bw", "20D AS bh", "1200D AS orig_w", "1600D AS orig_h",
        "0.4D AS scale", "80D AS pad_x", "0D AS pad_y", "array(1D) AS coefficients",
    )
    raw_lines = boxes.withColumn("scores", F.udf(counted, "array<double>")("scores"))
    tiles = spark.range(80).selectExpr("id div 8 AS image_id", "CAST(id div 2 % 4 AS INT) AS region_id", "CAST(id % 2 AS INT) AS tile", "array_repeat(1F, 16 * 32) AS values")
    pages = spark.range(15).selectExpr("id AS image_id", "'v' AS manifest_id", "CAST(id AS INT) AS page_number")
    regions = pin(regions_of(raw_regions))
    if given:
        lines = transcribe_pages(raw_regions, crop_lines(raw_lines, regions), tiles, reader, 32, regions)
    else:
        lines = transcribe_pages(raw_regions, raw_lines, tiles, reader, 32)
    saved = saved_pages(lines, regions, pages)
    assert sorted((r["doc_id"], r["group_pos"], r["line_index"]) for r in saved.collect()) == [(p, g, i) for p in range(10) for g in (0, 1) for i in (0, 1)]
    assert (made.value, read.value) == (120, 40)
