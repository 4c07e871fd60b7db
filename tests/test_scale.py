"""The paths for oversized groups give the same rows as the plain ones."""

import random

import pytest
from pyspark.sql import functions as F

from leafscribe.operators import events as E
from leafscribe.operators import geometry as G
from leafscribe.operators import workspace as W
from leafscribe.operators.scale import Ordered, has_large_group, lookup, ordinal
from leafscribe.operators.suppression import nms
from leafscribe.plans import queries as Q
from leafscribe.sinks import exports as X
from leafscribe.sources import store as S


def rows(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=str)


@pytest.fixture(scope="module")
def skewed(spark):
    """Group 0 holds most rows; one group has a null key."""
    rng = random.Random(5)
    data = [(0, i, rng.randint(-5, 9)) for i in range(120)]
    data += [(k, i, rng.randint(-5, 9)) for k in range(1, 9) for i in range(k)]
    data += [(None, i, i) for i in range(11)]
    rng.shuffle(data)
    return spark.createDataFrame(data, "k int, i int, v long").repartition(5).cache()


def test_ordinal(skewed):
    assert has_large_group(skewed, ["k"], 7)
    assert rows(ordinal(skewed, ["k"], ["i"], "n", 7)) == rows(ordinal(skewed, ["k"], ["i"], "n"))
    assert all(r.n == r.i + 1 for r in ordinal(skewed, ["k"], ["i"], "n", 7).collect())


def test_ordinal_without_keys(skewed):
    found = [r.n for r in ordinal(skewed, [], ["v", "k", "i"], "n").collect()]
    assert sorted(found) == list(range(1, skewed.count() + 1))
    numbered = ordinal(skewed, [], ["v", "k", "i"], "n").orderBy("n").collect()
    assert [r.v for r in numbered] == sorted(r.v for r in numbered)


def ordered(df, limit):
    work = Ordered(df, ["k"], ["i"], limit)
    work.running("s", "sum", F.col("v")).running("low", "min", F.col("s"))
    work.running("top", "max", F.when(F.col("v") > 3, F.struct("i", "v")))
    work.running("prior", "sum", F.col("v"), before=True)
    work.neighbour("back", F.col("v"), -1).neighbour("ahead", F.col("v"), 1)
    return work.done()


def test_running_and_neighbours(skewed):
    assert rows(ordered(skewed, 7)) == rows(ordered(skewed, 10_000))


def test_collected_parts(skewed):
    parts = Ordered(skewed, ["k"], ["i"], 7).collected(F.col("v"), "vs").collect()
    assert max(len(p.vs) for p in parts) <= 7
    whole = {r.k: r.vs for r in Ordered(skewed, ["k"], ["i"]).collected(F.col("v"), "vs").collect()}
    for key, values in whole.items():
        mine = sorted((p for p in parts if p.k == key), key=lambda p: p.part)
        assert [v for p in mine for v in p.vs] == values


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_lookup_with_salt(skewed, spark, how):
    names = spark.createDataFrame([(0, "a"), (3, "b"), (77, "c")], "k int, name string")
    assert rows(lookup(skewed, names, ["k"], how, max_rows=1)) == rows(
        lookup(skewed, names, ["k"], how)
    )


def brute_nms(boxes, t):
    def iou(a, b):
        w = min(a[2] + a[4], b[2] + b[4]) - max(a[2], b[2])
        h = min(a[3] + a[5], b[3] + b[5]) - max(a[3], b[3])
        inter = max(0.0, w) * max(0.0, h)
        union = a[4] * a[5] + b[4] * b[5] - inter
        return inter / union if union > 0 else 0.0

    kept = []
    for one in sorted(boxes, key=lambda b: (-b[1], b[0])):
        if all(iou(k, one) <= t for k in kept):
            kept.append(one)
    return {b[0] for b in kept}


def test_nms_rounds_against_brute_force(spark):
    rng = random.Random(11)
    data = {}
    for image in (1, 2):
        boxes = [
            (i, rng.randint(0, 40) / 40, rng.uniform(0, 220), rng.uniform(0, 90),
             rng.choice([12.0, 30.0, 75.0, 160.0]) * rng.uniform(0.8, 1.2), rng.choice([8.0, 20.0, 44.0]))
            for i in range(90)
        ]
        boxes += [(200 + i, 0.5, 10.0, 10.0, 30.0, 20.0) for i in range(12)]
        boxes += [(300, 0.9, 10.0, 10.0, -4.0, 20.0), (301, 0.9, 10.0, 10.0, 0.0, 0.0)]
        data[image] = boxes
    flat = [(image, *b) for image, boxes in data.items() for b in boxes]
    df = spark.createDataFrame(
        flat, "image_id long, det_id int, score double, x double, y double, w double, h double"
    )
    for limit in (20, 1_000):
        found = nms(df, limit=limit).collect()
        for image, boxes in data.items():
            assert {r.det_id for r in found if r.image_id == image} == brute_nms(boxes, 0.45)


def test_event_paths(views):
    events = views.events().cache()
    for work in (
        E.region_completion, E.inflight_gauge, E.active_images, E.stage_transitions, E.drop_cancelled,
    ):
        assert rows(work(events, limit=2)) == rows(work(events)), work.__name__
    assert rows(E.debounce(events, 7200.0, 3)) == rows(E.debounce(events, 7200.0))


def test_smoothed_rate_after_a_long_rest(spark):
    """The decayed average of equal times is not taken for "no value yet", whatever the blocks."""
    data, at = [], 0
    for i in range(9_000):
        at += 0 if i < 2_300 or 2_350 <= i < 8_900 else 8_000_000 if i >= 8_900 else 10_000_000
        data.append((1, i, at))
    df = spark.createDataFrame(data, "image_id int, seq int, us long").select(
        "image_id", "seq", F.timestamp_micros("us").alias("ts")
    )
    split = {r.seq: r.avg for r in E.smoothed_rate(df, limit=1).collect()}
    whole = {r.seq: r.avg for r in E.smoothed_rate(df, limit=10_000).collect()}
    assert [round(whole[s], 3) for s in (2_300, 2_301, 8_900, 8_901, 8_902)] == [10.0, 10.0, 2.4, 4.08, 5.256]
    assert split.keys() == whole.keys()
    assert all(abs(split[s] - whole[s]) <= 1e-9 * max(1.0, whole[s]) for s in whole)


def test_smoothed_rate_blocks(spark):
    rng = random.Random(2)
    at, data = 0, []
    for i in range(5_000):
        at += 0 if i < 3 else rng.randint(1, 9_000_000)
        data.append((1, i, at))
    df = spark.createDataFrame(data, "image_id int, seq int, us long").select(
        "image_id", "seq", F.timestamp_micros("us").alias("ts")
    )
    split = {r.seq: r for r in E.smoothed_rate(df, limit=1).collect()}
    whole = {r.seq: r for r in E.smoothed_rate(df, limit=10_000).collect()}
    assert split.keys() == whole.keys() == set(range(1, 5_000))
    for seq, r in whole.items():
        assert abs(split[seq].avg - r.avg) <= 1e-9 * max(1.0, r.avg)
    average = 0.0
    for (_, _, a), (_, seq, b) in zip(data, data[1:], strict=False):
        value = (b - a) / 1e6
        average = value if average == 0 else 0.3 * value + 0.7 * average
        assert abs(whole[seq].avg - average) <= 1e-9 * max(1.0, average)


def test_workspace_paths(views):
    lines = views.numbered_lines().cache()
    pages = views.pages().cache()
    groups = views.groups(lines).cache()
    assert rows(G.reading_order(lines, limit=3)) == rows(G.reading_order(lines))
    points = views.points()
    assert rows(G.hit_test(points, lines, limit=1)) == rows(G.hit_test(points, lines))
    assert rows(W.page_nav(pages, 3)) == rows(W.page_nav(pages))
    assert rows(W.line_nav(lines, 3)) == rows(W.line_nav(lines))
    assert rows(W.pages_to_process(pages, lines, 3)) == rows(W.pages_to_process(pages, lines))
    assert rows(S.serialize_for_save(lines, groups, limit=2)) == rows(
        S.serialize_for_save(lines, groups)
    )
    regions = lines.select(F.col("doc_id").alias("image_id"), F.coalesce("group_pos", F.lit(-1)).alias("region_id"))
    assert rows(G.start_index(regions, 2)) == rows(G.start_index(regions))
    saved = S.serialize_for_save(lines, groups)
    filled = groups.where("group_pos >= 1")
    counted = pages.withColumn("line_counter", F.lit(3))
    assert rows(W.hydrate(counted, filled, saved, limit=2)) == rows(W.hydrate(counted, filled, saved))


@pytest.mark.parametrize("kind", ["text", "json", "alto", "page"])
def test_exports_in_parts(views, kind):
    lines = views.lines().cache()
    pages = views.pages().cache()
    groups = views.groups(lines).cache()
    make = {
        "text": lambda n: X.export_text(pages, lines, n),
        "json": lambda n: X.export_json(pages, groups, lines, n),
        "alto": lambda n: X.export_alto(pages, lines, "now", limit=n),
        "page": lambda n: X.export_page(pages, groups, lines, "now", limit=n),
    }[kind]
    joint = "" if kind == "json" else "\n"
    whole = {r.doc_id: r.content for r in make(100_000).collect()}
    parts = make(6).collect()
    assert len(parts) > len(whole)
    built = {}
    for r in sorted(parts, key=lambda r: (r.doc_id, r.part)):
        built.setdefault(r.doc_id, []).append(r.content)
    assert {k: joint.join(v) for k, v in built.items()} == whole


def test_flattened_lines_go_on_across_blocks(views):
    whole = rows(Q.flatten_page_result(views))
    assert rows(Q.flatten_page_result(views, limit=1)) == whole
    assert rows(Q.flatten_page_result(views, limit=3)) == whole
