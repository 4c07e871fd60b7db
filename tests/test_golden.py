"""Hand-computed rows for rules that are easy to get wrong."""

import json
import math
import random
import xml.etree.ElementTree as ET
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafscribe.functions.boxes import box, in_shape, iou
from leafscribe.functions.numbers import duration_text, half_up, plain_number, three_digits
from leafscribe.functions.text import not_blank, pad_number, trimmed, words, xml_escaped
from leafscribe.operators import catalog as C
from leafscribe.operators import events as E
from leafscribe.operators import geometry as G
from leafscribe.operators import tokens as T
from leafscribe.operators import workspace as W
from leafscribe.sinks import exports as X
from leafscribe.sources import volumes as V


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_numbers(spark):
    assert [one(spark, half_up(F.lit(x))) for x in (-2.5, 2.5, 0.49)] == [-2, 3, 0]
    assert [one(spark, plain_number(F.lit(x))) for x in (20.0, 0.47)] == ["20", "0.47"]
    assert one(spark, duration_text(F.lit(59))) == "59s"
    # Exact binary value; an exact half goes up.
    rounded = {1.0005: "1.000", 0.2345: "0.234", 0.0625: "0.063", 0.9995: "1.000", 0.0005: "0.001", 0.0: "0.000", 12.3456: "12.346", -0.25: "-0.250"}
    rng = random.Random(5)
    for _ in range(60):
        x = rng.choice([rng.random(), rng.randrange(20_000) / 10_000, rng.randrange(4000) / 16])
        rounded[x] = str(Decimal(x).quantize(Decimal("0.001"), ROUND_HALF_UP))
    df = spark.createDataFrame([(x,) for x in rounded], "v double").select("v", three_digits(F.col("v")).alias("t"))
    assert {r.v: r.t for r in df.collect()} == rounded
    assert one(spark, duration_text(F.lit(125))) == "2m 5s"


def test_texts(spark):
    assert one(spark, pad_number(F.lit(7))) == "00007"
    assert one(spark, pad_number(F.lit(1234567))) == "1234567"
    assert one(spark, trimmed(F.lit(" ﻿ a b \n"))) == "a b"
    assert not one(spark, not_blank(F.lit("　 \t")))
    assert one(spark, words(F.lit(" a b\tc  "))) == ["a", "b", "c"]
    assert one(spark, xml_escaped(F.lit("<a href=\"x\">&'"))) == "&lt;a href=&quot;x&quot;&gt;&amp;'"


RECORDS = [
    ("<r><error code='bad'/></r>", None, "bad"),
    ("<r><error/></r>", None, V.UNKNOWN_ERROR),
    ("<r><error code='c'>gone</error></r>", None, "gone"),
    ("<a><b><dao xlink:href='https://x/bildvisning/r0001203?a=1'/></b></a>", "r0001203", None),
    ('<a><dao xlink:role="M" xlink:href="https://x/arkis!R1/manifest"/></a>', None, V.NO_VOLUME),
    ('<a><dao xlink:href="https://x/arkis!21R77/manifest"/></a>', "R77", None),
    ('<a><dao xlink:href="https://x/arkis%21R78/manifest"/></a>', "R78", None),
    ('<a><dao xlink:href="n"/><x:dao l:href="u/bildvisning/A1"/><dao xlink:href="u/bildvisning/B2"/></a>', "A1", None),
    ('<a><!-- <dao xlink:href="u/bildvisning/A1"/> --></a>', None, V.NO_VOLUME),
    ("<broken", None, V.NO_VOLUME),
    ('<a><dao xlink:href="u/bildvisning/A1"/><b>', None, V.NO_VOLUME),
    ('<a><dao xlink:href="u/bildvisning/A1"/></a><a/>', None, V.NO_VOLUME),
    ("<a><error>gone</error>", None, V.NO_VOLUME),
    ("", None, V.NO_VOLUME),
    (None, None, V.NO_VOLUME),
    ("<a><error>caf&#233; &#x41;</error></a>", None, "café A"),
    ("<a><error>one</error><error>two</error></a>", None, "one"),
    ("<a><e:error code='c'><b/> <i>x<i>y</i></i>z</e:error>w</a>", None, " xyz"),
    ("<a><dao xlink:href='u/bildvisning/A1'/><error/></a>", None, V.UNKNOWN_ERROR),
    ("<a><dao l:href='u/bildvisning/A1' xlink:href='u/bildvisning/&#66;2'/></a>", "B2", None),
    ("<a><dao xlink:href='u/arkis!21&amp;/manifest'/><x><dao xlink:href='u/ARKIS%21b7/manifest'/></x></a>", "b7", None),
    ("<!DOCTYPE a [<!ENTITY v 'A9'>]><a><dao xlink:href='u/bildvisning/&v;'/></a>", "A9", None),
    ("<a><dao xlink:href='u/bildvisning/A1'/>" + "<b>" * 20_000 + "</b>" * 20_000 + "</a>", "A1", None),
]


def test_harvest(spark):
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(RECORDS)], "i int, xml string")
    found = V.resolve_harvest(df).orderBy("i").collect()
    assert [(r.manifest_id, r.error) for r in found] == [r[1:] for r in RECORDS]


def test_harvest_entities_that_grow(spark):
    names = "".join(f"<!ENTITY e{i} '{f'&e{i - 1};' * 10 if i else 'x' * 100}'>" for i in range(12))
    record = f"<!DOCTYPE a [{names}]><a><dao xlink:href='u/bildvisning/A1'/><error>&e11;</error></a>"
    assert V.read_record(record) == (None, V.NO_VOLUME)


def test_harvest_errors(spark):
    hidden = '<o><![CDATA[<dao xlink:href="https://x/y/R0001203"/>]]></o>'
    rows = [
        ("<o><error>a &amp; b</error></o>", "a & b"),
        ("<o><error><b>x</b> y</error></o>", "x y"),
        ("<o><error><![CDATA[a<b]]></error></o>", "a<b"),
        ('<o><error code="c1"/></o>', "c1"),
        ("<o><error/></o>", V.UNKNOWN_ERROR),
        (hidden, V.NO_VOLUME),
    ]
    df = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(rows)], "i int, xml string")
    found = V.resolve_harvest(df).orderBy("i").collect()
    assert [(r.manifest_id, r.error) for r in found] == [(None, e) for _, e in rows]


def test_page_ranges(spark):
    df = spark.createDataFrame([("a", 3, 0, 9), ("b", 3, 2, 1), ("c", 0, 1, 5)], "m string, n int, s int, e int")
    found = V.expand_pages(df, F.col("n"), F.col("s"), F.col("e")).collect()
    assert {(r.m, r.page_number, r.error) for r in found} == {
        ("a", 1, None), ("a", 2, None), ("a", 3, None), ("c", None, V.NO_PAGES),
    }


def test_scan_folder(spark, tmp_path):
    for name in ("b.PNG", "a.jpg", "note.txt", "c"):
        (tmp_path / name).write_bytes(b"x")
    found = V.scan_folder(spark, str(tmp_path), 3).orderBy("page_number").collect()
    assert [(r.manifest_id, r.page_number, r.name) for r in found] == [
        ("upload-3", 1, "a.jpg"), ("upload-3", 2, "b.PNG"),
    ]


def test_iou_without_area(spark):
    b = lambda *v: box(*[F.lit(float(x)) for x in v])
    assert one(spark, iou(b(0, 0, 0, 0), b(0, 0, 0, 0))) == 0.0
    assert one(spark, iou(b(0, 0, 2, 2), b(1, 0, 2, 2))) == pytest.approx(1 / 3)


def test_anchor_arithmetic_equals_table(spark):
    table = {r.anchor_idx: (r.ax, r.ay) for r in G.anchors(spark).collect()}
    assert len(table) == 8400
    raw = spark.range(8400).selectExpr(
        "0L AS image_id", "CAST(id AS INT) AS anchor_idx", "9D AS logit", "0D AS l", "0D AS t", "1D AS r", "1D AS b"
    )
    assert {r.anchor_idx: (r.x, r.y) for r in G.decode_regions(raw).collect()} == table


def test_line_box_may_be_negative(spark):
    df = spark.createDataFrame(
        [(1, 1, [0.5, 0.5], 700.0, 10.0, 20.0, 20.0, 100.0, 100.0, 1.0, 0.0, 0.0)],
        "image_id int, det_id int, scores array<double>, cx double, cy double, bw double, bh double,"
        "orig_w double, orig_h double, scale double, pad_x double, pad_y double",
    )
    r = G.decode_lines(df).first()
    assert (r.class_id, r.x, r.y, r.w, r.h) == (0, 100.0, 0.0, -590.0, 20.0)


def test_contour_and_polygon(spark):
    on = {(0, 1), (0, 2), (1, 2), (2, 0)}
    cells = [(1, y, x, 1.0 if (y, x) in on else -1.0) for y in range(4) for x in range(4)]
    cells += [(2, 0, x, 1.0) for x in range(4)]
    df = spark.createDataFrame(cells, "det_id long, y int, x int, logit double")
    found = G.outline_polygons(G.mask_contour(df)).collect()
    assert [r.det_id for r in found] == [1]
    points = [(p.x, p.y) for p in found[0].polygon]
    assert points == [(1, 0), (2, 1), (0, 2), (1, 2), (3, 1), (3, 0)]


def from_segment(p, a, b):
    """Distance of a point from a segment, by its foot on the line."""
    p, a, b = (np.array(x, float) for x in (p, a, b))
    length = (b - a) @ (b - a)
    foot = a + (b - a) * np.clip((p - a) @ (b - a) / length, 0, 1) if length else a
    return float(np.linalg.norm(p - foot))


def simplify(spark, shapes):
    df = spark.createDataFrame(
        [(i, [{"x": x, "y": y} for x, y in s]) for i, s in enumerate(shapes)],
        "i int, polygon array<struct<x:double,y:double>>",
    )
    rows = sorted(G.simplify_polygons(df).collect(), key=lambda r: r.i)
    return [[(p.x, p.y) for p in r.polygon] for r in rows]


def test_simplify_keeps_what_matters(spark):
    rng = np.random.default_rng(8)
    shapes = [[(float(i), float(v)) for i, v in enumerate(rng.integers(-6, 7, n))] for n in range(0, 40)]
    for shape, kept in zip(shapes, simplify(spark, shapes), strict=True):
        if len(shape) <= 3:
            assert kept == shape
            continue
        at = [shape.index(p) for p in kept]  # x counts up, so points are distinct
        assert at == sorted(at) and at[0] == 0 and at[-1] == len(shape) - 1
        for a, b in zip(at, at[1:]):
            assert all(from_segment(shape[i], shape[a], shape[b]) <= 2.0 for i in range(a + 1, b))


def test_simplify_leaves_missing_polygons(spark):
    schema = "i int, polygon array<struct<x:double,y:double>>"
    rows = [(0, None), (1, []), (2, [(0.0, 0.0), (5.0, 0.0)]), (3, None)]
    got = G.simplify_polygons(spark.createDataFrame(rows, schema).coalesce(1)).orderBy("i").collect()
    assert [r.polygon and [tuple(p) for p in r.polygon] for r in got] == [None, [], [(0.0, 0.0), (5.0, 0.0)], None]


def test_simplify_by_hand(spark):
    flat = [(0.0, 0.0), (4.0, 1.0), (8.0, -1.0), (12.0, 0.0)]
    # Cut at the peak, then at (4, 0); what is left of it is flat.
    peak = [(0.0, 0.0), (1.0, 0.5), (2.0, 0.0), (3.0, 0.5), (4.0, 0.0), (6.0, 8.0), (12.0, 0.0)]
    # Pieces of three points stay as they are.
    short = [(0.0, 0.0), (4.0, 1.0), (8.0, 5.0), (12.0, 0.0)]
    still = [(1.0, 1.0)] * 5
    got = simplify(spark, [flat, peak, short, still])
    assert got == [[flat[0], flat[3]], [peak[0], peak[4], peak[5], peak[6]], short, [(1.0, 1.0)] * 2]


def test_nan_class_never_wins(spark):
    scores = "array(CAST('NaN' AS DOUBLE), 0.9D)"
    rest = "10D AS cx, 10D AS cy, 4D AS bw, 4D AS bh, 100D AS orig_w, 100D AS orig_h, 1D AS scale, 0D AS pad_x, 0D AS pad_y"
    df = spark.range(1).selectExpr("id AS image_id", "1 AS det_id", f"{scores} AS scores", *rest.split(", "))
    row = G.decode_lines(df).first()
    assert (row.class_id, row.score) == (1, 0.9)


def test_shapes_fall_back_to_box(spark):
    b = box(*[F.lit(float(x)) for x in (0, 0, 10, 10)])
    two = F.expr("array(named_struct('x',0D,'y',0D),named_struct('x',1D,'y',1D))")
    tri = F.expr("array(named_struct('x',0D,'y',0D),named_struct('x',4D,'y',0D),named_struct('x',0D,'y',4D))")
    at = lambda x, y, p: one(spark, in_shape(F.lit(float(x)), F.lit(float(y)), p, b))
    assert at(10, 10, two) and not at(10.1, 10, two)
    assert at(1, 1, tri) and not at(9, 9, tri)


def test_hit_test_takes_first_line(spark):
    lines = spark.createDataFrame(
        [(1, 5, 0.0, 0.0, 400.0, 300.0), (1, 2, 100.0, 100.0, 50.0, 50.0), (1, 9, 0.0, 0.0, 400.0, 300.0)],
        "doc_id int, line_id int, x double, y double, w double, h double",
    )
    points = spark.createDataFrame(
        [(1, 1, 120.0, 120.0), (2, 1, 399.0, 299.0), (3, 1, 900.0, 0.0), (4, 2, 1.0, 1.0)],
        "point_id int, doc_id int, px double, py double",
    )
    found = {r.point_id: r.hit for r in G.hit_test(points, lines).collect()}
    assert found == {1: 2, 2: 5, 3: -1, 4: -1}


def test_banned_tokens(spark):
    seq = {1: [5, 6, 7, 5, 6], 2: [5, 5, 5], 3: [9], 4: [8, 9], 5: [4, 4, 4, 4]}
    df = spark.createDataFrame(
        [(s, i, t) for s, ts in seq.items() for i, t in enumerate(ts)], "seq_id int, pos int, token_id int"
    )
    found = {}
    for r in T.banned_next(df).collect():
        found.setdefault(r.seq_id, set()).add(r.token_id)
    assert found == {1: {1, 7}, 2: {1, 5}, 3: {1}, 4: {1}, 5: {1, 4}}


def test_trigrams_across_spans(spark, monkeypatch):
    monkeypatch.setattr(T, "SPAN", 4)
    df = spark.createDataFrame([(1, i, i * 10) for i in range(11)], "seq_id int, pos int, token_id int")
    found = sorted((r.a, r.b, r.c) for r in T.trigrams(df).collect())
    assert found == [(i * 10, i * 10 + 10, i * 10 + 20) for i in range(9)]


def test_greedy_pick_ties_and_all_banned(spark):
    scores = spark.createDataFrame(
        [(1, 4, 2.0), (1, 3, 2.0), (1, 9, 5.0), (2, 7, 1.0), (3, 5, float("nan")), (3, 6, 0.5)],
        "seq_id int, token_id int, score double",
    )
    bans = spark.createDataFrame([(1, 9), (2, 7)], "seq_id int, token_id int")
    found = {r.seq_id: r.token_id for r in T.greedy_pick(scores, bans).collect()}
    assert found == {1: 3, 2: 0, 3: 6}


def test_end_cut(spark):
    df = spark.createDataFrame(
        [(1, i, 2 if i == 3 else 9) for i in range(6)] + [(2, i, 9) for i in range(300)], "seq_id int, pos int, token_id int"
    )
    counts = {r.seq_id: r["count"] for r in T.eos_cut(df).groupBy("seq_id").count().collect()}
    assert counts == {1: 3, 2: 256}


def test_vocabulary_overrides(spark):
    text = json.dumps({"model": {"vocab": {"a": 3, "b": 4}}, "added_tokens": [{"id": 4, "content": "<b>"}]})
    df = spark.createDataFrame([(text,), ("{}",)], "json string")
    assert {(r.id, r.token) for r in T.vocab_load(df).collect()} == {(3, "a"), (4, "<b>")}


@pytest.mark.parametrize("span", [4096, 2])
def test_detokenise_round_trip(spark, monkeypatch, span):
    monkeypatch.setattr(T, "SPAN", span)
    texts = ["Åäö €uro 😀 smörgås", "plain", "a\u0000b\n\t­ ", "\x7f\x80ÿ"]
    pieces, vocab = [], {}
    for s, text in enumerate(texts):
        # One token per byte, so that every character is cut.
        for pos, byte in enumerate(text.encode()):
            pieces.append((s, pos, 3 + byte))
    alphabet = spark.range(256).select(
        (F.col("id") + 3).cast("int").alias("id"), F.col("id").cast("int").alias("b")
    )
    rows = {b: b for b in range(256)}
    shown, extra = {}, 256
    for b in rows:
        if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF:
            shown[b] = chr(b)
        else:
            shown[b], extra = chr(extra), extra + 1
    vocab = spark.createDataFrame([(3 + b, c) for b, c in shown.items()] + [(1, "pad")], "id int, token string")
    assert alphabet.count() == vocab.count() - 1
    tokens = spark.createDataFrame(pieces + [(1, 90, 1), (1, 91, 9999)], "seq_id int, pos int, token_id int")
    built = T.detokenise(tokens, vocab)
    assert [r.text for r in built.orderBy("seq_id").collect()] == texts
    # Bytes after a span without a known token stay.
    lone = spark.createDataFrame([(7, 0, 1), (7, 1, 9999), (7, 2, 3 + 0xA4), (7, 3, 3 + 97)], tokens.schema)
    assert [r.text for r in T.detokenise(lone, vocab).collect()] == ["\ufffda"]
    encoded = spark.createDataFrame([(t,) for t in texts], "t string").select(
        "t", T.to_byte_alphabet(F.col("t")).alias("e")
    )
    for r in encoded.collect():
        assert r.e == "".join(shown[b] for b in r.t.encode())


def test_broken_bytes_become_replacement(spark):
    vocab = spark.createDataFrame([(3, "Ã"), (4, "a")], "id int, token string")
    tokens = spark.createDataFrame([(1, 0, 3), (1, 1, 4)], "seq_id int, pos int, token_id int")
    assert T.detokenise(tokens, vocab).first().text == "�a"


def test_error_sentinel(spark):
    df = spark.createDataFrame([("x", 0.5), (None, 0.9)], "text string, confidence double")
    assert [tuple(r) for r in T.error_sentinel(df).collect()] == [("x", 0.5, True), ("[error]", 0.0, True)]


def test_catalog_rules(spark):
    df = spark.createDataFrame(
        [("r1", "", "s", "5", ""), ("r2", "F", "", "6", "1700")],
        "reference_code string, fonds_title string, series_title string, volume_id string, date_text string",
    )
    found = {r.reference_code: (r.title, r.subtitle) for r in C.titles(df).collect()}
    assert found == {"r1": ("r1", "s / vol. 5"), "r2": ("F", "vol. 6 (1700)")}
    show = lambda t, q: tuple(one(spark, C.highlight(F.lit(t), q)))
    assert show("Hello World", " wOr ") == ("Hello ", "Wor", "ld")
    assert show("Hello", "x") == ("Hello", "", "")
    assert show("Hello", "  ") == ("Hello", "", "")


def test_first_group_only_and_line_ids(spark):
    pages = spark.createDataFrame([(1, "v", 1, 4), (2, "v", 2, 0)], "doc_id int, manifest_id string, page_number int, line_counter int")
    held = spark.createDataFrame([(2, 0)], "doc_id int, group_pos int")
    saved = spark.createDataFrame(
        [("v", 1, 0, 0, "a"), ("v", 1, 0, 1, "b"), ("v", 1, 1, 0, "c"), ("v", 2, 0, 0, "d")],
        "manifest_id string, page_number int, group_pos int, line_index int, text string",
    )
    found = W.hydrate(pages, held, saved).collect()
    assert sorted((r.doc_id, r.line_id, r.text) for r in found) == [(1, 4, "a"), (1, 5, "b")]
    # A second page of the same number takes nothing, even where the first one is filled.
    twice = pages.unionByName(spark.createDataFrame([(3, "v", 1, 0), (4, "v", 2, 0)], pages.schema))
    assert sorted(map(str, W.hydrate(twice, held, saved).collect())) == sorted(map(str, found))
    every = W.hydrate(pages, held, saved, first_group_only=False).collect()
    assert sorted(r.text for r in every) == ["a", "b", "c"]


def test_region_runs(spark):
    events = [
        (1, "region_lines", 2), (2, "line_done", 0), (3, "region_lines", 1), (4, "line_done", 0),
        (5, "line_done", 0), (6, "region_lines", 0),
    ]
    df = spark.createDataFrame(
        [(7, 0, s, k, t) for s, k, t in events], "image_id int, region_id int, seq int, type string, total int"
    )
    found = sorted((r.opened_by, r.completed_by, r.total) for r in E.region_completion(df).collect())
    assert found == [(3, 4, 1), (6, 6, 0)]
    gauge = {r.seq: r.in_flight for r in E.inflight_gauge(df).collect()}
    assert gauge == {1: 2, 2: 1, 3: 2, 4: 1, 5: 0, 6: 0}


def test_batch_eta(spark):
    value = E.batch_eta(F.lit(10), F.lit(0.5), F.lit(3), F.lit(0), F.lit(99.0))
    assert one(spark, value) == 10 + 2 * 14 * 0.5


def page(spark):
    pages = spark.createDataFrame([(1, 'a & "b".tif'), (2, "empty.jpg")], "doc_id int, name string")
    lines = spark.createDataFrame(
        [
            (1, 0, 0, 0, "one <two>", 10.0, 50.0, 100.0, 20.0, 0.5, True),
            (1, 1, 0, 1, "  ", 0.0, 10.0, 30.0, 20.0, 0.25, True),
            (1, 2, None, 0, "loose", 5.0, 90.0, 40.5, 20.0, 0.75, True),
            (1, 3, 1, 0, "open", 5.0, 95.0, 40.0, 20.0, 0.75, False),
        ],
        "doc_id int, line_id int, group_pos int, line_pos int, text string, x double, y double, w double, h double, confidence double, complete boolean",
    )
    groups = spark.createDataFrame(
        [(1, 0, "g0", None, None, None, None), (1, 1, "g1", 1.0, 2.0, 3.0, 4.0)],
        "doc_id int, group_pos int, name string, rx double, ry double, rw double, rh double",
    )
    return pages, groups, lines


def test_alto(spark):
    pages, _, lines = page(spark)
    found = {r.doc_id: r for r in X.export_alto(pages, lines, "now").collect()}
    assert found[1].file_name == 'a & "b"_alto.xml'
    root = ET.fromstring(found[1].content)
    at = root.find(".//{*}Page").attrib
    # Right edge of the first line and bottom of the last one.
    assert (at["WIDTH"], at["HEIGHT"]) == ("30", "110")
    texts = [[s.attrib["CONTENT"] for s in t.findall("{*}String")] for t in root.iter() if t.tag.endswith("TextLine")]
    assert texts == [[], ["one", "<two>"], ["loose"]]
    second = root.findall(".//{*}String")[1].attrib
    assert (second["ID"], second["HPOS"], second["WIDTH"], second["WC"]) == ("string_1_1", "60", "50", "0.500")
    empty = ET.fromstring(found[2].content).find(".//{*}Page").attrib
    assert (empty["WIDTH"], empty["HEIGHT"]) == ("0", "0")


def test_alto_moves_lines_before_they_are_written_out(spark):
    pages, _, lines = page(spark)
    plan = X.export_alto(pages, lines, "now")._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("Join") :]
    assert "Window" not in plan and "collect_list" in below
    # Elements were gathered and joined as text.
    assert "TextLine" in plan and "TextLine" not in below


def test_page_xml(spark):
    pages, groups, lines = page(spark)
    found = {r.doc_id: ET.fromstring(r.content) for r in X.export_page(pages, groups, lines, "now").collect()}
    regions = found[1].findall(".//{*}TextRegion")
    # The group without kept lines gives no region, the loose line is lost.
    assert [r.attrib["id"] for r in regions] == ["region_0"]
    assert [u.text for u in found[1].findall(".//{*}Unicode")] == ["one <two>", "  "]
    assert regions[0].find("{*}Coords").attrib["points"] == "0,10 110,10 110,70 0,70"
    assert found[2].findall(".//{*}TextRegion") == []
    bare = lines.withColumn("group_pos", F.lit(None).cast("int"))
    root = ET.fromstring(X.export_page(pages, groups, bare, "now").where("doc_id=1").first().content)
    assert [u.text for u in root.findall(".//{*}Unicode")] == ["  ", "one <two>", "loose"]


def test_json_export(spark):
    pages, groups, lines = page(spark)
    found = {r.doc_id: json.loads(r.content) for r in X.export_json(pages, groups, lines).collect()}
    assert found[2] == {"name": "empty.jpg", "groups": [], "lines": []}
    one_page = found[1]
    assert one_page["name"] == 'a & "b".tif'
    assert [g["name"] for g in one_page["groups"]] == ["g0", "g1"]
    assert [g["rect"] for g in one_page["groups"]] == [None, {"x": 1.0, "y": 2.0, "w": 3.0, "h": 4.0}]
    assert [[x["text"] for x in g["lines"]] for g in one_page["groups"]] == [["one <two>", "  "], []]
    assert [x["text"] for x in one_page["lines"]] == ["one <two>", "  ", "loose"]
    assert one_page["lines"][0]["polygon"] is None and "polygon" not in one_page["groups"][0]["lines"][0]
    assert one_page["lines"][0]["bbox"] == {"x": 10.0, "y": 50.0, "w": 100.0, "h": 20.0}
