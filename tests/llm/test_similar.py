"""The most similar records against a comparison with every record in plain Python."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafscribe.llm.similar import Layout, Space, similar_records

SCHEMA = "reference_code long, embedding array<float>"


def expected(rows, k, scale=1024.0, every=5):
    valid = []
    for code, v in rows:
        if code is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        valid.append((code, [math.floor(float(np.float32(x)) * scale) for x in v]))
    queries = {(c, tuple(u)) for c, u in valid if c % every == 0}
    out = []
    for q, u in queries:
        best = sorted((-sum(a * b for a, b in zip(u, w, strict=False)), c) for c, w in valid if c != q)[:k]
        out += [(q, i, c, -s) for i, (s, c) in enumerate(best, 1)]
    return sorted(out)


def found(df, k=10, every=5, **options):
    rows = similar_records(df, F.col("reference_code") % every == 0, k, **options)
    return sorted(tuple(r) for r in rows.select("query_code", "rank", "reference_code", "score").collect())


def vectors(n, size=6, clusters=4, seed=1, spread=0.1):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(clusters, size))
    points = centres[draw.integers(0, clusters, n)] + spread * draw.normal(size=(n, size))
    return [(i, [float(x) for x in p]) for i, p in enumerate(points)]


@pytest.mark.parametrize("options", [{}, {"pivots": 9, "group_queries": 7, "block_records": 20}, {"pivots": 1, "group_queries": 3}])
def test_equals_all_pairs(spark, options):
    rows = vectors(300)
    assert found(spark.createDataFrame(rows, SCHEMA), **options) == expected(rows, 10)


def test_lengths_of_vectors_differ(spark):
    # Inner products, not cosines: long vectors win.
    draw = np.random.default_rng(4)
    rows = [(i, [float(x) for x in draw.normal(size=4) * 10.0 ** draw.integers(-2, 3)]) for i in range(200)]
    assert found(spark.createDataFrame(rows, SCHEMA), pivots=12, group_queries=5, block_records=16) == expected(rows, 10)


def test_one_vector_on_a_third_of_the_records(spark):
    rows = vectors(240)
    rows += [(1000 + i, rows[5][1]) for i in range(120)] + [rows[7]] * 20 + [rows[10]] * 15
    random.Random(2).shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    assert found(df, k=4, pivots=8, group_queries=10, block_records=30) == expected(rows, 4)


def test_hard_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (5, None), (10, [1.0, None]), (15, [nan, 1.0]), (20, [inf, 0.0]), (None, [5.0, 5.0]), (25, [])]
    rows += [(1, [3.0]), (2, [0.0, 1.0, 7.0]), (3, [1.0, 2.0]), (4, [1.0, 2.0]), (0, [2.0, 1.0]), (6, [1e6, 1e6]), (30, [-4e5, 1e6])]
    df = spark.createDataFrame(rows, SCHEMA)
    clash = df.withColumns({c: F.lit("x") for c in ["rank", "score", "units", "cell", "group", "block", "salt", "wanted", "size"]})
    assert found(clash, k=3) == expected(rows, 3)
    assert found(df.limit(0)) == []
    assert found(df.where("reference_code = 3")) == []
    # Too few records for k.
    assert found(df.where("reference_code IN (0, 3)"), k=9) == expected([r for r in rows if r[0] in (0, 3)], 9)


def test_scores_beyond_64_bits_fail(spark):
    df = spark.createDataFrame([(0, [3e7, 3e7]), (1, [3e7, 3e7])], SCHEMA)
    with pytest.raises(Exception, match="64-bit"):
        found(df)


def test_codes_may_be_text(spark):
    rows = [(f"SE/RA/{i:03d}", [float(i % 7), 1.0]) for i in range(30)]
    df = spark.createDataFrame(rows, "reference_code string, embedding array<double>")
    got = similar_records(df, F.col("reference_code") == "SE/RA/003", 2).collect()
    assert [(r.query_code, r.rank, r.reference_code) for r in got] == [("SE/RA/003", 1, "SE/RA/006"), ("SE/RA/003", 2, "SE/RA/013")]


def test_far_records_are_not_sent():
    # Two distant clusters: a group of queries in one does not get the records of the other.
    pivots = np.array([[1000, 0], [-1000, 0]])
    space = Space(pivots, 1000.0**2)
    layout = Layout(space, np.array([70.0, -np.inf]), np.array([3, 0]), np.array([5, 5]), np.array([40.0, 40.0]), 8, 4)
    row, group = layout.groups_of(np.array([[999, 1], [-999, 1], [998, 20]]))
    assert row.tolist() == [0, 2] and group.tolist() == [0, 0]
    row, block = layout.blocks_of(np.array([[1000, 0]]), np.array([30.0]))
    # The cell of five records has two blocks.
    assert block.tolist() == [0, 1]
