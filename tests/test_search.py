"""The stored text index, bounded rank fusion, batched vector search, and one search over all of them."""

import math
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from leafscribe.operators.catalog import full_text
from leafscribe.operators.fusion import depth, fused
from leafscribe.operators.search import open_records, search_catalog
from leafscribe.operators.vectors import _Queries, _searched, vector_search_batch
from leafscribe.sources import text_index
from leafscribe.sources.text_index import TextIndex

WORDS = "socken kyrka dom häradsrätt protokoll år 1703 mantal skatt bonde".split()


def texts(n, seed=1):
    draw = random.Random(seed)
    weights = [2.0 ** -i for i in range(len(WORDS))]
    rows = [(f"SE/{i:04d}", " ".join(draw.choices(WORDS, weights, k=draw.randint(0, 30)))) for i in range(n)]
    return [*rows, ("SE/null", None), ("SE/empty", ""), ("SE/long", "kyrka, " * 5000), ("SE/case", "KYRKA—Kyrka;häradsrätt")]


@pytest.fixture(scope="module")
def records(spark):
    return spark.createDataFrame(texts(400), "reference_code string, description string").repartition(3)


@pytest.fixture(scope="module")
def index(spark, records, tmp_path_factory):
    index = TextIndex.create(spark, str(tmp_path_factory.mktemp("index")), "string", 8)
    part = F.crc32("reference_code") % 3
    for batch in range(3):
        index.append(records.where(part == batch), "reference_code", "description", batch, block=4, gathered=200)
    return index


def scores(df, key="key"):
    return {r[key]: round(r["score"], 9) for r in df.collect()}


@pytest.mark.parametrize("query", ["kyrka", "bonde skatt", "KYRKA häradsrätt 1703", "none such", "", "dom dom, dom"])
def test_index_scores_as_the_texts_do(records, index, query):
    assert scores(index.search(query)) == scores(full_text(records, "description", query), "reference_code")


@pytest.mark.parametrize("query", ["socken", "socken kyrka", "mantal skatt bonde", "kyrka mantal 1703 år"])
@pytest.mark.parametrize("k", [1, 10, 1000])
def test_best_blocks_give_the_same_top(records, index, query, k):
    every = sorted(scores(full_text(records, "description", query), "reference_code").items(), key=lambda p: (-p[1], p[0]))
    got = [(r["key"], round(r["score"], 9)) for r in index.top(query, k).collect()]
    assert got == every[:k]


def test_postings_of_a_task_are_held_in_arrays():
    draw = random.Random(3)
    words = pa.array([[f"w{draw.randrange(5000)}" for _ in range(300)] for _ in range(700)])
    batch = pa.record_batch([pa.array(range(10**6, 10**6 + 700)), words], ["key", "terms"])
    cut = text_index._cut(128, 10**6)
    list(cut(iter([batch.slice(0, 3)])))
    tracemalloc.start()
    blocks = list(cut(iter([batch.slice(i, 100) for i in range(0, 700, 100)])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # 109 bytes a posting as tuples.
    assert peak < 85 * sum(sum(b["n"].to_pylist()) for b in blocks)


def test_search_reads_only_its_buckets(index, capsys):
    index.search("kyrka").explain("formatted")
    plan = capsys.readouterr().out
    assert "PartitionFilters: [bucket#" in plan.replace("(", "").replace("isnotnull", "") or "bucket#" in plan.split("PartitionFilters")[1][:200]
    assert "In(term" in plan or "EqualTo(term,kyrka)" in plan
    files = {r["bucket"] for r in index._wanted("kyrka")[1].select("bucket").distinct().collect()}
    assert len(files) == 1


def test_bounds_leave_blocks_closed(spark, tmp_path):
    # One text is all about the term; the k-th score closes nearly all blocks.
    rows = [("a", "kyrka " * 9)] + [(f"b{i}", "kyrka " + "ord " * 50) for i in range(400)]
    index = TextIndex.create(spark, str(tmp_path / "i"))
    index.append(spark.createDataFrame(rows, "k string, t string").coalesce(1), "k", "t", 0, block=4)
    assert [r["key"] for r in index.top("kyrka", 1).collect()] == ["a"]
    plan = index.top("kyrka", 1)._jdf.queryExecution().optimizedPlan().toString()
    assert "bound" in plan
    assert index.blocks().where("term = 'kyrka'").count() == 101


def test_a_batch_is_replaced_and_keys_are_unique(spark, records, index, tmp_path):
    own = TextIndex.create(spark, str(tmp_path / "i"))
    own.append(records, "reference_code", "description", 0)
    own.append(records, "reference_code", "description", 0)
    assert scores(own.search("kyrka dom")) == scores(index.search("kyrka dom"))
    with pytest.raises(ValueError, match="indexed already"):
        own.append(records.limit(1), "reference_code", "description", 1)
    with pytest.raises(ValueError, match="None"):
        own.append(spark.createDataFrame([(None, "x")], "reference_code string, description string"), "reference_code", "description", 1)
    assert scores(own.search("kyrka dom")) == scores(index.search("kyrka dom"))


def test_compacted_index_is_the_same(index, tmp_path):
    whole = index.compact(str(tmp_path / "whole"), block=16)
    assert scores(whole.search("socken kyrka")) == scores(index.search("socken kyrka"))
    assert whole.blocks().count() < index.blocks().count()
    before, after = (sorted(map(tuple, i.vocabulary().collect())) for i in (index, whole))
    assert before == after


def test_empty_index(spark, tmp_path):
    index = TextIndex.create(spark, str(tmp_path / "i"), "long")
    index.append(spark.createDataFrame([], "k long, t string"), "k", "t", 0)
    assert index.search("kyrka").collect() == [] and index.top("kyrka", 3).collect() == []


# Fusion --------------------------------------------------------------------------------------


def all_ranks(rows):
    order = sorted((-s, k) for k, s in rows if s is not None)
    return {k: i for i, (_, k) in enumerate(order, 1)}


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("k", [1, 7])
def test_fused_equals_complete_ranking(spark, seed, k):
    draw = random.Random(seed)
    # Few different scores: many ties. Some records in one list only, some without a score.
    left = [(i, draw.choice([None, *range(6)])) for i in draw.sample(range(1000), draw.choice([5, 400, 900]))]
    right = [(i, draw.choice([None, *range(400)])) for i in draw.sample(range(1000), draw.choice([0, 300, 900]))]
    a, b = all_ranks(left), all_ranks(right)
    part = lambda r: 1 / (60 + r) if r else 0.0
    wanted = sorted((-(part(a.get(i)) + part(b.get(i))), i) for i in {*a, *b})[:k]
    wanted = [(i, a.get(i), b.get(i), round(-s, 12)) for s, i in wanted]
    frames = [spark.createDataFrame([(i, None if s is None else float(s)) for i, s in rows], "doc_id long, score double") for rows in (left, right)]
    got = fused(*frames, "doc_id", k).collect()
    assert [(r["doc_id"], r["text_rank"], r["vector_rank"], round(r["score"], 12)) for r in got] == wanted


def test_no_list_is_sorted_as_a_whole(spark):
    rows = spark.range(1000).select(F.col("id").alias("doc_id"), F.rand(3).alias("score"))
    plan = fused(rows, rows, "doc_id", 10)._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan.lower()
    assert f"TakeOrderedAndProject(limit={depth(10)}" in plan


# Vectors -------------------------------------------------------------------------------------


def best(rows, queries, k):
    out = []
    for name, q in queries:
        found = []
        for key, v in rows:
            if v is None or len(v) != len(q) or any(x is None or not math.isfinite(x) for x in v) or not any(v):
                continue
            a, b = np.array(v, float), np.array(q, float)
            found.append((-round(float(a @ b / math.sqrt(a @ a) / math.sqrt(b @ b)), 9), key))
        out += [(name, i, key, -s) for i, (s, key) in enumerate(sorted(found)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("most", [3, 4096])
def test_batched_cosine_equals_all_pairs(spark, most):
    draw = np.random.default_rng(2)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(draw.integers(-3, 4, (700, 8)))]
    nan, inf = float("nan"), float("inf")
    rows += [(900, None), (901, [0.0] * 8), (902, [nan] * 8), (903, [inf] * 8), (904, [1.0]), (905, [None] * 8), (906, rows[3][1])]
    queries = [(f"q{i:02d}", [float(x) for x in v]) for i, v in enumerate(draw.normal(size=(11, 8)))] + [("short", [2.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    asked = spark.createDataFrame([*queries, ("zero", [0.0] * 8), ("none", None)], "query string, vector array<double>")
    got = vector_search_batch(table, asked, 5, most=most).collect()
    assert sorted((r["query"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in got) == best(rows, queries, 5)
    assert vector_search_batch(table, asked.limit(0), 5).collect() == []


def test_batched_cosine_holds_little_besides_its_best_rows():
    draw = np.random.default_rng(4)
    queries, rows = draw.normal(size=(2000, 16)), draw.normal(size=(3000, 16))
    batches = pa.table({"key": np.arange(3000)[::-1], "vector": pa.array(list(rows))}).to_batches(1000)
    search = _searched(_Queries([f"{i}" for i in range(2000)], queries, 3), pa.int64())
    tracemalloc.start()
    out = list(search(iter(batches)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(len(b) for b in out) == 6000 and peak < 32 << 20


def test_batched_cosine_takes_the_smallest_keys_of_many_copies(spark):
    rows = [(i, [1.0, 0.0] if i % 3 else [3.0, float(i)]) for i in range(2999, -1, -1)]
    queries = [("copy", [2.0, 0.0]), ("copy2", [5.0, 0.0]), ("other", [1.0, 1.0])]
    asked = spark.createDataFrame(queries, "query string, vector array<double>")
    for key in (lambda i: i, lambda i: f"k{i:04d}"):
        kind = "long" if key(0) == 0 else "string"
        named = [(key(i), v) for i, v in rows]
        table = spark.createDataFrame(named, f"vec_id {kind}, embedding array<double>").coalesce(2)
        got = vector_search_batch(table, asked, 5).collect()
        assert sorted((r["query"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in got) == best(named, queries, 5)


# One search ----------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def catalog(spark, records):
    number = F.crc32("reference_code")
    blank = ["fonds_title", "fonds_description", "creator", "series_title", "volume_id", "date_text"]
    extra = {c: F.lit("") for c in blank}
    extra |= {"year_start": (1600 + number % 200).cast("int"), "archive_code": F.concat(F.lit("RA"), (number % 3).cast("string"))}
    return records.withColumns(extra).cache()


def found(page):
    return [(r["position"], r["reference_code"], round(r["score"], 9), r["total"]) for r in page.orderBy("position").collect()]


def test_pages_of_one_search_follow_each_other(catalog, index):
    whole = found(search_catalog(catalog, index, q="kyrka dom", limit=500))
    parts = [found(search_catalog(catalog, index, q="kyrka dom", limit=150, offset=at)) for at in range(0, 450, 150)]
    assert sum(parts, []) == whole
    assert [p for p, *_ in whole] == list(range(1, len(whole) + 1)) and {t for *_, t in whole} == {len(whole)}


def test_parameters(catalog, index):
    rows = {r["reference_code"]: r for r in catalog.collect()}
    every = found(search_catalog(catalog, index, limit=1000))
    assert [c for _, c, *_ in every] == sorted(rows)
    assert len(found(search_catalog(catalog, index, limit=0))) == 200
    some = found(search_catalog(catalog, index, q="kyrka", date_start=1650, date_end=1700, archive="RA1", limit=1000))
    plain = {c: s for _, c, s, _ in found(search_catalog(catalog, index, q="kyrka", archive="", limit=1000))}
    kept = {c: s for c, s in plain.items() if 1650 <= rows[c]["year_start"] <= 1700 and rows[c]["archive_code"] == "RA1"}
    assert {c: s for _, c, s, _ in some} == kept
    with pytest.raises(ValueError):
        search_catalog(catalog, index, q="x", mode="near")
    with pytest.raises(ValueError):
        search_catalog(catalog, index, q="x", mode="vector")
    with pytest.raises(ValueError, match="position"):
        search_catalog(catalog, index, q="x", limit=10**9)


def test_hybrid_ranks_what_passes_the_filters(spark, catalog, index):
    vectors = catalog.select("reference_code", F.array(*[((F.crc32("reference_code") + i) % 7 - 3).cast("double") for i in range(4)]).alias("embedding"))
    vectors = vectors.where("reference_code <> 'SE/long'")
    query = [1.0, 2.0, 0.0, -1.0]
    page = dict(q="kyrka bonde", archive="RA2", limit=1000)
    a = {c: p for p, c, *_ in found(search_catalog(catalog, index, **page))}
    b = {c: p for p, c, *_ in found(search_catalog(catalog, index, vectors, query_vector=query, mode="vector", **page))}
    wanted = sorted((-round(sum(1 / (60 + r[c]) for r in (a, b) if c in r), 9), c) for c in {*a, *b})
    got = found(search_catalog(catalog, index, vectors, query_vector=query, mode="hybrid", q="kyrka bonde", archive="RA2", limit=20, offset=5))
    assert [(c, s, t) for _, c, s, t in got] == [(c, -s, len(wanted)) for s, c in wanted[5:25]]


def test_opening_records_adds_only_new_pages(spark):
    found = spark.createDataFrame([("SE/1",), ("SE/2",), ("SE/3",), ("SE/4",), ("R0001203",), ("SE/9",)], "reference_code string")
    resolved = spark.createDataFrame(
        [("SE/1", "R0000001", None), ("SE/2", "R0000001", None), ("SE/3", None, "gone"), ("SE/4", "R0000004", None)],
        "code string, manifest_id string, error string",
    )
    manifests = spark.createDataFrame([("R0000001", 3), ("R0001203", 1), ("R0000004", 0)], "manifest_id string, n_pages int")
    known = spark.createDataFrame([("R0000001", 2)], "manifest_id string, page_number int")
    rows = sorted(map(tuple, open_records(found, resolved, manifests, known).collect()), key=str)
    assert [r[:4] for r in rows if r[4] is None] == [
        ("R0001203", "R0001203", 1, "R0001203_00001.jpg"),
        ("SE/1", "R0000001", 1, "R0000001_00001.jpg"),
        ("SE/1", "R0000001", 3, "R0000001_00003.jpg"),
    ]
    assert {r[0]: r[4] for r in rows if r[4]} == {
        "SE/3": "gone", "SE/4": "No pages found in this volume", "SE/9": "Could not find IIIF manifest ID in OAI-PMH response",
    }
