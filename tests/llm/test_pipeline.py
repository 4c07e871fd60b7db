import os
import sys

from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
import corpus_pipeline  # noqa: E402

DOCS = [
    (1, None, "sv", "src1", 0),
    (2, "12 - 7", "sv", "src1", 6),
    (10, " ".join(f"ord{i}" for i in range(80)), "sv", "src1", 9),
    (11, " ".join(f"ord{i}" for i in range(80)), "sv", "src2", 9),
    (12, " ".join(f"ord{i}" for i in range(79)) + " ny", "sv", "src2", 9),
    (13, "början " + " ".join(f"prov{i}" for i in range(12)) + " slut", "sv", "src3", 9),
    (14, "en helt annan sida om tinget i socknen", None, None, None),
    (14, "en helt annan sida om tinget i socknen", None, None, None),
]


def tables(spark, folder, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{folder}/documents.parquet")
    item = spark.createDataFrame([(0, " ".join(f"prov{i}" for i in range(12)))], "item_id long, text string")
    item.write.parquet(f"{folder}/benchmark.parquet")
    return spark.read.parquet(f"{folder}/documents.parquet")


def test_stages(spark, tmp_path):
    docs = tables(spark, tmp_path, DOCS)
    left = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        left.append(sorted(r.doc_id for r in docs.collect()))
    assert left == [[10, 11, 12, 13, 14, 14], [11, 12, 13, 14, 14], [11, 13, 14, 14], [11, 14, 14]]
    pieces = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted({r.doc_id for r in pieces.collect()}) == [11, 14]
    total = pieces.agg(F.sum("length")).first()[0]
    assert total == sum(r.doc_tokens for r in pieces.where("start = 0").collect())


def test_no_documents(spark, tmp_path):
    tables(spark, tmp_path, [])
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_no_known_language(spark, tmp_path):
    texts = [None, "", "12 - 7", "en sida", "две строки", "3 º", "ª"]
    docs = tables(spark, tmp_path, [(i, t, None, None, None) for i, t in enumerate(texts)])
    assert sorted(r.doc_id for r in corpus_pipeline.language(spark, docs, str(tmp_path)).collect()) == [3, 4, 5, 6]
    pieces = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted({r.doc_id for r in pieces.collect()}) == [3, 4, 5, 6]


def test_language_rejects_rows_not_ids(spark, tmp_path):
    rows = [(None, "12", None, None, None), (None, "en sida", None, None, None), (7, None, None, None, None)]
    docs = tables(spark, tmp_path, [*rows, (7, "en annan", None, None, None)])
    left = corpus_pipeline.language(spark, docs, str(tmp_path)).collect()
    assert sorted(r.text for r in left) == ["en annan", "en sida"]


def test_language_keeps_columns_of_any_name(spark, tmp_path):
    rows = [(1, "en sida " * 40_000, "sv", "a", 1), (2, "4", "sv", "a", 1), (3, "in nomine", "la", None, None)]
    docs = tables(spark, tmp_path, rows).withColumn("lang_pred", F.lit("own")).withColumn("score", F.lit(1))
    left = corpus_pipeline.language(spark, docs, str(tmp_path))
    assert left.columns == docs.columns
    assert sorted((r.doc_id, r.lang, r.lang_pred) for r in left.collect()) == [(1, "sv", "own"), (3, "la", "own")]


def test_null_and_repeated_ids_stand_for_one_text(spark, tmp_path):
    long = [" ".join(f"{w}{i}" for i in range(80)) for w in ("ord", "rad")]
    leak = "början " + " ".join(f"prov{i}" for i in range(12)) + " slut"
    rows = [(None, long[0]), (None, long[0] + " ny"), (None, leak), (None, "en sida för sig"), (None, None)]
    rows += [(5, long[0] + " än"), (5, leak + " här"), (5, "en annan sida"), (5, "7")]
    rows += [(9, long[1]), (9, long[1] + " ny")]
    docs = tables(spark, tmp_path, [(i, t, None, None, None) for i, t in rows])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
    left = sorted((r.doc_id or 0, r.text) for r in docs.collect())
    assert left[:3] == [(0, "en sida för sig"), (5, "en annan sida"), (5, long[0] + " än")]
    assert len(left) == 4 and left[3][0] == 9 and left[3][1].startswith(long[1])


def test_near_copies_without_ids(spark, tmp_path):
    long = " ".join(f"ord{i}" for i in range(80))
    docs = tables(spark, tmp_path, [(None, t, None, None, None) for t in (long, long + " ny", "en sida")])
    left = [r.text for r in corpus_pipeline.near(spark, docs, str(tmp_path)).collect()]
    assert len(left) == 2 and "en sida" in left


def test_repeated_rows_are_packed_once(spark, tmp_path):
    texts = [(4, "en sida"), (4, "en sida"), (4, "en annan"), (None, "utan nummer"), (None, "utan nummer"), (None, "två")]
    docs = tables(spark, tmp_path, [(i, t, "sv", str(n), n) for n, (i, t) in enumerate(texts * 3 + [(8, "ensam")])])
    pieces = corpus_pipeline.pack(spark, docs, str(tmp_path)).collect()
    assert sorted(r.doc_id or 0 for r in pieces) == [0, 0, 4, 4, 8]
    assert len({(r.doc_id, r.ids_crc32) for r in pieces}) == 5
