"""Saving, reading back, comparing and deleting on files."""

from pyspark.sql import functions as F

from leafscribe.sinks import exports as X
from leafscribe.sources import store as S


def saved(views):
    lines = views.numbered_lines()
    return S.serialize_for_save(lines, views.groups(lines))


def rows(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=str)


def test_upsert(spark, views, tmp_path):
    path = str(tmp_path / "store")
    all_rows = saved(views).drop("doc_id").cache()
    first = all_rows.where("page_number <= 5")
    S.save(first, path)
    assert rows(S.saved_rows(spark, path)) == rows(first)
    # Changed and new rows of two volumes; the rest stays.
    change = all_rows.where("manifest_id IN ('src2', 'src3') AND page_number BETWEEN 5 AND 7")
    change = change.withColumn("text", F.concat("text", F.lit("!")))
    S.save(change, path)
    keep = first.join(change.select(*S.LINE_KEY), S.LINE_KEY, "left_anti")
    assert rows(S.saved_rows(spark, path)) == rows(keep.unionByName(change))
    S.save(change, path)
    assert S.saved_rows(spark, path).count() == keep.count() + change.count()


def test_shrunk_group(spark, views, tmp_path):
    path = str(tmp_path / "store")
    all_rows = saved(views).drop("doc_id").cache()
    S.save(all_rows, path)
    largest = all_rows.groupBy(*S.GROUP_KEY).count().orderBy(F.desc("count"), *S.GROUP_KEY).first()
    assert largest["count"] > 2
    own = F.lit(True)
    for key in S.GROUP_KEY:
        own = own & (F.col(key) == largest[key])
    S.save(all_rows.where(own & (F.col("line_index") < 2)), path)
    assert rows(S.saved_rows(spark, path)) == rows(all_rows.where(~own | (F.col("line_index") < 2)))


def test_one_volume_reads_one_partition(spark, views, tmp_path):
    path = str(tmp_path / "store")
    S.save(saved(views), path)
    one = S.saved_rows(spark, path, "src4")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(manifest_id" in plan
    assert {r.manifest_id for r in one.collect()} == {"src4"}


def test_changed_volumes(views):
    now = saved(views).cache()
    before = S.digests(now)
    assert S.changed_volumes(now, before).isEmpty()
    moved = now.withColumn(
        "line_index", F.when(F.col("manifest_id") == "src6", F.col("line_index") + 1).otherwise(F.col("line_index"))
    )
    assert [r.manifest_id for r in S.changed_volumes(moved, before).collect()] == ["src6"]


def test_drop_partition(spark, views, tmp_path):
    spark.sql("DROP TABLE IF EXISTS saved_lines")
    saved(views).write.partitionBy("manifest_id").option("path", str(tmp_path / "t")).saveAsTable("saved_lines")
    S.drop_saved_volume(spark, "saved_lines", "src2")
    left = {r.manifest_id for r in spark.table("saved_lines").select("manifest_id").distinct().collect()}
    assert "src2" not in left and "src3" in left
    spark.sql("DROP TABLE saved_lines")


def test_first_volume_only(views):
    lines = views.numbered_lines()
    groups = views.groups(lines)
    only = S.serialize_for_save(lines, groups, first_volume_only=True)
    assert only.select("manifest_id").distinct().count() == 1


def test_written_text_files(spark, views, tmp_path):
    pages = views.pages().where("doc_id BETWEEN 0 AND 5")
    exported = X.export_text(pages, views.lines(), 4)
    X.write_files(exported, str(tmp_path / "txt"))
    for name in {r.file_name for r in exported.collect()}:
        expected = [
            r.content for r in exported.where(F.col("file_name") == name).orderBy("part").collect()
        ]
        parts = sorted((tmp_path / "txt" / f"file_name={name}").glob("part=*/*.txt"), key=lambda p: int(p.parent.name[5:]))
        assert "".join(p.read_text() for p in parts) == "\n".join(expected) + "\n"
