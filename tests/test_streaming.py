"""Every streaming query, replayed over several files, equals its batch twin."""

import pytest
from pyspark.sql import functions as F

from leafscribe.operators import events as E
from leafscribe.streaming import events as R


@pytest.fixture(scope="module")
def feed(spark, tmp_path_factory):
    """The events table in four files, in event order."""
    folder = str(tmp_path_factory.mktemp("feed"))
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").orderBy("event_id")
    top = events.agg(F.max("event_id")).first()[0] + 1
    for part in range(4):
        low, high = part * top // 4, (part + 1) * top // 4
        piece = events.where((F.col("event_id") >= low) & (F.col("event_id") < high))
        piece.coalesce(1).write.mode("append").parquet(folder)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", R.ROCKSDB)
    return folder


def drained(stream, spark, name, tmp_path, mode="append"):
    query = (
        stream.writeStream.format("memory").queryName(name).outputMode(mode)
        .option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.table(name)


def rows(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=str)


@pytest.mark.parametrize("name", ["region_completion", "inflight_gauge", "stage_transitions", "drop_cancelled"])
def test_stateful(spark, views, feed, tmp_path, name):
    found = drained(getattr(R, name)(R.read_events(spark, feed)), spark, name, tmp_path)
    expected = getattr(E, name)(views.events()).select(*found.columns)
    assert rows(found) == rows(expected)


def test_active_images(spark, views, feed, tmp_path):
    found = drained(R.active_images(R.read_events(spark, feed)), spark, "active", tmp_path)
    expected = E.stages(views.events()).select("image_id", "seq", "open_regions")
    assert rows(found.drop("active")) == rows(expected)


def test_smoothed_rate(spark, views, feed, tmp_path):
    found = drained(R.smoothed_rate(R.read_events(spark, feed)), spark, "rates", tmp_path)
    done = views.events().where("type = 'line_done'").select("image_id", "seq", "ts")
    expected = {(r.image_id, r.seq): r.avg for r in E.smoothed_rate(done).collect()}
    mine = {(r.image_id, r.seq): r.avg for r in found.collect()}
    assert mine.keys() == expected.keys()
    assert all(abs(mine[k] - expected[k]) < 1e-6 * max(1, expected[k]) for k in mine)


def test_latest_line(spark, views, feed, tmp_path):
    stream = R.latest_line(R.read_events(spark, feed))
    found = drained(stream, spark, "latest", tmp_path, mode="complete")
    assert rows(found) == rows(E.latest_lines(views.events()))


def test_debounce(spark, views, feed, tmp_path):
    found = drained(R.debounce(R.read_events(spark, feed), 7200.0), spark, "bursts", tmp_path)
    expected = E.debounce(views.events(), 7200.0).select("image_id", "seq", "fires_at")
    # Sessions still open at the last watermark are held back.
    newest = views.events().agg(F.max("ts")).first()[0]
    closed = expected.where(F.col("fires_at") < F.lit(newest) - F.expr("INTERVAL 1 MINUTE"))
    out = rows(found)
    assert set(rows(closed)) <= set(out) <= set(rows(expected))
    assert len(out) == len(set(out)) > 0


def test_lanes(spark, views, feed, tmp_path):
    query = R.write_lanes(R.read_events(spark, feed), str(tmp_path / "lanes"), str(tmp_path / "cp"))
    query.awaitTermination()
    found = spark.read.parquet(str(tmp_path / "lanes")).select("seq", "lane", "payload_k")
    assert rows(found) == rows(E.route_events(views.events()).select("seq", "lane", "payload_k"))
