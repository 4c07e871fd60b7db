"""Worker events as Structured Streaming queries.

Input is the event view as a stream, with `seq` rising over the triggers. Work that fits a
streaming aggregate or session window uses it; counters that are reset, cancelled or
clamped at zero keep a small state per key. One trigger holds at most what the source lets in
(`maxFilesPerTrigger`, `maxOffsetsPerTrigger`), and that bounds the rows a key sorts at once.
Set the RocksDB state store provider for these queries.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from leafscribe.operators.events import (
    CATALOG_DELAY,
    NEW_WEIGHT,
    OLD_WEIGHT,
    latest_lines,
    route_events,
)
from leafscribe.sources.views import event_rows

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

EVENT_TABLE = (
    "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
)


def read_events(spark: SparkSession, folder: str, files_per_trigger: int = 1) -> DataFrame:
    raw = (
        spark.readStream.schema(EVENT_TABLE)
        .option("maxFilesPerTrigger", files_per_trigger)
        .parquet(folder)
    )
    return event_rows(raw)


def _processor(columns: list[str], state: str, start: tuple, step: Callable, ttl_ms: int | None):
    """A processor that folds the rows of a key in `seq` order over one state tuple.

    `step(state, row)` gives (state or None to drop it, list of output tuples). Classes and
    functions are nested so that they travel to the Python workers by value.
    """

    class Fold(StatefulProcessor):
        def init(self, handle):
            self.held = handle.getValueState("held", state, ttl_ms)

        def handleInputRows(self, key, rows, timerValues):
            import pandas as pd

            held = self.held.get() if self.held.exists() else None
            held = start if held is None else tuple(held)
            out = []
            batch = pd.concat(list(rows), ignore_index=True).sort_values("seq")
            for row in batch.itertuples(index=False):
                held, made = step(held, row)
                held = start if held is None else held
                out += [(*key, *m) for m in made]
            if held == start:
                self.held.clear()
            else:
                self.held.update(held)
            yield pd.DataFrame(out, columns=columns)

        def close(self):
            pass

    return Fold()


def _folded(events, keys, schema, state, start, step, ttl_ms=None) -> DataFrame:
    columns = [part.split()[0] for part in schema.split(",")]
    return events.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=_processor(columns, state, start, step, ttl_ms),
        outputStructType=schema,
        outputMode="Append",
        timeMode="ProcessingTime" if ttl_ms else "None",
    )


def region_completion(events: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """Emits a region run when its last line is done; an empty region completes at once."""

    def step(held, row):
        opened_by, total, done = held
        if row.type == "region_lines":
            if row.total <= 0:
                return None, [(row.seq, row.seq, row.total)]
            return (int(row.seq), int(row.total), 0), []
        if opened_by < 0:
            return None, []
        if done + 1 >= total:
            return None, [(opened_by, row.seq, total)]
        return (opened_by, total, done + 1), []

    used = events.where(F.col("type").isin("region_lines", "line_done"))
    return _folded(
        used.select("image_id", "region_id", "seq", "type", "total"),
        ["image_id", "region_id"],
        "image_id long, region_id int, opened_by long, completed_by long, total int",
        "opened_by long, total int, done int",
        (-1, 0, 0),
        step,
        ttl_ms,
    )


def inflight_gauge(events: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """Lines under way per image after every dispatch and every finished line."""

    def step(held, row):
        (value,) = held
        value = value + int(row.total) if row.type == "region_lines" else max(0, value - 1)
        return (value,), [(row.seq, value)]

    used = events.where(F.col("type").isin("region_lines", "line_done"))
    return _folded(
        used.select("image_id", "seq", "type", "total"),
        ["image_id"],
        "image_id long, seq long, in_flight long",
        "value long",
        (0,),
        step,
        ttl_ms,
    )


def _image_states(events: DataFrame, ttl_ms: int | None) -> DataFrame:
    """Stage, lines under way and open regions of each image after every opening and line_done.
    The lines left per open region live in a JSON map."""

    def step(held, row):
        import json

        stage, in_flight, packed = held
        regions = json.loads(packed)
        region = str(row.region_id)
        if row.type == "region_lines":
            in_flight += int(row.total)
            regions.pop(region, None)
            if row.total > 0:
                regions[region] = int(row.total)
        else:
            in_flight = max(0, in_flight - 1)
            if region in regions:
                regions[region] -= 1
                if regions[region] <= 0:
                    del regions[region]
        now = "transcribing" if in_flight > 0 or regions else "done"
        return (now, in_flight, json.dumps(regions)), [(row.seq, stage, now, len(regions))]

    used = events.where(F.col("type").isin("region_lines", "line_done"))
    return _folded(
        used.select("image_id", "region_id", "seq", "type", "total"),
        ["image_id"],
        "image_id long, seq long, previous string, stage string, open_regions long",
        "stage string, in_flight long, regions string",
        ("idle", 0, "{}"),
        step,
        ttl_ms,
    )


def stage_transitions(events: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """Changes between transcribing and done per image."""
    return _image_states(events, ttl_ms).where("stage <> previous").drop("open_regions")


def active_images(events: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """Open regions of an image after each of its events; it is active while there are any."""
    states = _image_states(events, ttl_ms).select("image_id", "seq", "open_regions")
    return states.withColumn("active", F.col("open_regions") > 0)


def drop_cancelled(events: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """Tokens and results are dropped from a cancel until the next region_lines."""

    def step(held, row):
        (cancelled,) = held
        if row.type == "cancel":
            cancelled = True
        elif row.type == "region_lines":
            cancelled = False
        dropped = cancelled and row.type in ("token", "line_done")
        return (cancelled,), [] if dropped else [(row.seq, row.type)]

    return _folded(
        events.select("image_id", "region_id", "seq", "type"),
        ["image_id", "region_id"],
        "image_id long, region_id int, seq long, type string",
        "cancelled boolean",
        (False,),
        step,
        ttl_ms,
    )


def smoothed_rate(events: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """Smoothed seconds per finished line of each image."""
    new_weight, old_weight = NEW_WEIGHT, OLD_WEIGHT

    def step(held, row):
        last, average, n = held
        if n == 0:
            return (int(row.us), 0.0, 1), []
        seconds = (row.us - last) / 1e6
        average = seconds if average == 0 else new_weight * seconds + old_weight * average
        return (int(row.us), float(average), n + 1), [(row.seq, seconds, average)]

    done = events.where("type = 'line_done'")
    return _folded(
        done.select("image_id", "seq", F.unix_micros("ts").alias("us")),
        ["image_id"],
        "image_id long, seq long, seconds double, avg double",
        "last long, avg double, n long",
        (0, 0.0, 0),
        step,
        ttl_ms,
    )


def latest_line(events: DataFrame) -> DataFrame:
    """Newest text of each line; run in update mode."""
    return latest_lines(events)


def debounce(events: DataFrame, delay: float = CATALOG_DELAY, late: str = "1 minute") -> DataFrame:
    """Last event of every burst, once the watermark has passed its quiet time; append mode."""
    micros = int(delay * 1e6)
    window = F.session_window("ts", f"{micros} microseconds")
    bursts = (
        events.withWatermark("ts", late)
        .groupBy("image_id", window)
        .agg(F.max(F.struct("ts", "seq")).alias("last"))
    )
    return bursts.select(
        "image_id",
        F.col("last.seq").alias("seq"),
        F.timestamp_micros(F.unix_micros("last.ts") + micros).alias("fires_at"),
    )


def write_lanes(events: DataFrame, folder: str, checkpoint: str):
    """Routes one event stream to one folder per lane; a repeated batch replaces its own files."""

    def write(batch: DataFrame, number: int) -> None:
        (
            route_events(batch)
            .withColumn("batch", F.lit(number))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("lane", "batch")
            .parquet(folder)
        )

    return (
        events.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
