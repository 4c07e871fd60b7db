"""Worker events in sequence: completion, gauges, stages, latest text, rates, debounce, cancels.

These are the batch forms; `leafscribe.streaming` holds the streaming ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafscribe.functions.numbers import duration_text, half_up
from leafscribe.operators.scale import GROUP_ROWS, Ordered

# Smoothing weights, lines assumed per page, delays in seconds.
NEW_WEIGHT, OLD_WEIGHT = 0.3, 0.7
LINES_PER_PAGE = 14
SAVE_DELAY, CATALOG_DELAY, SEARCH_DELAY = 2.0, 0.4, 0.3

REGION = ["image_id", "region_id"]
# After so many steps the weight of an older value is 0 in a double (0.7 ** 2200); a decayed average itself
# stops at the smallest double, so it never counts as "no value yet" again.
FORGOTTEN = 2200
SMALLEST = 5e-324


def _is(kind: str) -> Column:
    return F.col("type") == kind


def region_states(events: DataFrame, limit: int = GROUP_ROWS) -> DataFrame:
    """Each opening and line_done of a region, with whether it is open before and after.

    A region_lines event opens (or re-opens) the counter of its region; each line_done
    counts; the region closes when the count reaches the total. Events of a region that is
    not open change nothing.
    """
    used = events.where(_is("region_lines") | _is("line_done"))
    ordered = Ordered(used, REGION, ["seq"], limit)
    done = F.when(_is("line_done"), 1).otherwise(0).cast("long")
    ordered.running("_done", "sum", done)
    opening = F.when(
        _is("region_lines"), F.struct("seq", F.col("total").alias("total"), F.col("_done").alias("base"))
    )
    ordered.running("_epoch", "max", opening)
    ordered.running("_earlier", "max", opening, before=True)
    is_open = lambda epoch, n: F.coalesce(
        n - F.col(epoch + ".base") < F.col(epoch + ".total"), F.lit(False)
    )
    own = ordered.done().withColumns(
        {
            "open_before": is_open("_earlier", F.col("_done") - done),
            "open_after": is_open("_epoch", F.col("_done")),
            "done": F.col("_done") - F.col("_epoch.base"),
            "epoch_total": F.col("_epoch.total"),
            "opened_by": F.col("_epoch.seq"),
        }
    )
    return own.drop("_done", "_epoch", "_earlier")


def region_completion(events: DataFrame, limit: int = GROUP_ROWS) -> DataFrame:
    """One row per completed region run; an empty region completes at once."""
    states = region_states(events, limit)
    last_line = _is("line_done") & F.col("open_before") & ~F.col("open_after")
    empty = _is("region_lines") & (F.col("total") <= 0)
    return states.where(last_line | empty).select(
        "image_id",
        "region_id",
        F.col("opened_by"),
        F.col("seq").alias("completed_by"),
        F.col("epoch_total").alias("total"),
    )


def inflight_gauge(events: DataFrame, limit: int = GROUP_ROWS) -> DataFrame:
    """Lines under way per image: + total on dispatch, - 1 on done, never below 0."""
    used = events.where(_is("region_lines") | _is("line_done"))
    step = F.when(_is("region_lines"), F.col("total")).otherwise(-1).cast("long")
    ordered = Ordered(used, ["image_id"], ["seq"], limit)
    ordered.running("_sum", "sum", step).running("_low", "min", F.col("_sum"))
    gauge = F.col("_sum") - F.least(F.lit(0).cast("long"), F.col("_low"))
    return ordered.done().withColumn("in_flight", gauge).drop("_sum", "_low")


def active_images(events: DataFrame, limit: int = GROUP_ROWS) -> DataFrame:
    """Images and how many of their regions are still open at the end."""
    states = region_states(events, limit)
    last = states.groupBy(*REGION).agg(F.max_by("open_after", "seq").alias("open"))
    counts = last.groupBy("image_id").agg(F.count_if("open").alias("open_regions"))
    return counts.withColumn("active", F.col("open_regions") > 0)


def stages(events: DataFrame, limit: int = GROUP_ROWS) -> DataFrame:
    """Stage of each image after every opening and line_done.

    Done when no line is under way and no region is open, else transcribing.
    """
    states = region_states(events, limit)
    opened = F.col("open_after").cast("int") - F.col("open_before").cast("int")
    step = F.when(_is("region_lines"), F.col("total")).otherwise(-1).cast("long")
    ordered = Ordered(states.withColumn("_opened", opened), ["image_id"], ["seq"], limit)
    ordered.running("open_regions", "sum", F.col("_opened"))
    ordered.running("_sum", "sum", step).running("_low", "min", F.col("_sum"))
    gauge = F.col("_sum") - F.least(F.lit(0).cast("long"), F.col("_low"))
    ordered.with_columns({"in_flight": gauge})
    busy = (F.col("in_flight") > 0) | (F.col("open_regions") > 0)
    ordered.with_columns({"stage": F.when(busy, "transcribing").otherwise("done")})
    ordered.neighbour("previous", F.col("stage"), -1)
    return ordered.done().withColumn("previous", F.coalesce("previous", F.lit("idle")))


def stage_transitions(events: DataFrame, limit: int = GROUP_ROWS) -> DataFrame:
    changed = stages(events, limit).where("stage <> previous")
    return changed.select("image_id", "seq", "previous", "stage")


def ready(parts: DataFrame) -> DataFrame:
    """Jobs whose parts (job, part, ready) are all ready."""
    return parts.groupBy("job").agg(F.bool_and("ready").alias("all_ready"))


def latest_lines(events: DataFrame) -> DataFrame:
    """Newest text of each line; confidence and completion come from line_done.

    Works on a batch and on a stream (update mode): only mergeable aggregates.
    """
    used = events.where(_is("token") | _is("line_done"))
    finished = _is("line_done")
    return used.groupBy("image_id", "line_id").agg(
        F.max_by("text", "seq").alias("text"),
        F.max_by(F.when(finished, F.col("value")), F.when(finished, F.col("seq"))).alias(
            "confidence"
        ),
        F.bool_or(finished).alias("complete"),
    )


def _smooth(values: Column, started: bool = False) -> Column:
    """Running average of an array: the first non-zero value as is (unless `started`), then 0.3 new + 0.7 old."""

    def step(acc: Column, v: Column) -> Column:
        old = acc["avg"]
        new = NEW_WEIGHT * v + OLD_WEIGHT * old
        new = new if started else F.when(old == 0, v).otherwise(new)
        return F.struct(new.alias("avg"), F.concat(acc["all"], F.array(new)).alias("all"))

    start = F.struct(F.lit(0.0).alias("avg"), F.array().cast("array<double>").alias("all"))
    return F.aggregate(values, start, step)


def smoothed_rate(events: DataFrame, limit: int = 4096) -> DataFrame:
    """Seconds per line of each image, smoothed, with the time left for its pending lines.

    Input: one row per finished line, with times ascending by `seq`. Blocks are long enough for
    the value carried into a block to depend on the block before it and on whether any value
    came earlier, so all blocks fold in parallel.
    """
    block_rows = max(limit, FORGOTTEN)
    ordered = Ordered(events, ["image_id"], ["seq"], block_rows)
    seconds = F.unix_micros("ts") / 1e6
    ordered.neighbour("_was", seconds, -1)
    ordered.running("done", "sum", F.lit(1).cast("long"))
    ordered.with_columns({"seconds": seconds - F.col("_was")})
    totals = events.groupBy("image_id").agg(F.count(F.lit(1)).alias("total"))

    def averaged(timed: DataFrame, blocked: bool) -> DataFrame:
        chunk = ["image_id", "_block"] if blocked else ["image_id"]
        item = F.struct("seq", "seconds", "done")
        packed = timed.where("seconds IS NOT NULL").groupBy(*chunk)
        packed = packed.agg(F.array_sort(F.collect_list(item)).alias("items"))
        values = F.transform("items", lambda i: i["seconds"])
        carry = F.lit(0.0)
        if blocked:
            # The end of a block as the first with a value, and as a later one.
            ends = packed.select(*chunk, _smooth(values)["avg"].alias("_own"), _smooth(values, True)["avg"].alias("_on"))
            first = ends.where("_own <> 0").groupBy("image_id").agg(F.min("_block").alias("_first"))
            ends = ends.join(first, "image_id", "left")
            on = F.when(F.col("_on") == 0, F.lit(SMALLEST)).otherwise(F.col("_on"))
            carried = F.when(F.col("_block") == F.col("_first"), F.col("_own")).when(F.col("_block") > F.col("_first"), on)
            following = (F.col("_block") + 1).alias("_block")
            packed = packed.join(ends.select("image_id", following, carried.alias("_carry")), chunk, "left")
            carry = F.coalesce("_carry", carry)
        seeded = _smooth(F.concat(F.array(carry), values))["all"]
        both = F.zip_with(
            "items",
            F.slice(seeded, F.lit(2), F.size(values)),
            lambda i, a: F.struct(i.alias("i"), a.alias("avg")),
        )
        return packed.select("image_id", F.explode(both).alias("r"))

    rows = ordered.each(averaged)
    flat = rows.select("image_id", "r.i.*", "r.avg").join(totals, "image_id")
    pending = F.col("total") - F.col("done")
    return flat.withColumns(
        {"pending": pending, "eta": half_up(pending * F.col("avg"))}
    ).withColumn("eta_text", duration_text(F.col("eta")))


def batch_eta(eta: Column, average: Column, pages: Column, current: Column, lines: Column) -> Column:
    """Seconds left for a run over several pages; 14 lines per page before one is finished."""
    per_page = F.when(current > 0, F.try_divide(lines, current)).otherwise(float(LINES_PER_PAGE))
    return half_up(eta + (pages - current - 1) * per_page * average)


def debounce(events: DataFrame, delay: float = SAVE_DELAY, limit: int = GROUP_ROWS) -> DataFrame:
    """Last event of every burst, fired `delay` seconds after it."""
    ordered = Ordered(events, ["image_id"], ["ts", "seq"], limit)
    ordered.neighbour("_next", F.col("ts"), 1)
    gap = F.unix_micros("_next") - F.unix_micros("ts")
    last = ordered.done().where(F.col("_next").isNull() | (gap >= int(delay * 1e6)))
    fires = F.timestamp_micros(F.unix_micros("ts") + int(delay * 1e6))
    return last.withColumn("fires_at", fires).drop("_next")


def drop_cancelled(events: DataFrame, limit: int = GROUP_ROWS) -> DataFrame:
    """Tokens and results of a region are dropped from a cancel until its next region_lines."""
    ordered = Ordered(events, REGION, ["seq"], limit)
    ordered.running("_cancel", "max", F.when(_is("cancel"), F.col("seq")))
    ordered.running("_opened", "max", F.when(_is("region_lines"), F.col("seq")))
    cancelled = F.col("_cancel").isNotNull() & (
        F.col("_opened").isNull() | (F.col("_cancel") > F.col("_opened"))
    )
    dropped = (_is("token") | _is("line_done")) & cancelled
    return ordered.done().where(~dropped).drop("_cancel", "_opened")


ROUTES = {"region_lines": "detect", "token": "text", "line_done": "text", "cancel": "control"}


def route_events(events: DataFrame) -> DataFrame:
    """Each event with its lane and the payload of its type."""
    lane = F.lit("status")
    for kind, name in ROUTES.items():
        lane = F.when(_is(kind), name).otherwise(lane)
    body = F.from_json("text", "struct<k:bigint>")
    return events.withColumns(
        {
            "lane": lane,
            "n_lines": F.when(_is("region_lines"), F.col("total")),
            "line": F.when(_is("token") | _is("line_done"), F.col("line_id")),
            "payload_k": body["k"],
        }
    )


def lane(routed: DataFrame, name: str) -> DataFrame:
    return routed.where(F.col("lane") == name)
