"""Pages, groups and lines held in the workspace: joins, counts, neighbours and edits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafscribe.functions.numbers import half_up
from leafscribe.functions.text import contains_folded, not_blank, trimmed
from leafscribe.operators.scale import GROUP_ROWS, Ordered, ordinal, within, without

UNNAMED = "unnamed"


def hydrate(
    pages: DataFrame,
    page_groups: DataFrame,
    saved: DataFrame,
    first_group_only: bool = True,
    limit: int = GROUP_ROWS,
) -> DataFrame:
    """Saved lines for pages that have no group yet, with new line ids after the page's own.

    pages: doc_id, manifest_id, page_number, line_counter. saved: manifest_id, page_number,
    group_pos, line_index and line columns. By default only a page's first saved group
    is taken, because after it the page has a group.
    """
    if first_group_only:
        firsts = saved.groupBy("manifest_id", "page_number").agg(
            F.min("group_pos").alias("group_pos")
        )
        saved = saved.join(firsts, ["manifest_id", "page_number", "group_pos"], "left_semi")
    # Two pages may carry the same number; only the first one can take the rows, and does not if it is filled.
    targets = pages.groupBy("manifest_id", "page_number").agg(
        F.min(F.struct("doc_id", "line_counter")).alias("t")
    )
    filled = page_groups.select(F.col("doc_id").alias("_filled")).distinct()
    targets = targets.join(filled, F.col("t.doc_id") == F.col("_filled"), "left_anti")
    placed = saved.drop("doc_id").join(targets, ["manifest_id", "page_number"])
    placed = placed.withColumns(
        {"doc_id": F.col("t.doc_id"), "line_counter": F.coalesce("t.line_counter", F.lit(0))}
    )
    numbered = ordinal(placed, ["doc_id"], ["group_pos", "line_index"], "_n", limit)
    return numbered.withColumns(
        {
            "line_id": (F.col("_n") - 1 + F.col("line_counter")).cast("long"),
            "complete": F.lit(True),
        }
    ).drop("_n", "t", "line_counter")


def _line_counts(lines: DataFrame) -> DataFrame:
    return lines.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.count_if("complete").alias("n_complete"),
        F.count("group_pos").alias("n_grouped"),
    )


def pages_with_counts(pages: DataFrame, lines: DataFrame) -> DataFrame:
    """Every page with its line counts, 0 where it has none."""
    counts = ("n_lines", "n_complete", "n_grouped")
    joined = pages.join(_line_counts(lines), "doc_id", "left")
    return joined.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in counts})


def pages_to_process(pages: DataFrame, lines: DataFrame, limit: int = GROUP_ROWS) -> DataFrame:
    """Pages without a group or without a line, with their turn inside the volume."""
    todo = pages_with_counts(pages, lines).where("n_lines = 0 OR n_grouped = 0")
    placed = todo.withColumn("_page", F.coalesce("page_number", F.lit(0)))
    return ordinal(placed, ["manifest_id"], ["_page", "doc_id"], "turn", limit).drop("_page")


def page_nav(pages: DataFrame, limit: int = GROUP_ROWS) -> DataFrame:
    """Position, total and neighbours of each page inside its volume."""
    held = pages.where("manifest_id IS NOT NULL").select(
        "manifest_id", F.coalesce("page_number", F.lit(0)).alias("page"), "doc_id"
    )
    ordered = Ordered(held, ["manifest_id"], ["page", "doc_id"], limit)
    ordered.running("position", "sum", F.lit(1).cast("long"))
    ordered.neighbour("prev_doc", F.col("doc_id"), -1).neighbour("next_doc", F.col("doc_id"), 1)
    totals = held.groupBy("manifest_id").agg(F.count(F.lit(1)).alias("total"))
    return ordered.done().join(totals, "manifest_id").withColumns(
        {"has_prev": F.col("prev_doc").isNotNull(), "has_next": F.col("next_doc").isNotNull()}
    )


def line_nav(lines: DataFrame, limit: int = GROUP_ROWS) -> DataFrame:
    """Previous and next line over the groups of a page; lines outside groups are not reached."""
    held = lines.where("group_pos IS NOT NULL").select("doc_id", "group_pos", "line_pos", "line_id")
    ordered = Ordered(held, ["doc_id"], ["group_pos", "line_pos", "line_id"], limit)
    ordered.neighbour("prev_line", F.col("line_id"), -1)
    ordered.neighbour("next_line", F.col("line_id"), 1)
    return ordered.done()


def progress_rollup(pages: DataFrame, lines: DataFrame) -> DataFrame:
    """Pages, lines, completed and pending per page, per volume and in total.

    Lines are counted per page before the join, the rollup then only sees pages.
    """
    counted = pages_with_counts(pages, lines).withColumn(
        "volume", F.coalesce(F.nullif("manifest_id", F.lit("")), F.lit(UNNAMED))
    )
    rolled = counted.rollup("volume", "doc_id").agg(
        F.count(F.lit(1)).alias("n_pages"),
        F.sum("n_lines").alias("n_lines"),
        F.sum("n_complete").alias("n_complete"),
        F.bool_or("pending").alias("working"),
        F.count_if((F.col("n_lines") > 0) & (F.col("n_lines") == F.col("n_complete"))).alias(
            "pages_done"
        ),
        F.grouping_id().alias("g"),
    )
    level = F.when(F.col("g") == 0, "page").when(F.col("g") == 1, "volume").otherwise("workspace")
    return rolled.withColumns(
        {"level": level, "n_pending": F.col("n_lines") - F.col("n_complete")}
    ).drop("g")


def page_complete(pages: DataFrame, lines: DataFrame) -> DataFrame:
    """True for pages with at least one line and all lines complete."""
    counted = pages_with_counts(pages, lines)
    flag = (F.col("n_lines") > 0) & (F.col("n_lines") == F.col("n_complete"))
    return counted.select("doc_id", flag.alias("transcribed"))


def filter_lines(lines: DataFrame, query: str) -> DataFrame:
    return lines.where(contains_folded(F.col("text"), query))


def filter_groups(lines: DataFrame, query: str) -> DataFrame:
    """Groups with at least one matching line."""
    hits = filter_lines(lines, query).where("group_pos IS NOT NULL")
    return hits.groupBy("doc_id", "group_pos").agg(F.count(F.lit(1)).alias("n_matches"))


def filter_pages(pages: DataFrame, lines: DataFrame, query: str) -> DataFrame:
    """Pages with a matching line, and the same at volume level; a blank query keeps all."""
    hits = filter_lines(lines, query).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_matches"))
    how = "inner" if query.strip() else "left"
    return pages.join(hits, "doc_id", how).withColumn(
        "n_matches", F.coalesce("n_matches", F.lit(0).cast("long"))
    )


def filter_volumes(pages: DataFrame, lines: DataFrame, query: str) -> DataFrame:
    kept = filter_pages(pages, lines, query)
    volume = F.coalesce(F.nullif("manifest_id", F.lit("")), F.lit(UNNAMED)).alias("volume")
    return kept.groupBy(volume).agg(
        F.count(F.lit(1)).alias("n_pages"), F.sum("n_matches").alias("n_matches")
    )


def group_text(lines: DataFrame, limit: int = GROUP_ROWS) -> DataFrame:
    """Non-blank texts of a group in group order; `part` counts blocks of an oversized group."""
    kept = lines.where("group_pos IS NOT NULL").where(not_blank(F.col("text")))
    packed = Ordered(kept, ["doc_id", "group_pos"], ["line_pos", "line_id"], limit)
    texts = packed.collected(F.col("text"), "texts")
    return texts.withColumn("content", F.array_join("texts", "\n")).drop("texts")


def delete_groups(rows: DataFrame, deleted: DataFrame) -> DataFrame:
    """Groups or lines without those of the deleted (doc_id, group_pos)."""
    return without(rows, deleted, ["doc_id", "group_pos"])


def last_edits(edits: DataFrame, keys, value: str, seq: str = "seq") -> DataFrame:
    return edits.groupBy(*keys).agg(F.max_by(value, seq).alias("_edit"))


def rename_groups(groups: DataFrame, edits: DataFrame) -> DataFrame:
    """Group names after the last rename (doc_id, group_pos, seq, text); blank names are ignored."""
    useful = edits.select("doc_id", "group_pos", "seq", trimmed(F.col("text")).alias("text"))
    newest = last_edits(useful.where("text <> ''"), ["doc_id", "group_pos"], "text")
    joined = groups.join(newest, ["doc_id", "group_pos"], "left")
    return joined.withColumn("name", F.coalesce("_edit", "name")).drop("_edit")


def edit_lines(lines: DataFrame, edits: DataFrame) -> DataFrame:
    """Line texts after the last edit (doc_id, line_id, seq, text); any text counts."""
    useful = edits.where("text IS NOT NULL")
    newest = last_edits(useful, ["doc_id", "line_id"], "text")
    joined = lines.join(newest, ["doc_id", "line_id"], "left")
    return joined.withColumn("text", F.coalesce("_edit", "text")).drop("_edit")


def remove_volumes(pages: DataFrame, volumes: DataFrame) -> DataFrame:
    """Pages that are left after removing the listed volumes."""
    return without(pages, volumes, ["manifest_id"])


def lines_of(pages: DataFrame, lines: DataFrame) -> DataFrame:
    """Lines whose page is still there."""
    return within(lines, pages, ["doc_id"])


def rerun_requests(pages: DataFrame, groups: DataFrame) -> DataFrame:
    """What to send again: each group that has a box, or the whole page if it has no groups."""
    regions = pages.select("doc_id").join(groups, "doc_id").where("rx IS NOT NULL")
    grouped = groups.select("doc_id").distinct()
    whole = pages.select("doc_id").join(grouped, "doc_id", "left_anti")
    missing = F.lit(None)
    return regions.select(
        "doc_id", F.lit("region").alias("request"), "group_pos", "rx", "ry", "rw", "rh"
    ).unionByName(
        whole.select(
            "doc_id",
            F.lit("page").alias("request"),
            missing.cast("int").alias("group_pos"),
            *[missing.cast("double").alias(c) for c in ("rx", "ry", "rw", "rh")],
        )
    )


def cleared_lines(rerun: DataFrame, groups: DataFrame, lines: DataFrame) -> DataFrame:
    """Lines that are left after a re-run starts: pages that have groups lose all their lines."""
    grouped = rerun.select("doc_id").join(groups.select("doc_id").distinct(), "doc_id", "left_semi")
    return without(lines, grouped, ["doc_id"])


def confidence_bands(lines: DataFrame) -> DataFrame:
    """Complete lines with their band and whole percent."""
    c = F.col("confidence")
    band = F.when(c > 0.7, "high").when(c > 0.4, "mid").otherwise("low")
    return lines.where("complete").withColumns(
        {"band": band, "percent": half_up(c * 100).cast("int")}
    )


def line_group(lines: DataFrame, members: DataFrame) -> DataFrame:
    """Index of the first group that holds a line, null if none does.

    members: doc_id, line_id, group_pos, one row per membership.
    """
    first = members.where("group_pos IS NOT NULL").groupBy("doc_id", "line_id").agg(
        F.min("group_pos").alias("first_group")
    )
    return lines.join(first, ["doc_id", "line_id"], "left")
