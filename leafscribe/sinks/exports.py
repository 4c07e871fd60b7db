"""Page exports: plain text, JSON, ALTO XML and PAGE XML.

A file is built from ordered fragments. A page of ordinary size gives one row (part 0);
an oversized page gives one row per block, and the file is its parts one after the other.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leafscribe.functions.numbers import half_up, three_digits
from leafscribe.functions.text import json_or_null, json_string, words, xml_escaped
from leafscribe.operators.geometry import bounding_box
from leafscribe.operators.scale import (
    GROUP_ROWS,
    Ordered,
    divided,
    has_large_group,
    large_groups,
    ordinal,
)

SOFTWARE = "leafscribe"
# Name space addresses of the two public XML formats.
ALTO_SPACE = "http://www.loc.gov/standards/alto/ns-v4#"
ALTO_SCHEMA = "http://www.loc.gov/standards/alto/v4/alto-4-4.xsd"
PAGE_SPACE = "http://schema.primaresearch.org/PAGE/gts/pagecontent/2019-07-15"
XSI = "http://www.w3.org/2001/XMLSchema-instance"
PROLOG = '<?xml version="1.0" encoding="UTF-8"?>'


def with_text(lines: DataFrame) -> DataFrame:
    """Complete lines whose text is not empty; a text of blanks counts."""
    return lines.where("complete AND text <> ''")


def file_name(name: Column, ending: str) -> Column:
    return F.concat(F.regexp_replace(name, r"\.[^.]+$", ""), F.lit(ending))


def _template(pattern: str, **values: Column) -> Column:
    """Fills `{name}` fields of a pattern with columns."""
    pieces = re.split(r"\{(\w+)\}", pattern)
    return F.concat(
        *[values[p].cast("string") if i % 2 else F.lit(p) for i, p in enumerate(pieces)]
    )


def _by_size(build: Callable, limit: int, pages: DataFrame, lines: DataFrame, *others: DataFrame):
    """Builds ordinary pages and large pages apart: `build(small, pages, lines, ...)`."""
    large = large_groups(lines, ["doc_id"], limit)
    if large is None:
        return build(True, pages, lines, *others)
    parts = [divided(df, large, ["doc_id"]) for df in (pages, lines, *others)]
    few, many = zip(*parts, strict=True)
    return build(True, *few).unionByName(build(False, *many))


def _assembled(fragments: DataFrame, joint: str, limit: int) -> DataFrame:
    ordered = Ordered(fragments, ["doc_id"], ["s", "a", "b"], limit)
    packed = ordered.collected(F.col("fragment"), "pieces")
    return packed.select("doc_id", "part", F.array_join("pieces", joint).alias("content"))


FIRST, LAST = -1, 2**62


def _fragments(df: DataFrame, *pieces: tuple) -> DataFrame:
    """Fragments (section, text[, place, place inside]) of each row, in one pass."""

    def place(value):
        return (F.col(value) if isinstance(value, str) else F.lit(value)).cast("long")

    made = [
        F.struct(
            F.lit(section).alias("s"),
            place(where[0] if where else 0).alias("a"),
            place(where[1] if len(where) > 1 else 0).alias("b"),
            text.alias("fragment"),
        )
        for section, text, *where in pieces
    ]
    if len(made) == 1:
        return df.select("doc_id", made[0].alias("f")).select("doc_id", "f.*")
    return df.select("doc_id", F.explode(F.array(*made)).alias("f")).select("doc_id", "f.*")


def _united(*parts: DataFrame) -> DataFrame:
    whole, *rest = parts
    for part in rest:
        whole = whole.unionByName(part)
    return whole


# Plain text -------------------------------------------------------------------------------


def export_text(pages: DataFrame, lines: DataFrame, limit: int = GROUP_ROWS) -> DataFrame:
    """Texts by y, then x, one per line; pages without text give an empty file."""
    packed = Ordered(with_text(lines), ["doc_id"], ["y", "x", "line_id"], limit).collected(
        F.col("text"), "texts"
    )
    files = pages.select("doc_id", file_name(F.col("name"), ".txt").alias("file_name"))
    joined = files.join(packed, "doc_id", "left")
    return joined.select(
        "doc_id",
        "file_name",
        F.coalesce("part", F.lit(0)).alias("part"),
        F.coalesce(F.array_join("texts", "\n"), F.lit("")).alias("content"),
    )


def write_files(exported: DataFrame, path: str) -> None:
    """One folder per page file; parts of an oversized page stay in order by name."""
    (
        exported.select("file_name", "part", "content")
        .write.mode("overwrite")
        .partitionBy("file_name", "part")
        .text(path)
    )


# JSON -------------------------------------------------------------------------------------


def _line_json(polygon: Column | None) -> Column:
    corner = F.struct("x", "y", "w", "h").alias("bbox")
    fields = [F.col("text"), F.col("confidence"), corner]
    if polygon is not None:
        fields.append(polygon.alias("polygon"))
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def export_json(
    pages: DataFrame, groups: DataFrame, lines: DataFrame, limit: int = GROUP_ROWS
) -> DataFrame:
    """Name, groups with their lines, and all lines; complete lines in their own order."""
    done = lines.where("complete")
    polygon = F.col("polygon") if "polygon" in lines.columns else F.lit(None).cast("string")
    name = json_or_null(json_string(F.col("name")))
    head = _template('{"name":{name},"groups":[', name=name)
    rect = F.when(
        F.col("rx").isNotNull(),
        F.to_json(F.expr("struct(rx AS x, ry AS y, rw AS w, rh AS h)")),
    ).otherwise("null")
    group_head = _template('{"name":{name},"rect":{rect},"lines":[', name=name, rect=rect)
    members = done.join(groups, ["doc_id", "group_pos"], "left_semi")
    fragments = _united(
        _fragments(pages, (0, head), (2, F.lit('],"lines":[')), (4, F.lit("]}"))),
        _fragments(
            groups, (1, group_head, "group_pos", FIRST), (1, F.lit("]}"), "group_pos", LAST)
        ),
        _fragments(members, (1, _line_json(None), "group_pos", "line_pos")),
        _fragments(done, (3, _line_json(polygon), "line_id")),
    )
    keys = lines.select("doc_id").unionAll(groups.select("doc_id"))
    # A line adds at most two fragments and a group two.
    small = not has_large_group(keys, ["doc_id"], limit // 4)
    ordered = Ordered(fragments, ["doc_id"], ["s", "a", "b"], limit, small or None)
    # A comma goes before every line and group, unless it is the first in its list.
    ordered.neighbour("_s", F.col("s"), -1).neighbour("_b", F.col("b"), -1)
    starts_item = (F.col("s") == 3) | ((F.col("s") == 1) & (F.col("b") != LAST))
    in_group = (F.col("s") == 1) & (F.col("b") != FIRST)
    after_item = (F.col("_s") == F.col("s")) & ~(in_group & (F.col("_b") == FIRST))
    comma = F.concat(F.lit(","), "fragment")
    ordered.with_columns(
        {"fragment": F.when(starts_item & after_item, comma).otherwise(F.col("fragment"))}
    )
    packed = ordered.collected(F.col("fragment"), "pieces")
    files = pages.select("doc_id", file_name(F.col("name"), ".json").alias("file_name"))
    return packed.join(files, "doc_id").select(
        "doc_id", "file_name", "part", F.array_join("pieces", "").alias("content")
    )


# ALTO -------------------------------------------------------------------------------------


def alto_words(lines: DataFrame) -> DataFrame:
    """Words of each exported line with estimated places: equal widths from the line's left."""
    # All that is the same for the words of a line is made before the line is cut.
    cut = with_text(lines).select(
        "doc_id",
        "line_id",
        half_up(F.col("x")).alias("_left"),
        half_up(F.col("y")).alias("vpos"),
        half_up(F.col("h")).alias("height"),
        three_digits(F.col("confidence")).alias("wc"),
        "w",
        words(F.col("text")).alias("_words"),
    )
    rows = cut.withColumn("width", half_up(F.try_divide("w", F.size("_words"))))
    flat = rows.select("*", F.posexplode("_words").alias("word_no", "word"))
    return flat.select(
        "doc_id",
        "line_id",
        "word_no",
        "word",
        (F.col("_left") + F.col("word_no") * F.col("width")).alias("hpos"),
        "vpos",
        "width",
        "height",
        "wc",
    )


def _alto_texts(items: Column, first: Column) -> Column:
    """The elements of lines (structs in order, numbered from `first`). Text is escaped before it is cut and all that is
    equal for the words of a line is made once, so a word costs one concat."""

    def cut(line: Column) -> Column:
        return F.struct(line.alias("l"), words(xml_escaped(line["text"])).alias("words"))

    def parts(item: Column, at: Column) -> Column:
        line, i = item["l"], first + at
        box = {c: half_up(line[c]) for c in ("x", "y", "w", "h")}
        width = half_up(F.try_divide(line["w"], F.size(item["words"])))
        end = _template(
            '" VPOS="{y}" WIDTH="{width}" HEIGHT="{h}" WC="{wc}"/>',
            y=box["y"],
            width=width,
            h=box["h"],
            wc=three_digits(line["confidence"]),
        )
        head = _template(
            '<TextLine ID="line_{i}" HPOS="{x}" VPOS="{y}" WIDTH="{w}" HEIGHT="{h}">\n',
            i=i,
            **box,
        )
        return F.struct(
            item["words"].alias("words"),
            box["x"].alias("left"),
            width.alias("width"),
            _template('<String ID="string_{i}_', i=i).alias("start"),
            end.alias("end"),
            head.alias("head"),
        )

    def text(part: Column) -> Column:
        def word(item: Column, at: Column) -> Column:
            hpos = part["left"] + at * part["width"]
            content, place = F.lit('" CONTENT="'), F.lit('" HPOS="')
            return F.concat(part["start"], at.cast("string"), content, item, place, hpos.cast("string"), part["end"])

        strings = F.array_join(F.transform(part["words"], word), "\n")
        return F.concat(part["head"], F.coalesce(strings, F.lit("")), F.lit("\n</TextLine>"))

    return F.transform(F.transform(F.transform(items, cut), parts), text)


def export_alto(
    pages: DataFrame,
    lines: DataFrame,
    created: str,
    software: str = SOFTWARE,
    limit: int = GROUP_ROWS,
) -> DataFrame:
    """ALTO 4.4. The page width is the right edge of the first line and the height the bottom
    of the last one, 0 without lines."""

    def build(small, pages, lines):
        return _alto(pages, lines, created, software, limit, small)

    return _by_size(build, limit, pages, lines)


def _alto(pages, lines, created, software, limit, small) -> DataFrame:
    order = ["y", "x", "line_id"]
    line = F.struct(*order, "w", "h", "text", "confidence")
    right, bottom = lambda i: i["x"] + i["w"], lambda i: i["y"] + i["h"]
    if small:
        # Only the lines as they are move and are put in order; their elements are made on the finished page.
        packed = with_text(lines).groupBy("doc_id").agg(F.array_sort(F.collect_list(line)).alias("_items"))
        heads = pages.join(packed, "doc_id", "left")
        last = F.get("_items", F.size("_items") - 1)
        heads = heads.withColumns({"_right": right(F.get("_items", F.lit(0))), "_bottom": bottom(last)})
    else:
        numbered = ordinal(with_text(lines), ["doc_id"], order, "_n", limit)
        numbered = numbered.withColumns({"_i": F.col("_n") - 1, "_item": line})
        built = numbered.withColumn("_line", F.get(_alto_texts(F.array("_item"), F.col("_i")), F.lit(0)))
        ends = [
            F.min_by(right(F.col("_item")), "_i").alias("_right"),
            F.max_by(bottom(F.col("_item")), "_i").alias("_bottom"),
        ]
        heads = pages.join(numbered.groupBy("doc_id").agg(*ends), "doc_id", "left")
    size = lambda c: F.coalesce(half_up(F.col(c)), F.lit(0).cast("long"))
    head = _template(
        "\n".join(
            [
                PROLOG,
                f'<alto xmlns="{ALTO_SPACE}" xmlns:xsi="{XSI}"'
                f' xsi:schemaLocation="{ALTO_SPACE} {ALTO_SCHEMA}">',
                "<Description><MeasurementUnit>pixel</MeasurementUnit>",
                "<sourceImageInformation><fileName>{name}</fileName></sourceImageInformation>",
                f'<Processing ID="proc_0"><processingDateTime>{created}</processingDateTime>',
                f"<processingSoftware><softwareName>{software}</softwareName></processingSoftware>",
                "</Processing></Description>",
                '<Layout><Page ID="page_0" PHYSICAL_IMG_NR="0" WIDTH="{right}" HEIGHT="{bottom}">',
                '<PrintSpace><TextBlock ID="block_0">',
            ]
        ),
        name=xml_escaped(F.col("name")),
        right=size("_right"),
        bottom=size("_bottom"),
    )
    foot = "</TextBlock></PrintSpace></Page></Layout></alto>"
    name = file_name(F.col("name"), "_alto.xml").alias("file_name")
    if small:
        body = F.array_join(_alto_texts(F.col("_items"), F.lit(0).cast("long")), "\n")
        content = F.concat_ws("\n", head, body, F.lit(foot))
        return heads.select("doc_id", name, F.lit(0).alias("part"), content.alias("content"))
    fragments = _united(
        _fragments(heads, (0, head), (2, F.lit(foot))),
        _fragments(built, (1, F.col("_line"), "_i")),
    )
    return pages.select("doc_id", name).join(_assembled(fragments, "\n", limit), "doc_id")


# PAGE -------------------------------------------------------------------------------------


def _region_lines(groups: DataFrame, lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Kept lines with the region they go to, and the regions with their boxes.

    Lines outside every group are lost when the page has any region; a page without one
    takes all its lines as a single region (group_pos null).
    """
    kept = with_text(lines)
    members = kept.join(groups.select("doc_id", "group_pos"), ["doc_id", "group_pos"])
    bare = kept.join(members.select("doc_id").distinct(), "doc_id", "left_anti")
    region_lines = members.select(
        "doc_id", "group_pos", F.lit(0.0).alias("k1"), F.lit(0.0).alias("k2"),
        F.col("line_pos").cast("long").alias("k3"), "line_id", "x", "y", "w", "h", "text", "confidence",
    ).unionByName(
        bare.select(
            "doc_id", F.lit(-1).alias("group_pos"), F.col("y").alias("k1"), F.col("x").alias("k2"),
            F.lit(0).cast("long").alias("k3"), "line_id", "x", "y", "w", "h", "text", "confidence",
        )
    )
    bounds = bounding_box(region_lines, ["doc_id", "group_pos"])
    boxed = bounds.join(
        groups.select("doc_id", "group_pos", "rx", "ry", "rw", "rh"), ["doc_id", "group_pos"], "left"
    )
    has_box = F.col("rx").isNotNull()
    regions = boxed.select(
        "doc_id",
        "group_pos",
        *[F.when(has_box, F.col("r" + c)).otherwise(F.col(c)).alias(c) for c in ("x", "y", "w", "h")],
    )
    return region_lines, regions


def _regions_by_page(groups: DataFrame, lines: DataFrame) -> DataFrame:
    """As `page_regions` for pages of ordinary size, lines and region boxes side by side.
    All windows share the partitioning by page: one shuffle for everything."""
    held = groups.select("doc_id", "group_pos", "rx", "ry", "rw", "rh", F.lit(True).alias("_in"))
    kept = with_text(lines).join(held, ["doc_id", "group_pos"], "left")
    page = Window.partitionBy("doc_id")
    inside = F.coalesce("_in", F.lit(False))
    kept = kept.withColumns({"_in": inside, "_any": F.max(inside).over(page)})
    kept = kept.where("_in OR NOT _any").withColumns(
        {
            "group_pos": F.when(F.col("_in"), F.col("group_pos")).otherwise(-1),
            "_k1": F.when(~F.col("_in"), F.col("y")),
            "_k2": F.when(~F.col("_in"), F.col("x")),
            "_k3": F.when(F.col("_in"), F.col("line_pos")),
        }
    )
    region = Window.partitionBy("doc_id", "group_pos")
    order = region.orderBy("_k1", "_k2", "_k3", "line_id")
    right, bottom = F.col("x") + F.col("w"), F.col("y") + F.col("h")
    has_box = F.col("rx").isNotNull()
    bound = {
        "x": F.min("x").over(region),
        "y": F.min("y").over(region),
        "w": F.max(right).over(region) - F.min("x").over(region),
        "h": F.max(bottom).over(region) - F.min("y").over(region),
    }
    return kept.withColumns(
        {
            "line_no": (F.row_number().over(order) - 1).cast("long"),
            "n_lines": F.count(F.lit(1)).over(region),
            "region": (F.dense_rank().over(page.orderBy("group_pos")) - 1).cast("long"),
            **{
                "region_" + c: F.when(has_box, F.col("r" + c)).otherwise(value)
                for c, value in bound.items()
            },
        }
    )


def page_regions(
    groups: DataFrame, lines: DataFrame, limit: int = GROUP_ROWS
) -> tuple[DataFrame, DataFrame]:
    """Regions (doc_id, region, box) and their lines (doc_id, region, line_no, ...)."""
    large = large_groups(lines, ["doc_id"], limit)
    if large is not None:
        lines, many_lines = divided(lines, large, ["doc_id"])
        groups, many_groups = divided(groups, large, ["doc_id"])
    placed = _regions_by_page(groups, lines)
    box = [F.col("region_" + c).alias(c) for c in ("x", "y", "w", "h")]
    regions = placed.where("line_no = 0").select("doc_id", "group_pos", "region", *box)
    kept = ["doc_id", "group_pos", "line_id", "x", "y", "w", "h", "text", "confidence"]
    placed = placed.select(*kept, "line_no", "region")
    if large is None:
        return regions, placed
    more_regions, more = _regions_spread(many_groups, many_lines, limit)
    return regions.unionByName(more_regions.select(*regions.columns)), placed.unionByName(more)


def _regions_spread(groups, lines, limit) -> tuple[DataFrame, DataFrame]:
    region_lines, regions = _region_lines(groups, lines)
    indexed = ordinal(regions, ["doc_id"], ["group_pos"], "_n", limit)
    indexed = indexed.withColumn("region", F.col("_n") - 1).drop("_n")
    order = ["k1", "k2", "k3", "line_id"]
    numbered = ordinal(region_lines, ["doc_id", "group_pos"], order, "_n", limit)
    numbered = numbered.withColumn("line_no", F.col("_n") - 1)
    placed = numbered.join(
        indexed.select("doc_id", "group_pos", "region"), ["doc_id", "group_pos"]
    ).drop("_n", "k1", "k2", "k3")
    return indexed, placed


def corners(x: Column, y: Column, w: Column, h: Column) -> Column:
    left, top, right, bottom = half_up(x), half_up(y), half_up(x + w), half_up(y + h)
    return _template(
        "{l},{t} {r},{t} {r},{b} {l},{b}", l=left, t=top, r=right, b=bottom
    )


def export_page(
    pages: DataFrame,
    groups: DataFrame,
    lines: DataFrame,
    created: str,
    software: str = SOFTWARE,
    limit: int = GROUP_ROWS,
) -> DataFrame:
    """PAGE XML 2019 with reading order."""

    def build(small, pages, lines, groups):
        return _page(pages, groups, lines, created, software, limit, small)

    return _by_size(build, limit, pages, lines, groups)


def _page(pages, groups, lines, created, software, limit, small) -> DataFrame:
    if small:
        placed = _regions_by_page(groups, lines)
    else:
        regions, placed = _regions_spread(groups, lines, limit)
        if "polygon" in lines.columns:
            shapes = lines.select("doc_id", "line_id", "polygon")
            placed = placed.join(shapes, ["doc_id", "line_id"])
    box = [F.col(c) for c in ("x", "y", "w", "h")]
    points = corners(*box)
    if "polygon" in lines.columns:
        outline = F.transform(
            "polygon", lambda p: F.concat_ws(",", half_up(p["x"]).cast("string"), half_up(p["y"]).cast("string"))
        )
        points = F.coalesce(F.array_join(outline, " "), points)
    line = _template(
        '<TextLine id="line_r{r}_l{l}" custom="readingOrder {index:{l};}">\n'
        '<Coords points="{points}"/>\n'
        '<TextEquiv conf="{conf}"><Unicode>{text}</Unicode></TextEquiv>\n</TextLine>',
        r=F.col("region"),
        l=F.col("line_no"),
        points=points,
        conf=three_digits(F.col("confidence")),
        text=xml_escaped(F.col("text")),
    )
    region_box = [F.col("region_" + c) for c in ("x", "y", "w", "h")] if small else box
    opening = _template(
        '<TextRegion id="region_{r}" custom="readingOrder {index:{r};}">\n'
        '<Coords points="{points}"/>',
        r=F.col("region"),
        points=corners(*region_box),
    )
    head = _template(
        "\n".join(
            [
                PROLOG,
                f'<PcGts xmlns="{PAGE_SPACE}" xmlns:xsi="{XSI}"'
                f' xsi:schemaLocation="{PAGE_SPACE} {PAGE_SPACE}/pagecontent.xsd">',
                f"<Metadata><Creator>{software}</Creator><Created>{created}</Created></Metadata>",
                '<Page imageFilename="{name}">',
                '<ReadingOrder><OrderedGroup id="reading_order">',
            ]
        ),
        name=xml_escaped(F.col("name")),
    )
    reference = _template(
        '<RegionRefIndexed index="{r}" regionRef="region_{r}"/>', r=F.col("region")
    )
    middle, foot = F.lit("</OrderedGroup></ReadingOrder>"), F.lit("</Page></PcGts>")
    name = file_name(F.col("name"), "_page.xml").alias("file_name")
    closing = F.lit("</TextRegion>")
    if small:
        first, last = F.col("line_no") == 0, F.col("line_no") + 1 == F.col("n_lines")
        text = F.concat_ws("\n", F.when(first, opening), line, F.when(last, closing))
        made = placed.select(
            "doc_id", "region", "line_no", text.alias("_text"), F.when(first, reference).alias("_ref")
        )
        item = F.struct("region", "line_no", "_text", "_ref")
        bodies = made.groupBy("doc_id").agg(F.array_sort(F.collect_list(item)).alias("_items"))
        joined = pages.join(bodies, "doc_id", "left")
        # array_join leaves nulls out, so only first lines add a reference.
        references = F.array_join(F.transform("_items", lambda i: i["_ref"]), "\n")
        body = F.array_join(F.transform("_items", lambda i: i["_text"]), "\n")
        content = F.concat_ws("\n", head, references, middle, body, foot)
        return joined.select("doc_id", name, F.lit(0).alias("part"), content.alias("content"))
    fragments = _united(
        _fragments(pages, (0, head), (2, middle), (4, foot)),
        _fragments(
            regions,
            (1, reference, "region"),
            (3, opening, "region", FIRST),
            (3, closing, "region", LAST),
        ),
        _fragments(placed, (3, line, "region", "line_no")),
    )
    return pages.select("doc_id", name).join(_assembled(fragments, "\n", limit), "doc_id")
