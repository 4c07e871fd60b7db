"""One query per operator, over the whole of the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafscribe.functions.boxes import box, in_polygon
from leafscribe.functions.numbers import half_up
from leafscribe.functions.text import not_blank
from leafscribe.operators import catalog as C
from leafscribe.operators import events as E
from leafscribe.operators import geometry as G
from leafscribe.operators import tokens as T
from leafscribe.operators import workspace as W
from leafscribe.operators.fusion import fused
from leafscribe.operators.masks import TILE
from leafscribe.operators.scale import GROUP_ROWS, Ordered, lookup
from leafscribe.operators.search import MODES, search_catalog
from leafscribe.operators.search import open_records as search_open_records
from leafscribe.operators.suppression import nms
from leafscribe.operators.vectors import vector_search_batch
from leafscribe.plans.page_transcription import crop_lines, regions_of, saved_pages, transcribe_pages
from leafscribe.session import pin
from leafscribe.sinks import exports as X
from leafscribe.sources import store as S
from leafscribe.sources import volumes as V
from leafscribe.sources.views import Views

# Parameters shared with the SQL checks.
IMAGE_BASE = "https://images.example"
DOC_QUERY = "the les und"
RECORD_QUERY = "the les"
LINE_QUERY = "an"
SEED = 7
TOP = 10
PAGE_SIZE = 20
SEARCH_YEARS = (1650, 1850)
CREATED = "2024-01-01T00:00:00.000Z"
CROP_WIDTH, CROP_HEIGHT = 400.0, 150.0
BURST = 7200.0
#: Rows and columns of the prototypes that are derived for line crops.
MASK_CELLS = 32


def query_vectors(size: int = 64) -> dict[str, list[float]]:
    return {
        f"q{j}": [float((i * (2 * j + 3) + j) % 7 - 3) for i in range(size)] for j in range(3)
    }


def r6(name: str) -> Column:
    return F.round(name, 6).alias(name)


QUERIES: dict[str, Callable[[Views], DataFrame]] = {}


def query(fn: Callable[[Views], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


# Sources ----------------------------------------------------------------------------------


@query
def image_scan(v: Views) -> DataFrame:
    return V.image_upload(v.fetches(), "page_id").drop("status")


@query
def harvest_resolve(v: Views) -> DataFrame:
    return V.resolve_harvest(v.harvest()).select("page_id", "manifest_id", "error")


@query
def manifest_page_count(v: Views) -> DataFrame:
    return v.manifests().select(
        "manifest_id", V.page_count(F.col("manifest")).cast("int").alias("n_pages")
    )


def _expanded(v: Views) -> DataFrame:
    return V.expand_pages(
        v.manifests(), V.page_count(F.col("manifest")), F.col("req_start"), F.col("req_end")
    )


@query
def page_urls(v: Views) -> DataFrame:
    pages = V.expand_pages(v.manifests(), V.page_count(F.col("manifest"))).where("error IS NULL")
    # Numbers above 99 999 stay whole.
    number = F.col("page_number") + F.when(F.col("page_id") % 5 == 0, 99_990).otherwise(0)
    return pages.select(
        "manifest_id",
        "page_number",
        V.page_url(IMAGE_BASE, F.col("manifest_id"), number).alias("url"),
        V.page_name(F.col("manifest_id"), number).alias("name"),
    )


@query
def valid_fetches(v: Views) -> DataFrame:
    return V.valid_fetches(v.fetches())


@query
def expand_pages(v: Views) -> DataFrame:
    return _expanded(v).select("manifest_id", "page_number", "error")


@query
def route_sources(v: Views) -> DataFrame:
    code = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit(" "), "expected_id", F.lit(" ")))
    code = code.otherwise(F.concat(F.lit("SE/"), F.col("page_id").cast("string"))).alias("code")
    resolved = V.resolve_harvest(v.harvest()).select(
        F.concat(F.lit("SE/"), F.col("page_id").cast("string")).alias("code"), "manifest_id", "error"
    )
    routed = V.route_sources(v.harvest().select(code), resolved)
    counts = v.manifests().select("manifest_id", V.page_count(F.col("manifest")).alias("n"))
    return routed.join(counts, "manifest_id", "left").select(
        "code", "manifest_id", "error", F.col("n").cast("int").alias("n_pages")
    )


def _saved(v: Views) -> DataFrame:
    lines = v.numbered_lines()
    rows = S.serialize_for_save(lines, v.groups(lines))
    moment = "timestampadd(SECOND, CAST(doc_id*60+line_index AS INT), TIMESTAMP'2024-01-01 00:00:00')"
    return rows.withColumns(
        {"reference_code": F.concat(F.lit("SE/"), "manifest_id"), "saved_at": F.expr(moment)}
    )


@query
def read_transcriptions(v: Views) -> DataFrame:
    groups = S.read_transcriptions(_saved(v), LINE_QUERY)
    return groups.select(
        "manifest_id",
        "page_number",
        "group_pos",
        "group_name",
        "part",
        F.size("lines").alias("n_lines"),
        F.array_join(F.transform("lines", lambda i: i["text"]), "\n").alias("texts"),
    )


@query
def list_saved(v: Views) -> DataFrame:
    return S.list_saved(_saved(v)).withColumn(
        "last_saved", F.date_format("last_saved", "yyyy-MM-dd HH:mm:ss")
    )


# Sinks ------------------------------------------------------------------------------------


@query
def serialize_for_save(v: Views) -> DataFrame:
    lines = v.numbered_lines()
    return S.serialize_for_save(lines, v.groups(lines))


@query
def changed_volumes(v: Views) -> DataFrame:
    lines = v.numbered_lines()
    groups = v.groups(lines)
    # The later snapshot: volumes with an even number have edited texts.
    even = F.col("manifest_id").rlike("[02468]$") & (F.col("doc_id") % 3 == 0)
    even = even & not_blank(F.col("text"))
    edited = lines.withColumn(
        "text", F.when(even, F.concat("text", F.lit(" (edited)"))).otherwise(F.col("text"))
    )
    saved = S.digests(S.serialize_for_save(lines, groups))
    changed = S.changed_volumes(S.serialize_for_save(edited, groups), saved)
    return changed.select("manifest_id", "n_lines")


@query
def delete_volumes(v: Views) -> DataFrame:
    listed = v.pages().where(F.col("manifest_id").rlike("[25]$")).select("manifest_id").distinct()
    return S.delete_volumes(v.lines(), listed).select("manifest_id", "doc_id", "line_id")


@query
def export_text(v: Views) -> DataFrame:
    return X.export_text(v.pages(), v.lines())


@query
def export_json(v: Views) -> DataFrame:
    lines = v.lines()
    return X.export_json(v.pages(), v.groups(lines), lines)


@query
def alto_words(v: Views) -> DataFrame:
    return X.alto_words(v.lines())


@query
def export_alto(v: Views) -> DataFrame:
    return X.export_alto(v.pages(), v.lines(), CREATED)


@query
def page_regions(v: Views) -> DataFrame:
    lines = v.lines()
    regions, placed = X.page_regions(v.groups(lines), lines)
    counts = placed.groupBy("doc_id", "region").agg(
        F.count(F.lit(1)).alias("n_lines"), F.min_by("line_id", "line_no").alias("first_line")
    )
    return regions.drop("group_pos").join(counts, ["doc_id", "region"])


@query
def export_page(v: Views) -> DataFrame:
    lines = v.lines()
    return X.export_page(v.pages(), v.groups(lines), lines, CREATED)


# Catalog ----------------------------------------------------------------------------------


@query
def catalog_filter(v: Views) -> DataFrame:
    found = C.catalog_filter(v.catalog(), date_start=1650, date_end=1800, archive="src3")
    return found.select("reference_code", "archive_code", "year_start")


@query
def catalog_index(v: Views) -> DataFrame:
    return v.text_index("documents").vocabulary()


@query
def catalog_fts(v: Views) -> DataFrame:
    best = v.text_index("documents").top(DOC_QUERY, TOP)
    return best.select(F.col("key").alias("doc_id"), r6("score"))


@query
def catalog_vector(v: Views) -> DataFrame:
    return C.vector_search(v.embeddings(), query_vectors(), TOP).select(
        "query", "rank", "vec_id", r6("score")
    )


@query
def catalog_vector_batch(v: Views) -> DataFrame:
    asked = v.embeddings().where("vec_id % 50 = 0")
    asked = asked.select(F.col("vec_id").cast("string").alias("query"), F.col("embedding").alias("vector"))
    return vector_search_batch(v.embeddings(), asked, TOP).select("query", "rank", "vec_id", r6("score"))


@query
def catalog_hybrid(v: Views) -> DataFrame:
    texts = v.text_index("documents").search(DOC_QUERY).withColumnRenamed("key", "doc_id")
    vectors = v.embeddings().select(
        F.col("vec_id").alias("doc_id"),
        C.cosine(F.col("embedding"), query_vectors()["q0"]).alias("score"),
    )
    return fused(texts, vectors, "doc_id", TOP).select("doc_id", "text_rank", "vector_rank", r6("score"))


def _record_hits(v: Views) -> DataFrame:
    return v.text_index("catalog").search(RECORD_QUERY).withColumnRenamed("key", "reference_code")


def _searched(v: Views, mode: str, **parameters) -> DataFrame:
    codes = v.catalog().select("doc_id", "reference_code")
    vectors = v.embeddings().join(codes, F.col("vec_id") == F.col("doc_id")).select("reference_code", "embedding")
    return search_catalog(
        v.catalog(), v.text_index("catalog"), vectors, RECORD_QUERY, query_vectors()["q0"], mode, **parameters
    )


@query
def catalog_search(v: Views) -> DataFrame:
    page = {"date_start": SEARCH_YEARS[0], "date_end": SEARCH_YEARS[1], "limit": PAGE_SIZE, "offset": PAGE_SIZE // 2}
    found = [_searched(v, mode, **page).withColumn("mode", F.lit(mode)) for mode in MODES]
    return found[0].unionByName(found[1]).unionByName(found[2]).select(
        "mode", "position", "reference_code", "archive_code", "date_text", r6("score"), "total"
    )


@query
def open_records(v: Views) -> DataFrame:
    # Every match, not a page of the result.
    found = _record_hits(v).select("reference_code")
    codes = v.catalog().select("doc_id", F.col("reference_code").alias("code"))
    harvest = V.resolve_harvest(v.harvest()).join(codes, F.col("page_id") == F.col("doc_id"))
    counts = v.manifests().select("manifest_id", V.page_count(F.col("manifest")).alias("n_pages"))
    known = counts.where("n_pages > 4").select("manifest_id", F.lit(3).alias("page_number"))
    return search_open_records(found, harvest.select("code", "manifest_id", "error"), counts, known)


@query
def catalog_page(v: Views) -> DataFrame:
    page = C.result_page(_record_hits(v), "reference_code", PAGE_SIZE, 2 * PAGE_SIZE)
    return page.select("reference_code", r6("score"), "total")


@query
def catalog_append(v: Views) -> DataFrame:
    hits = _record_hits(v)
    held = C.result_page(hits, "reference_code", PAGE_SIZE)
    both = C.append_page(held, hits, "reference_code", PAGE_SIZE)
    return both.select("reference_code", r6("score"), "has_more")


@query
def catalog_tree(v: Views) -> DataFrame:
    return C.catalog_tree(v.catalog(), "doc_id")


@query
def catalog_counts(v: Views) -> DataFrame:
    return C.catalog_counts(v.catalog())


@query
def highlight(v: Views) -> DataFrame:
    found = v.documents().select("doc_id", C.highlight(F.col("text"), " The ").alias("h"))
    return found.select("doc_id", "h.*")


@query
def random_volume(v: Views) -> DataFrame:
    n_pages = F.col("doc_id") % 12
    return C.random_volume(v.catalog(), SEED, n_pages).select("reference_code", "page_number")


@query
def catalog_titles(v: Views) -> DataFrame:
    return C.titles(v.catalog())


@query
def volume_metadata(v: Views) -> DataFrame:
    loads = v.catalog().withColumn("manifest_id", F.col("archive_code"))
    newest = C.latest_metadata(loads, "doc_id", ["reference_code", "date_text"])
    pages = v.pages().select("doc_id", "manifest_id")
    return C.with_metadata(pages, newest).select(
        "doc_id", "manifest_id", "reference_code", "date_text"
    )


# Detections and geometry ------------------------------------------------------------------


@query
def decode_regions(v: Views) -> DataFrame:
    boxes = G.decode_regions(v.anchors_out(), resize_scale=0.5)
    return boxes.select("image_id", "anchor_idx", r6("score"), "x", "y", "w", "h")


def _shifted_boxes(v: Views) -> DataFrame:
    return v.detections().withColumns({"x": F.col("x") - 60.5, "y": F.col("y") - 45})


@query
def region_boxes(v: Views) -> DataFrame:
    placed = G.reading_order(G.region_shape(_shifted_boxes(v)), "image_id", "det_id")
    return placed.select("image_id", "det_id", "label", "x", r6("y"), r6("w"), "h", "position")


@query
def decode_lines(v: Views) -> DataFrame:
    boxes = G.decode_lines(v.centre_boxes())
    return boxes.select(
        "image_id", "det_id", "class_id", "score", *[r6(c) for c in ("x", "y", "w", "h")]
    )


@query
def pairwise_iou(v: Views) -> DataFrame:
    return G.iou_with_best(v.detections()).select("image_id", "det_id", "best_det_id", r6("iou"))


@query
def nms_boxes(v: Views) -> DataFrame:
    kept = nms(v.detections(), min_score=G.LINE_SCORE)
    return kept.select("image_id", "det_id", "score", "x", r6("y"), r6("w"), "h")


QUERIES["nms"] = QUERIES.pop("nms_boxes")


@query
def mask_contour(v: Views) -> DataFrame:
    return G.mask_contour(v.mask_logits())


@query
def simplify_polygons(v: Views) -> DataFrame:
    simple = G.simplify_polygons(v.polygons())
    points = simple.select("image_id", "det_id", F.posexplode("polygon").alias("point_no", "p"))
    return points.select(
        "image_id",
        "det_id",
        "point_no",
        F.round("p.x", 6).alias("px"),
        F.round("p.y", 6).alias("py"),
    )


@query
def reading_order(v: Views) -> DataFrame:
    return G.reading_order(v.lines()).select("doc_id", "line_id", "position")


@query
def start_index(v: Views) -> DataFrame:
    lines = v.lines().select(
        F.col("doc_id").alias("image_id"),
        F.coalesce("group_pos", F.lit(-1)).alias("region_id"),
    )
    return G.start_index(lines)


@query
def crop_clamp(v: Views) -> DataFrame:
    crops = G.crop_clamp(_shifted_boxes(v), CROP_WIDTH, CROP_HEIGHT)
    return crops.select("image_id", "det_id", "cx", "cy", "cw", "ch")


@query
def padded_crop(v: Views) -> DataFrame:
    crops = G.padded_crop(_shifted_boxes(v), CROP_WIDTH, CROP_HEIGHT, G.PREVIEW_PAD)
    return crops.select("image_id", "det_id", *[r6(c) for c in ("px", "py", "pw", "ph")])


@query
def to_page_coords(v: Views) -> DataFrame:
    lines = v.polygons().withColumn("region_id", F.col("det_id") % 4)
    regions = lines.groupBy("image_id", "region_id").agg(
        F.floor(F.min("x")).alias("cx"), F.floor(F.min("y")).alias("cy")
    )
    moved = G.to_page_coords(lines, regions)
    points = moved.select(
        "image_id", "det_id", "x", r6("y"), F.posexplode("polygon").alias("point_no", "p")
    )
    return points.select(
        "image_id",
        "det_id",
        "x",
        "y",
        "point_no",
        F.round("p.x", 6).alias("px"),
        F.round("p.y", 6).alias("py"),
    )


@query
def letterbox(v: Views) -> DataFrame:
    sizes = v.detections().select(
        "image_id", "det_id", (F.col("w") * 10).alias("width"), (F.col("x") + 300).alias("height")
    )
    fitted = G.letterbox(sizes)
    return fitted.select(
        "image_id", "det_id", r6("scale"), "new_w", "new_h", r6("pad_x"), r6("pad_y")
    )


@query
def point_in_polygon(v: Views) -> DataFrame:
    px = F.col("x") + F.col("w") * (F.col("det_id") % 5) / 4
    py = F.col("y") + F.col("h") * (F.col("det_id") % 7) / 6
    return v.polygons().select(
        "image_id", "det_id", in_polygon(px, py, F.col("polygon")).alias("inside")
    )


@query
def hit_test(v: Views) -> DataFrame:
    return G.hit_test(v.points(), v.lines().select("doc_id", "line_id", "x", "y", "w", "h"))


@query
def lines_in_rect(v: Views) -> DataFrame:
    return G.lines_in_rect(v.rectangles(), v.lines())


@query
def group_bbox(v: Views) -> DataFrame:
    return G.bounding_box(v.lines().where("group_pos IS NOT NULL"), ["doc_id", "group_pos"])


# Tokens and scoring -----------------------------------------------------------------------


def _tokens(v: Views) -> DataFrame:
    words = v.token_words()
    known = v.vocabulary().withColumnRenamed("id", "token_id")
    return lookup(words, known, ["word"], "inner").select("seq_id", "pos", "token_id", "word")


@query
def banned_next(v: Views) -> DataFrame:
    return T.banned_next(_tokens(v).select("seq_id", "pos", "token_id"))


@query
def greedy_pick(v: Views) -> DataFrame:
    bans = v.embeddings().select(
        F.col("vec_id").alias("seq_id"),
        F.explode(F.array_distinct(F.array(F.lit(1), (F.col("vec_id") * 7 % 64).cast("int")))).alias(
            "token_id"
        ),
    )
    return T.greedy_pick(v.logits(), bans).select("seq_id", "token_id", r6("score"))


@query
def eos_cut(v: Views) -> DataFrame:
    ended = _tokens(v).withColumn(
        "token_id",
        F.when((F.col("seq_id") + F.col("pos")) % 97 == 96, T.END).otherwise(F.col("token_id")),
    )
    return T.eos_cut(ended.select("seq_id", "pos", "token_id"))


@query
def vocab_load(v: Views) -> DataFrame:
    entry = F.struct(
        F.struct(F.create_map("word", "id").alias("vocab")).alias("model"),
        F.when(
            F.col("id") % 10 == 0,
            F.array(F.struct("id", F.concat("word", F.lit("!")).alias("content"))),
        ).alias("added_tokens"),
    )
    return T.vocab_load(v.vocabulary().select(F.to_json(entry).alias("json")))


@query
def detokenise(v: Views) -> DataFrame:
    vocab = v.vocabulary().select(
        "id", T.to_byte_alphabet(F.concat(F.lit(" "), "word")).alias("token")
    )
    return T.detokenise(_tokens(v), vocab)


@query
def decode_tokens(v: Views) -> DataFrame:
    vocab = v.vocabulary().select(
        "id", T.to_byte_alphabet(F.concat(F.lit(" "), "word")).alias("token")
    )
    found = T.decode_tokens(_tokens(v).select("seq_id", "pos", "token_id"), vocab)
    return found.select("seq_id", "pos", "text")


def _timed(v: Views) -> DataFrame:
    return v.events().where("type = 'line_done'").select(
        "seq",
        F.col("region_id").alias("worker"),
        F.col("line_id").alias("tokens"),
        (F.col("value") / 4).alias("encoder_ms"),
        F.col("value").alias("decoder_ms"),
    )


@query
def decode_timing(v: Views) -> DataFrame:
    return T.decode_timing(_timed(v)).select(
        "seq", "worker", "tokens", r6("ms_per_token"), r6("total_ms")
    )


@query
def timing_by_worker(v: Views) -> DataFrame:
    return T.timing_by_worker(_timed(v)).select(
        "worker", "lines", "tokens", *[r6(c) for c in ("avg_ms_per_token", "avg_total_ms")],
        r6("median_total_ms"),
    )


@query
def score_lines(v: Views) -> DataFrame:
    scored = T.score_lines(v.embeddings(), T.linear_scorer(64), ["embedding"], [[64]], name="score")
    return scored.select("vec_id", r6("score"))


@query
def flatten_page_result(v: Views, limit: int = GROUP_ROWS) -> DataFrame:
    grouped = v.lines().where("group_pos IS NOT NULL")
    line = F.struct(
        box(F.col("x"), F.col("y"), F.col("w"), F.col("h")).alias("bbox"), "text", "confidence"
    )
    nested = Ordered(grouped, ["doc_id", "group_pos"], ["line_id"], limit).collected(line, "lines")
    region = F.struct(F.lit("text_region").alias("label"), F.lit(0.5).alias("confidence"))
    results = nested.select(
        "doc_id",
        F.col("group_pos").alias("source_group"),
        # A group is one part at every size: the blocks of a large one are counted on.
        F.lit(0).alias("part"),
        (F.col("part") * limit).alias("first"),
        F.array(F.struct(region.alias("region"), "lines")).alias("groups"),
    )
    return T.flatten_page_result(results, first="first")


@query
def error_sentinel(v: Views) -> DataFrame:
    results = v.lines().select(
        "doc_id",
        "line_id",
        F.when(F.col("complete"), F.col("text")).alias("text"),
        F.when(F.col("complete"), F.col("confidence")).alias("confidence"),
    )
    return T.error_sentinel(results)


def _transcribed(v: Views) -> tuple[DataFrame, DataFrame]:
    # Used for the crops, the lines and the saved groups.
    regions = pin(regions_of(v.anchors_out()))
    raw_lines = crop_lines(v.masked_boxes(), regions)
    # The line detector runs on the crops of regions: these have prototypes. The keys are few bytes, so that one task would get
    # them all and make every prototype: a number of partitions that is given stays.
    crop = ["image_id", "region_id"]
    crops = raw_lines.select(*crop).repartition(v.spark.sparkContext.defaultParallelism, *crop).distinct()
    prototypes = v.prototypes(crops, MASK_CELLS, TILE)
    lines = transcribe_pages(v.anchors_out(), raw_lines, prototypes, mask=MASK_CELLS, regions=regions)
    return lines, regions


@query
def page_transcription(v: Views) -> DataFrame:
    corner = lambda p: F.concat(half_up(p["x"]).cast("string"), F.lit(","), half_up(p["y"]).cast("string"))
    return _transcribed(v)[0].select(
        "image_id", "region_id", "group_name", "line_index", "text", "complete",
        *[r6(c) for c in ("x", "y", "w", "h", "det_confidence")],
        *[F.round(c, 8).alias(c) for c in ("text_confidence", "confidence")],
        F.array_join(F.transform("polygon", corner), " ").alias("points"),
    )


@query
def page_transcription_saved(v: Views) -> DataFrame:
    lines, regions = _transcribed(v)
    pages = v.embeddings().selectExpr(
        "vec_id AS image_id", "concat('R', lpad(CAST(vec_id div 10 AS STRING), 7, '0')) AS manifest_id",
        "CAST(vec_id % 10 + 1 AS INT) AS page_number",
    )
    saved = saved_pages(lines, regions, pages)
    sizes = ["x", "y", "w", "h", *["group_" + c for c in ("rx", "ry", "rw", "rh")]]
    return saved.select(*[r6(c) if c in sizes else c for c in saved.columns if c != "confidence"], F.round("confidence", 8).alias("confidence"))


# Workspace --------------------------------------------------------------------------------


@query
def hydrate(v: Views) -> DataFrame:
    lines = v.numbered_lines()
    groups = v.groups(lines)
    saved = S.serialize_for_save(lines, groups)
    pages = v.pages().withColumn("line_counter", (F.col("doc_id") % 5).cast("int"))
    # Pages with a second group count as filled already.
    filled = groups.where("group_pos >= 1")
    return W.hydrate(pages, filled, saved, first_group_only=False).select(
        "doc_id", "line_id", "group_pos", "group_name", "text", "confidence", "complete"
    )


@query
def new_pages(v: Views) -> DataFrame:
    volumes = v.manifests().withColumn(
        "manifest_id", F.concat(F.lit("src"), (F.col("page_id") % 25).cast("string"))
    )
    wanted = V.expand_pages(volumes, V.page_count(F.col("manifest"))).where("error IS NULL")
    wanted = wanted.select("manifest_id", "page_number").distinct()
    return V.new_pages(wanted, v.pages())


@query
def pages_to_process(v: Views) -> DataFrame:
    return W.pages_to_process(v.pages(), v.lines()).select("manifest_id", "doc_id", "turn")


@query
def page_nav(v: Views) -> DataFrame:
    return W.page_nav(v.pages())


@query
def line_nav(v: Views) -> DataFrame:
    return W.line_nav(v.lines()).select("doc_id", "line_id", "prev_line", "next_line")


@query
def progress_rollup(v: Views) -> DataFrame:
    return W.progress_rollup(v.pages(), v.lines())


@query
def page_complete(v: Views) -> DataFrame:
    return W.page_complete(v.pages(), v.lines())


@query
def filter_lines(v: Views) -> DataFrame:
    return W.filter_lines(v.lines(), LINE_QUERY).select("doc_id", "line_id", "text")


@query
def filter_groups(v: Views) -> DataFrame:
    return W.filter_groups(v.lines(), LINE_QUERY)


@query
def filter_pages(v: Views) -> DataFrame:
    return W.filter_pages(v.pages(), v.lines(), LINE_QUERY).select(
        "manifest_id", "doc_id", "n_matches"
    )


@query
def filter_volumes(v: Views) -> DataFrame:
    return W.filter_volumes(v.pages(), v.lines(), LINE_QUERY)


@query
def group_text(v: Views) -> DataFrame:
    return W.group_text(v.lines())


@query
def delete_groups(v: Views) -> DataFrame:
    lines = v.lines()
    deleted = v.events().where("type = 'cancel'").select(
        F.col("image_id").alias("doc_id"), F.col("region_id").alias("group_pos")
    )
    groups = W.delete_groups(v.groups(lines).select("doc_id", "group_pos"), deleted)
    left = W.delete_groups(lines.select("doc_id", "group_pos", "line_id"), deleted)
    return left.unionByName(groups.withColumn("line_id", F.lit(-1)))


@query
def apply_edits(v: Views) -> DataFrame:
    lines = v.lines()
    tokens = v.events().where("type = 'token'").withColumn("doc_id", F.col("image_id"))
    names = W.rename_groups(
        v.groups(lines),
        tokens.select("doc_id", F.col("region_id").alias("group_pos"), "seq", "text"),
    )
    texts = W.edit_lines(lines, tokens.select("doc_id", "line_id", "seq", "text"))
    return names.select(
        F.lit("group").alias("kind"), "doc_id", F.col("group_pos").alias("id"), F.col("name").alias("value")
    ).unionByName(
        texts.select(
            F.lit("line").alias("kind"), "doc_id", F.col("line_id").alias("id"), F.col("text").alias("value")
        )
    )


@query
def remove_volumes(v: Views) -> DataFrame:
    pages = v.pages()
    listed = pages.where(F.col("manifest_id").rlike("[25]$")).select("manifest_id").distinct()
    left = W.remove_volumes(pages, listed)
    lines = W.lines_of(left, v.lines()).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"))
    return left.select("doc_id", "manifest_id").join(lines, "doc_id", "left")


@query
def rerun_requests(v: Views) -> DataFrame:
    return W.rerun_requests(v.pages(), v.groups())


@query
def rerun_cleared(v: Views) -> DataFrame:
    lines = v.lines()
    rerun = v.pages().where("pending")
    return W.cleared_lines(rerun, v.groups(lines), lines).select("doc_id", "line_id")


@query
def confidence_bands(v: Views) -> DataFrame:
    return W.confidence_bands(v.lines()).groupBy("band").agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.sum("percent").alias("sum_percent"),
        F.min("percent").alias("low"),
        F.max("percent").alias("high"),
    )


@query
def line_group(v: Views) -> DataFrame:
    lines = v.lines().select("doc_id", "line_id", "group_pos")
    # Every line also sits in the group after its own.
    both = F.array(F.col("group_pos") + 1, F.col("group_pos"))
    members = lines.select("doc_id", "line_id", F.explode(both).alias("group_pos"))
    return W.line_group(lines.drop("group_pos"), members)


# Events -----------------------------------------------------------------------------------


@query
def region_completion(v: Views) -> DataFrame:
    return E.region_completion(v.events())


@query
def inflight_gauge(v: Views) -> DataFrame:
    return E.inflight_gauge(v.events()).select("image_id", "seq", "in_flight")


@query
def active_images(v: Views) -> DataFrame:
    return E.active_images(v.events())


@query
def stage_transitions(v: Views) -> DataFrame:
    return E.stage_transitions(v.events())


@query
def latest_line(v: Views) -> DataFrame:
    return E.latest_lines(v.events())


@query
def ema_eta(v: Views) -> DataFrame:
    rates = E.smoothed_rate(v.events().where("type = 'line_done'").select("image_id", "seq", "ts"))
    run = E.batch_eta(
        F.col("eta"), F.col("avg"), F.lit(12), F.col("done"), F.col("total").cast("double")
    )
    return rates.select(
        "image_id", "seq", r6("seconds"), r6("avg"), "pending", "eta", "eta_text",
        run.alias("run_eta"),
    )


@query
def debounce(v: Views) -> DataFrame:
    fired = E.debounce(v.events(), BURST)
    shown = F.date_format("fires_at", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return fired.select("image_id", "seq", shown.alias("fires_at"))


@query
def drop_cancelled(v: Views) -> DataFrame:
    return E.drop_cancelled(v.events()).select("image_id", "region_id", "seq", "type")


@query
def route_events(v: Views) -> DataFrame:
    return E.route_events(v.events()).select(
        "seq", "image_id", "lane", "n_lines", "line", "payload_k"
    )


def run(name: str, spark: SparkSession, folder: str) -> DataFrame:
    return QUERIES[name](Views(spark, folder))


