"""Page, line, box and event views over the given tables.

The tables hold no images and no detections, so these views derive them with arithmetic.
Each view is a lazy DataFrame over whole tables.
"""

from __future__ import annotations

import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafscribe.operators.scale import ordinal
from leafscribe.session import use_shared_checkpoints
from leafscribe.sources.text_index import TextIndex


VOLUME = """CASE WHEN doc_id%50=7 THEN NULL WHEN source='src1' THEN 'upload-1' ELSE source END"""


#: Folders of the text indexes that an application has built, by application, tables and name.
_INDEXES: dict[tuple[str, str, str], str] = {}


class Views:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")
        # Numbered views look at group sizes when they are made: once is enough.
        self.page_numbers = cache(self.page_numbers)
        self._boxes = cache(self._boxes)
        self.vocabulary = cache(self.vocabulary)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def documents(self) -> DataFrame:
        return self.table("documents")

    def embeddings(self) -> DataFrame:
        return self.table("embeddings")

    # Pages, lines, groups ------------------------------------------------------------

    def page_numbers(self) -> DataFrame:
        """Position of each document in its source; texts stay out of this shuffle."""
        keys = self.documents().select("doc_id", "source")
        numbered = ordinal(keys, ["source"], ["doc_id"], "page_number")
        return numbered.withColumn("page_number", F.col("page_number").cast("int"))

    def pages(self) -> DataFrame:
        """All pages; those of the volume `web` have no lines yet."""
        cut = self.page_numbers().selectExpr(
            "doc_id",
            f"{VOLUME} AS manifest_id",
            "page_number",
            "concat(source,'_',lpad(CAST(doc_id AS STRING),5,'0'),'.jpg') AS name",
            "doc_id%9=0 AS pending",
        )
        blank = self.table("pages").selectExpr(
            "-1-page_id AS doc_id",
            "'web' AS manifest_id",
            "CAST(page_id+1 AS INT) AS page_number",
            "concat('web_',lpad(CAST(page_id AS STRING),5,'0'),'.jpg') AS name",
            "page_id%9=0 AS pending",
        )
        return cut.unionByName(blank)

    def numbered_lines(self) -> DataFrame:
        """Lines with the number of their page."""
        return self.lines().join(self.page_numbers().select("doc_id", "page_number"), "doc_id")

    def lines(self) -> DataFrame:
        cut = self.documents().select(
            F.expr(VOLUME).alias("manifest_id"),
            "doc_id",
            F.posexplode(F.split("text", "\n")).alias("line_id", "txt"),
        )
        return cut.selectExpr(
            "manifest_id",
            "doc_id",
            "line_id",
            """CASE WHEN doc_id%6=1 OR line_id%9=8 THEN NULL
                    ELSE CAST(floor(line_id/4) AS INT) END AS group_pos""",
            "CAST(line_id%4 AS INT) AS line_pos",
            """CASE WHEN (doc_id*3+line_id)%13=0 THEN '' WHEN (doc_id*3+line_id)%17=0 THEN '  '
                    ELSE txt END AS text""",
            "CAST((doc_id*13+line_id*7)%40 AS DOUBLE) AS x",
            "CAST(24*floor(line_id/2) AS DOUBLE) AS y",
            "CAST(20+8*length(txt) AS DOUBLE) AS w",
            "CAST(20 AS DOUBLE) AS h",
            "CAST((doc_id*31+line_id*17)%101 AS DOUBLE)/100D AS confidence",
            "(doc_id+line_id)%7<>0 AS complete",
        )

    def groups(self, lines: DataFrame | None = None) -> DataFrame:
        lines = self.lines() if lines is None else lines
        seen = lines.where("group_pos IS NOT NULL").select("doc_id", "group_pos").distinct()
        even = "CASE WHEN group_pos%2=0 THEN CAST({} AS DOUBLE) END AS {}"
        return seen.selectExpr(
            "doc_id",
            "group_pos",
            "concat('text_region (',CAST((doc_id*7+group_pos*13)%101 AS STRING),'%)') AS name",
            even.format("0", "rx"),
            even.format("48*group_pos", "ry"),
            even.format("900", "rw"),
            even.format("48", "rh"),
        )

    # Boxes ---------------------------------------------------------------------------

    def _boxes(self) -> DataFrame:
        items = self.table("lineitem").withColumn(
            "image_id", F.expr("CAST(floor(l_orderkey/8) AS BIGINT)")
        )
        order = [
            "l_orderkey",
            "l_linenumber",
            "l_partkey",
            "l_suppkey",
            "l_shipdate",
            "l_extendedprice",
        ]
        numbered = ordinal(items, ["image_id"], order, "det_id")
        return numbered.withColumn("det_id", F.col("det_id").cast("int"))

    _CENTRE_BOX = [
        "image_id",
        "det_id",
        """array(CAST(l_partkey%101 AS DOUBLE)/100D, CAST(l_suppkey%101 AS DOUBLE)/100D,
                 CAST(l_orderkey%101 AS DOUBLE)/100D) AS scores""",
        "CAST(l_quantity*12 AS DOUBLE) AS cx",
        "CAST(l_linenumber*90 AS DOUBLE) AS cy",
        "CAST(40+l_partkey%300 AS DOUBLE) AS bw",
        "CAST(20+l_suppkey%40 AS DOUBLE) AS bh",
        "1200D AS orig_w",
        "1600D AS orig_h",
        "2D/5D AS scale",
        "80D AS pad_x",
        "0D AS pad_y",
    ]

    def centre_boxes(self) -> DataFrame:
        return self._boxes().selectExpr(*self._CENTRE_BOX)

    def masked_boxes(self) -> DataFrame:
        """Raw boxes per region crop, with the coefficients of their masks."""
        half = "array(CAST(l_partkey%7+1 AS DOUBLE)/2D, CAST(l_suppkey%5-2 AS DOUBLE)/2D) AS coefficients"
        return self._boxes().selectExpr(*self._CENTRE_BOX, "CAST(det_id%4 AS INT) AS region_id", half)

    def prototypes(self, crops: DataFrame, mask: int, tile: int) -> DataFrame:
        """Prototype tiles of region crops, two coefficients a cell. There are 13 patterns, dealt to the crops."""
        cell = f"(tile*{tile} + i div {2 * mask})*7 + (i div 2 % {mask})*3 + (i % 2)*11"
        tiles = F.explode(F.sequence(F.lit(0), F.lit(mask // tile - 1))).alias("tile")
        patterns = self.spark.range(13).select(F.col("id").alias("pattern"), tiles).selectExpr(
            "pattern", "tile",
            f"transform(sequence(0, {tile * mask * 2 - 1}), i -> CAST((pattern + {cell}) % 13 - 4 AS FLOAT) / 4F) AS values",
        )
        named = crops.selectExpr("image_id", "region_id", "(image_id*31 + region_id*17) % 13 AS pattern")
        return named.join(F.broadcast(patterns), "pattern").drop("pattern")

    def detections(self) -> DataFrame:
        return self._boxes().selectExpr(
            "image_id",
            "det_id",
            "l_linenumber%3 AS class_id",
            "CAST((l_partkey*7+l_suppkey*13+l_orderkey)%101 AS DOUBLE)/100D AS score",
            "l_quantity*10 AS x",
            "CAST(l_linenumber*20 AS DOUBLE)+l_discount*100 AS y",
            "CAST(100 AS DOUBLE)+l_tax*1000 AS w",
            "CAST(30 AS DOUBLE) AS h",
        )

    def polygons(self) -> DataFrame:
        corner = "named_struct('x',{},'y',{})"
        points = [
            ("x", "y+h/2"),
            ("x+w/4", "y"),
            ("x+w", "y"),
            ("x+w", "y+h"),
            ("x+w/2", "y+h*2/3"),
            ("x+w/4", "y+h"),
        ]
        listed = ",".join(corner.format(px, py) for px, py in points)
        return self.detections().selectExpr(
            "image_id", "det_id", "x", "y", "w", "h", f"array({listed}) AS polygon"
        )

    def points(self) -> DataFrame:
        return self.table("events").selectExpr(
            "event_id AS point_id",
            "user_id AS doc_id",
            "CAST(event_id%800 AS DOUBLE) AS px",
            "CAST((event_id*7)%240 AS DOUBLE) AS py",
        )

    def rectangles(self) -> DataFrame:
        return self.table("events").selectExpr(
            "event_id AS rect_id",
            "user_id AS doc_id",
            "CAST(event_id%600 AS DOUBLE) AS x1",
            "CAST((event_id*7)%240 AS DOUBLE) AS y1",
            "CAST((event_id*3)%600 AS DOUBLE) AS x2",
            "CAST((event_id*11)%240 AS DOUBLE) AS y2",
        )

    def _vector_items(self) -> DataFrame:
        return self.embeddings().select("vec_id", F.posexplode("embedding").alias("pos", "v"))

    def anchors_out(self) -> DataFrame:
        return self._vector_items().selectExpr(
            "vec_id AS image_id",
            "pos*131 AS anchor_idx",
            "CAST(v AS DOUBLE)*10 AS logit",
            "CAST(8+pos%5 AS DOUBLE) AS l",
            "CAST(4+pos%3 AS DOUBLE) AS t",
            "CAST(60+pos AS DOUBLE) AS r",
            "CAST(12+pos%4 AS DOUBLE) AS b",
        )

    def mask_logits(self) -> DataFrame:
        return self._vector_items().selectExpr(
            "vec_id AS det_id",
            "CAST(floor(pos/8) AS INT) AS y",
            "CAST(pos%8 AS INT) AS x",
            "CAST(v AS DOUBLE) AS logit",
        )

    # Tokens --------------------------------------------------------------------------

    def logits(self) -> DataFrame:
        return self._vector_items().selectExpr(
            "vec_id AS seq_id", "pos AS token_id", "CAST(v AS DOUBLE) AS score"
        )

    def token_words(self) -> DataFrame:
        return self.table("conversations").select(
            F.expr("conv_id*100+turn").alias("seq_id"),
            F.posexplode(F.split(F.lower("text"), "[ \n]+")).alias("pos", "word"),
        )

    def vocabulary(self) -> DataFrame:
        known = self.token_words().select("word").distinct().withColumn("code", F.hex("word"))
        ranked = ordinal(known, [], ["code"], "rank")
        return ranked.select("word", (F.col("rank") + 2).cast("int").alias("id"))

    # Events --------------------------------------------------------------------------

    def events(self) -> DataFrame:
        return event_rows(self.table("events"))

    # Catalog and volume inputs -------------------------------------------------------

    def catalog(self) -> DataFrame:
        return self.documents().selectExpr(
            "doc_id",
            "concat(source,'/',lang,'/',CAST(doc_id AS STRING)) AS reference_code",
            "source AS archive_code",
            "CASE WHEN doc_id%11=0 THEN '' ELSE concat('Fonds ',source) END AS fonds_title",
            "concat('About ',source) AS fonds_description",
            "concat('Creator ',lang) AS creator",
            "CASE WHEN doc_id%5=0 THEN '' ELSE lang END AS series_title",
            "CAST(doc_id AS STRING) AS volume_id",
            "CAST(1600+doc_id%300 AS STRING) AS date_text",
            "CAST(1600+doc_id%300 AS INT) AS year_start",
            "text AS description",
        )

    def text_index(self, name: str) -> TextIndex:
        """Index of the texts of `documents` by doc_id, or of the descriptions of `catalog` by reference code.

        Built once for an application, in the shared folder.
        """
        key, key_type, text = ("doc_id", "long", "text") if name == "documents" else ("reference_code", "string", "description")
        use_shared_checkpoints(self.spark)
        context = self.spark.sparkContext
        built = (context.applicationId, self.folder, name)
        if built in _INDEXES:
            return TextIndex(self.spark, _INDEXES[built], key_type)
        path = f"{context.getCheckpointDir()}/text-index-{uuid.uuid4().hex}"
        index = TextIndex.create(self.spark, path, key_type)
        index.append(getattr(self, name)(), key, text, 0)
        _INDEXES[built] = path
        return index

    def harvest(self) -> DataFrame:
        head = '<r xmlns:xlink="http://www.w3.org/1999/xlink"><dao xlink:href="https://a.example/'
        return self.table("pages").selectExpr(
            "page_id",
            "concat('R',lpad(CAST(page_id AS STRING),7,'0')) AS expected_id",
            f"""CASE WHEN page_id%20=10
                     THEN '<r><error><b>no</b> &#115;uch <![CDATA[record]]></error></r>'
                     WHEN page_id%20=11 THEN concat('{head}bildvisning/R', page_id, '"/><dao')
                     WHEN page_id%10=2 THEN concat('{head}bildvisning/&#82;',
                                                   lpad(CAST(page_id AS STRING),7,'0'),'"/></r>')
                     WHEN page_id%10=0
                     THEN '<r><error code="idDoesNotExist">no such record</error></r>'
                     WHEN page_id%10=1 THEN '{head}other"/></r>'
                     ELSE concat('{head}x"/><dao xlink:href="https://a.example/bildvisning/R',
                                 lpad(CAST(page_id AS STRING),7,'0'),'?p=1"/></r>') END AS xml""",
        )

    def manifests(self) -> DataFrame:
        return self.table("pages").selectExpr(
            "page_id",
            "concat('R',lpad(CAST(page_id AS STRING),7,'0')) AS manifest_id",
            """CASE WHEN page_id%12=0 THEN '{}'
                    ELSE concat('{"items":[',
                                array_join(array_repeat('{}', CAST(page_id%12 AS INT)),','),
                                ']}') END AS manifest""",
            "CAST(page_id%4 AS INT) AS req_start",
            "CAST(page_id%9 AS INT) AS req_end",
        )

    def fetches(self) -> DataFrame:
        return self.table("pages").selectExpr(
            "page_id",
            "CASE WHEN page_id%7=0 THEN 404 ELSE 200 END AS status",
            "CASE WHEN page_id%5=0 THEN 'text/html' ELSE 'image/jpeg' END AS ctype",
            "CAST(CASE WHEN page_id%3=0 THEN 42 ELSE length(html) END AS BIGINT) AS n_bytes",
        )


def event_rows(events: DataFrame) -> DataFrame:
    """Tagged worker events; also applied to a stream of the same table."""
    return events.selectExpr(
        "event_id AS seq",
        "CAST(ts AS TIMESTAMP) AS ts",
        "user_id AS image_id",
        "CAST(event_id%4 AS INT) AS region_id",
        "CAST(event_id%10 AS INT) AS line_id",
        """CASE event_type WHEN 'signup' THEN 'region_lines' WHEN 'view' THEN 'token'
                WHEN 'click' THEN 'line_done' WHEN 'error' THEN 'cancel'
                ELSE 'progress' END AS type""",
        "CAST(floor(value) AS INT)%5 AS total",
        "CASE WHEN event_id%6=0 THEN '  ' ELSE props END AS text",
        "value",
    )
