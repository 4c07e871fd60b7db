"""The same results as plain SQL over the same tables, for checking."""

from __future__ import annotations

import re

from leafscribe.plans import queries as Q

SPACE = r"[\t\n\x0b\f\r \x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"

# Derived views, in order of dependence.
VIEWS = {
    "f_feed": """
SELECT doc_id, CASE WHEN doc_id%50=7 THEN NULL WHEN source='src1' THEN 'upload-1' ELSE source END AS manifest_id,
  CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) AS INT) AS page_number,
  concat(source,'_',lpad(CAST(doc_id AS VARCHAR),5,'0'),'.jpg') AS name, doc_id%9=0 AS pending, text AS body
FROM documents""",
    "f_page": """
SELECT doc_id, manifest_id, page_number, name, pending FROM f_feed
UNION ALL
SELECT -1-page_id, 'web', CAST(page_id+1 AS INT), concat('web_',lpad(CAST(page_id AS VARCHAR),5,'0'),'.jpg'), page_id%9=0
FROM pages""",
    "f_line": """
SELECT manifest_id, page_number, doc_id, line_id,
  CASE WHEN doc_id%6=1 OR line_id%9=8 THEN NULL ELSE CAST(floor(line_id/4) AS INT) END AS group_pos, CAST(line_id%4 AS INT) AS line_pos,
  CASE WHEN (doc_id*3+line_id)%13=0 THEN '' WHEN (doc_id*3+line_id)%17=0 THEN '  ' ELSE txt END AS text,
  CAST((doc_id*13+line_id*7)%40 AS DOUBLE) AS x, CAST(24*floor(line_id/2) AS DOUBLE) AS y,
  CAST(20+8*length(txt) AS DOUBLE) AS w, CAST(20 AS DOUBLE) AS h,
  CAST((doc_id*31+line_id*17)%101 AS DOUBLE)/CAST(100 AS DOUBLE) AS confidence, (doc_id+line_id)%7<>0 AS complete
FROM (SELECT manifest_id, page_number, doc_id, CAST(generate_subscripts(ls,1)-1 AS INT) AS line_id, unnest(ls) AS txt
      FROM (SELECT *, string_split(body, chr(10)) AS ls FROM f_feed))""",
    "f_group": """
SELECT doc_id, group_pos, concat('text_region (',CAST((doc_id*7+group_pos*13)%101 AS VARCHAR),'%)') AS name,
  CASE WHEN group_pos%2=0 THEN CAST(0 AS DOUBLE) END AS rx, CASE WHEN group_pos%2=0 THEN CAST(48*group_pos AS DOUBLE) END AS ry,
  CASE WHEN group_pos%2=0 THEN CAST(900 AS DOUBLE) END AS rw, CASE WHEN group_pos%2=0 THEN CAST(48 AS DOUBLE) END AS rh
FROM (SELECT DISTINCT doc_id, group_pos FROM f_line WHERE group_pos IS NOT NULL)""",
    "f_boxes": """
SELECT *, CAST(floor(l_orderkey/8) AS BIGINT) AS image_id,
  CAST(row_number() OVER (PARTITION BY floor(l_orderkey/8) ORDER BY l_orderkey,l_linenumber,l_partkey,l_suppkey,l_shipdate,l_extendedprice) AS INT) AS det_id
FROM lineitem""",
    "f_cbox": """
SELECT image_id, det_id,
  [CAST(l_partkey%101 AS DOUBLE)/CAST(100 AS DOUBLE), CAST(l_suppkey%101 AS DOUBLE)/CAST(100 AS DOUBLE), CAST(l_orderkey%101 AS DOUBLE)/CAST(100 AS DOUBLE)] AS scores,
  CAST(l_quantity*12 AS DOUBLE) AS cx, CAST(l_linenumber*90 AS DOUBLE) AS cy, CAST(40+l_partkey%300 AS DOUBLE) AS bw, CAST(20+l_suppkey%40 AS DOUBLE) AS bh,
  CAST(1200 AS DOUBLE) AS orig_w, CAST(1600 AS DOUBLE) AS orig_h, CAST(2 AS DOUBLE)/CAST(5 AS DOUBLE) AS scale, CAST(80 AS DOUBLE) AS pad_x, CAST(0 AS DOUBLE) AS pad_y
FROM f_boxes""",
    "f_det": """
SELECT image_id, det_id, l_linenumber%3 AS class_id, CAST((l_partkey*7+l_suppkey*13+l_orderkey)%101 AS DOUBLE)/CAST(100 AS DOUBLE) AS score,
  l_quantity*10 AS x, CAST(l_linenumber*20 AS DOUBLE)+l_discount*100 AS y, CAST(100 AS DOUBLE)+l_tax*1000 AS w, CAST(30 AS DOUBLE) AS h
FROM f_boxes""",
    "f_shifted": "SELECT image_id, det_id, x-60.5::DOUBLE AS x, y-45 AS y, w, h FROM f_det",
    "f_event": """
SELECT event_id AS seq, CAST(ts AS TIMESTAMP) AS ts, user_id AS image_id, CAST(event_id%4 AS INT) AS region_id, CAST(event_id%10 AS INT) AS line_id,
  CASE event_type WHEN 'signup' THEN 'region_lines' WHEN 'view' THEN 'token' WHEN 'click' THEN 'line_done' WHEN 'error' THEN 'cancel' ELSE 'progress' END AS type,
  CAST(floor(value) AS INT)%5 AS total, CASE WHEN event_id%6=0 THEN '  ' ELSE props END AS text, value
FROM events""",
    "f_catalog": """
SELECT doc_id, concat(source,'/',lang,'/',CAST(doc_id AS VARCHAR)) AS reference_code, source AS archive_code,
  CASE WHEN doc_id%11=0 THEN '' ELSE concat('Fonds ',source) END AS fonds_title, concat('About ',source) AS fonds_description,
  concat('Creator ',lang) AS creator, CASE WHEN doc_id%5=0 THEN '' ELSE lang END AS series_title, CAST(doc_id AS VARCHAR) AS volume_id,
  CAST(1600+doc_id%300 AS VARCHAR) AS date_text, CAST(1600+doc_id%300 AS INT) AS year_start, text AS description
FROM documents""",
    "f_logits": """
SELECT vec_id AS seq_id, CAST(generate_subscripts(embedding,1)-1 AS INT) AS token_id, CAST(unnest(embedding) AS DOUBLE) AS score FROM embeddings""",
    "f_mask": """
SELECT det_id, CAST(floor(pos/8) AS INT) AS y, CAST(pos%8 AS INT) AS x, logit
FROM (SELECT vec_id AS det_id, generate_subscripts(embedding,1)-1 AS pos, CAST(unnest(embedding) AS DOUBLE) AS logit FROM embeddings)""",
    "f_raw": """
SELECT image_id, CAST(pos*131 AS INT) AS anchor_idx, CAST(v AS DOUBLE)*10 AS logit, CAST(8+pos%5 AS DOUBLE) AS l, CAST(4+pos%3 AS DOUBLE) AS t,
  CAST(60+pos AS DOUBLE) AS r, CAST(12+pos%4 AS DOUBLE) AS b
FROM (SELECT vec_id AS image_id, generate_subscripts(embedding,1)-1 AS pos, unnest(embedding) AS v FROM embeddings)""",
    "f_seq": r"""
SELECT seq_id, CAST(generate_subscripts(ws,1)-1 AS INT) AS pos, unnest(ws) AS word
FROM (SELECT conv_id*100+turn AS seq_id, regexp_split_to_array(lower(text), '[ \n]+') AS ws FROM conversations)""",
    "f_vocab": """
SELECT word, CAST(2+row_number() OVER (ORDER BY hex(encode(word))) AS INT) AS id FROM (SELECT DISTINCT word FROM f_seq)""",
    "f_tokens": "SELECT seq_id, pos, id AS token_id, word FROM f_seq JOIN f_vocab USING (word)",
    "f_oai": """
SELECT page_id, concat('R',lpad(CAST(page_id AS VARCHAR),7,'0')) AS expected_id,
  CASE WHEN page_id%10=0 THEN NULL WHEN page_id%10=1 THEN NULL ELSE concat('R',lpad(CAST(page_id AS VARCHAR),7,'0')) END AS manifest_id,
  CASE WHEN page_id%10=0 THEN 'no such record' WHEN page_id%10=1 THEN 'Could not find IIIF manifest ID in OAI-PMH response' END AS error
FROM pages""",
    "f_manifest": """
SELECT page_id, concat('R',lpad(CAST(page_id AS VARCHAR),7,'0')) AS manifest_id, CAST(page_id%12 AS INT) AS n_pages,
  CASE WHEN page_id%12=0 THEN '{}' ELSE concat('{"items":[',rtrim(repeat('{},', CAST(page_id%12 AS INT)),','),']}') END AS manifest,
  CAST(page_id%4 AS INT) AS req_start, CAST(page_id%9 AS INT) AS req_end FROM pages""",
    "f_fetch": """
SELECT page_id, CASE WHEN page_id%7=0 THEN 404 ELSE 200 END AS status, CASE WHEN page_id%5=0 THEN 'text/html' ELSE 'image/jpeg' END AS ctype,
  CAST(CASE WHEN page_id%3=0 THEN 42 ELSE length(html) END AS BIGINT) AS n_bytes FROM pages""",
    "f_point": """
SELECT event_id AS point_id, user_id AS doc_id, CAST(event_id%800 AS DOUBLE) AS px, CAST((event_id*7)%240 AS DOUBLE) AS py FROM events""",
    "f_rect": """
SELECT event_id AS rect_id, user_id AS doc_id, CAST(event_id%600 AS DOUBLE) AS x1, CAST((event_id*7)%240 AS DOUBLE) AS y1,
  CAST((event_id*3)%600 AS DOUBLE) AS x2, CAST((event_id*11)%240 AS DOUBLE) AS y2 FROM events""",
    "f_poly": """
SELECT image_id, det_id, x, y, w, h,
  [{'x':x,'y':y+h/2},{'x':x+w/4,'y':y},{'x':x+w,'y':y},{'x':x+w,'y':y+h},{'x':x+w/2,'y':y+h*2/3},{'x':x+w/4,'y':y+h}] AS polygon FROM f_det""",
    "f_kept": "SELECT * FROM f_line WHERE complete AND text <> ''",
    "f_saved": rf"""
SELECT l.manifest_id, coalesce(l.page_number,0) AS page_number, l.doc_id, l.group_pos, g.name AS group_name,
  coalesce(rx,0) AS group_rx, coalesce(ry,0) AS group_ry, coalesce(rw,0) AS group_rw, coalesce(rh,0) AS group_rh,
  CAST(row_number() OVER (PARTITION BY l.doc_id, l.group_pos ORDER BY l.line_pos, l.line_id)-1 AS INT) AS line_index,
  x, y, w, h, text, confidence, 'htr' AS source, '' AS contributor
FROM f_line l JOIN f_group g ON g.doc_id=l.doc_id AND g.group_pos=l.group_pos
WHERE l.manifest_id IS NOT NULL AND complete AND regexp_matches(text, '{SPACE.replace("[", "[^", 1)}')""",
    "f_counts": """
SELECT p.*, coalesce(n,0) AS n_lines, coalesce(c,0) AS n_complete, coalesce(g,0) AS n_grouped
FROM f_page p LEFT JOIN (SELECT doc_id, count(*) AS n, count_if(complete) AS c, count(group_pos) AS g FROM f_line GROUP BY 1) USING (doc_id)""",
    "f_words": rf"""
SELECT *, list_filter(regexp_split_to_array(text, '{SPACE}+'), lambda z: z <> '') AS ws FROM f_kept""",
    "f_span": """
SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY y, x, line_id)-1 AS i FROM f_kept""",
    "f_region_lines": """
SELECT doc_id, group_pos, 0.0::DOUBLE AS k1, 0.0::DOUBLE AS k2, line_pos::BIGINT AS k3, line_id, x, y, w, h, text, confidence FROM f_kept WHERE group_pos IS NOT NULL
UNION ALL
SELECT doc_id, -1, y, x, 0, line_id, x, y, w, h, text, confidence FROM f_kept
WHERE doc_id NOT IN (SELECT doc_id FROM f_kept WHERE group_pos IS NOT NULL)""",
    "f_placed": """
SELECT *, row_number() OVER (PARTITION BY doc_id, group_pos ORDER BY k1, k2, k3, line_id)-1 AS line_no,
  dense_rank() OVER (PARTITION BY doc_id ORDER BY group_pos)-1 AS region FROM f_region_lines""",
    "f_regions": """
SELECT p.doc_id, p.group_pos, p.region, coalesce(any_value(rx), min(x)) AS x, coalesce(any_value(ry), min(y)) AS y,
  coalesce(any_value(rw), max(x+w)-min(x)) AS w, coalesce(any_value(rh), max(y+h)-min(y)) AS h,
  count(*) AS n_lines, min_by(line_id, line_no) AS first_line
FROM f_placed p LEFT JOIN f_group g ON g.doc_id=p.doc_id AND g.group_pos=p.group_pos GROUP BY 1,2,3""",
    "f_runs": """
SELECT *, sum(CASE WHEN type='region_lines' THEN 1 ELSE 0 END) OVER (PARTITION BY image_id, region_id ORDER BY seq) AS epoch
FROM f_event WHERE type IN ('region_lines','line_done')""",
    "f_run_events": """
SELECT *, max(CASE WHEN type='region_lines' THEN total END) OVER (PARTITION BY image_id, region_id, epoch) AS run_total,
  min(seq) OVER (PARTITION BY image_id, region_id, epoch) AS opened_by,
  sum(CASE WHEN type='line_done' THEN 1 ELSE 0 END) OVER (PARTITION BY image_id, region_id, epoch ORDER BY seq) AS done
FROM f_runs""",
    "f_open": """
SELECT *, epoch>0 AND done < run_total AS open_after,
  coalesce(lag(epoch>0 AND done < run_total) OVER (PARTITION BY image_id, region_id ORDER BY seq), false) AS open_before
FROM f_run_events""",
    "f_sums": """
SELECT *, sum(CASE WHEN type='region_lines' THEN total ELSE -1 END) OVER (PARTITION BY image_id ORDER BY seq) AS s FROM f_open""",
    "f_gauge": """
SELECT *, s - least(0, min(s) OVER (PARTITION BY image_id ORDER BY seq)) AS in_flight,
  sum(CAST(open_after AS INT)-CAST(open_before AS INT)) OVER (PARTITION BY image_id ORDER BY seq) AS open_regions
FROM f_sums""",
    "f_stage": """
SELECT *, CASE WHEN in_flight>0 OR open_regions>0 THEN 'transcribing' ELSE 'done' END AS stage FROM f_gauge""",
}


def _bm25(source: str, key: str, text: str, query: str) -> str:
    terms = sorted(set(query.lower().split()))
    tf = ", ".join(f"len(list_filter(ws, lambda z: z = '{t}')) AS t{i}" for i, t in enumerate(terms))
    df = ", ".join(f"count_if(t{i}>0) AS d{i}" for i in range(len(terms)))
    part = " + ".join(
        f"CASE WHEN t{i}>0 THEN ln(1+(n-d{i}+0.5::DOUBLE)/(d{i}+0.5::DOUBLE))*t{i}*2.2::DOUBLE"
        f"/(t{i}+1.2::DOUBLE*(0.25::DOUBLE+0.75::DOUBLE*dl/mean)) ELSE 0::DOUBLE END"
        for i in range(len(terms))
    )
    any_term = " OR ".join(f"t{i}>0" for i in range(len(terms)))
    return rf"""(SELECT {key}, {part} AS score FROM (
  SELECT {key}, len(ws) AS dl, {tf} FROM (
    SELECT {key}, list_filter(regexp_split_to_array(lower({text}), '[^\p{{L}}\p{{N}}]+'), lambda z: z <> '') AS ws FROM {source}))
  CROSS JOIN (SELECT count(*) AS n, avg(dl) AS mean, {df} FROM (
    SELECT len(ws) AS dl, {tf} FROM (
      SELECT list_filter(regexp_split_to_array(lower({text}), '[^\p{{L}}\p{{N}}]+'), lambda z: z <> '') AS ws FROM {source})))
  WHERE {any_term})"""


DOC_HITS = _bm25("documents", "doc_id", "text", Q.DOC_QUERY)
RECORD_HITS = _bm25("f_catalog", "reference_code", "description", Q.RECORD_QUERY)


def _vector(name: str) -> str:
    return "[" + ",".join(f"{x}::DOUBLE" for x in Q.query_vectors()[name]) + "]"


def half_up(x: str) -> str:
    return f"CAST(floor({x}+0.5) AS BIGINT)"


def iou(a: str, b: str) -> str:
    inter = (
        f"(greatest(0,least({a}.x+{a}.w,{b}.x+{b}.w)-greatest({a}.x,{b}.x))"
        f"*greatest(0,least({a}.y+{a}.h,{b}.y+{b}.h)-greatest({a}.y,{b}.y)))"
    )
    union = f"({a}.w*{a}.h+{b}.w*{b}.h-{inter})"
    return f"(CASE WHEN {union}>0 THEN {inter}/{union} ELSE 0 END)"


def _nms(source: str, group: str, key: str) -> str:
    """Greedy suppression as a fold over the boxes of a group, best first."""
    return f"""(SELECT {group}, b.k AS {key}, -b.s AS score, b.x AS x, b.y AS y, b.w AS w, b.h AS h FROM (
  SELECT {group}, unnest(list_reduce(bs,
    lambda acc, d: CASE WHEN len(list_filter(acc, lambda k: {iou("k", "d[1]")} > 0.45))>0
      THEN acc ELSE list_concat(acc, d) END)) AS b
  FROM (SELECT {group}, list([{{'s':-score,'k':{key},'x':x,'y':y,'w':w,'h':h}}] ORDER BY -score, {key}) AS bs
        FROM {source} GROUP BY {group})))"""


def esc(x: str) -> str:
    return (
        f"replace(replace(replace(replace({x},'&','&amp;'),'<','&lt;'),'>','&gt;'),'\"','&quot;')"
    )


def corners(x: str, y: str, w: str, h: str) -> str:
    left, top, right, low = half_up(x), half_up(y), half_up(f"{x}+{w}"), half_up(f"{y}+{h}")
    return f"concat({left},',',{top},' ',{right},',',{top},' ',{right},',',{low},' ',{left},',',{low})"


def anchor(axis: str) -> str:
    parts, offset = [], 0
    for stride in (8, 16, 32):
        grid = 640 // stride
        index = f"(anchor_idx-{offset})"
        value = f"{index}%{grid}" if axis == "x" else f"floor({index}/{grid})"
        parts.append(f"WHEN anchor_idx BETWEEN {offset} AND {offset + grid * grid - 1} THEN {value}*{stride}")
        offset += grid * grid
    return f"CAST(CASE {' '.join(parts)} END AS DOUBLE)"


def regions_sql(scale: float) -> str:
    k = 1 / scale
    return f"""(SELECT image_id, anchor_idx, 1.0::DOUBLE/(1.0::DOUBLE+exp(-logit)) AS score,
    ({anchor("x")}-l)*{k}::DOUBLE AS x, ({anchor("y")}-t)*{k}::DOUBLE AS y,
    ({anchor("x")}+r)*{k}::DOUBLE-({anchor("x")}-l)*{k}::DOUBLE AS w,
    ({anchor("y")}+b)*{k}::DOUBLE-({anchor("y")}-t)*{k}::DOUBLE AS h
  FROM f_raw WHERE 1.0::DOUBLE/(1.0::DOUBLE+exp(-logit)) >= 0.3)"""


LINE_BOXES = """(SELECT image_id, det_id, {extra} CAST(list_position(scores, list_max(scores))-1 AS INT) AS class_id, list_max(scores) AS score,
    greatest(0,least((cx-bw/2-pad_x)/scale,orig_w)) AS x, greatest(0,least((cy-bh/2-pad_y)/scale,orig_h)) AS y,
    least(bw/scale,orig_w-(cx-bw/2-pad_x)/scale) AS w, least(bh/scale,orig_h-(cy-bh/2-pad_y)/scale) AS h
  FROM f_cbox WHERE list_max(scores)>=0.25)"""

def _simplified(source: str, keys: str) -> str:
    """Common table expressions up to `u`: the points of each polygon that simplification keeps."""
    return f"""s AS (SELECT {keys}, polygon AS p, 1 AS lo, CAST(len(polygon) AS INT) AS hi FROM {source}
  UNION ALL SELECT {keys}, p, CASE side WHEN 0 THEN lo ELSE cut END, CASE side WHEN 0 THEN cut ELSE hi END
  FROM (SELECT *, CAST(lo+list_position(ds, list_max(ds)) AS INT) AS cut, unnest([0,1]) AS side
    FROM (SELECT *, list_transform(range(lo+1,hi), lambda i: sqrt(
        pow(p[i].x-p[lo].x-greatest(0,least(1,CASE WHEN sq=0 THEN 0 ELSE ((p[i].x-p[lo].x)*dx+(p[i].y-p[lo].y)*dy)/sq END))*dx,2)
        +pow(p[i].y-p[lo].y-greatest(0,least(1,CASE WHEN sq=0 THEN 0 ELSE ((p[i].x-p[lo].x)*dx+(p[i].y-p[lo].y)*dy)/sq END))*dy,2))) AS ds
      FROM (SELECT *, dx*dx+dy*dy AS sq FROM (SELECT *, p[hi].x-p[lo].x AS dx, p[hi].y-p[lo].y AS dy FROM s WHERE hi-lo>2)))
    WHERE list_max(ds)>2)),
corner AS (SELECT {keys}, p, unnest(CASE WHEN hi-lo=2 THEN [lo,lo+1,hi] ELSE [lo,hi] END) AS i FROM s),
u AS (SELECT DISTINCT {keys}, i, p[i].x AS x, p[i].y AS y FROM corner)"""


#: Regions, kept lines and read lines of the whole pages.
TRANSCRIBED = f"""
r AS (SELECT image_id, CAST(row_number() OVER (PARTITION BY image_id ORDER BY y, x, anchor_idx)-1 AS INT) AS region_id, concat('text_region (',{half_up('score*100')},'%)') AS group_name,
    greatest(0,{half_up('x')}) AS cx, greatest(0,{half_up('y')}) AS cy, x AS rx, y AS ry, greatest(0,w) AS rw, greatest(0,h) AS rh
  FROM (SELECT image_id, anchor_idx, score, greatest(0,x) AS x, greatest(0,y) AS y, w, h FROM {_nms(regions_sql(1.0), 'image_id', 'anchor_idx')})),
d AS (SELECT * FROM {LINE_BOXES.format(extra='det_id%4 AS region_id,')} JOIN (SELECT image_id, region_id FROM r) USING (image_id, region_id)),
k AS (SELECT image_id, region_id, det_id, score, x+cx AS x, y+cy AS y, w, h, group_name, cx, cy, rx, ry, rw, rh FROM {_nms('d', 'image_id, region_id', 'det_id')} JOIN r USING (image_id, region_id)),
read AS (SELECT *, CAST(row_number() OVER (PARTITION BY image_id, region_id ORDER BY y, x, det_id)-1 AS INT) AS line_index,
  CASE WHEN {half_up('y')}%100=77 THEN '[error]' ELSE concat('line at ',{half_up('y')}) END AS text,
  CASE WHEN {half_up('y')}%100<>77 THEN (x*0.25::DOUBLE+y*0.5::DOUBLE+w*0.75::DOUBLE+h)/1000 END AS text_confidence FROM k)"""

SQL: dict[str, str] = {
    "image_scan": """
SELECT page_id, ctype, n_bytes, 'upload-1' AS manifest_id, CAST(row_number() OVER (ORDER BY page_id) AS INT) AS page_number FROM f_fetch WHERE ctype LIKE 'image/%'""",
    "harvest_resolve": "SELECT page_id, manifest_id, error FROM f_oai",
    "manifest_page_count": "SELECT manifest_id, CAST(coalesce(json_array_length(manifest, '$.items'),0) AS INT) AS n_pages FROM f_manifest",
    "page_urls": f"""
SELECT manifest_id, page_number, concat('{Q.IMAGE_BASE}/arkis!',manifest_id,'_',pad,'/full/max/0/default.jpg') AS url, concat(manifest_id,'_',pad,'.jpg') AS name
FROM (SELECT *, CASE WHEN n<10 THEN concat('0000',n) WHEN n<100 THEN concat('000',n) WHEN n<1000 THEN concat('00',n) WHEN n<10000 THEN concat('0',n) ELSE CAST(n AS VARCHAR) END AS pad
FROM (SELECT *, page_number + CASE WHEN page_id%5=0 THEN 99990 ELSE 0 END AS n
FROM (SELECT page_id, manifest_id, CAST(unnest(range(1, n_pages+1)) AS INT) AS page_number FROM f_manifest)))""",
    "valid_fetches": "SELECT * FROM f_fetch WHERE status BETWEEN 200 AND 299 AND ctype LIKE 'image/%' AND n_bytes>=100",
    "expand_pages": """
SELECT manifest_id, CAST(unnest(range(greatest(1,req_start), least(req_end,n_pages)+1)) AS INT) AS page_number, CAST(NULL AS VARCHAR) AS error
FROM f_manifest WHERE n_pages>0
UNION ALL SELECT manifest_id, NULL, 'No pages found in this volume' FROM f_manifest WHERE n_pages=0""",
    "route_sources": """
SELECT code, r.manifest_id, error, n_pages FROM (
  SELECT concat(' ',expected_id,' ') AS code, expected_id AS manifest_id, NULL AS error FROM f_oai WHERE page_id%3=0
  UNION ALL SELECT concat('SE/',page_id), manifest_id, error FROM f_oai WHERE page_id%3<>0) r
LEFT JOIN f_manifest m ON m.manifest_id=r.manifest_id""",
    "read_transcriptions": f"""
SELECT manifest_id, page_number, group_pos, group_name, CAST(0 AS INT) AS part, CAST(count(*) AS INT) AS n_lines, string_agg(text, chr(10) ORDER BY line_index) AS texts
FROM f_saved WHERE contains(lower(text),'{Q.LINE_QUERY}') GROUP BY manifest_id, page_number, group_pos, group_name""",
    "list_saved": """
SELECT manifest_id, concat('SE/',manifest_id) AS reference_code, count(*) AS lines, count(DISTINCT (page_number, group_pos)) AS groups,
  count(DISTINCT page_number) AS pages,
  strftime(max(TIMESTAMP '2024-01-01' + to_seconds(doc_id*60+line_index)), '%Y-%m-%d %H:%M:%S') AS last_saved
FROM f_saved GROUP BY manifest_id""",
    "serialize_for_save": "SELECT * FROM f_saved",
    "changed_volumes": r"""
SELECT manifest_id, count(*) AS n_lines FROM f_saved GROUP BY 1
HAVING string_agg(concat(doc_id,'|',group_pos,'|',line_index,'|',text), '#' ORDER BY doc_id, group_pos, line_index)
  <> string_agg(concat(doc_id,'|',group_pos,'|',line_index,'|',CASE WHEN regexp_matches(manifest_id,'[02468]$') AND doc_id%3=0 THEN concat(text,' (edited)') ELSE text END), '#' ORDER BY doc_id, group_pos, line_index)""",
    "delete_volumes": "SELECT manifest_id, doc_id, line_id FROM f_line WHERE manifest_id IS NULL OR NOT regexp_matches(manifest_id,'[25]$')",
    "export_text": r"""
SELECT p.doc_id, concat(regexp_replace(name,'\.[^.]+$',''),'.txt') AS file_name, CAST(0 AS INT) AS part, coalesce(content,'') AS content
FROM f_page p LEFT JOIN (SELECT doc_id, string_agg(text, chr(10) ORDER BY y, x, line_id) AS content FROM f_kept GROUP BY 1) USING (doc_id)""",
    "export_json": r"""
SELECT p.doc_id, concat(regexp_replace(name,'\.[^.]+$',''),'.json') AS file_name, CAST(0 AS INT) AS part,
  concat('{"name":', to_json(name), ',"groups":[', coalesce(gs,''), '],"lines":[', coalesce(ls,''), ']}') AS content
FROM f_page p
LEFT JOIN (SELECT g.doc_id, string_agg(concat('{"name":', to_json(name), ',"rect":', CASE WHEN rx IS NULL THEN 'null' ELSE to_json({'x':rx,'y':ry,'w':rw,'h':rh}) END,
    ',"lines":[', coalesce(ls,''), ']}'), ',' ORDER BY g.group_pos) AS gs
  FROM f_group g LEFT JOIN (SELECT doc_id, group_pos, string_agg(to_json({'text':text,'confidence':confidence,'bbox':{'x':x,'y':y,'w':w,'h':h}}), ',' ORDER BY line_pos) AS ls
    FROM f_line WHERE complete GROUP BY 1,2) m ON m.doc_id=g.doc_id AND m.group_pos=g.group_pos GROUP BY 1) USING (doc_id)
LEFT JOIN (SELECT doc_id, string_agg(to_json({'text':text,'confidence':confidence,'bbox':{'x':x,'y':y,'w':w,'h':h},'polygon':NULL}), ',' ORDER BY line_id) AS ls
  FROM f_line WHERE complete GROUP BY 1) USING (doc_id)""",
    "alto_words": f"""
SELECT doc_id, line_id, word_no, word, {half_up("x")}+word_no*width AS hpos, {half_up("y")} AS vpos, width, {half_up("h")} AS height, printf('%.3f', confidence) AS wc
FROM (SELECT *, {half_up("w/len(ws)")} AS width, CAST(generate_subscripts(ws,1)-1 AS INT) AS word_no, unnest(ws) AS word FROM f_words WHERE len(ws)>0)""",
    "export_alto": f"""
SELECT p.doc_id, concat(regexp_replace(name,'\\.[^.]+$',''),'_alto.xml') AS file_name, CAST(0 AS INT) AS part,
  concat_ws(chr(10), '<?xml version="1.0" encoding="UTF-8"?>',
  '<alto xmlns="http://www.loc.gov/standards/alto/ns-v4#" xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance" xsi:schemaLocation="http://www.loc.gov/standards/alto/ns-v4# http://www.loc.gov/standards/alto/v4/alto-4-4.xsd">',
  '<Description><MeasurementUnit>pixel</MeasurementUnit>', concat('<sourceImageInformation><fileName>',{esc("name")},'</fileName></sourceImageInformation>'),
  '<Processing ID="proc_0"><processingDateTime>{Q.CREATED}</processingDateTime>', '<processingSoftware><softwareName>leafscribe</softwareName></processingSoftware>', '</Processing></Description>',
  concat('<Layout><Page ID="page_0" PHYSICAL_IMG_NR="0" WIDTH="',coalesce(rt,0),'" HEIGHT="',coalesce(bt,0),'">'), '<PrintSpace><TextBlock ID="block_0">', ls, '</TextBlock></PrintSpace></Page></Layout></alto>') AS content
FROM f_page p LEFT JOIN (
  SELECT doc_id, {half_up("min_by(x+w, i)")} AS rt, {half_up("max_by(y+h, i)")} AS bt, string_agg(line, chr(10) ORDER BY i) AS ls FROM (
    SELECT s.*, concat('<TextLine ID="line_',i,'" HPOS="',{half_up("s.x")},'" VPOS="',{half_up("s.y")},'" WIDTH="',{half_up("s.w")},'" HEIGHT="',{half_up("s.h")},'">',chr(10),coalesce(ws,''),chr(10),'</TextLine>') AS line
    FROM f_span s LEFT JOIN (SELECT doc_id, line_id, string_agg(concat('<String ID="string_',i,'_',word_no,'" CONTENT="',{esc("word")},'" HPOS="',{half_up("x")}+word_no*width,'" VPOS="',{half_up("y")},'" WIDTH="',width,'" HEIGHT="',{half_up("h")},'" WC="',printf('%.3f',confidence),'"/>'), chr(10) ORDER BY word_no) AS ws
      FROM (SELECT w.*, i, {half_up("w.w/len(ws)")} AS width, CAST(generate_subscripts(ws,1)-1 AS INT) AS word_no, unnest(ws) AS word FROM f_words w JOIN f_span USING (doc_id, line_id) WHERE len(ws)>0)
      GROUP BY 1,2) USING (doc_id, line_id)) GROUP BY 1) USING (doc_id)""",
    "page_regions": "SELECT doc_id, region, x, y, w, h, n_lines, first_line FROM f_regions",
    "export_page": f"""
SELECT p.doc_id, concat(regexp_replace(name,'\\.[^.]+$',''),'_page.xml') AS file_name, CAST(0 AS INT) AS part,
  concat_ws(chr(10), '<?xml version="1.0" encoding="UTF-8"?>',
  '<PcGts xmlns="http://schema.primaresearch.org/PAGE/gts/pagecontent/2019-07-15" xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance" xsi:schemaLocation="http://schema.primaresearch.org/PAGE/gts/pagecontent/2019-07-15 http://schema.primaresearch.org/PAGE/gts/pagecontent/2019-07-15/pagecontent.xsd">',
  '<Metadata><Creator>leafscribe</Creator><Created>{Q.CREATED}</Created></Metadata>', concat('<Page imageFilename="',{esc("name")},'">'),
  '<ReadingOrder><OrderedGroup id="reading_order">', refs, '</OrderedGroup></ReadingOrder>', body, '</Page></PcGts>') AS content
FROM f_page p LEFT JOIN (
  SELECT r.doc_id, string_agg(concat('<RegionRefIndexed index="',region,'" regionRef="region_',region,'"/>'), chr(10) ORDER BY region) AS refs,
    string_agg(concat('<TextRegion id="region_',region,'" custom="readingOrder {{index:',region,';}}">',chr(10),'<Coords points="',{corners("r.x", "r.y", "r.w", "r.h")},'"/>',chr(10),ls,chr(10),'</TextRegion>'), chr(10) ORDER BY region) AS body
  FROM f_regions r JOIN (SELECT doc_id, region, string_agg(concat('<TextLine id="line_r',region,'_l',line_no,'" custom="readingOrder {{index:',line_no,';}}">',chr(10),'<Coords points="',{corners("x", "y", "w", "h")},'"/>',chr(10),
      '<TextEquiv conf="',printf('%.3f',confidence),'"><Unicode>',{esc("text")},'</Unicode></TextEquiv>',chr(10),'</TextLine>'), chr(10) ORDER BY line_no) AS ls FROM f_placed GROUP BY 1,2) USING (doc_id, region)
  GROUP BY 1) USING (doc_id)""",
    "catalog_filter": "SELECT reference_code, archive_code, year_start FROM f_catalog WHERE year_start>=1650 AND year_start<=1800 AND archive_code='src3'",
    "catalog_fts": f"SELECT doc_id, round(score,6) AS score FROM (SELECT * FROM {DOC_HITS} ORDER BY score DESC, doc_id LIMIT {Q.TOP})",
    "catalog_vector": "SELECT query, rank, vec_id, round(score,6) AS score FROM ("
    + "SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS INT) AS rank FROM ("
    + " UNION ALL ".join(
        f"SELECT '{n}' AS query, vec_id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), {_vector(n)}) AS score FROM embeddings"
        for n in Q.query_vectors()
    )
    + f")) WHERE rank<={Q.TOP}",
    "catalog_index": r"""
SELECT term, count(*) AS n_records, CAST(sum(n) AS BIGINT) AS n_occurrences FROM (
  SELECT doc_id, term, count(*) AS n FROM (
    SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+')) AS term FROM documents)
  WHERE term <> '' GROUP BY ALL)
GROUP BY term""",
    "catalog_vector_batch": f"""
SELECT query, CAST(rank AS INT) AS rank, vec_id, round(score,6) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS rank FROM (
    SELECT CAST(q.vec_id AS VARCHAR) AS query, e.vec_id,
           list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS score
    FROM embeddings q JOIN embeddings e ON q.vec_id % 50 = 0)) WHERE rank <= {Q.TOP}""",
    "catalog_search": f"""
WITH r AS (SELECT * FROM f_catalog WHERE year_start BETWEEN {Q.SEARCH_YEARS[0]} AND {Q.SEARCH_YEARS[1]}),
t AS (SELECT reference_code, score FROM {RECORD_HITS} SEMI JOIN r USING (reference_code)),
v AS (SELECT reference_code, list_cosine_similarity(CAST(embedding AS DOUBLE[]), {_vector("q0")}) AS score FROM r JOIN embeddings ON vec_id = doc_id),
h AS (SELECT reference_code, coalesce(1.0::DOUBLE/(60+a),0)+coalesce(1.0::DOUBLE/(60+b),0) AS score
  FROM (SELECT reference_code, row_number() OVER (ORDER BY score DESC, reference_code) AS a FROM t)
  FULL JOIN (SELECT reference_code, row_number() OVER (ORDER BY score DESC, reference_code) AS b FROM v) USING (reference_code)),
every AS (SELECT 'fts' AS mode, * FROM t UNION ALL SELECT 'vector', * FROM v UNION ALL SELECT 'hybrid', * FROM h)
SELECT mode, position, reference_code, archive_code, date_text, round(score,6) AS score, total FROM (
  SELECT *, row_number() OVER (PARTITION BY mode ORDER BY score DESC, reference_code) AS position, count(*) OVER (PARTITION BY mode) AS total FROM every)
JOIN r USING (reference_code) WHERE position > {Q.PAGE_SIZE // 2} AND position <= {Q.PAGE_SIZE // 2 + Q.PAGE_SIZE}""",
    "open_records": f"""
WITH f AS (SELECT reference_code, doc_id FROM {RECORD_HITS} JOIN f_catalog USING (reference_code)),
a AS (SELECT reference_code, page_id, page_id % 12 AS n, page_id IS NULL OR page_id % 10 < 2 AS failed FROM f LEFT JOIN pages ON page_id = doc_id),
p AS (SELECT reference_code, page_id, n, unnest(CASE WHEN failed OR n = 0 THEN [NULL] ELSE range(1, n + 1) END) AS page, failed FROM a)
SELECT reference_code, CASE WHEN NOT failed THEN concat('R', lpad(CAST(page_id AS VARCHAR), 7, '0')) END AS manifest_id, CAST(page AS INT) AS page_number,
  CASE WHEN page IS NOT NULL THEN concat('R', lpad(CAST(page_id AS VARCHAR), 7, '0'), '_', lpad(CAST(page AS VARCHAR), 5, '0'), '.jpg') END AS name,
  CASE WHEN page_id % 10 = 0 THEN 'no such record' WHEN failed THEN 'Could not find IIIF manifest ID in OAI-PMH response'
       WHEN n = 0 THEN 'No pages found in this volume' END AS error
FROM p WHERE page IS NULL OR NOT (n > 4 AND page = 3)""",
    "catalog_hybrid": f"""
SELECT doc_id, text_rank, vector_rank, round(score,6) AS score FROM (
  SELECT doc_id, text_rank, vector_rank, coalesce(1.0::DOUBLE/(60+text_rank),0)+coalesce(1.0::DOUBLE/(60+vector_rank),0) AS score
  FROM (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS text_rank FROM {DOC_HITS})
  FULL JOIN (SELECT vec_id AS doc_id, row_number() OVER (ORDER BY list_cosine_similarity(CAST(embedding AS DOUBLE[]), {_vector("q0")}) DESC, vec_id) AS vector_rank FROM embeddings) USING (doc_id)
  ORDER BY score DESC, doc_id LIMIT {Q.TOP})""",
    "catalog_page": f"SELECT reference_code, round(score,6) AS score, (SELECT count(*) FROM {RECORD_HITS}) AS total FROM (SELECT * FROM {RECORD_HITS} ORDER BY score DESC, reference_code LIMIT {Q.PAGE_SIZE} OFFSET {2 * Q.PAGE_SIZE})",
    "catalog_append": f"SELECT reference_code, round(score,6) AS score, (SELECT count(*) FROM {RECORD_HITS})>{2 * Q.PAGE_SIZE} AS has_more FROM (SELECT * FROM {RECORD_HITS} ORDER BY score DESC, reference_code LIMIT {2 * Q.PAGE_SIZE})",
    "catalog_tree": """
WITH k AS (SELECT *, coalesce(nullif(fonds_title,''),reference_code) AS fonds, coalesce(series_title,'') AS series FROM f_catalog)
SELECT 'fonds' AS level, fonds, CAST(NULL AS VARCHAR) AS series, CAST(NULL AS VARCHAR) AS reference_code, min(doc_id) AS first_seen, count(*) AS n_volumes,
  min_by(fonds_description,doc_id) AS description, min_by(creator,doc_id) AS creator, min_by(archive_code,doc_id) AS archive_code FROM k GROUP BY fonds
UNION ALL SELECT 'series', fonds, series, NULL, min(doc_id), count(*), NULL, NULL, NULL FROM k GROUP BY fonds, series
UNION ALL SELECT 'volume', fonds, series, reference_code, doc_id, 1, NULL, NULL, NULL FROM k""",
    "catalog_counts": """
WITH k AS (SELECT coalesce(nullif(fonds_title,''),reference_code) AS fonds, coalesce(series_title,'') AS series FROM f_catalog)
SELECT fonds, series, count(*) AS n_volumes, false AS is_fonds FROM k GROUP BY 1,2
UNION ALL SELECT fonds, NULL, count(*), true FROM k GROUP BY 1""",
    "highlight": """
SELECT doc_id, CASE WHEN p>0 THEN substr(text,1,p-1) ELSE text END AS before, CASE WHEN p>0 THEN substr(text,p,3) ELSE '' END AS match,
  CASE WHEN p>0 THEN substr(text,p+3) ELSE '' END AS after FROM (SELECT doc_id, text, strpos(lower(text),'the') AS p FROM documents)""",
    "random_volume": f"""
SELECT reference_code, CASE WHEN doc_id%12>0 THEN CAST('0x' || substr(m,1,8) AS BIGINT)%(doc_id%12)+1 END AS page_number
FROM (SELECT *, md5(concat('{Q.SEED}:',reference_code)) AS m FROM f_catalog) ORDER BY m, reference_code LIMIT 1""",
    "catalog_titles": """
SELECT reference_code, coalesce(nullif(fonds_title,''),reference_code) AS title,
  concat(CASE WHEN series_title<>'' THEN concat(series_title,' / ') ELSE '' END, 'vol. ', volume_id, CASE WHEN date_text<>'' THEN concat(' (',date_text,')') ELSE '' END) AS subtitle FROM f_catalog""",
    "volume_metadata": """
SELECT p.doc_id, p.manifest_id, reference_code, date_text FROM f_page p LEFT JOIN (
  SELECT archive_code, max_by(reference_code,doc_id) AS reference_code, max_by(date_text,doc_id) AS date_text FROM f_catalog GROUP BY 1) m ON m.archive_code=p.manifest_id""",
    "decode_regions": f"SELECT image_id, anchor_idx, round(score,6) AS score, x, y, w, h FROM {regions_sql(0.5)}",
    "region_boxes": """
SELECT image_id, det_id, 'text_region' AS label, x, round(y,6) AS y, round(w,6) AS w, h, row_number() OVER (PARTITION BY image_id ORDER BY y, x, det_id)-1 AS position
FROM (SELECT image_id, det_id, greatest(0,x) AS x, greatest(0,y) AS y, greatest(0,w) AS w, greatest(0,h) AS h FROM f_shifted)""",
    "decode_lines": f"SELECT image_id, det_id, class_id, score, round(x,6) AS x, round(y,6) AS y, round(w,6) AS w, round(h,6) AS h FROM {LINE_BOXES.format(extra='')}",
    "pairwise_iou": f"""
SELECT d.image_id, d.det_id, b.det_id AS best_det_id, round({iou("d", "b")},6) AS iou
FROM f_det d JOIN (SELECT * FROM f_det QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY score DESC, det_id)=1) b ON b.image_id=d.image_id""",
    "nms": f"SELECT image_id, det_id, score, x, round(y,6) AS y, round(w,6) AS w, h FROM {_nms('(SELECT * FROM f_det WHERE score>=0.25)', 'image_id', 'det_id')}",
    "mask_contour": """
WITH e AS (SELECT det_id, y, min(x) AS l, max(x)+1 AS r FROM f_mask WHERE logit>=0 GROUP BY 1,2),
u AS (SELECT * FROM e WHERE det_id IN (SELECT det_id FROM e GROUP BY 1 HAVING count(*)>=2))
SELECT det_id, CAST(0 AS INT) AS side, y AS position, l AS x, y FROM u UNION ALL SELECT det_id, 1, -y, r, y FROM u""",
    "simplify_polygons": f"""
WITH RECURSIVE {_simplified("f_poly", "image_id, det_id")}
SELECT image_id, det_id, CAST(row_number() OVER (PARTITION BY image_id, det_id ORDER BY i)-1 AS INT) AS point_no, round(x,6) AS px, round(y,6) AS py FROM u""",
    "reading_order": "SELECT doc_id, line_id, row_number() OVER (PARTITION BY doc_id ORDER BY y, x, line_id)-1 AS position FROM f_line",
    "start_index": """
SELECT image_id, region_id, n_lines, CAST(coalesce(sum(n_lines) OVER (PARTITION BY image_id ORDER BY region_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS BIGINT) AS start_index
FROM (SELECT doc_id AS image_id, coalesce(group_pos,-1) AS region_id, count(*) AS n_lines FROM f_line GROUP BY 1,2)""",
    "crop_clamp": f"""
SELECT image_id, det_id, cx, cy, greatest(1,least({half_up("w")},400-cx)) AS cw, greatest(1,least({half_up("h")},150-cy)) AS ch
FROM (SELECT *, greatest(0,{half_up("x")}) AS cx, greatest(0,{half_up("y")}) AS cy FROM f_shifted)""",
    "padded_crop": """
SELECT image_id, det_id, round(px,6) AS px, round(py,6) AS py, round(least(400-px,w+24),6) AS pw, round(least(150-py,h+24),6) AS ph
FROM (SELECT *, greatest(0,x-12) AS px, greatest(0,y-12) AS py FROM f_shifted)""",
    "to_page_coords": """
SELECT image_id, det_id, x+cx AS x, round(y+cy,6) AS y, point_no, round(p.x+cx,6) AS px, round(p.y+cy,6) AS py
FROM (SELECT l.image_id, l.det_id, l.x, l.y, cx, cy, CAST(generate_subscripts(polygon,1)-1 AS INT) AS point_no, unnest(polygon) AS p
FROM f_poly l JOIN (SELECT image_id, det_id%4 AS region_id, floor(min(x)) AS cx, floor(min(y)) AS cy FROM f_poly GROUP BY 1,2) r
ON r.image_id=l.image_id AND r.region_id=l.det_id%4)""",
    "letterbox": f"""
SELECT image_id, det_id, round(scale,6) AS scale, new_w, new_h, round((640-new_w)/2,6) AS pad_x, round((640-new_h)/2,6) AS pad_y FROM (
  SELECT *, {half_up("w*10*scale")} AS new_w, {half_up("(x+300)*scale")} AS new_h FROM (SELECT *, least(640/(w*10), 640/(x+300)) AS scale FROM f_det))""",
    "point_in_polygon": """
WITH q AS (SELECT *, x+w*(det_id%5)/4 AS px, y+h*(det_id%7)/6 AS py FROM f_poly),
e AS (SELECT image_id, det_id, px, py, unnest(polygon) AS a, unnest(list_concat(polygon[-1:], polygon[:-2])) AS b FROM q)
SELECT image_id, det_id, count_if((a.y>py)<>(b.y>py) AND px < (b.x-a.x)*(py-a.y)/(b.y-a.y)+a.x)%2=1 AS inside FROM e GROUP BY 1,2""",
    "hit_test": """
SELECT p.point_id, p.doc_id, p.px, p.py, CAST(coalesce(min(l.line_id),-1) AS INT) AS hit FROM f_point p LEFT JOIN f_line l
ON l.doc_id=p.doc_id AND px BETWEEN x AND x+w AND py BETWEEN y AND y+h GROUP BY 1,2,3,4""",
    "lines_in_rect": """
SELECT rect_id, l.doc_id, line_id FROM f_rect r JOIN f_line l ON l.doc_id=r.doc_id
AND x+w/2 BETWEEN least(x1,x2) AND greatest(x1,x2) AND y+h/2 BETWEEN least(y1,y2) AND greatest(y1,y2)""",
    "group_bbox": "SELECT doc_id, group_pos, min(x) AS x, min(y) AS y, max(x+w)-min(x) AS w, max(y+h)-min(y) AS h FROM f_line WHERE group_pos IS NOT NULL GROUP BY 1,2",
    "banned_next": """
WITH g AS (SELECT seq_id, pos, token_id AS a, lead(token_id,1) OVER w AS b, lead(token_id,2) OVER w AS c, max(pos) OVER (PARTITION BY seq_id) AS mx FROM f_tokens WINDOW w AS (PARTITION BY seq_id ORDER BY pos))
SELECT DISTINCT g.seq_id, g.c AS token_id FROM g JOIN g t ON t.seq_id=g.seq_id AND t.pos=t.mx-1 AND t.a=g.a AND t.b=g.b WHERE g.c IS NOT NULL
UNION SELECT DISTINCT seq_id, 1 FROM f_tokens""",
    "greedy_pick": """
SELECT seq_id, token_id, round(score,6) AS score FROM f_logits WHERE token_id<>1 AND token_id<>(seq_id*7)%64
QUALIFY row_number() OVER (PARTITION BY seq_id ORDER BY score DESC, token_id)=1""",
    "eos_cut": """
WITH e AS (SELECT seq_id, pos, CASE WHEN (seq_id+pos)%97=96 THEN 2 ELSE token_id END AS token_id FROM f_tokens)
SELECT seq_id, pos, token_id FROM e WHERE pos<256 AND pos < coalesce((SELECT min(pos) FROM e z WHERE z.seq_id=e.seq_id AND z.token_id=2), 1000000)""",
    "vocab_load": "SELECT id, CASE WHEN id%10=0 THEN concat(word,'!') ELSE word END AS token FROM f_vocab",
    "detokenise": "SELECT seq_id, concat(' ',string_agg(word,' ' ORDER BY pos)) AS text FROM f_seq GROUP BY seq_id",
    "decode_tokens": "SELECT seq_id, pos, concat(' ',word) AS text FROM f_seq",
    "decode_timing": """
SELECT seq, region_id AS worker, line_id AS tokens, round(CASE WHEN line_id>0 THEN value/line_id ELSE 0 END,6) AS ms_per_token, round(value/4+value,6) AS total_ms
FROM f_event WHERE type='line_done'""",
    "timing_by_worker": """
SELECT region_id AS worker, count(*) AS lines, CAST(sum(line_id) AS BIGINT) AS tokens, round(avg(CASE WHEN line_id>0 THEN value/line_id ELSE 0 END),6) AS avg_ms_per_token,
  round(avg(value/4+value),6) AS avg_total_ms, round(quantile_disc(value/4+value,0.5),6) AS median_total_ms FROM f_event WHERE type='line_done' GROUP BY 1""",
    "score_lines": "SELECT vec_id, round(list_dot_product(CAST(embedding AS DOUBLE[]), list_transform(range(1,65), lambda i: i/64::DOUBLE)),6) AS score FROM embeddings",
    "flatten_page_result": """
SELECT doc_id, group_pos AS source_group, CAST(0 AS INT) AS part, CAST(0 AS INT) AS group_pos, 'text_region' AS label, 0.5::DOUBLE AS region_confidence,
  CAST(row_number() OVER (PARTITION BY doc_id, group_pos ORDER BY line_id)-1 AS INT) AS line_pos, x, y, w, h, text, confidence FROM f_line WHERE group_pos IS NOT NULL""",
    "error_sentinel": "SELECT doc_id, line_id, CASE WHEN complete THEN text ELSE '[error]' END AS text, CASE WHEN complete THEN confidence ELSE 0 END AS confidence, true AS complete FROM f_line",
    "page_transcription": f"""
WITH RECURSIVE {TRANSCRIBED},
g AS (SELECT image_id, region_id, det_id, k.cx AS ox, k.cy AS oy, (l_partkey%7+1)/2::DOUBLE AS c0, (l_suppkey%5-2)/2::DOUBLE AS c1,
    CAST(greatest(0,floor((c.cx-bw/2)*{Q.MASK_CELLS / 640}::DOUBLE)) AS INT) AS mx1, CAST(greatest(0,floor((c.cy-bh/2)*{Q.MASK_CELLS / 640}::DOUBLE)) AS INT) AS my1,
    CAST(least({Q.MASK_CELLS - 1},ceil((c.cx+bw/2)*{Q.MASK_CELLS / 640}::DOUBLE)) AS INT) AS mx2, CAST(least({Q.MASK_CELLS - 1},ceil((c.cy+bh/2)*{Q.MASK_CELLS / 640}::DOUBLE)) AS INT) AS my2
  FROM k JOIN f_cbox c USING (image_id, det_id) JOIN f_boxes USING (image_id, det_id)),
cells AS (SELECT image_id, region_id, det_id, ox, oy, y, x FROM g, unnest(range(my1, my2+1)) AS ry(y), unnest(range(mx1, mx2+1)) AS rx(x)
  WHERE c0*((image_id*31+region_id*17+y*7+x*3)%13-4)/4::DOUBLE + c1*((image_id*31+region_id*17+y*7+x*3+11)%13-4)/4::DOUBLE >= 0),
e AS (SELECT image_id, region_id, det_id, ox, oy, y, min(x) AS l, max(x)+1 AS r FROM cells GROUP BY ALL),
o AS (SELECT image_id, region_id, det_id, ox, oy, list_concat(list({{'x': l, 'y': y}} ORDER BY y), list({{'x': r, 'y': y}} ORDER BY y DESC)) AS p
  FROM e GROUP BY ALL HAVING count(*)>=2),
m AS (SELECT image_id, region_id, det_id, list_transform(p, lambda q: {{
    'x': greatest(0,least(1200::DOUBLE,(q.x/{Q.MASK_CELLS / 640}::DOUBLE-80)/(2/5::DOUBLE)))+ox,
    'y': greatest(0,least(1600::DOUBLE,(q.y/{Q.MASK_CELLS / 640}::DOUBLE-0)/(2/5::DOUBLE)))+oy}}) AS polygon FROM o),
{_simplified("m", "image_id, region_id, det_id")},
t AS (SELECT image_id, region_id, det_id, string_agg(concat({half_up("x")},',',{half_up("y")}), ' ' ORDER BY i) AS points FROM u GROUP BY 1,2,3)
SELECT image_id, region_id, group_name, line_index, text, true AS complete, round(x,6) AS x, round(y,6) AS y, round(w,6) AS w, round(h,6) AS h,
  round(score,6) AS det_confidence, round(text_confidence,8) AS text_confidence, round(coalesce(text_confidence,0),8) AS confidence, points
FROM read LEFT JOIN t USING (image_id, region_id, det_id)""",
    "page_transcription_saved": f"""
WITH {TRANSCRIBED}
SELECT concat('R',lpad(CAST(image_id//10 AS VARCHAR),7,'0')) AS manifest_id, CAST(image_id%10+1 AS INT) AS page_number, image_id AS doc_id, region_id AS group_pos, group_name,
  round(rx,6) AS group_rx, round(ry,6) AS group_ry, round(rw,6) AS group_rw, round(rh,6) AS group_rh,
  line_index, round(x,6) AS x, round(y,6) AS y, round(w,6) AS w, round(h,6) AS h, text, round(coalesce(text_confidence,0),8) AS confidence, 'htr' AS source, '' AS contributor FROM read""",
    "hydrate": """
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY group_pos, line_index)-1+doc_id%5 AS BIGINT) AS line_id, group_pos, group_name, text, confidence, true AS complete FROM (
  SELECT p.doc_id, s.group_pos, s.line_index, s.group_name, s.text, s.confidence FROM f_saved s JOIN (
    SELECT manifest_id, page_number, min(doc_id) AS doc_id FROM f_page GROUP BY 1,2 HAVING min(doc_id) NOT IN (SELECT doc_id FROM f_group WHERE group_pos>=1)) p
  ON p.manifest_id=s.manifest_id AND p.page_number=s.page_number)""",
    "new_pages": """
SELECT DISTINCT concat('src',page_id%25) AS manifest_id, n AS page_number FROM (SELECT page_id, CAST(unnest(range(1, n_pages+1)) AS INT) AS n FROM f_manifest) x
WHERE NOT EXISTS (SELECT 1 FROM f_page p WHERE p.manifest_id=concat('src',x.page_id%25) AND p.page_number=x.n)""",
    "pages_to_process": "SELECT manifest_id, doc_id, row_number() OVER (PARTITION BY manifest_id ORDER BY coalesce(page_number,0), doc_id) AS turn FROM f_counts WHERE n_lines=0 OR n_grouped=0",
    "page_nav": """
SELECT manifest_id, coalesce(page_number,0) AS page, doc_id, row_number() OVER w AS position, count(*) OVER (PARTITION BY manifest_id) AS total, lag(doc_id) OVER w AS prev_doc, lead(doc_id) OVER w AS next_doc,
  lag(doc_id) OVER w IS NOT NULL AS has_prev, lead(doc_id) OVER w IS NOT NULL AS has_next
FROM f_page WHERE manifest_id IS NOT NULL WINDOW w AS (PARTITION BY manifest_id ORDER BY coalesce(page_number,0), doc_id)""",
    "line_nav": "SELECT doc_id, line_id, lag(line_id) OVER w AS prev_line, lead(line_id) OVER w AS next_line FROM f_line WHERE group_pos IS NOT NULL WINDOW w AS (PARTITION BY doc_id ORDER BY group_pos, line_pos)",
    "progress_rollup": """
SELECT volume, doc_id, count(*) AS n_pages, CAST(sum(n_lines) AS BIGINT) AS n_lines, CAST(sum(n_complete) AS BIGINT) AS n_complete, bool_or(pending) AS working,
  CAST(count_if(n_lines>0 AND n_lines=n_complete) AS BIGINT) AS pages_done, CASE grouping(volume, doc_id) WHEN 0 THEN 'page' WHEN 1 THEN 'volume' ELSE 'workspace' END AS level,
  CAST(sum(n_lines)-sum(n_complete) AS BIGINT) AS n_pending
FROM (SELECT *, coalesce(nullif(manifest_id,''),'unnamed') AS volume FROM f_counts) GROUP BY ROLLUP (volume, doc_id)""",
    "page_complete": "SELECT doc_id, n_lines>0 AND n_lines=n_complete AS transcribed FROM f_counts",
    "filter_lines": f"SELECT doc_id, line_id, text FROM f_line WHERE contains(lower(text),'{Q.LINE_QUERY}')",
    "filter_groups": f"SELECT doc_id, group_pos, count(*) AS n_matches FROM f_line WHERE contains(lower(text),'{Q.LINE_QUERY}') AND group_pos IS NOT NULL GROUP BY 1,2",
    "filter_pages": f"SELECT p.manifest_id, doc_id, n_matches FROM f_page p JOIN (SELECT doc_id, count(*) AS n_matches FROM f_line WHERE contains(lower(text),'{Q.LINE_QUERY}') GROUP BY 1) USING (doc_id)",
    "filter_volumes": f"SELECT coalesce(manifest_id,'unnamed') AS volume, count(DISTINCT doc_id) AS n_pages, count(*) AS n_matches FROM f_line WHERE contains(lower(text),'{Q.LINE_QUERY}') GROUP BY 1",
    "group_text": rf"SELECT doc_id, group_pos, CAST(0 AS INT) AS part, string_agg(text, chr(10) ORDER BY line_pos) AS content FROM f_line WHERE group_pos IS NOT NULL AND regexp_matches(text,'{SPACE.replace('[', '[^', 1)}') GROUP BY doc_id, group_pos",
    "delete_groups": """
WITH d AS (SELECT DISTINCT image_id AS doc_id, region_id AS group_pos FROM f_event WHERE type='cancel'),
a AS (SELECT doc_id, group_pos, line_id FROM f_line UNION ALL SELECT doc_id, group_pos, -1 FROM f_group)
SELECT a.* FROM a WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.doc_id=a.doc_id AND d.group_pos=a.group_pos)""",
    "apply_edits": rf"""
WITH t AS (SELECT * FROM f_event WHERE type='token')
SELECT 'group' AS kind, doc_id, group_pos AS id, coalesce(e,name) AS value FROM f_group LEFT JOIN (
  SELECT image_id AS doc_id, region_id AS group_pos, max_by(regexp_replace(text,'^{SPACE}+|{SPACE}+$','','g'), seq) AS e FROM t WHERE regexp_matches(text,'{SPACE.replace("[", "[^", 1)}') GROUP BY 1,2) USING (doc_id, group_pos)
UNION ALL SELECT 'line', doc_id, line_id, coalesce(e,text) FROM f_line LEFT JOIN (
  SELECT image_id AS doc_id, line_id, max_by(text, seq) AS e FROM t WHERE text IS NOT NULL GROUP BY 1,2) USING (doc_id, line_id)""",
    "remove_volumes": """
SELECT p.doc_id, p.manifest_id, n_lines FROM f_page p LEFT JOIN (SELECT doc_id, count(*) AS n_lines FROM f_line GROUP BY 1) USING (doc_id)
WHERE p.manifest_id IS NULL OR NOT regexp_matches(p.manifest_id,'[25]$')""",
    "rerun_requests": """
SELECT doc_id, 'region' AS request, group_pos, rx, ry, rw, rh FROM f_page JOIN f_group USING (doc_id) WHERE rx IS NOT NULL
UNION ALL SELECT doc_id, 'page', NULL, NULL, NULL, NULL, NULL FROM f_page WHERE doc_id NOT IN (SELECT doc_id FROM f_group)""",
    "rerun_cleared": """
SELECT doc_id, line_id FROM f_line WHERE doc_id NOT IN (SELECT doc_id FROM f_page WHERE pending AND doc_id IN (SELECT doc_id FROM f_group))""",
    "confidence_bands": f"""
SELECT CASE WHEN confidence>0.7 THEN 'high' WHEN confidence>0.4 THEN 'mid' ELSE 'low' END AS band, count(*) AS n_lines, CAST(sum(p) AS BIGINT) AS sum_percent, CAST(min(p) AS INT) AS low, CAST(max(p) AS INT) AS high
FROM (SELECT *, {half_up("confidence*100")} AS p FROM f_line WHERE complete) GROUP BY 1""",
    "line_group": "SELECT doc_id, line_id, group_pos AS first_group FROM f_line",
    "region_completion": """
SELECT image_id, region_id, opened_by, seq AS completed_by, run_total AS total FROM f_run_events
WHERE epoch>0 AND ((type='line_done' AND done=run_total) OR (type='region_lines' AND total<=0))""",
    "inflight_gauge": "SELECT image_id, seq, CAST(in_flight AS BIGINT) AS in_flight FROM f_gauge",
    "active_images": """
SELECT image_id, CAST(count_if(o) AS BIGINT) AS open_regions, count_if(o)>0 AS active FROM (SELECT image_id, region_id, max_by(open_after, seq) AS o FROM f_open GROUP BY 1,2) GROUP BY 1""",
    "stage_transitions": """
SELECT image_id, seq, previous, stage FROM (SELECT *, coalesce(lag(stage) OVER (PARTITION BY image_id ORDER BY seq),'idle') AS previous FROM f_stage) WHERE stage<>previous""",
    "latest_line": """
SELECT image_id, line_id, max_by(text,seq) AS text, max_by(value,seq) FILTER (type='line_done') AS confidence, bool_or(type='line_done') AS complete
FROM f_event WHERE type IN ('token','line_done') GROUP BY 1,2""",
    "ema_eta": """
WITH RECURSIVE d AS (SELECT image_id, seq, (epoch_us(ts)/1000000.0::DOUBLE)-(epoch_us(lag(ts) OVER w)/1000000.0::DOUBLE) AS seconds, row_number() OVER w AS k, count(*) OVER (PARTITION BY image_id) AS n
  FROM f_event WHERE type='line_done' WINDOW w AS (PARTITION BY image_id ORDER BY seq)),
s AS (SELECT image_id, seq, k, n, seconds, seconds AS a FROM d WHERE k=2
  UNION ALL SELECT d.image_id, d.seq, d.k, d.n, d.seconds, CASE WHEN a=0 THEN d.seconds ELSE 0.3::DOUBLE*d.seconds+0.7::DOUBLE*a END FROM s JOIN d ON d.image_id=s.image_id AND d.k=s.k+1)
SELECT image_id, seq, round(seconds,6) AS seconds, round(a,6) AS avg, pending, eta,
  CASE WHEN eta>=60 THEN concat(eta//60,'m ',eta%60,'s') ELSE concat(eta,'s') END AS eta_text,
  CAST(floor(eta+(12-k-1)*(n/k)*a+0.5) AS BIGINT) AS run_eta
FROM (SELECT *, n-k AS pending, CAST(floor((n-k)*a+0.5) AS BIGINT) AS eta FROM s)""",
    "debounce": """
SELECT image_id, seq, strftime(ts + INTERVAL 2 HOUR, '%Y-%m-%d %H:%M:%S.%f') AS fires_at FROM (
  SELECT *, lead(ts) OVER (PARTITION BY image_id ORDER BY ts, seq) AS nx FROM f_event) WHERE nx IS NULL OR nx-ts>=INTERVAL 2 HOUR""",
    "drop_cancelled": """
SELECT image_id, region_id, seq, type FROM (SELECT *, max(CASE WHEN type='cancel' THEN seq END) OVER w AS c, max(CASE WHEN type='region_lines' THEN seq END) OVER w AS o
  FROM f_event WINDOW w AS (PARTITION BY image_id, region_id ORDER BY seq))
WHERE NOT (type IN ('token','line_done') AND c IS NOT NULL AND (o IS NULL OR c>o))""",
    "route_events": """
SELECT seq, image_id, CASE type WHEN 'region_lines' THEN 'detect' WHEN 'token' THEN 'text' WHEN 'line_done' THEN 'text' WHEN 'cancel' THEN 'control' ELSE 'status' END AS lane,
  CASE WHEN type='region_lines' THEN total END AS n_lines, CASE WHEN type IN ('token','line_done') THEN line_id END AS line,
  CASE WHEN trim(text)<>'' THEN CAST(json_extract(text,'$.k') AS BIGINT) END AS payload_k FROM f_event""",
}


def _needed(sql: str) -> list[str]:
    found: set[str] = set()
    todo = [sql]
    while todo:
        for name in re.findall(r"\bf_\w+", todo.pop()):
            if name in VIEWS and name not in found:
                found.add(name)
                todo.append(VIEWS[name])
    return [name for name in VIEWS if name in found]


def oracle(name: str) -> str:
    """Self-contained SQL of one query."""
    sql = SQL[name].strip()
    views = ",\n".join(f"{v} AS ({VIEWS[v].strip()})" for v in _needed(sql))
    if not views:
        return sql
    if sql.startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {views},\n{sql[len('WITH RECURSIVE') :]}"
    if sql.startswith("WITH"):
        return f"WITH {views},\n{sql[len('WITH') :]}"
    return f"WITH {views}\n{sql}"


def all_sql() -> dict[str, str]:
    return {name: oracle(name) for name in SQL}
