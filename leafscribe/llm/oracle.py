"""SQL of the same results for DuckDB, where SQL can express them."""

SQL: dict[str, str] = {}

SQL["op1_exact_dedup"] = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""

_LETTERS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

SQL["op4_decontaminate"] = rf"""
WITH item AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id,
         regexp_extract_all(translate(text, {_LETTERS}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n,
         array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS words
  FROM item, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS r(i) WHERE len(w) > 0),
doc AS (
  SELECT doc_id,
         regexp_extract_all(translate(coalesce(text, ''), {_LETTERS}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
places AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS words
  FROM doc, (SELECT DISTINCT n FROM win), unnest(range(1, len(w) - n + 2)) AS r(i)),
hit AS (SELECT doc_id, i, n, item_id FROM places JOIN win USING (n, words)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hit, unnest(range(i, i + n)) AS r(p) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def _strength(groups: str) -> str:
    return f"""(
  SELECT CASE WHEN g < 2 OR v <= 0 OR n - nn / n - (g - 1) <= 0 THEN 2.0
              ELSE 1 / least(greatest((b - n * m * m - (g - 1) * v) / (v * (n - nn / n - (g - 1))), 0.001), 0.999) - 1 END
  FROM (SELECT g, n, nn, b, m, m * (1 - m) AS v FROM (
    SELECT count(*) AS g, CAST(sum(n) AS DOUBLE) AS n, sum(CAST(n AS DOUBLE) * n) AS nn,
           sum(CAST(k AS DOUBLE) * k / n) AS b, CAST(sum(k) AS DOUBLE) / sum(n) AS m FROM {groups} WHERE n > 0)))"""


SQL["op10_url_filter"] = rf"""
WITH cut AS (
  SELECT page_id, coalesce(CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) END, '') AS u FROM pages),
split AS (
  SELECT page_id, translate(regexp_extract(u, '^[^/?#]*'), {_LETTERS}) AS host,
         regexp_extract(regexp_replace(u, '^[^/?#]*', ''), '^[^?#]*') AS path FROM cut),
rules(verdict, rule_host, rule_path) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'),
  ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
ruled AS (
  SELECT page_id, host, path,
         arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
         arg_max(verdict, length(rule_host || rule_path)) AS decided
  FROM split LEFT JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY page_id, host, path),
hosts AS (
  SELECT host, count(decided) AS n, count(*) FILTER (decided = 'block') AS k,
         regexp_extract(host, '[^.]*\.?[^.]*$') AS domain, regexp_extract(host, '[^.]*$') AS suffix
  FROM ruled GROUP BY host),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM hosts GROUP BY domain, suffix),
suffixes AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM domains GROUP BY suffix),
s1 AS (SELECT suffix, (k + t * m) / (n + t) AS mean FROM suffixes, (SELECT {_strength("suffixes")} AS t),
  (SELECT CAST(sum(k) + 1 AS DOUBLE) / (sum(n) + 2) AS m FROM suffixes)),
s2 AS (SELECT domain, (k + t * mean) / (n + t) AS mean FROM domains JOIN s1 USING (suffix),
  (SELECT {_strength("domains")} AS t)),
s3 AS (SELECT host, k + t * mean AS a, n - k + t * (1 - mean) AS b FROM hosts JOIN s2 USING (domain),
  (SELECT {_strength("hosts")} AS t)),
bound AS (SELECT host, a / (a + b) - 1.645 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) AS bound FROM s3)
SELECT page_id, host, path, rule,
       coalesce(decided, CASE WHEN bound > 0.5 THEN 'block' ELSE 'allow' END) AS verdict
FROM ruled JOIN bound USING (host)
"""

SQL["op9_substring_dedup"] = r"""
WITH doc AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS h FROM doc, unnest(range(1, len(w) - 33)) AS r(i)),
twice AS (SELECT h FROM win GROUP BY h HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, p FROM win JOIN twice USING (h), unnest(range(i, i + 35)) AS r(p)),
removed AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed,
       sha256(coalesce(array_to_string(CASE WHEN ps IS NULL THEN w ELSE
         list_transform(list_filter(range(1, len(w) + 1), lambda p: NOT list_contains(ps, p)), lambda p: w[p]) END, ' '), '')) AS kept_sha256
FROM doc LEFT JOIN removed USING (doc_id)
"""


def _field(column: str) -> str:
    return f"coalesce(strlen(CAST({column} AS VARCHAR)) || ':' || CAST({column} AS VARCHAR), '-')"


def _crc32(text: str) -> str:
    """CRC-32 of a string of ASCII characters, bit by bit; 3988292384 is the reversed polynomial."""
    return f"""xor(4294967295::BIGINT, list_reduce(range(0, 8 * length({text})), lambda c, i:
      xor((CASE WHEN i % 8 = 0 THEN xor(c, ascii({text}[i // 8 + 1])::BIGINT) ELSE c END) >> 1,
          3988292384 * ((CASE WHEN i % 8 = 0 THEN xor(c, ascii({text}[i // 8 + 1])::BIGINT) ELSE c END) & 1)), 4294967295::BIGINT))"""


SQL["op11_merkle_manifest"] = f"""
WITH RECURSIVE
leaves AS (
  SELECT doc_id, source, sha256(head || {_field("text")}) AS leaf,
         sha256(head || {_field("CASE WHEN bad THEN replace(text, chr(10), '') ELSE text END")}) AS claimed
  FROM (SELECT *, {_field("doc_id")} || {_field("source")} || {_field("lang")} || {_field("n_chars")} AS head,
               coalesce({_crc32("CAST(doc_id AS VARCHAR)")} % 2 = 0, false) AS bad FROM documents)),
placed AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p FROM leaves),
nodes(source, lvl, p, h, n) AS (
  SELECT source, 0, p, leaf, count(*) OVER (PARTITION BY source) FROM placed
  UNION ALL
  SELECT source, lvl + 1, p // 3, sha256(string_agg(h, '' ORDER BY p)), (any_value(n) + 2) // 3
  FROM nodes WHERE n > 1 GROUP BY source, lvl, p // 3),
subroots AS (SELECT source, h AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS sp FROM nodes WHERE n = 1),
tops(lvl, p, h, n) AS (
  SELECT 0, sp, subroot, count(*) OVER () FROM subroots
  UNION ALL
  SELECT lvl + 1, p // 3, sha256(string_agg(h, '' ORDER BY p)), (any_value(n) + 2) // 3
  FROM tops WHERE n > 1 GROUP BY lvl, p // 3),
sides AS (
  SELECT a.source, a.lvl, a.p, coalesce(string_agg(b.h, '' ORDER BY b.p) FILTER (b.p < a.p), '') AS before,
         coalesce(string_agg(b.h, '' ORDER BY b.p) FILTER (b.p > a.p), '') AS after
  FROM nodes a JOIN nodes b ON a.source IS NOT DISTINCT FROM b.source AND a.lvl = b.lvl AND a.p // 3 = b.p // 3
  WHERE a.n > 1 GROUP BY ALL),
top_sides AS (
  SELECT a.lvl, a.p, coalesce(string_agg(b.h, '' ORDER BY b.p) FILTER (b.p < a.p), '') AS before,
         coalesce(string_agg(b.h, '' ORDER BY b.p) FILTER (b.p > a.p), '') AS after
  FROM tops a JOIN tops b ON a.lvl = b.lvl AND a.p // 3 = b.p // 3 WHERE a.n > 1 GROUP BY ALL),
lower AS (
  SELECT l.source, l.p, list(before || '|' || after ORDER BY s.lvl) FILTER (s.lvl IS NOT NULL) AS w
  FROM placed l LEFT JOIN sides s ON l.source IS NOT DISTINCT FROM s.source AND s.p = l.p // CAST(pow(3, s.lvl) AS BIGINT)
  GROUP BY ALL),
upper AS (
  SELECT r.source, r.subroot, list(before || '|' || after ORDER BY s.lvl) FILTER (s.lvl IS NOT NULL) AS w
  FROM subroots r LEFT JOIN top_sides s ON s.p = r.sp // CAST(pow(3, s.lvl) AS BIGINT) GROUP BY ALL),
whole AS (
  SELECT l.doc_id, l.leaf, l.claimed, u.subroot, list_concat(coalesce(o.w, []), coalesce(u.w, [])) AS w
  FROM placed l JOIN lower o ON l.source IS NOT DISTINCT FROM o.source AND l.p = o.p
  JOIN upper u ON l.source IS NOT DISTINCT FROM u.source),
done AS (
  SELECT doc_id, leaf, subroot, (SELECT h FROM tops WHERE n = 1) AS root,
         sha256(replace(array_to_string(w, ''), '|', '')) AS proof_sha256,
         list_reduce(w, lambda node, s: sha256(split_part(s, '|', 1) || node || split_part(s, '|', 2)), claimed) AS folded_root
  FROM whole)
SELECT *, folded_root = root AS verified FROM done
"""

SQL["op12_exact_topk"] = """
WITH vectors AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS units FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.units, c.units) AS BIGINT) AS score
  FROM vectors q JOIN vectors c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM scores
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 10
"""

SQL["op13_spelling_variants"] = rf"""
WITH RECURSIVE
steps AS (  -- CRC-32 of each byte value; 3988292384 is the reversed polynomial
  SELECT list(list_reduce(range(0, 8), lambda c, i: xor(c >> 1, 3988292384 * (c & 1)), byte) ORDER BY byte) AS t
  FROM unnest(range(0, 256)) AS r(byte)),
runs AS (
  SELECT doc_id, run, count(*) AS c FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, {_LETTERS}), '[a-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents)
  GROUP BY ALL),
hashed AS (
  SELECT run, c, length(run) AS len, xor(4294967295::BIGINT, list_reduce(range(0, strlen(doc_id || ':' || run)), lambda x, i:
    xor(x >> 8, t[(xor(x, 16 * (instr('0123456789ABCDEF', h[2 * i + 1]) - 1) + instr('0123456789ABCDEF', h[2 * i + 2]) - 1) & 255) + 1]),
    4294967295::BIGINT)) AS crc
  FROM (SELECT *, hex(doc_id || ':' || run) AS h FROM runs), steps),
words AS (
  SELECT word, CAST(sum(c) AS BIGINT) AS n FROM (
    SELECT c, CASE WHEN crc % 97 = 0 THEN substr(run, 1, crc % len) || substr(run, crc % len + 2) ELSE run END AS word FROM hashed)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(c) >= 3),
less AS (
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM words, unnest(range(1, length(word) + 1)) AS r(i)),
near AS (
  SELECT DISTINCT a.word, b.word AS near, b.n FROM less a JOIN less b USING (i, rest) WHERE a.word <> b.word
  UNION ALL
  SELECT DISTINCT a.word, b.word, b.n FROM less a JOIN words b ON a.rest = b.word
  UNION ALL
  SELECT DISTINCT b.word, a.word, a.n FROM less a JOIN words b ON a.rest = b.word),
best AS (
  SELECT word, count(*) AS n_near, first(near ORDER BY n DESC, near) AS near, max(n) AS near_n FROM near GROUP BY word),
forms AS (
  SELECT w.word, CASE WHEN near_n >= 2 * w.n THEN near END AS form, w.n, coalesce(n_near, 0) AS n_near,
         CASE WHEN near_n >= 2 * w.n THEN near_n END AS form_n FROM words w LEFT JOIN best b ON w.word = b.word),
paths(word, reached) AS (
  SELECT word, word FROM forms
  UNION ALL SELECT p.word, f.form FROM paths p JOIN forms f ON p.reached = f.word WHERE f.form IS NOT NULL)
SELECT f.word, f.form, p.reached AS root, f.n, f.n_near, f.form_n
FROM forms f JOIN paths p ON f.word = p.word JOIN forms last ON last.word = p.reached WHERE last.form IS NULL
"""
