"""DuckDB SQL of the operators that SQL can express."""

WORD = r"[^\x20\x09-\x0D]+"

OP2 = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT rid, i, ws[i:i+7] AS win FROM (SELECT rid, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS n FROM g) WHERE n > 1),
rep AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY rid),
m AS (SELECT w.rid, doc_id, lang, source, len(ws)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
  (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, (length(text) - length(replace(text, '!', '')))::BIGINT AS n_shouts,
  len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN rep USING (rid)),
v AS (SELECT rid, lang, source, unnest(['word_length', 'symbols', 'dup_lines', 'repeats', 'shouting']) AS metric,
  unnest([floor(1000.0::DOUBLE * word_chars / n_words)::BIGINT, floor(1000.0::DOUBLE * n_symbols / n_words)::BIGINT, floor(1000.0::DOUBLE * n_dup_lines / n_lines)::BIGINT, floor(1000.0::DOUBLE * n_repeat_words / n_words)::BIGINT, floor(1000.0::DOUBLE * n_shouts / n_words)::BIGINT]) AS val FROM m WHERE n_words > 0),
b AS (SELECT *, val - val % (1::BIGINT << greatest(length(bin(val)) - 10, 0)::INT) AS bucket FROM v),
h AS (SELECT metric, lang, source, bucket, count(*) AS n FROM b GROUP BY ALL), ha AS (SELECT metric, bucket, sum(n) AS n, sum(sum(n)) OVER (PARTITION BY metric) AS rows FROM h GROUP BY metric, bucket),
hl AS (SELECT metric, lang, bucket, sum(n) AS n FROM h GROUP BY ALL), sl AS (SELECT metric, lang, sum(n) AS rows FROM hl GROUP BY ALL),
wl AS (SELECT sl.metric, sl.lang, ha.bucket, coalesce(hl.n, 0)::HUGEINT * ha.rows + 200 * ha.n AS w, ha.rows * (sl.rows + 200)::HUGEINT AS scale FROM sl JOIN ha ON sl.metric = ha.metric LEFT JOIN hl ON hl.metric = sl.metric AND hl.lang IS NOT DISTINCT FROM sl.lang AND hl.bucket = ha.bucket),
wg AS (SELECT g.metric, g.lang, g.source, wl.bucket, coalesce(h.n, 0)::HUGEINT * wl.scale + 200 * wl.w AS w FROM (SELECT DISTINCT metric, lang, source FROM h) g JOIN wl ON wl.metric = g.metric AND wl.lang IS NOT DISTINCT FROM g.lang
  LEFT JOIN h ON h.metric = g.metric AND h.lang IS NOT DISTINCT FROM g.lang AND h.source IS NOT DISTINCT FROM g.source AND h.bucket = wl.bucket),
c AS (SELECT *, sum(w) OVER (PARTITION BY metric, lang, source ORDER BY bucket) AS upto, sum(w) OVER (PARTITION BY metric, lang, source) AS rows FROM wg),
t AS (SELECT metric, lang, source, min(bucket) FILTER (4 * upto >= rows) AS q1, min(bucket) FILTER (4 * upto >= 3 * rows) AS q3, CASE metric WHEN 'word_length' THEN 400 WHEN 'symbols' THEN 20 WHEN 'dup_lines' THEN 90 WHEN 'repeats' THEN 60 ELSE 40 END AS spread FROM c GROUP BY metric, lang, source),
ok AS (SELECT v.rid, bool_and(v.val <= t.q3 + 4 * greatest(t.q3 - t.q1, t.spread) AND (v.metric <> 'word_length' OR v.val >= t.q1 - 4 * greatest(t.q3 - t.q1, t.spread))) AS fine
  FROM v JOIN t ON v.metric = t.metric AND v.lang IS NOT DISTINCT FROM t.lang AND v.source IS NOT DISTINCT FROM t.source GROUP BY v.rid)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
  CASE WHEN n_words < 20 OR 100 * n_repeat_words > 30 * n_words THEN false ELSE fine END AS kept FROM m LEFT JOIN ok USING (rid)
"""

OP8 = r"""
WITH c AS (SELECT conv_id, list(struct_pack(role := coalesce(role, 'unknown'), text := coalesce(text, '')) ORDER BY turn NULLS FIRST, coalesce(role, 'unknown'), coalesce(text, '')) AS t
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
r AS (SELECT *, list_filter(range(1, len(t) + 1), lambda i: t[i].role = 'assistant') AS ix FROM c),
m AS (SELECT *, ix[(len(ix) + 1) // 2] AS here, CASE WHEN len(ix) > 1 THEN t[ix[(len(ix) + 1) // 2 + 1]].text ELSE '' END AS other FROM r),
p AS (SELECT conv_id, t AS a, CASE WHEN here IS NULL THEN t ELSE list_transform(range(1, len(t) + 1), lambda i: CASE WHEN i = here THEN struct_pack(role := 'assistant', text := other) ELSE t[i] END) END AS b, here FROM m),
n AS (SELECT *, CASE WHEN here IS NULL OR a[here] = b[here] THEN len(a) ELSE here - 1 END AS n FROM p),
s AS (SELECT conv_id, n, a[1:n] AS head, a[n + 1:] AS ca, b[n + 1:] AS cb FROM n),
e AS (SELECT *, list_transform(ca, lambda x: length(x.role) + 5 + length(x.text) + 8) AS la, list_transform(cb, lambda x: length(x.role) + 5 + length(x.text) + 8) AS lb FROM s)
SELECT conv_id, n::BIGINT AS prompt_turns,
  coalesce(array_to_string(list_transform(head, lambda x: '<|' || x.role || '|>' || chr(10) || x.text || '<|end|>' || chr(10)), ''), '') AS prompt,
  coalesce(array_to_string(list_transform(ca, lambda x: '<|' || x.role || '|>' || chr(10) || x.text || '<|end|>' || chr(10)), ''), '') AS chosen,
  coalesce(array_to_string(list_transform(list_filter(range(1, len(ca) + 1), lambda i: ca[i].role = 'assistant'), lambda i: (coalesce(list_sum(la[1:i - 1]), 0) + 14)::BIGINT || '-' || coalesce(list_sum(la[1:i]), 0)::BIGINT), ','), '') AS chosen_mask,
  coalesce(array_to_string(list_transform(cb, lambda x: '<|' || x.role || '|>' || chr(10) || x.text || '<|end|>' || chr(10)), ''), '') AS rejected,
  coalesce(array_to_string(list_transform(list_filter(range(1, len(cb) + 1), lambda i: cb[i].role = 'assistant'), lambda i: (coalesce(list_sum(lb[1:i - 1]), 0) + 14)::BIGINT || '-' || coalesce(list_sum(lb[1:i]), 0)::BIGINT), ','), '') AS rejected_mask
FROM e
"""

OP6 = r"""
WITH RECURSIVE r AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
  ('0x' || substr(md5('7|' || coalesce(doc_id::VARCHAR, '~')), 1, 8))::BIGINT AS key FROM documents),
m AS (SELECT greatest(256, 2 ** ceil(log2(greatest(count(*), 1)) / 2))::BIGINT AS m FROM r),
d AS (SELECT r.*, key % m AS block, row_number() OVER () AS rid FROM r, m),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
k AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM s),
w AS (SELECT *, ([5, 2, 1])[(rank % 3 + 1)::INT] AS weight, 2 * source_size AS lim FROM k),
l AS (SELECT *, lim / weight::DOUBLE AS per, (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE - coalesce(sum(lim) OVER o, 0)::DOUBLE) / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0))::DOUBLE AS lvl
  FROM w WINDOW o AS (ORDER BY lim / weight::DOUBLE, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT lvl AS final FROM l ORDER BY (weight * lvl <= lim) DESC, per, rank LIMIT 1),
g AS (SELECT source, rank, source_size, least(lim::DOUBLE, weight * final) AS target FROM l, f),
b AS (SELECT source, block, sum(size)::BIGINT AS words FROM d GROUP BY source, block),
q AS (SELECT b.source, b.block, b.words, g.source_size, g.target, row_number() OVER p AS place, (sum(b.words) OVER p)::BIGINT AS upto,
  floor(g.target / greatest(g.source_size, 1))::INT AS passes FROM b JOIN g ON b.source IS NOT DISTINCT FROM g.source WINDOW p AS (PARTITION BY g.rank ORDER BY md5('7|' || g.rank || '|' || b.block)[1:8], b.block)),
z AS (SELECT *, target - passes * source_size AS rest FROM q),
c AS (SELECT source, block, place, source_size, target, passes + (upto <= rest AND passes < 2)::INT AS copies, CASE WHEN (upto > rest OR passes >= 2) AND upto - words < rest THEN rest - (upto - words) ELSE 0 END AS owed FROM z),
t AS (SELECT d.*, c.place, c.source_size, c.target, c.copies, c.owed FROM d JOIN c ON d.source IS NOT DISTINCT FROM c.source AND d.block = c.block),
u AS (SELECT *, coalesce(size <= owed AND sum(CASE WHEN size <= owed THEN size ELSE 0 END) OVER (PARTITION BY source, block ORDER BY key, doc_id, size, rid ROWS UNBOUNDED PRECEDING) <= owed, false) AS fits FROM t WHERE owed > 0),
o AS (SELECT source, max(owed) - sum(CASE WHEN fits THEN size ELSE 0 END) AS owing, max(place) AS cut_place FROM u GROUP BY source),
v AS (SELECT t.*, o.owing FROM t JOIN o ON t.source IS NOT DISTINCT FROM o.source LEFT JOIN u ON t.rid = u.rid WHERE t.place >= o.cut_place AND t.size BETWEEN 1 AND o.owing AND NOT coalesce(u.fits, false)),
h AS (SELECT source, size, count(*) AS n, max(owing) AS owing, row_number() OVER (PARTITION BY source ORDER BY size DESC) AS i FROM v GROUP BY source, size),
x AS (SELECT source, 1 AS i, max(owing) AS owing, 0::BIGINT AS size, 0::BIGINT AS n FROM h GROUP BY source
  UNION ALL SELECT h.source, x.i + 1, x.owing - least(h.n, floor(x.owing / h.size)) * h.size, h.size, least(h.n, floor(x.owing / h.size))::BIGINT FROM x JOIN h ON x.source IS NOT DISTINCT FROM h.source AND x.i = h.i),
y AS (SELECT v.rid, row_number() OVER (PARTITION BY v.source, v.size ORDER BY v.place, v.key, v.doc_id, v.rid) <= x.n AS more FROM v JOIN x ON v.source IS NOT DISTINCT FROM x.source AND v.size = x.size)
SELECT t.doc_id, t.size, t.source_size, t.target, ((t.copies + coalesce(u.fits, false)::INT + coalesce(y.more, false)::INT) * t.size)::BIGINT AS taken FROM t LEFT JOIN u ON t.rid = u.rid LEFT JOIN y ON t.rid = y.rid
"""

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP3 = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, 'null') AS item, regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
w AS (SELECT DISTINCT item, n, ws[i:i + n - 1] AS win FROM (SELECT item, ws, least(len(ws), 13) AS n, unnest(range(1, len(ws) - least(len(ws), 13) + 2)) AS i FROM b WHERE len(ws) > 0)),
k AS (SELECT DISTINCT n FROM w),
g AS (SELECT rid, i, n, ws[i:i + n - 1] AS win FROM (SELECT rid, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, k WHERE len(ws) >= n)),
h AS (SELECT rid, i, g.n AS n, item FROM g JOIN w ON g.win = w.win),
c AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT rid, i, n FROM h)) GROUP BY rid),
t AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT rid, item FROM h) GROUP BY rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  (coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws)) AS contaminated FROM d LEFT JOIN c USING (rid) LEFT JOIN t USING (rid)
"""

OP7 = r"""
WITH d AS (SELECT doc_id, hex(coalesce(text, '')) AS h FROM documents),
w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS g FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS i FROM d WHERE length(h) >= 100)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS least FROM w) WHERE least < doc_id),
x AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS new FROM r)),
s AS (SELECT doc_id, run, min(i) AS a, max(i) + 50 AS z FROM x GROUP BY doc_id, run),
n AS (SELECT doc_id, sum(z - a)::BIGINT AS n_removed, count(*) AS n_spans FROM s GROUP BY doc_id),
q AS (SELECT doc_id, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS f, a AS t FROM s UNION ALL SELECT doc_id, max(z), NULL FROM s GROUP BY doc_id),
k AS (SELECT q.doc_id, string_agg(CASE WHEN t IS NULL THEN substr(h, 2 * f + 1) ELSE substr(h, 2 * f + 1, 2 * (t - f)) END, '' ORDER BY f) AS h FROM q JOIN d ON q.doc_id = d.doc_id GROUP BY q.doc_id)
SELECT d.doc_id, (length(d.h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(k.h, d.h))) AS kept_sha256
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN k ON d.doc_id = k.doc_id
"""

OP9 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOW}, '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')] ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) END AS sh FROM d),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s),
p AS (SELECT a.doc_id AS u, b.doc_id AS v FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
l AS (SELECT u, v FROM p UNION ALL SELECT v, u FROM p),
c AS (SELECT doc_id AS root, doc_id AS node FROM d UNION SELECT root, v FROM c JOIN l ON node = u),
m AS (SELECT node, min(root) AS component_id FROM c GROUP BY node)
SELECT doc_id, len(sh)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN m ON doc_id = node
"""

SQL = {"op2_quality_rules": OP2, "op3_decontaminate": OP3, "op6_mix_sources": OP6, "op7_suffix_dedup": OP7, "op8_preference_chat": OP8, "op9_minhash_dedup": OP9}
