"""Checking SQL of the operators that SQL can express."""

ORACLES: dict[str, str] = {}

ORACLES["op9_mixing"] = """
WITH d AS (
  SELECT doc_id, source,
    coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size
  FROM documents),
k AS (
  SELECT *, length(bin(size)) * 8 + (size >> greatest(length(bin(size)) - 3, 0)) AS klass,
    floor((('0x' || substr(md5('mix-1:' || doc_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE) * 32) AS part
  FROM d),
r AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY klass, part, size, doc_id) AS i
  FROM k),
s AS (
  SELECT source, source_size,
    ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS w
  FROM (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source)),
c AS (
  SELECT a.*, (SELECT coalesce(sum(least(3.0::DOUBLE * b.source_size, b.w * (3.0::DOUBLE * a.source_size) / a.w)), 0) FROM s b) AS at_cap,
    (SELECT sum(source_size) FROM s)::DOUBLE AS words
  FROM s a),
full_ AS (SELECT *, at_cap < words AS capped FROM c),
lvl AS (
  SELECT (max(words) - coalesce(sum(3.0::DOUBLE * source_size) FILTER (capped), 0))
    / sum(w) FILTER (NOT capped) AS level FROM full_),
t AS (
  SELECT source, source_size,
    CASE WHEN capped THEN 3.0::DOUBLE * source_size ELSE level * w END AS target,
    ('0x' || substr(md5('mix-1:' || coalesce(source, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u
  FROM full_, lvl)
SELECT doc_id, size, source_size, target,
  (floor(u + i * (target / source_size)) - floor(u + (i - 1) * (target / source_size)))::BIGINT AS copies,
  ((floor(u + i * (target / source_size)) - floor(u + (i - 1) * (target / source_size))) * size)::BIGINT AS taken
FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source
"""

ORACLES["op7_decontaminate"] = """
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
iw AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM benchmark),
ds AS (SELECT DISTINCT doc_id, unnest([array_to_string(w[i:i+4], ' ') FOR i IN range(1, greatest(len(w) - 3, 1))]) AS s FROM dw),
si AS (SELECT DISTINCT item_id, unnest([array_to_string(w[i:i+4], ' ') FOR i IN range(1, greatest(len(w) - 3, 1))]) AS s FROM iw),
n AS (SELECT item_id, count(*) AS n_shingles FROM si GROUP BY item_id),
f AS (SELECT doc_id, item_id, count(*) AS n_found FROM ds JOIN si USING (s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_shingles, n_found, n_found::DOUBLE / n_shingles AS containment
FROM f JOIN n USING (item_id) WHERE 100 * n_found >= 80 * n_shingles
"""

ORACLES["op1_substring_dedup"] = """
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) AS w FROM documents),
win AS (SELECT doc_id, unnest(range(1, greatest(len(w) - 11, 1))) AS i FROM d),
k AS (SELECT win.doc_id, i, array_to_string(w[i:i+12], ' ') AS s FROM win JOIN d USING (doc_id)),
m AS (SELECT s, min(doc_id) AS least FROM k GROUP BY s),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM k JOIN m USING (s) WHERE least < doc_id),
g AS (SELECT doc_id, list(i) AS cut FROM gone GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(cut), 0)::BIGINT AS n_removed,
  sha256(array_to_string(CASE WHEN cut IS NULL THEN w ELSE [x FOR x, j IN w IF NOT list_contains(cut, j)] END, ' ')) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id)
"""

ORACLES["op3_jaccard_join"] = """
WITH RECURSIVE d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+'), []) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ') || '|'] ELSE [array_to_string(w[i:i+4], ' ') FOR i IN range(1, len(w) - 3)] END) AS s FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (s) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
r(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
SELECT d.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(r.b) AS component_id
FROM d JOIN r ON r.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id
"""

ORACLES["op12_filter_audit"] = """
WITH RECURSIVE d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w, min(doc_id) OVER (PARTITION BY text) AS least FROM d),
f AS (SELECT doc_id, part,
    (len(w) < 50)::INT + 2 * (100 * len(list_distinct(w)) < 65 * len(w))::INT
    + 4 * (100 * len(regexp_extract_all(text, '[A-Z]')) > 5 * length(text))::INT
    + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * (doc_id > least)::INT AS flags FROM w),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
n AS (SELECT part, flags, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic
  FROM f LEFT JOIN l USING (doc_id) GROUP BY part, flags),
o(filter_order, used) AS (SELECT '', 0 UNION ALL
  SELECT filter_order || chr(65 + i::INT), used | (1 << i::INT) FROM o, range(5) r(i) WHERE used & (1 << i::INT) = 0),
s AS (SELECT filter_order, k::INT AS step, 1 << (ascii(filter_order[k]) - 65) AS own,
    coalesce(list_sum([1 << (ascii(c) - 65) FOR c IN string_split(filter_order[1:k-1], '') IF c <> '']), 0)::INT AS before
  FROM o, range(1, 6) r(k) WHERE length(filter_order) = 5),
c AS (SELECT part, filter_order, step, own,
    sum(n) FILTER (flags & (own | before) = 0) AS kept,
    sum(n) FILTER (flags & own <> 0 AND flags & before = 0) AS removed,
    sum(n) FILTER (flags & own <> 0 AND flags & before <> 0) AS redundant,
    sum(n) FILTER (flags = own) AS unique_fails,
    sum(good) FILTER (flags & own <> 0 AND flags & before = 0) AS good_lost,
    sum(toxic) FILTER (flags & own <> 0 AND flags & before = 0) AS toxic_lost
  FROM n, s GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed,
  coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
  coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
  (sum(coalesce(removed, 0)) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM c
"""

ORACLES["op11_prefix_trie"] = """
WITH o AS (
  SELECT conv_id AS c, struct_pack(r := coalesce(role, ''), t := coalesce(text, '')) AS turn,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
k AS (SELECT c, max(pos) AS n FROM o GROUP BY c),
tab AS (SELECT list(y ORDER BY x0) AS t FROM (
  SELECT range AS x0, list_reduce(list_prepend(range, range(8)), lambda v, j: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END) AS y FROM range(256))),
h AS (SELECT c, xor(list_reduce(list_prepend(4294967295, [ascii(x)::BIGINT FOR x IN string_split(c::VARCHAR, '')]),
    lambda v, b: xor(v >> 8, t[1 + (xor(v, b) & 255)])), 4294967295) % 6 AS h FROM k, tab),
cv AS (SELECT c, h, c - c % 100 AS head FROM h),
b AS (
  SELECT cv.c, o.pos, o.turn FROM cv JOIN o ON o.c = cv.head AND o.pos <= cv.h
  UNION ALL SELECT cv.c, 1000 + o.pos, o.turn FROM cv JOIN o ON o.c = cv.c AND o.pos > cv.h),
r AS (SELECT cv.c, coalesce(l, []) AS l FROM cv LEFT JOIN (SELECT c, list(turn ORDER BY pos) AS l FROM b GROUP BY c) USING (c)),
p AS (SELECT c, len(l) AS n, d, l[1:d] AS path FROM (SELECT c, l, unnest(range(0, len(l) + 1)) AS d FROM r)),
m AS (SELECT path, d, min(c) AS conv, count(*) AS n_convs,
    (n_convs - 1) * CASE WHEN d = 0 THEN 0 ELSE length(any_value(path[d].t)) END AS own,
    coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (n = d), '') AS ends FROM p GROUP BY path, d),
kids AS (SELECT path[1:d-1] AS path, count(*) AS n FROM m WHERE d > 0 GROUP BY 1),
e AS (SELECT m.*, coalesce(kids.n, 0) AS n_children FROM m LEFT JOIN kids USING (path)),
s AS (SELECT up, sum(own) AS saved, count(*) FILTER (n_children = 0) AS leaves
  FROM (SELECT path[1:unnest(range(0, d + 1))] AS up, own, n_children FROM e) GROUP BY up)
SELECT e.conv AS conv_id, e.d AS depth, par.conv AS parent_conv_id, e.n_convs, e.n_children, s.leaves AS n_leaves,
  s.saved::BIGINT AS saved_tokens, sha256(e.ends) AS ends_sha256
FROM e JOIN s ON s.up = e.path LEFT JOIN m par ON e.d > 0 AND par.path = e.path[1:e.d-1]
"""
