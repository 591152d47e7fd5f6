"""What the queries of the corpus operators return, said in SQL by the definition (for checks).

Nothing here sketches, hashes into bands, anchors or votes by bucket: pairs, windows and places are
all looked at, which is only possible on small tables.
"""

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

NEAR_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(doc_id, reach) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.y FROM r JOIN e ON e.x = r.reach),
c AS (SELECT doc_id, min(reach) AS component_id FROM r GROUP BY doc_id)
SELECT c.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, c.doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)
"""

REPEATS_SQL = """
WITH d AS (SELECT doc_id, hex(coalesce(text, '')) AS h, strlen(coalesce(text, '')) AS n FROM documents),
b AS (SELECT doc_id, n, b0, substr(h, 2 * b0 + 1, 2398) AS part FROM (SELECT *, unnest(range(0, greatest(n - 199, 0), 1000)) AS b0 FROM d)),
w AS (SELECT doc_id, b0 + i AS pos, md5(substr(part, 2 * i + 1, 400)) AS k FROM (SELECT *, unnest(range(0, least(1000, n - 199 - b0))) AS i FROM b)),
t AS (SELECT k FROM w GROUP BY k HAVING count(*) > 1),
m AS (SELECT doc_id, pos, CASE WHEN pos - lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) <= 200 THEN 0 ELSE 1 END AS new FROM w WHERE k IN (SELECT k FROM t)),
g AS (SELECT doc_id, pos, sum(new) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM m),
s AS (SELECT doc_id, run, min(pos) AS lo, max(pos) + 200 AS hi FROM g GROUP BY doc_id, run),
o AS (SELECT doc_id, lo, hi, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS before FROM s),
k AS (SELECT o.doc_id, sum(hi - lo) AS gone, count(*) AS spans, string_agg(substr(h, 2 * before + 1, 2 * (lo - before)), '' ORDER BY lo) AS kept, max(hi) AS last FROM o JOIN d USING (doc_id) GROUP BY o.doc_id)
SELECT d.doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""

LINES_SQL = """
WITH RECURSIVE t AS (SELECT doc_id, text, CASE WHEN coalesce(text, '') = '' THEN [] ELSE string_split(text, chr(10)) END AS ls FROM documents),
o AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS no FROM t),
q AS (SELECT line, min((doc_id, no)) AS first, strlen(line) AS n, hex(line) AS h FROM o WHERE NOT regexp_full_match(line, '[\\x20\\x09-\\x0D]*') OR strlen(line) >= 32 GROUP BY line),
f AS (SELECT row_number() OVER () AS id, * FROM q WHERE n >= 32),
-- A line within two edits holds one of three parts of the other, moved by two bytes at most.
x AS (SELECT id, n, i, (n // 3) * i + CASE WHEN n % 3 = 2 AND i = 2 THEN 1 ELSE 0 END AS p, n // 3 + CASE WHEN i >= 3 - n % 3 THEN 1 ELSE 0 END AS z, h FROM f, (SELECT unnest([0, 1, 2]) AS i)),
a AS (SELECT id, n, i, substr(h, 2 * p + 1, 2 * z) AS part FROM x),
y AS (SELECT f.id, f.h, f.n, f.n - m AS n2, i, s FROM f, (SELECT unnest([0, 1, 2]) AS m), (SELECT unnest([0, 1, 2]) AS i), (SELECT unnest([-2, -1, 0, 1, 2]) AS s)),
z AS (SELECT id, n2, i, substr(h, 2 * ((n2 // 3) * i + CASE WHEN n2 % 3 = 2 AND i = 2 THEN 1 ELSE 0 END + s) + 1, 2 * (n2 // 3 + CASE WHEN i >= 3 - n2 % 3 THEN 1 ELSE 0 END)) AS part
      FROM y WHERE (n2 // 3) * i + CASE WHEN n2 % 3 = 2 AND i = 2 THEN 1 ELSE 0 END + s >= 0 AND n2 > 0),
c AS (SELECT DISTINCT a.id AS x, z.id AS y FROM a JOIN z ON a.n = z.n2 AND a.i = z.i AND a.part = z.part AND a.id <> z.id),
l AS (SELECT x, y FROM c JOIN f a ON a.id = x JOIN f b ON b.id = y WHERE levenshtein(a.line, b.line) <= 2),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r(id, reach) AS (SELECT id, id FROM f UNION SELECT r.id, e.y FROM r JOIN e ON e.x = r.reach),
k AS (SELECT r.id, min(f.first) AS stays FROM r JOIN f ON f.id = r.reach GROUP BY r.id),
v AS (SELECT line, stays FROM k JOIN f USING (id) UNION ALL SELECT line, first FROM q WHERE n < 32),
u AS (SELECT doc_id, no, line, v.stays IS NULL OR v.stays = (doc_id, no) AS kept FROM o LEFT JOIN v USING (line)),
g AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (NOT kept) AS n_removed, string_agg(line, chr(10) ORDER BY no) FILTER (kept) AS text FROM u GROUP BY doc_id)
SELECT t.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(g.text, '')) AS kept_sha256 FROM t LEFT JOIN g USING (doc_id)
"""

MIXING_SQL = """
WITH RECURSIVE d AS (
    SELECT doc_id, source, md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k, md5(coalesce(text, '')) AS tie,
           CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size
    FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS total, CAST(1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS BIGINT) AS w FROM d GROUP BY source),
r AS (  -- by the share at which a source is full: all before it are full, and it is not
    SELECT *, sum(total) OVER () - coalesce(3 * sum(total) OVER before, 0) AS left_, sum(w) OVER () - coalesce(sum(w) OVER before, 0) AS ws
    FROM s WINDOW before AS (ORDER BY 3.0 * total / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, left_ * w >= 3 * total * ws AS full_ FROM r),
u AS (SELECT CAST(left_ AS DOUBLE) AS l, CAST(ws AS DOUBLE) AS ws FROM f WHERE NOT full_ ORDER BY left_ DESC, 3.0 * total / w LIMIT 1),
t AS (SELECT source, total, CASE WHEN full_ THEN CAST(3 * total AS DOUBLE) ELSE (SELECT l FROM u) * w / (SELECT ws FROM u) END AS target FROM f),
q AS (SELECT *, CAST(round_even(target, 0) AS BIGINT) AS quota FROM t),
p AS (SELECT *, CASE WHEN total = 0 THEN 0 ELSE quota // total END AS passes, CASE WHEN total = 0 THEN 0 ELSE quota % total END AS rest FROM q),
o AS (SELECT d.doc_id, d.size, p.total, p.target, p.passes, p.rest,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.tie ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, total AS source_size, target, CAST(passes * size + greatest(0, least(size, rest - before)) AS BIGINT) AS taken FROM o
"""

BASE32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(v >> {s} & 31 AS INTEGER) + 1, 1)" for s in (15, 10, 5, 0))
WARC_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
k AS (SELECT html, max(page_id) AS keeper, sha1(html) AS h, CAST(strlen(html) AS BIGINT) AS n FROM p GROUP BY html),
v AS (SELECT html, g, CAST('0x' || substr(h, 5 * g + 1, 5) AS BIGINT) AS v FROM (SELECT html, h, unnest(range(8)) AS g FROM k)),
d AS (SELECT html, string_agg({BASE32}, '' ORDER BY g) AS payload_digest FROM v GROUP BY html)
SELECT page_id, n AS payload_bytes, payload_digest, CASE WHEN page_id IS NOT DISTINCT FROM keeper THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id IS DISTINCT FROM keeper THEN keeper END AS refers_to
FROM p JOIN k USING (html) JOIN d USING (html)
"""


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def licenses_sql(phrases: dict, bodies: list, drift: int, cover: float) -> str:
    """phrases: {text: label}; bodies: (label, words)."""
    short = ", ".join(f"({quoted(p)}, {len(p.split())}, {quoted(label)})" for p, label in phrases.items())
    long = ", ".join(f"({i}, {quoted(label)}, {quoted(' '.join(words))})" for i, (label, words) in enumerate(bodies))
    near = "OVER (PARTITION BY doc_id, template ORDER BY diagonal)"
    return f"""
WITH w AS (SELECT doc_id, regexp_extract_all({LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
i AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM w),
p AS (SELECT doc_id, i - 1 AS pos, label FROM i JOIN (VALUES {short}) AS t(phrase, m, label) ON array_to_string(w[i:i + m - 1], ' ') = phrase),
b AS (SELECT doc_id, count(*) AS n, min(pos) AS first, max(pos) AS last, list(DISTINCT label) AS labels FROM p GROUP BY doc_id),
g AS (SELECT doc_id, i - 1 AS pos, array_to_string(w[i:i + 3], ' ') AS gram FROM i WHERE i <= len(w) - 3),
tw AS (SELECT template, label, string_split(words, ' ') AS tw FROM (VALUES {long}) AS t(template, label, words)),
tg AS (SELECT template, label, k - 1 AS spot, len(tw) - 3 AS grams, array_to_string(tw[k:k + 3], ' ') AS gram FROM (SELECT *, unnest(range(1, len(tw) - 2)) AS k FROM tw)),
m AS (SELECT doc_id, template, label, grams, spot, pos - spot AS diagonal FROM g JOIN tg USING (gram)),
d AS (SELECT DISTINCT doc_id, template, diagonal FROM m),
e AS (SELECT *, CASE WHEN diagonal - lag(diagonal) {near} <= {drift} THEN 0 ELSE 1 END AS fresh FROM d),
r AS (SELECT *, sum(fresh) {near} AS run FROM e),
s AS (SELECT doc_id, template, label, grams, run, count(DISTINCT spot) AS votes FROM m JOIN r USING (doc_id, template, diagonal) GROUP BY ALL),
c AS (SELECT doc_id, list(DISTINCT label) AS labels, max(CAST(votes AS DOUBLE) / grams) AS cover FROM s WHERE votes >= ceil(grams * {cover}) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(b.n, 0) AS BIGINT) AS n_base, CAST(b.first AS BIGINT) AS first_word, CAST(b.last AS BIGINT) AS last_word,
array_to_string(list_sort(coalesce(b.labels, [])), ',') AS base_labels, array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(c.labels, [])))), ',') AS labels,
greatest(CASE WHEN b.n > 0 THEN 0.5 ELSE 0.0 END, coalesce(c.cover, 0.0)) AS score
FROM w LEFT JOIN b USING (doc_id) LEFT JOIN c USING (doc_id)
"""
