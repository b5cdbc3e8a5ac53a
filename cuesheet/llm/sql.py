"""DuckDB SQL for the queries that SQL can express on whole tables."""


def _vector_codes(rounds: int = 4) -> str:
    """A part is a list of doubles that hold integers, so that distances below 2^53 are exact."""
    near = "(SELECT r, p, arg_min(e, d * 256 + e) AS e, min(d) AS d FROM (SELECT r, x.p, e, CAST(list_inner_product(v, v) - 2 * list_inner_product(v, c) + list_inner_product(c, c) AS HUGEINT) AS d FROM x JOIN {books} b ON x.p = b.p) GROUP BY r, p)"
    text = """WITH d AS (SELECT vec_id, label, list_transform(embedding, lambda y: floor(1024 * CAST(y AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0),
k AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY vec_id NULLS LAST, v) - 1 AS r FROM d),
x AS MATERIALIZED (SELECT r, p, v[p * len(v) // 4 + 1:(p + 1) * len(v) // 4] AS v FROM (SELECT r, v, unnest(range(4)) AS p FROM k)),
b0 AS MATERIALIZED (SELECT p, r AS e, v AS c FROM x WHERE r < 256),
"""
    for i in range(rounds):
        text += f"""a{i} AS MATERIALIZED {near.format(books=f"b{i}")},
s{i} AS (SELECT p, e, list(CAST(floor(s / CAST(n AS DOUBLE)) AS DOUBLE) ORDER BY j) AS c FROM (SELECT a.p, a.e, j, sum(x.v[j]) AS s, count(*) AS n FROM a{i} a JOIN x ON a.r = x.r AND a.p = x.p, LATERAL (SELECT unnest(range(1, len(x.v) + 1)) AS j) GROUP BY ALL) GROUP BY p, e),
b{i + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(s.c, b.c) AS c FROM b{i} b LEFT JOIN s{i} s ON b.p = s.p AND b.e = s.e),
"""
    return text + f"""f AS {near.format(books=f"b{rounds}")},
o AS (SELECT r, string_agg(printf('%02x', CAST(e AS BIGINT)), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM f GROUP BY r),
h AS (SELECT sha256(string_agg(CAST(CAST(y AS BIGINT) AS VARCHAR), ',' ORDER BY p, e, j)) AS codebooks_sha256 FROM (SELECT p, e, unnest(c) AS y, generate_subscripts(c, 1) AS j FROM b{rounds}))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM k JOIN o USING (r), h
"""


ORACLES = {
    "op1_decontaminate": r"""
WITH words AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
grams AS (SELECT DISTINCT item, array_to_string(w[i:i + 9], ' ') AS g, least(len(w), 10) AS n FROM (SELECT item, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i FROM items WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM grams),
starts AS (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT r, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM words, lens WHERE len(w) >= n)),
hits AS (SELECT r, i, s.n, item FROM starts s JOIN grams USING (g)),
covered AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT r, unnest(generate_series(i, i + n - 1)) AS p FROM (SELECT DISTINCT r, i, n FROM hits)) GROUP BY r),
found AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS l FROM (SELECT DISTINCT r, item FROM hits WHERE item IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(l, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN covered USING (r) LEFT JOIN found USING (r)
""",
    "op2_exact_dedup": r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, length(coalesce(text, '')) AS points, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t FROM documents),
ranked AS (SELECT *, row_number() OVER w AS k, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY t) AS n FROM d WINDOW w AS (PARTITION BY t ORDER BY points DESC, doc_id NULLS LAST, r))
SELECT doc_id, keep_id, CAST(n AS BIGINT) AS group_size, k = 1 AS kept, sha256(t) AS text_sha256 FROM ranked
""",
    "op10_line_dedup": r"""
WITH d AS (SELECT doc_id, source, text, row_number() OVER () AS r, string_split(text, chr(10)) AS lines FROM documents),
pages AS (SELECT source, count(*) AS n FROM d GROUP BY source),
bad AS (SELECT c.source, c.line FROM (SELECT source, line, count(*) AS c FROM (SELECT source, r, unnest(list_distinct(lines)) AS line FROM d) WHERE trim(line, ' ') <> '' GROUP BY source, line) c JOIN pages p ON c.source IS NOT DISTINCT FROM p.source WHERE c.c >= 3 AND c.c > p.n * CAST(0.1 AS DOUBLE)),
lists AS (SELECT source, list(line) AS bad FROM bad GROUP BY source),
kept AS (SELECT d.doc_id, d.source, d.text, d.lines, CASE WHEN bad IS NULL THEN d.lines ELSE list_filter(d.lines, lambda x: NOT list_contains(bad, x)) END AS k FROM d LEFT JOIN lists ON d.source IS NOT DISTINCT FROM lists.source)
SELECT doc_id, source, CAST(coalesce(len(list_filter(lines, lambda x: trim(x, ' ') <> '')), 0) AS BIGINT) AS n_lines,
  CAST(coalesce(len(list_filter(lines, lambda x: trim(x, ' ') <> '')) - len(list_filter(k, lambda x: trim(x, ' ') <> '')), 0) AS BIGINT) AS n_removed,
  sha256(CASE WHEN text IS NULL THEN NULL ELSE array_to_string(k, chr(10)) END) AS kept_sha256
FROM kept
""",
    "op8_warc": r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS t, row_number() OVER () AS r FROM pages),
g AS (SELECT *, row_number() OVER w AS k, first_value(page_id) OVER w AS owner FROM p WINDOW w AS (PARTITION BY t ORDER BY page_id DESC NULLS LAST, r)),
bits AS (SELECT *, array_to_string(list_transform(string_split(sha1(t), ''), lambda c: substr(bin(16 + strpos('0123456789abcdef', c) - 1), 2)), '') AS b FROM g)
SELECT page_id, CAST(strlen(t) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(('0b' || substr(b, CAST(5 * i + 1 AS INTEGER), 5)) AS INTEGER) + 1, 1)), '') AS payload_digest,
  CASE WHEN k = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN k > 1 THEN owner END AS refers_to
FROM bits
""",
    "op9_minhash": r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE w[i] || ' ' || w[i + 1] END AS g FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 1, 1))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
sn AS (SELECT s.doc_id, g, n FROM s JOIN n USING (doc_id)),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, a.n + b.n AS sizes, count(*) AS c FROM sn a JOIN sn b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY ALL),
links AS (SELECT x, y FROM common WHERE 100 * c >= 80 * (sizes - c)),
edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.y FROM reach r JOIN edges e ON r.b = e.x)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) c ON c.doc_id = d.doc_id
""",
    "op6_url_filter": r"""
WITH h AS (SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
b AS (SELECT *, regexp_replace(regexp_replace(host, '^.*@', ''), ':\d*$', '') AS bare FROM h),
t AS (SELECT *, regexp_extract(bare, '([^.]+\.[^.]+)\.?$', 1) AS two, regexp_extract(bare, '([^.]+\.[^.]+\.[^.]+)\.?$', 1) AS three, regexp_matches(bare, '^[\d.]+$') AS ip FROM b),
f AS (SELECT *, regexp_full_match(two, '(ac|co|com|edu|go|gob|gov|mil|ne|net|nom|or|org|sch)\.[a-z]{2}') AS deep FROM t),
p AS (SELECT page_id, host, path, bare, CASE WHEN ip THEN bare WHEN deep THEN two ELSE regexp_extract(bare, '([^.]+)\.?$', 1) END AS suffix, CASE WHEN ip OR (CASE WHEN deep THEN three ELSE two END) = '' THEN bare WHEN deep THEN three ELSE two END AS domain FROM f),
o AS (SELECT doc_id AS page_id, max(CASE WHEN toxic = 1 OR quality = 0 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY doc_id),
hosts AS (SELECT bare, any_value(domain) AS domain, any_value(suffix) AS suffix, count(*) AS n, sum(bad) AS bad FROM p JOIN o USING (page_id) WHERE bare <> '' GROUP BY bare),
whole AS (SELECT coalesce(sum(bad), 0) + CAST(0.1 AS DOUBLE) AS a, coalesce(sum(n), 0) - coalesce(sum(bad), 0) + CAST(0.9 AS DOUBLE) AS b FROM hosts),
r1 AS (SELECT suffix AS key, sum(n) AS n, sum(bad) AS bad, any_value(a / (a + b)) AS m FROM hosts, whole GROUP BY suffix),
s1 AS (SELECT sum(n * (bad / n - m) ** 2) AS seen, sum(m * (1 - m)) AS noise, sum(m * (1 - m) * (n - 1)) AS slope FROM r1 WHERE n > 1),
k1 AS (SELECT CASE WHEN coalesce(slope, 0) = 0 OR seen <= noise THEN 1000.0 ELSE least(greatest(slope / (seen - noise) - 1, 1.0), 1000.0) END AS s FROM s1),
p1 AS (SELECT key, m * s + bad AS a, (1 - m) * s + n - bad AS b FROM r1, k1),
r2 AS (SELECT domain AS key, sum(h.n) AS n, sum(h.bad) AS bad, any_value(p1.a / (p1.a + p1.b)) AS m FROM hosts h JOIN p1 ON p1.key = h.suffix GROUP BY domain),
s2 AS (SELECT sum(n * (bad / n - m) ** 2) AS seen, sum(m * (1 - m)) AS noise, sum(m * (1 - m) * (n - 1)) AS slope FROM r2 WHERE n > 1),
k2 AS (SELECT CASE WHEN coalesce(slope, 0) = 0 OR seen <= noise THEN 1000.0 ELSE least(greatest(slope / (seen - noise) - 1, 1.0), 1000.0) END AS s FROM s2),
p2 AS (SELECT key, m * s + bad AS a, (1 - m) * s + n - bad AS b FROM r2, k2),
r3 AS (SELECT bare AS key, h.n, h.bad, p2.a / (p2.a + p2.b) AS m FROM hosts h JOIN p2 ON p2.key = h.domain),
s3 AS (SELECT sum(n * (bad / n - m) ** 2) AS seen, sum(m * (1 - m)) AS noise, sum(m * (1 - m) * (n - 1)) AS slope FROM r3 WHERE n > 1),
k3 AS (SELECT CASE WHEN coalesce(slope, 0) = 0 OR seen <= noise THEN 1000.0 ELSE least(greatest(slope / (seen - noise) - 1, 1.0), 1000.0) END AS s FROM s3),
p3 AS (SELECT key, m * s + bad AS a, (1 - m) * s + n - bad AS b FROM r3, k3),
post AS (SELECT page_id, host, path, coalesce(p3.a, p2.a, p1.a, whole.a) AS a, coalesce(p3.b, p2.b, p1.b, whole.b) AS b FROM whole, p LEFT JOIN p3 ON p3.key = bare LEFT JOIN p2 ON p2.key = domain LEFT JOIN p1 ON p1.key = suffix),
low AS (SELECT *, a / (a + b) AS mean, a / (a + b) - 1.645 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) AS low FROM post),
rules AS (SELECT * FROM (VALUES ('block', 'com/en/', 'com', '/en/'), ('allow', 'example.com/en/7', 'example.com', '/en/7'), ('allow', 'net/de/', 'net', '/de/'), ('block', 'example.net/de/8', 'example.net', '/de/8'), ('block', 'org/es/', 'org', '/es/')) AS t(v, rule, place, start)),
hit AS (SELECT host, path, arg_max(rule, length(rule)) AS rule, arg_max(v, length(rule)) AS v FROM (SELECT DISTINCT host, path FROM low), rules WHERE (host = place OR ends_with(host, '.' || place)) AND starts_with(path, start) GROUP BY host, path)
SELECT page_id, low.host, low.path, rule, coalesce(v, CASE WHEN low > 0.3 THEN 'block' ELSE 'allow' END) AS verdict, round(mean, 6) AS bad_mean, round(low, 6) AS bad_low
FROM low LEFT JOIN hit ON hit.host = low.host AND hit.path = low.path
""",
    "op11_collocations": r"""
WITH p AS (SELECT lang, regexp_extract_all(unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM (SELECT coalesce(lang, 'und') AS lang, text FROM documents)),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM p GROUP BY lang),
f AS MATERIALIZED (SELECT lang, g, k AS size, count(*) AS a FROM (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, range(1, 5) t(k) WHERE len(w) >= k)) GROUP BY lang, g, k HAVING count(*) >= 30),
c AS (SELECT *, string_split(g, ' ') AS w FROM f WHERE size > 1),
parts AS MATERIALIZED (SELECT lang, g, a, k, array_to_string(w[1:k], ' ') AS p1, array_to_string(w[k + 1:], ' ') AS p2 FROM c JOIN range(1, 4) t(k) ON k < c.size),
lefts AS MATERIALIZED (SELECT parts.*, f.a AS l FROM parts JOIN f ON f.lang = parts.lang AND f.g = p1),
cuts AS (SELECT lefts.*, f.a AS r, 2000000 * CAST(lefts.a AS HUGEINT) // (l + f.a) AS score FROM lefts JOIN f ON f.lang = lefts.lang AND f.g = p2),
best AS (SELECT *, row_number() OVER (PARTITION BY lang, g ORDER BY score, k) AS place FROM cuts),
around AS (SELECT lang, g, max(a) AS a FROM (SELECT lang, array_to_string(w[i:i + k - 1], ' ') AS g, a FROM (SELECT lang, w, a, k, unnest(range(1, size - k + 2)) AS i FROM c JOIN range(2, 4) t(k) ON k < size)) GROUP BY lang, g),
free AS (SELECT b.*, b.g AS phrase FROM best b LEFT JOIN around o ON o.lang = b.lang AND o.g = b.g WHERE place = 1 AND (o.a IS NULL OR 100 * o.a < 80 * b.a)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM free)
SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
""",
    "op12_jaccard_join": r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
sn AS (SELECT s.doc_id, g, n FROM s JOIN n USING (doc_id)),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, a.n + b.n AS sizes, count(*) AS c FROM sn a JOIN sn b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY ALL),
links AS (SELECT x, y FROM common WHERE 100 * c >= 80 * (sizes - c)),
edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.y FROM reach r JOIN edges e ON r.b = e.x)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, c.component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) c ON c.doc_id = d.doc_id
""",
    "op13_vector_codes": _vector_codes(),
}
