"""SQL counterparts, for DuckDB, of the queries that SQL can express.

They state the results, not the methods: joins of all n-grams instead of MinHash, plain regular
expressions over the markup of the given pages, all inner products.
"""

from tallybird.llm.license_scan import TEMPLATES

WORD = r"[^\x20\x09-\x0D]+"

OP1 = rf"""
WITH RECURSIVE words AS (
    SELECT row_number() OVER () AS r, doc_id, lower(coalesce(text, '')) AS t,
           regexp_extract_all(lower(coalesce(text, '')), '{WORD}') AS w
    FROM documents
), texts AS (
    SELECT t, any_value(w) AS w, count(*) AS copies, min(doc_id) AS node FROM words GROUP BY t
), grams AS (
    SELECT node, copies, unnest(list_distinct(
        CASE WHEN len(w) = 0 THEN []
             WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
             ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS g
    FROM texts
), sizes AS (SELECT node, any_value(copies) AS copies, count(*) AS n FROM grams GROUP BY node),
shared AS (
    SELECT a.node AS x, b.node AS y, count(*) AS common
    FROM grams a JOIN grams b ON a.g = b.g AND a.node <> b.node GROUP BY ALL
), links AS (
    SELECT x, y, b.copies AS copies FROM shared JOIN sizes a ON a.node = x JOIN sizes b ON b.node = y
    WHERE common >= 0.8 * (a.n + b.n - common) - 1e-9
), reach AS (
    SELECT node, node AS other FROM sizes
    UNION
    SELECT reach.node, links.y FROM reach JOIN links ON links.x = reach.other
), classes AS (SELECT node, min(other) AS class_id FROM reach GROUP BY node),
degree AS (SELECT x AS node, sum(copies) AS linked FROM links GROUP BY x)
SELECT words.doc_id,
       CASE WHEN len(words.w) = 0 THEN words.doc_id ELSE classes.class_id END AS class_id,
       (CASE WHEN len(words.w) = 0 THEN 0 ELSE texts.copies - 1 + coalesce(linked, 0) END)::BIGINT AS n_links
FROM words JOIN texts USING (t) LEFT JOIN classes USING (node) LEFT JOIN degree USING (node)
"""

OP2 = r"""
WITH cut AS (
    SELECT page_id, url, regexp_extract(html, '(?s)<article>(.*?)(?:</article>|$)', 1) AS body FROM pages
), bare AS (
    SELECT page_id, url,
           regexp_replace(regexp_replace(body, '</?(?:p|h1|h2|h3|br|div|ul|li)(?:\s[^>]*)?>', ' ', 'g'), '<[^>]+>', '', 'g') AS t
    FROM cut
), plain AS (
    SELECT page_id, url, trim(regexp_replace(
        replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '\s+', ' ', 'g')) AS text
    FROM bare
)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM plain
"""


def _op3() -> str:
    rows = ", ".join("('{}', '{}')".format(name, text.replace("'", "''")) for name, text in TEMPLATES)
    return rf"""
WITH given(template_id, text) AS (VALUES {rows}),
templates AS (
    SELECT *, least(5, len(w)) AS n, len(w) - least(5, len(w)) + 1 AS m
    FROM (SELECT template_id, row_number() OVER () AS t,
                 list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS w FROM given)
), wanted AS (
    SELECT t, n, m, unnest(list_distinct(list_transform(range(1, m + 1), lambda i: array_to_string(w[i:i + n - 1], ' ')))) AS g
    FROM templates
), needs AS (
    SELECT t, any_value(CAST(2 ** ceil(log2(m)) AS BIGINT)) AS size, count(*) AS distinct_shingles FROM wanted GROUP BY t
), docs AS (
    SELECT row_number() OVER () AS r, doc_id,
           list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS w
    FROM documents
), places AS (
    SELECT r, lengths.n, unnest(range(1, len(w) - lengths.n + 2)) AS i, w
    FROM docs, (SELECT DISTINCT n FROM templates) lengths WHERE len(w) >= lengths.n
), grams AS (SELECT r, n, i - 1 AS place, array_to_string(w[i:i + n - 1], ' ') AS g FROM places),
hits AS (SELECT r, place, t, m, g FROM grams JOIN wanted USING (n, g)),
short AS (  -- all shingles in a row
    SELECT r, t, place - unnest(range(0, m)) AS start, g FROM hits WHERE m <= 4
), held_short AS (
    SELECT DISTINCT r, t FROM short JOIN templates USING (t) JOIN needs USING (t)
    GROUP BY r, t, start, m, distinct_shingles HAVING count(*) = m AND count(DISTINCT g) = distinct_shingles
), windows AS (
    SELECT r, t, distinct_shingles, unnest([place // size, place // size - 1]) AS win, g FROM hits JOIN needs USING (t) WHERE m > 4
), held_long AS (
    SELECT DISTINCT r, t FROM windows WHERE win >= 0
    GROUP BY r, t, win, distinct_shingles HAVING count(DISTINCT g) >= 0.8 * distinct_shingles - 1e-9
), held AS (
    SELECT DISTINCT r, template_id FROM (FROM held_short UNION ALL FROM held_long) JOIN templates USING (t)
), listed AS (SELECT r, count(*) AS n, string_agg(template_id, ',' ORDER BY template_id) AS ids FROM held GROUP BY r)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_licenses, coalesce(ids, '') AS licenses FROM docs LEFT JOIN listed USING (r)
"""


# The extra kinds (pem, github, slack, jwt) occur in none of the given tables; the SQL states the base.
OP4 = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
patterns(kind, rank, pattern, least) AS (VALUES
    ('assign', 0, '((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 6),
    ('access', 1, 'AKIA[A-Z0-9]+', 20),
    ('hex', 2, '[0-9a-f]+', 24)
), parts AS (
    SELECT r, kind, rank, least,
           CASE kind WHEN 'assign' THEN regexp_extract_all(text, '((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)')
                     WHEN 'access' THEN regexp_extract_all(text, 'AKIA[A-Z0-9]+')
                     ELSE regexp_extract_all(text, '[0-9a-f]+') END AS found,
           CASE kind WHEN 'assign' THEN regexp_split_to_array(text, '((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)')
                     WHEN 'access' THEN regexp_split_to_array(text, 'AKIA[A-Z0-9]+')
                     ELSE regexp_split_to_array(text, '[0-9a-f]+') END AS gaps
    FROM docs CROSS JOIN patterns
    WHERE regexp_matches(text, CASE kind WHEN 'assign' THEN '(?i)passw|secret|token|api' WHEN 'access' THEN 'AKIA' ELSE '[0-9a-f]{24}' END)
), each AS (
    SELECT r, kind, rank, least, unnest(range(1, len(found) + 1)) AS k, found, gaps FROM parts WHERE len(found) > 0
), placed AS (
    SELECT r, kind, rank, least, found[k] AS match,
           sum(length(gaps[k]) + length(found[k])) OVER (PARTITION BY r, kind ORDER BY k) AS stop
    FROM each
), kept AS (
    SELECT r, kind, rank, (stop - length(match))::BIGINT AS start, stop::BIGINT AS stop FROM placed
    WHERE CASE kind WHEN 'assign'
        THEN length(regexp_extract(match, '((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2))
        ELSE length(match) END >= least
), listed AS (
    SELECT r, count(*) FILTER (kind = 'assign') AS a, count(*) FILTER (kind = 'access') AS c, count(*) FILTER (kind = 'hex') AS h,
           string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS spans
    FROM kept GROUP BY r
)
SELECT doc_id, coalesce(a, 0)::BIGINT AS n_assign, coalesce(c, 0)::BIGINT AS n_access, coalesce(h, 0)::BIGINT AS n_hex,
       sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN listed USING (r)
"""

OP8 = r"""
WITH vectors AS (
    SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS w
    FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT q.r, q.vec_id AS query_id, c.vec_id, list_inner_product(q.w, c.w)::BIGINT AS score,
           row_number() OVER (PARTITION BY q.r ORDER BY list_inner_product(q.w, c.w) DESC, c.vec_id) AS rank
    FROM vectors q JOIN vectors c ON q.vec_id % 20 = 0 AND q.r <> c.r
)
SELECT query_id, rank::INT AS rank, vec_id, score FROM scored WHERE rank <= 20
"""

OP9 = rf"""
WITH sized AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size,
           md5(coalesce(doc_id::VARCHAR, text, '')) AS draw
    FROM documents
), sources AS (
    SELECT source, sum(size)::BIGINT AS source_size, 2.0::DOUBLE * sum(size)::BIGINT AS room
    FROM sized GROUP BY source
), weighed AS (
    SELECT *, ([3.0, 1.0, 2.0]::DOUBLE[])[((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT] AS weight
    FROM sources
), levels AS (
    SELECT *, (1.5::DOUBLE * (sum(source_size) OVER ())::BIGINT
               - (sum(room) OVER (ORDER BY room / weight, source NULLS LAST
                                  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - room))
              / sum(weight) OVER (ORDER BY room / weight, source NULLS LAST
                                  ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
    FROM weighed
), targets AS (
    SELECT source, source_size, least(room, max(level) OVER () * weight) AS target FROM levels
), placed AS (
    SELECT doc_id, size, source_size, target,
           CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs,
           sum(size) OVER (PARTITION BY sized.source ORDER BY draw, size
                           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS earlier
    FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source
)
SELECT doc_id, size, source_size, target,
       (epochs * size + greatest(0, least(size, floor(target - epochs * source_size) - earlier)))::BIGINT AS taken
FROM placed
"""

#: Unsigned CRC-32 of a decimal number, bit by bit: x > 0 takes in the byte x - 1, 0 shifts by one bit.
_CRC = """xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(conv_id::VARCHAR, ''),
    lambda c: [ascii(c)::BIGINT + 1, 0, 0, 0, 0, 0, 0, 0, 0]))),
    lambda a, x: CASE WHEN x > 0 THEN xor(a, x - 1) ELSE xor(a >> 1, (a & 1) * 3988292384) END), 4294967295)"""

OP12 = rf"""
WITH clean AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), own AS (
    SELECT conv_id, list({{'d': d, 'w': w}} ORDER BY turn NULLS FIRST, d) AS turns
    FROM (SELECT conv_id, turn, md5(length(role) || ':' || role || text) AS d, len(regexp_extract_all(text, '{WORD}'))::BIGINT AS w FROM clean)
    GROUP BY conv_id
), dealt AS (SELECT conv_id, turns, ({_CRC} % 4)::BIGINT AS h FROM own),
rebuilt AS (
    SELECT o.conv_id, list_concat(coalesce(b.turns[1:h], []), o.turns[h + 1:]) AS turns
    FROM dealt o LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 20
), paths AS (
    SELECT conv_id, len(turns) AS n, unnest(range(0, len(turns) + 1)) AS depth, turns FROM rebuilt
), nodes AS (
    SELECT array_to_string(list_transform(turns[1:depth], lambda x: x.d), '') AS key, depth,
           min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(any_value(turns[depth].w), 0) AS words,
           sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = depth), '')) AS ends_sha256
    FROM paths GROUP BY ALL
), children AS (
    SELECT left(key, 32 * (depth - 1)) AS key, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL
), sized AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN children USING (key)),
above AS (SELECT key, n_children, n_convs, words, unnest(range(0, depth + 1)) AS a FROM sized),
sums AS (
    SELECT left(key, 32 * a) AS key, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * words) AS saved
    FROM above GROUP BY ALL
)
SELECT s.conv_id, s.depth, p.conv_id AS parent_conv_id, s.n_convs, s.n_children, n_leaves, saved::BIGINT AS saved_tokens, s.ends_sha256
FROM sized s JOIN sums USING (key) LEFT JOIN nodes p ON s.depth > 0 AND p.key = left(s.key, 32 * (s.depth - 1))
"""

OP13 = rf"""
WITH marks AS (
    SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id
), docs AS (
    SELECT d.doc_id, coalesce(d.source, '') AS part, coalesce(d.text, '') AS t,
           regexp_extract_all(coalesce(d.text, ''), '{WORD}') AS w,
           coalesce(good, 0) AS good, coalesce(marks.toxic, 0) AS toxic
    FROM documents d LEFT JOIN marks ON d.doc_id = marks.doc_id
), fails AS (
    SELECT part, good, toxic,
           (len(w) < 200)::INT AS a, (100 * len(list_distinct(w)) < 50 * len(w))::INT AS b,
           (100 * len(regexp_extract_all(t, '[A-Z]')) > 2 * length(t))::INT AS c,
           regexp_matches(t, '[#$%&*|]')::INT AS d,
           coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::INT AS e
    FROM docs
), cells AS (
    SELECT part, good, toxic, [a, b, c, d, e] AS f, a + b + c + d + e AS failed, count(*) AS n FROM fails GROUP BY ALL
), letters(i) AS (VALUES (1), (2), (3), (4), (5)),
orders AS (
    SELECT [p.i, q.i, r.i, s.i, t.i] AS o
    FROM letters p, letters q, letters r, letters s, letters t
    WHERE len(list_distinct([p.i, q.i, r.i, s.i, t.i])) = 5
), steps AS (
    SELECT part, array_to_string(list_transform(o, lambda x: chr(64 + x)), '') AS filter_order, letters.i AS step, o[letters.i] AS own,
           good, toxic, failed, n, f[o[letters.i]] AS here,
           coalesce(list_max(list_transform(o[1:letters.i - 1], lambda x: f[x])), 0) AS before
    FROM cells, orders, letters
), counted AS (
    SELECT part, filter_order, step, own,
           coalesce(sum(n) FILTER (here = 0 AND before = 0), 0)::BIGINT AS kept,
           coalesce(sum(n) FILTER (here = 1 AND before = 0), 0)::BIGINT AS removed,
           coalesce(sum(n) FILTER (here = 1 AND before = 1), 0)::BIGINT AS redundant,
           coalesce(sum(n) FILTER (here = 1 AND failed = 1), 0)::BIGINT AS unique_fails,
           coalesce(sum(n) FILTER (here = 1 AND before = 0 AND good = 1), 0)::BIGINT AS good_lost,
           coalesce(sum(n) FILTER (here = 1 AND before = 0 AND toxic = 1), 0)::BIGINT AS toxic_lost
    FROM steps GROUP BY part, filter_order, step, own
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM counted
"""

ORACLE_SQL = {
    "op1_ngram_jaccard_join": OP1,
    "op2_html_extraction": OP2,
    "op3_license_scan": _op3(),
    "op4_secret_scan": OP4,
    "op8_exact_top_k": OP8,
    "op9_source_mixing": OP9,
    "op12_conversation_trie": OP12,
    "op13_filter_audit": OP13,
}
