"""SQL twins of the operators' queries, for DuckDB over the same tables."""

LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP13 = rf"""
WITH word AS (SELECT 'd' AS side, doc_id, unnest(regexp_extract_all({LOWER.format("text")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM documents
              UNION ALL SELECT 'b', NULL, unnest(regexp_extract_all({LOWER.format("text")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) FROM benchmark),
crcs AS (SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, b) ORDER BY b) AS t FROM range(256) r(b)),
spelt AS (SELECT w, list_transform(range(1, length(hex(encode(w))) // 2 + 1), lambda i: ('0x' || substr(hex(encode(w)), 2 * i - 1, 2))::BIGINT) AS b FROM (SELECT DISTINCT w FROM word)),
bucketed AS (SELECT w, xor(list_reduce(b, lambda c, x: xor(c // 256, t[xor(c % 256, x) + 1]), 4294967295), 4294967295) % 10000 AS k FROM spelt CROSS JOIN crcs),
sums AS (SELECT k, count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 'b') AS t FROM word JOIN bucketed USING (w) GROUP BY k),
whole AS (SELECT count(*) FILTER (side = 'd')::DOUBLE AS s, count(*) FILTER (side = 'b')::DOUBLE AS t FROM word),
gain AS (SELECT k, floor(1000 * ln((sums.t + 1.0::DOUBLE) * (whole.s + 10000) / ((sums.s + 1.0::DOUBLE) * (whole.t + 10000))))::BIGINT AS g FROM sums CROSS JOIN whole),
weighed AS (SELECT doc_id, count(*) AS n, sum(g)::BIGINT AS weight FROM word JOIN bucketed USING (w) JOIN gain USING (k) WHERE side = 'd' GROUP BY doc_id),
scored AS (SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM documents LEFT JOIN weighed USING (doc_id)),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, rank FROM scored LEFT JOIN (SELECT doc_id, rank FROM ranked WHERE rank <= 10 * n // 100) USING (doc_id)"""

OP12 = rf"""
WITH piece AS (SELECT lang, p, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM (
    SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS p, piece FROM (SELECT lang, unnest(string_split_regex({LOWER.format("coalesce(text, '')")}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents))),
gram AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i : i + k - 1], ' '))) AS phrase FROM piece CROSS JOIN (SELECT unnest([1, 2, 3, 4])::INT AS k)),
f AS (SELECT lang, k, phrase, count(*)::HUGEINT AS a FROM gram GROUP BY ALL),
held AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND a >= 30),
inner_ AS (SELECT lang, a, unnest(list_transform(range(0, ((k - 1) * (k - 2)) // 2 + k - 2), lambda x: CASE WHEN x < k - 1 THEN array_to_string(w[x + 1 : x + 2], ' ') ELSE array_to_string(w[x - k + 2 : x - k + 4], ' ') END)) AS phrase FROM held WHERE k > 2),
gone AS (SELECT DISTINCT h.lang, h.phrase FROM held h JOIN inner_ i ON i.lang = h.lang AND i.phrase = h.phrase WHERE 100 * i.a >= 80 * h.a),
cut AS (SELECT lang, phrase, a, c, array_to_string(w[1 : c], ' ') AS x, array_to_string(w[c + 1 : k], ' ') AS y FROM (SELECT *, unnest(range(1, k)) AS c FROM held)),
scored AS (SELECT cut.lang, cut.phrase, cut.a, cut.c, x.a AS l, y.a AS r, 2000000 * cut.a // (x.a + y.a) AS score FROM cut JOIN f x ON x.lang = cut.lang AND x.phrase = cut.x JOIN f y ON y.lang = cut.lang AND y.phrase = cut.y),
low AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
ranked AS (SELECT low.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM low ANTI JOIN gone USING (lang, phrase))
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM ranked JOIN (SELECT lang, sum(a) AS n FROM f WHERE k = 1 GROUP BY lang) USING (lang) WHERE rank <= 2000"""

OP11 = rf"""
WITH RECURSIVE words AS (SELECT doc_id, list_filter(string_split_regex({LOWER.format("coalesce(text, '')")}, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
shingle AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 3 THEN list_filter([array_to_string(w, ' ')], lambda x: x <> '') ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g FROM words),
sized AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS met FROM shingle a JOIN shingle b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT x, y FROM shared JOIN sized a ON a.doc_id = x JOIN sized b ON b.doc_id = y WHERE 100 * met >= 85 * (a.n + b.n - met)),
edge AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
reach(x, y) AS (SELECT x, y FROM edge UNION SELECT reach.x, edge.y FROM reach JOIN edge ON reach.y = edge.x)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(low, doc_id)) AS component_id, least(doc_id, coalesce(low, doc_id)) = doc_id AS kept
FROM documents LEFT JOIN sized USING (doc_id) LEFT JOIN (SELECT x AS doc_id, min(y) AS low FROM reach GROUP BY x) USING (doc_id)"""

OP5 = r"""
WITH line AS (SELECT doc_id, unnest(range(len(lines))) AS place, unnest(lines) AS x FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents)),
pair AS (SELECT doc_id, place AS chunk, lead(place) OVER w - place + 1 AS n_lines, x || chr(10) || lead(x) OVER w AS part
         FROM line WHERE trim(x, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> '' WINDOW w AS (PARTITION BY doc_id ORDER BY place)),
ranked AS (SELECT *, first_value(doc_id) OVER w AS kept_doc_id, first_value(chunk) OVER w AS kept_chunk
           FROM pair WHERE part IS NOT NULL WINDOW w AS (PARTITION BY part ORDER BY doc_id, chunk))
SELECT doc_id, chunk::INTEGER AS chunk, n_lines::INTEGER AS n_lines, length(part)::INTEGER AS n_chars, kept_doc_id, kept_chunk::INTEGER AS kept_chunk
FROM ranked WHERE doc_id <> kept_doc_id OR chunk <> kept_chunk"""
