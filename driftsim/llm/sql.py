"""DuckDB forms of the numbered queries that SQL can express."""

_LINES = """
WITH cut AS (
  SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL
), spots AS (
  SELECT doc_id, ls, unnest(range(0, len(ls) - 2)) AS p FROM cut WHERE len(ls) >= 3
), ordered AS (
  SELECT doc_id, p, row_number() OVER (PARTITION BY ls[p + 1], ls[p + 2], ls[p + 3] ORDER BY doc_id, p) AS nth FROM spots
), gone AS (
  SELECT DISTINCT doc_id, p + j AS i FROM ordered, (SELECT unnest([0, 1, 2]) AS j) WHERE nth > 1
), numbered AS (
  SELECT doc_id, unnest(ls) AS line, unnest(range(0, len(ls))) AS i FROM cut
), sums AS (
  SELECT n.doc_id, count(g.i) AS n_removed,
         coalesce(string_agg(line, chr(10) ORDER BY n.i) FILTER (WHERE g.i IS NULL), '') AS kept
  FROM numbered n LEFT JOIN gone g ON g.doc_id = n.doc_id AND g.i = n.i GROUP BY n.doc_id
)
SELECT d.doc_id, coalesce(len(c.ls), 0)::BIGINT AS n_lines, coalesce(s.n_removed, 0)::BIGINT AS n_removed,
       sha256(coalesce(s.kept, '')) AS kept_sha256
FROM documents d LEFT JOIN cut c USING (doc_id) LEFT JOIN sums s USING (doc_id)
"""

_WORDS = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_BENCHMARK = f"""
WITH d AS (
  SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS ws FROM documents
), b AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item, {_WORDS.format("coalesce(text, '')")} AS ws FROM benchmark
), phrases AS (
  SELECT item, least(len(ws), 13) AS m,
         array_to_string(ws[p : p + least(len(ws), 13) - 1], ' ') AS phrase
  FROM (SELECT item, ws, unnest(range(1, greatest(len(ws) - 12, 1) + 1)) AS p FROM b WHERE len(ws) > 0)
), spots AS (
  SELECT doc_id, p, m, array_to_string(ws[p : p + m - 1], ' ') AS phrase
  FROM (SELECT doc_id, ws, m, unnest(range(1, len(ws) - m + 2)) AS p
        FROM d, (SELECT DISTINCT m FROM phrases) WHERE len(ws) >= m)
), found AS (
  SELECT DISTINCT s.doc_id, s.p, s.m, f.item FROM spots s JOIN phrases f USING (m, phrase)
), hits AS (
  SELECT doc_id, count(DISTINCT w) AS n FROM (SELECT doc_id, unnest(range(p, p + m)) AS w FROM found) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id
)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(h.n, 0)::BIGINT AS n_hit, coalesce(i.n, 0)::BIGINT AS n_items,
       sha256(coalesce(i.names, '')) AS items_sha256, coalesce(h.n, 0) > 0 AND 20 * h.n >= len(ws) AS contaminated
FROM d LEFT JOIN hits h USING (doc_id) LEFT JOIN items i USING (doc_id)
"""

_PASSAGES = r"""
WITH cut AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), spots AS (
  SELECT doc_id, p, md5(array_to_string(ws[p : p + 49], ' ')) AS words
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS p FROM cut WHERE len(ws) >= 50)
), firsts AS (
  SELECT words, min(doc_id) AS least FROM spots GROUP BY words
), gone AS (
  SELECT DISTINCT doc_id, i FROM (
    SELECT doc_id, unnest(range(p, p + 50)) AS i FROM spots JOIN firsts USING (words) WHERE doc_id > least)
), numbered AS (
  SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM cut
), sums AS (
  SELECT n.doc_id, count(g.i) AS n_removed, string_agg(word, ' ' ORDER BY n.i) FILTER (WHERE g.i IS NULL) AS kept
  FROM numbered n LEFT JOIN gone g ON g.doc_id = n.doc_id AND g.i = n.i GROUP BY n.doc_id
)
SELECT c.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM cut c LEFT JOIN sums s USING (doc_id)
"""

_STRINGS = """
WITH cut AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), spots AS (
  SELECT doc_id, p, md5(substr(h, 2 * p + 1, 400)) AS bytes
  FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 199)) AS p FROM cut WHERE length(h) >= 400)
), twice AS (
  SELECT bytes FROM spots GROUP BY bytes HAVING count(*) > 1
), hits AS (
  SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM spots WHERE bytes IN (SELECT bytes FROM twice)
), numbered AS (
  SELECT *, sum(CASE WHEN before IS NULL OR before + 200 < p THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS span FROM hits
), spans AS (
  SELECT doc_id, span, min(p) AS a, max(p) + 200 AS b FROM numbered GROUP BY doc_id, span
), gaps AS (
  SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS from_byte FROM spans
), sums AS (
  SELECT g.doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS last_byte,
         string_agg(substr(h, 2 * from_byte + 1, 2 * (a - from_byte)), '' ORDER BY a) AS kept
  FROM gaps g JOIN cut c ON c.doc_id = g.doc_id GROUP BY g.doc_id
)
SELECT c.doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last_byte, 0) + 1))) AS kept_sha256
FROM cut c LEFT JOIN sums s USING (doc_id)
"""

_VECTORS = """
WITH RECURSIVE good AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b
  ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.95
), reach AS (
  SELECT vec_id AS v, vec_id AS r FROM good UNION SELECT l.b, r.r FROM reach r JOIN links l ON l.a = r.v
), least AS (
  SELECT v, min(r) AS component_id FROM reach GROUP BY v
)
SELECT g.vec_id, (SELECT count(*) FROM links l WHERE l.a = g.vec_id) AS n_links, component_id, g.vec_id = component_id AS kept
FROM good g JOIN least ON least.v = g.vec_id
"""

_RUNS = r"""
WITH RECURSIVE crc AS (
  SELECT doc_id, doc_id::VARCHAR AS s, 0 AS bit, 4294967295::BIGINT AS c FROM documents
  UNION ALL
  SELECT doc_id, s, bit + 1, CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END
  FROM (SELECT doc_id, s, bit, CASE WHEN bit % 8 = 0 THEN xor(c, ord(substr(s, bit // 8 + 1, 1))::BIGINT) ELSE c END AS x FROM crc WHERE bit < 8 * length(s))
), hashed AS (
  SELECT doc_id, xor(c, 4294967295::BIGINT) AS h FROM crc WHERE bit = 8 * length(s)
), cut AS (
  SELECT d.doc_id, h, h // 10 AS g, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents d JOIN hashed USING (doc_id)
), sized AS (
  SELECT *, len(ws) AS n, CASE WHEN h % 10 = 0 AND len(ws) > 0 THEN g % len(ws) END AS a FROM cut
), planted AS (
  SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM sized
), words AS (
  SELECT doc_id, i, ws[(CASE WHEN a IS NOT NULL AND i >= a THEN a + (i - a) % p ELSE i END) + 1] AS word
  FROM (SELECT *, unnest(range(0, n)) AS i FROM planted)
), matches AS (
  SELECT x.doc_id, y.i - x.i AS q, x.i FROM words x JOIN words y ON x.doc_id = y.doc_id AND x.word = y.word AND x.i < y.i
  JOIN planted d ON d.doc_id = x.doc_id WHERE 4 * (y.i - x.i) <= d.n
), islands AS (
  SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM matches
), stretches AS (
  SELECT doc_id, q, min(i) AS s, count(*) + q AS l FROM islands GROUP BY doc_id, q, island HAVING count(*) + q >= greatest(6, 4 * q)
), runs AS (
  SELECT doc_id, s, l, min(q) AS q FROM stretches GROUP BY doc_id, s, l
), listed AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS lines,
         first(struct_pack(s := s, l := l, q := q) ORDER BY l::DOUBLE / q DESC, s, q) AS best
  FROM runs GROUP BY doc_id
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(s + q, s + l)) AS i FROM runs
), kept AS (
  SELECT w.doc_id, string_agg(word, ' ' ORDER BY w.i) AS text FROM words w ANTI JOIN gone g ON g.doc_id = w.doc_id AND g.i = w.i GROUP BY w.doc_id
)
SELECT c.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, best.s::BIGINT AS start, best.l::BIGINT AS length, best.q::BIGINT AS period,
       (1000 * best.l // best.q)::BIGINT AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(k.text, '')) AS collapsed_sha256
FROM cut c LEFT JOIN listed USING (doc_id) LEFT JOIN kept k ON k.doc_id = c.doc_id
"""

LLM_ORACLE = {
    "op1_line_dedup": _LINES,
    "op3_substring_dedup": _PASSAGES,
    "op5_decontamination": _BENCHMARK,
    "op6_suffix_array_dedup": _STRINGS,
    "op7_embedding_dedup": _VECTORS,
    "op13_periodic_runs": _RUNS,
}
