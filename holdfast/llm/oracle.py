"""DuckDB SQL of the queries that SQL can express, brute force on whole tables."""

from __future__ import annotations

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_LETTERS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_SPACED = rf"regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+')"

DECONTAMINATE = f"""
    WITH items AS (SELECT CAST(item_id AS VARCHAR) AS item, {_LETTERS} AS w FROM benchmark
                   WHERE item_id IS NOT NULL AND text IS NOT NULL),
         windows AS (SELECT DISTINCT item, least(10, len(w)) AS n,
                            unnest([w[i : i + least(10, len(w)) - 1] FOR i IN range(1, len(w) - least(10, len(w)) + 2)]) AS span
                     FROM items WHERE len(w) > 0),
         docs AS (SELECT doc_id, COALESCE({_LETTERS}, []) AS w FROM documents),
         places AS (SELECT doc_id, n, i, w[i : i + n - 1] AS span
                    FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
                          FROM docs, (SELECT DISTINCT n FROM windows))),
         hits AS (SELECT doc_id, places.n, i, item FROM places JOIN windows ON windows.n = places.n AND windows.span = places.span),
         words AS (SELECT doc_id, COUNT(*) AS n_hit
                   FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS at FROM hits) GROUP BY 1),
         found AS (SELECT doc_id, COUNT(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
                   FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY 1)
    SELECT doc_id, len(w) AS n_words, COALESCE(n_hit, 0) AS n_hit, COALESCE(n_items, 0) AS n_items,
           sha256(COALESCE(ids, '')) AS items_sha256, COALESCE(n_hit, 0) > 0 AS contaminated
    FROM docs LEFT JOIN words USING (doc_id) LEFT JOIN found USING (doc_id)"""

_BITS = "array_to_string([lpad(bin(CAST(strpos('0123456789abcdef', d) - 1 AS INTEGER)), 4, '0') FOR d IN string_split(h, '')], '')"
_BASE32 = """array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                 1 + CAST(list_sum([CAST(substr(bits, 5 * k + j, 1) AS INTEGER) * (1 << (5 - j)) FOR j IN [1, 2, 3, 4, 5]]) AS BIGINT), 1) FOR k IN range(32)], '')"""

ARCHIVE = f"""
    WITH hashed AS (SELECT page_id, octet_length(encode(COALESCE(html, ''))) AS payload_bytes, sha1(COALESCE(html, '')) AS h FROM pages),
         coded AS (SELECT *, {_BITS} AS bits, MIN(page_id) OVER (PARTITION BY h, payload_bytes) AS first_id FROM hashed)
    SELECT page_id, payload_bytes, {_BASE32} AS payload_digest,
           CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN page_id <> first_id THEN first_id END AS refers_to
    FROM coded"""

#: Smallest id reachable over ``links`` (a, b, both directions); ``nodes`` has every id.
_REACH = """reach(id, to_id) AS (SELECT id, id FROM nodes UNION SELECT r.id, l.b FROM reach r JOIN links l ON l.a = r.to_id),
         component AS (SELECT id, MIN(to_id) AS component_id FROM reach GROUP BY 1)"""

NGRAM_JOIN = f"""
    WITH RECURSIVE docs AS (SELECT doc_id, COALESCE({_SPACED}, []) AS w FROM documents),
         shingles AS (SELECT DISTINCT doc_id,
                             unnest([w[i : i + 4] FOR i IN range(1, greatest(2, len(w) - 3))]) AS s FROM docs WHERE len(w) > 0),
         sizes AS (SELECT doc_id, COUNT(*) AS n FROM shingles GROUP BY 1),
         common AS (SELECT x.doc_id AS a, y.doc_id AS b, COUNT(*) AS c
                    FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2),
         links AS (SELECT a, b FROM common JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b
                   WHERE 100 * c >= 80 * (p.n + q.n - c)),
         nodes AS (SELECT doc_id AS id FROM docs), {_REACH}
    SELECT docs.doc_id, COALESCE(n, 0) AS n_shingles, component_id
    FROM docs LEFT JOIN sizes USING (doc_id) JOIN component ON component.id = docs.doc_id"""

VECTORS = f"""
    WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
         links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id <> y.vec_id
                   WHERE list_cosine_similarity(x.e, y.e) >= 0.98),
         nodes AS (SELECT vec_id AS id FROM v), {_REACH}
    SELECT vec_id, (SELECT COUNT(*) FROM links WHERE a = vec_id) AS n_links, component_id, vec_id = component_id AS kept
    FROM v JOIN component ON component.id = v.vec_id"""


def _vector_codes(rounds: int = 4) -> str:
    """Every round compares all parts with all entries; whole numbers are exact as doubles."""
    steps = """kept AS (SELECT vec_id, label, [floor(1024 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v FROM embeddings
                   WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
         parts AS (SELECT vec_id, label, p, v[p * (len(v) // 4) + 1 : (p + 1) * (len(v) // 4)] AS x
                   FROM kept, (SELECT unnest(range(4)) AS p)),
         seeds AS (SELECT vec_id, ROW_NUMBER() OVER (ORDER BY vec_id) - 1 AS e FROM kept ORDER BY vec_id LIMIT 256),
         book0 AS (SELECT p, e, x AS c FROM parts JOIN seeds USING (vec_id)),"""
    for turn in range(rounds + 1):
        steps += f"""
         near{turn} AS (SELECT vec_id, any_value(label) AS label, p, any_value(x) AS x, MIN(d * 256 + e) AS best FROM (
                          SELECT parts.*, e, CAST(list_inner_product(x, x) - 2 * list_inner_product(x, c)
                                                  + list_inner_product(c, c) AS BIGINT) AS d
                          FROM parts JOIN book{turn} USING (p)) GROUP BY vec_id, p),"""
        if turn < rounds:
            steps += f"""
         mean{turn} AS (SELECT p, e, list(floor(total / n) ORDER BY i) AS c FROM (
                          SELECT p, e, i, SUM(y) AS total, COUNT(*) AS n FROM (
                            SELECT p, best % 256 AS e, unnest(x) AS y, generate_subscripts(x, 1) AS i FROM near{turn})
                          GROUP BY p, e, i) GROUP BY p, e),
         book{turn + 1} AS (SELECT p, e, COALESCE(m.c, b.c) AS c FROM book{turn} b LEFT JOIN mean{turn} m USING (p, e)),"""
    return f"""
    WITH {steps}
         sealed AS (SELECT sha256(string_agg(list_aggregate([CAST(CAST(y AS BIGINT) AS VARCHAR) FOR y IN c], 'string_agg', ','), ',' ORDER BY p, e)) AS s
                    FROM book{rounds}),
         coded AS (SELECT vec_id, any_value(label) AS label, CAST(SUM(best // 256) AS BIGINT) AS error,
                          string_agg(lower(printf('%02x', best % 256)), '' ORDER BY p) AS code FROM near{rounds} GROUP BY vec_id)
    SELECT vec_id, code, error, CAST(SUM(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, s AS codebooks_sha256
    FROM coded, sealed"""


VECTOR_CODES = _vector_codes()

#: Bytes of a text, each followed by eight -1: a step of CRC-32 takes a byte in, or shifts by a bit.
_STEPS = """flatten([[16 * (strpos('0123456789ABCDEF', substr(h, 2 * k - 1, 1)) - 1) + strpos('0123456789ABCDEF', substr(h, 2 * k, 1)) - 1,
                          -1, -1, -1, -1, -1, -1, -1, -1] FOR k IN range(1, length(h) // 2 + 1)])"""
_CRC = f"""xor(list_reduce(list_concat([4294967295::BIGINT], {_STEPS}), lambda c, x: CASE WHEN x >= 0 THEN xor(c, x)
              WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END), 4294967295::BIGINT)"""
_DIGITS = "list_reduce([strpos('0123456789abcdef', c) - 1 FOR c IN string_split(substr(sha256('7:' || COALESCE(CAST(doc_id AS VARCHAR), '')), 1, 8), '')], lambda a, b: 16 * a + b)"

IMPORTANCE = f"""
    WITH texts AS (SELECT 1 AS side, doc_id, COALESCE({_LETTERS}, []) AS w FROM documents
                   UNION ALL SELECT 0, NULL, COALESCE({_LETTERS}, []) FROM benchmark),
         features AS (SELECT side, doc_id, unnest(list_concat(w, [w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))])) AS f FROM texts),
         hashed AS (SELECT f, {_CRC} % 10000 AS bucket FROM (SELECT f, hex(f) AS h FROM (SELECT DISTINCT f FROM features))),
         placed AS (SELECT side, doc_id, bucket FROM features JOIN hashed USING (f)),
         counts AS (SELECT bucket, CAST(SUM(side) AS DOUBLE) AS s, CAST(SUM(1 - side) AS DOUBLE) AS t FROM placed GROUP BY 1),
         totals AS (SELECT SUM(s) AS all_s, SUM(t) AS all_t FROM counts),
         gains AS (SELECT bucket, floor(1000 * ln((t + 1) * (all_s + 10000) / ((s + 1) * (all_t + 10000)))) AS gain FROM counts, totals),
         weights AS (SELECT doc_id, CAST(floor(SUM(gain) / COUNT(*)) AS BIGINT) AS weight
                     FROM placed JOIN gains USING (bucket) WHERE side = 1 GROUP BY 1),
         scored AS (SELECT doc_id, len(w) AS n_words, CAST(len(w) + greatest(len(w) - 1, 0) AS BIGINT) AS n_features,
                           COALESCE(weight, 0) AS weight,
                           COALESCE(weight, 0) + CAST(floor(-1000 * ln(-ln(({_DIGITS} + CAST(0.5 AS DOUBLE)) / 4294967296))) AS BIGINT) AS score
                    FROM texts LEFT JOIN weights USING (doc_id) WHERE side = 1),
         ranked AS (SELECT doc_id, ROW_NUMBER() OVER (ORDER BY score DESC, doc_id) AS rank, COUNT(*) OVER () AS n
                    FROM scored WHERE n_words >= 20)
    SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 25 * n // 100 THEN rank END AS rank
    FROM scored LEFT JOIN ranked USING (doc_id)"""
