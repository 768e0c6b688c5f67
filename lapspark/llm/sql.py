"""DuckDB SQL that computes the same rows as the queries of ``queries.py``, where SQL can."""

from __future__ import annotations

from lapspark.llm.sentence_spans import SEGMENT
from lapspark.llm.secret_scan import ACCESS, ASSIGN, EXAMPLE, HEX, KINDS, OPAQUE


def _spans(kind: int, pattern: str, group: int, least: int) -> str:
    quoted = pattern.replace("'", "''")
    return f"""
    SELECT doc_id, source, {kind} AS rank, pos + gap AS "start", pos + gap + hit AS "end", value FROM (
        SELECT *, coalesce(sum(gap + hit) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos
        FROM (
            SELECT doc_id, source, unnest(range(len(hits))) AS i, unnest(list_transform(hits, lambda h: length(h))) AS hit,
                   unnest(list_transform(gaps[:len(hits)], lambda g: length(g))) AS gap, unnest(vals) AS value
            FROM (
                SELECT doc_id, source, regexp_extract_all(body, '{quoted}', 0) AS hits,
                       string_split_regex(body, '{quoted}') AS gaps, regexp_extract_all(body, '{quoted}', {group}) AS vals
                FROM texts WHERE regexp_matches(body, '{quoted}')
            )
        )
    ) WHERE length(value) >= {least}"""


OP1_SECRET_SCANS = f"""
WITH texts AS (SELECT doc_id, source, coalesce(text, '') AS body FROM documents),
found AS (
    {_spans(0, ASSIGN, 2, 12)} UNION ALL {_spans(1, ACCESS, 0, 0)} UNION ALL {_spans(2, HEX, 0, 0)}
    UNION ALL {_spans(3, OPAQUE, 0, 0)}
),
judged AS (
    SELECT *, (['{"','".join(KINDS)}'])[rank + 1] || ':' || "start"::BIGINT || ':' || "end"::BIGINT AS written,
           regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]')
           AND NOT regexp_matches(lower(value), '{EXAMPLE}')
           AND len(list_distinct(string_split(value, ''))) >= 8 AS looks_live
    FROM found
),
spread AS (SELECT value, count(DISTINCT source) AS n_owners FROM judged WHERE rank < 3 OR looks_live GROUP BY value),
kept AS (
    SELECT j.*, looks_live AND n_owners <= 1 AS is_live, n_owners > 1 AS is_copied
    FROM judged j JOIN spread USING (value)
    WHERE rank < 3 OR (looks_live AND n_owners <= 1 AND NOT EXISTS (
        SELECT 1 FROM judged b WHERE b.rank < 3 AND b.doc_id = j.doc_id AND b."start" < j."end" AND b."end" > j."start"))
),
per_doc AS (
    SELECT doc_id, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access,
           count(*) FILTER (rank = 2) AS n_hex,
           string_agg(written, ',' ORDER BY "start", rank) FILTER (rank < 3) AS base,
           string_agg(written, ',' ORDER BY "start", rank) AS spans,
           count(*) FILTER (is_live) AS n_live, count(*) FILTER (is_copied) AS n_copied
    FROM kept GROUP BY doc_id
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live,
       coalesce(n_copied, 0) AS n_copied
FROM texts LEFT JOIN per_doc USING (doc_id)
"""


OP7_EXACT_TOPK = """
WITH clean AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
    FROM clean q JOIN clean c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 10
"""

_PARTS = SEGMENT.replace("'", "''")
OP4_SENTENCE_SPANS = f"""
WITH parts AS (
    SELECT doc_id, generate_subscripts(p, 1) AS place, unnest(p) AS part
    FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_PARTS}') AS p FROM documents)
),
sentences AS (
    SELECT *, trim(part, E' \\t\\n\\r\\f\\v') AS sentence FROM parts
),
numbered AS (
    SELECT doc_id, place, sentence, row_number() OVER (PARTITION BY doc_id ORDER BY place) - 1 AS number,
           count(*) OVER (PARTITION BY doc_id) AS total
    FROM sentences WHERE sentence <> ''
),
spans AS (
    SELECT doc_id, number, total, concat_ws(chr(10), sentence, lead(sentence, 1) OVER w, lead(sentence, 2) OVER w) AS span
    FROM numbered WINDOW w AS (PARTITION BY doc_id ORDER BY place)
),
later AS (
    SELECT doc_id, number FROM (
        SELECT *, row_number() OVER (PARTITION BY span ORDER BY doc_id, number) AS nth FROM spans
        WHERE number = 0 OR number <= total - 3
    ) WHERE nth > 1
),
gone AS (
    SELECT DISTINCT n.doc_id, n.place FROM numbered n JOIN later l ON n.doc_id = l.doc_id AND n.number - l.number BETWEEN 0 AND 2
),
kept AS (
    SELECT p.doc_id, string_agg(p.part, '' ORDER BY p.place) FILTER (g.place IS NULL) AS text, count(g.place) AS n_removed
    FROM parts p LEFT JOIN gone g USING (doc_id, place) GROUP BY p.doc_id
),
counts AS (SELECT doc_id, max(total) AS total FROM numbered GROUP BY doc_id)
SELECT doc_id, coalesce(total, 0) AS n_sentences, coalesce(n_removed, 0) AS n_removed,
       sha256(coalesce(k.text, '')) AS kept_sha256
FROM documents d LEFT JOIN kept k USING (doc_id) LEFT JOIN counts USING (doc_id)
"""

_CRC_TABLE = """
crc_table AS (
    SELECT b, list_reduce(list_prepend(b::BIGINT, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS t
    FROM (SELECT unnest(range(256)) AS b)
)"""

OP12_MINHASH = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
    FROM documents
),
shingles AS (
    SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM words WHERE len(w) > 0)
),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
    GROUP BY a.doc_id, b.doc_id
),
links AS (
    SELECT a, b FROM common c JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c.n >= 85 * (x.n + y.n - c.n)
),
reached(doc_id, other) AS (
    SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM reached r JOIN links l ON l.a = r.other
)
SELECT doc_id, any_value(coalesce(n, 0)) AS n_shingles, min(other) AS component_id, doc_id = min(other) AS kept
FROM reached LEFT JOIN sizes USING (doc_id) GROUP BY doc_id
"""

# The CRC-32 of n bytes is the xor of what each byte leaves at its distance from the end, and of the value of n zero bytes.
OP11_IMPORTANCE_RESAMPLING = f"""
WITH RECURSIVE {_CRC_TABLE},
texts AS (
    SELECT doc_id, 0 AS target, text FROM documents UNION ALL SELECT row_number() OVER (), 1, text FROM benchmark
),
words AS (
    SELECT row, doc_id, target, unnest(w) AS word, generate_subscripts(w, 1) AS place FROM (
        SELECT row_number() OVER () AS row, doc_id, target, regexp_extract_all(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
        FROM texts)
),
runs AS (SELECT *, lead(word, 1) OVER w AS second, lead(word, 2) OVER w AS third FROM words WINDOW w AS (PARTITION BY row ORDER BY place)),
grams AS (
    SELECT doc_id, target, word AS gram FROM runs UNION ALL SELECT doc_id, target, word || ' ' || second FROM runs WHERE second IS NOT NULL
    UNION ALL SELECT doc_id, target, word || ' ' || second || ' ' || third FROM runs WHERE third IS NOT NULL
),
counted AS (SELECT doc_id, target, gram, count(*) AS n FROM grams GROUP BY ALL),
hexed AS (SELECT gram, hex(encode(gram)) AS h FROM (SELECT DISTINCT gram FROM counted)),
shifts(k, b, t) AS (
    SELECT 0, b, t FROM crc_table
    UNION ALL
    SELECT k + 1, s.b, xor(s.t >> 8, c.t) FROM shifts s JOIN crc_table c ON c.b = s.t & 255
    WHERE k < (SELECT max(length(h)) // 2 FROM hexed)
),
zeros(k, z) AS (
    SELECT 0, 4294967295
    UNION ALL
    SELECT k + 1, xor(z >> 8, c.t) FROM zeros JOIN crc_table c ON c.b = z & 255 WHERE k < (SELECT max(length(h)) // 2 FROM hexed)
),
bytes AS (
    SELECT gram, length(h) // 2 - 1 - i AS k, ('0x' || substr(h, 2 * i::BIGINT + 1, 2))::INTEGER AS b
    FROM (SELECT gram, h, unnest(range(length(h) // 2)) AS i FROM hexed)
),
buckets AS (
    SELECT gram, xor(xor(x, z), 4294967295) % 10000 AS bucket FROM (
        SELECT gram, bit_xor(t) AS x, max(bytes.k) + 1 AS size FROM bytes JOIN shifts ON shifts.k = bytes.k AND shifts.b = bytes.b GROUP BY gram
    ) JOIN zeros ON zeros.k = size
),
per_bucket AS (
    SELECT bucket, coalesce(sum(n) FILTER (target = 0), 0) AS s, coalesce(sum(n) FILTER (target = 1), 0) AS t
    FROM counted JOIN buckets USING (gram) GROUP BY bucket
),
totals AS (SELECT sum(s) AS s_all, sum(t) AS t_all FROM per_bucket),
gains AS (
    SELECT bucket, floor(1000 * ln(((t + 1)::DOUBLE * (s_all + 10000)::DOUBLE) / ((s + 1)::DOUBLE * (t_all + 10000)::DOUBLE)))::BIGINT AS gain
    FROM per_bucket, totals
),
weights AS (
    SELECT doc_id, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight
    FROM counted JOIN buckets USING (gram) JOIN gains USING (bucket) WHERE target = 0 GROUP BY doc_id
),
sizes AS (SELECT doc_id, count(*) AS n_words FROM words WHERE target = 0 GROUP BY doc_id),
scored AS (
    SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
           coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
    FROM documents LEFT JOIN weights USING (doc_id) LEFT JOIN sizes USING (doc_id)
),
ranked AS (
    SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM scored WHERE n_words >= 20
)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 5 * n // 100 THEN rank END AS rank
FROM scored LEFT JOIN ranked USING (doc_id)
"""

OP13_MERKLE_MANIFEST = f"""
WITH RECURSIVE {_CRC_TABLE},
crc_list AS (SELECT list(t ORDER BY b) AS t FROM crc_table),
crcs AS (
    SELECT doc_id, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
               lambda s, c: xor(s >> 8, t[(xor(s, c) & 255) + 1])), 4294967295) AS crc
    FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL), crc_list
),
head AS (
    SELECT doc_id, lang, text, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lowered,
           concat(coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'),
                  coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-')) AS head
    FROM documents
),
leaves AS (
    SELECT doc_id, lang, lowered, head, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf FROM head
),
placed AS (
    SELECT l.doc_id, lang, leaf,
           CASE WHEN crc % 3 = 0 THEN sha256(head || coalesce(strlen(lowered) || ':' || lowered, '-')) ELSE leaf END AS changed,
           row_number() OVER (PARTITION BY lang ORDER BY l.doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n,
           row_number() OVER (ORDER BY lang, l.doc_id, leaf) AS row
    FROM leaves l LEFT JOIN crcs c ON l.doc_id = c.doc_id
),
low(lang, level, pos, n, digest) AS (
    SELECT lang, 0, pos, n, leaf FROM placed
    UNION ALL
    SELECT lang, level + 1, pos // 8, (any_value(n) + 7) // 8, sha256(string_agg(digest, '' ORDER BY pos))
    FROM low WHERE n > 1 GROUP BY lang, level, pos // 8
),
subroots AS (
    SELECT lang, digest, level, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM low WHERE n = 1
),
high(level, pos, n, digest) AS (
    SELECT 0, pos, n, digest FROM subroots
    UNION ALL
    SELECT level + 1, pos // 8, (any_value(n) + 7) // 8, sha256(string_agg(digest, '' ORDER BY pos)) FROM high WHERE n > 1
    GROUP BY level, pos // 8
),
low_way(row, lang, level, pos, value, proof) AS (
    SELECT row, lang, 0, pos, changed, '' FROM placed
    UNION ALL
    SELECT w.row, w.lang, w.level + 1, w.pos // 8,
           sha256(string_agg(CASE WHEN t.pos = w.pos THEN w.value ELSE t.digest END, '' ORDER BY t.pos)),
           w.proof || coalesce(string_agg(t.digest, '' ORDER BY t.pos) FILTER (t.pos <> w.pos), '')
    FROM low_way w JOIN low t ON t.lang IS NOT DISTINCT FROM w.lang AND t.level = w.level AND t.pos // 8 = w.pos // 8
    WHERE t.n > 1 GROUP BY w.row, w.lang, w.level, w.pos, w.value, w.proof
),
high_way(row, level, pos, value, proof) AS (
    SELECT w.row, 0, s.pos, w.value, w.proof FROM low_way w JOIN subroots s ON s.lang IS NOT DISTINCT FROM w.lang AND s.level = w.level
    UNION ALL
    SELECT w.row, w.level + 1, w.pos // 8,
           sha256(string_agg(CASE WHEN t.pos = w.pos THEN w.value ELSE t.digest END, '' ORDER BY t.pos)),
           w.proof || coalesce(string_agg(t.digest, '' ORDER BY t.pos) FILTER (t.pos <> w.pos), '')
    FROM high_way w JOIN high t ON t.level = w.level AND t.pos // 8 = w.pos // 8
    WHERE t.n > 1 GROUP BY w.row, w.level, w.pos, w.value, w.proof
),
root AS (SELECT level, digest FROM high WHERE n = 1)
SELECT p.doc_id, p.leaf, s.digest AS subroot, r.digest AS root, sha256(h.proof) AS proof_sha256, h.value AS folded_root,
       h.value = r.digest AS verified
FROM placed p
JOIN subroots s ON s.lang IS NOT DISTINCT FROM p.lang
JOIN root r ON true
JOIN high_way h ON h.row = p.row AND h.level = r.level
"""
