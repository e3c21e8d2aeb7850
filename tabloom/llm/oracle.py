"""DuckDB SQL for the operators that SQL can express over whole tables."""

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1 = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
item AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(list_slice(w, i, i + 9), ' ') AS win
         FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 8))) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM item),
place AS (SELECT doc_id, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS win
          FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT doc_id, i, n, item_id FROM place JOIN item USING (n, win)),
hit_words AS (SELECT doc_id, count(DISTINCT k) AS n_hit
              FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit_words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

# arrivals: every place a call can get from itself and from what it needs, hop by hop; with as many hops as
# the conversation has calls one of them comes twice
OP2 = """
WITH RECURSIVE t AS (SELECT CAST(conv_id AS VARCHAR) AS conv_id, turn, role, length(coalesce(text, '')) AS n,
                  CAST(to_json(coalesce(text, '')) AS VARCHAR) AS q FROM conversations),
raw AS (SELECT conv_id, turn, n, 'call-' || turn AS call_id,
               CASE n % 4 WHEN 0 THEN 'search' WHEN 1 THEN 'lookup' WHEN 2 THEN 'measure' ELSE 'browse' END AS name,
               CASE n % 4
                 WHEN 0 THEN '{"limit":' || (n % 45) || ',"query":' || q || '}'
                 WHEN 1 THEN '{"exact":' || CASE WHEN n % 7 = 0 THEN '"yes"' WHEN n % 2 = 0 THEN 'true' ELSE 'false' END
                             || ',"key":' || q || '}'
                 WHEN 2 THEN '{"of":' || q || ',"unit":"' || CASE WHEN n % 5 = 0 THEN 'lines' WHEN n % 2 = 0 THEN 'words' ELSE 'chars' END
                             || '","value":' || n || '}'
                 ELSE '{"page":' || q || '}' END AS args,
               CASE n % 4
                 WHEN 0 THEN CASE WHEN n % 45 < 1 THEN 'limit: too small' WHEN n % 45 > 40 THEN 'limit: too large' ELSE '' END
                 WHEN 1 THEN CASE WHEN n % 7 = 0 THEN 'exact: not boolean' ELSE '' END
                 WHEN 2 THEN CASE WHEN n % 5 = 0 THEN 'unit: not allowed' ELSE '' END
                 ELSE 'unknown tool' END AS problems
        FROM t WHERE role IN ('user', 'system')),
call AS (SELECT *, count(*) OVER (PARTITION BY conv_id, call_id) AS copies, count(*) OVER (PARTITION BY conv_id) AS calls FROM raw),
edge AS (SELECT c.conv_id, c.call_id, d.call_id AS dep
         FROM (SELECT conv_id, call_id, turn - 2 AS at FROM call WHERE n % 3 = 0
               UNION SELECT conv_id, call_id, turn + 2 FROM call WHERE n % 5 = 0
               UNION SELECT conv_id, call_id, turn + 4 FROM call WHERE n % 7 = 0) c
         JOIN call d ON d.conv_id = c.conv_id AND d.turn = c.at),
arrival AS (SELECT conv_id, call_id, turn AS p, CAST(0 AS BIGINT) AS h, calls FROM call
            UNION SELECT edge.conv_id, edge.call_id, p, h + 1, calls FROM arrival
                  JOIN edge ON edge.conv_id = arrival.conv_id AND edge.dep = arrival.call_id WHERE h < calls),
place AS (SELECT conv_id, call_id, max(struct_pack(p := p, h := h)) AS k, max(h) >= any_value(calls) AS cyclic
          FROM arrival GROUP BY conv_id, call_id),
answer AS (SELECT conv_id, 'call-' || CASE WHEN n % 11 = 0 THEN turn + 1 ELSE turn - 1 END AS call_id,
                  min(struct_pack(turn := turn, content := '{"content":' || q || ',"size":' || n || '}')) AS a
           FROM t WHERE role = 'assistant' GROUP BY 1, 2)
SELECT conv_id, call_id, name, copies, CASE WHEN NOT cyclic THEN k.p END AS order_pos,
       CAST(CASE WHEN NOT cyclic THEN k.h END AS INTEGER) AS order_hop,
       CASE WHEN cyclic THEN 'cyclic' WHEN problems <> '' THEN 'invalid' WHEN a IS NULL THEN 'no_result'
            WHEN a.turn < call.turn THEN 'result_before_call' ELSE 'ok' END AS status, problems,
       '{"arguments":' || args || ',"id":"' || call_id || '","name":"' || name || '"}' AS call_json,
       '{"content":' || a.content || ',"id":"' || call_id || '"}' AS result_json
FROM call JOIN place USING (conv_id, call_id) LEFT JOIN answer USING (conv_id, call_id)
"""

_HASH = "CAST('0x' || substr(md5('20240601:' || {k} || ':' || {half}), 1, 15) AS BIGINT)"


def _rounds(n: int = 6) -> str:
    sql = "SELECT x, x // b AS l, x % b AS r, a, b FROM cells"
    for k in range(n):
        if k % 2 == 0:
            sql = f"SELECT x, (l + {_HASH.format(k=k, half='r')} % a) % a AS l, r, a, b FROM ({sql})"
        else:
            sql = f"SELECT x, l, (r + {_HASH.format(k=k, half='l')} % b) % b AS r, a, b FROM ({sql})"
    return sql


OP3 = f"""
WITH RECURSIVE crc_table AS (SELECT list_transform(range(256), lambda x: list_reduce(list_concat([x], range(8)),
    lambda c, k: xor(c >> 1, 3988292384 * (c & 1)))) AS t),
sums AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 8 AS size,
                xor(list_reduce(list_concat([4294967295],
                    list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: CAST('0x' || h AS BIGINT))),
                    lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295) AS text_crc32
         FROM documents, crc_table),
numbered AS (SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS row,
                    count(*) OVER () AS n FROM sums),
grid AS (SELECT n, a, CAST(ceil(n / a) AS BIGINT) AS b
         FROM (SELECT max(n) AS n, CAST(floor(sqrt(max(n) - 1)) AS BIGINT) + 1 AS a FROM numbered)),
cells AS (SELECT unnest(range(a * b)) AS x, a, b FROM grid),
step AS (SELECT x, l * b + r AS y FROM ({_rounds()})),
walk AS (SELECT x AS row, y AS p FROM step, grid WHERE x < n
         UNION ALL SELECT row, y FROM walk JOIN step ON p = x JOIN grid ON p >= n)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'rows' AS law, CAST(p % 24 AS INTEGER) AS shard,
       CAST(p // 24 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM numbered JOIN walk USING (row) WHERE p < n
"""

OP6 = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 3), ' ') AS g, least(len(w), 4) AS n
      FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 2))) AS i FROM d WHERE len(w) > 0)),
size AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pair AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k
         FROM s x JOIN s y ON x.g = y.g AND x.n = y.n AND x.doc_id <> y.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM pair JOIN size p ON a = p.doc_id JOIN size q ON b = q.doc_id
         WHERE 100 * k >= 80 * (p.n + q.n - k)),
reach AS (SELECT a, b FROM link UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
low AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(size.n, 0) AS n_shingles, least(d.doc_id, coalesce(low.b, d.doc_id)) AS component_id,
       least(d.doc_id, coalesce(low.b, d.doc_id)) = d.doc_id AS kept
FROM d LEFT JOIN size USING (doc_id) LEFT JOIN low ON low.a = d.doc_id
"""

# terms: letters and all that lies outside ASCII, only A-Z lower-cased
OP12 = """
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, CAST(count(*) AS HUGEINT) AS total FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
size AS (SELECT lang, count(*) AS v, sum(total) AS lang_n FROM kept GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY ALL),
g AS (SELECT lang, source, coalesce(sum(n), 0) AS group_n FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source)
      GROUP BY lang, source),
p AS (SELECT g.lang, g.source, kept.term, coalesce(n, 0) AS n,
             1 + (1000000000 * CAST(coalesce(n, 0) + 1 AS HUGEINT)) // (group_n + v) AS p,
             1 + (1000000000 * (total + 1)) // (lang_n + v) AS q
      FROM g JOIN kept USING (lang) JOIN size USING (lang) LEFT JOIN c USING (lang, source, term)),
pair AS (SELECT a.lang, a.source, b.source AS item, CAST(sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS BIGINT) AS value
         FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
found AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
          FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source
          UNION ALL
          SELECT lang, source, 'term', term, CAST(((p - q) * (p - q)) // q AS BIGINT) FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM found)
WHERE part = 'pair' OR rank <= 200
"""


def op13(entries: int = 16, rounds: int = 6) -> str:
    """Lloyd rounds one after the other: assign every part, then take floored means."""
    near = """a{i} AS MATERIALIZED (SELECT r, p, any_value(x) AS x, min(struct_pack(d := d, k := k)) AS best FROM (
        SELECT r, p, k, x, CAST(list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - c[i]) * (x[i] - c[i]))) AS BIGINT) AS d
        FROM part JOIN b{i} USING (p)) GROUP BY r, p)"""
    mean = """b{j} AS MATERIALIZED (SELECT p, k, coalesce(m, c) AS c FROM b{i} LEFT JOIN (
        SELECT p, k, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS m FROM (
            SELECT p, best.k AS k, i, sum(x[i]) AS s, count(*) AS n
            FROM (SELECT p, best, x, unnest(range(1, len(x) + 1)) AS i FROM a{i}) GROUP BY ALL) GROUP BY p, k) USING (p, k))"""
    steps = [near.format(i=0)]
    for i in range(rounds):
        steps += [mean.format(i=i, j=i + 1), near.format(i=i + 1)]
    return f"""
WITH v AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label,
                  list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
           FROM embeddings WHERE embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
part AS MATERIALIZED (SELECT r, p, list_slice(e, p * (len(e) // 8) + 1, (p + 1) * (len(e) // 8)) AS x FROM v, range(8) AS t(p)),
b0 AS MATERIALIZED (SELECT p, r - 1 AS k, x AS c FROM part WHERE r <= {entries}),
{', '.join(steps)},
codes AS (SELECT r, string_agg(lower(printf('%02x', best.k)), '' ORDER BY p) AS code, CAST(sum(best.d) AS BIGINT) AS error
          FROM a{rounds} GROUP BY r),
digest AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, k)) AS h FROM b{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256
FROM codes JOIN v USING (r), digest
"""


OP13 = op13()
