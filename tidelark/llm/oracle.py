"""SQL that gives the same rows as the queries that SQL can express, over whole tables."""

_WORDS = r"w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x09-\x0D\x20]+') AS w FROM documents)"

OP1 = rf"""WITH {_WORDS},
p AS (SELECT doc_id, unnest(range(1, len(w) - 48)) AS p, w FROM w WHERE len(w) >= 50),
g AS (SELECT doc_id, p, md5(array_to_string(list_slice(w, p, p + 49), ' ')) AS g FROM p),
f AS (SELECT g, min(doc_id) AS first FROM g GROUP BY g),
h AS (SELECT g.doc_id, g.p FROM g JOIN f USING (g) WHERE f.first < g.doc_id),
c AS (SELECT DISTINCT doc_id, p + o AS i FROM h, (SELECT unnest(range(0, 50)) AS o) q),
t AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM w),
k AS (SELECT t.doc_id, string_agg(t.word, ' ' ORDER BY t.i) FILTER (c.i IS NULL) AS kept, count(c.i) AS n_removed FROM t LEFT JOIN c ON c.doc_id = t.doc_id AND c.i = t.i GROUP BY 1)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, coalesce(k.n_removed, 0) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)"""

OP6 = rf"""WITH RECURSIVE {_WORDS},
t AS (SELECT doc_id, w, array_to_string(w, ' ') AS t FROM w),
r AS (SELECT t, min(doc_id) AS rep, count(*) AS n_copies FROM t WHERE len(w) > 0 GROUP BY t),
s AS (SELECT DISTINCT t.doc_id, array_to_string(list_slice(t.w, p.p, p.p + 4), ' ') AS s FROM t JOIN r ON r.rep = t.doc_id, LATERAL (SELECT unnest(range(1, greatest(2, len(t.w) - 3))) AS p) p),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
b AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM b JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE shared >= 0.8 * (x.n + y.n - shared)),
q(a, root) AS (SELECT DISTINCT a, a FROM l UNION SELECT l.b, q.root FROM q JOIN l ON l.a = q.a),
c AS (SELECT a, min(root) AS root FROM q GROUP BY a),
k AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT t.doc_id, coalesce(c.root, r.rep, t.doc_id) AS class_id, coalesce(k.n_links, 0) AS n_links, coalesce(r.n_copies, 1) AS n_copies FROM t LEFT JOIN r ON r.t = t.t AND len(t.w) > 0 LEFT JOIN c ON c.a = r.rep LEFT JOIN k ON k.a = r.rep"""

_LOW = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP10 = rf"""WITH w AS (SELECT doc_id, {_LOW} AS w FROM documents), i AS (SELECT item_id, {_LOW} AS w FROM benchmark),
x AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(list_slice(w, p.p, p.p + least(10, len(w)) - 1), ' ') AS g FROM i, LATERAL (SELECT unnest(range(1, greatest(2, len(w) - 8))) AS p) p WHERE len(w) > 0),
z AS (SELECT DISTINCT n FROM x),
p AS (SELECT doc_id, n, unnest(range(1, CAST(len(w) - n + 2 AS BIGINT))) AS p, w FROM w, z WHERE len(w) >= n),
h AS (SELECT p.doc_id, p.p, p.n, x.item_id FROM (SELECT doc_id, n, p, array_to_string(list_slice(w, p, p + n - 1), ' ') AS g FROM p) p JOIN x ON x.g = p.g AND x.n = p.n),
c AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(p, CAST(p + n AS BIGINT))) AS j FROM (SELECT DISTINCT doc_id, p, n FROM h) u) q GROUP BY 1),
m AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) q GROUP BY 1)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM w LEFT JOIN c USING (doc_id) LEFT JOIN m USING (doc_id)"""

#: The table of CRC-32, whose polynomial is 0xEDB88320; hex digits of a text's bytes are folded over it.
_CRC = "tab AS (SELECT list(list_reduce([i,0,0,0,0,0,0,0,0], lambda c, b: CASE WHEN c & 1 = 1 THEN xor(3988292384::BIGINT, c >> 1) ELSE c >> 1 END) ORDER BY i) AS t FROM (SELECT unnest(range(256)) AS i) q)"


def _crc32(hexed: str) -> str:
    digits = f"list_transform(regexp_extract_all({hexed}, '..'), lambda x: ('0x' || x)::BIGINT)"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, {digits}), lambda c, x: xor(c >> 8, tab.t[(xor(c, x) & 255) + 1])))"


def _more(value: str, cost: str, letter: str) -> str:
    """A cost of eight digits and the letters after it, with one edit more in front."""
    return f"printf('%08d', substr({value}, 1, 8)::INTEGER + {cost}) || '{letter}' || substr({value}, 9)"


def _edited(state: int, keeps: dict[str, str], reroled: str) -> str:
    stays = "(CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END)"
    kept = "CASE initial " + " ".join(f"WHEN '{i}' THEN {v}" for i, v in {**keeps, "": f"v{state}"}.items()) + " END"
    free = "CASE WHEN fault IN ('blank', 'duplicate') THEN NULL ELSE least({}, {}) END".format(_more(f"({kept})", stays, "K"), _more(reroled, f"2 + {stays}", "R"))
    return f"least({_more(f'v{state}', '3', 'D')}, {free}) AS w{state}"


_BACK = ", ".join([_edited(0, {"s": "v1", "u": "v2"}, "v2"), _edited(1, {"u": "v2"}, "v2"), _edited(2, {"a": "v3"}, "v3"), _edited(3, {"u": "v2"}, "v2")])
_U = f"least(w2, {_more('w3', '2', 'I')})"

OP11 = rf"""WITH RECURSIVE {_CRC},
k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, hex(encode(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))) AS h FROM conversations),
d AS (SELECT conv_id, turn, role, text, {_crc32("h")} % 20 AS d FROM k, tab),
e AS (SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role, CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN d = 3 THEN [0, 1] ELSE [0] END) AS copy FROM d WHERE d <> 0),
g AS (SELECT conv_id, row_number() OVER (ORDER BY conv_id) AS c FROM (SELECT DISTINCT conv_id FROM conversations) q),
j AS (SELECT g.c, turn, role, text, left(role, 1) AS initial, row_number() OVER (PARTITION BY g.c ORDER BY turn NULLS FIRST, role, text) AS i FROM e JOIN g ON g.conv_id IS NOT DISTINCT FROM e.conv_id),
r AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' END AS fault FROM j),
x AS (SELECT *, initial || lead(initial) OVER (PARTITION BY c ORDER BY i) AS pair FROM r),
n AS (SELECT c, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM x GROUP BY c),
b(c, i, v0, v1, v2, v3) AS (SELECT c, n, '00000000', '00000004II', '00000002I', '00000000' FROM n
  UNION ALL SELECT c, i, least(w0, {_more(_U, "2", "I")}), least(w1, {_more(_U, "2", "I")}), {_U}, least(w3, {_more("w2", "2", "I")})
  FROM (SELECT b.c, b.i - 1 AS i, {_BACK} FROM b JOIN r ON r.c = b.c AND r.i = b.i) q),
o AS (SELECT c, substr(v0, 1, 8)::BIGINT AS cost, substr(v0, 9) AS audit FROM b WHERE i = 0),
a(c, p, i, state, letter) AS (SELECT c, 0, 0::BIGINT, 0, '' FROM o
  UNION ALL SELECT c, p, i, CASE WHEN letter = 'D' OR letter = 'K' AND initial = '' THEN state WHEN letter = 'K' THEN CASE initial WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END ELSE CASE state WHEN 2 THEN 3 ELSE 2 END END, letter
  FROM (SELECT a.c, a.p + 1 AS p, m.i, a.state, substr(o.audit, a.p + 1, 1) AS letter, coalesce(r.initial, '') AS initial FROM a JOIN o ON o.c = a.c AND a.p < length(o.audit), LATERAL (SELECT a.i + CASE WHEN substr(o.audit, a.p + 1, 1) = 'I' THEN 0 ELSE 1 END AS i) m LEFT JOIN r ON r.c = a.c AND r.i = m.i) q),
z AS (SELECT a.c, string_agg(CASE a.letter WHEN 'K' THEN r.role || ':' || r.text ELSE CASE a.state WHEN 2 THEN 'user:' ELSE 'assistant:' END || CASE a.letter WHEN 'R' THEN r.text ELSE '' END END, chr(10) ORDER BY a.p) AS text FROM a LEFT JOIN r ON r.c = a.c AND r.i = a.i WHERE a.letter IN ('K', 'R', 'I') GROUP BY 1)
SELECT g.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(z.text, '')) AS repaired_sha256
FROM g LEFT JOIN n USING (c) LEFT JOIN o USING (c) LEFT JOIN z USING (c)"""

OP12 = f"""WITH {_CRC},
h AS (SELECT doc_id, source, strlen(coalesce(text, '')) + 8 AS size, hex(encode(coalesce(text, ''))) AS h FROM documents),
d AS (SELECT doc_id, source, size, {_crc32("h")} AS crc FROM h, tab),
k AS (SELECT *, md5('0:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || crc) AS k FROM d),
f AS (SELECT *, (row_number() OVER (PARTITION BY source ORDER BY k, doc_id) - 0.5::DOUBLE) / count(*) OVER (PARTITION BY source) AS f FROM k),
p AS (SELECT *, row_number() OVER (ORDER BY f, k, source, doc_id) - 1 AS p, count(*) OVER () AS n FROM f)
SELECT doc_id, size, crc AS text_crc32, 'rows' AS law, CAST(p * 24 // n AS INTEGER) AS shard, p - ((p * 24 // n) * n + 23) // 24 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM p"""

OP13 = """WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label AS own, b.vec_id AS id, b.label, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM e a JOIN e b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score, own FROM s WHERE own = label QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (SELECT anchor_id, positive_id, positive_score, id AS negative_id, score AS negative_score, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS rank FROM p JOIN s USING (anchor_id, own) WHERE s.label <> own AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3"""
