"""SQL of the operators' queries, for an engine that shares nothing with them.

Left out, and tested by brute force instead: token trees (1), block-max search (3), page trees (4) and gear
chunks (9), which SQL cannot express at a bearable cost."""
from __future__ import annotations

from . import licenses, quality

WORD = r"[^\x20\x09-\x0D]+"

OP2 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
     d AS (SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha1(h) AS payload_digest FROM p),
     m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS top FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN top END AS refers_to
FROM m"""

# CRC-32 by its rule: bytes are folded through a table that is itself made of eight shifts per entry.
# The jump chain in 64-bit arithmetic kept in 128 bits.
OP5 = """
WITH RECURSIVE tab AS (
    SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM (SELECT unnest(range(256)) AS i))),
d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
h AS (SELECT doc_id, octet_length(b) AS n, hex(b) AS x FROM d),
c AS (SELECT doc_id, n, CASE WHEN n = 0 THEN 0 ELSE xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT,
        list_transform(range(n), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT)),
        lambda s, v: xor(s >> 8, t[(xor(s, v) & 255) + 1]))) END AS crc FROM h, tab),
j AS (SELECT doc_id, doc_id::HUGEINT AS k, 0::BIGINT AS landed, 0::BIGINT AS nxt, 0::BIGINT AS grown FROM documents
      UNION ALL
      SELECT doc_id, k2, CASE WHEN nxt < 24 THEN nxt ELSE landed END,
             floor((nxt + 1)::DOUBLE * (2147483648.0::DOUBLE / ((k2 // 8589934592) + 1)::DOUBLE))::BIGINT, nxt
      FROM (SELECT *, (k * 2862933555777941757::HUGEINT + 1) % 18446744073709551616::HUGEINT AS k2 FROM j WHERE nxt <= 24)),
s AS (SELECT doc_id, max(landed) AS shard, max(grown) AS grown_shard FROM j GROUP BY doc_id)
SELECT doc_id, (n + 8)::BIGINT AS size, crc::BIGINT AS text_crc32, 'key' AS law, shard::INT AS shard,
       (row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1)::BIGINT AS slot, grown_shard::INT AS grown_shard
FROM c JOIN s USING (doc_id)"""

OP6 = """
WITH RECURSIVE n AS (SELECT source, count(*) AS rows FROM documents GROUP BY source),
w AS (SELECT source, sqrt(rows::DOUBLE) / (SELECT sum(sqrt(rows::DOUBLE)) FROM n) * (SELECT sum(rows) FROM n)::DOUBLE / rows AS rate FROM n),
r AS (SELECT source, greatest(ceil(rate / 8.0::DOUBLE), 1)::INT AS pieces, rate / greatest(ceil(rate / 8.0::DOUBLE), 1) AS piece FROM w),
c AS (SELECT source, pieces, piece, 0 AS k, exp(-piece) AS p, exp(-piece) AS f FROM r
      UNION ALL SELECT source, pieces, piece, k + 1, p * piece / (k + 1), f + p * piece / (k + 1) FROM c WHERE k < 63),
d AS (SELECT doc_id, source, unnest(range(1, pieces + 1)) AS draw FROM documents JOIN r USING (source)),
u AS (SELECT doc_id, source, ('0x' || substr(md5(doc_id || ':' || draw || ':17'), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE AS u FROM d),
m AS (SELECT doc_id, any_value(u.source) AS source, count(*) AS copies FROM u JOIN c ON u.source = c.source AND c.f <= u.u GROUP BY doc_id),
e AS (SELECT doc_id, source, unnest(range(copies)) AS copy FROM m)
SELECT doc_id, source, copy::INT AS copy, ('0x' || substr(md5(doc_id || ':' || copy || ':place-17'), 1, 15))::BIGINT AS shuffle_key FROM e"""


def _op7() -> str:
    listed = ", ".join("'" + w.replace("'", "''") + "'" for w in quality.VOCABULARY)
    edges = r"^[.,;:!?\x22'()\[\]]+|[.,;:!?\x22'()\[\]]+$"
    fold = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    sides = {"lower": "[a-z]", "upper": "[A-Z]", "digit": "[0-9]", "space": r"[ \t\r\x0b\x0c]", "line": r"\n", "stop": "[.,;:!?\\x22'()-]", "symbol": "[#*$%&|<>]", "beyond": r"[^\x00-\x7F]"}
    counted = ", ".join(f"len(regexp_extract_all(t, '{p.replace(chr(39), chr(39) * 2)}'))::BIGINT AS c{i}" for i, p in enumerate(sides.values()))
    half = lambda p, q: f"(CASE WHEN {p} > 0 THEN {p} * ln(2 * {p} / ({p} + {q})) ELSE 0e0 END + CASE WHEN {q} > 0 THEN {q} * ln(2 * {q} / ({p} + {q})) ELSE 0e0 END)"
    cells = [f"c{i}" for i in range(9)]
    shares = list(quality.PRIOR_CLASSES.values())
    by_class = " + ".join(half(f"(f.{c}::DOUBLE / f.chars)", f"((g.{c} - f.{c} + {quality.PRIOR_CHARS * shares[i]!r}::DOUBLE) / (g.chars - f.chars + {float(quality.PRIOR_CHARS)!r}::DOUBLE))") for i, c in enumerate(cells))
    quoted = lambda w: "'" + w.replace("'", "''") + "'"
    prior = ", ".join(f"({quoted(lang)}, {quoted(w)}, {n!r}::DOUBLE)" for lang in (*quality.COMMON_WORDS, "*") for w, n in zip(quality.VOCABULARY, quality.prior_common(lang)) if n)
    known = ", ".join(map(quoted, quality.COMMON_WORDS))
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS lang FROM documents),
w AS (SELECT doc_id, lang, t, regexp_extract_all(t, '{WORD}') AS words FROM d),
f0 AS (SELECT doc_id, lang, len(words)::BIGINT AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars, length(t) AS chars, {counted} FROM w),
f AS (SELECT *, chars - ({' + '.join(cells[:8])}) AS c8 FROM f0),
g AS (SELECT lang, sum(n_words) AS n_words, sum(chars)::DOUBLE AS chars, {', '.join(f'sum({c}) AS {c}' for c in cells)} FROM f GROUP BY lang),
lines AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines WHERE regexp_matches(line, '{WORD}') GROUP BY doc_id),
win AS (SELECT doc_id, i, words[i:i + 7] AS v FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) >= 8)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, v) AS n FROM win) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, i + unnest(range(8)) AS p FROM twice) GROUP BY doc_id),
one AS (SELECT doc_id, lang, unnest(words) AS x FROM w),
hist AS (SELECT doc_id, lang, {fold.format(f"regexp_replace(x, '{edges.replace(chr(39), chr(39) * 2)}', '', 'g')")} AS x, count(*) AS n FROM one GROUP BY ALL),
common AS (SELECT doc_id, lang, x, sum(n) AS n FROM hist WHERE x IN ({listed}) GROUP BY ALL),
prior AS (SELECT lang, x, n FROM (VALUES {prior}) v(lang, x, n)),
heard AS (SELECT lang, x, sum(n) AS n FROM common GROUP BY lang, x),
langs AS (SELECT DISTINCT lang FROM f),
ref AS (SELECT l.lang, x, coalesce(h.n, 0) + coalesce(p.n, 0) AS n FROM langs l CROSS JOIN (SELECT DISTINCT x FROM prior) v
        LEFT JOIN heard h USING (lang, x) LEFT JOIN prior p ON p.x = v.x AND p.lang = CASE WHEN l.lang IN ({known}) THEN l.lang ELSE '*' END),
pair AS (SELECT f.doc_id, (ref.n - coalesce(c.n, 0))::DOUBLE / (g.n_words - f.n_words + {quality.PRIOR_WORDS}) AS q, coalesce(c.n, 0)::DOUBLE / f.n_words AS p
         FROM f JOIN g USING (lang) JOIN ref USING (lang) LEFT JOIN common c ON c.doc_id = f.doc_id AND c.x = ref.x WHERE f.n_words > 0),
js AS (SELECT doc_id, sum({half('p', 'q')}) AS s, sum(p) AS p, sum(q) AS q FROM pair GROUP BY doc_id),
wd AS (SELECT doc_id, sqrt(greatest(s + {half('(1 - js.p)', '(1 - js.q)')}, 0) / (2 * ln(2e0))) AS word_distance FROM js),
cd AS (SELECT f.doc_id, sqrt(greatest({by_class}, 0) / (2 * ln(2e0))) AS class_distance FROM f JOIN g USING (lang) WHERE f.chars > 0),
a AS (SELECT f.doc_id, f.n_words, f.word_chars, f.c6 AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
             CASE WHEN f.n_words >= {quality.GUARD_WORDS} THEN class_distance END AS class_distance,
             CASE WHEN f.n_words >= {quality.GUARD_WORDS} THEN word_distance END AS word_distance
      FROM f LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN wd ON wd.doc_id = f.doc_id LEFT JOIN cd ON cd.doc_id = f.doc_id),
v AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM a)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, round(class_distance, 6) AS class_distance, round(word_distance, 6) AS word_distance, base_failed,
       NOT base_failed AND NOT coalesce(greatest(class_distance, word_distance) > {quality.MAX_DISTANCE} + {quality.ALLOWANCE} / sqrt(n_words), false) AS kept
FROM v"""


# Places follow from the pieces between matches.  Weak parts are compared one by one.
OP8 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
kinds AS (SELECT * FROM (VALUES
    (0, 'assign', '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2, 6),
    (1, 'access', 'AKIA[A-Z0-9]+()', 0, 20), (2, 'hex', '[0-9a-f]+()', 0, 24),
    (3, 'ident', '(?i)(user|username|login|client_?id|key_?id)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9@_.-]+)', 2, 4),
    (4, 'opaque', '[A-Za-z0-9+/_-]{32,}()', 0, 32),
    (5, 'endpoint', '(?i)([a-z][a-z0-9+.-]*://[a-z0-9][a-z0-9.:/_-]*|[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+(:[0-9]+)?)', 0, 8)) v(kind, name, pattern, grp, least)),
m AS (SELECT doc_id, kind, unnest(range(1, len(whole) + 1)) AS i, whole, vals, gaps, least FROM (
        SELECT doc_id, kind, least, regexp_extract_all(t, pattern, 0) AS whole, CASE WHEN grp = 2 THEN regexp_extract_all(t, pattern, 2) ELSE regexp_extract_all(t, pattern, 0) END AS vals,
               string_split_regex(t, pattern) AS gaps FROM d, kinds)),
p AS (SELECT doc_id, kind, i, length(whole[i]) AS size, length(gaps[i]) AS gap, vals[i] AS val, least FROM m),
s AS (SELECT *, sum(gap + size) OVER (PARTITION BY doc_id, kind ORDER BY i) AS stop FROM p),
found AS (SELECT doc_id, kind, (stop - size)::BIGINT AS start, stop::BIGINT AS stop FROM s
          WHERE length(val) >= least AND (kind <> 4 OR (regexp_matches(val, '[0-9]') AND regexp_matches(val, '[A-Za-z]')))),
parts AS (SELECT * FROM found a WHERE kind <> 4 OR NOT EXISTS (SELECT 1 FROM found b WHERE b.doc_id = a.doc_id AND b.kind < 3 AND b.start < a.stop AND b.stop > a.start)),
near AS (SELECT a.doc_id, a.kind, a.start, bool_or(b.kind IN (1, 3)) AS i, bool_or(b.kind IN (0, 2, 4)) AS s FROM parts a JOIN parts b ON a.doc_id = b.doc_id AND abs(a.start - b.start) <= 200
         WHERE a.kind >= 3 GROUP BY ALL),
kept AS (SELECT p.* FROM parts p LEFT JOIN near n ON p.doc_id = n.doc_id AND p.kind = n.kind AND p.start = n.start
         WHERE p.kind < 3 OR (p.kind = 3 AND n.s) OR (p.kind = 4 AND n.i) OR (p.kind = 5 AND n.i AND n.s)),
listed AS (SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
                  string_agg(name || ':' || start || ':' || stop, ',' ORDER BY start, kind) FILTER (kind < 3) AS base, string_agg(name || ':' || start || ':' || stop, ',' ORDER BY start, kind) AS spans
           FROM kept JOIN kinds USING (kind) GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN listed USING (doc_id)"""

OP10 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS words FROM documents),
g AS (SELECT DISTINCT doc_id, gram FROM (
        SELECT doc_id, unnest(CASE WHEN len(words) >= 4 THEN list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' ')) WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END) AS gram FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
few AS (SELECT gram FROM g GROUP BY gram HAVING count(*) > 1),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM (SELECT * FROM g SEMI JOIN few USING (gram)) a JOIN (SELECT * FROM g SEMI JOIN few USING (gram)) b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
sides AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT a AS doc_id, a AS other FROM sides UNION SELECT r.doc_id, e.b FROM reach r JOIN sides e ON r.other = e.a),
root AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(root.component_id, d.doc_id) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN root USING (doc_id)"""

OP11 = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[\x20\x09-\x0D]*{WORD}|[\x20\x09-\x0D]+') AS tokens FROM d),
n AS (SELECT *, len(tokens)::BIGINT AS n, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2, ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM w),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
             CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM n),
s AS (SELECT *, array_to_string(tokens[1:a], '') AS prefix, array_to_string(tokens[a + 1:b], '') AS middle, array_to_string(tokens[b + 1:], '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM s"""

# Trees are built level by level; a level's node is joined with its neighbour for the proof.  Keys are unique.
OP12 = r"""
WITH RECURSIVE e AS (SELECT doc_id, coalesce('=' || lang, '') AS g, n_chars,
        coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
        coalesce(strlen(text) || ':' || text, '-') AS tail FROM documents),
bits AS (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM (SELECT unnest(range(256)) AS i)),
tab AS (SELECT list(v ORDER BY i) AS t FROM bits),
crc AS (SELECT doc_id, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(doc_id::VARCHAR)), lambda i: ascii(substr(doc_id::VARCHAR, i + 1, 1))::BIGINT)),
               lambda s, v: xor(s >> 8, t[(xor(s, v) & 255) + 1]))) AS crc FROM documents, tab),
leaf AS (SELECT e.doc_id, g, row_number() OVER (PARTITION BY g ORDER BY e.doc_id) - 1 AS i, sha256(head || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || tail) AS d,
                sha256(head || coalesce(strlen((n_chars + CASE WHEN crc % 7 = 0 THEN 1 ELSE 0 END)::VARCHAR) || ':' || (n_chars + CASE WHEN crc % 7 = 0 THEN 1 ELSE 0 END), '-') || tail) AS held
         FROM e JOIN crc USING (doc_id)),
low AS (SELECT g, 0 AS level, i, d, count(*) OVER (PARTITION BY g) AS n FROM leaf
        UNION ALL SELECT g, level + 1, i // 2, sha256(string_agg(d, '' ORDER BY i)), any_value(n + 1) // 2 FROM low WHERE n > 1 GROUP BY g, level, i // 2),
subs AS (SELECT g, d, level, row_number() OVER (ORDER BY encode(g)) - 1 AS i, count(*) OVER () AS n FROM low WHERE n = 1),
high AS (SELECT 0 AS level, i, d, n FROM subs UNION ALL SELECT level + 1, i // 2, sha256(string_agg(d, '' ORDER BY i)), any_value(n + 1) // 2 FROM high WHERE n > 1 GROUP BY level, i // 2),
root AS (SELECT d AS root FROM high WHERE n = 1),
tree AS (SELECT g, level, i, d FROM low WHERE n > 1 UNION ALL SELECT s.g, s.level + h.level, h.i, h.d FROM high h, subs s WHERE h.n > 1),
spots AS (SELECT l.doc_id, l.g, t.level, CASE WHEN t.level < s.level THEN l.i >> t.level ELSE s.i >> (t.level - s.level) END AS at FROM leaf l JOIN subs s USING (g) JOIN (SELECT DISTINCT g, level FROM tree) t USING (g)),
steps AS (SELECT p.doc_id, p.level, p.at & 1 AS side, coalesce(t.d, '') AS d FROM spots p LEFT JOIN tree t ON t.g = p.g AND t.level = p.level AND t.i = xor(p.at, 1)),
proof AS (SELECT doc_id, sha256(string_agg(d, '' ORDER BY level)) AS proof_sha256, max(level) + 1 AS height FROM steps GROUP BY doc_id),
fold AS (SELECT doc_id, 0 AS level, held AS node FROM leaf
         UNION ALL SELECT f.doc_id, f.level + 1, sha256(CASE WHEN s.side = 1 THEN s.d || f.node ELSE f.node || s.d END) FROM fold f JOIN steps s ON s.doc_id = f.doc_id AND s.level = f.level),
last AS (SELECT doc_id, arg_max(node, level) AS folded_root FROM fold GROUP BY doc_id)
SELECT l.doc_id, l.d AS leaf, s.d AS subroot, root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM leaf l JOIN subs s USING (g) JOIN last USING (doc_id) LEFT JOIN proof USING (doc_id), root"""


def _op13() -> str:
    bodies = [licenses.words_of(b) for b in (*licenses.PHRASES, *(b for _, b in licenses.TEMPLATES))]
    labels = [*licenses.PHRASES.values(), *(label for label, _ in licenses.TEMPLATES)]
    listed = ", ".join(f"({i}, '{label}', {list(body)})" for i, (label, body) in enumerate(zip(labels, bodies)))
    known, run = len(licenses.PHRASES), licenses.K
    return f"""
WITH tpl AS (SELECT * FROM (VALUES {listed}) v(template, label, words)),
tw AS (SELECT template, unnest(range(len(words))) AS t, unnest(words) AS w FROM tpl),
tg AS (SELECT template, t, array_to_string(words[t + 1:t + {run}], ' ') AS gram, len(words) - {run - 1} AS size FROM (SELECT *, unnest(range(len(words) - {run - 1})) AS t FROM tpl)),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents),
dw AS (SELECT doc_id, unnest(range(len(words))) AS p, unnest(words) AS w FROM d),
dg AS (SELECT doc_id, p, array_to_string(words[p + 1:p + {run}], ' ') AS gram FROM (SELECT *, unnest(range(len(words) - {run - 1})) AS p FROM d WHERE len(words) >= {run})),
votes AS (SELECT doc_id, template, p - t AS d, count(DISTINCT t) AS n, any_value(size) AS size, min(t) AS low, max(t) + {run - 1} AS high FROM dg JOIN tg USING (gram) GROUP BY ALL),
kept AS (SELECT * FROM votes WHERE n >= CASE WHEN template < {known} THEN size ELSE least(size, {licenses.MIN_VOTES}) END),
opened AS (SELECT *, CASE WHEN template < {known} OR d - lag(d) OVER s > {licenses.NEIGHBOUR} THEN 1 ELSE 0 END AS fresh FROM kept WINDOW s AS (PARTITION BY doc_id, template ORDER BY d)),
passage AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, template ORDER BY d) AS passage FROM opened),
hit AS (SELECT a.doc_id, a.template, passage, tw.t, min(tw.t + a.d) AS p FROM passage a JOIN tw ON tw.template = a.template AND tw.t BETWEEN a.low AND a.high
        JOIN dw ON dw.doc_id = a.doc_id AND dw.p = tw.t + a.d AND dw.w = tw.w GROUP BY ALL),
found AS (SELECT doc_id, template, label, passage, min(p) AS a, max(p) + 1 AS b, count(*) AS n, len(any_value(words)) AS m FROM hit JOIN tpl USING (template) GROUP BY doc_id, template, label, passage),
good AS (SELECT *, n / m AS score FROM found WHERE n >= CASE WHEN template < {known} THEN m ELSE {licenses.MIN_COVER}::DOUBLE * m END),
spans AS (SELECT * FROM good f WHERE template < {known} OR NOT EXISTS (SELECT 1 FROM good g WHERE g.doc_id = f.doc_id AND g.template >= {known} AND g.score > f.score AND g.label <> f.label
             AND 2 * (least(f.b, g.b) - greatest(f.a, g.a)) >= least(f.b - f.a, g.b - g.a))),
listed AS (SELECT doc_id, count(*) FILTER (template < {known}) AS n_base, min(a) FILTER (template < {known}) AS first_word, max(a) FILTER (template < {known}) AS last_word,
                  string_agg(DISTINCT label, ',' ORDER BY label) FILTER (template < {known}) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(score) AS score FROM spans GROUP BY doc_id)
SELECT d.doc_id, len(d.words)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM d LEFT JOIN listed USING (doc_id)"""


ORACLE: dict[str, str] = {
    "op2_warc_transactions": OP2, "op5_jump_sharding": OP5, "op6_poisson_mixing": OP6, "op7_divergence_rules": _op7(), "op8_credential_linking": OP8, "op10_ngram_jaccard": OP10,
    "op11_fill_in_middle": OP11, "op12_merkle_manifest": OP12, "op13_license_diagonals": _op13()}
