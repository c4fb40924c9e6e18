"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

from sluice.llm.licenses import DENIAL, REQUIRED, TEMPLATES, THRESHOLD, WITHIN, forbidden, word_bigrams
from sluice.llm.mixing import GOLDEN, LEAST_BLOCKS, SLOTS
from sluice.llm.pii import CAPITALS, CONTEXT_CHARS, COUNT_FROM, LOWER, RAISE, SCORES, SMALL, SPEAKS_AGAINST, SPEAKS_FOR, context_pattern

EXACT_TOPK = """
WITH v AS (SELECT vec_id, [floor(64 * x::DOUBLE) FOR x IN embedding] AS v FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.vec_id AS query_id, x.vec_id AS vec_id, list_dot_product(q.v, x.v)::BIGINT AS score FROM v q JOIN v x ON q.vec_id % 20 = 0 AND q.vec_id <> x.vec_id AND len(q.v) = len(x.v)),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20"""

URL_FILTER = """
WITH p AS (SELECT row_number() OVER () AS i, page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT i, page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
u(verdict, rhost, rpath) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
f AS (SELECT i, rhost || rpath AS rule, verdict FROM h JOIN u ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)),
b AS (SELECT i, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict FROM f GROUP BY i)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM h LEFT JOIN b USING (i)"""

SOURCE_MIX = f"""
WITH d AS (SELECT row_number() OVER () AS i, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, 't' || text, '')) AS k FROM documents),
t AS (SELECT source, sum(size)::BIGINT AS s, [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3]::DOUBLE AS w FROM d GROUP BY source),
c AS (SELECT *, 3.0::DOUBLE * s AS cap, sum(s) OVER () AS every FROM t),
l AS (SELECT *, (every - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM c),
o AS (SELECT *, coalesce(max(CASE WHEN cap >= level * w THEN level END) OVER (), 0) AS open FROM l),
g AS (SELECT source, s, every, least(cap, open * w) AS target, CASE WHEN s > 0 THEN greatest(1, round(s / greatest(1.0, every / {float(SLOTS)!r}::DOUBLE)), least(s::DOUBLE, ceil({float(LEAST_BLOCKS)!r}::DOUBLE * greatest(1.0, s / nullif(least(cap, open * w), 0))))) ELSE 0 END::BIGINT AS n FROM o),
e AS (SELECT *, CASE WHEN s > 0 THEN target * n / s ELSE 0 END AS need FROM g),
a AS (SELECT *, sum(need) OVER (ORDER BY source NULLS LAST ROWS UNBOUNDED PRECEDING) AS upto, sum(need) OVER () AS total FROM e),
p AS (SELECT x - floor(x) AS u FROM (SELECT i::DOUBLE * {GOLDEN!r}::DOUBLE AS x FROM range((SELECT coalesce(max(round(total)), 0)::BIGINT FROM a)) r(i))),
h AS (SELECT source, least(count(*), 3 * any_value(n)) AS taken FROM p JOIN a ON u >= (upto - need) / total AND u < upto / total GROUP BY source),
m AS (SELECT d.*, sum(size) OVER (PARTITION BY source ORDER BY k, doc_id NULLS FIRST, size, i ROWS UNBOUNDED PRECEDING) AS last FROM d)
SELECT doc_id, size, s AS source_size, target, CASE WHEN size = 0 THEN 0 ELSE coalesce(h.taken, 0) // n * size + greatest(0, least(last, coalesce(h.taken, 0) % n * s // n) - (last - size)) END::BIGINT AS taken
FROM m JOIN a ON m.source IS NOT DISTINCT FROM a.source LEFT JOIN h ON h.source IS NOT DISTINCT FROM a.source"""

_WORDS = "string_split(trim(regexp_replace({u}, '[^a-z0-9]+', ' ', 'g')), ' ')"
_LIST = lambda items: f"{list(items)}::VARCHAR[]"
_KNOWN = ", ".join(f"('{n}', '{t.lower().replace(chr(39), chr(39) * 2)}', {_LIST(REQUIRED.get(n, ()))}, {_LIST(forbidden(n, word_bigrams(t)))}, {_LIST(WITHIN.get(n, ()))})" for n, t in TEMPLATES.items())

LICENSE_SCAN = f"""
WITH k AS (SELECT name, needs, bars, wide, list_distinct([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) AS g FROM (SELECT name, needs, bars, wide, {_WORDS.format(u="body")} AS w FROM (VALUES {_KNOWN}) t(name, body, needs, bars, wide))),
d AS (SELECT row_number() OVER () AS i, doc_id, regexp_replace(regexp_replace(lower(coalesce(text, '')), '{DENIAL}', ' ', 'g'), '[^a-z0-9\\n]+', ' ', 'g') AS t FROM documents),
u AS (SELECT i, unnest(list_distinct(string_split(t, chr(10)) || string_split_regex(t, '\\n *\\n') || [t])) AS u FROM d), s AS (SELECT i, {_WORDS.format(u="u")} AS w FROM u),
b AS (SELECT DISTINCT i, list_distinct([w[j] || ' ' || w[j + 1] FOR j IN range(1, len(w))]) AS g FROM s WHERE len(w) BETWEEN 3 AND 400),
h AS (SELECT i, name, any_value(wide) AS wide, any_value(len(k.g)) AS long, max(2.0 * len(list_intersect(b.g, k.g)) / (len(b.g) + len(k.g))) AS dice FROM b, k WHERE len(b.g) BETWEEN 0.6 * len(k.g) AND 1.7 * len(k.g) AND list_has_all(b.g, needs) AND NOT list_has_any(b.g, bars) GROUP BY i, name),
o AS (SELECT *, list(name) OVER (PARTITION BY i) AS beside FROM h WHERE dice >= {THRESHOLD}),
a AS (SELECT i, list(name ORDER BY dice DESC, long DESC, name) AS names, arg_max(dice, [dice, long]) AS dice FROM o WHERE NOT list_has_any(beside, wide) GROUP BY i)
SELECT doc_id, names[1] AS license, coalesce(round(dice, 6), 0)::DOUBLE AS dice, coalesce(array_to_string(names, ','), '') AS matches FROM d LEFT JOIN a USING (i)"""

_PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
    "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}\b",
    "ssn": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
    "secret": r"\b(?:AKIA[A-Z0-9]{16}|(?:password|passwd|secret|token|api_key)=[A-Za-z0-9]{8,64})\b",
}
_PROPOSED = " UNION ALL ".join(f"SELECT i, {n} AS k, '{kind}' AS kind, regexp_extract_all(t, '{p}') AS m, string_split_regex(t, '{p}') AS g FROM d" for n, (kind, p) in enumerate(_PII.items()))
_COUNTS = ", ".join(f"count(*) FILTER (kind = '{kind}') AS n_{kind}" for kind in _PII)
_BASE_SCORE = "CASE kind " + " ".join(f"WHEN '{k}' THEN {n}" for k, n in SCORES.items()) + " END"


def _by_kind(words: dict[str, tuple[str, ...]], step: int) -> str:
    return "CASE " + " ".join(f"WHEN kind = '{k}' AND regexp_matches(near, '{context_pattern(w)}') THEN {step}" for k, w in words.items()) + " ELSE 0 END"


_BASE = "kind IN ('email', 'ip', 'card', 'phone')"
_WRITTEN = "string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k)"
PII = f"""
WITH d AS (SELECT row_number() OVER () AS i, doc_id, coalesce(text, '') AS t FROM documents), x AS ({_PROPOSED}),
y AS (SELECT i, k, kind, m, g, unnest(range(1, len(m) + 1)) AS j FROM x WHERE len(m) > 0),
z AS (SELECT i, k, kind, m[j] AS v, translate(right(g[j], {CONTEXT_CHARS}) || ' ' || left(g[j + 1], {CONTEXT_CHARS}), '{CAPITALS}', '{SMALL}') AS near, regexp_replace(m[j], '[^0-9]', '', 'g') AS digits, regexp_replace(m[j], '\\x20', '', 'g') AS plain, (list_sum([length(a) FOR a IN g[1:j]]) + coalesce(list_sum([length(a) FOR a IN m[1:j - 1]]), 0))::BIGINT AS s FROM y),
f AS (SELECT i, k, kind, s, s + length(v) AS e, least(10, {_BASE_SCORE} + {_by_kind(SPEAKS_FOR, RAISE)} + {_by_kind(SPEAKS_AGAINST, -LOWER)}) AS score FROM z WHERE CASE kind WHEN 'email' THEN true WHEN 'secret' THEN true
  WHEN 'ip' THEN len(list_filter(string_split(v, '.'), lambda p: length(ltrim(p, '0')) > 3 OR (length(ltrim(p, '0')) = 3 AND ltrim(p, '0') > '255'))) = 0
  WHEN 'card' THEN length(digits) BETWEEN 14 AND 19 AND list_sum([CASE WHEN (length(digits) - q) % 2 = 0 THEN digits[q]::INT ELSE digits[q]::INT * 2 - CASE WHEN digits[q]::INT > 4 THEN 9 ELSE 0 END END FOR q IN range(1, length(digits) + 1)]) % 10 = 0
  WHEN 'phone' THEN length(digits) BETWEEN 10 AND 15
  WHEN 'ssn' THEN NOT regexp_matches(v, '^(?:000|666|9)|-00-|-0000$')
  ELSE length(plain) BETWEEN 15 AND 34 AND list_reduce(list_prepend(0::BIGINT, [CASE WHEN c BETWEEN '0' AND '9' THEN c::BIGINT ELSE unicode(c)::BIGINT - 55 END FOR c IN string_split(plain[5:] || plain[:4], '')]), lambda a, c: CASE WHEN c < 10 THEN (a * 10 + c) % 97 ELSE (a * 100 + c) % 97 END) = 1 END),
c AS (SELECT * FROM f WHERE {_BASE} OR score >= {COUNT_FROM}),
a AS (SELECT i, {_COUNTS}, {_WRITTEN} AS spans, string_agg(score::VARCHAR, ',' ORDER BY s, k) AS scores, {_WRITTEN} FILTER ({_BASE}) AS base FROM c GROUP BY i)
SELECT doc_id, {", ".join(f"coalesce(n_{kind}, 0) AS n_{kind}" for kind in _PII)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(scores, '') AS scores FROM d LEFT JOIN a USING (i)"""

FILL_IN_MIDDLE = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS w, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
k AS (SELECT doc_id, t, w, len(w)::BIGINT AS n, ('0x' || h[1:8])::BIGINT % (len(w) + 1) AS x, ('0x' || h[9:16])::BIGINT % (len(w) + 1) AS y, ('0x' || h[17:24])::BIGINT % 100 AS h3, ('0x' || h[25:32])::BIGINT % 100 AS h4 FROM d),
p AS (SELECT *, array_to_string(w[1:least(x, y)], '') AS a, array_to_string(w[least(x, y) + 1:greatest(x, y)], '') AS b, array_to_string(w[greatest(x, y) + 1:], '') AS c, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 >= 90 THEN 'plain' WHEN h4 < 20 THEN 'spm' ELSE 'psm' END AS form FROM k)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(a) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(b) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || a || '<S>' || c || '<M>' || b ELSE '<S>' || c || '<P>' || a || '<M>' || b END) AS output_sha256, sha256(t) AS restored_sha256 FROM p"""


def _more(x: str, n: str, letter: str) -> str:
    """A path's key (its cost in nine digits, then its letters) with one edit more."""
    return f"lpad((left({x}, 9)::BIGINT + {n})::VARCHAR, 9, '0') || substr({x}, 10) || '{letter}'"


_INSERTED = f"a, b, least(c, {', '.join(_more(x, '5', 'I') for x in 'abd')}) AS c, d"
_INSERTED_TWICE = f"least(d, {_more('c', '5', 'I')})"
_EDITED = f"""{_more('a', '2', 'D')}, least({_more('b', '2', 'D')}, CASE WHEN o = 's' AND f < 2 THEN {_more('a', '5 * f', 'K')} END),
  least({_more('c', '2', 'D')}, CASE WHEN o = 'u' AND f < 2 THEN least({', '.join(_more(x, '5 * f', 'K') for x in 'abd')}) END, CASE WHEN f < 2 THEN least({', '.join(_more(x, '1 + 5 * f', 'R') for x in 'abd')}) END),
  least({_more('d', '2', 'D')}, CASE WHEN o = 'a' AND f < 2 THEN {_more('c', '5 * f', 'K')} END, CASE WHEN f < 2 THEN {_more('c', '1 + 5 * f', 'R')} END)"""
_CRC = "xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten([[ascii(x)::BIGINT, 0, 0, 0, 0, 0, 0, 0] FOR x IN string_split(key, '')])), lambda a, e: xor(xor(a, e) >> 1, (xor(a, e) & 1) * 3988292384)))"
DIALOGUE = f"""
WITH RECURSIVE t AS (SELECT conv_id, dense_rank() OVER (ORDER BY conv_id) AS v, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
h AS (SELECT *, {_CRC} % 20 AS harm FROM t),
w AS (SELECT v, turn, CASE WHEN harm = 4 THEN 'user' ELSE role END AS role, CASE harm WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN harm = 3 THEN 2 ELSE 1 END)) AS time FROM h WHERE harm <> 0),
n AS (SELECT *, row_number() OVER (PARTITION BY v ORDER BY turn NULLS FIRST, role, sha256(text), time) AS i, left(role, 1) AS o, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM w),
q AS (SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY v, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN NOT regexp_matches(right(bare, 1), '[.!?]') THEN 'truncated' ELSE '' END AS fault, lag(o) OVER (PARTITION BY v ORDER BY i) AS p FROM n),
x AS (SELECT *, CASE fault WHEN '' THEN 0 WHEN 'truncated' THEN 1 ELSE 2 END AS f FROM q),
r(v, i, a, b, c, d) AS (SELECT DISTINCT v, 0::BIGINT, '000000000', NULL::VARCHAR, NULL::VARCHAR, NULL::VARCHAR FROM t UNION ALL
  SELECT v, i, {_EDITED} FROM (SELECT v, i, o, f, a, b, c, {_INSERTED_TWICE} AS d FROM (SELECT x.v, x.i, x.o, x.f, {_INSERTED} FROM r JOIN x ON x.v = r.v AND x.i = r.i + 1))),
z AS (SELECT v, least(a, {_INSERTED_TWICE}) AS path FROM (SELECT v, {_INSERTED} FROM (SELECT v, arg_max(a, i) AS a, nullif(arg_max(coalesce(b, '-'), i), '-') AS b, nullif(arg_max(coalesce(c, '-'), i), '-') AS c, nullif(arg_max(coalesce(d, '-'), i), '-') AS d FROM r GROUP BY v))),
e AS (SELECT v, j, e, count(*) FILTER (e <> 'I') OVER g AS i, count(*) FILTER (e <> 'D') OVER g AS k FROM (SELECT v, unnest(string_split(substr(path, 10), '')) AS e, unnest(range(1, length(path) - 8)) AS j FROM z) WINDOW g AS (PARTITION BY v ORDER BY j)),
m AS (SELECT e.v, e.k, e.e, CASE WHEN e.e <> 'I' THEN x.role END AS role, CASE WHEN e.e = 'I' THEN '' ELSE x.text END AS text, bool_or(e.e = 'K' AND e.k = 1 AND x.o = 's') OVER (PARTITION BY e.v) AS s FROM e LEFT JOIN x ON x.v = e.v AND x.i = e.i WHERE e.e <> 'D'),
y AS (SELECT v, string_agg(CASE WHEN e = 'K' THEN role WHEN (k - s::INT) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY k) AS whole FROM m GROUP BY v),
u AS (SELECT v, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (p IS NOT NULL AND p || o NOT IN ('su', 'ua', 'au')) AS illegal FROM x GROUP BY v)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, left(path, 9)::BIGINT AS cost, substr(path, 10) AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, v FROM t) LEFT JOIN u USING (v) LEFT JOIN y USING (v) JOIN z USING (v)"""

WARC = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS best FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id < best THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN payload_bytes >= 1000 AND page_id < best THEN best END AS refers_to FROM m"""
