"""DuckDB SQL for the operators that SQL can express on whole tables."""

from __future__ import annotations

from .quality import BITS, BOUND, EVEN, LEAST_SPREAD, RULES, SHRINK
from .urls import LOWER, UPPER

WORDS = r"list_filter(regexp_split_to_array({x}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"

URLS = f"""WITH u AS (SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, row_number() OVER () AS n, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host, regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM u),
r AS (SELECT * FROM (VALUES {{rules}}) t(rule_host, rule_path, verdict)),
m AS (SELECT h.n, rule_host || rule_path AS rule, verdict FROM h JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) QUALIFY row_number() OVER (PARTITION BY h.n ORDER BY length(rule_host || rule_path) DESC, length(rule_host) DESC, verdict DESC) = 1)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM h LEFT JOIN m USING (n)"""

EMBEDDINGS = """WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
n AS (SELECT *, sqrt(list_dot_product(e, e)) AS norm FROM v WHERE list_dot_product(e, e) > 0),
l AS (SELECT a.vec_id AS i, b.vec_id AS j FROM n a JOIN n b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.98),
c AS (SELECT vec_id AS id, vec_id AS top FROM embeddings UNION SELECT l.j, c.top FROM c JOIN l ON l.i = c.id WHERE c.top < l.j),
k AS (SELECT i, count(*) AS n_links FROM l GROUP BY i), t AS (SELECT id, min(top) AS top FROM c GROUP BY id)
SELECT vec_id, coalesce(n_links, 0) AS n_links, top AS component_id, top = vec_id AS kept FROM embeddings JOIN t ON t.id = vec_id LEFT JOIN k ON k.i = vec_id"""

JACCARD = f"""WITH RECURSIVE w AS (SELECT doc_id, {WORDS.format(x=f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')")} AS ws FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(ws) >= 3 THEN list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS i, b.doc_id AS j, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT i, j FROM p JOIN n a ON a.doc_id = i JOIN n b ON b.doc_id = j WHERE 100 * k >= 90 * (a.n + b.n - k)),
c AS (SELECT doc_id AS id, doc_id AS top FROM documents UNION SELECT l.j, c.top FROM c JOIN l ON l.i = c.id WHERE c.top < l.j),
t AS (SELECT id, min(top) AS top FROM c GROUP BY id)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, top AS component_id FROM w JOIN t ON t.id = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id"""

_BUCKET = f"x - x % CAST(pow(2, greatest(length(bin(x)) - {BITS}, 0)) AS BIGINT)"
_PERCENT, _TIMES = ("CASE rate " + " ".join(f"WHEN '{k}' THEN {v[i]}" for k, v in RULES.items()) + " END" for i in (0, 1))


def _quantiles(keys: str) -> str:
    """mid, high and docs of each rate by keys (a list of columns that ends with a comma, or nothing)."""
    ranked = f"SELECT {keys} rate, b, sum(sum(n)) OVER (PARTITION BY {keys} rate ORDER BY b) AS upto, sum(sum(n)) OVER (PARTITION BY {keys} rate) AS al FROM b GROUP BY {keys} rate, b"
    return f"SELECT {keys} rate, min(b) FILTER (100 * upto >= 50 * al) AS mid, min(b) FILTER (100 * upto >= {_PERCENT} * al) AS high, max(al) AS docs FROM ({ranked}) GROUP BY {keys} rate"


def _shrunk(part: str, own: str, wide: str) -> str:
    return f"({own}.docs * {own}.{part} + {SHRINK} * {wide}.{part}) // ({own}.docs + {SHRINK}) AS {part}"


_CUT = f"mid + ({_TIMES}) * greatest(high - mid, {LEAST_SPREAD}, mid // {EVEN})"

QUALITY = rf"""WITH w AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, {WORDS.format(x="coalesce(text, '')")} AS ws FROM documents),
ln AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS dups FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
g AS (SELECT doc_id, unnest(range(1, len(ws) - 1)) AS i, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) AS g FROM w WHERE len(ws) >= 3),
d AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1), rp AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM d) GROUP BY doc_id),
m AS (SELECT w.doc_id, lang, source, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dups, 0) AS n_dup_lines, coalesce(rp.n, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines FROM w LEFT JOIN ln USING (doc_id) LEFT JOIN rp USING (doc_id)),
r AS (SELECT *, 1000 * n_symbols // greatest(n_words, 1) AS symbols, 1000 * n_repeat_words // greatest(n_words, 1) AS repeats, 1000 * n_dup_lines // greatest(n_lines, 1) AS dup_lines, 1000 * word_chars // greatest(n_words, 1) AS chars FROM m),
x AS (SELECT doc_id, lang, source, 'symbols' AS rate, symbols AS x, n_words, n_repeat_words FROM r UNION ALL SELECT doc_id, lang, source, 'repeats', repeats, n_words, n_repeat_words FROM r UNION ALL SELECT doc_id, lang, source, 'dup_lines', dup_lines, n_words, n_repeat_words FROM r UNION ALL SELECT doc_id, lang, source, 'chars', chars, n_words, n_repeat_words FROM r),
b AS (SELECT lang, source, rate, {_BUCKET} AS b, count(*) AS n FROM x WHERE NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) GROUP BY ALL),
c AS (SELECT *, {_CUT} AS cut FROM ({_quantiles("")})),
l0 AS ({_quantiles("lang,")}), l AS (SELECT *, least({_CUT}, most) AS cut FROM (SELECT l0.lang, l0.rate, {_shrunk("mid", "l0", "c")}, {_shrunk("high", "l0", "c")}, {BOUND} * c.cut AS most FROM l0 JOIN c ON c.rate = l0.rate)),
o0 AS ({_quantiles("lang, source,")}), o AS (SELECT *, least({_CUT}, most) AS cut FROM (SELECT o0.lang, o0.source, o0.rate, {_shrunk("mid", "o0", "l")}, {_shrunk("high", "o0", "l")}, {BOUND} * l.cut AS most FROM o0 JOIN l ON l.lang IS NOT DISTINCT FROM o0.lang AND l.rate = o0.rate)),
k AS (SELECT doc_id, bool_or(x > o.cut) AS bad FROM x LEFT JOIN o ON o.lang IS NOT DISTINCT FROM x.lang AND o.source IS NOT DISTINCT FROM x.source AND o.rate = x.rate GROUP BY doc_id)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT coalesce(bad, false) AS kept FROM m LEFT JOIN k USING (doc_id)"""

#: The 256 remainders of CRC-32, from its polynomial, and a text's CRC by them; the text is ASCII.
_CRC = """crc_table AS (SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crcs)"""


def _crc(text: str) -> str:
    return f"xor(list_reduce(list_concat([4294967295], list_transform(range(1, length({text}) + 1), lambda i: ord(substr({text}, i, 1)))), lambda c, b: xor(c >> 8, crcs[(xor(c, b) & 255) + 1])), 4294967295)"


def _field(c: str) -> str:
    return f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || {c}, '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(map(_field, ("doc_id", "source", "lang", "n_chars", text))) + ")"


_UP = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Trees level by level, siblings by self joins, folds by recursion.
MERKLE = f"""WITH RECURSIVE {_CRC}, d AS (SELECT doc_id, source, {_leaf('text')} AS leaf, CASE WHEN {_crc('CAST(doc_id AS VARCHAR)')} % 5 = 0 THEN {_leaf("translate(text, '" + _UP + "', '" + _UP.lower() + "')")} ELSE {_leaf('text')} END AS now FROM documents, crc_table),
  o AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM d),
  t AS (SELECT source, 0 AS lvl, pos AS idx, leaf AS h, n FROM o UNION ALL SELECT source, lvl + 1, idx // 16, sha256(string_agg(h, '' ORDER BY idx)), (any_value(n) + 15) // 16 FROM t WHERE n > 1 GROUP BY source, lvl, idx // 16),
  s AS (SELECT source, h, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM t WHERE n = 1),
  u AS (SELECT 0 AS lvl, pos AS idx, h, n FROM s UNION ALL SELECT lvl + 1, idx // 16, sha256(string_agg(h, '' ORDER BY idx)), (any_value(n) + 15) // 16 FROM u WHERE n > 1 GROUP BY lvl, idx // 16),
  own AS (SELECT a.source, a.lvl, a.idx, coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') AS before, coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS after FROM t a JOIN t b ON a.source IS NOT DISTINCT FROM b.source AND a.lvl = b.lvl AND a.idx // 16 = b.idx // 16 WHERE a.n > 1 GROUP BY a.source, a.lvl, a.idx),
  top AS (SELECT a.lvl, a.idx, coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') AS before, coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS after FROM u a JOIN u b ON a.lvl = b.lvl AND a.idx // 16 = b.idx // 16 WHERE a.n > 1 GROUP BY a.lvl, a.idx),
  w AS (SELECT o.*, s.pos AS place, s.h AS subroot, row_number() OVER () AS id FROM o JOIN s ON o.source IS NOT DISTINCT FROM s.source),
  steps AS (SELECT id, own.lvl AS k, before, after FROM w JOIN own ON w.source IS NOT DISTINCT FROM own.source AND own.idx = w.pos // CAST(pow(16, own.lvl) AS BIGINT) UNION ALL SELECT id, 1000 + top.lvl, before, after FROM w JOIN top ON top.idx = w.place // CAST(pow(16, top.lvl) AS BIGINT)),
  n AS (SELECT id, before, after, row_number() OVER (PARTITION BY id ORDER BY k) AS k FROM steps),
  p AS (SELECT id, sha256(string_agg(before || after, '' ORDER BY k)) AS proof FROM n GROUP BY id),
  fold AS (SELECT id, 0 AS k, now AS h FROM w UNION ALL SELECT fold.id, n.k, sha256(before || h || after) FROM fold JOIN n ON n.id = fold.id AND n.k = fold.k + 1),
  last AS (SELECT id, arg_max(h, k) AS h FROM fold GROUP BY id), r AS (SELECT h AS root FROM u WHERE n = 1)
  SELECT doc_id, leaf, subroot, root, coalesce(proof, sha256('')) AS proof_sha256, last.h AS folded_root, last.h = root AS verified FROM w JOIN last USING (id) LEFT JOIN p USING (id) CROSS JOIN r"""

_SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
#: A row at a time, the cheapest and least edits for each of the four states.
REPAIR = f"""WITH RECURSIVE {_CRC}, h AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc("(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))")} % 20 AS h FROM conversations, crc_table),
  r AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE WHEN h = 3 THEN [0, 1] ELSE [0] END) AS copy FROM h WHERE h <> 0),
  o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, substr(sha256(text), 1, 32), copy) AS n, rtrim(text, {_SPACES}) AS core FROM r),
  e AS (SELECT *, CASE WHEN core = '' THEN 2 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 THEN 3 WHEN right(core, 1) IN ('.', '!', '?') THEN 0 ELSE 1 END AS flag, CASE left(role, 1) WHEN 's' THEN 0 WHEN 'u' THEN 1 WHEN 'a' THEN 2 ELSE 3 END AS kind, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY n) || left(role, 1) AS pair FROM o),
  c AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (flag = 2) AS blank, count(*) FILTER (flag = 3) AS duplicate, count(*) FILTER (flag = 1) AS truncated, count(*) FILTER (n > 1 AND pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS m FROM e GROUP BY conv_id),
  step AS (SELECT kind, flag, p, CASE letter WHEN 'D' THEN s WHEN 'R' THEN CASE s WHEN 2 THEN 3 ELSE 2 END ELSE kind + 1 END AS q, 3 * k + CASE letter WHEN 'D' THEN 4 WHEN 'R' THEN 3 + 3 * flag ELSE 3 * flag END AS cost, repeat('I', k) || letter AS letters
    FROM (VALUES (0, 0, 0), (0, 1, 2), (0, 2, 3), (1, 0, 1), (1, 1, 2), (1, 2, 3), (2, 0, 2), (2, 1, 3), (3, 0, 3), (3, 1, 2)) i(p, k, s), range(4) a(kind), range(4) b(flag), (VALUES ('D'), ('R'), ('K')) c(letter)
    WHERE letter = 'D' OR flag < 2 AND (letter = 'R' OR (kind, s) IN ((0, 0), (1, 0), (1, 1), (1, 3), (2, 2)))),
  best AS (SELECT conv_id, CAST(0 AS BIGINT) AS n, 0 AS q, {{'c': 0, 'a': ''}} AS b FROM c UNION ALL SELECT k.conv_id, k.n + 1, step.q, min({{'c': k.b.c + step.cost, 'a': k.b.a || step.letters}}) FROM best k JOIN e ON e.conv_id IS NOT DISTINCT FROM k.conv_id AND e.n = k.n + 1 JOIN step ON step.kind = e.kind AND step.flag = e.flag AND step.p = k.q GROUP BY k.conv_id, k.n, step.q),
  fin AS (SELECT c.*, min({{'c': b.c + x.cost, 'a': b.a || x.letters}}) AS b FROM best JOIN c ON c.conv_id IS NOT DISTINCT FROM best.conv_id AND c.m = best.n JOIN (VALUES (0, 0, ''), (1, 6, 'II'), (2, 3, 'I'), (3, 0, '')) x(q, cost, letters) ON x.q = best.q GROUP BY ALL),
  l AS (SELECT conv_id, b.a AS audit, unnest(range(1, length(b.a) + 1)) AS i FROM fin), g AS (SELECT *, substr(audit, i, 1) AS letter FROM l),
  v AS (SELECT *, count(*) FILTER (letter <> 'I') OVER w AS n, count(*) FILTER (letter <> 'D') OVER w AS place, count(*) FILTER (letter <> 'D') OVER (PARTITION BY conv_id) % 2 AS odd FROM g WINDOW w AS (PARTITION BY conv_id ORDER BY i)),
  y AS (SELECT v.conv_id, sha256(string_agg(CASE WHEN letter = 'K' THEN role WHEN (place - 1 - odd) % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN letter = 'I' THEN '' ELSE text END, chr(10) ORDER BY i)) AS h FROM v LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM v.conv_id AND e.n = v.n AND letter <> 'I' WHERE letter <> 'D' GROUP BY v.conv_id)
  SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(b.c, 0) AS BIGINT) AS cost, coalesce(b.a, '') AS audit, coalesce(y.h, sha256('')) AS repaired_sha256
  FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN fin ON fin.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN y ON y.conv_id IS NOT DISTINCT FROM a.conv_id"""
