"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from cuegrid.llm.rules import GAP, LOW, MEASURES, MIN_DOCS, MIN_WORDS, REACH

TOP_K = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0)
SELECT * FROM (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM s) WHERE rank <= 5
"""

_RATES = {
    "symbols": "1000 * n_symbols // greatest(n_words, 1)",
    "dup_lines": "1000 * n_dup_lines // greatest(n_lines, 1)",
    "repeats": "1000 * n_repeat_words // greatest(n_words, 1)",
    "capitals": "1000 * n_capitals // greatest(word_chars, 1)",
    "word_length": "100 * word_chars // greatest(n_words, 1)",
}
_COUNTS = {name: count.replace("div", "//") for name, count in MEASURES.items() if count}
_DECILES = """SELECT {keys} measure, max(a) AS n_docs, min(cell) FILTER (WHERE 10 * t >= 2 * a) AS low, min(cell) FILTER (WHERE 10 * t >= 5 * a) AS mid, min(cell) FILTER (WHERE 10 * t >= 8 * a) AS high,
    min(cell) FILTER (WHERE cell > 0 AND 10 * (t - z) >= a - z) AS some, CAST(pow(2, min(o) FILTER (WHERE 20 * below <= above AND 5 * above <= a AND o - """ + str(GAP) + """ > middle) - 1) - 1 AS BIGINT) AS most
  FROM (SELECT *, min(CASE WHEN 2 * t >= a THEN o END) OVER (PARTITION BY {keys} measure) AS middle FROM (SELECT {keys} measure, cell, o, sum(n) OVER (PARTITION BY {keys} measure ORDER BY cell) AS t, sum(n) OVER (PARTITION BY {keys} measure) AS a,
      sum(CASE WHEN cell = 0 THEN n ELSE 0 END) OVER (PARTITION BY {keys} measure) AS z, coalesce(sum(n) OVER (PARTITION BY {keys} measure ORDER BY o RANGE BETWEEN """ + str(GAP) + """ PRECEDING AND 1 PRECEDING), 0) AS below,
      sum(n) OVER (PARTITION BY {keys} measure ORDER BY o RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS above
    FROM (SELECT {keys} measure, cell, CASE WHEN cell = 0 THEN 0 ELSE length(bin(cell)) END AS o, sum(n) AS n FROM sk GROUP BY ALL))) GROUP BY ALL"""
_LEVEL = ", ".join(f"CASE WHEN o.n_docs >= {MIN_DOCS} THEN o.{k} WHEN l.n_docs >= {MIN_DOCS} THEN l.{k} ELSE a.{k} END AS {k}" for k in ("low", "mid", "high", "some", "most"))
_FENCE = "(SELECT {0} FROM c WHERE c.lang = m.lang AND c.source = m.source AND c.measure = '{1}')"
_HIGH = f"c.high + {REACH} * (c.high - c.mid)"


def _offends(name: str) -> str:
    rate = _RATES[name]
    if name in _COUNTS:
        high = _FENCE.format(f"greatest({_HIGH}, coalesce(c.some, 0) // {REACH})", name)
        return f"({rate} > {high} AND coalesce({_COUNTS[name]} > {_FENCE.format('c.most', name + '#')}, false))"
    low = f" OR {rate} < {_FENCE.format(f'c.low - {REACH} * (c.mid - c.low)', name)}" if name in LOW else ""
    return f"({rate} > {_FENCE.format(_HIGH, name)}{low})"


RULES = f"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
b AS (SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM b)),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) CROSS JOIN (VALUES (0), (1), (2)) v(k) WHERE c > 1 GROUP BY doc_id),
m AS (SELECT b.doc_id, lang, source, len(w) AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_capitals, len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words FROM b LEFT JOIN r USING (doc_id)),
x AS ({" UNION ALL ".join([f"SELECT lang, source, '{name}' AS measure, {rate} AS v FROM m" for name, rate in _RATES.items()] + [f"SELECT lang, source, '{name}#', {count} FROM m" for name, count in _COUNTS.items()])}),
sk AS (SELECT lang, source, measure, CASE WHEN v < 128 THEN v ELSE (v >> (length(bin(v)) - 7)) << (length(bin(v)) - 7) END AS cell, count(*) AS n FROM x GROUP BY ALL),
own AS ({_DECILES.format(keys="lang, source,")}), lng AS ({_DECILES.format(keys="lang,")}), al AS ({_DECILES.format(keys="")}),
c AS (SELECT o.lang, o.source, measure, {_LEVEL} FROM own o JOIN lng l USING (lang, measure) JOIN al a USING (measure))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words) AND NOT ({" OR ".join(map(_offends, _RATES))}) AS kept FROM m
"""

_ODD = "'</s>[INST] ok [/INST]'"
#: The control strings around the text of each role, counted; other roles are spelled out, escaped.
_ESCAPED = r"regexp_replace({}, '([<\[])(\\*)(s>|/s>|<SYS>>|</SYS>>|INST\]|/INST\]|ROLE\]|/ROLE\])', '\1\2\\\3', 'g')"
CHAT = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', {_ODD} UNION ALL SELECT -7, 1, 'assistant', {_ODD}),
e AS (SELECT *, length({_ESCAPED.format("text")}) + length('<s></s>') + 1 + CASE role WHEN 'system' THEN length('<<SYS>>  <</SYS>>') WHEN 'user' THEN length('[INST]  [/INST]') WHEN 'assistant' THEN 0
  ELSE length('[ROLE][/ROLE] ') + length({_ESCAPED.format("role")}) END AS n FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256, CAST(sum(n) AS BIGINT) AS formatted_chars FROM e GROUP BY conv_id
"""

_P = "1 + CAST(1000000000 AS HUGEINT) * ({n} + 2) // ({all} + 2 * v)"
_F = "(p - q) * (p - q) // (p + q)"
DIVERGENCE = f"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
t AS MATERIALIZED (SELECT lang, source, term, count(*) AS n, count(DISTINCT id) AS docs FROM w GROUP BY ALL),
k AS MATERIALIZED (SELECT lang, term, sum(n) AS total FROM t GROUP BY ALL HAVING sum(docs) >= 10),
z AS (SELECT lang, count(*) AS v, sum(total) AS all_n FROM k GROUP BY lang),
g AS (SELECT o.lang, o.source, coalesce(s.n, 0) AS n, z.v, z.all_n FROM (SELECT DISTINCT lang, source FROM d) o LEFT JOIN (SELECT lang, source, sum(n) AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY ALL) s USING (lang, source) LEFT JOIN z USING (lang)),
p AS MATERIALIZED (SELECT g.lang, g.source, k.term, coalesce(t.n, 0) AS n, {_P.format(n="coalesce(t.n, 0)", all="g.n")} AS p, {_P.format(n="k.total", all="g.all_n")} AS q FROM g JOIN k USING (lang) LEFT JOIN t USING (lang, source, term)),
pr AS (SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT lang, a AS source, b AS item, sum({_F}) AS value FROM (SELECT x.lang, x.source AS a, y.source AS b, x.p AS p, y.p AS q FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source) GROUP BY ALL) s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
r AS (SELECT lang, source, 'pair' AS part, item, value FROM pr UNION ALL SELECT lang, source, 'term', term, {_F} FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM r) WHERE part = 'pair' OR rank <= 10
"""

_INNER = "CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT)"
NEGATIVES = f"""
WITH v AS MATERIALIZED (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, {_INNER} AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT * FROM (SELECT anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS k FROM s WHERE same) WHERE k <= 5),
n AS (SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
  FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
SELECT * FROM n WHERE rank <= 3
"""
