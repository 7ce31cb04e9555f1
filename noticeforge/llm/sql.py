"""DuckDB SQL for the queries of this package that SQL can express."""

from noticeforge.llm.quality import LINE_LIMIT, MIN_WORDS, NGRAM_LIMITS, REPEAT_PER_CENT

_LOWERED = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_SPACED = r"[^\x20\x09-\x0D]+"


def _alnum(column: str) -> str:
    return f"regexp_extract_all({_LOWERED.format(column)}, '{_ALNUM}')"


OP3 = f"""
WITH d AS (SELECT doc_id, {_alnum('text')} AS w FROM documents),
i AS (SELECT item_id, {_alnum('text')} AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[k : k + least(13, len(w)) - 1], ' ') AS g
       FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS k FROM i WHERE len(w) > 0)),
dw AS (SELECT doc_id, n, k, array_to_string(w[k : k + n - 1], ' ') AS g
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
hit AS (SELECT doc_id, item_id, k, n FROM dw JOIN iw USING (n, g)),
words AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(k, k + n)) AS p FROM (SELECT DISTINCT doc_id, k, n FROM hit)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def _grams(n: int) -> str:
    return f"""
r{n} AS (SELECT doc_id, k FROM g JOIN (SELECT doc_id, g{n} FROM g WHERE g{n} IS NOT NULL GROUP BY ALL HAVING count(*) > 1) USING (doc_id, g{n})),
c{n} AS (SELECT doc_id, count(*) AS words, sum(length(word)) AS chars
         FROM (SELECT DISTINCT doc_id, unnest(range(k, k + {n})) AS k FROM r{n}) JOIN w USING (doc_id, k) GROUP BY doc_id)"""


_LENGTHS = list(NGRAM_LIMITS)
OP10 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_SPACED}') AS w FROM documents),
l AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines, sum(length(line)) AS line_chars
      FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '{_SPACED}') GROUP BY doc_id),
o AS (SELECT doc_id, sum(length(line)) AS once_chars FROM (SELECT DISTINCT doc_id, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '{_SPACED}')) GROUP BY doc_id),
w AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS k FROM d),
g AS (SELECT doc_id, k, {', '.join(f"{' || chr(32) || '.join(['word', *(f'lead(word, {i}) OVER o' for i in range(1, n))])} AS g{n}" for n in _LENGTHS)} FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY k)),
{','.join(_grams(n) for n in _LENGTHS)},
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
             CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(c5.words, 0) AS BIGINT) AS n_repeat_words, length(replace(text, chr(10), '')) AS chars,
             CAST(coalesce(line_chars - once_chars, 0) AS BIGINT) AS dup_line_chars,
             {', '.join(f'CAST(coalesce(c{n}.chars, 0) AS BIGINT) AS dup_{n}gram_chars' for n in _LENGTHS)}
      FROM d LEFT JOIN l USING (doc_id) LEFT JOIN o USING (doc_id) {' '.join(f'LEFT JOIN c{n} USING (doc_id)' for n in _LENGTHS)})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, dup_line_chars, {', '.join(f'dup_{n}gram_chars' for n in _LENGTHS)},
       n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_PER_CENT} * n_words AS base_failed,
       NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_PER_CENT} * n_words OR 100 * dup_line_chars > {LINE_LIMIT} * chars
            OR {' OR '.join(f'100 * dup_{n}gram_chars > {x} * word_chars' for n, x in NGRAM_LIMITS.items())}) AS kept
FROM m
"""

OP6 = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWERED.format('text')}, '{_SPACED}') AS w FROM documents),
s AS (SELECT doc_id, w[1] AS g FROM d WHERE len(w) = 1
      UNION SELECT doc_id, word || ' ' || next FROM (SELECT doc_id, word, lead(word) OVER (PARTITION BY doc_id ORDER BY k) AS next
        FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS k FROM d)) WHERE next IS NOT NULL),
n AS (SELECT doc_id, count(*) AS n, md5(string_agg(g, chr(10) ORDER BY g)) AS whole FROM s GROUP BY doc_id),
c AS (SELECT doc_id, n, min(doc_id) OVER (PARTITION BY whole) AS rep FROM n),
rs AS (SELECT rep, n, g FROM c JOIN s USING (doc_id) WHERE doc_id = rep),
e AS (SELECT a.rep AS u, b.rep AS v FROM rs a JOIN rs b ON a.g = b.g AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
      GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
links AS (SELECT u, v FROM e UNION ALL SELECT v, u FROM e),
reach AS (SELECT DISTINCT rep AS node, rep AS seen FROM c UNION SELECT r.node, b.v FROM reach r JOIN links b ON r.seen = b.u),
root AS (SELECT node, min(seen) AS comp FROM reach GROUP BY node)
SELECT d.doc_id, coalesce(c.n, 0) AS n_shingles, coalesce(comp, d.doc_id) AS component_id, coalesce(comp, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN root ON c.rep = root.node
"""

OP12 = f"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all({_LOWERED.format('text')}, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
t AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT id) AS docs FROM (SELECT id, lang, source, unnest(w) AS term FROM d) GROUP BY ALL),
k AS (SELECT lang, term, sum(n) AS n FROM t GROUP BY lang, term HAVING sum(docs) >= 30),
v AS (SELECT lang, count(*) AS terms, sum(n) AS total FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT g.lang, g.source, k.term, coalesce(t.n, 0) AS n FROM g JOIN k USING (lang) LEFT JOIN t ON t.lang = g.lang AND t.source = g.source AND t.term = k.term),
s AS (SELECT lang, source, term, n, 1 + (CAST(1000000000 AS HUGEINT) * CAST(n + 5 AS HUGEINT)) // CAST(sum(n) OVER (PARTITION BY lang, source) + 5 * terms AS HUGEINT) AS p FROM c JOIN v USING (lang)),
q AS (SELECT k.lang, term, 1 + (CAST(1000000000 AS HUGEINT) * CAST(k.n + 5 AS HUGEINT)) // CAST(total + 5 * terms AS HUGEINT) AS q FROM k JOIN v USING (lang)),
f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM s a JOIN s b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
terms AS (SELECT s.lang, s.source, 'term' AS part, s.term AS item, p - q AS value FROM s JOIN q ON q.lang = s.lang AND q.term = s.term WHERE s.n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
WHERE part = 'pair' OR rank <= 50
"""
