"""DuckDB SQL of the page and document queries."""

import re

_FULL, _HALF = "".join(chr(0xFF01 + k) for k in range(94)).replace("'", "''"), "".join(chr(0x21 + k) for k in range(94)).replace("'", "''")


def normalized(x: str) -> str:
    return f"trim(regexp_replace(translate({x}, '{_FULL}', '{_HALF}'), '[\\s\\x0b\\x{{3000}}\\x{{00a0}}]+', ' ', 'g'))".replace("{{", "{").replace("}}", "}")


def hashed(x: str) -> str:
    return f"sha256({normalized(x)})"


def canonical(url: str) -> str:
    bare = f"regexp_replace({url}, '#.*$', '')"
    scheme = f"lower(regexp_extract({bare}, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1))"
    host = f"lower(regexp_extract({bare}, '^[^:]+://([^/?]*)', 1))"
    path = f"regexp_replace(regexp_extract({bare}, '^[^:]+://[^/?]*([^?]*)', 1), '/+$', '')"
    pairs = f"list_sort(list_filter(string_split(regexp_extract({bare}, '\\?(.*)$', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(lower(string_split(p, '=')[1]), '^(utm_.*|ref|spm|from|fbclid|gclid)$')))"
    return (
        f"CASE WHEN {scheme} <> '' THEN {scheme} || '://' || CASE WHEN {scheme} = 'http' THEN regexp_replace({host}, ':80$', '') WHEN {scheme} = 'https' THEN regexp_replace({host}, ':443$', '') ELSE {host} END"
        f" || CASE WHEN {path} = '' THEN '/' ELSE {path} END || CASE WHEN len({pairs}) > 0 THEN '?' || array_to_string({pairs}, '&') ELSE '' END ELSE {url} END"
    )


def resolved(href: str, base: str) -> str:
    scheme, origin = f"regexp_extract({base}, '^([A-Za-z]+)://', 1)", f"regexp_extract({base}, '^[A-Za-z]+://[^/?#]*')"
    page, href = f"regexp_replace({base}, '[?#].*$', '')", f"trim({href})"
    folder = f"CASE WHEN regexp_matches({page}, '^[A-Za-z]+://[^/]*$') THEN {page} || '/' ELSE regexp_replace({page}, '[^/]*$', '') END"
    full = f"CASE WHEN regexp_matches({href}, '^[A-Za-z]+://') THEN {href} WHEN starts_with({href}, '//') THEN {scheme} || ':' || {href} WHEN starts_with({href}, '/') THEN {origin} || {href} WHEN regexp_matches({href}, '^[?#]') THEN {page} || {href} ELSE {folder} || regexp_replace({href}, '^\\./', '') END"
    part = lambda k: f"regexp_extract({full}, '^([A-Za-z]+://[^/?#]*)([^?#]*)(.*)$', {k})"
    path = part(2)
    clean = f"list_reduce(list_concat([''], string_split({path}, '/')[2:]), lambda acc, x: CASE x WHEN '..' THEN regexp_replace(acc, '/[^/]*$', '') WHEN '.' THEN acc ELSE acc || '/' || x END) || CASE WHEN regexp_matches({path}, '/\\.\\.?$') THEN '/' ELSE '' END"
    return f"CASE WHEN regexp_matches({href}, '^(?i)[a-z][a-z0-9+.-]*:') AND NOT regexp_matches({href}, '^(?i)https?:') THEN NULL ELSE {part(1)} || CASE WHEN regexp_matches({path}, '/\\.\\.?(/|$)') THEN {clean} ELSE {path} END || {part(3)} END"


def visible_text(html: str) -> str:
    x = f"regexp_replace({html}, '(?s)<!--.*?-->', ' ', 'g')"
    for tag in ("script", "style", "nav", "footer", "head"):
        x = f"regexp_replace({x}, '(?s)<{tag}[^>]*>.*?</{tag}>', ' ', 'g')"
    x = f"regexp_replace({x}, '<[^>]*>', ' ', 'g')"
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
        x = f"replace({x}, '{entity}', '{char}')"
    return normalized(x)


_KEYED = f"""
batch AS (SELECT page_id, url, canonical_url, content_hash FROM (SELECT *, row_number() OVER (PARTITION BY canonical_url ORDER BY page_id) AS k FROM
  (SELECT page_id, url, {canonical('url')} AS canonical_url, {hashed('html')} AS content_hash FROM pages)) WHERE k = 1),
store AS (SELECT page_id, canonical_url, content_hash FROM (SELECT *, row_number() OVER (PARTITION BY canonical_url ORDER BY page_id) AS k FROM
  (SELECT page_id, {canonical('url')} AS canonical_url, {hashed("CASE WHEN page_id % 10 = 0 THEN html || ' changed' ELSE html END")} AS content_hash FROM pages WHERE page_id % 2 = 0)) WHERE k = 1)"""
_LINKS = "links AS (SELECT page_id, url, CAST(k - 1 AS INTEGER) AS position, h[k] AS href FROM (SELECT page_id, url, h, unnest(range(1, len(h) + 1)) AS k FROM (SELECT page_id, url, list_transform(regexp_extract_all(html, '(?i)\\bhref\\s*=\\s*(\"[^\"]*\"|''[^'']*'')', 1), lambda x: replace(x[2:-2], '&amp;', '&')) AS h FROM pages)))"
_DOCS = f"docs AS (SELECT doc_id AS document_id, source AS source_id, lang, n_chars, {hashed('text')} AS content_hash FROM documents)"
_TITLE = "nullif(trim(regexp_extract(html, '(?s)<{0}[^>]*>(.*?)</{0}>', 1)), '')"
_MASKED = "regexp_replace(regexp_replace(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}', '[email]', 'g'), '\\+?[0-9]{1,3}[ -]?\\(?[0-9]{3}\\)?[ -][0-9]{3}-[0-9]{4}', '[phone]', 'g'), '\\b[0-9]{15,17}[0-9Xx]\\b', '[id]', 'g')"
_BLANK, _ESCAPED = r"[ \t\n\x0B\f\r]", r"\\[^\n\r\x{85}\x{2028}\x{2029}]"


def any_case(pattern: str) -> str:
    """The pattern for its small letters in either case, of A to Z only: (?i) takes more of them here than in Spark."""
    return re.sub("[a-z]", lambda m: f"[{m[0].upper()}{m[0]}]", pattern)


def without_secrets(x: str) -> str:
    """The rule of text.mask_secrets(): values of what is called a secret, then what has the form of one."""
    words = any_case("token|secret|passw(?:or)?d|pwd|passphrase|api[_-]?key|access[_-]?key|private[_-]?key|credentials?|authorization")
    name = f"(?:[0-9A-Z_a-z.-]*(?:{words})[0-9A-Z_a-z.-]*|{any_case('cookie|set-cookie')}|密码|口令|密钥)"
    quoted = lambda q: rf"{q}(?:[^{q}\\]|{_ESCAPED})*{q}"
    value = f"""(?:{quoted('"')}|{quoted("'")}|[^ \\t\\n\\x0B\\f\\r"',;&，。；]+)"""
    rules = [
        (f"""({name}["']?{_BLANK}*[=:：]{_BLANK}*)(?:(?:{any_case('bearer|basic|digest|token')}){_BLANK}+)?{value}""", r"\1***"),
        (rf"\b({any_case('bearer')}{_BLANK}+)[0-9A-Za-z._~+/=-]{{8,}}", r"\1***"),
        (r"(://[^/ \t\n\x0B\f\r@:]+:)[^/ \t\n\x0B\f\r]+@", r"\1***@"),
        (r"\beyJ[0-9A-Z_a-z-]{5,}\.[0-9A-Z_a-z-]{5,}(?:\.[0-9A-Z_a-z-]*)?", "***"),
        (r"\bA(?:KI|SI)A[0-9A-Z]{16}\b|\bgh[oprsu]_[0-9A-Za-z]{20,}|\bsk-[0-9A-Z_a-z-]{20,}|\bxox[abprs]-[0-9A-Za-z-]{10,}", "***"),
        (r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?s:.*?)(?:-----END [A-Z ]*PRIVATE KEY-----|\z)", "***"),
    ]
    for pattern, mask in rules:
        x = f"regexp_replace({x}, '{pattern.replace(chr(39), chr(39) * 2)}', '{mask}', 'g')"
    return x


_WITH_SECRET = """concat_ws(chr(10), text, CASE doc_id % 8 WHEN 0 THEN 'Authorization: Bearer eyJ' || doc_id || '.abcdef' WHEN 1 THEN '{"api_key": "k' || doc_id || '", "n": 1}' WHEN 2 THEN 'X-Api-Key: ' || doc_id || 'x'
 WHEN 3 THEN 'password="p@ss!' || doc_id || '" ok' WHEN 4 THEN 'postgres://user:p' || doc_id || '@db/x' WHEN 5 THEN 'got Bearer abcdefgh' || doc_id || ' back' WHEN 6 THEN 'the secret is ' || doc_id WHEN 7 THEN '密码：p' || doc_id || '，完' END)"""
_UNIT = "CAST(embedding AS DOUBLE[])"
_TOPK = f"""
q AS (SELECT vec_id AS query_id, {_UNIT} AS v, label AS query_label FROM embeddings WHERE vec_id % 20 = 0),
cos AS (SELECT query_id, query_label, vec_id, label, round(list_cosine_similarity(v, {_UNIT}), 6) AS cosine FROM q, embeddings WHERE vec_id <> query_id),
topk AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, vec_id) AS INTEGER) AS rank FROM cos) WHERE rank <= 10)"""

ORACLE_SQL = {
    "canonical_urls": f"SELECT page_id, {canonical('url')} AS canonical_url FROM pages",
    "new_urls": f"WITH {_KEYED} SELECT page_id, canonical_url FROM batch WHERE canonical_url NOT IN (SELECT canonical_url FROM store)",
    "changed_pages": f"WITH {_KEYED} SELECT b.page_id, canonical_url, b.content_hash, s.content_hash AS current_hash FROM batch b JOIN store s USING (canonical_url) WHERE b.content_hash <> s.content_hash",
    "skip_unmodified": f"WITH {_KEYED} SELECT b.page_id, canonical_url FROM batch b LEFT JOIN store s USING (canonical_url) WHERE s.content_hash IS DISTINCT FROM b.content_hash",
    "resolved_links": f"WITH {_LINKS} SELECT page_id, position, {resolved('href', 'url')} AS link FROM links",
    "discovered_links": f"WITH {_LINKS}, r AS (SELECT page_id, {resolved('href', 'url')} AS full_link FROM links WHERE full_link IS NOT NULL) SELECT {canonical('full_link')} AS link, count(*) AS n_links, count(DISTINCT page_id) AS n_pages FROM r GROUP BY 1",
    "page_text": f"SELECT page_id, {visible_text('html')} AS body FROM pages",
    "page_title": f"SELECT page_id, coalesce({_TITLE.format('title')}, {_TITLE.format('h1')}) AS title FROM pages",
    "boilerplate_lines": "SELECT source AS source_id, sha256(line) AS line_hash, count(*) AS n_docs FROM (SELECT DISTINCT doc_id, source, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE trim(line) <> '' GROUP BY 1, 2 HAVING count(*) >= 2",
    "fingerprints": f"WITH {_DOCS} SELECT document_id, content_hash FROM docs",
    "duplicate_rate": f"WITH {_DOCS}, f AS (SELECT source_id, row_number() OVER (PARTITION BY source_id, content_hash ORDER BY document_id) > 1 AS dup FROM docs) SELECT source_id, count(*) AS n_rows, count(*) FILTER (WHERE dup) AS n_duplicates, round(avg(dup::INT), 4) AS duplicate_rate FROM f GROUP BY source_id",
    "current_versions": f"WITH {_DOCS} SELECT source_id, lang, max(document_id) AS document_id, arg_max(content_hash, document_id) AS content_hash FROM docs GROUP BY source_id, lang",
    "version_history": f"WITH {_DOCS}, f AS (SELECT *, CAST(floor(log2(n_chars + 1)) AS INTEGER) AS c FROM docs), g AS (SELECT *, lag(content_hash) OVER w IS DISTINCT FROM content_hash AS changed FROM f WINDOW w AS (PARTITION BY source_id, lang, c ORDER BY document_id)) SELECT document_id, CAST(sum(changed::INT) OVER (PARTITION BY source_id, lang, c ORDER BY document_id) AS BIGINT) AS version, changed FROM g",
    "repeat_hashes": f"WITH {_DOCS} SELECT content_hash, count(*) AS n FROM docs GROUP BY content_hash HAVING count(*) > 1",
    "masked_pii": f"SELECT doc_id AS document_id, {_MASKED} || chr(10) || CASE doc_id % 7 WHEN 0 THEN '电话[phone]。' WHEN 1 THEN '手机：[phone]' WHEN 2 THEN '座机[phone]' WHEN 3 THEN '证件[id]号' WHEN 4 THEN 'call [phone]' WHEN 5 THEN '订单' || lpad(CAST(doc_id AS VARCHAR), 8, '0') ELSE 'mail [email]' END AS masked FROM documents",
    "masked_secrets": f"SELECT doc_id AS document_id, {without_secrets(_WITH_SECRET)} AS masked FROM documents",
    "distinct_urls": f"SELECT count(DISTINCT url) AS n_url, count(DISTINCT {canonical('url')}) AS n_canonical FROM pages",
    "top_documents": "SELECT doc_id AS document_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 20",
    "golden_diff": "SELECT coalesce(l.doc_id, d.doc_id) AS document_id, CAST(quality AS INTEGER) AS expected_value, CAST(n_chars >= 200 AS INTEGER) AS actual_value, CASE WHEN d.doc_id IS NULL THEN 'missing' WHEN l.doc_id IS NULL THEN 'unexpected' WHEN CAST(quality AS INTEGER) IS NOT DISTINCT FROM CAST(n_chars >= 200 AS INTEGER) THEN 'equal' ELSE 'different' END AS kind FROM labels l FULL JOIN documents d ON l.doc_id = d.doc_id",
    "golden_success": "SELECT CASE WHEN d.doc_id IS NULL THEN 'missing' WHEN l.doc_id IS NULL THEN 'unexpected' WHEN CAST(quality AS INTEGER) IS NOT DISTINCT FROM CAST(n_chars >= 200 AS INTEGER) THEN 'equal' ELSE 'different' END AS kind, count(*) AS n FROM labels l FULL JOIN documents d ON l.doc_id = d.doc_id GROUP BY 1",
    "precision_at_20": "WITH r AS (SELECT lang, CAST(quality AS DOUBLE) AS good, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS k FROM documents JOIN labels USING (doc_id)) SELECT lang, count(*) FILTER (WHERE k <= 20) AS n_top, round(avg(good) FILTER (WHERE k <= 20), 4) AS precision, round(coalesce(sum(good) FILTER (WHERE k > 20), 0) / sum(good), 4) AS missed FROM r GROUP BY lang",
    "vector_topk": f"WITH {_TOPK} SELECT query_id, vec_id, cosine, rank FROM topk",
    "recall_gain": f"WITH {_TOPK}, b AS (SELECT query_id, e.label = query_label AS good FROM q JOIN embeddings e ON e.vec_id BETWEEN query_id + 1 AND query_id + 10), pb AS (SELECT query_id, avg(good::INT) AS p FROM b GROUP BY query_id), pc AS (SELECT query_id, avg((label = query_label)::INT) AS p FROM topk GROUP BY query_id) SELECT query_id, round(pb.p, 4) AS base_precision, round(pc.p, 4) AS candidate_precision, round(pc.p - pb.p, 4) AS gain FROM pb FULL JOIN pc USING (query_id)",
    "rerank_capped": f"WITH {_TOPK}, t AS (SELECT query_id, vec_id, label, rank AS place, coalesce(sum(vec_id % 3 + 1) OVER (PARTITION BY query_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 6 AS reranked FROM topk WHERE rank <= 5) SELECT query_id, vec_id, place, reranked, CAST(row_number() OVER (PARTITION BY query_id ORDER BY reranked DESC, CASE WHEN reranked THEN -label END NULLS FIRST, place) AS INTEGER) AS final_place FROM t",
}
