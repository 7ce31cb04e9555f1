"""DuckDB SQL of the queries on notices, attachments and cells."""

from noticeforge.plans.pages_sql import _LINKS, canonical, resolved
from noticeforge.plans.positions_sql import VISIBLE

_XLSX = "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet"

ORACLE_SQL = {
    "notice_dates": """
WITH d AS (SELECT o_orderkey AS post_id, o_orderkey % 14 AS form, CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) AS day, CAST(CAST(o_orderdate AS DATE) + 13 AS TIMESTAMP) AS last FROM orders),
w AS (SELECT post_id, CASE form WHEN 7 THEN 0 WHEN 12 THEN 4 WHEN 2 THEN 1 WHEN 4 THEN 1 WHEN 8 THEN 1 WHEN 10 THEN 1 ELSE 2 END AS n_dates,
  CASE form WHEN 0 THEN day WHEN 1 THEN day + INTERVAL 9 HOUR WHEN 3 THEN date_trunc('month', day) WHEN 5 THEN day + INTERVAL 9 HOUR WHEN 6 THEN day + INTERVAL 9 HOUR
            WHEN 9 THEN day WHEN 11 THEN day + INTERVAL 870 MINUTE WHEN 12 THEN day + INTERVAL 14 HOUR WHEN 13 THEN day END AS start_at,
  CASE form WHEN 0 THEN last + INTERVAL 86399 SECOND WHEN 1 THEN last + INTERVAL 17 HOUR WHEN 2 THEN day + INTERVAL 24 HOUR WHEN 3 THEN day + INTERVAL 86399 SECOND WHEN 4 THEN day + INTERVAL 17 HOUR
            WHEN 5 THEN day + INTERVAL 930 MINUTE WHEN 6 THEN day + INTERVAL 690 MINUTE WHEN 9 THEN last + INTERVAL 86399 SECOND WHEN 10 THEN day + INTERVAL 17 HOUR
            WHEN 11 THEN day + INTERVAL 17 HOUR WHEN 12 THEN day + INTERVAL 17 HOUR WHEN 13 THEN last + INTERVAL 86399 SECOND END AS deadline FROM d)
SELECT post_id, CAST(n_dates AS INTEGER) AS n_dates, strftime(start_at, '%Y-%m-%d %H:%M:%S') AS start_at, strftime(deadline, '%Y-%m-%d %H:%M:%S') AS deadline FROM w
""",
    "notice_fields": "SELECT c_custkey AS document_id, c_name AS organization, CAST(c_custkey % 40 + 1 AS INTEGER) AS headcount, CASE WHEN c_custkey % 3 = 0 THEN 'bachelor' WHEN c_custkey % 3 = 1 THEN 'master' END AS education, CAST(CASE c_custkey % 3 WHEN 0 THEN 3 WHEN 1 THEN 4 END AS INTEGER) AS education_order, 'https://jobs.example.org/' || c_custkey AS apply_url FROM customer",
    "notice_regions": "WITH names AS (SELECT n_nationkey AS id, n_name AS name FROM nation UNION ALL SELECT r_regionkey + 100, r_name FROM region), docs AS (SELECT s_suppkey AS document_id, CASE WHEN s_suppkey % 4 = 0 THEN 'somewhere in ' || r_name ELSE 'an office in ' || n_name || ', ' || r_name END AS text FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) SELECT document_id, (SELECT name FROM names WHERE contains(text, name) ORDER BY length(name) DESC, id LIMIT 1) AS region FROM docs",
    "normalised_evidence": "SELECT c_custkey AS entity_id, 'segment' AS field_name, c_mktsegment AS raw_value, lower(c_mktsegment) AS norm_value FROM customer WHERE c_mktsegment IS NOT NULL UNION ALL SELECT c_custkey, 'balance', CAST(CAST(floor(c_acctbal) AS BIGINT) AS VARCHAR), CAST(CAST(floor(c_acctbal) AS BIGINT) % 1000 AS VARCHAR) FROM customer WHERE c_acctbal > 0",
    "evidenced_fields": "SELECT c_custkey AS entity_id, CASE WHEN c_custkey % 4 <> 0 THEN c_name END AS organization, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal END AS balance FROM customer",
    "attachment_links": f"WITH {_LINKS}, r AS (SELECT page_id, position, {resolved('href', 'url')} AS full_link FROM links), f AS (SELECT page_id, position, CASE WHEN position % 3 = 0 THEN {canonical('full_link')} || '.PDF?v=1' ELSE {canonical('full_link')} END AS link FROM r WHERE full_link IS NOT NULL) SELECT * FROM f WHERE regexp_matches(regexp_replace(link, '[?#].*$', ''), '(?i)\\.(pdf|xlsx?)$')",
    "attachment_checks": f"SELECT page_id, CASE page_id % 7 WHEN 1 THEN '{_XLSX}' WHEN 2 THEN 'application/vnd.ms-excel' WHEN 3 THEN 'text/html' WHEN 5 THEN 'unknown' ELSE 'application/pdf' END AS real_mime, CASE page_id % 7 WHEN 0 THEN 'ok' WHEN 1 THEN 'ok' WHEN 4 THEN 'incomplete' ELSE 'rejected' END AS status, CASE page_id % 7 WHEN 2 THEN 'mime_mismatch' WHEN 3 THEN 'html_error_page' WHEN 4 THEN 'incomplete' WHEN 5 THEN 'empty' WHEN 6 THEN 'wrong_extension' END AS reason, page_id % 7 NOT IN (4, 5) AS complete, CASE page_id % 7 WHEN 1 THEN 'xlsx' WHEN 5 THEN 'unsupported' ELSE 'pdf_text' END AS parser FROM pages",
    "pdf_states": "SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'ok' WHEN 1 THEN 'encrypted' ELSE 'corrupt' END AS parse_status, CASE page_id % 4 WHEN 1 THEN 'needs a password' WHEN 2 THEN 'no end of file' WHEN 3 THEN 'no PDF header' END AS diagnosis FROM pages",
    "parse_success": "SELECT count(*) AS n_readable, round(avg((page_id % 8 = 0)::INT), 4) AS parse_success FROM pages WHERE page_id % 4 = 0",
    "scan_flags": "SELECT doc_id // 10 AS attachment_id, count(*) AS n_pages, round(avg(length(coalesce(trim(text), ''))), 4) AS chars_per_page, CASE WHEN avg(length(coalesce(trim(text), ''))) < 1000 THEN 'ocr_required' ELSE 'ok' END AS parse_status FROM documents GROUP BY 1",
    "text_blocks": "SELECT attachment_id, CAST(1 AS INTEGER) AS page, CAST(k - 1 AS INTEGER) AS block_no, b[k] AS text FROM (SELECT attachment_id, b, unnest(range(1, len(b) + 1)) AS k FROM (SELECT doc_id AS attachment_id, list_filter(regexp_split_to_array(text, '\\n\\s*\\n'), lambda x: trim(x) <> '') AS b FROM documents))",
    "new_attachments": "WITH f AS (SELECT doc_id AS document_id, 'https://files.example.org/' || lpad(CAST(doc_id AS VARCHAR), 9, '0') AS url, sha256(text) AS sha256 FROM documents), n AS (SELECT sha256, min(url) AS url FROM f WHERE sha256 NOT IN (SELECT sha256 FROM f WHERE document_id % 3 = 0) GROUP BY sha256) SELECT document_id, n.sha256, n.url, n.url AS canonical_url FROM n JOIN f ON n.url = f.url",
    "slot_runs": "WITH runs AS (SELECT event_id AS run_id, user_id AS source_id, ts + to_minutes(CAST(floor(value) AS INTEGER)) AS finished_at, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'success' END AS status FROM events), slots AS (SELECT source_id, CAST(d AS TIMESTAMP) AS slot_at FROM (SELECT DISTINCT user_id AS source_id FROM events), (SELECT unnest(generate_series(DATE '2024-01-01', DATE '2024-01-30', INTERVAL 1 DAY)) AS d)) SELECT s.source_id, slot_at, run_id, status FROM slots s LEFT JOIN runs r ON r.source_id = s.source_id AND finished_at >= slot_at AND finished_at < slot_at + INTERVAL 6 HOUR",
    "source_states": "SELECT user_id AS source_id, arg_max(event_type <> 'error', (ts, event_id)) AS enabled FROM events GROUP BY user_id",
    "review_states": f"WITH {VISIBLE}, x AS (SELECT post_id, unnest(list_filter([CASE WHEN position_id IS NULL THEN 'missing_position' END, CASE WHEN deadline IS NULL THEN 'missing_deadline' END, CASE WHEN deadline < start_at THEN 'deadline_before_start' END, CASE WHEN headcount > 45 THEN 'large_headcount' END], lambda r: r IS NOT NULL)) AS reason FROM visible) SELECT reason, CASE WHEN post_id % 5 = 0 AND reason = 'large_headcount' THEN 'accepted' ELSE 'open' END AS state, count(*) AS n FROM x GROUP BY ALL",
    "pref_problems": "SELECT c_custkey AS pref_id, concat_ws(',', CASE WHEN c_custkey % 4 = 0 THEN 'regions' END, CASE WHEN c_custkey % 5 = 0 OR c_mktsegment NOT IN ('BUILDING', 'MACHINERY', 'FURNITURE') THEN 'majors' END) AS problems FROM customer",
    "sheet_fields": "SELECT c_nationkey AS attachment_id, CAST(c_custkey + 3 AS INTEGER) AS row, c_name AS name, CAST(c_custkey % 50 AS VARCHAR) AS headcount, n_name AS region, 'A' || (c_custkey + 3) AS name_cell, 'C' || (c_custkey + 3) AS region_cell FROM customer JOIN nation ON c_nationkey = n_nationkey",
}
