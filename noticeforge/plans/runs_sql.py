"""DuckDB SQL of the run log, notification, evidence and call queries."""

from noticeforge.plans.pages_sql import hashed

_ITEMS = "items AS (SELECT event_id AS run_id, user_id AS source_id, CAST(ts AS DATE) AS day, ts AS started_at, CASE event_type WHEN 'signup' THEN 'discovered' WHEN 'purchase' THEN 'new' WHEN 'click' THEN 'updated' WHEN 'view' THEN 'skipped' ELSE 'failed' END AS outcome, CASE WHEN event_type = 'error' THEN 'E' || CAST(regexp_extract(props, '\"k\": ([0-9]+)', 1) AS INTEGER) % 5 END AS error_class, CASE event_type WHEN 'error' THEN 503 WHEN 'click' THEN 200 WHEN 'view' THEN 304 WHEN 'signup' THEN 404 ELSE 429 END AS http_status FROM events)"
_STATS = _ITEMS + ", stats AS (SELECT source_id, day, count(*) FILTER (WHERE outcome = 'discovered') AS discovered, count(*) FILTER (WHERE outcome = 'new') AS new, count(*) FILTER (WHERE outcome = 'updated') AS updated, count(*) FILTER (WHERE outcome = 'skipped') AS skipped, count(*) FILTER (WHERE outcome = 'failed') AS failed FROM items GROUP BY ALL)"
_RUNS = "runs AS (SELECT event_id AS run_id, user_id AS source_id, ts AS started_at, ts + to_minutes(CAST(floor(value) AS INTEGER)) AS finished_at, event_type <> 'error' AS ok, event_type FROM events)"
_FILLED = (
    _RUNS
    + ", slots AS (SELECT source_id, CAST(d AS DATE) AS slot_day FROM (SELECT DISTINCT user_id AS source_id FROM events), (SELECT unnest(generate_series(DATE '2024-01-01', DATE '2024-01-30', INTERVAL 1 DAY)) AS d)), last AS (SELECT source_id, CAST(started_at AS DATE) AS slot_day, arg_max(started_at, (started_at, run_id)) AS started_at, arg_max(ok, (started_at, run_id)) AS ok FROM runs GROUP BY 1, 2), filled AS (SELECT s.source_id, s.slot_day, started_at, ok FROM slots s LEFT JOIN last USING (source_id, slot_day))"
)
_NOTES = "notes AS (SELECT user_id * 100 + (CAST(ts AS DATE) - DATE '2024-01-01') AS report_id, CASE WHEN event_id % 2 = 0 THEN 'email' ELSE 'wechat' END AS channel, event_type = 'purchase' AS ok, ts AS sent_at FROM events), tried AS (SELECT report_id, channel, count(*) AS attempts, bool_or(ok) AS delivered, max(sent_at) AS last_sent, CASE WHEN bool_or(ok) THEN 'delivered' WHEN count(*) < 3 THEN 'retry' ELSE 'permanent' END AS state FROM notes GROUP BY ALL), open AS (SELECT report_id, channel FROM (SELECT DISTINCT report_id FROM notes), (SELECT unnest(['email', 'wechat']) AS channel) WHERE (report_id, channel) NOT IN (SELECT (report_id, channel) FROM notes WHERE ok))"
_CALLS = "calls AS (SELECT event_id AS call_id, ts AS called_at, CAST(ts AS DATE) AS day, event_type AS model, CAST(regexp_extract(props, '\"k\": ([0-9]+)', 1) AS BIGINT) AS tokens, CAST(value AS DECIMAL(12,2)) AS cost FROM events)"
_MERGED = "cand AS (SELECT conv_id AS entity_id, role AS source_type, nullif(string_split(lower(regexp_replace(text, '[^A-Za-z0-9 ]', '', 'g')), ' ')[1], '') AS norm_value, length(text) AS confidence, turn AS position, list_position(['system', 'user', 'assistant'], role) AS pr FROM conversations), merged AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY norm_value IS NULL, pr, confidence DESC, position) = 1 AS winner, coalesce(min(norm_value) OVER (PARTITION BY entity_id) <> max(norm_value) OVER (PARTITION BY entity_id), false) AS conflict FROM cand)"

ORACLE_SQL = {
    "run_stats": f"WITH {_STATS} SELECT * FROM stats",
    "run_status": f"WITH {_STATS} SELECT source_id, day, failed, discovered + new + updated + skipped + failed AS attempted, CASE WHEN failed > 0.5 * (discovered + new + updated + skipped + failed) THEN 'failed' ELSE 'success' END AS status FROM stats",
    "source_availability": f"WITH {_FILLED}, w AS (SELECT source_id, coalesce(ok, false)::INT AS ok FROM filled WHERE slot_day < DATE '2024-01-31' AND slot_day >= DATE '2024-01-24') SELECT source_id, count(*) AS n_slots, CAST(sum(ok) AS BIGINT) AS n_ok, round(avg(ok), 4) AS availability FROM w GROUP BY ROLLUP (source_id)",
    "on_time_rate": f"WITH {_FILLED}, w AS (SELECT source_id, coalesce(hour(started_at) < 12 AND ok, false)::INT AS hit, row_number() OVER (PARTITION BY source_id ORDER BY slot_day DESC) AS k FROM filled) SELECT source_id, count(*) AS n_slots, round(avg(hit), 4) AS on_time_rate FROM w WHERE k <= 20 GROUP BY source_id",
    "failure_streaks": f"WITH {_RUNS}, i AS (SELECT *, sum(ok::INT) OVER (PARTITION BY source_id ORDER BY started_at, run_id) AS island FROM runs), s AS (SELECT source_id, island, sum(1 - ok::INT) AS n FROM i GROUP BY ALL) SELECT source_id, CAST(max(n) AS BIGINT) AS longest_failures, CAST(arg_max(n, island) AS BIGINT) AS current_failures FROM s GROUP BY source_id",
    "failed_only_rerun": f"WITH {_ITEMS} SELECT source_id, day, count(*) AS attempts FROM items GROUP BY source_id, day HAVING arg_max(outcome, (started_at, run_id)) = 'failed'",
    "retry_plan": f"WITH {_ITEMS}, t AS (SELECT *, CAST(row_number() OVER (PARTITION BY source_id, day ORDER BY started_at, run_id) AS INTEGER) AS attempts FROM items) SELECT run_id, attempts, CASE WHEN http_status IN (429, 503) THEN 'retry' WHEN http_status = 304 THEN 'unchanged' WHEN http_status = 404 THEN 'final' ELSE 'ok' END AS action, CASE WHEN http_status IN (429, 503) AND attempts < 3 THEN started_at + to_seconds(60 * 2 ** (attempts - 1)) END AS next_attempt FROM t",
    "slot_overlap": f"WITH {_RUNS}, o AS (SELECT *, max(finished_at) OVER (PARTITION BY source_id ORDER BY started_at, run_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS busy_until FROM runs) SELECT run_id, source_id, busy_until FROM o WHERE busy_until >= started_at",
    "unfinished_runs": f"WITH {_RUNS}, l AS (SELECT source_id, arg_max(run_id, (started_at, run_id)) AS run_id, max(started_at) AS started_at, arg_max(event_type, (started_at, run_id)) AS t FROM runs GROUP BY source_id) SELECT source_id, run_id, started_at FROM l WHERE t = 'signup' AND started_at < TIMESTAMP '2024-01-31' - INTERVAL 6 HOUR",
    "due_sources": "WITH l AS (SELECT user_id AS source_id, (1 + user_id % 3) * 86400 AS interval_s, max(ts) AS last_started FROM events GROUP BY user_id) SELECT source_id, interval_s, last_started FROM l WHERE source_id % 5 <> 0 AND last_started + to_seconds(interval_s) <= TIMESTAMP '2024-01-31'",
    "failure_classes": f"WITH {_ITEMS} SELECT error_class, count(*) AS n FROM items WHERE error_class IS NOT NULL GROUP BY error_class",
    "stage_trace": "SELECT CAST(ts AS DATE) AS scheduled_at, min(event_id) FILTER (WHERE event_type = 'signup') AS signup, min(event_id) FILTER (WHERE event_type = 'view') AS view, min(event_id) FILTER (WHERE event_type = 'click') AS click, min(event_id) FILTER (WHERE event_type = 'purchase') AS purchase, min(event_id) FILTER (WHERE event_type = 'error') AS error FROM events GROUP BY 1",
    "outbox": f"WITH {_NOTES} SELECT report_id, channel FROM open",
    "delivery_attempts": f"WITH {_NOTES} SELECT report_id, channel, attempts, state FROM tried",
    "delivery_list": f"WITH {_NOTES} SELECT o.report_id, o.channel, coalesce(attempts, 0) AS attempts, CASE WHEN attempts < 3 THEN last_sent + to_seconds(60 * 2 ** (attempts - 1)) END AS next_attempt, coalesce(state, 'new') AS state FROM open o LEFT JOIN tried t ON o.report_id = t.report_id AND o.channel = t.channel",
    "tool_audit": "SELECT event_type AS tool, CASE WHEN value > 100 THEN 'slow' ELSE 'ok' END AS status, count(*) AS n_calls, round(avg(value), 4) AS mean_ms, round(quantile_cont(value, 0.95), 4) AS p95_ms FROM events GROUP BY 1, 2",
    "task_success": "SELECT CASE WHEN user_id % 2 = 0 THEN 'query' ELSE 'command' END AS kind, count(*) AS n_tasks, round(avg((event_type <> 'error')::INT), 4) AS success_rate, count(*) FILTER (WHERE user_id % 2 = 0 AND event_type = 'purchase') AS violations FROM events GROUP BY 1",
    "llm_cost_daily": f"WITH {_CALLS} SELECT day, model, count(*) AS n_calls, CAST(sum(tokens) AS BIGINT) AS tokens, sum(cost) AS cost FROM calls GROUP BY day, model",
    "budget_admission": f"WITH {_CALLS}, s AS (SELECT call_id, coalesce(sum(cost) OVER (PARTITION BY day ORDER BY called_at, call_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent_before FROM calls) SELECT call_id, spent_before, CASE WHEN spent_before < 600 THEN 'admitted' ELSE 'pending' END AS status FROM s",
    "valid_extractions": "SELECT event_id, CASE WHEN event_id % 7 IN (0, 5, 6) THEN CAST(regexp_extract(props, '\"k\": ([0-9]+)', 1) AS INTEGER) END AS k, CASE event_id % 7 WHEN 1 THEN 'malformed' WHEN 2 THEN 'wrong_type' WHEN 3 THEN 'missing_field' WHEN 4 THEN 'extra_field' END AS problem FROM events",
    "utc_to_local": "SELECT event_id, ts + INTERVAL 8 HOUR AS local_ts, CAST(ts + INTERVAL 8 HOUR AS DATE) AS local_date FROM events",
    "first_seen": "SELECT user_id, event_type, CAST(min(ts) + INTERVAL 8 HOUR AS DATE) AS first_day FROM events GROUP BY user_id, event_type",
    "merged_fields": f"WITH {_MERGED} SELECT entity_id, source_type, norm_value, position, conflict FROM merged WHERE winner",
    "field_conflicts": f"WITH {_MERGED} SELECT entity_id, bool_or(conflict) AS conflict, count(DISTINCT norm_value) AS n_values FROM merged GROUP BY entity_id",
    "evidence_lists": "SELECT conv_id, string_agg(turn || ':' || role || ':' || length(text), ';' ORDER BY turn, role, length(text)) AS evidence, count(*) AS n_evidence FROM conversations GROUP BY conv_id",
    "evidence_gaps": "SELECT conv_id, field_name FROM (SELECT DISTINCT conv_id FROM conversations), (SELECT unnest(['system', 'user', 'assistant']) AS field_name) WHERE (conv_id, field_name) NOT IN (SELECT (conv_id, role) FROM conversations)",
    "quality_board": f"WITH r AS (SELECT 'src' || user_id % 20 AS source_id, count(*) AS n_runs, round(avg((event_type <> 'error')::INT), 4) AS success_rate, sum(CAST(value AS DECIMAL(12,2))) AS minutes FROM events GROUP BY 1), d AS (SELECT source AS source_id, n_chars, lang, row_number() OVER (PARTITION BY source, {hashed('text')} ORDER BY doc_id) > 1 AS dup FROM documents), q AS (SELECT source_id, count(*) AS n_rows, round(avg(dup::INT), 4) AS duplicate_rate, round(sum((n_chars >= 200)::INT + (lang IS NOT NULL)::INT) / (2.0 * count(*)), 4) AS filled_share FROM d GROUP BY source_id) , a AS (SELECT source AS source_id, count(*) AS n_readable, round(avg((doc_id % 7 <> 2)::INT), 4) AS parse_rate FROM documents WHERE doc_id % 7 NOT IN (3, 5) GROUP BY 1) SELECT source_id, n_runs, success_rate, minutes, n_rows, duplicate_rate, filled_share, n_readable, parse_rate FROM r FULL JOIN q USING (source_id) FULL JOIN a USING (source_id)",
}
