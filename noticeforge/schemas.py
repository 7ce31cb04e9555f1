"""Fixed schemas (DDL) of the tables of the chain from source to report; never inferred on read."""

SCHEMAS: dict[str, str] = {
    "sources": "source_id long, name string, base_url string, category string, adapter string, enabled boolean, crawl_interval_s long",
    "source_events": "source_id long, enabled boolean, changed_at timestamp",
    "crawl_runs": "run_id long, source_id long, scheduled_at timestamp, status string, started_at timestamp, finished_at timestamp, stats struct<discovered:long,new:long,updated:long,skipped:long,failed:long>, error string",
    "crawl_items": "run_id long, source_id long, url string, outcome string, http_status int, attempts int, error_class string, etag string, last_modified string",
    "snapshots": "source_id long, url string, html string, fetched_at timestamp",
    "raw_documents": "document_id string, source_id long, canonical_url string, title string, raw_html string, raw_text string, published_at timestamp, content_hash string, fetched_at timestamp, version int",
    "attachments": "attachment_id string, document_id string, url string, file_name string, mime_type string, sha256 string, local_path string, parse_status string, size long",
    "blocks": "document_id long, attachment_id long, source_type string, block_no int, page int, sheet string, row int, cell string, text string",
    "job_posts": "post_id long, document_id string, organization string, category string, region string, apply_url string, start_at timestamp, deadline timestamp, extraction_version string",
    "job_positions": "position_id string, post_id long, name string, department string, location string, education string, major string, headcount int, requirements string",
    "field_evidence": "entity_type string, entity_id long, field_name string, source_type string, raw_value string, norm_value string, quote string, page int, cell string, confidence double, extraction_version string",
    "user_preferences": "pref_id long, regions array<string>, education int, majors array<string>, job_keywords array<string>, requirement_terms array<string>, organization_types array<string>, exclusions array<string>, updated_at timestamp",
    "match_results": "position_id string, pref_id long, score double, score_version string, components array<struct<rule:string,input:string,score:double,explanation:string>>, matched_rules array<string>, generated_at timestamp",
    "reports": "pref_id long, report_date date, format string, content string, item_count long, status string",
    "notifications": "report_id long, channel string, status string, attempts int, sent_at timestamp, error string",
    "review_queue": "document_id long, field_name string, reason string, severity string, state string",
    "llm_calls": "call_id long, called_at timestamp, document_id long, model string, prompt_version string, tokens long, cost decimal(12,6), status string",
    "tool_calls": "call_id long, tool string, args_summary string, status string, duration_ms long, idempotency_key string",
}

EVIDENCE_RANK = ("rule", "table", "llm")
