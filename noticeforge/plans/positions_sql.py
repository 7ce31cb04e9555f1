"""DuckDB SQL of the position and report queries."""

VISIBLE = """
posts AS (SELECT o_orderkey AS post_id, c_name AS organization, c_mktsegment AS category, r_name AS region, o_orderdate AS start_at
          FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
positions AS (SELECT concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(l_quantity AS BIGINT), CAST(round(l_extendedprice * 100) AS BIGINT), strftime(l_shipdate, '%Y%m%d')) AS position_id,
                     l_orderkey AS post_id, p_name AS name, p_type AS major, p_size AS education, p_brand AS requirements, CAST(l_quantity AS BIGINT) AS headcount, l_shipdate AS deadline,
                     l_partkey AS part_id, l_suppkey AS supplier_id, l_linenumber AS line_number, l_extendedprice AS price
              FROM lineitem JOIN part ON l_partkey = p_partkey),
visible AS (SELECT p.*, q.* EXCLUDE (post_id) FROM posts p LEFT JOIN positions q USING (post_id) WHERE start_at <= TIMESTAMP '1998-06-15')"""

SCORED = (
    VISIBLE
    + """,
flagged AS (SELECT *, CASE WHEN deadline >= start_at THEN deadline END AS due, position_id IS NULL OR deadline IS NULL OR deadline < start_at AS severe FROM visible),
parts AS (SELECT *,
    CAST(CASE WHEN region IN ('ASIA', 'EUROPE') THEN 25 ELSE 0 END AS DOUBLE) AS s_region,
    CAST(CASE WHEN contains(name, 'widget') OR contains(name, 'gear') THEN 30 WHEN requirements IN ('Brand#1', 'Brand#2') THEN 15 ELSE 0 END AS DOUBLE) AS s_keyword,
    CAST(CASE WHEN major IN ('STANDARD', 'PROMO') THEN 15 ELSE 0 END AS DOUBLE) AS s_major,
    CAST(CASE WHEN category IN ('BUILDING', 'MACHINERY') THEN 10 ELSE 0 END AS DOUBLE) AS s_organization,
    CAST(CASE WHEN due IS NULL OR due <= TIMESTAMP '1998-06-15' THEN 0 WHEN due <= TIMESTAMP '1998-06-18' THEN 10 WHEN due <= TIMESTAMP '1998-06-22' THEN 7 WHEN due <= TIMESTAMP '1998-06-29' THEN 4 ELSE 2 END AS DOUBLE) AS s_urgency,
    CAST(2 * ((organization IS NOT NULL)::INT + (name IS NOT NULL)::INT + (region IS NOT NULL)::INT + (due IS NOT NULL)::INT + 1) AS DOUBLE) AS s_completeness,
    coalesce(education > 30, false) AS bad_education, coalesce(contains(name, 'anvil'), false) AS bad_word, coalesce(due <= TIMESTAMP '1998-06-15', false) AS expired
  FROM flagged),
scored AS (SELECT *, NOT (bad_education OR bad_word OR expired) AS passed,
    CASE WHEN NOT (bad_education OR bad_word OR expired) THEN s_region + s_keyword + s_major + s_organization + s_urgency + s_completeness ELSE 0 END AS score FROM parts)"""
)

GROUPED = (
    SCORED
    + """,
grouped AS (SELECT * FROM (SELECT *, CASE WHEN severe OR post_id % 97 = 0 OR post_id % 89 = 0 THEN 'to_confirm' WHEN deadline > TIMESTAMP '1998-06-15' AND deadline <= TIMESTAMP '1998-06-18' THEN 'closing_soon'
      WHEN score >= 60 AND deadline > TIMESTAMP '1998-06-15' THEN 'priority' WHEN CAST(start_at AS DATE) - CAST(post_id % 3 AS INTEGER) = DATE '1998-06-15' THEN 'new_today' END AS report_group
    FROM scored WHERE passed) WHERE report_group IS NOT NULL),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY report_group ORDER BY score DESC, deadline ASC NULLS LAST, post_id, part_id NULLS FIRST, supplier_id NULLS FIRST, line_number NULLS FIRST, price NULLS FIRST) AS INTEGER) AS rank FROM grouped)"""
)

_REASONS = "concat_ws(',', CASE WHEN bad_education THEN 'education' END, CASE WHEN bad_word THEN 'exclusion' END, CASE WHEN expired THEN 'expired' END)"
_RULES = "concat_ws('+', CASE WHEN s_region > 0 THEN 'region' END, CASE WHEN s_keyword > 0 THEN 'keyword' END, CASE WHEN s_major > 0 THEN 'major' END, CASE WHEN s_organization > 0 THEN 'organization' END, CASE WHEN s_urgency > 0 THEN 'urgency' END, CASE WHEN s_completeness > 0 THEN 'completeness' END)"
_RISKS = "concat_ws(', ', CASE WHEN position_id IS NULL THEN 'no position' END, CASE WHEN deadline IS NULL THEN 'no deadline' END, CASE WHEN deadline < start_at THEN 'deadline before start' END, CASE WHEN region IS NULL THEN 'no region' END, CASE WHEN post_id % 97 = 0 THEN 'fields in conflict' END, CASE WHEN post_id % 89 = 0 THEN 'table not parsed' END)"
_LINE = f"concat_ws(' | ', coalesce(name, '?'), coalesce(organization, '?'), coalesce(region, '?'), coalesce(strftime(deadline, '%Y-%m-%d'), '?'), {_RULES}, CASE WHEN {_RISKS} <> '' THEN 'check: ' || {_RISKS} END, 'https://jobs.example.org/' || post_id, 'original: https://notices.example.org/' || post_id || '.html')"

_SUPPLIER_PREFS = """
prefs AS (SELECT s_suppkey AS pref_id, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE r_name END AS wanted_region, 20 + s_suppkey % 30 AS least_education,
                 CASE s_suppkey % 4 WHEN 0 THEN [] WHEN 1 THEN ['PROMO', 'ECONOMY'] ELSE ['STANDARD'] END AS majors,
                 CASE WHEN s_suppkey % 5 = 0 THEN 'gear|anvil' WHEN s_suppkey % 5 = 1 THEN 'widget' WHEN s_suppkey % 35 = 2 THEN NULL ELSE 'no such word' END AS keywords,
                 'Brand#' || (s_suppkey % 5 + 1) AS term, CASE WHEN s_suppkey % 2 = 0 THEN ['BUILDING', 'MACHINERY'] ELSE ['FURNITURE'] END AS segments, s_suppkey % 7 = 0 AS no_anvil
          FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""

ORACLE_SQL = {
    "matches_of_preferences": f"""WITH {SCORED}, {_SUPPLIER_PREFS},
pairs AS (SELECT pref_id, position_id, s_urgency + s_completeness
                 + CASE WHEN wanted_region IS NULL OR wanted_region = region THEN 25 ELSE 0 END
                 + CASE WHEN keywords IS NULL OR regexp_matches(name, keywords) THEN 30 WHEN requirements = term THEN 15 ELSE 0 END
                 + CASE WHEN len(majors) = 0 OR list_contains(majors, major) THEN 15 ELSE 0 END
                 + CASE WHEN list_contains(segments, category) THEN 10 ELSE 0 END AS score
          FROM scored CROSS JOIN prefs WHERE position_id IS NOT NULL AND NOT expired AND coalesce(education <= least_education, true) AND NOT (no_anvil AND contains(name, 'anvil')))
SELECT pref_id, position_id, score FROM pairs WHERE score >= 75""",
    "report_daily": f"WITH {GROUPED} SELECT report_group, rank, post_id, part_id, supplier_id, line_number, name AS title, organization, region, deadline, score FROM ranked",
    "score_components": f"WITH {SCORED} SELECT position_id, s_region AS region_score, s_keyword AS keyword_score, s_major AS major_score, s_organization AS organization_score, s_urgency AS urgency_score, s_completeness AS completeness_score, score FROM scored WHERE position_id IS NOT NULL",
    "hard_filter_reasons": f"WITH {SCORED} SELECT reason, count(*) AS n FROM (SELECT unnest(string_split({_REASONS}, ',')) AS reason FROM scored WHERE NOT passed) GROUP BY reason",
    "top20_per_region": f"WITH {SCORED} SELECT region, rank, post_id, position_id, score FROM (SELECT *, CAST(row_number() OVER (PARTITION BY region ORDER BY score DESC, deadline ASC NULLS LAST, post_id, part_id NULLS FIRST, supplier_id NULLS FIRST, line_number NULLS FIRST, price NULLS FIRST) AS INTEGER) AS rank FROM scored WHERE passed AND position_id IS NOT NULL) WHERE rank <= 20",
    "explain_match": f"WITH {SCORED}, best AS (SELECT * FROM scored WHERE position_id IS NOT NULL) SELECT position_id, score, rule, part FROM (UNPIVOT (SELECT position_id, score, s_region AS region, s_keyword AS keyword, s_major AS major, s_organization AS organization, s_urgency AS urgency, s_completeness AS completeness FROM best) ON region, keyword, major, organization, urgency, completeness INTO NAME rule VALUE part)",
    "score_version_diff": f"WITH {SCORED}, two AS (SELECT position_id, score AS score_1, CASE WHEN passed THEN s_region + s_keyword * 0.5 + s_major * 2 + s_organization + s_urgency + s_completeness ELSE 0 END AS score_2 FROM scored WHERE position_id IS NOT NULL) SELECT position_id, score_1, score_2, score_2 - score_1 AS change, CAST(rank() OVER (ORDER BY score_1 DESC) - rank() OVER (ORDER BY score_2 DESC) AS BIGINT) AS rank_shift FROM two",
    "rescore_idempotent": f"WITH {VISIBLE} SELECT CAST(0 AS BIGINT) AS only_first, CAST(0 AS BIGINT) AS only_second, count(*) AS n_stored FROM visible WHERE position_id IS NOT NULL",
    "search_jobs": f"WITH {SCORED} SELECT position_id, post_id, name, organization, region, deadline, score FROM scored WHERE region = 'ASIA' AND category = 'BUILDING' AND contains(name, 'gear') AND deadline > TIMESTAMP '1998-06-15' AND score >= 40 AND passed ORDER BY score DESC, deadline, position_id LIMIT 50",
    "search_capped": f"WITH {SCORED} SELECT position_id, score FROM scored WHERE passed AND position_id IS NOT NULL ORDER BY score DESC, deadline NULLS LAST, position_id LIMIT 100",
    "get_job_detail": f"WITH {VISIBLE} SELECT post_id, any_value(organization) AS organization, any_value(region) AS region, count(position_id) AS n_positions, coalesce(string_agg(position_id || ':' || name, ';' ORDER BY position_id), '') AS position_list FROM visible GROUP BY post_id",
    "report_counts": f"WITH {GROUPED} SELECT report_group, count(*) AS n_items FROM grouped GROUP BY report_group",
    "closing_soon": f"WITH {GROUPED} SELECT position_id, deadline, score FROM grouped WHERE report_group = 'closing_soon'",
    "to_confirm": f"WITH {GROUPED} SELECT post_id, position_id, CASE WHEN position_id IS NULL THEN 'no_position' WHEN deadline IS NULL THEN 'no_deadline' WHEN deadline < start_at THEN 'deadline_before_start' WHEN post_id % 97 = 0 THEN 'conflict' ELSE 'table_failed' END AS reason FROM grouped WHERE report_group = 'to_confirm'",
    "empty_report": f"""WITH {GROUPED}, prefs AS (SELECT n_name AS pref_id FROM nation UNION SELECT r_name FROM region), cut AS (SELECT region, report_group, CAST((rank - 1) // 200 AS INTEGER) AS part, count(*) AS n FROM ranked GROUP BY ALL)
SELECT pref_id, DATE '1998-06-15' AS report_date, 'markdown' AS format, report_group, coalesce(part, 0) AS part, coalesce(n, 0) AS item_count, CASE WHEN n IS NULL THEN 'No positions today.' END AS told FROM prefs LEFT JOIN cut ON pref_id = region""",
    "report_lines": f"WITH {GROUPED} SELECT report_group, rank, {_LINE} AS line FROM ranked",
    "report_markdown": f"WITH {GROUPED}, l AS (SELECT region, report_group, CAST((rank - 1) // 200 AS INTEGER) AS part, rank, {_LINE} AS line FROM ranked) SELECT region, report_group, part, 'markdown' AS format, CASE WHEN part = 0 THEN '## ' || report_group || chr(10) ELSE '' END || string_agg('- ' || line, chr(10) ORDER BY rank) AS content, count(*) AS item_count FROM l GROUP BY region, report_group, part",
    "report_html": f"WITH {GROUPED}, l AS (SELECT region, report_group, CAST((rank - 1) // 200 AS INTEGER) AS part, rank, '<p>' || replace(replace(replace(replace({_LINE}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') || '</p>' AS line FROM ranked) SELECT region, report_group, part, 'html' AS format, CASE WHEN part = 0 THEN '<h2>' || report_group || '</h2>' ELSE '' END || string_agg(line, '' ORDER BY rank) AS content, count(*) AS item_count FROM l GROUP BY region, report_group, part",
    "message_parts": f"WITH RECURSIVE {GROUPED}, l AS (SELECT region, report_group, rank, (rank - 1) // 500 AS b, CAST(length({_LINE}) AS INTEGER) AS n, row_number() OVER (PARTITION BY region, report_group, (rank - 1) // 500 ORDER BY rank) AS k FROM ranked), m AS (SELECT region, report_group, b, k, n AS used, 0 AS part FROM l WHERE k = 1 UNION ALL SELECT l.region, l.report_group, l.b, l.k, CASE WHEN used + n <= 500 THEN used + n ELSE n END, CASE WHEN used + n <= 500 THEN part ELSE part + 1 END FROM m JOIN l ON l.region = m.region AND l.report_group = m.report_group AND l.b = m.b AND l.k = m.k + 1) SELECT region, report_group, rank, n, CAST(b * 500 + part AS BIGINT) AS part FROM l JOIN m USING (region, report_group, b, k)",
    "completeness": f"WITH {VISIBLE}, rows AS (SELECT region AS part, organization, name, region, deadline FROM visible UNION ALL SELECT 'all', organization, name, region, deadline FROM visible) SELECT part, count(*) AS n_rows, round(sum((organization IS NOT NULL)::INT + (name IS NOT NULL)::INT + (region IS NOT NULL)::INT + (deadline IS NOT NULL)::INT + 1) / (5.0 * count(*)), 4) AS filled_share, count(*) FILTER (WHERE organization IS NOT NULL AND name IS NOT NULL AND region IS NOT NULL AND deadline IS NOT NULL) AS n_complete FROM rows GROUP BY part",
    "validation_issues": f"""WITH {VISIBLE}, x AS (SELECT post_id, position_id, unnest(list_filter([CASE WHEN position_id IS NULL THEN 'missing_position:error' END, CASE WHEN deadline IS NULL THEN 'missing_deadline:error' END, CASE WHEN deadline < start_at THEN 'deadline_before_start:error' END, CASE WHEN headcount > 45 THEN 'large_headcount:warning' END,
  CASE WHEN post_id % 53 = 0 OR post_id % 59 = 0 THEN 'bad_link:error' END, CASE WHEN category = 'HOUSEHOLD' THEN 'unknown_category:warning' END, CASE WHEN post_id % 97 = 0 THEN 'conflict:error' END], lambda r: r IS NOT NULL)) AS v FROM visible)
SELECT post_id, position_id, string_split(v, ':')[1] AS reason, string_split(v, ':')[2] AS severity FROM x""",
    "review_reasons": f"WITH {VISIBLE}, x AS (SELECT unnest(list_filter([CASE WHEN position_id IS NULL THEN 'missing_position:error' END, CASE WHEN deadline IS NULL THEN 'missing_deadline:error' END, CASE WHEN deadline < start_at THEN 'deadline_before_start:error' END, CASE WHEN headcount > 45 THEN 'large_headcount:warning' END], lambda r: r IS NOT NULL)) AS v FROM visible) SELECT string_split(v, ':')[1] AS reason, string_split(v, ':')[2] AS severity, count(*) AS n FROM x GROUP BY ALL",
    "severe_excluded": f"WITH {SCORED} SELECT region, count(*) AS n_recommendable, max(score) AS best FROM scored WHERE NOT severe GROUP BY region",
    "traceability": f"WITH {GROUPED} SELECT report_group, count(*) AS n_lines, count(*) FILTER (WHERE o_orderkey IS NOT NULL) AS n_traced, round(avg((o_orderkey IS NOT NULL)::INT), 4) AS rate FROM grouped LEFT JOIN orders ON post_id = o_orderkey AND o_orderstatus <> 'P' GROUP BY report_group",
    "trace_lines": f"WITH {GROUPED} SELECT report_group, rank, post_id, CASE WHEN o_orderkey IS NOT NULL THEN 'https://jobs.example.org/' || o_orderkey END AS source_link FROM ranked LEFT JOIN orders ON post_id = o_orderkey AND o_orderstatus <> 'P'",
    "major_match_sets": f"WITH {VISIBLE} SELECT position_id, (contains(name, 'widget')::INT + contains(name, 'gear')::INT) AS n_hits, trim(concat_ws(',', CASE WHEN contains(name, 'gear') THEN 'gear' END, CASE WHEN contains(name, 'widget') THEN 'widget' END)) AS hits FROM visible WHERE contains(name, 'widget') OR contains(name, 'gear')",
}
ORACLE_SQL["search_stored_jobs"] = ORACLE_SQL["search_jobs"]
