from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from noticeforge import bindings as B
from noticeforge.operators import dictionary, evaluation, extract, identity, merge, quality, reporting, runs, scoring, search, tables, validate
from noticeforge.schemas import SCHEMAS

NOW = datetime(2026, 3, 1)
POSITION = "position_id string, post_id long, name string, organization string, region string, education int, major string, category string, requirements string, start_at timestamp, deadline timestamp, link string"
FULL = (1, ["R"], 3, ["M"], ["dev"], ["T"], ["O"], ["bad"], NOW)
NEUTRAL = (2, [], None, [], [], [], [], [], NOW)


def position(key="a", hours=24, **other):
    row = {"position_id": key, "post_id": 1, "name": "dev", "organization": "org", "region": "R", "education": 3, "major": "M", "category": "O", "requirements": "x", "start_at": NOW - timedelta(days=9), "deadline": None if hours is None else NOW + timedelta(hours=hours), "link": "l"}
    return tuple((row | other).values())


def score(spark, rows, prefs=(FULL,), **options):
    df = spark.createDataFrame(rows, POSITION)
    return scoring.score_positions(df, spark.createDataFrame(list(prefs), SCHEMAS["user_preferences"]), F.lit(NOW), **options)


def test_scores(spark):
    rows = [
        position("full"),
        position("term", name="other", requirements="x T y"),
        position("h71", 71), position("h72", 72), position("h73", 73), position("d8", 8 * 24), position("d15", 15 * 24),
        position("none", None), position("expired", -1), position("low", education=4), position("word", name="bad dev"), position("unknown", education=None),
        position("early", 24, start_at=NOW + timedelta(days=9)),
    ]
    got = {r.position_id: r for r in score(spark, rows).collect()}
    assert got["full"].score == 100 and got["full"].matched_rules == list(scoring.WEIGHTS)
    assert got["term"].score == 85
    assert [got[k].score for k in ("h71", "h72", "h73", "d8", "d15")] == [100, 100, 97, 94, 92]
    assert (got["none"].score, got["none"].passed) == (88, True)
    assert {k: got[k].reasons for k in ("expired", "low", "word")} == {"expired": ["expired"], "low": ["education"], "word": ["exclusion"]}
    assert got["low"].score == 0 and got["unknown"].passed and got["early"].passed
    for r in got.values():
        assert 0 <= r.score <= 100 and len(r.components) == 6


def test_empty_preferences_are_neutral(spark):
    row = score(spark, [position("a", education=9, name="bad")], [NEUTRAL]).first()
    assert row.passed and row.score == 100


def test_weights_must_sum_to_100(spark):
    with pytest.raises(ValueError):
        score(spark, [position()], weights=scoring.WEIGHTS | {"region": 1.0})


def test_versions_at_once_equal_versions_by_themselves(spark):
    rows = [position("a"), position("b", 200, region="X"), position("c", education=9), position("d", None)]
    df, prefs = spark.createDataFrame(rows, POSITION), spark.createDataFrame([FULL, NEUTRAL], SCHEMAS["user_preferences"])
    other = scoring.WEIGHTS | {"keyword": 15.0, "major": 30.0}
    both = scoring.score_versions(df, prefs, F.lit(NOW), {"1": scoring.WEIGHTS, "2": other})
    alone = [score(spark, rows, (FULL, NEUTRAL), version=v, weights=w) for v, w in (("1", scoring.WEIGHTS), ("2", other))]
    key = lambda d: sorted(map(repr, d.select(*alone[0].columns).collect()))
    assert key(both) == key(alone[0].unionByName(alone[1])) and both.count() == 16
    with pytest.raises(ValueError):
        scoring.score_versions(df, prefs, F.lit(NOW), {"1": scoring.WEIGHTS | {"region": 1.0}})


def test_rescore_replaces_only_its_partition(spark, folder):
    df = spark.createDataFrame([position("a"), position("b", 200)], POSITION)
    one, two = (spark.createDataFrame([p], SCHEMAS["user_preferences"]) for p in (FULL, NEUTRAL))
    for prefs, version in ((one, "1"), (two, "1"), (one, "2"), (one, "1")):
        scoring.rescore(spark, df, prefs, F.lit(NOW), version, f"{folder}/m")
    stored = spark.read.parquet(f"{folder}/m")
    assert stored.count() == 6 and stored.select("pref_id", "score_version").distinct().count() == 3
    assert scoring.explain_match(stored, F.lit("a")).where("pref_id = 1 and score_version = 1").count() == 6


def test_report_groups_order_and_texts(spark, folder):
    rows = [position("close", 10), position("prio", 500), position("new", 900, region="X", major="X", category="X", name="y<&>", start_at=NOW), position("confirm", None), position("bad", 5, start_at=NOW + timedelta(days=3)), position("dull", 900, region="X", major="X", category="X", name="y")]
    scored = score(spark, rows)
    grouped = reporting.report_groups(scored, F.lit(NOW), ["position_id"])
    assert {r.position_id: r.report_group for r in grouped.collect()} == {"close": "closing_soon", "prio": "priority", "new": "new_today", "confirm": "to_confirm", "bad": "to_confirm"}
    prefs = spark.createDataFrame([FULL, NEUTRAL], SCHEMAS["user_preferences"])
    for _ in range(2):
        reporting.generate_report(scored, prefs, F.lit("2026-03-01").cast("date"), F.lit(NOW), ["position_id"], f"{folder}/r", F.col("link"))
    reporting.generate_report(scored, prefs, F.lit("2026-03-02").cast("date"), F.lit(NOW), ["position_id"], f"{folder}/r", F.col("link"))
    stored = spark.read.parquet(f"{folder}/r")
    assert stored.count() == 2 * (2 * 4 + 2)  # four groups of one preference, one line for the other's empty report
    text = {(r.pref_id, r.format, r.report_group): r for r in stored.where("report_date = '2026-03-01'").collect()}
    assert text[2, "markdown", None].content == "No positions today." and sum(r.item_count for k, r in text.items() if k[:2] == (1, "markdown")) == 5
    assert text[1, "markdown", "to_confirm"].content.startswith("## to_confirm\n- ") and "y<&>" in text[1, "markdown", "new_today"].content
    assert "y&lt;&amp;&gt;" in text[1, "html", "new_today"].content
    lines = spark.createDataFrame([(1, "priority", k, f"line {k}") for k in range(1, 8)], "pref_id long, report_group string, rank int, line string")
    parts = reporting.render_report(lines, "markdown", ["pref_id"], 3).orderBy("part").collect()
    assert [r.item_count for r in parts] == [3, 3, 1] and parts[0].content == "## priority\n- line 1\n- line 2\n- line 3" and parts[2].content == "- line 7"


def test_groups_by_discovery_conflict_and_failed_tables(spark):
    """What was first seen today is new whenever it starts; fields in conflict and tables that failed are to be confirmed, before anything else."""
    far = {"region": "X", "major": "X", "category": "X", "name": "clerk"}
    rows = [
        position("old start", 900, post_id=1, **far), position("new", 900, post_id=2, start_at=NOW - timedelta(days=30), **far), position("again", 900, post_id=3, start_at=NOW, **far),
        position("conflict", 24, post_id=4), position("table", 500, post_id=5), position("close", 24, post_id=6), position("prio", 500, post_id=7), position("rejected", 24, post_id=4, name="bad dev"),
    ]
    posts = spark.createDataFrame(rows, POSITION)
    day = timedelta(days=1)
    fetched = spark.createDataFrame([(1, NOW - day), (2, NOW), (2, NOW + day), (3, NOW - 9 * day), (3, NOW), (4, NOW), (5, NOW), (6, NOW), (7, NOW)], "post_id long, fetched_at timestamp")
    candidates = spark.createDataFrame([(4, "deadline", "rule", "a"), (4, "deadline", "table", "b"), (6, "deadline", "rule", "a"), (6, "deadline", "table", None), (6, "deadline", "llm", "a"), (4, "title", "rule", "x")], "entity_id long, field_name string, source_type string, norm_value string")
    conflicts = merge.conflicts(candidates)
    assert [tuple(r) for r in conflicts.collect()] == [(4, "deadline")]
    files = spark.createDataFrame([(5, "positions", "corrupt"), (6, "positions", "ok"), (7, "notice", "corrupt")], "post_id long, kind string, parse_status string")
    known = reporting.with_facts(posts, identity.first_seen(fetched, ["post_id"], "fetched_at"), conflicts.withColumnRenamed("entity_id", "post_id"), reporting.failed_tables(files))
    assert known.count() == len(rows)
    scored = scoring.score_positions(known, spark.createDataFrame([FULL], SCHEMAS["user_preferences"]), F.lit(NOW))
    grouped = reporting.report_groups(scored, F.lit(NOW), ["position_id"])
    assert {r.position_id: r.report_group for r in grouped.collect()} == {"new": "new_today", "conflict": "to_confirm", "table": "to_confirm", "close": "closing_soon", "prio": "priority"}
    lines = {r.line.split(" | ")[-1]: r.line for r in reporting.report_lines(grouped, F.col("link"), F.concat(F.lit("o"), F.col("post_id").cast("string"))).collect()}
    assert " | check: fields in conflict | l | " in lines["original: o4"] and "table not parsed | l" in lines["original: o5"] and "check" not in lines["original: o7"]


def test_all_rules_of_posts(spark):
    rows = [(1, "p", NOW, NOW, 3, "http://e.com/x", "A", False), (2, "q", NOW, None, 99, "javascript:x", "Z", True), (3, None, NOW, NOW - timedelta(1), None, None, None, None)]
    df = spark.createDataFrame(rows, "post_id long, position_id string, start_at timestamp, deadline timestamp, headcount int, link string, category string, conflict boolean")
    found = validate.validate(df, validate.time_and_presence_rules() | validate.post_rules(["A", "B"]), ["post_id"])
    assert sorted(tuple(r) for r in found.collect()) == [
        (2, "bad_link", "error"), (2, "conflict", "error"), (2, "large_headcount", "warning"), (2, "missing_deadline", "error"), (2, "unknown_category", "warning"),
        (3, "bad_link", "error"), (3, "deadline_before_start", "error"), (3, "missing_position", "error"),
    ]


def test_search_over_stored_matches(spark, folder):
    """The same rows as a search over scores; the plan reads one partition with its filters, and joins nothing."""
    rows = [position(f"p{k}", 24 * (k % 40 - 5), region="RST"[k % 3], name="dev" if k % 2 else "clerk", education=k % 5) for k in range(200)]
    df, prefs = spark.createDataFrame(rows, POSITION), spark.createDataFrame([FULL, NEUTRAL], SCHEMAS["user_preferences"])
    for version in ("1", "2"):
        scoring.store_matches(scoring.score_positions(df, prefs, F.lit(NOW), version), f"{folder}/s")
    options = {"region": "R", "keyword": "dev", "open_at": F.lit(NOW), "min_score": 50.0}
    found = search.search_stored(spark, f"{folder}/s", 1, "2", **options)
    want = search.search_jobs(scoring.score_positions(df, prefs, F.lit(NOW)).where("passed and pref_id = 1"), **options)
    key = lambda df: [(r.position_id, r.score, r.region) for r in df.collect()]
    assert key(found) == key(want) != []
    spark.conf.set("spark.sql.maxMetadataStringLength", 5000)
    plan = search.search_stored(spark, f"{folder}/s", 1, "2", **options).select("position_id", "score")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(pref_id" in plan and "EqualTo(region,R)" in plan and "GreaterThanOrEqual(score,50.0)" in plan and "StringContains(name,dev)" in plan and "Join" not in plan


def test_parse_rates_on_the_board(spark):
    runs_ = spark.createDataFrame([("a", "success", 1.0), ("b", "failed", 2.0)], "source_id string, status string, minutes double")
    flagged = spark.createDataFrame([("a", False)], "source_id string, duplicate boolean")
    filled = spark.createDataFrame([("a", 1.0)], "source_id string, filled_share double")
    files = spark.createDataFrame([("a", "ok"), ("a", "partial"), ("a", "encrypted"), ("c", "ok")], "source_id string, parse_status string")
    board = {r.source_id: (r.success_rate, r.n_readable, r.parse_rate) for r in quality.quality_board(runs_, flagged, filled, files).collect()}
    assert board == {"a": (1.0, 2, 0.5), "b": (0.0, None, None), "c": (None, 1, 1.0)}


def test_message_parts(spark):
    lines = spark.createDataFrame([(1, k + 1, n) for k, n in enumerate([5, 6, 3, 9, 2, 2, 11, 1])], "report_id long, rank int, n int")
    parts = reporting.message_parts(lines, 10, ["report_id"], "n")
    assert [r.part for r in parts.orderBy("rank").collect()] == [0, 1, 1, 2, 3, 3, 4, 5]
    parts = reporting.message_parts(lines, 10, ["report_id"], "n", block=3)
    assert [r.part for r in parts.orderBy("rank").collect()] == [0, 1, 1, 3, 4, 4, 6, 7]


def test_message_parts_read_their_lines_once(spark, folder):
    spark.createDataFrame([(1, k + 1, n, "x") for k, n in enumerate([5, 6, 3])] + [(None, 1, 4, None)], "report_id long, rank int, n int, more string").write.parquet(f"{folder}/lines")
    parts = reporting.message_parts(spark.read.parquet(f"{folder}/lines"), 10, ["report_id"], "n")
    assert parts._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    assert sorted(map(repr, map(tuple, parts.collect()))) == ["(1, 1, 5, 'x', 0)", "(1, 2, 6, 'x', 1)", "(1, 3, 3, 'x', 1)", "(None, 1, 4, None, 0)"]


def test_stores_are_compared_in_one_pass(spark):
    """Rows count as often as they stand; nulls are equal."""
    of = lambda *rows: spark.createDataFrame([*rows], "a long, b string")
    found = identity.same_store(of((1, "x"), (1, "x"), (2, None)), of((1, "x"), (2, None), (3, "z"), (3, "z")))
    assert tuple(found.first()) == (1, 2) and tuple(identity.same_store(of(), of()).first()) == (0, 0)
    assert found._jdf.queryExecution().executedPlan().toString().count("Union") == 1


def test_rescore_drops_what_comes_out_empty(spark, folder):
    df = spark.createDataFrame([position("a")], POSITION)
    prefs = spark.createDataFrame([FULL], SCHEMAS["user_preferences"])
    other = spark.createDataFrame([NEUTRAL], SCHEMAS["user_preferences"])
    scoring.rescore(spark, df, prefs, F.lit(NOW), "1", f"{folder}/e")
    scoring.rescore(spark, df, other, F.lit(NOW), "1", f"{folder}/e")
    scoring.rescore(spark, df.limit(0), prefs, F.lit(NOW), "1", f"{folder}/e")
    assert [r.pref_id for r in spark.read.parquet(f"{folder}/e").collect()] == [NEUTRAL[0]]


def test_vectors_by_brute_force(spark, monkeypatch):
    from noticeforge.operators import evaluation

    monkeypatch.setattr(evaluation, "CHUNK", 7)
    rng = np.random.default_rng(1)
    m = rng.integers(-2, 3, (90, 3)).astype(float)  # many ties
    rows = [(k, [float(v) for v in x] if k != 5 else None) for k, x in enumerate(m)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    got = evaluation.vector_topk(df.where("vec_id % 9 = 0").withColumnRenamed("vec_id", "query_id"), df, 10)
    found = {}
    for r in got.collect():
        found.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.cosine)
    for q in range(0, 90, 9):
        if not m[q].any():
            assert q not in found
            continue
        cos = sorted((-round(float(m[q] @ m[i] / np.linalg.norm(m[q]) / np.linalg.norm(m[i])), 6) + 0.0, i) for i in range(90) if i not in (5, q) and m[i].any())
        assert [found[q][k + 1][0] for k in range(10)] == [i for _, i in cos[:10]]


def test_merge_and_evidence(spark):
    rows = [
        (1, "org", "llm", "A", 0.9, 1), (1, "org", "rule", "B", 0.5, 2), (1, "org", "table", None, 1.0, 3),
        (1, "reg", "rule", "X", 0.5, 2), (1, "reg", "rule", "X", 0.5, 1), (1, "reg", "rule", None, 0.9, 0),
    ]
    got = merge.merge_fields(merge.all_candidates(spark.createDataFrame(rows, "entity_id long, field_name string, source_type string, norm_value string, confidence double, position int"))).collect()
    won = {r.field_name: (r.norm_value, r.position, r.conflict) for r in got if r.winner}
    assert won == {"org": ("B", 2, True), "reg": ("X", 1, False)} and len(got) == 6


def test_budget(spark):
    calls = spark.createDataFrame([(1, NOW, 4.0), (2, NOW, 4.0), (3, NOW, 4.0), (4, NOW + timedelta(days=1), 99.0)], "call_id long, called_at timestamp, cost double").withColumn("day", F.to_date("called_at"))
    assert {r.call_id: r.status for r in merge.admit_calls(calls, 8).collect()} == {1: "admitted", 2: "admitted", 3: "pending", 4: "admitted"}


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_budget_over_minutes_equals_a_loop(spark, kind):
    rng = np.random.default_rng(4)
    rows = [(int(k), NOW + timedelta(days=int(rng.integers(0, 3)), seconds=int(rng.integers(0, 900))) if k % 40 else None, int(c)) for k, c in zip(rng.permutation(400), rng.integers(0, 9, 400))]
    calls = spark.createDataFrame(rows, f"call_id long, called_at {kind}, cost long").withColumn("day", F.to_date("called_at"))
    spent, want = {}, {}
    for r in sorted(calls.collect(), key=lambda r: (r.called_at is not None, r.called_at or NOW, r.call_id)):
        want[r.call_id] = (spent.get(r.day, 0), "admitted" if spent.get(r.day, 0) < 300 else "pending")
        spent[r.day] = spent.get(r.day, 0) + r.cost
    got = merge.admit_calls(calls, 300)
    assert got.columns == [*calls.columns, "spent_before", "status"] and {r.call_id: (r.spent_before, r.status) for r in got.collect()} == want


@pytest.mark.parametrize("tie", ["long", "string"])
def test_ranks_over_slices_equal_one_sort(spark, tie):
    rng = np.random.default_rng(5)
    rows = [(int(p), float(s), None if d == 2 else NOW + timedelta(days=int(d)), None if t < -95 else t, k) for k, (p, s, d, t) in enumerate(zip(rng.integers(0, 2, 500), rng.integers(0, 2, 500), rng.integers(0, 3, 500), map(int, rng.integers(-100, 100, 500))))]
    df = spark.createDataFrame(rows, "pref_id int, score double, deadline timestamp, tie long, k int").withColumn("tie", F.col("tie").cast(tie))
    got = reporting.ranked(df, ["pref_id"], ["tie", "k"], ids_per_slice=7)
    assert got.columns == [*df.columns, "rank"]
    key = lambda r: (-r.score, r.deadline is None, r.deadline or NOW, r.tie is not None, r.tie or type(r.tie or 0)(), r.k)
    for p in (0, 1):
        part = [r for r in got.collect() if r.pref_id == p]
        assert [r["rank"] for r in sorted(part, key=key)] == list(range(1, len(part) + 1))


def test_strict_extraction(spark):
    bodies = ['{"k": 1}', '{"k": 1', '{"k": "x"}', '{"j": 1}', '{"k": 1, "z": 2}', '{"k": null}', None]
    got = validate.parse_extraction(spark.createDataFrame(list(enumerate(bodies)), "id int, body string"), "body", "k int", ["k"])
    assert [r.problem for r in got.orderBy("id").collect()] == [None, "malformed", "wrong_type", "missing_field", "extra_field", "missing_field", "malformed"]


def test_review_and_prefs(spark):
    checks = spark.createDataFrame([(1, "a", "error"), (2, "b", "warning")], "document_id long, reason string, severity string")
    decisions = spark.createDataFrame([(1, "a", "accepted")], "document_id long, reason string, state string")
    assert {r.document_id: r.state for r in validate.review_queue(checks, decisions, ["document_id"]).collect()} == {1: "accepted", 2: "open"}
    prefs = spark.createDataFrame([(1, ["R"]), (2, ["Q"]), (3, None)], "pref_id long, regions array<string>")
    assert {r.pref_id: r.problems for r in validate.validate_prefs(prefs, {"regions": ["R"]}).collect()} == {1: [], 2: ["regions"], 3: ["regions"]}


CELLS = [
    ("Plan", 1, 1, "2026 positions"), ("Plan", 1, 2, ""), ("Plan", 2, 1, "Unit"), ("Plan", 2, 2, "Name"), ("Plan", 2, 3, "Count"),
    ("Plan", 3, 1, "Library"), ("Plan", 3, 2, "Clerk"), ("Plan", 3, 3, "2"), ("Plan", 4, 1, ""), ("Plan", 4, 2, "Guard"), ("Plan", 4, 3, ""), ("Plan", 5, 1, ""), ("Plan", 5, 2, ""), ("Notes", 1, 1, "free text"),
]


def test_tables(spark):
    cells = spark.createDataFrame([(1, s, r, c, f"{'ABC'[c - 1]}{r}", v) for s, r, c, v in CELLS], "attachment_id long, sheet string, row int, col int, cell string, value string")
    ranges = spark.createDataFrame([(1, "Plan", 3, 1, 4, 1), (1, "Plan", 1, 1, 1, 2)], "attachment_id long, sheet string, r1 int, c1 int, r2 int, c2 int")
    filled = tables.fill_merged(cells, ranges)
    value = {(r.sheet, r.row, r.col): r.value for r in filled.collect()}
    assert value["Plan", 4, 1] == "Library" and value["Plan", 1, 2] == "2026 positions" and value["Plan", 4, 3] is None and value["Plan", 5, 1] is None
    headers = tables.header_rows(filled, ["unit", "name", "count"])
    assert {r.sheet: (r.header_row, r.state) for r in headers.collect()} == {"Plan": (2, "ok"), "Notes": (None, "review")}
    rows = {r.row: r for r in tables.cells_to_fields(filled, headers, {"Unit": "organization", "Name": "name", "Count": "headcount"}).collect()}
    assert set(rows) == {3, 4} and (rows[4].organization, rows[4].name, rows[4].headcount) == ("Library", "Guard", None)
    assert rows[3].evidence == {"organization": "A3", "name": "B3", "headcount": "C3"}


def test_regions_and_fields(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "work in New York City"), (2, "nowhere"), (3, None)], "document_id long, text string")
    regions = spark.createDataFrame([(1, "York"), (2, "New York"), (3, "City")], "region_id int, name string")
    for limit in (dictionary.BLOCK_BYTES, 3):
        monkeypatch.setattr(extract, "NAMES_BYTES", limit)
        assert {r.document_id: r.region for r in extract.match_regions(docs, regions).collect()} == {1: "New York", 2: None, 3: None}
    notice = spark.createDataFrame([(1, "招聘单位：某某大学\n招聘3人，本科，报名时间：2026年3月5日至2026年3月18日 https://e.com/x", NOW)], "document_id long, text string, published_at timestamp")
    row = extract.extract_fields(notice).first()
    assert (row.organization, row.headcount, row.education.norm, row.deadline, row.apply_url) == ("某某大学", 3, "bachelor", datetime(2026, 3, 18, 23, 59, 59), "https://e.com/x")
    assert extract.with_norm(notice, {"text": (F.col("text"), F.upper("text")), "none": (F.lit(None), F.lit("x"))}, "document_id").count() == 1
    page = extract.detail_fields(spark.createDataFrame([('<head><title>T</title></head><time datetime="2026-03-05"></time><p>b',)], "html string")).first()
    assert (page.title, page.body, page.published_at) == ("T", "b", datetime(2026, 3, 5))


def test_golden(spark):
    e = spark.createDataFrame([(1, "a", "x"), (1, "b", None), (2, "a", "x"), (3, "a", "x")], "sample_id long, field string, value string")
    a = spark.createDataFrame([(1, "a", "x"), (1, "b", None), (2, "a", "y"), (4, "a", "z")], "sample_id long, field string, value string")
    got = {r.kind: r.n for r in evaluation.golden_summary(evaluation.golden_diff(e, a, ["sample_id", "field"], ["value"])).collect()}
    assert got == {"equal": 2, "different": 1, "missing": 1, "unexpected": 1}


def test_vector_blocks_agree(spark, monkeypatch):
    vectors = B.table(spark, "/root/testdata/sf0.001", "embeddings")
    queries = vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    rows = lambda: sorted(map(tuple, evaluation.vector_topk(queries, vectors, 3).collect()))
    whole = rows()
    monkeypatch.setattr(evaluation, "QUERY_BLOCK", 2)
    assert rows() == whole and whole


def test_run_log(spark):
    log = spark.createDataFrame([(k, 1, NOW + timedelta(hours=k), NOW + timedelta(hours=k + (2 if k == 3 else 0.5)) if k < 6 else None, s) for k, s in enumerate(["success", "failed", "failed", "failed", "success", "failed", "failed"])], "run_id long, source_id long, started_at timestamp, finished_at timestamp, status string")
    s = runs.streaks(log, F.col("status") == "success").first()
    assert (s.longest_failures, s.current_failures) == (3, 2)
    assert runs.alerts(runs.streaks(log, F.col("status") == "success"), 2).count() == 1
    assert [r.run_id for r in runs.overlapping_runs(log).collect()] == [4, 5]
    assert runs.unfinished_runs(log, F.lit(NOW + timedelta(days=2)), "1 DAY").first().run_id == 6
    slots = spark.createDataFrame([(1, NOW), (1, NOW + timedelta(hours=12)), (2, NOW)], "source_id long, slot_at timestamp")
    inside = runs.slots_in_window(slots, log, "2 HOURS")
    assert inside.where("run_id is not null").count() == 2 and inside.count() == 4


@pytest.mark.parametrize("seed", range(3))
def test_score_is_monotone_in_matches(spark, seed):
    worse, better = position("w", 24 * 20, region="X"), position("b", 24 * 20)
    got = {r.position_id: r.score for r in score(spark, [worse, better]).collect()}
    assert got["b"] > got["w"]


def test_parse_success_and_search(spark):
    from noticeforge.operators import quality, search

    attachments = spark.createDataFrame([(1, "ok"), (2, "failed"), (3, "encrypted"), (4, "ocr_required"), (5, "ok")], "attachment_id long, parse_status string")
    row = quality.parse_success(attachments).first()
    assert (row.n_readable, row.parse_success) == (3, 0.6667)
    rows = score(spark, [position("a", 10), position("b", 20), position("c", None), position("d", 5, region="X")]).where("passed")
    assert [r.position_id for r in search.search_jobs(rows, region="R", n=2).collect()] == ["a", "b"]
    assert search.search_jobs(rows, n=99, max_results=3).count() == 3
    assert search.search_jobs(rows, keyword="dev", open_at=F.lit(NOW), min_score=90).count() == 2
    posts = spark.createDataFrame([(1, "o"), (2, "p")], "post_id long, organization string")
    evidence = spark.createDataFrame([(1, "deadline", "q")], "post_id long, field_name string, quote string")
    detail = {r.post_id: r for r in search.get_job_detail(posts, rows.select("post_id", "position_id"), evidence).collect()}
    assert len(detail[1].positions) == 4 and detail[1].evidence[0].quote == "q" and detail[2].positions is None
    assert search.get_job_detail(posts, rows.select("post_id", "position_id"), post_id=F.lit(2)).count() == 1
