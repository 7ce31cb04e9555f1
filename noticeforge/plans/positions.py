"""Queries on positions, scores and reports over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeforge import bindings as B
from noticeforge.operators import evaluation, pairing, quality, reporting, scoring, search, validate
from noticeforge.operators.identity import same_store
from noticeforge.sources.folders import work_folder


def _as_of() -> Column:
    return B.at(B.AS_OF)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.score_positions(B.visible(spark, sf_dir), B.prefs(spark), _as_of())


def _known(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.score_positions(B.known(spark, sf_dir), B.prefs(spark), _as_of())


def grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reporting.report_groups(_known(spark, sf_dir), _as_of(), B.TIE_BREAKS)


def unranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reporting.in_groups(_known(spark, sf_dir), _as_of())


def report_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouped(spark, sf_dir).select("report_group", "rank", "post_id", "part_id", "supplier_id", "line_number", F.col("name").alias("title"), "organization", "region", "deadline", "score")


def score_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [F.col(f"part_{rule}").alias(f"{rule}_score") for rule in scoring.WEIGHTS]
    return scored(spark, sf_dir).where(F.col("position_id").isNotNull()).select("position_id", *parts, "score")


def supplier_prefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as preferences: of their region or of none, with keywords, terms and exclusions by their number; some name next to nothing."""
    placed = B.table(spark, sf_dir, "supplier").join(B.table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(B.table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    k = F.col("s_suppkey")
    words = lambda *w: F.array(*map(F.lit, w)).cast("array<string>")
    return placed.select(
        k.alias("pref_id"),
        F.when(k % 3 == 0, words()).otherwise(F.array("r_name")).alias("regions"),
        (20 + k % 30).cast("int").alias("education"),
        F.when(k % 4 == 0, words()).when(k % 4 == 1, words("PROMO", "ECONOMY")).otherwise(words("STANDARD")).alias("majors"),
        F.when(k % 5 == 0, words("Gear", "anvil")).when(k % 5 == 1, words("widget")).when(k % 35 == 2, words()).otherwise(words("no such word")).alias("job_keywords"),
        F.array(F.concat(F.lit("Brand#"), (k % 5 + 1).cast("string"))).alias("requirement_terms"),
        F.when(k % 2 == 0, words("BUILDING", "MACHINERY")).otherwise(words("FURNITURE")).alias("organization_types"),
        F.when(k % 7 == 0, words("anvil")).otherwise(words()).alias("exclusions"),
    )


def matches_of_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each preference wants with a score of 75 or more, without making all pairs."""
    positions = B.open_positions(spark, sf_dir).select("position_id", *pairing.READS)
    return pairing.score_matches(positions, supplier_prefs(spark, sf_dir), _as_of(), 75.0).select("pref_id", "position_id", "score")


def hard_filter_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = scoring.hard_filter(scoring.with_prefs(B.visible(spark, sf_dir), B.prefs(spark)), _as_of())
    return pairs.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def top20_per_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(spark, sf_dir).where(F.col("passed") & F.col("position_id").isNotNull())
    return reporting.top_n(rows, ["region"], 20, B.TIE_BREAKS).select("region", "rank", "post_id", "position_id", "score")


def explain_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.explain_match(scoring.match_results(scored(spark, sf_dir))).select("position_id", "score", "rule", "part")


def score_version_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    other = scoring.WEIGHTS | {"keyword": 15.0, "major": 30.0}
    both = scoring.compared_scores(B.visible(spark, sf_dir), B.prefs(spark), _as_of(), scoring.WEIGHTS, other)
    return evaluation.compare_scores(both.where(F.col("position_id").isNotNull()))


def rescore_idempotent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of results that was scored twice against one that was scored once."""
    folder = work_folder(spark)
    for name in ("twice", "once", "twice"):
        scoring.rescore(spark, B.visible(spark, sf_dir), B.prefs(spark), _as_of(), "1", f"{folder}/{name}")
    stored = lambda name: spark.read.parquet(f"{folder}/{name}").select("position_id", "pref_id", "score", "score_version", F.array_join("matched_rules", "+").alias("rules"))
    return same_store(stored("twice"), stored("once")).withColumn("n_stored", F.lit(stored("twice").count()))


def search_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(spark, sf_dir).where(F.col("passed"))
    return search.search_jobs(rows, region="ASIA", category="BUILDING", keyword="gear", open_at=_as_of(), min_score=40).select("position_id", "post_id", "name", "organization", "region", "deadline", "score")


def search_stored_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same search over matches that were stored before."""
    path = work_folder(spark)
    scoring.store_matches(scored(spark, sf_dir), path)
    found = search.search_stored(spark, path, 1, "1", region="ASIA", category="BUILDING", keyword="gear", open_at=_as_of(), min_score=40)
    return found.select("position_id", "post_id", "name", "organization", "region", "deadline", "score")


def search_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(spark, sf_dir).where(F.col("passed") & F.col("position_id").isNotNull())
    return search.search_jobs(rows, n=5000, max_results=100).select("position_id", "score")


def get_job_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    posts = B.posts(spark, sf_dir).where(F.col("start_at") <= _as_of())
    detail = search.get_job_detail(posts, B.positions(spark, sf_dir).select("post_id", "position_id", "name"))
    listed = F.array_join(F.transform("positions", lambda x: F.concat(x["position_id"], F.lit(":"), x["name"])), ";")
    return detail.select("post_id", "organization", "region", F.coalesce(F.size("positions"), F.lit(0)).cast("long").alias("n_positions"), F.coalesce(listed, F.lit("")).alias("position_list"))


def report_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reporting.report_counts(unranked(spark, sf_dir)).select("report_group", "n_items")


def closing_soon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unranked(spark, sf_dir).where(F.col("report_group") == "closing_soon").select("position_id", "deadline", "score")


def to_confirm(spark: SparkSession, sf_dir: str) -> DataFrame:
    reason = F.when(F.col("position_id").isNull(), "no_position").when(F.col("deadline").isNull(), "no_deadline").when(F.col("deadline") < F.col("start_at"), "deadline_before_start").when(F.col("conflict"), "conflict").otherwise("table_failed")
    return unranked(spark, sf_dir).where(F.col("report_group") == "to_confirm").select("post_id", "position_id", reason.alias("reason"))


def empty_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of each nation, read as a preference for the region of its name: most have no line, and say so."""
    day = F.to_date(_as_of())
    prefs = B.table(spark, sf_dir, "nation").select(F.col("n_name").alias("pref_id")).unionByName(B.table(spark, sf_dir, "region").select(F.col("r_name").alias("pref_id")))
    rendered = reporting.render_report(_by_region(spark, sf_dir).withColumnRenamed("region", "pref_id"), "markdown", ["pref_id"], 200).withColumn("report_date", day)
    whole = reporting.report_spine(prefs, spark.range(1).select(day.alias("report_date")), rendered, ("markdown",))
    return whole.select("pref_id", "report_date", "format", "report_group", "part", "item_count", F.when(F.col("item_count") == 0, F.col("content")).alias("told"))


def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reporting.report_lines(grouped(spark, sf_dir), F.col("link"), F.col("original")).drop("pref_id")


def _by_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report lines with a region in place of the preference."""
    return reporting.report_lines(grouped(spark, sf_dir).withColumn("pref_id", F.col("region")), F.col("link"), F.col("original")).withColumnRenamed("pref_id", "region")


def report_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reporting.render_report(_by_region(spark, sf_dir), "markdown", ["region"], 200)


def report_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reporting.render_report(_by_region(spark, sf_dir), "html", ["region"], 200)


def message_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _by_region(spark, sf_dir).withColumn("n", F.length("line")).drop("line")
    return reporting.message_parts(lines, 500, ["region", "report_group"], "n").select("region", "report_group", "rank", "n", "part")


def completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.visible(spark, sf_dir).withColumn("title", F.col("name"))
    found = quality.completeness(rows, ["organization", "name", "region", "deadline", "link"], "region")
    return found.select(F.coalesce("region_key", F.lit("all")).alias("part"), "n_rows", "filled_share", "n_complete")


def _checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.validate(B.visible(spark, sf_dir), validate.time_and_presence_rules(), ["post_id", "position_id"])


def validation_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rules, over posts of which some have a link that is none."""
    rows = B.known(spark, sf_dir).withColumn("link", F.when(F.col("post_id") % 53 == 0, F.concat(F.lit("javascript:open("), F.col("post_id").cast("string"), F.lit(")"))).when(F.col("post_id") % 59 != 0, F.col("link")))
    rules = validate.time_and_presence_rules() | validate.post_rules(["BUILDING", "MACHINERY", "FURNITURE", "AUTOMOBILE"])
    return validate.validate(rows, rules, ["post_id", "position_id"])


def review_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.review_reasons(_checks(spark, sf_dir))


def severe_excluded(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(spark, sf_dir).where(F.col("position_id").isNotNull())
    kept = scoring.recommendable(rows, _checks(spark, sf_dir).where(F.col("position_id").isNotNull()))
    return kept.groupBy("region").agg(F.count(F.lit(1)).alias("n_recommendable"), F.max("score").alias("best"))


def _traced(rows: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    originals = B.table(spark, sf_dir, "orders").where(F.col("o_orderstatus") != "P").select(F.col("o_orderkey").alias("post_id"), F.concat(F.lit("https://jobs.example.org/"), F.col("o_orderkey").cast("string")).alias("source_link"))
    return search.trace_lines(rows, originals, "post_id")


def traceability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.traceability(_traced(unranked(spark, sf_dir).select("report_group", "post_id"), spark, sf_dir), ["report_group"])


def trace_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _traced(grouped(spark, sf_dir).select("report_group", "rank", "post_id"), spark, sf_dir)


def major_match_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = search.keyword_hits(B.visible(spark, sf_dir).where(F.col("position_id").isNotNull()), ["widget", "gear"])
    return rows.select("position_id", "n_hits", F.array_join("hits", ",").alias("hits"))


QUERIES = {
    "report_daily": report_daily,
    "score_components": score_components,
    "matches_of_preferences": matches_of_preferences,
    "hard_filter_reasons": hard_filter_reasons,
    "top20_per_region": top20_per_region,
    "explain_match": explain_match,
    "score_version_diff": score_version_diff,
    "rescore_idempotent": rescore_idempotent,
    "search_jobs": search_jobs,
    "search_stored_jobs": search_stored_jobs,
    "search_capped": search_capped,
    "get_job_detail": get_job_detail,
    "report_counts": report_counts,
    "closing_soon": closing_soon,
    "to_confirm": to_confirm,
    "empty_report": empty_report,
    "report_lines": report_lines,
    "report_markdown": report_markdown,
    "report_html": report_html,
    "message_parts": message_parts,
    "completeness": completeness,
    "validation_issues": validation_issues,
    "review_reasons": review_reasons,
    "severe_excluded": severe_excluded,
    "traceability": traceability,
    "trace_lines": trace_lines,
    "major_match_sets": major_match_sets,
}
