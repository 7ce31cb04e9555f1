"""Query services: search, detail, tracing; keyword arguments become pushed-down filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_RESULTS = 200


def cap_rows(df: DataFrame, n: int, max_results: int = MAX_RESULTS) -> DataFrame:
    return df.limit(min(n, max_results))


def search_jobs(rows: DataFrame, *, region: str | None = None, category: str | None = None, keyword: str | None = None, open_at: Column | None = None, min_score: float | None = None, n: int = 50, max_results: int = MAX_RESULTS) -> DataFrame:
    """Scored positions that pass every given filter, best first."""
    tests = {"region": region, "category": category}
    for column, value in tests.items():
        if value is not None:
            rows = rows.where(F.col(column) == value)
    if keyword is not None:
        rows = rows.where(F.contains("name", F.lit(keyword)))
    if open_at is not None:
        rows = rows.where(F.col("deadline") > open_at)
    if min_score is not None:
        rows = rows.where(F.col("score") >= min_score)
    return cap_rows(rows.orderBy(F.desc("score"), F.asc_nulls_last("deadline"), "position_id"), n, max_results)


def search_stored(spark: SparkSession, path: str, pref_id: int, version: str, **filters) -> DataFrame:
    """search_jobs() over the stored matches of a preference and version: a read of their partition with the filters pushed down, without any scoring."""
    stored = spark.read.option("basePath", path).parquet(path).where((F.col("pref_id") == pref_id) & (F.col("score_version") == version))
    return search_jobs(stored, **filters)


def get_job_detail(posts: DataFrame, positions: DataFrame, evidence: DataFrame | None = None, attachments: DataFrame | None = None, post_id: Column | None = None) -> DataFrame:
    """One row per post with its positions, evidence and attachments as sorted arrays; each child is aggregated before the join."""
    if post_id is not None:
        posts, positions = posts.where(F.col("post_id") == post_id), positions.where(F.col("post_id") == post_id)
    out = posts
    for name, child in (("positions", positions), ("evidence", evidence), ("attachments", attachments)):
        if child is not None:
            rows = F.struct(*(c for c in child.columns if c != "post_id"))
            out = out.join(child.groupBy("post_id").agg(F.array_sort(F.collect_list(rows)).alias(name)), "post_id", "left")
    return out


def trace_lines(lines: DataFrame, documents: DataFrame, key: str) -> DataFrame:
    """Report lines with the link of their original; null is a gap."""
    return lines.join(documents.select(key, "source_link"), key, "left")


def traceability(traced: DataFrame, by: list[str]) -> DataFrame:
    found = F.col("source_link").isNotNull()
    return traced.groupBy(*by).agg(F.count(F.lit(1)).alias("n_lines"), F.count_if(found).alias("n_traced"), F.round(F.avg(found.cast("int")), 4).alias("rate"))


def keyword_hits(positions: DataFrame, keywords: list[str]) -> DataFrame:
    """position_id, the keywords in the name, and how many."""
    hits = F.filter(F.array(*map(F.lit, sorted(keywords))), lambda k: F.contains(F.col("name"), k))
    return positions.select("position_id", hits.alias("hits")).where(F.size("hits") > 0).withColumn("n_hits", F.size("hits"))
