"""Which pages are new, changed or repeated: canonical keys, fingerprints, versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noticeforge.functions.text import fingerprint
from noticeforge.functions.urls import canonical_url, hrefs, is_attachment, with_canonical, with_resolved

KEY = ["source_id", "canonical_url"]


def keyed(pages: DataFrame, url: str = "url", body: str = "html") -> DataFrame:
    """pages with canonical_url and content_hash."""
    return pages.withColumn("canonical_url", canonical_url(F.col(url))).withColumn("content_hash", fingerprint(F.col(body)))


def unique_documents(docs: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key, by an order that breaks all ties."""
    return docs.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("_n") == 1).drop("_n")


def new_urls(batch: DataFrame, store: DataFrame, key: list[str] = KEY) -> DataFrame:
    """Rows of the batch whose key the store lacks; only keys of the store are shuffled."""
    return batch.join(store.select(*key).distinct(), key, "left_anti")


def changed_pages(batch: DataFrame, current: DataFrame, key: list[str] = KEY) -> DataFrame:
    """Rows of the batch whose stored current hash is another."""
    known = current.select(*key, F.col("content_hash").alias("current_hash"))
    return batch.join(known, key).where(F.col("content_hash") != F.col("current_hash"))


def skip_unmodified(candidates: DataFrame, last_fetch: DataFrame, key: list[str], tags: list[str]) -> DataFrame:
    """Candidates that must be fetched: never seen, or with a tag that differs (null equals null)."""
    seen = last_fetch.select(*key, *(F.col(t).alias(f"last_{t}") for t in tags), F.lit(True).alias("_seen"))
    same = F.lit(True)
    for t in tags:
        same = same & F.col(t).eqNullSafe(F.col(f"last_{t}"))
    return candidates.join(seen, key, "left").where(F.col("_seen").isNull() | ~same).drop("_seen", *(f"last_{t}" for t in tags))


def current_versions(docs: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The latest version of each key; order: latest first."""
    return unique_documents(docs, key, order)


def version_history(docs: DataFrame, key: list[str], order: list[Column], hash_col: str = "content_hash", chunk: Column | None = None) -> DataFrame:
    """docs with version (counted from 1, one more at each changed hash) and changed. A null hash is a change, as is the row after it.

    chunk: something of a row that never falls along the order, such as its month. With it a key may hold most rows: those of each chunk are
    counted by themselves, and what the chunks before end with and count, from a small table, is added.
    """
    if chunk is None:
        w = Window.partitionBy(*key).orderBy(*order)
        changed = F.lag(hash_col).over(w).isNull() | F.coalesce(F.lag(hash_col).over(w) != F.col(hash_col), F.lit(True))
        return docs.withColumn("changed", changed).withColumn("version", F.sum(F.col("changed").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    w = Window.partitionBy(*key, "_chunk").orderBy(*order)
    rows = docs.withColumn("_chunk", chunk).withColumns({"_number": F.row_number().over(w), "_lag": F.lag(hash_col).over(w)})
    differs = F.col("_lag").isNull() | F.coalesce(F.col("_lag") != F.col(hash_col), F.lit(True))
    rows = rows.withColumn("_changed", (F.col("_number") > 1) & differs)
    ends = rows.groupBy(*key, "_chunk").agg(F.max_by(F.struct(hash_col), "_number").alias("_last"), F.min_by(F.struct(hash_col), "_number").alias("_first"), F.sum(F.col("_changed").cast("int")).alias("_inside"))
    along = Window.partitionBy(*key).orderBy(F.asc_nulls_first("_chunk"))
    before = F.lag(F.col("_last")[hash_col]).over(along)
    opens = before.isNull() | F.coalesce(before != F.col("_first")[hash_col], F.lit(True))
    counted = ends.withColumn("_opens", opens).withColumn("_before", F.coalesce(F.sum(F.col("_inside") + F.col("_opens").cast("int")).over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    names = [*key, "_chunk"]
    small = counted.select(*(F.col(c).alias(f"_of_{c}") for c in names), "_opens", "_before")
    same = F.lit(True)
    for c in names:
        same = same & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    joined = rows.join(small, same).withColumn("changed", F.when(F.col("_number") == 1, F.col("_opens")).otherwise(F.col("_changed")))
    inside = F.sum(F.col("changed").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return joined.withColumn("version", F.col("_before") + inside).select(*docs.columns, "changed", "version")


def duplicate_flags(docs: DataFrame, order: list[Column], source: str = "source_id", keys: tuple[str, ...] = ("canonical_url", "content_hash")) -> DataFrame:
    """docs with duplicate: an earlier row of its source has one of its keys."""
    flags = [F.row_number().over(Window.partitionBy(source, k).orderBy(*order)) > 1 for k in keys]
    out = docs
    for k, flag in zip(keys, flags):
        out = out.withColumn(f"_again_{k}", flag & F.col(k).isNotNull())
    again = F.lit(False)
    for k in keys:
        again = again | F.col(f"_again_{k}")
    return out.withColumn("duplicate", again).drop(*(f"_again_{k}" for k in keys))


def repeats(docs: DataFrame, column: str) -> DataFrame:
    return docs.groupBy(column).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def same_store(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: how many rows only one of two stores has; zeros if a run changed nothing."""
    of = lambda df, n: df.select(*before.columns, F.lit(n).cast("long").alias("_n"))
    surplus = of(before, 1).union(of(after, -1)).groupBy(*before.columns).agg(F.sum("_n").alias("_n"))
    only = lambda n: F.coalesce(F.sum(F.greatest(n, F.lit(0))), F.lit(0)).cast("long")
    return surplus.agg(only(F.col("_n")).alias("only_first"), only(-F.col("_n")).alias("only_second"))


def first_seen(docs: DataFrame, key: list[str], at: str) -> DataFrame:
    return docs.groupBy(*key).agg(F.min(at).alias("first_seen"))


def distinct_counts(df: DataFrame, columns: list[str], exact: bool = True) -> DataFrame:
    count = F.count_distinct if exact else F.approx_count_distinct
    return df.agg(*(count(F.col(c)).alias(f"n_{c}") for c in columns))


def discover_links(pages: DataFrame, keep: list[str]) -> DataFrame:
    """One row per link to a web page: keep, position, href, link (resolved and canonical)."""
    links = pages.select(*keep, "url", F.posexplode(hrefs(F.col("html"))).alias("position", "href"))
    found = with_resolved(links, "href", "url", "_link").where(F.col("_link").isNotNull())
    return with_canonical(found, F.col("_link"), "link").drop("url", "_link")


def attachment_links(links: DataFrame) -> DataFrame:
    return links.where(is_attachment(F.col("link")))


def drop_boilerplate(docs: DataFrame, min_docs: int, text: str = "raw_text") -> DataFrame:
    """docs without the lines that stand in at least min_docs documents of their source."""
    numbered = docs.select("document_id", "source_id", F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    common = boilerplate_lines(docs, min_docs, text).select("source_id", "line_hash")
    kept = numbered.withColumn("line_hash", F.sha2("line", 256)).join(common, ["source_id", "line_hash"], "left_anti")
    clean = kept.groupBy("document_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("clean_text"))
    return docs.join(clean, "document_id", "left").withColumn("clean_text", F.coalesce("clean_text", F.lit("")))


def boilerplate_lines(docs: DataFrame, min_docs: int, text: str = "raw_text") -> DataFrame:
    """source_id, line_hash and n_docs of lines that stand in at least min_docs documents of a source."""
    lines = docs.select("document_id", "source_id", F.explode(F.array_distinct(F.split(text, "\n"))).alias("line")).where(F.trim("line") != "")
    return lines.groupBy("source_id", F.sha2("line", 256).alias("line_hash")).agg(F.count(F.lit(1)).alias("n_docs")).where(F.col("n_docs") >= min_docs)
