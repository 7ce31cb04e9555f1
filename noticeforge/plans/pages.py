"""Queries on pages and documents over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeforge import bindings as B
from noticeforge.functions import text, urls
from noticeforge.operators import evaluation, identity, quality, reporting, vectors


def _batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages with canonical URL and hash, one row per URL."""
    pages = identity.keyed(B.table(spark, sf_dir, "pages"))
    return identity.unique_documents(pages, ["canonical_url"], [F.asc("page_id")])


def _store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even pages, each tenth with another body."""
    pages = B.table(spark, sf_dir, "pages").where(F.col("page_id") % 2 == 0)
    body = F.when(F.col("page_id") % 10 == 0, F.concat("html", F.lit(" changed"))).otherwise(F.col("html"))
    return identity.unique_documents(identity.keyed(pages.withColumn("html", body)), ["canonical_url"], [F.asc("page_id")])


def canonical_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.table(spark, sf_dir, "pages").select("page_id", urls.canonical_url(F.col("url")).alias("canonical_url"))


def new_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.new_urls(_batch(spark, sf_dir).select("page_id", "canonical_url"), _store(spark, sf_dir), ["canonical_url"])


def changed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.changed_pages(_batch(spark, sf_dir).select("page_id", "canonical_url", "content_hash"), _store(spark, sf_dir), ["canonical_url"]).select("page_id", "canonical_url", "content_hash", "current_hash")


def skip_unmodified(spark: SparkSession, sf_dir: str) -> DataFrame:
    tagged = lambda df: df.select("page_id", "canonical_url", F.col("content_hash").alias("etag"))
    return identity.skip_unmodified(tagged(_batch(spark, sf_dir)), tagged(_store(spark, sf_dir)), ["canonical_url"], ["etag"]).select("page_id", "canonical_url")


def resolved_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = B.table(spark, sf_dir, "pages").select("page_id", "url", F.posexplode(urls.hrefs(F.col("html"))).alias("position", "href"))
    return links.select("page_id", "position", urls.resolve_link(F.col("href"), F.col("url")).alias("link"))


def discovered_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = identity.discover_links(B.table(spark, sf_dir, "pages"), ["page_id"])
    return links.groupBy("link").agg(F.count(F.lit(1)).alias("n_links"), F.count_distinct("page_id").alias("n_pages"))


def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages, of each five one as it is, in upper case, with a bar in its bar, with a script in a comment, with a foot that never ends."""
    k, html = F.col("page_id") % 5, F.col("html")
    upper = html
    for tag in (*text.RAW_TAGS, *text.NESTED_TAGS):
        upper = F.regexp_replace(upper, f"<(/?){tag}\\b([^>]*)>", f"<$1{tag.upper()}$2 >")
    nested = F.regexp_replace(html, "(<nav\\b[^>]*>)", "$1<nav class=x>inner</nav>")
    commented = F.concat(html, F.lit("<!-- <script> --><script>var a = '<!-- </p>';</script>"))
    made = F.when(k == 1, upper).when(k == 2, nested).when(k == 3, commented).when(k == 4, F.concat(html, F.lit("<footer>never <b>closed</b>"))).otherwise(html)
    return B.table(spark, sf_dir, "pages").select("page_id", text.html_text(made).alias("body"))


def page_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.table(spark, sf_dir, "pages").select("page_id", text.page_title(F.col("html")).alias("title"))


def boilerplate_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.boilerplate_lines(B.documents(spark, sf_dir), 2)


def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.documents(spark, sf_dir).select("document_id", text.fingerprint(F.col("raw_text")).alias("content_hash"))


def _hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.documents(spark, sf_dir).select("document_id", "source_id", "lang", "n_chars", text.fingerprint(F.col("raw_text")).alias("content_hash"))


def duplicate_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.duplicate_rate(identity.duplicate_flags(_hashed(spark, sf_dir), [F.asc("document_id")], keys=("content_hash",)))


def current_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.current_versions(_hashed(spark, sf_dir), ["source_id", "lang"], [F.desc("document_id")]).select("source_id", "lang", "document_id", "content_hash")


def version_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a source's documents of a language and length class stand for the versions of one page
    rows = _hashed(spark, sf_dir).withColumn("length_class", F.floor(F.log2(F.col("n_chars") + 1)).cast("int"))
    return identity.version_history(rows, ["source_id", "lang", "length_class"], [F.asc("document_id")], chunk=F.floor(F.col("document_id") / 500)).select("document_id", "version", "changed")


def repeat_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.repeats(_hashed(spark, sf_dir), "content_hash")


def masked_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, with a line of numbers made of their own."""
    k = F.col("document_id")
    eight = F.lpad((k % 100000000).cast("string"), 8, "0")
    forms = ["电话138{}。", "手机：+86 139-{}", "座机010-{}转12", "证件110101{}003X号", "call +1 (415) 555-1234", "订单{}", "mail a{}@b.example"]
    line = F.array(*(F.concat(F.lit(f.partition("{}")[0]), F.when(F.lit("{}" in f), eight).otherwise(""), F.lit(f.partition("{}")[2])) for f in forms))
    return B.documents(spark, sf_dir).select("document_id", text.mask_pii(F.concat_ws("\n", "raw_text", F.get(line, (k % len(forms)).cast("int")))).alias("masked"))


def masked_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, with a line that holds a secret made of their number."""
    k = F.col("document_id")
    forms = ["Authorization: Bearer eyJ{}.abcdef", '{"api_key": "k{}", "n": 1}', "X-Api-Key: {}x", 'password="p@ss!{}" ok', "postgres://user:p{}@db/x", "got Bearer abcdefgh{} back", "the secret is {}", "密码：p{}，完"]
    line = F.array(*(F.concat_ws("", F.lit(a), k.cast("string"), F.lit(b)) for a, _, b in (f.rpartition("{}") for f in forms)))
    return B.documents(spark, sf_dir).select("document_id", text.mask_secrets(F.concat_ws("\n", "raw_text", F.get(line, (k % len(forms)).cast("int")))).alias("masked"))


def distinct_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = B.table(spark, sf_dir, "pages").withColumn("canonical", urls.canonical_url(F.col("url")))
    return identity.distinct_counts(pages, ["url", "canonical"])


def top_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.documents(spark, sf_dir).select("document_id", F.col("n_chars").alias("score"), F.lit(None).cast("timestamp").alias("deadline"))
    return reporting.top_k(rows, 20, ["document_id"]).select("document_id", F.col("score").alias("n_chars"))


def _golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    expected = B.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("document_id"), F.col("quality").cast("int").alias("value"))
    actual = B.documents(spark, sf_dir).select("document_id", (F.col("n_chars") >= 200).cast("int").alias("value"))
    return evaluation.golden_diff(expected, actual, ["document_id"], ["value"])


def golden_success(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.golden_summary(_golden(spark, sf_dir))


def precision_at_20(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = B.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("document_id"), F.col("quality").cast("double").alias("relevant"))
    return evaluation.precision_at_k(B.documents(spark, sf_dir).select("document_id", "lang", "n_chars"), labels, "document_id", "lang", [F.desc("n_chars"), F.asc("document_id")])


def _queries(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    vectors = B.table(spark, sf_dir, "embeddings")
    return vectors.where(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("query_id"), "embedding", F.col("label").alias("query_label")), vectors


def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, vectors = _queries(spark, sf_dir)
    return evaluation.vector_topk(queries, vectors, 10)


def vector_probed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of each query as far as cells find them, and whether they stand among the exact ten."""
    queries, vectors_ = _queries(spark, sf_dir)
    found, exact = vectors.probed_topk(queries, vectors_, 10), evaluation.vector_topk(queries, vectors_, 10)
    return found.join(exact.select("query_id", "vec_id", F.lit(True).alias("exact")), ["query_id", "vec_id"], "left").select("query_id", "rank", "vec_id", "cosine", F.coalesce("exact", F.lit(False)).alias("exact"))


def _relevant(found: DataFrame, queries: DataFrame, vectors: DataFrame) -> DataFrame:
    labelled = found.join(queries.select("query_id", "query_label"), "query_id").join(vectors.select("vec_id", "label"), "vec_id")
    return labelled.select("query_id", (F.col("label") == F.col("query_label")).alias("relevant"))


def recall_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, vectors = _queries(spark, sf_dir)
    found = evaluation.vector_topk(queries, vectors, 10)
    # the base path offers the ten vectors that follow the query
    base = queries.select("query_id", F.explode(F.sequence(F.col("query_id") + 1, F.col("query_id") + 10)).alias("vec_id"))
    return evaluation.recall_gain(_relevant(base, queries, vectors), _relevant(found, queries, vectors), "query_id")


def rerank_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, vectors = _queries(spark, sf_dir)
    found = evaluation.vector_topk(queries, vectors, 10).drop("rank")
    scores = vectors.select("vec_id", F.col("label").alias("rerank_score"), (F.col("vec_id") % 3 + 1).cast("decimal(12,2)").alias("cost"))
    done = evaluation.rerank_top_n(found, scores, "query_id", "vec_id", [F.desc("cosine"), F.asc("vec_id")], 5, 6)
    return done.select("query_id", "vec_id", "place", "reranked", "final_place")


QUERIES = {
    "canonical_urls": canonical_urls,
    "new_urls": new_urls,
    "changed_pages": changed_pages,
    "skip_unmodified": skip_unmodified,
    "resolved_links": resolved_links,
    "discovered_links": discovered_links,
    "page_text": page_text,
    "page_title": page_title,
    "boilerplate_lines": boilerplate_lines,
    "fingerprints": fingerprints,
    "duplicate_rate": duplicate_rate,
    "current_versions": current_versions,
    "version_history": version_history,
    "repeat_hashes": repeat_hashes,
    "masked_pii": masked_pii,
    "masked_secrets": masked_secrets,
    "distinct_urls": distinct_urls,
    "top_documents": top_documents,
    "golden_diff": _golden,
    "golden_success": golden_success,
    "precision_at_20": precision_at_20,
    "vector_topk": vector_topk,
    "vector_probed": vector_probed,
    "recall_gain": recall_gain,
    "rerank_capped": rerank_capped,
}
