"""The operators applied to the given tables: one query each, and the SQL that gives the same rows where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeforge.llm import decontaminate, divergence, graph_search, licenses, near_dup, packing, pii, quality, substring_dedup, token_counts, token_files, toxicity, variants
from noticeforge.llm.frames import remainder_of_five, shared_folder
from noticeforge.llm.sql import OP3, OP6, OP10, OP12


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pii_key(spark: SparkSession) -> str:
    """The key of the setting noticeforge.pii.key; where it is unset, one that is good for the given synthetic tables only."""
    return spark.conf.get("noticeforge.pii.key", "only for synthetic tables")


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.license_scan(_table(spark, sf_dir, "documents"))
    starts, own = F.col("base.start"), F.col("base.label")
    return found.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(own)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(own, F.col("detections.label"))), ",").alias("labels"),
        F.coalesce(F.array_max("detections.weight"), F.when(F.size("base") > 0, 0.5), F.lit(0.0)).alias("score"),
    )


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.pseudonymise(_table(spark, sf_dir, "documents"), pii_key(spark))
    return found.select("doc_id", "text", F.size("found").cast("long").alias("n_found"), F.array_join(F.array_sort(F.array_distinct("found.kind")), ",").alias("kinds"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark)
    token_files.write(_table(spark, sf_dir, "documents"), folder, _tokenizer())
    return token_files.read(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), _tokenizer("piece_bpe_32k.model"))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(_table(spark, sf_dir, "documents"), similarity=0.8, size=2, words="spaced")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    scores = toxicity.toxicity(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))
    return scores.select("doc_id", (remainder_of_five(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.crc32_of_ids(packing.pack(_table(spark, sf_dir, "documents"), _tokenizer()))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.without_repeats(_table(spark, sf_dir, "documents"), passages=True).select("doc_id", "text", "n_sentences", "n_removed")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(_table(spark, sf_dir, "documents")).drop("chars")


def op11_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph_search.nearest_neighbours(_table(spark, sf_dir, "embeddings"), k=5, is_query=F.col("vec_id") % 50 == 0)


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(_table(spark, sf_dir, "documents"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.spelling_variants(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_licenses": op1_licenses,
    "op2_pii": op2_pii,
    "op3_decontamination": op3_decontamination,
    "op4_token_files": op4_token_files,
    "op5_token_counts": op5_token_counts,
    "op6_near_duplicates": op6_near_duplicates,
    "op7_toxicity": op7_toxicity,
    "op8_packing": op8_packing,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_quality": op10_quality,
    "op11_nearest_neighbours": op11_nearest_neighbours,
    "op12_source_divergence": op12_source_divergence,
    "op13_spelling_variants": op13_spelling_variants,
}

ORACLE_SQL = {"op3_decontamination": OP3, "op6_near_duplicates": OP6, "op10_quality": OP10, "op12_source_divergence": OP12}
