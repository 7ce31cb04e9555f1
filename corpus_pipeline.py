"""A corpus pipeline of the operators of noticeforge.llm: each stage works on what the one before kept.

All stages take an empty table (no rows come back), null and repeated ids, repeated rows, null, empty and very long texts, and columns of any other name,
which they keep. What becomes of such rows is said at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeforge.llm import decontaminate, near_dup, packing, pii, toxicity
from noticeforge.llm.frames import shared_folder, written
from noticeforge.llm.queries import pii_key


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones among them, scores under 0.5. Null and empty texts have the bias for a score; without labels nothing is rejected."""
    return toxicity.accepted(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near-duplicates (five-word shingles, similarity 0.8 or more).

    Rows go, not ids: unlike texts under one id both stay, a row that stands several times stays once. Texts without words and rows with a null id all stay.
    """
    return near_dup.one_of_each_group(docs, similarity=0.8, size=5, words="alnum")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that don't hold benchmark items in a twentieth or more of their words. Texts without words hold none."""
    return decontaminate.uncontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pseudonymise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts replaced by pseudonyms, and n_chars counted anew. A null text stays null, with a null n_chars."""
    return pii.rewritten(docs, pii_key(spark)).withColumn("n_chars", F.length("text").cast("long"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' token ids in sequences of at most 4096. A null or empty text is its end id alone."""
    import public_tokenizers

    return packing.crc32_of_ids(packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("toxicity", reject_toxic),
    ("near-duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii", pseudonymise),
    ("packing", pack),
]

#: A classifier, a sketch and a tokenizer have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = shared_folder(spark)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, folder, f"stage{k}")
    return docs
