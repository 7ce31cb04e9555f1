"""What a store of versions knows of its pages without their texts: of each page the last hash and when it was fetched.

The key table stands beside the store. A crawl compares what it has fetched with it and reads the history only of pages
that arrive late. States are appended, in partitions of their sources; a generation of too many files is written anew with one row a page. A mark
stands while versions and states are appended; where a job has died in between, the next one finds it and makes the
table anew from the versions.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeforge.operators.identity import KEY

STATES = "source_id long, canonical_url string, content_hash string, fetched_at timestamp"
#: Files of a generation of the key table after which it is written anew.
MOST_FILES = 500
#: Bits of the filter of a batch's keys: 4 MB in all, whatever the batch.
FILTER_BITS = 1 << 25


def hadoop(spark: SparkSession, path: str):
    """A path and its file system."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    where, fs = hadoop(spark, path)
    return fs.exists(where)


def beside(store: str) -> str:
    return f"{store.rstrip('/')}.keys"


def latest(states: DataFrame) -> DataFrame:
    """The last state of each page."""
    last = F.max(F.struct("fetched_at", "content_hash")).alias("x")
    return states.groupBy(*KEY).agg(last).select(*KEY, "x.content_hash", "x.fetched_at")


def _generations(spark: SparkSession, store: str) -> list[int]:
    """Numbers of the whole generations."""
    top, fs = hadoop(spark, beside(store))
    names = [s.getPath().getName() for s in fs.listStatus(top)] if fs.exists(top) else []
    return sorted(int(n[1:]) for n in names if n[:1] == "g" and n[1:].isdigit() and exists(spark, f"{beside(store)}/{n}/_SUCCESS"))


def _anew(spark: SparkSession, store: str, states: DataFrame) -> str:
    old = _generations(spark, store)
    path = f"{beside(store)}/g{(old or [0])[-1] + 1}"
    latest(states).write.mode("overwrite").partitionBy("source_id").parquet(path)
    for n in old:
        where, fs = hadoop(spark, f"{beside(store)}/g{n}")
        fs.delete(where, True)
    mark(spark, store, False)
    return path


def mark(spark: SparkSession, store: str, on: bool) -> None:
    """Set or remove the mark of an append that has begun and not ended."""
    where, fs = hadoop(spark, f"{beside(store)}/_appending")
    if on:
        fs.create(where, True).close()
    else:
        fs.delete(where, False)


def table(spark: SparkSession, store: str, versions: DataFrame) -> str:
    """The path of the key table, made from the stored versions where it is missing or an append has died."""
    found = _generations(spark, store)
    if not found or exists(spark, f"{beside(store)}/_appending"):
        return _anew(spark, store, versions.select(*KEY, "content_hash", "fetched_at"))
    path = f"{beside(store)}/g{found[-1]}"
    where, fs = hadoop(spark, path)
    if fs.getContentSummary(where).getFileCount() > MOST_FILES:
        return _anew(spark, store, read(spark, path))
    return path


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(STATES).parquet(path)


def probable(rows: DataFrame, batch: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """The rows whose page may be one of the batch's, by a filter of bits that is broadcast: all that are, and few others."""
    place = F.pmod(F.xxhash64(*KEY), F.lit(bits)) + 1
    made = batch.select(place.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("_bits"))
    at = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substring("_bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    is_set = byte.bitwiseAND(F.pow(F.lit(2), at % 8).cast("int")) != 0
    columns = rows.columns
    return rows.withColumn("_bucket", F.bitmap_bucket_number(place)).join(F.broadcast(made), "_bucket").where(is_set).select(*columns)


def append(states: DataFrame, path: str) -> None:
    states.select("canonical_url", "content_hash", "fetched_at", "source_id").write.mode("append").partitionBy("source_id").parquet(path)


def last_batch(spark: SparkSession, store: str, cursor: str) -> int:
    """The last batch of a cursor that the store holds, -1 before the first."""
    path = _ledger(store, cursor)
    if not exists(spark, f"{path}/_SUCCESS"):
        return -1
    row = spark.read.schema("batch_id long").parquet(path).agg(F.max("batch_id")).first()
    return -1 if row[0] is None else row[0]


def note_batch(spark: SparkSession, store: str, cursor: str, batch_id: int) -> None:
    """Batches of a cursor follow each other, so the last one is all that is kept."""
    spark.range(batch_id, batch_id + 1, 1, 1).toDF("batch_id").write.mode("overwrite").parquet(_ledger(store, cursor))


def _ledger(store: str, cursor: str) -> str:
    return f"{beside(store)}/batches/{hashlib.sha256(cursor.encode()).hexdigest()[:32]}"

