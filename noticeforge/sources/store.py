"""Tables of the store: snapshots, appended versions, backfill, outbox."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from noticeforge.operators.identity import KEY, current_versions, keyed
from noticeforge.operators.runs import undelivered
from noticeforge.schemas import SCHEMAS
from noticeforge.sources import keys

#: Sources of a batch up to which the stored partitions to read are named.
SOURCES = 1_000
VERSIONS = "source_id long, url string, canonical_url string, content_hash string, raw_html string, fetched_at timestamp"


def snapshots(spark: SparkSession, folder: str) -> DataFrame:
    """Landed pages with their fixed schema, for replays without a network."""
    return spark.read.schema(SCHEMAS["snapshots"]).parquet(folder)


def _stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table at path; an empty one before the first write."""
    return spark.read.schema(schema).parquet(path) if keys.exists(spark, path) else spark.createDataFrame([], schema)


def versions(spark: SparkSession, path: str) -> DataFrame:
    """All stored versions; an empty table before the first write."""
    return _stored(spark, path, VERSIONS)


def current(spark: SparkSession, path: str) -> DataFrame:
    return current_versions(versions(spark, path), KEY, [F.desc("fetched_at"), F.desc("content_hash")])


def append_versions(batch: DataFrame, path: str, note: tuple[str, int] | None = None) -> int:
    """Append every snapshot that differs from the one before it, among those stored and those of the batch; the number of rows.

    How snapshots are dealt to batches doesn't matter, and the same batch again adds none. A late one that the next stored version repeats adds none either.
    Pages are compared with their last state in the key table; only of pages with a snapshot that isn't newer is the history read, without texts. note: a
    cursor and the number of its batch, which are written with the versions.
    """
    spark = batch.sparkSession
    rows = keyed(batch).select("source_id", "url", "canonical_url", "content_hash", F.col("html").alias("raw_html"), "fetched_at", F.lit(False).alias("stored"))
    pages = rows.select(*KEY, "fetched_at")
    # the batch's sources, where they are few, name the partitions to read
    sources = [r[0] for r in batch.select("source_id").distinct().limit(SOURCES + 1).collect()]
    of_sources = lambda df: df.where(F.col("source_id").isin(sources)) if len(sources) <= SOURCES else df
    table = keys.table(spark, path, versions(spark, path))
    asked = pages.groupBy(*KEY).agg(F.min("fetched_at").alias("first"))
    states = keys.latest(keys.probable(of_sources(keys.read(spark, table)), pages).join(asked.select(*KEY), KEY, "left_semi"))
    known, late = states.select(*KEY, "content_hash", "fetched_at"), states.join(asked, KEY).where(F.col("first") <= F.col("fetched_at")).select(*KEY)
    if not late.isEmpty():
        history = keys.probable(of_sources(versions(spark, path)).select(*KEY, "content_hash", "fetched_at"), late).join(late, KEY, "left_semi")
        known = known.join(late, KEY, "left_anti").unionByName(history)
    w = Window.partitionBy(*KEY).orderBy("fetched_at", "content_hash", F.desc("stored"))
    same = lambda other: F.col("content_hash").eqNullSafe(other(F.col("content_hash")).over(w))
    repeats = (F.row_number().over(w) > 1) & same(F.lag)
    changed = rows.unionByName(known.withColumn("stored", F.lit(True)), allowMissingColumns=True).withColumn("same", repeats).where(F.col("stored") | ~F.col("same"))
    repeated = F.coalesce(F.lead("stored").over(w), F.lit(False)) & same(F.lead)
    fresh = changed.withColumn("same", repeated).where(~F.col("stored") & ~F.col("same")).drop("stored", "same").persist()
    n = fresh.count()
    keys.mark(spark, path, True)
    if n:
        fresh.write.mode("append").partitionBy("source_id").parquet(path)
        keys.append(fresh, table)
    if note:
        keys.note_batch(spark, path, *note)
    keys.mark(spark, path, False)
    fresh.unpersist()
    return n


def backfill(spark: SparkSession, path: str, start: Column, end: Column, source_id: int | None = None) -> DataFrame:
    """Stored versions fetched from start up to end, of one source's partition if given, to run the operators on again."""
    rows = versions(spark, path).where((F.col("fetched_at") >= start) & (F.col("fetched_at") < end))
    return rows if source_id is None else rows.where(F.col("source_id") == source_id)


def outbox(reports: DataFrame, notifications: DataFrame, channels: list[str], path: str) -> DataFrame:
    """Append the deliveries still to be made that the outbox doesn't hold yet, and give all that are open, as stored: a second call appends nothing."""
    spark = reports.sparkSession
    open_ = undelivered(reports, notifications, channels)
    fresh = open_.join(_stored(spark, path, open_._jdf.schema().toDDL()), ["report_id", "channel"], "left_anti").persist()
    if fresh.count():
        fresh.write.mode("append").parquet(path)
    fresh.unpersist()
    return _stored(spark, path, open_._jdf.schema().toDDL()).join(open_, ["report_id", "channel"], "left_semi")
