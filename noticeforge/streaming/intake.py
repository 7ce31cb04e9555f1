"""Incremental intake of landed snapshots: the checkpoint is the cursor, the stored hashes decide what is new."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeforge.schemas import SCHEMAS
from noticeforge.sources.keys import exists, last_batch
from noticeforge.sources.store import append_versions

#: Landed files of a batch.
FILES_PER_BATCH = 1_000


def intake(spark: SparkSession, folder: str, checkpoint: str, on_batch: Callable[[DataFrame, int], None], source_id: int | None = None, files_per_batch: int = FILES_PER_BATCH) -> None:
    """Run on_batch over all files that no earlier run with this checkpoint has seen, some at a time, then stop.

    Of a folder with a part of its own for each source (source_id=...), only the part of the source asked for is listed.
    """
    names = [x.split()[0] for x in SCHEMAS["snapshots"].split(", ")]
    own = ", ".join(x for x in SCHEMAS["snapshots"].split(", ") if not x.startswith("source_id "))
    reader = spark.readStream.option("maxFilesPerTrigger", files_per_batch)
    part = f"{folder.rstrip('/')}/source_id={source_id}"
    if source_id is not None and exists(spark, part):
        stream = reader.schema(own).parquet(part).withColumn("source_id", F.lit(source_id).cast("long")).select(*names)
    else:
        stream = reader.schema(SCHEMAS["snapshots"]).parquet(folder)
        stream = stream if source_id is None else stream.where(F.col("source_id") == source_id)
    stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(on_batch).start().awaitTermination()


def apply_batch(batch: DataFrame, batch_id: int, store: str, cursor: str | None = None) -> int:
    """Append a batch's new and changed pages; a batch delivered again, or the same bytes in another file, adds nothing.

    With a cursor the store notes its batches: one that it holds isn't even read again.
    """
    if cursor is not None and last_batch(batch.sparkSession, store, cursor) >= batch_id:
        return 0
    return append_versions(batch, store, None if cursor is None else (cursor, batch_id))


def run_crawl(spark: SparkSession, folder: str, checkpoint: str, store: str, source_id: int | None = None, files_per_batch: int = FILES_PER_BATCH) -> int:
    """Take in what has landed (of one source, which has a cursor of its own, so that nothing of the others is passed over), and give the number of versions added."""
    added = 0
    if source_id is not None:
        checkpoint = f"{checkpoint}-source-{source_id}"

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        nonlocal added
        added += apply_batch(batch, batch_id, store, checkpoint)

    intake(spark, folder, checkpoint, on_batch, source_id, files_per_batch)
    return added
