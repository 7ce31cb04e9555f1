"""What the operators share on DataFrames: named inputs, Arrow steps, and the folder for files that all executors see."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeforge.llm import stores
from noticeforge.llm.words import Slice, slices


def keyed_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the columns `id` and `text`, whatever else the input has; a text of another type is read as a string."""
    return docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))


def rest_of(docs: DataFrame, *used: str) -> Column:
    """All other columns as one struct, to be carried through a step (a constant where there are none)."""
    return F.struct(*(docs[c] for c in docs.columns if c not in used), F.lit(0).alias("_"))


def as_before(df: DataFrame, docs: DataFrame, made: dict[str, str]) -> DataFrame:
    """The columns of docs in their order, from the struct `rest` and, by `made`, from columns of df."""
    return df.select(*((F.col(made[c]) if c in made else F.col("rest")[c]).alias(c) for c in docs.columns))


def map_slices(df: DataFrame, fn: Callable[[pa.RecordBatch, Slice], pa.RecordBatch | None], schema: str, text_col: str = "text", store: bool = False) -> DataFrame:
    """fn(the rows of the batch that the slice holds, the slice of their texts) in Python workers, slice by slice, so that memory doesn't grow with a batch.

    store: fn uses the worker's store; else one that an earlier stage has left goes.
    """

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not store:
            stores.free()
        for batch in batches:
            for s in slices(batch.column(batch.schema.get_field_index(text_col))):
                out = fn(batch.slice(s.first, len(s)), s)
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(step, schema)


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which all executors share; where that is unset, a local one is set with a local master (tests), and others are refused."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not top:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        if known.isDefined():
            top = known.get()
        else:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            top = tempfile.mkdtemp(prefix="spark-")
            spark.sparkContext.setCheckpointDir(top)
    return f"{top.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame, folder: str, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage, and a lost executor costs nothing of it."""
    path = f"{folder}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remainder_of_five(id_col: Column) -> Column:
    """crc32 of an id's text, modulo 5: 0 marks held-out rows."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 5


def computed_once(df: DataFrame, keep: list[str], **columns: Column) -> DataFrame:
    """`keep` and new columns, which later filters and projections then read instead of repeating their expressions.

    Catalyst copies a projected expression into filters above it; a row of a one-element array comes out of a generator, which it leaves alone.
    """
    return df.select(*keep, F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))
