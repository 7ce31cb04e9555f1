"""Quality metrics of the store: duplicates, completeness, parse success, and a board of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNREADABLE = ("encrypted", "corrupt", "ocr_required", "unsupported")


def duplicate_rate(flagged: DataFrame, source: str = "source_id") -> DataFrame:
    return flagged.groupBy(source).agg(F.count(F.lit(1)).alias("n_rows"), F.count_if("duplicate").alias("n_duplicates"), F.round(F.avg(F.col("duplicate").cast("int")), 4).alias("duplicate_rate"))


def completeness(rows: DataFrame, fields: list[str], by: str) -> DataFrame:
    """Per value of `by` and in total (null key): share of filled fields, and rows with all of them."""
    filled = sum((F.col(f).isNotNull().cast("int") for f in fields[1:]), F.col(fields[0]).isNotNull().cast("int"))
    counted = rows.select(F.col(by).alias(f"{by}_key"), filled.alias("_filled"))
    return counted.rollup(f"{by}_key").agg(F.count(F.lit(1)).alias("n_rows"), F.round(F.sum("_filled") / (F.lit(float(len(fields))) * F.count(F.lit(1))), 4).alias("filled_share"), F.count_if(F.col("_filled") == len(fields)).alias("n_complete"))


def parse_success(attachments: DataFrame) -> DataFrame:
    readable = ~F.col("parse_status").isin(*UNREADABLE)
    ok = (F.col("parse_status") == "ok").cast("int")
    return attachments.where(readable).agg(F.count(F.lit(1)).alias("n_readable"), F.round(F.avg(ok), 4).alias("parse_success"))


def parse_rates(attachments: DataFrame, source: str = "source_id") -> DataFrame:
    """Per source the attachments that could be read and the share of them that were parsed."""
    ok = (F.col("parse_status") == "ok").cast("int")
    readable = attachments.where(~F.col("parse_status").isin(*UNREADABLE))
    return readable.groupBy(source).agg(F.count(F.lit(1)).alias("n_readable"), F.round(F.avg(ok), 4).alias("parse_rate"))


def quality_board(runs: DataFrame, flagged: DataFrame, filled: DataFrame, attachments: DataFrame | None = None) -> DataFrame:
    """Per source: run success and total minutes, duplicate rate, completeness and, with attachments (source_id, parse_status), parse rate; sources of any side stay."""
    r = runs.groupBy("source_id").agg(F.count(F.lit(1)).alias("n_runs"), F.round(F.avg((F.col("status") == "success").cast("int")), 4).alias("success_rate"), F.sum("minutes").alias("minutes"))
    d = duplicate_rate(flagged).select("source_id", "n_rows", "duplicate_rate")
    board = r.join(d, "source_id", "full").join(filled, "source_id", "full")
    return board if attachments is None else board.join(parse_rates(attachments), "source_id", "full")
