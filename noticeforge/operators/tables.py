"""Cells of spreadsheets to fields: merged ranges, header rows, rows below the header."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SHEET = ["attachment_id", "sheet"]
MIN_HEADER_WORDS = 2


def fill_merged(cells: DataFrame, merge_ranges: DataFrame) -> DataFrame:
    """cells with empty ones inside a declared merge range given the range's value, down and to the right; no others."""
    r = merge_ranges.select(*SHEET, "r1", "c1", "r2", "c2").withColumn("range_no", F.struct("r1", "c1", "r2", "c2"))
    inside = cells.join(r, SHEET, "left").where(F.col("r1").isNull() | (F.col("row").between(F.col("r1"), F.col("r2")) & F.col("col").between(F.col("c1"), F.col("c2"))))
    tagged = cells.join(inside.where(F.col("r1").isNotNull()).select(*SHEET, "row", "col", "range_no").dropDuplicates([*SHEET, "row", "col"]), [*SHEET, "row", "col"], "left")
    w = Window.partitionBy(*SHEET, "range_no").orderBy("row", "col").rowsBetween(Window.unboundedPreceding, 0)
    value = F.nullif(F.trim("value"), F.lit(""))
    filled = F.when(F.col("range_no").isNotNull(), F.last(value, ignorenulls=True).over(w)).otherwise(value)
    return tagged.withColumn("value", filled).drop("range_no")


def header_rows(cells: DataFrame, header_words: list[str], min_score: int = MIN_HEADER_WORDS) -> DataFrame:
    """Per sheet its header row (most known words, then the upper one), or a null row and state review."""
    known = F.lower(F.trim("value")).isin([w.lower() for w in header_words]).cast("int")
    scored = cells.groupBy(*SHEET, "row").agg(F.sum(known).alias("score"))
    w = Window.partitionBy(*SHEET).orderBy(F.desc("score"), F.asc("row"))
    best = scored.withColumn("_n", F.row_number().over(w)).where(F.col("_n") == 1)
    good = F.coalesce(F.col("score"), F.lit(0)) >= min_score
    return best.select(*SHEET, F.when(good, F.col("row")).alias("header_row"), F.coalesce("score", F.lit(0)).alias("score"), F.when(good, "ok").otherwise("review").alias("state"))


def cells_to_fields(cells: DataFrame, headers: DataFrame, field_map: dict[str, str]) -> DataFrame:
    """One row per table row below the header, a column per field, and `evidence`: the cell each value stands in."""
    fields = sorted(set(field_map.values()))
    names = F.element_at(F.create_map(*(F.lit(x) for k, v in field_map.items() for x in (k.lower(), v))), F.lower(F.trim("value")))
    good = headers.where(F.col("state") == "ok").select(*SHEET, "header_row")
    with_header = cells.join(good, SHEET)
    titles = with_header.where(F.col("row") == F.col("header_row")).select(*SHEET, "col", names.alias("field")).where(F.col("field").isNotNull())
    body = with_header.where((F.col("row") > F.col("header_row")) & (F.trim("value") != "")).join(titles, [*SHEET, "col"])
    wide = body.groupBy(*SHEET, "row").pivot("field", fields).agg(F.first("value"))
    where = body.groupBy(*SHEET, "row").agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct("field", "cell")))).alias("evidence"))
    return wide.join(where, [*SHEET, "row"])
