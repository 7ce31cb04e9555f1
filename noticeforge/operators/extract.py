"""Fields of pages and notices as rows with evidence: detail pages, regions by dictionary, raw and normalised values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeforge.functions.fields import extract_apply_url, extract_headcount, extract_org, normalize_enum
from noticeforge.functions.text import html_text, page_title, published_at
from noticeforge.functions.times import start_deadline
from noticeforge.operators.dictionary import BLOCK_BYTES, with_names

NAMES_BYTES = BLOCK_BYTES

def detail_fields(pages: DataFrame) -> DataFrame:
    """pages with title, published_at and body."""
    html = F.col("html")
    return pages.withColumn("title", page_title(html)).withColumn("published_at", published_at(html)).withColumn("body", html_text(html))


def match_regions(docs: DataFrame, regions: DataFrame, text: str = "text") -> DataFrame:
    """docs with region: the longest dictionary name in the text, the smaller id of equal ones; null without any.

    The names are looked for all at once, in one reading of the texts; large dictionaries go in blocks.
    """
    names = regions.select(F.col("region_id").alias("id"), F.col("name").cast("string").alias("name"))
    found = with_names(docs, F.col(text), names, "_found", NAMES_BYTES)
    best = F.array_max(F.transform("_found", lambda x: F.struct(F.length(x["name"]).alias("length"), (-x["id"]).alias("minus"), x["name"].alias("name"))))
    return found.withColumn("region", best["name"]).drop("_found")


def extract_fields(docs: DataFrame, text: str = "text", published: str = "published_at") -> DataFrame:
    """docs with organization, apply_url, headcount, education {raw, norm, order}, start_at and deadline."""
    x = F.col(text)
    dates = start_deadline(x, F.col(published))
    out = docs.withColumns({"organization": extract_org(x), "apply_url": extract_apply_url(x), "headcount": extract_headcount(x), "education": normalize_enum(x), "_dates": dates})
    return out.withColumns({"start_at": F.col("_dates.start_at"), "deadline": F.col("_dates.deadline")}).drop("_dates")


def with_norm(df: DataFrame, columns: dict[str, tuple[Column, Column]], key: str) -> DataFrame:
    """Evidence rows: key, field_name, raw_value, norm_value; a field without a raw value gives none."""
    rows = F.array(*(F.struct(F.lit(name).alias("field_name"), raw.cast("string").alias("raw_value"), norm.cast("string").alias("norm_value")) for name, (raw, norm) in columns.items()))
    return df.select(key, F.explode(F.filter(rows, lambda r: r["raw_value"].isNotNull())).alias("x")).select(key, "x.*")
