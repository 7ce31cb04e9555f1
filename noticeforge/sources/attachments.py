"""Attachments: scan with digest, validation by leading bytes, routing, PDF status, page density, blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_SIZE, MIN_CHARS_PER_PAGE = 50 << 20, 50
#: Leading bytes of the formats, as hex.
MAGIC = (("25504446", "application/pdf"), ("504B0304", "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet"), ("D0CF11E0", "application/vnd.ms-excel"))
PARSERS = {"application/pdf": "pdf_text", "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": "xlsx", "application/vnd.ms-excel": "xls"}


#: Extensions of the formats.
EXTENSIONS = {"application/pdf": ("pdf",), "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": ("xlsx",), "application/vnd.ms-excel": ("xls",)}


def scan_attachments(spark: SparkSession, folder: str, max_size: int = MAX_SIZE) -> DataFrame:
    """Files of a folder with their SHA-256; larger ones are left out by their listing, before they are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).where(F.col("length") <= max_size)
    return files.select("path", "length", "modificationTime", F.sha2("content", 256).alias("sha256"), "content")


def real_mime(content: Column) -> Column:
    head = F.hex(F.substring(content, 1, 4))
    text = F.lower(F.substring(F.decode(F.substring(content, 1, 512), "ISO-8859-1"), 1, 512))
    out = F.when(text.rlike(r"^\s*(?:<!doctype html|<html)"), "text/html")
    for magic, mime in MAGIC:
        out = out.when(head == magic, mime)
    return out.otherwise("unknown")


def validate_attachment(files: DataFrame, max_size: int = MAX_SIZE) -> DataFrame:
    """files with real_mime, status (ok, rejected, incomplete) and reason; needs mime_type, length, declared_length, content.

    A path, if there is one, must have an extension of the file's real format.
    """
    mime = real_mime(F.col("content"))
    reason = (
        F.when(F.col("content").isNull() | (F.col("length") == 0), "empty")
        .when(F.col("length") > max_size, "too_large")
        .when(mime == "text/html", "html_error_page")
        .when(F.coalesce(F.octet_length("content") < F.col("declared_length"), F.lit(False)), "incomplete")
        .when(~F.coalesce(mime == F.col("mime_type"), F.lit(False)), "mime_mismatch")
    )
    if "path" in files.columns:
        extension = F.lower(F.regexp_extract(F.regexp_replace("path", "[?#].*$", ""), r"\.([A-Za-z0-9]+)$", 1))
        known = F.lit(False)
        for kind, names in EXTENSIONS.items():
            known = known | ((mime == kind) & extension.isin(*names))
        reason = reason.when(~F.coalesce(known, F.lit(False)), "wrong_extension")
    out = files.withColumn("real_mime", mime).withColumn("reason", reason)
    return out.withColumn("status", F.when(F.col("reason").isNull(), "ok").when(F.col("reason") == "incomplete", "incomplete").otherwise("rejected"))


def check_length(files: DataFrame) -> DataFrame:
    return files.withColumn("complete", F.coalesce(F.octet_length("content") >= F.col("declared_length"), F.col("content").isNotNull()))


def route(files: DataFrame, registry: dict[str, str] = PARSERS) -> DataFrame:
    """files with the parser for their MIME type, else unsupported."""
    parser = F.element_at(F.create_map(*(F.lit(x) for pair in registry.items() for x in pair)), F.col("mime_type"))
    return files.withColumn("parser", F.coalesce(parser, F.lit("unsupported")))


def pdf_status(files: DataFrame) -> DataFrame:
    """files with parse_status (ok, corrupt, encrypted) and a diagnosis, by marks in their bytes."""
    text = F.decode("content", "ISO-8859-1")
    status = F.when(F.col("content").isNull() | ~F.startswith(text, F.lit("%PDF")), "corrupt").when(F.instr(text, "/Encrypt") > 0, "encrypted").when(F.instr(text, "%%EOF") == 0, "corrupt").otherwise("ok")
    why = F.when(F.col("content").isNull() | ~F.startswith(text, F.lit("%PDF")), "no PDF header").when(F.instr(text, "/Encrypt") > 0, "needs a password").when(F.instr(text, "%%EOF") == 0, "no end of file")
    return files.withColumn("parse_status", status).withColumn("diagnosis", why)


def flag_scans(pages: DataFrame, min_chars: int = MIN_CHARS_PER_PAGE) -> DataFrame:
    """Per attachment the mean characters a page, and ocr_required below min_chars."""
    density = pages.groupBy("attachment_id").agg(F.count(F.lit(1)).alias("n_pages"), F.avg(F.length(F.coalesce(F.trim("text"), F.lit("")))).alias("chars_per_page"))
    return density.withColumn("parse_status", F.when(F.col("chars_per_page") < min_chars, "ocr_required").otherwise("ok"))


def to_blocks(pages: DataFrame) -> DataFrame:
    """Paragraphs of pages, numbered, each with its file and page."""
    parts = F.filter(F.split("text", "\n\\s*\n"), lambda b: F.trim(b) != "")
    return pages.select("attachment_id", "page", F.posexplode(parts).alias("block_no", "text"))


def new_attachments(batch: DataFrame, attachments: DataFrame, documents: DataFrame) -> DataFrame:
    """The first of each new content, linked to its document; content known by its digest isn't stored again."""
    fresh = batch.join(attachments.select("sha256").distinct(), "sha256", "left_anti")
    first = fresh.groupBy("sha256").agg(F.min(F.struct("url", "document_id")).alias("x")).select("sha256", "x.url", "x.document_id")
    return first.join(documents.select("document_id", "canonical_url"), "document_id")
