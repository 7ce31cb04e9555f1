"""Queries on notices, their attachments and tables of cells, over values made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from noticeforge import bindings as B
from noticeforge.functions import times
from noticeforge.operators import extract, identity, quality, runs, tables, validate
from noticeforge.plans.positions import _checks
from noticeforge.sources import attachments

#: Numbers of days as notices write them.
CHINESE_NUMBERS = [f"{tens}{ones}" for tens in ("", "十", "二十", "三十") for ones in ("", *"一二三四五六七八九") if tens or ones][:31]
PDF, XLSX = "application/pdf", "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet"


def _case(number: Column, *values: Column) -> Column:
    """The value of the number 0, 1, 2 and so on."""
    out = F.when(number == 0, values[0])
    for k, v in enumerate(values[1:], 1):
        out = out.when(number == k, v)
    return out


def notice_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as notices that write their times in fourteen ways."""
    day = F.to_date("o_orderdate")
    last = F.date_add(day, 13)
    written = lambda form, d=day: F.date_format(d, form)
    name = lambda k: F.element_at(F.array(*map(F.lit, CHINESE_NUMBERS)), k)
    digits = F.translate(F.year(day).cast("string"), "0123456789", "〇一二三四五六七八九")
    text = _case(
        F.col("o_orderkey") % 14,
        F.concat(F.lit("公告。报名时间："), written("yyyy年M月d日"), F.lit("至"), written("yyyy-MM-dd", last), F.lit("。")),
        F.concat(F.lit("报名时间："), written("yyyy年M月d日"), F.lit("9:00至"), written("M月d日", last), F.lit("17:00，逾期不候")),
        F.concat(F.lit("截止时间："), written("yyyy年M月d日"), F.lit("24:00")),
        F.concat(F.lit("报名"), written("yyyy年M月"), F.lit("1日-"), F.day(day).cast("string"), F.lit("日（工作日）")),
        F.concat(F.lit("请于"), written("yyyy年M月d日"), F.lit("下午5点前报名，30日内答复")),
        F.concat(F.lit("自"), written("yyyy年M月d日"), F.lit("上午9时起至下午3时30分止")),
        F.concat(F.lit("报名时间："), digits, F.lit("年"), name(F.month(day)), F.lit("月"), name(F.day(day)), F.lit("日上午九时至十一时半")),
        F.lit("报名时间另行通知，电话010-62751234，每天9:00-17:00"),
        F.concat(F.lit("截止日期："), F.year(day).cast("string"), F.lit("年2月31日")),
        F.translate(F.concat(F.lit("报名时间："), written("yyyy/M/d"), F.lit("～"), written("yyyy/M/d", last)), "0123456789/", "０１２３４５６７８９／"),
        F.concat(F.lit("报名从即日起至"), written("M月d日"), F.lit("17时")),
        F.concat(written("yyyy.M.d"), F.lit(" 14:30—17:00")),
        F.concat(F.lit("发布时间"), written("yyyy年M月d日"), F.lit("。报名时间（第一批）："), written("M月d日"), F.lit("（周四）下午2点至5点，笔试时间"), written("M月d日", last)),
        F.concat(written("yyyy-MM-dd"), F.lit("公布名单，"), written("yyyy-MM-dd", last), F.lit("体检")),
    )
    notices = B.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("post_id"), text.alias("text"), F.col("o_orderdate").alias("published_at"))
    found = notices.select("post_id", F.size(times.extract_dates(F.col("text"), F.col("published_at"))).alias("n_dates"), times.start_deadline(F.col("text"), F.col("published_at")).alias("w"))
    moment = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return found.select("post_id", "n_dates", moment("w.start_at").alias("start_at"), moment("w.deadline").alias("deadline"))


def notice_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as notices with organisation, headcount, education and address."""
    k = F.col("c_custkey")
    degree = _case(k % 6, F.lit("本科及以上"), F.lit("硕士研究生"), F.lit("学历不限"), F.lit("本科及以上学历，博士优先"), F.lit("硕士研究生，本科阶段须为全日制"), F.lit("有硕士学位者优先"))
    number = F.col("n")
    chinese = F.element_at(F.array(*map(F.lit, CHINESE_NUMBERS)), F.least(number, F.lit(31)).cast("int"))
    people = F.when((k % 4 == 1) & (number <= 31), F.concat(F.lit("招聘"), chinese, F.lit("人，"))).when(k % 4 == 2, F.concat(F.lit("按成绩前3名进入面试，招聘"), number.cast("string"), F.lit("名，")))
    people = people.when(k % 4 == 3, F.concat(F.lit("共"), number.cast("string"), F.lit("名，"))).otherwise(F.concat(F.lit("招聘人数："), number.cast("string"), F.lit("，")))
    text = F.concat(F.lit("招聘单位："), F.col("c_name"), F.lit("，"), people, degree, F.lit("，报名 https://jobs.example.org/"), k.cast("string"), F.lit(" 。"))
    docs = B.table(spark, sf_dir, "customer").withColumn("n", k % 40 + 1).select(k.alias("document_id"), text.alias("text"), F.lit(None).cast("timestamp").alias("published_at"))
    return extract.extract_fields(docs).select("document_id", "organization", "headcount", F.col("education.norm").alias("education"), F.col("education.order").alias("education_order"), "apply_url")


def notice_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' places by a dictionary of nations and regions."""
    nation, region = B.table(spark, sf_dir, "nation"), B.table(spark, sf_dir, "region")
    names = nation.select(F.col("n_nationkey").alias("region_id"), F.col("n_name").alias("name")).unionByName(region.select((F.col("r_regionkey") + 100).alias("region_id"), F.col("r_name").alias("name")))
    placed = B.table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    text = F.when(F.col("s_suppkey") % 4 == 0, F.concat(F.lit("somewhere in "), F.col("r_name"))).otherwise(F.concat(F.lit("an office in "), F.col("n_name"), F.lit(", "), F.col("r_name")))
    docs = placed.select(F.col("s_suppkey").alias("document_id"), text.alias("text"))
    return extract.match_regions(docs, names).select("document_id", "region")


def normalised_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = B.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("entity_id"), "c_mktsegment", F.when(F.col("c_acctbal") > 0, F.floor("c_acctbal").cast("long")).alias("balance"))
    return extract.with_norm(c, {"segment": (F.col("c_mktsegment"), F.lower("c_mktsegment")), "balance": (F.col("balance"), F.col("balance") % 1000)}, "entity_id")


def evidenced_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' organisations and balances, each only where its evidence stands."""
    c = B.table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    evidence = c.select(k.alias("entity_id"), F.when(k % 4 != 0, F.col("c_name")).alias("organization_quote"), F.when(k % 3 == 0, F.col("c_acctbal").cast("string")).alias("balance_quote"))
    rows = c.join(evidence, k == F.col("entity_id"))
    return rows.select("entity_id", validate.require_evidence(F.col("c_name"), F.col("organization_quote")).alias("organization"), validate.require_evidence(F.col("c_acctbal"), F.col("balance_quote")).alias("balance"))


def attachment_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of pages, each third one as the address of a file."""
    links = identity.discover_links(B.table(spark, sf_dir, "pages"), ["page_id"])
    files = links.withColumn("link", F.when(F.col("position") % 3 == 0, F.concat("link", F.lit(".PDF?v=1"))).otherwise(F.col("link")))
    return identity.attachment_links(files).select("page_id", "position", "link")


def attachment_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as files of seven kinds: two good ones, a false type, an error page, a cut one, an empty one, one of another extension."""
    kind, html = F.col("page_id") % 7, F.col("html").cast("binary")
    begun = lambda hex_: F.concat(F.unhex(F.lit(hex_)), html)
    content = _case(kind, begun("25504446"), begun("504B0304"), begun("D0CF11E0"), F.concat(F.lit("<HTML>").cast("binary"), html), begun("25504446"), F.lit(None).cast("binary"), begun("25504446"))
    path = F.concat(F.lit("files/"), F.col("page_id").cast("string"), F.when(kind == 1, ".xlsx").when(kind == 6, ".exe").otherwise(".PDF"))
    files = B.table(spark, sf_dir, "pages").select("page_id", path.alias("path"), content.alias("content"), F.when(kind == 1, XLSX).when(kind == 5, "text/plain").otherwise(PDF).alias("mime_type"), kind.alias("kind"))
    files = files.withColumn("length", F.octet_length("content").cast("long")).withColumn("declared_length", F.col("length") + F.when(F.col("kind") == 4, 10).otherwise(0))
    checked = attachments.route(attachments.check_length(attachments.validate_attachment(files)))
    return checked.select("page_id", "real_mime", "status", "reason", "complete", "parser")


def _pdf_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("page_id") % 4
    content = F.concat(F.when(kind != 3, "%PDF").otherwise(""), "html", F.when(kind == 0, "%%EOF").when(kind == 1, "/Encrypt").otherwise(""))
    return attachments.pdf_status(B.table(spark, sf_dir, "pages").select("page_id", content.cast("binary").alias("content")))


def pdf_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pdf_states(spark, sf_dir).select("page_id", "parse_status", "diagnosis")


def parse_success(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the readable files each second one failed."""
    status = F.when((F.col("parse_status") == "ok") & (F.col("page_id") % 8 == 4), "failed").otherwise(F.col("parse_status"))
    return quality.parse_success(_pdf_states(spark, sf_dir).withColumn("parse_status", status))


def scan_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten documents are the pages of a file."""
    pages = B.documents(spark, sf_dir).select(F.floor(F.col("document_id") / 10).alias("attachment_id"), F.col("raw_text").alias("text"))
    return attachments.flag_scans(pages, 1000).withColumn("chars_per_page", F.round("chars_per_page", 4))


def text_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attachments.to_blocks(B.documents(spark, sf_dir).select(F.col("document_id").alias("attachment_id"), F.lit(1).alias("page"), F.col("raw_text").alias("text")))


def new_attachments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files; those of each third document are stored."""
    url = F.concat(F.lit("https://files.example.org/"), F.lpad(F.col("document_id").cast("string"), 9, "0"))
    batch = B.documents(spark, sf_dir).select("document_id", url.alias("url"), F.sha2("raw_text", 256).alias("sha256"))
    known = batch.where(F.col("document_id") % 3 == 0)
    return attachments.new_attachments(batch, known, batch.select("document_id", F.col("url").alias("canonical_url")))


def slot_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    slots = B.slots(spark, sf_dir).select("source_id", F.col("slot_day").cast("timestamp_ntz").alias("slot_at"))
    return runs.slots_in_window(slots, B.runs(spark, sf_dir), "6 HOURS").select("source_id", "slot_at", "run_id", "status")


def source_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = B.table(spark, sf_dir, "events")
    return runs.source_states(e.select(F.col("user_id").alias("source_id"), (F.col("event_type") != "error").alias("enabled"), F.struct("ts", "event_id").alias("changed_at")))


def review_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks of which those of each fifth post's headcount are decided."""
    checks = _checks(spark, sf_dir)
    decisions = checks.where((F.col("post_id") % 5 == 0) & (F.col("reason") == "large_headcount")).select("post_id").distinct().select("post_id", F.lit("large_headcount").alias("reason"), F.lit("accepted").alias("state"))
    return validate.review_queue(checks, decisions, ["post_id"]).groupBy("reason", "state").agg(F.count(F.lit(1)).alias("n"))


def pref_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as users whose wishes are right, unknown or missing."""
    k = F.col("c_custkey")
    prefs = B.table(spark, sf_dir, "customer").select(k.alias("pref_id"), F.array(F.lit("ASIA"), F.when(k % 4 == 0, "MARS").otherwise("EUROPE")).alias("regions"), F.when(k % 5 != 0, F.array(F.col("c_mktsegment"))).alias("majors"))
    allowed = {"regions": ["ASIA", "EUROPE", "AFRICA"], "majors": ["BUILDING", "MACHINERY", "FURNITURE"]}
    return validate.validate_prefs(prefs, allowed).select("pref_id", F.array_join("problems", ",").alias("problems"))


def sheet_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of a nation as the rows of a sheet, below a title and a header, the nation in one merged range."""
    c = B.table(spark, sf_dir, "customer").join(B.table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    first = F.col("c_custkey") == F.min("c_custkey").over(Window.partitionBy("c_nationkey"))
    cell = lambda row, col, value: F.struct(row.cast("int").alias("row"), F.lit(col).alias("col"), value.cast("string").alias("value"), F.concat(F.lit("ABC"[col - 1]), row.cast("string")).alias("cell"))
    sheet = lambda df, cells: df.select(F.col("c_nationkey").alias("attachment_id"), F.lit("S").alias("sheet"), F.explode(F.array(*cells)).alias("x")).select("attachment_id", "sheet", "x.*")
    row = F.col("c_custkey") + 3
    body = sheet(c.withColumn("first", first), [cell(row, 1, F.col("c_name")), cell(row, 2, F.col("c_custkey") % 50), cell(row, 3, F.when(F.col("first"), F.col("n_name")).otherwise(""))])
    top = [cell(F.lit(1), 1, F.lit("List of positions"))] + [cell(F.lit(2), k, F.lit(name)) for k, name in enumerate(("Position", "Headcount", "Region"), 1)]
    files = c.select("c_nationkey").distinct()
    ranges = files.select(F.col("c_nationkey").alias("attachment_id"), F.lit("S").alias("sheet"), F.lit(3).alias("r1"), F.lit(3).alias("c1"), F.lit(1 << 30).alias("r2"), F.lit(3).alias("c2"))
    filled = tables.fill_merged(body.unionByName(sheet(files, top)), ranges)
    headers = tables.header_rows(filled, ["position", "headcount", "region"])
    fields = tables.cells_to_fields(filled, headers, {"Position": "name", "Headcount": "headcount", "Region": "region"})
    return fields.select("attachment_id", "row", "name", "headcount", "region", F.element_at("evidence", "name").alias("name_cell"), F.element_at("evidence", "region").alias("region_cell"))


QUERIES = {
    "notice_dates": notice_dates,
    "notice_fields": notice_fields,
    "notice_regions": notice_regions,
    "normalised_evidence": normalised_evidence,
    "attachment_links": attachment_links,
    "evidenced_fields": evidenced_fields,
    "attachment_checks": attachment_checks,
    "pdf_states": pdf_states,
    "parse_success": parse_success,
    "scan_flags": scan_flags,
    "text_blocks": text_blocks,
    "new_attachments": new_attachments,
    "slot_runs": slot_runs,
    "source_states": source_states,
    "review_states": review_states,
    "pref_problems": pref_problems,
    "sheet_fields": sheet_fields,
}
