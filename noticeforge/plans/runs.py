"""Queries on the run log, notifications, evidence and calls over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from noticeforge import bindings as B
from noticeforge.functions import fields, times
from noticeforge.functions.text import fingerprint
from noticeforge.operators import evaluation, identity, merge, quality, runs, validate

def _as_of() -> Column:
    return B.at(B.RUNS_AS_OF)
#: What an event type stands for among the outcomes of crawl items.
OUTCOME = {"signup": "discovered", "purchase": "new", "click": "updated", "view": "skipped", "error": "failed"}
STATUS = {"error": 503, "click": 200, "view": 304, "signup": 404, "purchase": 429}


def _mapped(column: str, names: dict) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for pair in names.items() for x in pair)), F.col(column))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.table(spark, sf_dir, "events")


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    return e.select(F.col("event_id").alias("run_id"), F.col("user_id").alias("source_id"), F.to_date("ts").alias("day"), F.col("ts").alias("started_at"), _mapped("event_type", OUTCOME).alias("outcome"), F.when(F.col("event_type") == "error", F.concat(F.lit("E"), (F.get_json_object("props", "$.k").cast("int") % 5).cast("string"))).alias("error_class"), _mapped("event_type", STATUS).alias("http_status"))


def run_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.run_stats(_items(spark, sf_dir), ["source_id", "day"])


def run_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.run_status(run_stats(spark, sf_dir)).select("source_id", "day", "failed", "attempted", "status")


def _filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.last_run_of_slot(B.slots(spark, sf_dir), B.runs(spark, sf_dir))


def source_availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.source_availability(_filled(spark, sf_dir), _as_of())


def on_time_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.on_time_rate(_filled(spark, sf_dir), (F.hour("started_at") < 12) & (F.col("status") == "success"))


def failure_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.streaks(B.runs(spark, sf_dir), F.col("status") == "success")


def failed_only_rerun(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.failed_items(_items(spark, sf_dir), ["source_id", "day"], ["started_at", "run_id"], F.col("outcome") == "failed")


def retry_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    tried = _items(spark, sf_dir).withColumn("attempts", F.row_number().over(Window.partitionBy("source_id", "day").orderBy("started_at", "run_id")))
    return tried.select("run_id", "attempts", fields.classify_fetch(F.col("http_status")).alias("action"), fields.next_attempt(F.col("started_at"), F.col("http_status"), F.col("attempts")).alias("next_attempt"))


def slot_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.overlapping_runs(B.runs(spark, sf_dir)).select("run_id", "source_id", "busy_until")


def unfinished_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = B.runs(spark, sf_dir).withColumn("finished_at", F.when(F.col("outcome") != "signup", F.col("finished_at")))
    return runs.unfinished_runs(log, _as_of(), "6 HOURS").select("source_id", "run_id", "started_at")


def due_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = _events(spark, sf_dir).select(F.col("user_id").alias("source_id")).distinct().withColumn("enabled", F.col("source_id") % 5 != 0).withColumn("interval_s", (1 + F.col("source_id") % 3) * 86400)
    return runs.due_sources(sources, B.runs(spark, sf_dir), _as_of()).select("source_id", "interval_s", "last_started")


def failure_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.failure_classes(_items(spark, sf_dir))


def stage_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _events(spark, sf_dir).select(F.to_date("ts").alias("scheduled_at"), F.col("event_type").alias("stage"), F.col("event_id").alias("id"))
    return runs.stage_trace(log, ["signup", "view", "click", "purchase", "error"])


def _notifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date"))
    return _events(spark, sf_dir).select((F.col("user_id") * 100 + day).cast("long").alias("report_id"), F.when(F.col("event_id") % 2 == 0, "email").otherwise("wechat").alias("channel"), F.when(F.col("event_type") == "purchase", "success").otherwise("failed").alias("status"), F.col("ts").alias("sent_at"))


def outbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    sent = _notifications(spark, sf_dir)
    return runs.undelivered(sent, sent, ["email", "wechat"])


def delivery_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.delivery_attempts(_notifications(spark, sf_dir), 3).select("report_id", "channel", "attempts", "state")


def delivery_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    sent = _notifications(spark, sf_dir)
    return runs.delivery_list(sent, sent, ["email", "wechat"], 3)


def tool_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = _events(spark, sf_dir).select(F.col("event_type").alias("tool"), F.when(F.col("value") > 100, "slow").otherwise("ok").alias("status"), F.col("value").alias("duration_ms"))
    return evaluation.tool_audit(calls, exact=True)


def task_success(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks = _events(spark, sf_dir).select(F.when(F.col("user_id") % 2 == 0, "query").otherwise("command").alias("kind"), (F.col("event_type") != "error").alias("success"), (F.col("event_type") == "purchase").alias("wrote"))
    return evaluation.task_success(tasks)


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select(F.col("event_id").alias("call_id"), F.col("ts").alias("called_at"), F.to_date("ts").alias("day"), F.col("event_type").alias("model"), F.get_json_object("props", "$.k").cast("long").alias("tokens"), F.col("value").cast("decimal(12,2)").alias("cost"))


def llm_cost_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.llm_usage(_calls(spark, sf_dir), ["day", "model"])


def budget_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.admit_calls(_calls(spark, sf_dir), 600).select("call_id", "spent_before", "status")


def valid_extractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies made invalid in four ways by the id, and read strictly."""
    n, good = F.col("event_id") % 7, F.col("props")
    body = F.when(n == 1, F.replace(good, F.lit("}"), F.lit(""))).when(n == 2, F.lit('{"k": "x"}')).when(n == 3, F.lit('{"j": 1}')).when(n == 4, F.replace(good, F.lit("}"), F.lit(', "z": 2}'))).otherwise(good)
    parsed = validate.parse_extraction(_events(spark, sf_dir).select("event_id", body.alias("body")), "body", "k int", ["k"])
    return parsed.select("event_id", F.when(F.col("problem").isNull(), F.col("parsed.k")).alias("k"), "problem")


def utc_to_local(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select("event_id", times.to_local(F.col("ts")).alias("local_ts"), F.to_date(times.to_local(F.col("ts"))).alias("local_date"))


def first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = identity.first_seen(_events(spark, sf_dir), ["user_id", "event_type"], "ts")
    return seen.select("user_id", "event_type", F.to_date(times.to_local(F.col("first_seen"))).alias("first_day"))


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = B.table(spark, sf_dir, "conversations")
    words = F.split(F.lower(F.regexp_replace("text", "[^A-Za-z0-9 ]", "")), " ")
    return c.select(F.col("conv_id").alias("entity_id"), F.lit("opening").alias("field_name"), F.col("role").alias("source_type"), F.nullif(words[0], F.lit("")).alias("norm_value"), F.length("text").cast("double").alias("confidence"), F.col("turn").alias("position"))


def _merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.merge_fields(_candidates(spark, sf_dir), ("system", "user", "assistant"))


def merged_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir).where("winner").select("entity_id", "source_type", "norm_value", "position", "conflict")


def field_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir).groupBy("entity_id").agg(F.max("conflict").alias("conflict"), F.count_distinct("norm_value").alias("n_values"))


def evidence_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = B.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.length("text").alias("n"))
    lists = merge.evidence_lists(c, "conv_id", ["turn", "role", "n"])
    line = F.transform("evidence", lambda x: F.concat_ws(":", x["turn"].cast("string"), x["role"], x["n"].cast("string")))
    return lists.select("conv_id", F.array_join(line, ";").alias("evidence"), F.size("evidence").cast("long").alias("n_evidence"))


def evidence_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = B.table(spark, sf_dir, "conversations").select("conv_id", F.col("role").alias("field_name"))
    return validate.evidence_gaps(c, c, "conv_id", ["system", "user", "assistant"])


def quality_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources of documents, with the runs of the users whose number ends alike."""
    log = _events(spark, sf_dir).select(F.concat(F.lit("src"), (F.col("user_id") % 20).cast("string")).alias("source_id"), F.when(F.col("event_type") == "error", "failed").otherwise("success").alias("status"), F.col("value").cast("decimal(12,2)").alias("minutes"))
    docs = B.documents(spark, sf_dir).withColumn("content_hash", fingerprint(F.col("raw_text")))
    flagged = identity.duplicate_flags(docs.select("document_id", "source_id", "content_hash"), [F.asc("document_id")], keys=("content_hash",))
    long_texts = docs.select("source_id", F.when(F.col("n_chars") >= 200, F.col("n_chars")).alias("n_chars"), "lang")
    filled = quality.completeness(long_texts, ["n_chars", "lang"], "source_id").where(F.col("source_id_key").isNotNull()).select(F.col("source_id_key").alias("source_id"), "filled_share")
    status = F.element_at(F.array(*map(F.lit, ("ok", "ok", "partial", "corrupt", "ok", "encrypted", "ok"))), (F.col("document_id") % 7 + 1).cast("int"))
    return quality.quality_board(log, flagged, filled, docs.select("source_id", status.alias("parse_status")))


QUERIES = {
    "run_stats": run_stats,
    "run_status": run_status,
    "source_availability": source_availability,
    "on_time_rate": on_time_rate,
    "failure_streaks": failure_streaks,
    "failed_only_rerun": failed_only_rerun,
    "retry_plan": retry_plan,
    "slot_overlap": slot_overlap,
    "unfinished_runs": unfinished_runs,
    "due_sources": due_sources,
    "failure_classes": failure_classes,
    "stage_trace": stage_trace,
    "outbox": outbox,
    "delivery_attempts": delivery_attempts,
    "delivery_list": delivery_list,
    "tool_audit": tool_audit,
    "task_success": task_success,
    "llm_cost_daily": llm_cost_daily,
    "budget_admission": budget_admission,
    "valid_extractions": valid_extractions,
    "utc_to_local": utc_to_local,
    "first_seen": first_seen,
    "merged_fields": merged_fields,
    "field_conflicts": field_conflicts,
    "evidence_lists": evidence_lists,
    "evidence_gaps": evidence_gaps,
    "quality_board": quality_board,
}
