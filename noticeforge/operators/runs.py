"""The run log: counts, availability, streaks, overlaps, re-runs, retries, deliveries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FAILURE_SHARE, STREAK_ALERT = 0.5, 3
OUTCOMES = ("discovered", "new", "updated", "skipped", "failed")


def due_sources(sources: DataFrame, runs: DataFrame, as_of: Column) -> DataFrame:
    """Enabled sources never run, or whose interval since the last start is over; interval_s is in seconds."""
    last = runs.where(F.col("started_at") <= as_of).groupBy("source_id").agg(F.max("started_at").alias("last_started"))
    due = F.col("last_started") + F.make_dt_interval(secs=F.col("interval_s").cast("decimal(18,6)")) <= as_of
    return sources.where("enabled").join(last, "source_id", "left").where(F.col("last_started").isNull() | due)


def source_states(events: DataFrame) -> DataFrame:
    return events.groupBy("source_id").agg(F.max_by("enabled", "changed_at").alias("enabled"))


def resolve_adapters(sources: DataFrame, registry: dict[str, object]) -> DataFrame:
    """sources, if each adapter is registered; raises with the unknown names (a short list) otherwise."""
    unknown = [r[0] for r in sources.where(~F.coalesce(F.col("adapter").isin(list(registry)), F.lit(False))).select("adapter").distinct().limit(20).collect()]
    if unknown:
        raise ValueError(f"unknown adapters: {', '.join(sorted(str(x) for x in unknown))}")
    return sources


def run_stats(items: DataFrame, by: list[str]) -> DataFrame:
    return items.groupBy(*by).agg(*(F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOMES))


def run_status(stats: DataFrame, threshold: float = FAILURE_SHARE) -> DataFrame:
    tried = sum((F.col(o) for o in OUTCOMES[1:]), F.col(OUTCOMES[0]))
    return stats.withColumn("attempted", tried).withColumn("status", F.when(F.col("failed") > threshold * F.col("attempted"), "failed").otherwise("success"))


def last_run_of_slot(slots: DataFrame, runs: DataFrame) -> DataFrame:
    """Each planned (source_id, slot_day) with the last run that day; nulls for a missed slot."""
    last = runs.groupBy("source_id", F.to_date("started_at").alias("slot_day")).agg(F.max_by(F.struct("started_at", "status"), F.struct("started_at", "run_id")).alias("run"))
    return slots.join(last, ["source_id", "slot_day"], "left").select("source_id", "slot_day", "run.started_at", "run.status")


def slots_in_window(slots: DataFrame, runs: DataFrame, interval: str) -> DataFrame:
    """Planned slots (source_id, slot_at) with the runs that finished within the interval after them, or once with nulls.

    Times are cut into buckets as long as the interval: a run is in the bucket of a slot or in the next one, so it stands under its own and the one before, and
    a source's slots meet only runs near them.
    """
    span = F.expr(f"unix_seconds(timestamp_seconds(0) + INTERVAL {interval})")
    bucket = lambda df, c: F.floor(_seconds(df, c) / span).cast("long")
    own = bucket(runs, "finished_at")
    r = runs.select(F.col("source_id").alias("_source"), "run_id", "finished_at", "status", F.explode(F.array(own, own - 1)).alias("_of"))
    inside = (F.col("source_id") == F.col("_source")) & (F.col("_bucket") == F.col("_of")) & (F.col("finished_at") >= F.col("slot_at")) & (F.col("finished_at") < F.col("slot_at") + F.expr(f"INTERVAL {interval}"))
    return slots.withColumn("_bucket", bucket(slots, "slot_at")).join(r, inside, "left").drop("_source", "_bucket", "_of")


def _seconds(df: DataFrame, column: str) -> Column:
    """A time as seconds: of local times, by their own calendar, as moments would jump at a change of clocks."""
    t = F.col(column)
    if dict(df.dtypes)[column] != "timestamp_ntz":
        return F.unix_seconds(t.cast("timestamp"))
    return F.datediff(F.to_date(t), F.lit("1970-01-01").cast("date")).cast("long") * 86400 + F.hour(t) * 3600 + F.minute(t) * 60 + F.second(t)


def source_availability(filled: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """Share of planned slots of the last days with a successful run, per source and (null) in total."""
    inside = (F.col("slot_day") < F.to_date(as_of)) & (F.col("slot_day") >= F.date_sub(F.to_date(as_of), days))
    ok = F.coalesce(F.col("status") == "success", F.lit(False)).cast("int")
    return filled.where(inside).rollup("source_id").agg(F.count(F.lit(1)).alias("n_slots"), F.sum(ok).alias("n_ok"), F.round(F.avg(ok), 4).alias("availability"))


def last_n_slots(slots: DataFrame, n: int = 20) -> DataFrame:
    w = Window.partitionBy("source_id").orderBy(F.desc("slot_day"))
    return slots.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def on_time_rate(filled: DataFrame, on_time: Column, n: int = 20) -> DataFrame:
    """Share of each source's last n planned slots whose run was on time."""
    hit = F.coalesce(on_time, F.lit(False)).cast("int")
    return last_n_slots(filled, n).groupBy("source_id").agg(F.count(F.lit(1)).alias("n_slots"), F.round(F.avg(hit), 4).alias("on_time_rate"))


def streaks(runs: DataFrame, ok: Column, by: str = "source_id", order: tuple[str, ...] = ("started_at", "run_id")) -> DataFrame:
    """Per source the longest run of failures and the one it ends with; order begins with a time.

    A source may hold most runs, so those of each hour are summed up by themselves - failures at the begin, at the end, the longest run of
    them, whether any run succeeded - and the hours are put together in their order.
    """
    rows = runs.select(by, *order, ok.cast("int").alias("_ok")).withColumn("_hour", F.date_trunc("hour", order[0]))
    w = Window.partitionBy(by, "_hour").orderBy(*order)
    islands = rows.withColumn("_island", F.sum("_ok").over(w)).groupBy(by, "_hour", "_island").agg(F.sum(1 - F.col("_ok")).alias("n"))
    n, island = F.coalesce("n", F.lit(0)), F.coalesce("_island", F.lit(0))
    hours = islands.groupBy(by, "_hour").agg(F.max(island).alias("oks"), F.coalesce(F.max(F.when(island == 0, n)), F.lit(0)).alias("first"), F.max_by(n, island).alias("last"), F.max(n).alias("most"))
    ordered = hours.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(F.col("_hour").isNotNull().alias("k"), "_hour", "oks", "first", "last", "most"))).alias("hours"))

    def step(state: Column, x: Column) -> Column:
        run = state["current"] + x["first"]
        return F.struct(F.greatest(state["longest"], run, x["most"]).alias("longest"), F.when(x["oks"] == 0, run).otherwise(x["last"]).alias("current"))

    zero = F.lit(0).cast("long")
    told = ordered.select(by, F.aggregate("hours", F.struct(zero.alias("longest"), zero.alias("current")), step).alias("s"))
    return told.select(by, F.col("s.longest").alias("longest_failures"), F.col("s.current").alias("current_failures"))


def alerts(streaks_: DataFrame, least: int = STREAK_ALERT) -> DataFrame:
    return streaks_.where(F.col("current_failures") >= least).withColumn("proposal", F.lit("disable"))


def overlapping_runs(runs: DataFrame) -> DataFrame:
    """Runs that begin before an earlier one of their source has finished, with busy_until, the latest end of those.

    The latest end within the hour of a run's start, and that of all earlier hours, from a small table of hours: no task holds a source.
    """
    rows = runs.withColumn("_hour", F.date_trunc("hour", "started_at"))
    ends = rows.groupBy("source_id", "_hour").agg(F.max("finished_at").alias("_end"))
    earlier = Window.partitionBy("source_id").orderBy("_hour").rowsBetween(Window.unboundedPreceding, -1)
    before = ends.select(F.col("source_id").alias("_source"), F.col("_hour").alias("_at"), F.max("_end").over(earlier).alias("_before"))
    inside = Window.partitionBy("source_id", "_hour").orderBy("started_at", "run_id").rowsBetween(Window.unboundedPreceding, -1)
    found = rows.withColumn("_inside", F.max("finished_at").over(inside)).join(before, F.col("source_id").eqNullSafe(F.col("_source")) & F.col("_hour").eqNullSafe(F.col("_at")))
    busy = found.withColumn("busy_until", F.greatest("_before", "_inside")).where(F.col("busy_until") >= F.col("started_at"))
    return busy.drop("_hour", "_source", "_at", "_before", "_inside")


def unfinished_runs(runs: DataFrame, as_of: Column, timeout: str) -> DataFrame:
    """Sources whose last run has no end and began longer ago than the timeout."""
    last = runs.groupBy("source_id").agg(F.max_by(F.struct("run_id", "started_at", "finished_at"), F.struct("started_at", "run_id")).alias("r")).select("source_id", "r.*")
    return last.where(F.col("finished_at").isNull() & (F.col("started_at") < as_of - F.expr(f"INTERVAL {timeout}")))


def failed_items(items: DataFrame, key: list[str], order: list[str], failed: Column) -> DataFrame:
    """Items whose last attempt failed, so that no later one has succeeded."""
    last = items.withColumn("_failed", failed).groupBy(*key).agg(F.max_by("_failed", F.struct(*order)).alias("_failed"), F.count(F.lit(1)).alias("attempts"))
    return last.where("_failed").drop("_failed")


def failure_classes(items: DataFrame) -> DataFrame:
    return items.where(F.col("error_class").isNotNull()).groupBy("error_class").agg(F.count(F.lit(1)).alias("n"))


def undelivered(reports: DataFrame, notifications: DataFrame, channels: list[str]) -> DataFrame:
    """(report_id, channel) without a success."""
    wanted = reports.select("report_id").distinct().withColumn("channel", F.explode(F.array(*map(F.lit, channels))))
    return wanted.join(notifications.where(F.col("status") == "success").select("report_id", "channel"), ["report_id", "channel"], "left_anti")


def delivery_attempts(notifications: DataFrame, cap: int) -> DataFrame:
    """Per (report_id, channel): attempts, delivered, and state: delivered, retry or permanent."""
    counted = notifications.groupBy("report_id", "channel").agg(F.count(F.lit(1)).alias("attempts"), F.max((F.col("status") == "success")).alias("delivered"), F.max("sent_at").alias("last_sent"))
    return counted.withColumn("state", F.when(F.col("delivered"), "delivered").when(F.col("attempts") < cap, "retry").otherwise("permanent"))


def delivery_list(reports: DataFrame, notifications: DataFrame, channels: list[str], cap: int, base_s: int = 60) -> DataFrame:
    """What to send: undelivered, with attempts so far, when to try next, and permanent failures shown as such."""
    tried = delivery_attempts(notifications, cap).select("report_id", "channel", "attempts", "last_sent", "state")
    out = undelivered(reports, notifications, channels).join(tried, ["report_id", "channel"], "left")
    n = F.coalesce("attempts", F.lit(0))
    due = F.when((n > 0) & (n < cap), F.col("last_sent") + F.make_dt_interval(secs=(base_s * F.pow(F.lit(2), n - 1)).cast("decimal(18,6)")))
    return out.select("report_id", "channel", n.cast("long").alias("attempts"), due.alias("next_attempt"), F.coalesce("state", F.lit("new")).alias("state"))


def stage_trace(stage_log: DataFrame, stages: list[str]) -> DataFrame:
    return stage_log.groupBy("scheduled_at").pivot("stage", stages).agg(F.min("id"))
