"""Daily reports: four groups, ranked lines, rendered text, a spine for empty reports, and delivery lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noticeforge.operators.scoring import severe
from noticeforge.sources.folders import staged

GROUPS = ("to_confirm", "closing_soon", "priority", "new_today")
MIN_SCORE, CLOSING_HOURS = 60.0, 72
#: Ranks of a group that a part of a report takes, and after which the packing of messages starts anew.
LINES_PER_PART, LINES_PER_BLOCK = 1_000, 500
#: Ids of the first tie-break that are ranked together.
IDS_PER_SLICE = 1 << 16


def posts_with_positions(posts: DataFrame, positions: DataFrame) -> DataFrame:
    """Every post, with its positions or once without any."""
    return posts.join(positions, "post_id", "left")


def with_facts(posts: DataFrame, first_seen: DataFrame, conflicts: DataFrame, failed_tables: DataFrame) -> DataFrame:
    """posts with first_seen (post_id, first_seen), conflict and table_failed, for posts that the other tables name."""
    named = lambda df, flag: df.select("post_id").distinct().withColumn(flag, F.lit(True))
    out = posts.join(first_seen.select("post_id", "first_seen"), "post_id", "left")
    for df, flag in ((conflicts, "conflict"), (failed_tables, "table_failed")):
        out = out.join(named(df, flag), "post_id", "left").withColumn(flag, F.coalesce(flag, F.lit(False)))
    return out


def failed_tables(attachments: DataFrame) -> DataFrame:
    """post_id of attachments with a table of positions that couldn't be parsed."""
    return attachments.where((F.col("kind") == "positions") & (F.col("parse_status") != "ok")).select("post_id").distinct()


def report_group(as_of: Column, min_score: float = MIN_SCORE, closing_hours: int = CLOSING_HOURS, columns: list[str] | tuple[str, ...] = ()) -> Column:
    """The first group that a scored row belongs to; null if none.

    columns: those of the rows. With conflict and table_failed, such rows are to be confirmed; with first_seen, new is what was discovered on the day,
    else what starts on it.
    """
    unsure = severe(F.col("position_id"), F.col("start_at"), F.col("deadline"))
    for flag in ("conflict", "table_failed"):
        if flag in columns:
            unsure = unsure | F.coalesce(F.col(flag), F.lit(False))
    discovered = F.col("first_seen" if "first_seen" in columns else "start_at")
    closing = (F.col("deadline") > as_of) & (F.col("deadline") <= as_of + F.expr(f"INTERVAL {closing_hours} HOURS"))
    window_open = (F.col("start_at") <= as_of) & (F.col("deadline") > as_of)
    return (
        F.when(unsure, "to_confirm")
        .when(closing, "closing_soon")
        .when((F.col("score") >= min_score) & window_open, "priority")
        .when(F.to_date(discovered) == F.to_date(as_of), "new_today")
    )


def in_groups(scored: DataFrame, as_of: Column, min_score: float = MIN_SCORE) -> DataFrame:
    """Rows that the hard filter passed and that a group takes, with report_group."""
    return scored.where(F.col("passed")).withColumn("report_group", report_group(as_of, min_score, columns=scored.columns)).where(F.col("report_group").isNotNull())


def report_groups(scored: DataFrame, as_of: Column, tie_breaks: list[str], min_score: float = MIN_SCORE) -> DataFrame:
    """The rows of in_groups(), without components, with their rank in the group for each preference. They are written once, as ranks read them twice."""
    rows = staged(in_groups(scored, as_of, min_score).drop("components"))
    return ranked(rows, ["pref_id", "report_group"], tie_breaks)


def ranked(rows: DataFrame, partition: list[str], tie_breaks: list[str], ids_per_slice: int = IDS_PER_SLICE) -> DataFrame:
    """rows with their rank in the stable order within each partition, without one task for a whole partition.

    A partition may hold most rows, and so may one score and deadline in it (posts without a position). The rows of each (score,
    deadline, slice of the first tie-break) are numbered by themselves, and the numbers of rows of better levels, summed over a
    small table of the levels, are added. Slices need a whole number as first tie-break; another one is a single slice.
    """
    first = tie_breaks[0] if tie_breaks and dict(rows.dtypes)[tie_breaks[0]] in ("int", "bigint") else None
    rows = rows.withColumn("_slice", F.floor(F.col(first) / ids_per_slice) if first else F.lit(0))
    level = [*partition, "score", "deadline", "_slice"]
    sizes = rows.groupBy(*level).agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy(*partition).orderBy(*stable_order(["_slice"])).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*(F.col(c).alias(f"_{c}") for c in level), F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    same = F.lit(True)
    for c in level:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    inside = Window.partitionBy(*level).orderBy(*(F.asc(c) for c in tie_breaks))
    numbered = rows.withColumn("_number", F.row_number().over(inside)).join(offsets, same)
    return numbered.withColumn("rank", (F.col("_before") + F.col("_number")).cast("int")).drop("_number", "_before", "_slice", *(f"_{c}" for c in level))


def stable_order(tie_breaks: list[str]) -> list[Column]:
    """Score down, deadline up with unknown last, then the tie-breaks."""
    return [F.desc("score"), F.asc_nulls_last("deadline"), *(F.asc(c) for c in tie_breaks)]


def report_order(rows: DataFrame, tie_breaks: list[str]) -> DataFrame:
    return rows.orderBy(*stable_order(tie_breaks))


def top_k(rows: DataFrame, k: int, tie_breaks: list[str]) -> DataFrame:
    return report_order(rows, tie_breaks).limit(k)


def top_n(rows: DataFrame, partition: list[str], n: int, tie_breaks: list[str]) -> DataFrame:
    """The first n rows of each partition in the stable order, with their rank."""
    order = Window.partitionBy(*partition).orderBy(*stable_order(tie_breaks))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def report_lines(grouped: DataFrame, link: Column, original: Column | None = None) -> DataFrame:
    """pref_id, report_group, rank and the line: title, organisation, region, deadline, reason, risks, the link to apply and, if there is one, that of the original."""
    flagged = lambda flag, told: [F.when(F.col(flag), told)] if flag in grouped.columns else []
    unknown = lambda c: F.coalesce(c, F.lit("?"))
    risks = F.filter(F.array(F.when(F.col("position_id").isNull(), "no position"), F.when(F.col("deadline").isNull(), "no deadline"), F.when(F.col("deadline") < F.col("start_at"), "deadline before start"), F.when(F.col("region").isNull(), "no region"), *flagged("conflict", "fields in conflict"), *flagged("table_failed", "table not parsed")), lambda r: r.isNotNull())
    line = F.concat_ws(
        " | ",
        unknown(F.col("name")),
        unknown(F.col("organization")),
        unknown(F.col("region")),
        unknown(F.date_format("deadline", "yyyy-MM-dd")),
        F.array_join("matched_rules", "+"),
        F.when(F.size(risks) > 0, F.concat(F.lit("check: "), F.array_join(risks, ", "))),
        link,
        *([] if original is None else [F.concat(F.lit("original: "), original)]),
    )
    return grouped.select("pref_id", "report_group", "rank", line.alias("line"))


def report_counts(grouped: DataFrame) -> DataFrame:
    return grouped.groupBy("pref_id", "report_group").agg(F.count(F.lit(1)).alias("n_items"))


def escape_html(x: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        x = F.replace(x, F.lit(raw), F.lit(safe))
    return x


def render_report(lines: DataFrame, form: str, keys: list[str] | None = None, per_part: int = LINES_PER_PART) -> DataFrame:
    """The parts of each report (pref_id, report_date): report_group, part, format, content, item_count; a part holds up to per_part ranks of a group, so that no row
    holds a whole report. In order of group and part they are its text; the first one of a group has its title if it has the group's first line."""
    keys = keys or ["pref_id", "report_date"]
    part = F.floor((F.col("rank") - 1) / per_part).cast("int").alias("part")
    collected = lines.groupBy(*keys, "report_group", part).agg(F.array_sort(F.collect_list(F.struct("rank", "line"))).alias("rows"))
    texts = F.transform("rows", lambda x: x["line"])
    opens = F.col("part") == 0
    if form == "markdown":
        title, content = F.concat(F.lit("## "), F.col("report_group"), F.lit("\n")), F.array_join(F.transform(texts, lambda x: F.concat(F.lit("- "), x)), "\n")
    elif form == "html":
        title, content = F.concat(F.lit("<h2>"), escape_html(F.col("report_group")), F.lit("</h2>")), F.array_join(F.transform(texts, lambda x: F.concat(F.lit("<p>"), escape_html(x), F.lit("</p>"))), "")
    else:
        raise ValueError(f"unknown format {form}")
    return collected.select(*keys, "report_group", "part", F.lit(form).alias("format"), F.concat(F.when(opens, title).otherwise(""), content).alias("content"), F.size("rows").cast("long").alias("item_count"))


def report_spine(prefs: DataFrame, dates: DataFrame, rendered: DataFrame, forms: tuple[str, ...] = ("markdown", "html"), empty: str = "No positions today.") -> DataFrame:
    """The parts of a report for each preference, date and format; without lines there is one, which says so."""
    spine = prefs.select("pref_id").distinct().crossJoin(dates.select("report_date").distinct()).withColumn("format", F.explode(F.array(*map(F.lit, forms))))
    joined = spine.join(rendered, ["pref_id", "report_date", "format"], "left")
    return joined.select("pref_id", "report_date", "format", "report_group", F.coalesce("part", F.lit(0)).alias("part"), F.coalesce("content", F.lit(empty)).alias("content"), F.coalesce("item_count", F.lit(0)).cast("long").alias("item_count"))


def write_reports(reports: DataFrame, path: str) -> None:
    """Replace only the dates and formats written."""
    reports.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("report_date", "format").parquet(path)


def generate_report(scored: DataFrame, prefs: DataFrame, report_date: Column, as_of: Column, tie_breaks: list[str], path: str, link: Column, original: Column | None = None) -> None:
    """Make the reports of a date from scored rows and write them; the same again for the same input."""
    lines = report_lines(report_groups(scored, as_of, tie_breaks), link, original).withColumn("report_date", report_date)
    rendered = render_report(lines, "markdown").unionByName(render_report(lines, "html"))
    dates = prefs.sparkSession.range(1).select(report_date.alias("report_date"))
    write_reports(report_spine(prefs, dates, rendered), path)


def message_parts(lines: DataFrame, limit: int, keys: list[str], length: str, rank: str = "rank", block: int = LINES_PER_BLOCK) -> DataFrame:
    """lines with `part`, which orders the messages of each key: each takes lines by rank while their lengths sum to at most `limit`.

    Packing is sequential; it starts anew every `block` ranks, so that what one row holds, up to that many lines, is bounded. The lines are carried
    through and not joined back, so that what they come from is made once.
    """
    number = F.floor((F.col(rank) - 1) / block).cast("long")
    line = F.struct(F.col(rank).alias("_r"), F.col(length).cast("long").alias("_n"), *(c for c in lines.columns if c not in keys))
    rows = lines.groupBy(*keys, number.alias("_block")).agg(F.array_sort(F.collect_list(line)).alias("rows"))

    def step(acc: Column, x: Column) -> Column:
        fits = (acc["used"] + x["_n"] <= limit) | (F.size(acc["parts"]) == 0)
        part = F.when(fits, acc["part"]).otherwise(acc["part"] + 1)
        return F.struct(F.when(fits, acc["used"] + x["_n"]).otherwise(x["_n"]).alias("used"), part.alias("part"), F.concat(acc["parts"], F.array(part)).alias("parts"))

    start = F.struct(F.lit(0).cast("long").alias("used"), F.lit(0).cast("long").alias("part"), F.array().cast("array<long>").alias("parts"))
    numbered = rows.select(*keys, "_block", F.explode(F.arrays_zip(F.col("rows"), F.aggregate("rows", start, step)["parts"].alias("parts"))).alias("x"))
    return numbered.select(*(c if c in keys else F.col(f"x.rows.{c}").alias(c) for c in lines.columns), (F.col("_block") * block + F.col("x.parts")).alias("part"))
