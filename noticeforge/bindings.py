"""Views of the driver's tables in the shape of the library's entities; each query on those tables starts here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeforge.operators import identity, merge, reporting
from noticeforge.operators.scoring import over

#: "Now" for positions and for runs: operators never read the clock.
AS_OF, RUNS_AS_OF = "1998-06-15 00:00:00", "2024-01-31 00:00:00"
TIE_BREAKS = ["post_id", "part_id", "supplier_id", "line_number", "price"]

PREFS = [(1, ["ASIA", "EUROPE"], 30, ["STANDARD", "PROMO"], ["widget", "gear"], ["Brand#1", "Brand#2"], ["BUILDING", "MACHINERY"], ["anvil"])]
PREFS_DDL = "pref_id long, regions array<string>, education int, majors array<string>, job_keywords array<string>, requirement_terms array<string>, organization_types array<string>, exclusions array<string>"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def at(moment: str) -> Column:
    return F.lit(moment).cast("timestamp_ntz")


def prefs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PREFS, PREFS_DDL)


def _links(post_id: Column) -> list[Column]:
    """Of the form to apply and of the notice."""
    k = post_id.cast("string")
    return [F.concat(F.lit("https://jobs.example.org/"), k).alias("link"), F.concat(F.lit("https://notices.example.org/"), k, F.lit(".html")).alias("original")]


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = lambda name: table(spark, sf_dir, name)
    joined = read("orders").join(read("customer"), F.col("o_custkey") == F.col("c_custkey")).join(read("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(read("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.select(F.col("o_orderkey").alias("post_id"), F.col("c_name").alias("organization"), F.col("c_mktsegment").alias("category"), F.col("r_name").alias("region"), F.col("o_orderdate").alias("start_at"), *_links(F.col("o_orderkey")))


def position_id() -> Column:
    whole = lambda c: F.col(c).cast("long").cast("string")
    return F.concat_ws("-", whole("l_orderkey"), whole("l_partkey"), whole("l_suppkey"), whole("l_linenumber"), whole("l_quantity"), F.round(F.col("l_extendedprice") * 100).cast("long").cast("string"), F.date_format("l_shipdate", "yyyyMMdd"))


def _position_columns() -> list[Column]:
    return [
        position_id().alias("position_id"),
        F.col("l_orderkey").alias("post_id"),
        F.col("p_name").alias("name"),
        F.col("p_type").alias("major"),
        F.col("p_size").alias("education"),
        F.col("p_brand").alias("requirements"),
        F.col("l_quantity").cast("long").alias("headcount"),
        F.col("l_shipdate").alias("deadline"),
        F.col("l_partkey").alias("part_id"),
        F.col("l_suppkey").alias("supplier_id"),
        F.col("l_linenumber").alias("line_number"),
        F.col("l_extendedprice").alias("price"),
    ]


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return joined.select(*_position_columns())


def visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts that have begun, each with its positions or once without."""
    begun = posts(spark, sf_dir).where(F.col("start_at") <= at(AS_OF))
    return reporting.posts_with_positions(begun, positions(spark, sf_dir))


def open_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of visible() with a position that isn't over. Lines meet posts first, so that only those that stay meet their parts; texts of numbers are made last."""
    begun = posts(spark, sf_dir).where(F.col("start_at") <= at(AS_OF)).drop("link", "original")
    lines = table(spark, sf_dir, "lineitem").join(begun, F.col("l_orderkey") == F.col("post_id")).where(~over(F.col("start_at"), F.col("l_shipdate"), at(AS_OF)))
    joined = lines.drop("post_id").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return joined.select(*_position_columns(), "organization", "category", "region", "start_at", *_links(F.col("l_orderkey")))


def fetches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as notices that were fetched up to two days before their start, and again five days later."""
    begin = F.col("o_orderdate")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("post_id"), F.explode(F.array(begin - F.make_dt_interval(days=(F.col("o_orderkey") % 3).cast("int")), begin + F.expr("INTERVAL 5 DAYS"))).alias("fetched_at"))


def field_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What rules and tables say about a notice's field; one in 97 notices contradicts itself."""
    k = F.col("o_orderkey")
    of = lambda source, value: F.struct(F.lit(source).alias("source_type"), value.alias("norm_value"))
    both = F.explode(F.array(of("rule", F.col("o_orderpriority")), of("table", F.when(k % 97 == 0, "another").otherwise(F.col("o_orderpriority")))))
    return table(spark, sf_dir, "orders").select(k.alias("entity_id"), F.lit("category").alias("field_name"), both.alias("x")).select("entity_id", "field_name", "x.*")


def post_attachments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of positions of each notice; one in 89 couldn't be parsed."""
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(k.alias("post_id"), F.lit("positions").alias("kind"), F.when(k % 89 == 0, "corrupt").otherwise("ok").alias("parse_status"))


def known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """visible() with what is known of the posts: when they were first seen, whether their fields contradict each other, whether a table of theirs failed."""
    seen = identity.first_seen(fetches(spark, sf_dir), ["post_id"], "fetched_at")
    conflicts = merge.conflicts(field_candidates(spark, sf_dir)).select(F.col("entity_id").alias("post_id"))
    begun = posts(spark, sf_dir).where(F.col("start_at") <= at(AS_OF))
    return reporting.posts_with_positions(reporting.with_facts(begun, seen, conflicts, reporting.failed_tables(post_attachments(spark, sf_dir))), positions(spark, sf_dir))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as crawl runs: source_id, run_id, started_at, finished_at (value in minutes later), status, outcome."""
    e = table(spark, sf_dir, "events")
    failed = F.col("event_type") == "error"
    return e.select(F.col("event_id").alias("run_id"), F.col("user_id").alias("source_id"), F.col("ts").alias("started_at"), (F.col("ts") + F.make_dt_interval(mins=F.floor("value").cast("int"))).alias("finished_at"), F.when(failed, "failed").otherwise("success").alias("status"), F.col("event_type").alias("outcome"))


def slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A planned run of every source for each of the 30 days."""
    sources = table(spark, sf_dir, "events").select(F.col("user_id").alias("source_id")).distinct()
    days = F.explode(F.sequence(F.lit("2024-01-01").cast("date"), F.lit("2024-01-30").cast("date")))
    return sources.select("source_id", days.alias("slot_day"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("document_id"), F.col("source").alias("source_id"), F.col("text").alias("raw_text"), "lang", "n_chars")
