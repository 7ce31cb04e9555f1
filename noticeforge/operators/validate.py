"""Checks of posts and positions, review states, evidence gaps and strict extraction JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def validate(rows: DataFrame, rules: dict[str, tuple[Column, str]], keys: list[str]) -> DataFrame:
    """One row per broken rule: keys, reason, severity. rules: reason -> (what breaks it, severity)."""
    found = F.array(*(F.when(broken, F.struct(F.lit(reason).alias("reason"), F.lit(severity).alias("severity"))) for reason, (broken, severity) in rules.items()))
    return rows.select(*keys, F.explode(F.filter(found, lambda x: x.isNotNull())).alias("x")).select(*keys, "x.reason", "x.severity")


def time_and_presence_rules(max_headcount: int = 45) -> dict[str, tuple[Column, str]]:
    return {
        "missing_position": (F.col("position_id").isNull(), "error"),
        "missing_deadline": (F.col("deadline").isNull(), "error"),
        "deadline_before_start": (F.col("deadline") < F.col("start_at"), "error"),
        "large_headcount": (F.col("headcount") > max_headcount, "warning"),
    }


def post_rules(categories: list[str], link: str = "link") -> dict[str, tuple[Column, str]]:
    """Rules on the link and the category of a post, and on fields in conflict (a column `conflict`)."""
    return {"bad_link": (link_rule(link), "error"), "unknown_category": (enum_rule("category", categories), "warning"), "conflict": (F.col("conflict"), "error")}


def enum_rule(column: str, known: list[str]) -> Column:
    return F.col(column).isNotNull() & ~F.col(column).isin(known)


def link_rule(column: str) -> Column:
    return F.col(column).isNull() | ~F.col(column).rlike(r"^https?://[^\s/]+")


def review_queue(checks: DataFrame, decisions: DataFrame, keys: list[str]) -> DataFrame:
    """Checks with the state that a decision on them gave, else open."""
    return checks.join(decisions.select(*keys, "reason", "state"), [*keys, "reason"], "left").withColumn("state", F.coalesce("state", F.lit("open")))


def review_reasons(checks: DataFrame) -> DataFrame:
    return checks.groupBy("reason", "severity").agg(F.count(F.lit(1)).alias("n"))


def evidence_gaps(entities: DataFrame, evidence: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field_name) of required fields without any evidence."""
    needed = entities.select(key).distinct().withColumn("field_name", F.explode(F.array(*map(F.lit, fields))))
    return needed.join(evidence.select(key, "field_name"), [key, "field_name"], "left_anti")


def require_evidence(value: Column, evidence: Column) -> Column:
    """No evidence, no value."""
    return F.when(evidence.isNotNull(), value)


def parse_extraction(df: DataFrame, body: str, ddl: str, required: list[str]) -> DataFrame:
    """df with `parsed` and `problem`: malformed, wrong_type, missing_field, extra_field or null if all is right."""
    corrupt = "_corrupt"
    parsed = F.from_json(F.col(body), f"{ddl}, {corrupt} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": corrupt})
    keys = F.json_object_keys(body)
    known = [x.strip().split()[0] for x in ddl.split(",")]
    out = df.withColumn("parsed", parsed)
    problem = (
        F.when(F.col(body).isNull() | keys.isNull(), "malformed")
        .when(F.col(f"parsed.{corrupt}").isNotNull(), "wrong_type")
        .when(F.size(F.array_except(F.array(*map(F.lit, required)), keys)) > 0, "missing_field")
        .when(F.exists(F.array(*(F.col(f"parsed.{c}").isNull() for c in required)), lambda x: x), "missing_field")
        .when(F.size(F.array_except(keys, F.array(*map(F.lit, known)))) > 0, "extra_field")
    )
    return out.withColumn("problem", problem).withColumn("parsed", F.col("parsed").dropFields(corrupt))


def validate_prefs(prefs: DataFrame, allowed: dict[str, list[str]]) -> DataFrame:
    """prefs with `problems`: columns whose list is null or holds a value that isn't allowed."""
    tests = [F.when(F.col(c).isNull() | (F.size(F.array_except(F.col(c), F.array(*map(F.lit, values)))) > 0), F.lit(c)) for c, values in allowed.items()]
    return prefs.withColumn("problems", F.filter(F.array(*tests), lambda x: x.isNotNull()))
