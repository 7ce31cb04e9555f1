"""Field candidates of several extractors: one value per field, conflicts, evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from noticeforge.schemas import EVIDENCE_RANK


def all_candidates(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def merge_fields(candidates: DataFrame, priority: tuple[str, ...] = EVIDENCE_RANK, position: str = "position") -> DataFrame:
    """candidates with winner (by source priority, confidence, position; a null value never beats another) and conflict (several
    different normalised values); the losers stay."""
    key = ["entity_id", "field_name"]
    rank = F.array_position(F.array(*map(F.lit, priority)), F.col("source_type"))
    rank = F.when(rank == 0, len(priority) + 1).otherwise(rank)
    order = Window.partitionBy(*key).orderBy(F.col("norm_value").isNull(), rank, F.desc("confidence"), F.asc(position))
    whole = Window.partitionBy(*key)
    low, high = F.min("norm_value").over(whole), F.max("norm_value").over(whole)
    return candidates.withColumn("winner", F.row_number().over(order) == 1).withColumn("conflict", F.coalesce(low != high, F.lit(False)))


def conflicts(candidates: DataFrame) -> DataFrame:
    """entity_id and field_name of the fields for which sources give different values."""
    both = candidates.groupBy("entity_id", "field_name").agg(F.min("norm_value").alias("low"), F.max("norm_value").alias("high"))
    return both.where(F.col("low") != F.col("high")).select("entity_id", "field_name")


def evidence_lists(evidence: DataFrame, key: str, fields: list[str]) -> DataFrame:
    return evidence.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("evidence"))


def llm_usage(calls: DataFrame, by: list[str]) -> DataFrame:
    return calls.groupBy(*by).agg(F.count(F.lit(1)).alias("n_calls"), F.sum("tokens").alias("tokens"), F.sum("cost").alias("cost"))


def admit_calls(calls: DataFrame, budget: float, day: str = "day", order: tuple[str, ...] = ("called_at", "call_id")) -> DataFrame:
    """calls with spent_before (that day) and status: admitted while it is under the budget, else pending.

    A day may hold most calls: those of each minute of order[0], a time, are summed by themselves, and the sums of earlier
    minutes, over a small table of minutes, are added. Calls without a time come first.
    """
    time, *_ = order
    # local times as text, since as moments they would jump at a change of clocks
    minute = F.substring(F.col(time).cast("string"), 1, 16) if dict(calls.dtypes)[time] == "timestamp_ntz" else F.date_trunc("minute", F.col(time))
    rows = calls.withColumn("_minute", minute)
    sums = rows.groupBy(day, "_minute").agg(F.sum("cost").alias("_cost"))
    earlier = Window.partitionBy(day).orderBy("_minute").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(F.col(day).alias("_day"), F.col("_minute").alias("_at"), F.coalesce(F.sum("_cost").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(day, "_minute").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    numbered = rows.withColumn("_inside", F.coalesce(F.sum("cost").over(inside), F.lit(0))).join(offsets, F.col(day).eqNullSafe(F.col("_day")) & F.col("_minute").eqNullSafe(F.col("_at")))
    spent = (F.col("_before") + F.col("_inside")).cast(sums.schema["_cost"].dataType)
    out = numbered.withColumn("spent_before", spent).withColumn("status", F.when(F.col("spent_before") < budget, "admitted").otherwise("pending"))
    return out.drop("_minute", "_inside", "_day", "_at", "_before")
