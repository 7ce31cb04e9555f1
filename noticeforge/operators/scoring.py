"""Matching positions against preferences: a hard filter with reasons, six weighted components with explanations, versions.

Preferences are few rows, but users are not bounded: with_prefs(), which gives all pairs, measures them and broadcasts only up to
BROADCAST_PREFS. Who asks only for scores from a threshold up takes pairing.score_matches(), which makes no other pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BROADCAST_PREFS = 10_000
#: Weights of the rules; they sum to 100.
WEIGHTS = {"region": 25.0, "keyword": 30.0, "major": 15.0, "organization": 10.0, "urgency": 10.0, "completeness": 10.0}
KEY_FIELDS = ("organization", "name", "region", "deadline", "link")
#: Share of the urgency weight by hours left.
URGENCY = ((72, 1.0), (7 * 24, 0.7), (14 * 24, 0.4))
URGENCY_LATER = 0.2


def with_prefs(positions: DataFrame, prefs: DataFrame) -> DataFrame:
    """Every position with every preference row, whose columns get the prefix pref_."""
    named = prefs.select(*(F.col(c).alias(c if c == "pref_id" else f"pref_{c}") for c in prefs.columns))
    if prefs.limit(BROADCAST_PREFS + 1).count() <= BROADCAST_PREFS:
        named = F.broadcast(named)
    return positions.crossJoin(named)


def valid_deadline(start: Column, deadline: Column) -> Column:
    """The deadline, or null if it is before the start."""
    return F.when(start.isNull() | (deadline >= start), deadline)


def over(start: Column, deadline: Column, as_of: Column) -> Column:
    """A valid deadline has passed; unknown ones haven't."""
    return F.coalesce(valid_deadline(start, deadline) <= as_of, F.lit(False))


def severe(position_id: Column, start: Column, deadline: Column) -> Column:
    """No position, no deadline, or one before the start: to be confirmed, never recommended."""
    return position_id.isNull() | valid_deadline(start, deadline).isNull()


def _neutral(values: Column, hit: Column) -> Column:
    """An empty or missing list never filters and gives full marks."""
    return F.coalesce(F.size(values) <= 0, F.lit(True)) | F.coalesce(hit, F.lit(False))


def _named(words: Column, text: Column) -> Column:
    return F.coalesce(F.exists(words, lambda w: F.contains(F.lower(text), F.lower(w))), F.lit(False))


def reject_reasons(as_of: Column) -> Column:
    """Array of the reasons for which a row of with_prefs() is out; unknown education or deadline passes."""
    reasons = F.array(
        F.when(F.col("education") > F.col("pref_education"), "education"),
        F.when(_named(F.col("pref_exclusions"), F.concat_ws(" ", "name", "organization")), "exclusion"),
        F.when(valid_deadline(F.col("start_at"), F.col("deadline")) <= as_of, "expired"),
    )
    return F.filter(reasons, lambda r: r.isNotNull())


def hard_filter(pairs: DataFrame, as_of: Column) -> DataFrame:
    """pairs with `reasons` and `passed`."""
    return pairs.withColumn("reasons", reject_reasons(as_of)).withColumn("passed", F.size("reasons") == 0)


def score_region(region: Column, regions: Column, weight: float = WEIGHTS["region"]) -> Column:
    return F.when(_neutral(regions, F.array_contains(regions, region)), weight).otherwise(0.0)


def score_keyword(name: Column, requirements: Column, keywords: Column, terms: Column, weight: float = WEIGHTS["keyword"]) -> Column:
    """Full in the name, half only in the requirements (a keyword within them, or one of the terms as a word)."""
    inside = _named(keywords, requirements) | F.coalesce(F.arrays_overlap(F.split(requirements, " "), terms), F.lit(False))
    return F.when(_neutral(keywords, _named(keywords, name)), weight).when(inside, weight / 2).otherwise(0.0)


def score_major(major: Column, majors: Column, weight: float = WEIGHTS["major"]) -> Column:
    return F.when(_neutral(majors, F.array_contains(majors, major) | (F.lower(major) == "unrestricted")), weight).otherwise(0.0)


def score_org_type(category: Column, types: Column, weight: float = WEIGHTS["organization"]) -> Column:
    return F.when(_neutral(types, F.array_contains(types, category)), weight).otherwise(0.0)


def score_urgency(deadline: Column, as_of: Column, weight: float = WEIGHTS["urgency"]) -> Column:
    out = F.when(deadline.isNull() | (deadline <= as_of), 0.0)
    for hours, share in URGENCY:
        out = out.when(deadline <= as_of + F.expr(f"INTERVAL {hours} HOURS"), weight * share)
    return out.otherwise(weight * URGENCY_LATER)


def score_completeness(fields: list[Column], weight: float = WEIGHTS["completeness"]) -> Column:
    filled = sum((f.isNotNull().cast("int") for f in fields[1:]), fields[0].isNotNull().cast("int"))
    return filled * (weight / len(fields))


def part_scores(as_of: Column, weights: dict[str, float] = WEIGHTS) -> dict[str, Column]:
    """The column part_<rule> of each rule for a row of with_prefs()."""
    deadline = valid_deadline(F.col("start_at"), F.col("deadline"))
    parts = {
        "region": score_region(F.col("region"), F.col("pref_regions"), weights["region"]),
        "keyword": score_keyword(F.col("name"), F.col("requirements"), F.col("pref_job_keywords"), F.col("pref_requirement_terms"), weights["keyword"]),
        "major": score_major(F.col("major"), F.col("pref_majors"), weights["major"]),
        "organization": score_org_type(F.col("category"), F.col("pref_organization_types"), weights["organization"]),
        "urgency": score_urgency(deadline, as_of, weights["urgency"]),
        "completeness": score_completeness([deadline if c == "deadline" else F.col(c) for c in KEY_FIELDS], weights["completeness"]),
    }
    return {f"part_{rule}": F.round(x.cast("double"), 4) for rule, x in parts.items()}


def components() -> Column:
    """Array of {rule, input, score, explanation} from the part columns; pruned away where nobody asks for it."""
    deadline = valid_deadline(F.col("start_at"), F.col("deadline"))
    text = lambda c: F.coalesce(c.cast("string"), F.lit("unknown"))
    wanted = lambda c: F.concat(F.lit("wanted: "), F.array_join(F.coalesce(F.col(c), F.array().cast("array<string>")), ", "))
    told = {
        "region": (text(F.col("region")), wanted("pref_regions")),
        "keyword": (text(F.col("name")), wanted("pref_job_keywords")),
        "major": (text(F.col("major")), wanted("pref_majors")),
        "organization": (text(F.col("category")), wanted("pref_organization_types")),
        "urgency": (text(F.date_format(deadline, "yyyy-MM-dd")), F.lit("by time left")),
        "completeness": (F.lit(", ".join(KEY_FIELDS)), F.lit("by fields filled")),
    }
    return F.array(*(F.struct(F.lit(rule).alias("rule"), value.alias("input"), F.col(f"part_{rule}").alias("score"), why.alias("explanation")) for rule, (value, why) in told.items()))


def total_score(passed: Column, parts: list[Column]) -> Column:
    """0 if the hard filter rejects, else the sum of the component scores."""
    return F.when(passed, F.round(sum(parts[1:], parts[0]), 4)).otherwise(0.0)


def _checked(weights: dict[str, float]) -> dict[str, float]:
    if abs(sum(weights.values()) - 100) > 1e-9:
        raise ValueError("weights must sum to 100")
    return weights


def _with_totals(scored: DataFrame, as_of: Column) -> DataFrame:
    """scored, which has reasons, passed and the part columns, with score, components, matched_rules and generated_at."""
    matched = F.filter(F.array(*(F.when(F.col(f"part_{rule}") > 0, F.lit(rule)) for rule in WEIGHTS)), lambda r: r.isNotNull())
    return scored.withColumns({"score": total_score(F.col("passed"), [F.col(f"part_{rule}") for rule in WEIGHTS]), "components": components(), "matched_rules": matched, "generated_at": as_of})


def score_positions(positions: DataFrame, prefs: DataFrame, as_of: Column, version: str = "1", weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """All pairs with reasons, passed, part_<rule>, score, components, matched_rules, score_version and generated_at (= as_of)."""
    return score_pairs(hard_filter(with_prefs(positions, prefs), as_of), as_of, version, weights)


def score_pairs(pairs: DataFrame, as_of: Column, version: str = "1", weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """Pairs that hard_filter() gave, scored."""
    scored = pairs.withColumns(part_scores(as_of, _checked(weights)))
    return _with_totals(scored.withColumn("score_version", F.lit(version)), as_of)


def score_versions(positions: DataFrame, prefs: DataFrame, as_of: Column, versions: dict[str, dict[str, float]]) -> DataFrame:
    """The rows of score_positions() for several versions of the weights, from one reading and pairing of the positions."""
    of = lambda version, weights: F.struct(F.lit(version).alias("score_version"), *(x.alias(c) for c, x in part_scores(as_of, _checked(weights)).items()))
    pairs = hard_filter(with_prefs(positions, prefs), as_of).withColumn("_of", F.explode(F.array(*(of(*item) for item in versions.items()))))
    return _with_totals(pairs.select("*", "_of.*").drop("_of"), as_of)


def compared_scores(positions: DataFrame, prefs: DataFrame, as_of: Column, first: dict[str, float], second: dict[str, float]) -> DataFrame:
    """pref_id, position_id, score_1 and score_2 by two weightings, as columns of one row; position_id null without a position."""
    pairs = hard_filter(with_prefs(positions, prefs), as_of)
    total = lambda weights: total_score(F.col("passed"), list(part_scores(as_of, _checked(weights)).values()))
    return pairs.select("pref_id", "position_id", total(first).alias("score_1"), total(second).alias("score_2"))


SEARCHED = ["position_id", "post_id", "name", "organization", "region", "category", "deadline", "score", "components", "matched_rules", "generated_at"]


def store_matches(scored: DataFrame, path: str) -> None:
    """Write the positions that passed, with what searches ask for, in partitions of preference and version, near each other by region and score, so that
    a search reads few row groups. Partitions that the rows name are replaced."""
    rows = scored.where(F.col("passed") & F.col("position_id").isNotNull()).select(*SEARCHED, "pref_id", "score_version")
    near = rows.repartitionByRange("pref_id", "score_version", "region", "score").sortWithinPartitions("pref_id", "score_version", "region", "score")
    near.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("pref_id", "score_version").parquet(path)


def match_results(scored: DataFrame) -> DataFrame:
    """The rows to append to the results table, one per scored position."""
    return scored.where(F.col("position_id").isNotNull()).select("position_id", "pref_id", "score", "score_version", "components", "matched_rules", "generated_at")


def rescore(spark, positions: DataFrame, prefs: DataFrame, as_of: Column, version: str, path: str, weights: dict[str, float] = WEIGHTS) -> None:
    """Score all over again and replace the partitions (pref_id, score_version) of these preferences; one that comes out empty goes."""
    rows = match_results(score_positions(positions, prefs, as_of, version, weights))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("pref_id", "score_version").parquet(path)
    if positions.where(F.col("position_id").isNotNull()).isEmpty():  # all pairs are scored, so without a position no preference has a result
        files = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for r in prefs.select("pref_id").distinct().toLocalIterator():
            files.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/pref_id={r.pref_id}/score_version={version}"), True)


def recommendable(positions: DataFrame, checks: DataFrame, key: str = "position_id") -> DataFrame:
    """Positions without a check of severity error."""
    return positions.join(checks.where(F.col("severity") == "error").select(key).distinct(), key, "left_anti")


def explain_match(matches: DataFrame, position_id: Column | None = None) -> DataFrame:
    """One row per stored component of the matches (of one position)."""
    rows = matches if position_id is None else matches.where(F.col("position_id") == position_id)
    return rows.select("position_id", "pref_id", "score", "score_version", F.explode("components").alias("x")).select("position_id", "pref_id", "score", "score_version", "x.rule", "x.input", F.col("x.score").alias("part"), "x.explanation")
