"""License scans by ordered signature rules; DataFrame functions only.

A whole text is folded once into its words with single spaces. The keywords of the rules that stand among the words choose
the rules to run; most texts hold none and cost no regex. Those that do get numbers behind their words, so that a match tells its own place. Matches
are word intervals; those that overlap, directly or through others, form a cluster, and within a cluster the rules take their turns by priority: a match stays unless it
overlaps one that stays already, but one that contains others takes their place. So every suppressed match overlaps one that stays.
All of it happens within a row, with no shuffle, in time linear in the text and its matches (quadratic only within a cluster).
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeforge.llm.frames import computed_once, keyed_text
from noticeforge.llm.license_rules import BASE, rules

#: Everything between words; A-Z count as a-z later, by case-insensitive patterns (of ASCII only).
_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Between a word and its number.
_MARK = "\u0002"
#: Matches that are looked at together for the largest end so far.
_BLOCK = 128
_BASE_KEYS = sorted({phrase.split()[0] for phrase, _ in BASE})


def _constant(value: list, kind: str) -> Column:
    """A table of rules as one literal: Catalyst folds it, instead of handling an expression for each cell."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def _spaces(x: Column) -> Column:
    return F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))


def numbered(pattern: str) -> str:
    """A pattern over words as one over numbered words."""
    number = _MARK + "[0-9]+ "
    return pattern.replace(" ?", "\0").replace(" ", number).replace("\0", f"(?:{number})?") + _MARK + "[0-9]+"


def _matches(words: Column, rule: Column) -> Column:
    """Structs of start and minus_end, in order, of all places of the rule's pattern, overlapping ones too."""
    found = F.regexp_extract_all(words, F.concat(F.lit("(?i)(?= ("), rule["pattern"], F.lit(") )")), F.lit(1))
    last = lambda x: F.substring_index(x, _MARK, -1).cast("int")
    return F.transform(found, lambda x: F.struct((last(x) - _spaces(x)).alias("start"), (-1 - last(x)).alias("minus_end"), rule["rank"].alias("rank")))


def _clusters(df: DataFrame, keep: list[str]) -> DataFrame:
    """keep and `clusters` of the matches `found`, which are in order of start: an array of texts "start:minus_end:rank,...".

    Arrays are never appended to, as each step of an aggregate copies what it has: the largest end before each match comes from those of blocks, and
    a text with marks between clusters is split.
    """
    some = F.size("found") > 0
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size("found") - 1) / _BLOCK)), lambda k: F.transform(F.slice("found", (k * _BLOCK + 1).cast("int"), _BLOCK), lambda x: -x["minus_end"]))
    df = computed_once(df, [*keep, "found"], blocks=F.when(some, blocks))
    df = computed_once(df, [*keep, "found", "blocks"], tops=F.transform("blocks", lambda b: F.array_max(b)))
    first = lambda x, k: F.when(k == 0, 0).otherwise(F.array_max(F.slice(x, 1, k)))
    df = computed_once(df, [*keep, "found", "blocks"], before=F.transform("tops", lambda t, k: first(F.col("tops"), k)))
    df = computed_once(df, [*keep, "found"], reach=F.flatten(F.transform("blocks", lambda b, k: F.transform(b, lambda e, i: F.greatest(F.get("before", k), first(b, i))))))
    one = F.transform("found", lambda x, i: F.concat(F.when(x["start"] >= F.get("reach", i), ";").otherwise(","), F.concat_ws(":", x["start"].cast("string"), x["minus_end"].cast("string"), x["rank"].cast("string"))))
    return df.select(*keep, F.when(some, F.split(F.substring(F.array_join(one, ""), F.lit(2), F.lit(1 << 30)), ";")).alias("clusters"))


def _survivors(cluster: Column) -> Column:
    """The matches of a cluster that stay, in order of start, as structs of start, minus_end and rank."""
    part = lambda x, k: F.split(x, ":")[k].cast("int")
    by_rank = F.array_sort(F.transform(F.split(cluster, ","), lambda x: F.struct(part(x, 2).alias("rank"), part(x, 0).alias("start"), part(x, 1).alias("minus_end"))))

    def step(kept: Column, x: Column) -> Column:
        inside = lambda k: (k["start"] >= x["start"]) & (k["minus_end"] >= x["minus_end"]) & ((k["start"] > x["start"]) | (k["minus_end"] > x["minus_end"]))
        touches = lambda k: (k["start"] < -x["minus_end"]) & (-k["minus_end"] > x["start"])
        return F.when(F.exists(kept, lambda k: touches(k) & ~inside(k)), kept).otherwise(F.concat(F.filter(kept, lambda k: ~inside(k)), F.array(x)))

    back = lambda x: F.struct(x["start"].alias("start"), x["minus_end"].alias("minus_end"), x["rank"].alias("rank"))
    return F.array_sort(F.transform(F.aggregate(by_rank, F.slice(by_rank, 1, 0), step), back))


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_words, base (array of {start, label}), detections (array of {start, end, rule, label, weight}).

    Words are numbered from 0; end is the number after the last. A null or empty text has no words and no detections.
    Repeated rows give repeated results, a null id stays null, other columns are ignored, an empty table gives no rows.
    """
    ordered = rules()
    keywords = sorted({k for r in ordered for k in r.keywords} | set(_BASE_KEYS))
    table = _constant([r._asdict() | {"pattern": numbered(r.pattern), "rank": k} for k, r in enumerate(ordered)], "array<struct<keywords:array<string>,pattern:string,rank:int,label:string,weight:double>>")
    words = keyed_text(docs, id_col, text_col).select("id", F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), _GAP, " ")).alias("words"))
    # ascii words of the text are lower-cased for the gate; what lower() does to other letters can only open it more
    gated = words.select("id", "words", F.when(F.col("words") == "", 0).otherwise(_spaces(F.col("words")) + 1).cast("long").alias("n_words"), F.array_intersect(F.split(F.lower("words"), " "), _constant(keywords, "array<string>")).alias("keys"))
    open_ = F.size("keys") > 0
    words_ = F.transform(F.split("words", " "), lambda w, i: F.concat(F.lit(" "), w, F.lit(_MARK), i.cast("string")))
    gated = computed_once(gated, ["id", "n_words", "keys"], words=F.when(open_, F.concat(F.array_join(words_, ""), F.lit(" "))))
    chosen = F.when(open_, F.filter(table, lambda r: F.arrays_overlap(F.col("keys"), r["keywords"])))
    base = _constant([{"keyword": phrase.split()[0], "pattern": numbered(phrase), "rank": 0, "label": label, "weight": 0.0} for phrase, label in BASE], "array<struct<keyword:string,pattern:string,rank:int,label:string,weight:double>>")
    base_found = F.flatten(F.transform(F.filter(base, lambda r: F.array_contains(F.col("keys"), r["keyword"])), lambda r: F.transform(_matches(F.col("words"), r), lambda x: F.struct(x["start"].cast("long").alias("start"), r["label"].alias("label")))))
    found = computed_once(gated, ["id", "n_words"], base=F.when(open_, base_found), found=F.when(open_, F.array_sort(F.flatten(F.transform(chosen, lambda r: _matches(F.col("words"), r))))))
    found = _clusters(found, ["id", "n_words", "base"])
    known = lambda x: F.element_at(table, x["rank"] + 1)
    kept = F.transform(F.flatten(F.transform("clusters", _survivors)), lambda x: F.struct(x["start"].cast("long").alias("start"), (-x["minus_end"]).cast("long").alias("end"), x["rank"].alias("rule"), known(x)["label"].alias("label"), known(x)["weight"].alias("weight")))
    empty = lambda kind: F.array().cast(kind)
    return computed_once(
        found.withColumnRenamed("id", "doc_id"),
        ["doc_id", "n_words"],
        base=F.coalesce("base", empty("array<struct<start:long,label:string>>")),
        detections=F.coalesce(kept, empty("array<struct<start:long,end:long,rule:int,label:string,weight:double>>")),
    )
