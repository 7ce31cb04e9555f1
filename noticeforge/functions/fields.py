"""Fields of notices by labels and dictionaries, and what fetch results mean."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Degrees as written -> degree and its order.
EDUCATION = (("博士研究生", "doctor", 5), ("博士", "doctor", 5), ("硕士研究生", "master", 4), ("硕士", "master", 4), ("研究生", "master", 4), ("本科", "bachelor", 3), ("学士", "bachelor", 3), ("大专", "college", 2), ("专科", "college", 2), ("高中", "school", 1), ("中专", "school", 1))
RETRY_CAP, RETRY_BASE_S = 3, 60


def normalize_enum(x: Column, names: tuple[tuple[str, str, int], ...] = EDUCATION) -> Column:
    """{raw, norm, order} of the least of the names that the text asks for; norm is null without any.

    Of names within names the longest counts. What is only preferred ("... 优先") isn't asked for, nor is the stage or school of a degree.
    """
    known = "|".join(sorted((n for n, _, _ in names), key=len, reverse=True))
    asked = F.regexp_replace(x, f"(?:{known})[^，,。；;、\\n]{{0,8}}优先|(?:{known})(?:阶段|期间|院校|毕业院校|就读)", " ")
    rank = F.create_map(*(F.lit(v) for n, _, number in names for v in (n, number)))
    value = F.create_map(*(F.lit(v) for number, norm in {number: norm for _, norm, number in names}.items() for v in (number, norm)))
    order = F.array_min(F.transform(F.regexp_extract_all(asked, F.lit(f"({known})"), F.lit(1)), lambda n: F.element_at(rank, n)))
    return F.struct(x.alias("raw"), F.element_at(value, order).alias("norm"), order.alias("order"))


def _labelled(x: Column, labels: str, value: str) -> Column:
    return F.nullif(F.trim(F.regexp_extract(x, f"{labels}\\s*[:：]\\s*({value})", 1)), F.lit(""))


def extract_org(x: Column) -> Column:
    return F.coalesce(_labelled(x, "(?:招聘单位|招录机关|单位名称|Organi[sz]ation)", "[^\\n,，。;；]{2,60}"), F.nullif(F.regexp_extract(x, "([\\p{IsHan}]{2,30}(?:公司|大学|学院|研究院|委员会|局|银行|医院))", 1), F.lit("")))


def extract_apply_url(x: Column) -> Column:
    return F.nullif(F.regexp_extract(x, "(https?://[^\\s\"'<>，。；）)]+)", 1), F.lit(""))


#: What stands before the number of people wanted.
HEADCOUNT_LABELS = "招聘人数|招录人数|需求人数|计划人数|岗位数|人数|名额|招聘|招录|招收|录用|拟聘|引进"
_COUNT = "[0-9零一二两三四五六七八九十百]+"


def whole_number(x: Column) -> Column:
    """Digits, or Chinese numerals below a thousand, as a number; else null."""
    part = lambda unit: F.translate(F.regexp_extract(x, f"([一二两三四五六七八九]?){unit}", 1), "一二两三四五六七八九", "1223456789")
    of = lambda unit, times: F.when(F.contains(x, F.lit(unit)), F.coalesce(part(unit).try_cast("int"), F.lit(1)) * times).otherwise(0)
    ones = F.coalesce(F.translate(F.regexp_extract(x, "([一二两三四五六七八九])$", 1), "一二两三四五六七八九", "1223456789").try_cast("int"), F.lit(0))
    return F.when(x.rlike("^[0-9]+$"), x.try_cast("int")).when(x.rlike("^[零一二两三四五六七八九十百]+$"), of("百", 100) + of("十", 10) + ones)


def extract_headcount(x: Column) -> Column:
    """The number of people that a label names, else the first number of people that is no place in a ranking ("前3名")."""
    plain = F.translate(x, "０１２３４５６７８９", "0123456789")
    labelled = F.regexp_extract(plain, f"(?:{HEADCOUNT_LABELS})[^0-9零一二两三四五六七八九十百，,。；;\\n]{{0,10}}({_COUNT})\\s*(?:人|名|个)?(?![0-9零一二两三四五六七八九十百]|\\s*(?:年|月|日|号|元|岁|%))", 1)
    other = F.regexp_extract(plain, f"(?<![前第0-9零一二两三四五六七八九十百])({_COUNT})\\s*(?:人|名)(?!次)", 1)
    return F.coalesce(whole_number(F.nullif(labelled, F.lit(""))), whole_number(F.nullif(other, F.lit(""))))


def classify_fetch(status: Column) -> Column:
    """ok, unchanged, retry (429 and 5xx, or no answer), or final (other 4xx)."""
    return F.when(status.isNull() | (status == 429) | status.between(500, 599), "retry").when(status == 304, "unchanged").when(status.between(400, 499), "final").otherwise("ok")


def next_attempt(last: Column, status: Column, attempts: Column, base_s: int = RETRY_BASE_S, cap: int = RETRY_CAP) -> Column:
    """When to try again: base * 2 ** (attempts - 1) seconds after the last attempt; null if done or at the cap."""
    wait = F.make_dt_interval(secs=(base_s * F.pow(F.lit(2), attempts - 1)).cast("decimal(18,6)"))
    return F.when((classify_fetch(status) == "retry") & (attempts < cap), last + wait)
