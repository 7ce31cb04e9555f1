"""Dates of notices and zones: UTC inside, local outside."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZONE = "Asia/Shanghai"
#: What notices call the begin and the end of a time, and what stands between the two.
START_LABELS, END_LABELS = "报名开始|开始时间|报名时间|自|from", "报名截止|截止时间|截止日期|截止|至|until"
_BETWEEN = "(?:起|开始)?\\s*(?:至|到|-|—|–|~)+\\s*"
#: Halves of the day: those after noon, noon, and the others.
_PM, _NOON, _AM = "下午|晚上|晚", "中午", "上午|早上|早|凌晨"
_N = "[0-9〇零一二三四五六七八九十]"
_DAY = f"(?:(?:({_N}{{4}})\\s*[年/.-]\\s*)?({_N}{{1,3}})\\s*[月/.-]\\s*)?({_N}{{1,3}})(?![0-9])\\s*[日号]?(?:\\s*[（(][^）)0-9]{{1,6}}[）)])?"
_CLOCK = f"(?:\\s*T?({_PM}|{_NOON}|{_AM})?\\s*({_N}{{1,3}})(?:\\s*:\\s*([0-9]{{2}})(?![0-9])(?::[0-9]{{2}})?|\\s*[时点](?:\\s*(半|整|{_N}{{1,3}})(?!{_N}|\\s*[年月日号])\\s*分?)?))"
#: A first date has its year, or its month and 月 with 日 or 号; a second one may be a day with 日 or 号 or a clock alone.
_IS_DATE = f"(?={_N}{{4}}\\s*[年/.-]|{_N}{{1,3}}\\s*月\\s*{_N}{{1,3}}\\s*[日号])"
_IS_END = f"(?={_N}{{4}}\\s*[年/.-]\\s*{_N}{{1,3}}\\s*[月/.-]|{_N}{{1,3}}\\s*月\\s*{_N}{{1,3}}|{_N}{{1,3}}\\s*[日号])"
_TAIL = "(?:\\s*(起|止|截止|之前|以前|前))?"
#: A written time: 1 labels before it, 2-4 its year, month and day, 5-8 its clock, 9 what is between, 10-12 and 13-16 the same of its end, 17 what follows it.
_RANGE = f"(?i)((?:(?:{START_LABELS}|{END_LABELS})[^0-9。；;\\n]{{0,12}}?)?){_IS_DATE}{_DAY}{_CLOCK}?(?:({_BETWEEN})(?:{_IS_END}{_DAY}{_CLOCK}?|{_CLOCK}))?{_TAIL}"


def to_utc(x: Column, zone: str = ZONE) -> Column:
    return F.convert_timezone(F.lit(zone), F.lit("UTC"), x)


def to_local(x: Column, zone: str = ZONE) -> Column:
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), x)


def _plain(x: Column) -> Column:
    """Full-width digits, marks and spaces as those of ASCII."""
    return F.translate(x, "０１２３４５６７８９：／－．～\u3000\u00a0", "0123456789:/-.~  ")


def _number(x: Column) -> Column:
    """A whole number of digits or Chinese numerals up to 99 (years digit by digit), else null."""
    x = F.translate(x, "〇零一二三四五六七八九", "00123456789")
    for pattern, value in (("([0-9])十([0-9])", "$1$2"), ("([0-9])十", "$10"), ("十([0-9])", "1$1"), ("十", "10")):
        x = F.regexp_replace(x, pattern, value)
    return x.try_cast("int")


def _cut(match: Column) -> Column:
    """A written time with the groups of _RANGE, from one run of the pattern."""
    groups = "\x01".join(f"${k}" for k in range(1, 22))
    return F.struct(match.alias("raw"), F.split(F.regexp_replace(match, f"^{_RANGE}$", groups), "\x01").alias("groups"))


def _parts(cut: Column) -> Column:
    """The parts of a written time as numbers and words; null where a part isn't there."""
    match, part = cut["raw"], lambda k: F.nullif(F.get(cut["groups"], F.lit(k - 1)), F.lit(""))

    def side(day: int, clock: int, other: int | None) -> Column:
        clocks = [clock] if other is None else [clock, other]
        of = lambda k: F.coalesce(*(part(c + k) for c in clocks))
        half, hour = of(0), _number(of(1))
        written = F.coalesce(of(2), F.when(of(3) == "半", "30").when(of(3) == "整", "0").otherwise(of(3)))
        minute = F.when(written.isNull(), 0).otherwise(_number(written))
        return F.struct(_number(part(day)).alias("year"), _number(part(day + 1)).alias("month"), _number(part(day + 2)).alias("day"), half.alias("half"), hour.alias("hour"), minute.alias("minute"))

    label = F.lower(F.nullif(F.regexp_extract(part(1), f"(?i).*({START_LABELS}|{END_LABELS})", 1), F.lit("")))
    return F.struct(match.alias("raw"), label.alias("label"), side(2, 5, None).alias("a"), part(9).isNotNull().alias("ranged"), side(10, 13, 17).alias("b"), part(21).alias("tail"))


def _hour(x: Column, half: Column) -> Column:
    """The hour of the day, 24 for its end."""
    late = F.when((x == 12) & half.startswith("晚"), 24).when(x < 12, x + 12).otherwise(x)
    noon = F.when(x < 11, x + 12).otherwise(x)
    return F.when(half.rlike(_PM), late).when(half == _NOON, noon).when((half == "凌晨") & (x == 12), 0).otherwise(x)


def _moment(year: Column, month: Column, day: Column, hour: Column, minute: Column) -> Column:
    at = lambda h, m: F.try_make_timestamp(year, month, day, h, m, F.lit(0))
    h, m = F.coalesce(hour, F.lit(0)), F.coalesce(minute, F.lit(0))
    return F.when((h == 24) & (m == 0), at(F.lit(0), F.lit(0)) + F.expr("INTERVAL 1 DAY")).otherwise(at(h, m))


def extract_dates(x: Column, published: Column | None = None) -> Column:
    """Array of {raw, at, clock, role, labelled} of every written date in order, the begin and the end of a time each by itself.

    Dates are read one after another: one without a year takes that of the date before it, else of `published`, and the end of a time what it
    leaves out of its begin (an earlier month is the next year's; a clock alone is the same day's, and after noon if the begin is). 24:00 is the next
    day. at is null for impossible dates and unknown years. clock: it has a time of day; role: start, end or null; labelled: by a word before it.
    """
    matches = F.transform(F.transform(F.regexp_extract_all(_plain(x), F.lit(f"({_RANGE})"), F.lit(1)), _cut), _parts)
    known = F.year(published) if published is not None else F.lit(None).cast("int")
    entry = "struct<raw:string,at:timestamp,clock:boolean,role:string,labelled:boolean>"

    def step(state: Column, m: Column) -> Column:
        a, b = m["a"], m["b"]
        year = F.coalesce(a["year"], state["year"])
        first_hour = _hour(a["hour"], F.coalesce(a["half"], F.lit("")))
        same_day = b["day"].isNull()
        month = F.coalesce(b["month"], a["month"])
        next_year = F.when(b["year"].isNull() & (month < a["month"]), year + 1).otherwise(F.coalesce(b["year"], year))
        half = F.coalesce(b["half"], F.when(same_day, a["half"]), F.lit(""))
        begin = _moment(year, a["month"], a["day"], first_hour, a["minute"])
        end = _moment(next_year, month, F.coalesce(b["day"], a["day"]), _hour(b["hour"], half), b["minute"])
        is_end = m["label"].rlike(f"^(?:{END_LABELS})$") | m["tail"].isin("止", "截止", "之前", "以前", "前")
        role = F.when(m["ranged"], "start").when(F.coalesce(is_end, F.lit(False)), "end").when(m["label"].isNotNull() | (m["tail"] == "起"), "start")
        labelled = m["label"].isNotNull() | F.coalesce(~m["ranged"] & m["tail"].isNotNull(), F.lit(False))
        one = lambda at, clock, r: F.struct(m["raw"].alias("raw"), at.alias("at"), clock.isNotNull().alias("clock"), r.alias("role"), labelled.alias("labelled")).cast(entry)
        both = F.when(m["ranged"], F.array(one(begin, a["hour"], role), one(end, b["hour"], F.lit("end")))).otherwise(F.array(one(begin, a["hour"], role)))
        return F.struct(F.coalesce(F.when(m["ranged"], next_year), year).alias("year"), F.concat(state["dates"], both).alias("dates"))

    start = F.struct(known.alias("year"), F.array().cast(f"array<{entry}>").alias("dates"))
    return F.aggregate(matches, start, step, lambda state: state["dates"])


def read_date(x: Column, published: Column | None = None) -> Column:
    """The moment that one written date names, else null. Without a year, that of `published` counts; without that, null."""
    return F.get(extract_dates(x, published), F.lit(0))["at"]


def start_deadline(x: Column, published: Column | None = None) -> Column:
    """{start_at, deadline}: of dates in order the first that a label calls one, else the first begin or end of a time, else of two or more dates the earliest and the
    latest. A deadline without a clock ends with its day, at 23:59:59."""
    return F.get(F.transform(F.array(extract_dates(x, published)), _of_dates), F.lit(0))  # the dates are read once


def _of_dates(dates: Column) -> Column:
    known = F.filter(dates, lambda d: d["at"].isNotNull())

    def first(role: str) -> Column:
        own = F.filter(known, lambda d: d["role"] == role)
        return F.coalesce(F.get(F.filter(own, lambda d: d["labelled"]), F.lit(0)), F.get(own, F.lit(0)))

    ordered = F.array_sort(F.transform(known, lambda d: F.struct(d["at"].alias("at"), d["clock"].alias("clock"))))
    two = F.size(ordered) >= 2
    start, end = first("start"), first("end")
    plain = start.isNull() & end.isNull() & two
    last = F.get(ordered, F.size(ordered) - 1)
    closes = lambda at, clock: F.when(clock, at).otherwise(at + F.expr("INTERVAL '23:59:59' HOUR TO SECOND"))
    deadline = F.when(plain, closes(last["at"], last["clock"])).otherwise(closes(end["at"], end["clock"]))
    return F.struct(F.when(plain, F.get(ordered, F.lit(0))["at"]).otherwise(start["at"]).alias("start_at"), deadline.alias("deadline"))
