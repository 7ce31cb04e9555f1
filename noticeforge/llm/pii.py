"""Pseudonyms for personal data by a format-preserving Feistel network; DataFrame functions only.

Found values that pass their checks are replaced by others of the same form. A number or date is read as a point of
its own finite domain (digits of a length, addresses, days of four centuries), split into two parts, and run through
ROUNDS rounds whose round function is keyed SHA-256, each adding to one part modulo its size. That is a permutation of the
domain, so equal values get equal pseudonyms in all documents, however they are written, and different values stay different. Luhn and
IBAN check digits are set anew, so pseudonyms stay valid. Addresses of people and secrets, which have no such domain, get keyed
digests: e-mails a name at an invalid domain, secrets hex digits of their length. Whole texts are rewritten within their row.

| kind | found | check | what is permuted |
|-|-|-|-|
| card | 13 to 19 digits, also in groups of 4 or as 4-6-5 | Luhn | all but the check digit |
| iban | country, 2 digits, as many letters and digits as the country has (others: 11 to 30 digits), also in groups | modulo 97, at most 20 letters | digits among digits and letters among letters, after the first four characters |
| phone | + and 8 to 15 digits with usual separators; (3) 3-4 and 3-3-4 digits | 7 digits or more after the country code | the digits after the country code (+1 where none is written); a (0) stays |
| ssn | 3-2-4 digits | no 000, 666 or 9xx, 00, 0000 | area, group and serial |
| ipv4 | four numbers with dots | each 0 to 255 | both halves |
| date | y-m-d, y/m/d, d.m.y, d/m/y, m/d/y with leading zeros | a day of 1800 to 2199 | the day among those; m/d/y where that reads in one way only, else d/m/y |
| email | address | form | digest |
| secret | token, key, secret or password = 16 or more hex digits or letters and digits (password: 6 or more, a digit among them); keys with a known prefix | form | digest |
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeforge.llm.frames import computed_once

ROUNDS = 10

_BREAK, _NO = r"(?<![0-9A-Za-z])", r"(?![0-9A-Za-z])"
_EMAIL = r"(?<![\p{L}0-9._%+-])[\p{L}0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
_SECRET_NAME = r"(?i:(?:token|key|secret|password|passwd|pwd)\s{0,3}[=:]\s{0,3}[\"']?)"
_KNOWN_KEY = r"(?:AKIA|ASIA|gh[pousr]_|sk-)"
_SECRET = (
    r"(?i:(?:token|key|secret|password|passwd|pwd)\s{0,3}[=:]\s{0,3}[\"']?(?:[0-9a-f]{16,128}|(?=[a-z0-9_+/-]*[0-9])(?=[a-z0-9_+/-]*[a-z])[a-z0-9_+/-]{16,128})(?![0-9A-Za-z]))"
    r"|(?i:(?:password|passwd|pwd)\s{0,3}[=:]\s{0,3}[\"']?(?=[a-z0-9_+/-]*[0-9])[a-z0-9_+/-]{6,15}(?![0-9A-Za-z]))"
    rf"|{_BREAK}{_KNOWN_KEY}[0-9A-Za-z]{{16,128}}{_NO}"
)
_IPV4 = r"(?<![0-9A-Za-z.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9A-Za-z]|\.[0-9])"
_DATE = rf"{_BREAK}(?:[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}|[0-9]{{4}}/[0-9]{{2}}/[0-9]{{2}}|[0-9]{{2}}[./][0-9]{{2}}[./][0-9]{{4}}){_NO}"
_SSN = rf"(?<![0-9A-Za-z-])[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}(?![0-9A-Za-z]|-[0-9])"
#: Lengths of IBANs and the countries that have them.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_IBAN = rf"{_BREAK}(?=[A-Z]{{2}}[0-9]{{2}})(?:" + "|".join(rf"(?:{c.replace(' ', '|')})[0-9]{{2}}(?: ?[0-9A-Z]){{{n - 4}}}" for n, c in IBAN_LENGTHS.items()) + rf"|[A-Z]{{2}}[0-9]{{13,32}}){_NO}"
#: Country codes of one and two digits; all others have three.
_COUNTRY = "^(1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"
_PHONE = r"(?<![0-9A-Za-z+])\+[0-9]{1,3}(?:[ .-]?\(?[0-9]{1,4}\)?){2,6}(?![0-9A-Za-z])|(?<![0-9A-Za-z+.-])(?:\([2-9][0-9]{2}\) ?|[2-9][0-9]{2}[-.])[2-9][0-9]{2}[-.][0-9]{4}(?![0-9A-Za-z]|[-.][0-9])"
_CARD = rf"(?<![0-9A-Za-z.])(?:[0-9]{{4}}[ -][0-9]{{4}}[ -][0-9]{{4}}[ -][0-9]{{1,7}}|[0-9]{{4}}[ -][0-9]{{6}}[ -][0-9]{{5}}|[0-9]{{13,19}}){_NO}"
_ANY = "|".join((_EMAIL, _SECRET, _IPV4, _DATE, _SSN, _IBAN, _PHONE, _CARD))
#: Every value has one of these; texts without any are left as they are at the cost of one scan.
_GATE = r"[0-9@]|gh[pousr]_|sk-|(?i:token|key|secret|password|passwd|pwd)\s{0,3}[=:]"
#: Days of 1800 to 2199: 400 years have 146097 days, which is 189 times 773.
_FIRST_DAY, _DAYS = "1800-01-01", (189, 773)


def _long(x: Column) -> Column:
    return x.try_cast("long")


def _pow10(n: Column) -> Column:
    return F.pow(F.lit(10.0), n).cast("long")


def feistel(left: Column, right: Column, left_size: Column, right_size: Column, tweak: Column, key: str) -> Column:
    """The struct (l, r) to which (left, right) is permuted within its sizes, both of at most 10**18."""

    def f(number: Column, part: Column, size: Column) -> Column:
        digest = F.sha2(F.concat_ws("|", F.lit(key), tweak, number.cast("string"), part.cast("string")), 256)
        return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), size)

    def step(acc: Column, i: Column) -> Column:
        odd = i % 2 == 1
        # a - (size - b) stays within long where a + b might not
        add = lambda a, b, size: F.when(a >= size - b, a - (size - b)).otherwise(a + b)
        return F.struct(F.when(odd, add(acc["l"], f(i, acc["r"], left_size), left_size)).otherwise(acc["l"]).alias("l"), F.when(odd, acc["r"]).otherwise(add(acc["r"], f(i, acc["l"], right_size), right_size)).alias("r"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), F.struct(left.alias("l"), right.alias("r")), step)


def luhn_sum(digits: Column, shift: int) -> Column:
    """The Luhn sum of the digits, each second one doubled; shift 1: the last is doubled."""

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return acc + F.when((i + shift) % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add)


def _rest97(text: Column) -> Column:
    """What digits and letters (A is 10, Z is 35) leave modulo 97."""
    step = lambda acc, c: F.when(c.between("0", "9"), acc * 10 + c.try_cast("int")).otherwise(acc * 100 + F.ascii(c) - 55) % 97
    return F.aggregate(F.split(text, ""), F.lit(0), step)


def _iban_rest(bban: Column, country: Column, check: Column) -> Column:
    return _rest97(F.concat(bban, country, check))


def _refilled(form: Column, chars: Column, low: str = "0", high: str = "9") -> Column:
    """form with its digits (or the characters from low to high) replaced by `chars`, in order."""

    def add(acc: Column, c: Column) -> Column:
        is_slot = c.between(low, high)
        return F.struct(F.concat(acc["s"], F.when(is_slot, F.substring(chars, acc["k"], F.lit(1))).otherwise(c)).alias("s"), (acc["k"] + is_slot.cast("int")).alias("k"))

    return F.aggregate(F.split(form, ""), F.struct(F.lit("").alias("s"), F.lit(1).alias("k")), add)["s"]


def _number26(letters: Column) -> Column:
    return F.when(letters == "", F.lit(0).cast("long")).otherwise(F.aggregate(F.split(letters, ""), F.lit(0).cast("long"), lambda acc, c: acc * 26 + F.ascii(c) - 65))


def _letters26(number: Column, n: Column) -> Column:
    """The number, under 2**53, as n letters."""
    step = lambda acc, i: F.struct(F.concat(F.char(65 + acc["x"] % 26), acc["s"]).alias("s"), F.floor((acc["x"] - acc["x"] % 26) / 26).alias("x"))
    return F.when(n == 0, "").otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.struct(F.lit("").alias("s"), number.alias("x")), step)["s"])


def _half(n: Column) -> Column:
    return F.floor(n / 2).cast("int")


def _ymd(m: Column) -> Column:
    """The date that m writes, else null: d/m/y before m/d/y."""
    day = lambda form: F.try_to_timestamp(m, F.lit(form)).cast("date")
    year_first = m.substr(5, 1).isin("-", "/")
    return F.when(year_first, F.coalesce(*(day(f) for f in ("yyyy-MM-dd", "yyyy/MM/dd")))).otherwise(F.coalesce(*(day(f) for f in ("dd.MM.yyyy", "dd/MM/yyyy", "MM/dd/yyyy"))))


def _read(m: Column) -> Column:
    """kind, form and the two parts of a found value; kind null if it fails its check."""
    digits = F.regexp_replace(F.replace(m, F.lit("(0)"), F.lit("")), "[^0-9]", "")
    n = F.length(digits)
    none = lambda value: F.lit(value).cast("long")

    def halves(d: Column, kind: str, lead: Column, letters: Column | None = None) -> Column:
        k, size = _half(F.length(d)), F.length(d)
        x = F.lit("") if letters is None else letters
        k2, size2 = _half(F.length(x)), F.length(x)
        cut = lambda text, at: (F.substring(text, F.lit(1), at), F.substring(text, at + 1, F.length(text)))
        (left, right), (left2, right2) = cut(d, k), cut(x, k2)
        pow26 = lambda e: F.pow(F.lit(26.0), e).cast("long")
        return F.struct(
            F.lit(kind).alias("kind"), F.coalesce(_long(left), none(0)).alias("l"), F.coalesce(_long(right), none(0)).alias("r"), _pow10(k).alias("ls"), _pow10(size - k).alias("rs"), lead.alias("lead"), size.alias("n"),
            _number26(left2).alias("l2"), _number26(right2).alias("r2"), pow26(k2).alias("ls2"), pow26(size2 - k2).alias("rs2"), size2.alias("n2"),
        )

    def fixed(kind: str, left: Column, right: Column, left_size: int, right_size: int, lead: Column) -> Column:
        return F.struct(
            F.lit(kind).alias("kind"), left.cast("long").alias("l"), right.cast("long").alias("r"), none(left_size).alias("ls"), none(right_size).alias("rs"), lead.alias("lead"), F.lit(0).alias("n"),
            none(0).alias("l2"), none(0).alias("r2"), none(1).alias("ls2"), none(1).alias("rs2"), F.lit(0).alias("n2"),
        )

    octets = F.transform(F.split(m, r"\."), lambda x: x.try_cast("int"))
    written = m.startswith("+")
    country = F.when(written, F.regexp_extract(digits, _COUNTRY, 1)).otherwise("1")
    national = F.when(written, F.substring(digits, F.length(country) + 1, n)).otherwise(digits)
    area, group, serial = (_long(F.substring(m, a, k)) for a, k in ((1, 3), (5, 2), (8, 4)))
    # serial parts: areas 1 to 899 without 666, groups 1 to 99, serials 1 to 9999
    area_no = area - 1 - (area > 666).cast("long")
    day = F.datediff(_ymd(m), F.lit(_FIRST_DAY).cast("date"))
    form = F.when(m.substr(5, 1).isin("-", "/"), F.lit("yyyyMMdd")).when(m.contains("/") & F.try_to_timestamp(m, F.lit("dd/MM/yyyy")).isNull(), F.lit("MMddyyyy")).otherwise(F.lit("ddMMyyyy"))
    iban = F.replace(m, F.lit(" "), F.lit(""))
    bban = F.substring(iban, F.lit(5), F.length(m))
    letters = F.regexp_replace(bban, "[^A-Z]", "")
    text = lambda kind: fixed(kind, F.lit(0), F.lit(0), 1, 1, F.lit(""))
    return (
        F.when(m.contains("@"), text("email"))
        .when(m.rlike(f"^(?:{_SECRET_NAME}|{_KNOWN_KEY}[0-9A-Za-z]{{16}})"), text("secret"))
        .when(m.rlike(f"^(?:{_IPV4})$"), F.when(F.forall(octets, lambda x: x <= 255), fixed("ipv4", octets[0] * 256 + octets[1], octets[2] * 256 + octets[3], 65536, 65536, F.lit(""))))
        .when(m.rlike(f"^(?:{_DATE})$"), F.when(day.between(0, _DAYS[0] * _DAYS[1] - 1), fixed("date", F.floor(day / _DAYS[1]), day % _DAYS[1], *_DAYS, form)))
        .when(m.rlike(f"^(?:{_SSN})$"), F.when((area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0), fixed("ssn", area_no, (group - 1) * 9999 + serial - 1, 898, 99 * 9999, F.lit(""))))
        .when(m.rlike("^[A-Z]{2}"), F.when((_iban_rest(bban, F.substring(iban, 1, 2), F.substring(iban, 3, 2)) == 1) & (F.length(letters) <= 20), halves(F.regexp_replace(bban, "[^0-9]", ""), "iban", F.substring(iban, 1, 2), letters)))
        .when(m.rlike(f"^(?:{_PHONE})$"), F.when(F.length(national).between(7, 14), halves(national, "phone", country)))
        .when(n.between(13, 19), F.when(luhn_sum(digits, 0) % 10 == 0, halves(F.substring(digits, F.lit(1), n - 1), "card", F.lit(""))))
    )


def _tweak(v: Column) -> Column:
    """What tells domains apart: kind, country and length; the order in which a date is written isn't part of its value."""
    return F.concat_ws("|", v["kind"], F.when(v["kind"] == "date", F.lit("")).otherwise(v["lead"]), v["n"].cast("string"))


def _pad(x: Column, n: Column) -> Column:
    return F.lpad(x.cast("string"), n, F.lit("0"))


def _write(m: Column, v: Column, p: Column, p2: Column, key: str) -> Column:
    """The pseudonym: m written with the permuted parts p, and p2 of letters."""
    a = F.floor(v["n"] / 2).cast("int")
    core = F.concat(_pad(p["l"], a), _pad(p["r"], v["n"] - a))
    digest = lambda part: F.sha2(F.concat_ws("|", F.lit(key), v["kind"], part), 256)
    octet = lambda x: F.concat_ws(".", F.shiftright(x, 8).cast("string"), (x % 256).cast("string"))
    area = p["l"] + 1 + (p["l"] >= 665).cast("long")
    day = F.date_add(F.lit(_FIRST_DAY).cast("date"), (p["l"] * _DAYS[1] + p["r"]).cast("int"))
    written = F.when(v["lead"] == "yyyyMMdd", F.date_format(day, "yyyyMMdd")).when((v["lead"] == "MMddyyyy") & (F.dayofmonth(day) > 12), F.date_format(day, "MMddyyyy")).otherwise(F.date_format(day, "ddMMyyyy"))
    check = (10 - luhn_sum(core, 1) % 10) % 10
    a2 = _half(v["n2"])
    bban = F.replace(F.substring(m, F.lit(5), F.length(m)), F.lit(" "), F.lit(""))
    new_bban = _refilled(_refilled(bban, core), F.concat(_letters26(p2["l"], a2), _letters26(p2["r"], v["n2"] - a2)), "A", "Z")
    iban = F.concat(v["lead"], _pad(98 - _iban_rest(new_bban, v["lead"], F.lit("00")), F.lit(2)), new_bban)
    # each character of the form but spaces is a place: letters and digits of the form as one alphabet
    spaced = _refilled(F.regexp_replace(m, "[0-9A-Z]", "0"), iban)
    phone = F.replace(_refilled(F.replace(m, F.lit("(0)"), F.lit("(\u0004)")), F.concat(F.when(m.startswith("+"), v["lead"]).otherwise(""), core)), F.lit("\u0004"), F.lit("0"))
    name = F.regexp_extract(m, f"^({_SECRET_NAME}|{_KNOWN_KEY})", 1)
    secret = F.substring(m, F.length(name) + 1, F.length(m))
    same = F.when(secret.rlike("^[0-9a-fA-F]+$"), F.lower(secret)).otherwise(secret)
    hex_ = F.substring(F.concat(digest(same), digest(F.concat(same, F.lit("|2")))), F.lit(1), F.length(secret))
    return (
        F.when(v["kind"] == "email", F.concat(F.lit("u"), F.substring(digest(F.lower(m)), 1, 16), F.lit("@mail.invalid")))
        .when(v["kind"] == "secret", F.concat(name, F.when(name.isin("AKIA", "ASIA"), F.upper(hex_)).otherwise(hex_)))
        .when(v["kind"] == "ipv4", F.concat_ws(".", octet(p["l"]), octet(p["r"])))
        .when(v["kind"] == "date", _refilled(m, written))
        .when(v["kind"] == "ssn", _refilled(m, F.concat(_pad(area, F.lit(3)), _pad(F.floor(p["r"] / 9999) + 1, F.lit(2)), _pad(p["r"] % 9999 + 1, F.lit(4)))))
        .when(v["kind"] == "iban", spaced)
        .when(v["kind"] == "phone", phone)
        .when(v["kind"] == "card", _refilled(m, F.concat(core, check.cast("string"))))
    )


def pseudonymise(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """One row per input row: the columns of `keep`, doc_id, the rewritten text, and found (array of {kind, pseudonym}, in order).

    A null text stays null with nothing found, an empty one empty. Values that fail their check (a number without a right
    check digit, a day that isn't) stay as they are. Repeated rows give repeated results; a null id stays null; other
    columns are ignored unless kept; an empty table gives no rows. No shuffle. Whoever has the key can undo the permutations.
    """
    if not key:
        raise ValueError("pseudonyms need a key")
    kept = keep or []
    names = {c: f"_kept_{i}" for i, c in enumerate(kept)}
    df = docs.select(*(docs[c].alias(n) for c, n in names.items()), docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    matches = F.when(F.col("text").rlike(_GATE), F.regexp_extract_all("text", F.lit(_ANY), F.lit(0)))
    df = computed_once(df, [*names.values(), "id", "text"], raw=matches)
    read = F.transform("raw", lambda m: F.struct(m.alias("m"), _read(m).alias("v")))
    df = computed_once(df, [*names.values(), "id", "text"], read=F.when(F.size("raw") > 0, read))
    permuted = F.transform("read", lambda x: F.struct(x["m"].alias("m"), x["v"].alias("v"), F.when(x["v"]["kind"].isNotNull(), feistel(x["v"]["l"], x["v"]["r"], x["v"]["ls"], x["v"]["rs"], _tweak(x["v"]), key)).alias("p"), F.when(x["v"]["n2"] > 0, feistel(x["v"]["l2"], x["v"]["r2"], x["v"]["ls2"], x["v"]["rs2"], F.concat(_tweak(x["v"]), F.lit("|letters|"), x["v"]["n2"].cast("string")), key)).otherwise(F.struct(F.lit(0).cast("long").alias("l"), F.lit(0).cast("long").alias("r"))).alias("p2")))
    df = computed_once(df, [*names.values(), "id", "text"], permuted=permuted)
    new = F.transform("permuted", lambda x: F.struct(x["v"]["kind"].alias("kind"), F.coalesce(_write(x["m"], x["v"], x["p"], x["p2"], key), x["m"]).alias("pseudonym")))
    df = computed_once(df, [*names.values(), "id", "text"], new=new)
    parts = F.split("text", _ANY, -1)
    joined = F.array_join(F.transform(parts, lambda part, i: F.concat(part, F.coalesce(F.get(F.col("new"), i)["pseudonym"], F.lit("")))), "")
    found = F.coalesce(F.filter("new", lambda x: x["kind"].isNotNull()), F.array().cast("array<struct<kind:string,pseudonym:string>>"))
    done = computed_once(df, [*names.values(), "id"], text=F.when(F.size("new") > 0, joined).otherwise(F.col("text")), found=found)
    return done.select(*(F.col(n).alias(c) for c, n in names.items()), F.col("id").alias("doc_id"), "text", "found")


def rewritten(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs with all their columns, whatever they are called, and the rewritten texts; otherwise as pseudonymise()."""
    others = [c for c in docs.columns if c not in (id_col, text_col)]
    longer = "_" * max(map(len, docs.columns))  # names that docs doesn't have
    done = pseudonymise(docs.select(*(docs[c].alias(f"{longer}{k}") if c in others else docs[c] for k, c in enumerate(docs.columns))), key, id_col, text_col, [f"{longer}{k}" for k, c in enumerate(docs.columns) if c in others])
    return done.select(*(F.col({id_col: "doc_id", text_col: "text"}.get(c, f"{longer}{k}")).alias(c) for k, c in enumerate(docs.columns)))
