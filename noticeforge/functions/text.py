"""Text of pages and documents: normalising, fingerprints, HTML to text, masking."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_FULL = "".join(chr(0xFF01 + k) for k in range(94))
_HALF = "".join(chr(0x21 + k) for k in range(94))
#: Elements whose content is no text of the page: without tags inside, and with.
RAW_TAGS, NESTED_TAGS = ("script", "style"), ("nav", "footer", "head")
#: Entities that pages use.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
#: Numbers stand by themselves; a Chinese character beside them is no part of them.
_ALONE, _ENDS = "(?<![0-9A-Za-z])", "(?![0-9A-Za-z])"
ID_NUMBER = f"{_ALONE}[0-9]{{15,17}}[0-9Xx]{_ENDS}"
#: Phones: with country code and brackets; mobiles of 11 digits; landlines with area code, and an extension.
PHONE = "|".join((
    r"\+?[0-9]{1,3}[ -]?\(?[0-9]{3}\)?[ -][0-9]{3}-[0-9]{4}",
    f"(?:(?:\\+|00)86[ -]?)?{_ALONE}1[3-9][0-9][ -]?[0-9]{{4}}[ -]?[0-9]{{4}}{_ENDS}",
    f"{_ALONE}(?:\\(0[0-9]{{2,3}}\\)|（0[0-9]{{2,3}}）|0[0-9]{{2,3}}[ -]?)[ ]?[0-9]{{7,8}}(?:(?:-|转)[0-9]{{1,6}})?{_ENDS}",
))
#: What a secret is called: a name that holds one of these words, or is one.
_NAMED = "[A-Za-z0-9_.-]*(?:token|secret|passw(?:or)?d|pwd|passphrase|api[_-]?key|access[_-]?key|private[_-]?key|credentials?|authorization)[A-Za-z0-9_.-]*|cookie|set-cookie|密码|口令|密钥"
#: A name, in quotes or not, what follows it, a scheme of authorization, and its value: quoted with escapes, or up to the next space or mark.
#: Loops over escapes are possessive: Java's others recurse, and a long value would end the JVM.
SECRET = f"(?i)((?:{_NAMED})[\"']?\\s*[=:：]\\s*)(?:(?:bearer|basic|digest|token)\\s+)?(?:\"(?:[^\"\\\\]|\\\\.)*+\"|'(?:[^'\\\\]|\\\\.)*+'|[^\\s\"',;&，。；]+)"
#: Secrets that are known by their form: tokens after "Bearer", of some services, of three parts; passwords in addresses; keys in armour.
#: As with numbers, no letter beyond ASCII beside them is part of them; Java's \b takes those in, or not, by its version.
_BEFORE, _AFTER = "(?<![0-9A-Za-z_])", "(?![0-9A-Za-z_])"
SHAPES = (
    (_BEFORE + r"(?i)(bearer\s+)[A-Za-z0-9._~+/=-]{8,}", "$1***"),
    (r"(://[^/\s:@]+:)[^/\s]+@", "$1***@"),
    (_BEFORE + r"eyJ[A-Za-z0-9_-]{5,}\.[A-Za-z0-9_-]{5,}(?:\.[A-Za-z0-9_-]*)?", "***"),
    (_BEFORE + r"(?:(?:AKIA|ASIA)[0-9A-Z]{16}" + _AFTER + r"|gh[oprsu]_[A-Za-z0-9]{20,}|sk-[A-Za-z0-9_-]{20,}|xox[abprs]-[A-Za-z0-9-]{10,})", "***"),
    (r"(?s)-----BEGIN [A-Z ]*PRIVATE KEY-----.*?(?:-----END [A-Z ]*PRIVATE KEY-----|\z)", "***"),
)


def normalize_text(x: Column) -> Column:
    """Full-width ASCII folded, runs of white space (also U+3000, U+00A0) as one space, trimmed."""
    return F.trim(F.regexp_replace(F.translate(x, _FULL, _HALF), r"[\s　 ]+", " "))


def fingerprint(x: Column) -> Column:
    return F.sha2(normalize_text(x), 256)


def html_text(html: Column) -> Column:
    """The visible text of a page; the pages aren't well-formed, so tags are cut by patterns.

    Comments and elements without tags inside go first, in the order they stand; then what stands in elements that may hold others of their kind, by the
    depth of each. An element that never ends reaches to the end of the page (the head to the body).
    """
    raw = "|".join(RAW_TAGS)
    x = F.regexp_replace(html, f"(?is)<!--.*?(?:-->|\\z)|<({raw})\\b[^>]*>.*?(?:</\\1\\s*>|\\z)", " ")
    x = F.regexp_replace(_outside(x), "</?[A-Za-z!?][^>]*>", " ")
    for entity, char in ENTITIES:
        x = F.replace(x, F.lit(entity), F.lit(char))
    return normalize_text(x)


def _outside(x: Column) -> Column:
    """x without what stands in NESTED_TAGS: cut at their tags, with a depth for each of them along the way."""
    marked = F.regexp_replace(F.translate(x, "\x01\x02", "  "), f"(?i)<(/?)({'|'.join(NESTED_TAGS)}|body)\\b[^>]*>", "\x01$1$2\x02")
    parts = F.split(F.concat(F.lit("\x02"), marked), "\x01")

    def step(state: Column, part: Column) -> Column:
        tag = F.lower(F.substring_index(part, "\x02", 1))
        depth = {t: F.when(tag == t, state[t] + 1).when(tag == f"/{t}", F.greatest(state[t] - 1, F.lit(0))).otherwise(state[t]) for t in NESTED_TAGS}
        depth["head"] = F.when(tag == "body", 0).otherwise(depth["head"])
        inside = sum(depth.values(), F.lit(0))
        text = F.when(inside == 0, F.array(F.substring_index(part, "\x02", -1))).otherwise(F.array(F.lit(" ")))
        return F.struct(*(d.alias(t) for t, d in depth.items()), F.concat(state["out"], text).alias("out"))

    start = F.struct(*(F.lit(0).alias(t) for t in NESTED_TAGS), F.array().cast("array<string>").alias("out"))
    return F.aggregate(parts, start, step, lambda state: F.array_join(state["out"], " "))


def page_title(html: Column) -> Column:
    """The title, else the first heading, else null."""
    first = lambda tag: F.nullif(F.trim(F.regexp_extract(html, f"(?is)<{tag}\\b[^>]*>(.*?)</{tag}\\s*>", 1)), F.lit(""))
    return F.coalesce(first("title"), first("h1"))


def published_at(html: Column) -> Column:
    """The day that a page names as its own: a meta or time element, else a labelled date."""
    day = lambda pattern: F.try_to_timestamp(F.regexp_replace(F.regexp_extract(html, pattern, 1), "[/年月]", "-"), F.lit("yyyy-M-d"))
    form = "([0-9]{4}[-/年][0-9]{1,2}[-/月][0-9]{1,2})"
    return F.coalesce(day(f'(?s)<time[^>]*datetime="{form}'), day(f'(?s)<meta[^>]*content="{form}'), day(f"(?:发布时间|发布日期|Published)[:：]?\\s*{form}"))


def mask_pii(x: Column) -> Column:
    """x with e-mail addresses, numbers of identity cards and accounts, and phone numbers masked."""
    for pattern, mask in ((EMAIL, "[email]"), (ID_NUMBER, "[id]"), (PHONE, "[phone]")):
        x = F.regexp_replace(x, pattern, mask)
    return x


def mask_secrets(x: Column) -> Column:
    """x with the values of what is called a secret, and what has the form of one, masked."""
    x = F.regexp_replace(x, SECRET, "$1***")
    for pattern, mask in SHAPES:
        x = F.regexp_replace(x, pattern, mask)
    return x
