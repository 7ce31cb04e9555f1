"""URLs: one canonical form, relative links, links of pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeforge.functions.once import with_once

#: Query parameters that only track; a trailing star takes all with the prefix.
TRACKING = ("utm_*", "ref", "spm", "from", "fbclid", "gclid")
_SCHEME = "^([A-Za-z][A-Za-z0-9+.-]*)://"
ATTACHMENT = r"(?i)\.(pdf|xlsx?)$"


def _tracking_pattern(names: tuple[str, ...]) -> str:
    return "^(" + "|".join(n[:-1] + ".*" if n.endswith("*") else n for n in names) + ")$"


def with_canonical(df: DataFrame, url: Column, out: str, tracking: tuple[str, ...] = TRACKING) -> DataFrame:
    """df with canonical_url() of an address as the column `out`, each of its parts computed once."""
    df = with_once(df, _url=url, _bare=F.regexp_replace(url, "#.*$", ""))
    bare = F.col("_bare")
    df = with_once(df, _scheme=F.lower(F.regexp_extract(bare, _SCHEME, 1)), _host=F.lower(F.regexp_extract(bare, "^[^:]+://([^/?]*)", 1)), _path=_path_of(bare), _pairs=_pairs_of(bare, tracking))
    return df.withColumn(out, _whole(F.col("_scheme"), F.col("_host"), F.col("_path"), F.col("_pairs"), F.col("_url"))).drop("_url", "_bare", "_scheme", "_host", "_path", "_pairs")


def canonical_url(url: Column, tracking: tuple[str, ...] = TRACKING) -> Column:
    """Lower-case scheme and host, no default port, fragment, tracking parameters or trailing slash, sorted query pairs."""
    bare = F.regexp_replace(url, "#.*$", "")
    return _whole(F.lower(F.regexp_extract(bare, _SCHEME, 1)), F.lower(F.regexp_extract(bare, "^[^:]+://([^/?]*)", 1)), _path_of(bare), _pairs_of(bare, tracking), url)


def _path_of(bare: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(bare, "^[^:]+://[^/?]*([^?]*)", 1), "/+$", "")


def _pairs_of(bare: Column, tracking: tuple[str, ...]) -> Column:
    pattern = _tracking_pattern(tracking)
    return F.array_sort(F.filter(F.split(F.regexp_extract(bare, r"\?(.*)$", 1), "&"), lambda p: (p != "") & ~F.lower(F.split(p, "=")[0]).rlike(pattern)))


def _whole(scheme: Column, host: Column, path: Column, pairs: Column, url: Column) -> Column:
    host = F.when(scheme == "http", F.regexp_replace(host, ":80$", "")).when(scheme == "https", F.regexp_replace(host, ":443$", "")).otherwise(host)
    tail = F.when(F.size(pairs) > 0, F.concat(F.lit("?"), F.array_join(pairs, "&"))).otherwise("")
    return F.when(scheme != "", F.concat(scheme, F.lit("://"), host, F.when(path == "", "/").otherwise(path), tail)).otherwise(url)


def _without_dots(path: Column) -> Column:
    """A path without its segments "." and ".."."""
    steps = F.split(path, "/")
    step = lambda acc, x: F.when(x == "..", F.regexp_replace(acc, "/[^/]*$", "")).when(x == ".", acc).otherwise(F.concat(acc, F.lit("/"), x))
    clean = F.concat(F.aggregate(F.slice(steps, 2, F.size(steps)), F.lit(""), step), F.when(path.rlike(r"/\.\.?$"), "/").otherwise(""))
    return F.when(path.rlike(r"/\.\.?(/|$)"), clean).otherwise(path)


def resolve_link(href: Column, base: Column) -> Column:
    """href as an absolute URL, seen from the page at base; null for what isn't a web page (mailto:, javascript: and other schemes)."""
    return _cleared(F.trim(href), *_cut(_joined(F.trim(href), base)))


def with_resolved(df: DataFrame, href: str, base: str, out: str) -> DataFrame:
    """df with resolve_link() of two columns as the column `out`, each of its steps computed once."""
    df = with_once(df, _full=_joined(F.trim(F.col(href)), F.col(base)))
    site, path, tail = _cut(F.col("_full"))
    df = with_once(df, _site=site, _path=path, _tail=tail)
    return df.withColumn(out, _cleared(F.trim(F.col(href)), F.col("_site"), F.col("_path"), F.col("_tail"))).drop("_full", "_site", "_path", "_tail")


def _cut(full: Column) -> tuple[Column, ...]:
    return tuple(F.regexp_extract(full, "^([A-Za-z]+://[^/?#]*)([^?#]*)(.*)$", k) for k in (1, 2, 3))


def _cleared(href: Column, site: Column, path: Column, tail: Column) -> Column:
    return F.when(~href.rlike("^(?i)(?!https?:)[a-z][a-z0-9+.-]*:"), F.concat(site, _without_dots(path), tail))


def _joined(href: Column, base: Column) -> Column:
    scheme, host = F.regexp_extract(base, "^([A-Za-z]+)://", 1), F.regexp_extract(base, "^[A-Za-z]+://([^/?#]*)", 1)
    origin = F.concat(scheme, F.lit("://"), host)
    page = F.regexp_replace(base, "[?#].*$", "")
    folder = F.when(page.rlike("^[A-Za-z]+://[^/]*$"), F.concat(page, F.lit("/"))).otherwise(F.regexp_replace(page, "[^/]*$", ""))
    return (
        F.when(href.rlike("^[A-Za-z]+://"), href)
        .when(href.startswith("//"), F.concat(scheme, F.lit(":"), href))
        .when(href.startswith("/"), F.concat(origin, href))
        .when(href.rlike("^[?#]"), F.concat(page, href))
        .otherwise(F.concat(folder, F.regexp_replace(href, r"^\./", "")))
    )


def hrefs(html: Column) -> Column:
    """All link targets of a page, in order, in either kind of quotes or without any."""
    found = F.regexp_extract_all(html, F.lit(r"""(?i)\bhref\s*=\s*("[^"]*"|'[^']*'|[^\s"'=<>`][^\s"'<>`]*)"""), F.lit(1))
    bare = lambda x: F.when(x.rlike("^[\"']"), F.substring(x, F.lit(2), F.length(x) - 2)).otherwise(x)
    return F.transform(found, lambda x: F.replace(bare(x), F.lit("&amp;"), F.lit("&")))


def is_attachment(url: Column) -> Column:
    return F.regexp_replace(url, "[?#].*$", "").rlike(ATTACHMENT)
