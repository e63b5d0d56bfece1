"""URL columns, split once by the generic URI pattern of RFC 3986."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsloom.functions.text import nz

URI = r"^(?:([a-zA-Z][a-zA-Z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"

# Query parameters that only track the reader.
TRACKING = (
    "utm_source utm_medium utm_campaign utm_term utm_content ref source fbclid gclid "
    "mc_cid mc_eid ncid sr_share mod outputtype"
).split()
FETCH_TRACKING = (
    "utm_source utm_medium utm_campaign utm_term utm_content fbclid gclid ref source campaign"
).split()


def part(url, i: int) -> Column:
    return F.regexp_extract(nz(url), URI, i)


def _with_host(url) -> Column:
    """A bare ``host/path`` gets a scheme so that its host is seen as one."""
    return F.when(part(url, 2) != "", nz(url)).otherwise(F.concat(F.lit("https://"), nz(url)))


def bare_host(netloc: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(netloc), r"^www\.", ""), r":(80|443)$", "")


def _pairs(query: Column, banned: list[str], sort: bool) -> Column:
    kv = F.filter(
        F.split(query, "&"),
        lambda p: F.rlike(p, F.lit("^[^=]+=.+$"))
        & ~F.lower(F.substring_index(p, "=", 1)).isin(banned),
    )
    if sort:
        kv = F.transform(
            F.array_sort(F.transform(kv, lambda p: F.struct(
                F.regexp_extract(p, "^([^=]+)=", 1).alias("k"), F.regexp_extract(p, "^[^=]+=(.*)$", 1).alias("v")))),
            lambda s: F.concat(s["k"], F.lit("="), s["v"]),
        )
    return F.array_join(kv, "&")


def _suffix(mark: str, text: Column) -> Column:
    return F.when(text != "", F.concat(F.lit(mark), text)).otherwise(F.lit(""))


def normalize_url(url) -> Column:
    """Form used for duplicate search: https, bare host, no tracking, sorted query, no trailing slash or fragment."""
    full = _with_host(url)
    scheme = F.lower(part(full, 1))
    scheme = F.when(scheme.isin("http", "https", ""), F.lit("https")).otherwise(scheme)
    path = F.regexp_replace(part(full, 3), "/+$", "")
    out = F.concat(
        scheme, F.lit("://"), bare_host(part(full, 2)), path,
        _suffix("?", _pairs(part(full, 4), TRACKING, True)),
    )
    return F.when((nz(url) == "") | (part(full, 2) == ""), F.lit("")).otherwise(out)


def normalize_fetch_url(url) -> Column:
    """Form used before fetching: tracking, valueless parameters and fragment out, the rest in order."""
    scheme, netloc = part(url, 1), part(url, 2)
    out = F.concat(
        scheme, F.lit("://"), netloc, part(url, 3),
        _suffix("?", _pairs(part(url, 4), FETCH_TRACKING, False)),
    )
    return F.when((scheme == "") | (netloc == ""), nz(url)).otherwise(out)


def is_valid_url(url) -> Column:
    return (part(url, 1) != "") & (part(url, 2) != "")


def domain_of(url) -> Column:
    """Lower-case host without port and leading www; null when there is none."""
    host = F.regexp_replace(F.lower(part(_with_host(F.trim(nz(url))), 2)), r":\d+$", "")
    host = F.regexp_replace(host, r"^www\.", "")
    return F.when(host != "", host)


def logo_url(domain, base: str = "https://logo.example.com/") -> Column:
    return F.when(nz(domain) != "", F.concat(F.lit(base), nz(domain)))


def is_malformed(url) -> Column:
    """A literal backslash-u escape left inside the address."""
    return F.contains(nz(url), F.lit("\\u"))


def repair_url(url) -> Column:
    """Undo the escapes that JSON leaves behind; anything else after a stray escape is cut off."""
    out = F.replace(nz(url), F.lit("\\u0026"), F.lit("&"))
    out = F.replace(out, F.lit("\\u003d"), F.lit("="))
    out = F.replace(out, F.lit("\\u002F"), F.lit("/"))
    return F.regexp_replace(out, r"\\u[0-9a-fA-F]{0,4}.*$", "")


def upgrade_image(url) -> Column:
    """Larger renditions for two known image hosts (fixed patterns)."""
    u = nz(url)
    return (
        F.when(F.contains(u, F.lit("ichef.bbci.co.uk/ace/standard/240/")),
               F.replace(u, F.lit("/standard/240/"), F.lit("/standard/960/")))
        .when(F.contains(u, F.lit("static01.nyt.com")) & F.contains(u, F.lit("mediumSquare")),
              F.regexp_replace(u, r"-mediumSquareAt\dX", "-superJumbo"))
        .otherwise(u)
    )
