"""URL forms, keys and evidence as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query keys that only track visits.
TRACKING = (
    "utm_source utm_medium utm_campaign utm_term utm_content utm_id utm_placement ref referer referrer source campaign origin "
    "fbclid gclid msclkid dclid twclid li_fat_id refid trackingid trk aceid from alid sid cid pid aid"
).split()


def part(url: Column, name: str) -> Column:
    return F.try_parse_url(url, F.lit(name))


def _pairs(url: Column) -> Column:
    q = F.coalesce(part(url, "QUERY"), F.lit(""))
    return F.filter(F.split(q, "&"), lambda p: F.length(p) > 0)


def _key(pair: Column) -> Column:
    return F.substring_index(pair, "=", 1)


def normalised(url: Column) -> Column:
    """For deduplication: lower-case host, no trailing slash, no blank or tracking parameters, sorted, no fragment."""
    kept = F.filter(_pairs(url), lambda p: ~_key(p).isin(*TRACKING) & p.contains("=") & ~p.endswith("="))
    query = F.array_join(F.array_sort(kept), "&")
    path = F.regexp_replace(F.coalesce(part(url, "PATH"), F.lit("")), "/+$", "")
    base = F.concat(F.lower(part(url, "PROTOCOL")), F.lit("://"), F.lower(part(url, "AUTHORITY")), path)
    return F.concat(base, F.when(F.length(query) > 0, F.concat(F.lit("?"), query)).otherwise(F.lit("")))


def canonical(url: Column) -> Column:
    """For candidates: no default port or fragment, query sorted with all its parameters."""
    host = F.regexp_replace(F.lower(part(url, "AUTHORITY")), ":(80|443)$", "")
    path = F.coalesce(F.nullif(part(url, "PATH"), F.lit("")), F.lit("/"))
    query = F.array_join(F.array_sort(_pairs(url)), "&")
    base = F.concat(F.lower(part(url, "PROTOCOL")), F.lit("://"), host, path)
    return F.concat(base, F.when(F.length(query) > 0, F.concat(F.lit("?"), query)).otherwise(F.lit("")))


def host(url: Column) -> Column:
    return F.lower(part(url, "HOST"))


def signature(url: Column, patterns: list[str]) -> Column:
    """A 32-bit key: the first id that one of ``patterns`` finds, else host, path and query."""
    low = F.lower(url)
    found = [F.nullif(F.regexp_extract(low, p, 1), F.lit("")) for p in patterns]
    rest = F.concat(host(url), F.coalesce(part(url, "PATH"), F.lit("")), F.coalesce(part(url, "QUERY"), F.lit("")))
    return F.conv(F.substring(F.md5(F.coalesce(*found, rest).cast("binary")), 1, 8), 16, 10).cast("long")


def is_generic_apply(url: Column) -> Column:
    """A mail address, or a site without any path."""
    return F.lower(url).startswith("mailto:") | F.coalesce(F.regexp_replace(F.coalesce(part(url, "PATH"), F.lit("")), "/", "") == "", F.lit(True))


def host_suffixes(h: Column) -> Column:
    """A host and its parent domains, longest first."""
    labels = F.split(h, "\\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def company_label(h: Column) -> Column:
    """The label of a host that names its owner: the first, or the second after a generic one."""
    labels = F.split(F.regexp_replace(h, "^www\\.", ""), "\\.")
    first = F.get(labels, F.lit(0))
    return F.when(first.isin("jobs", "careers", "apply", "boards", "job", "career") & (F.size(labels) > 2), F.get(labels, F.lit(1))).otherwise(first)


def resolved(href: Column, page: Column) -> Column:
    """A link as an absolute URL: with a scheme as it is, with two slashes under the page's scheme, else under its host or folder."""
    scheme, host = F.concat(part(page, "PROTOCOL"), F.lit(":")), part(page, "AUTHORITY")
    root = F.concat(scheme, F.lit("//"), host)
    folder = F.regexp_replace(F.coalesce(F.nullif(part(page, "PATH"), F.lit("")), F.lit("/")), "[^/]*$", "")
    return (
        F.when(href.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme, href))
        .when(href.startswith("/"), F.concat(root, href))
        .otherwise(F.concat(root, folder, href))
    )


def next_page(url: Column, param: str, first: int, step: int, page: Column) -> Column:
    """The URL with a page parameter set to first + step * (page - 1) at the end, others kept; null if it isn't absolute."""
    kept = F.filter(_pairs(url), lambda p: _key(p) != param)
    query = F.array_join(F.concat(kept, F.array(F.concat(F.lit(f"{param}="), (first + step * (page - 1)).cast("string")))), "&")
    fragment = F.regexp_extract(url, "(#.*)$", 1)
    base = F.concat(part(url, "PROTOCOL"), F.lit("://"), part(url, "AUTHORITY"), F.coalesce(part(url, "PATH"), F.lit("")))
    return F.concat(base, F.lit("?"), query, fragment)


_HOST = r"(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,63}"


def redacted(text: Column) -> Column:
    """A text whose rendered URLs are cut to their hosts: with a scheme, as breadcrumbs, or with www and a path."""
    whole = F.regexp_extract_all(text, F.lit("\\b[A-Za-z][A-Za-z0-9+.-]*://[^\\s<>\"']+"), F.lit(0))
    longest_first = F.array_sort(F.array_distinct(whole), lambda a, b: F.length(b) - F.length(a))
    x = F.aggregate(longest_first, text, lambda s, u: F.replace(s, u, F.coalesce(host(u), F.lit(""))))
    x = F.regexp_replace(x, rf"({_HOST})(?::\d+)?[ \t\u00a0]*[\u203a\u00bb][^\n]*", "$1")
    return F.regexp_replace(x, rf"(?i)(?<![\w.@-])(www\.{_HOST})(?::\d+)?[/?#][^\s<>\"']*", "$1")
