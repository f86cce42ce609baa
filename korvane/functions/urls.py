"""Addresses: normal form, filters, links of a page, decoding, file names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

_PARTS = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*)://)?([^/?#]*)([^?#]*)(.*)$"
_LINK = r"""(?is)(?=href[ \t\n\x0B\f\r]*=[ \t\n\x0B\f\r]*(["'])(.*?)\1)"""
# Hosts whose articles have a known path, and that path.
ARTICLE_HOSTS = (("ru.wikipedia.org", r"(?s)^/wiki/[^:]+\z"), ("habr.com", r"^/ru/articles/[0-9]+/"))


def _part(url: Column, i: int) -> Column:
    return F.regexp_extract(url, _PARTS, i)


def host(url: Column) -> Column:
    """Host of an address in lower case without user and port; empty where there is none."""
    return F.lower(F.regexp_replace(F.regexp_replace(_part(url, 2), r"^.*@", ""), r":\d*$", ""))


def path(url: Column) -> Column:
    return _part(url, 3)


def _without_dots(way: Column) -> Column:
    """A path with its dot segments worked off, however many there are."""
    parts = F.split(F.substring(way, F.lit(2), F.length(way)), "/", -1)
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda done, x: F.when(x == ".", done).when(x == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(x))))
    return F.concat(F.lit("/"), F.array_join(kept, "/"), F.when((F.size(kept) > 0) & way.rlike(r"/\.\.?$"), F.lit("/")).otherwise(F.lit("")))


def normalize_url(url: Column) -> Column:
    """Scheme and host in lower case, http where no scheme stands, / for no path, no default port, no dot segments; query and fragment
    stay. What has no host stays as it is; null stays null."""
    scheme = F.lower(F.when(_part(url, 1) == "", F.lit("http")).otherwise(_part(url, 1)))
    authority = F.lower(_part(url, 2))
    authority = F.when((scheme == "http"), F.regexp_replace(authority, r":(80)?$", "")).when(scheme == "https", F.regexp_replace(authority, r":(443)?$", "")).otherwise(authority)
    plain = path(url)
    way = F.when(plain == "", F.lit("/")).when(F.contains(plain, F.lit("/.")), _without_dots(plain)).otherwise(plain)
    return F.when(_part(url, 2) == "", url).otherwise(F.concat(scheme, F.lit("://"), authority, way, _part(url, 4)))


def domain_allowed(url: Column, allowed: Sequence[str]) -> Column:
    """True for any address where nothing is listed, else if its host is a listed one or below it; no host is never allowed."""
    h = host(url)
    if not allowed:
        return F.lit(True)
    fits = [(h == d.lower()) | F.endswith(h, F.lit("." + d.lower())) for d in allowed]
    out = fits[0]
    for f in fits[1:]:
        out = out | f
    return F.coalesce((h != "") & out, F.lit(False))


def denied_extension(url: Column, denied: Sequence[str]) -> Column:
    """Whether the path ends with a listed extension, in any case."""
    way = F.lower(path(url))
    out = F.lit(False)
    for e in denied:
        out = out | F.endswith(way, F.lit(e.lower()))
    return F.coalesce(out, F.lit(False))


def url_allowed(url: Column, allowed: Sequence[str] = (), denied: Sequence[str] = ()) -> Column:
    return domain_allowed(url, allowed) & ~denied_extension(url, denied)


def is_article_url(url: Column) -> Column:
    """Whether host and path are those of an article of a known site. A host counts by its end, without a dot before it."""
    out = F.lit(False)
    for end, pattern in reversed(ARTICLE_HOSTS):
        out = F.when(F.endswith(host(url), F.lit(end)), path(url).rlike(pattern)).otherwise(out)
    return F.coalesce(out, F.lit(False))


def url_store_allowed(url: Column, articles_only: bool) -> Column:
    return is_article_url(url) if articles_only else F.lit(True)


def matches_any(url: Column, patterns: Sequence[str]) -> Column:
    """Whether any pattern is found in the address."""
    out = F.lit(False)
    for p in patterns:
        out = out | url.rlike(p)
    return F.coalesce(out, F.lit(False))


def extract_links(page: Column, max_links: int = 200) -> Column:
    """Quoted href values of a page that start with http:// or https://, under 2,048 bytes, in order, at most max_links."""
    found = F.regexp_extract_all(page, F.lit(_LINK), F.lit(2))
    return F.slice(F.filter(found, lambda v: v.rlike("^https?://") & (F.octet_length(v) < 2048)), 1, max_links)


def url_decode(value: Column) -> Column:
    """Percent-decoding with + for a blank; a % that starts no code stays."""
    return F.try_url_decode(F.regexp_replace(value, r"%(?![0-9A-Fa-f]{2})", "%25"))


def wiki_url(title: Column, base: str = "https://ru.wikipedia.org/wiki/") -> Column:
    """Address of a wiki page by its title."""
    coded = F.url_encode(F.replace(title, F.lit(" "), F.lit("_")))
    for old, new in (("%2F", "/"), ("%7E", "~"), ("*", "%2A"), ("+", "%20")):
        coded = F.replace(coded, F.lit(old), F.lit(new))
    return F.concat(F.lit(base), coded)


def safe_filename(value: Column, longest: int = 150) -> Column:
    """A file name of letters, digits, dot, dash and underscore; of a hash where nothing of the value is left."""
    name = F.regexp_replace(F.regexp_replace(value, r"[^a-zA-Z0-9._-]+", "_"), r"^_+|_+$", "")
    return F.substring(F.when(name == "", F.substring(F.sha2(value.cast("binary"), 256), 1, 16)).otherwise(name), 1, longest)


def content_hash(body: Column) -> Column:
    """SHA-256 of a body, in hex."""
    return F.sha2(body.cast("binary"), 256)
