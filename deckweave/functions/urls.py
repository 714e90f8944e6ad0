"""Expressions on addresses, cookies and their matching."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Where a deck viewer wraps the address of the file it shows.
VIEWER = "/assets/library/pdfjs/web/viewer.html"
ASSET = "(?i)\\.(pdf|ppt|pptx)(\\?|\\z)"
# Names of cookies that hold a session.
SESSION = "(?i)sess|laravel|csrf|xsrf|token"
# Addresses and pages that ask for a sign-in, and failures worth another try.
SIGN_IN = "(?i)login\\.microsoftonline\\.com|/login|/account/login-checkpoint"
TRY_AGAIN = (429, 500, 502, 503, 504)


def origin(url: Column) -> Column:
    return F.regexp_extract(url, "^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+)", 1)


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, "^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)", 1))


def path(url: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(url, "^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+(/[^?#]*)", 1), F.lit("")), F.lit("/"))


def absolute(url: Column, base: Column) -> Column:
    """An address against an origin: absolute ones stay, rooted and relative ones are put behind it."""
    return F.when(origin(url) != "", url).when(url.startswith("/"), F.concat(base, url)).otherwise(F.concat(base, F.lit("/"), url))


def asset_url(url: Column) -> Column:
    """The file an address leads to: the one a viewer shows, or itself if it names a deck; else empty."""
    shown = F.regexp_extract(url, "[?&]file=([^&#]*)", 1)
    shown = F.when(shown == "", "").otherwise(absolute(F.url_decode(shown), origin(url)))
    found = F.when(F.lower(path(url)).contains(VIEWER), shown).when(url.rlike(ASSET), url).otherwise("")
    return F.when(url.isNull() | (origin(url) == ""), "").otherwise(found)


def asset_type(url: Column) -> Column:
    x = F.lower(F.coalesce(url, F.lit("")))
    out = F.lit("unknown")
    for kind in ("ppt", "pptx", "pdf"):
        out = F.when(x.rlike(f"\\.{kind}(\\?|\\z)"), kind).otherwise(out)
    return out


def encoded(c: Column) -> Column:
    """Percent encoding with spaces as %20."""
    return F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))


def domain_matches(domain: Column, host_name: Column) -> Column:
    d = F.regexp_replace(F.lower(domain), "^\\.", "")
    return (host_name == d) | host_name.endswith(F.concat(F.lit("."), d))


def path_matches(cookie_path: Column, request: Column) -> Column:
    after = F.substr(request, F.length(cookie_path) + 1, F.lit(1))
    inside = request.startswith(cookie_path) & (cookie_path.endswith("/") | after.isin("/", ""))
    return F.coalesce(cookie_path.isin("", "/") | (request == cookie_path) | inside, F.lit(True))


def cookie_matches(url: Column, domain: Column, cookie_path: Column, expires: Column, secure: Column, now: int) -> Column:
    """Whether a cookie goes with a request: not expired (0 and below never expire), its domain, its path, and a safe scheme if it asks for one."""
    alive = (expires <= 0) | (expires >= F.lit(now))
    safe = ~secure | F.lower(url).startswith("https:")
    return alive & domain_matches(domain, host(url)) & path_matches(cookie_path, path(url)) & safe


def suffixes(host_name: Column) -> Column:
    """A host and the domains above it: a.b.c, b.c, c."""
    parts = F.split(host_name, "\\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."))


def map_url(base: str, course: Column, curriculum: Column) -> Column:
    """The address of a course's map; the ampersand stands behind the path as the site has it."""
    empty = F.lit("")
    return F.concat(F.lit(f"{base}/map/"), encoded(F.coalesce(course, empty)), F.lit("&curriculum="), encoded(F.coalesce(curriculum, empty)))


def overlaid(*maps: Column) -> Column:
    """Maps of strings as one, the last of a name winning, by name; null maps count for nothing."""
    none = F.create_map().cast("map<string,string>")
    entries = F.concat(*(F.map_entries(F.coalesce(m, none)) for m in reversed(maps)))
    names = F.array_sort(F.array_distinct(F.transform(entries, lambda e: e["key"])))
    return F.map_from_entries(F.transform(names, lambda n: F.element_at(F.filter(entries, lambda e: e["key"] == n), 1)))


def joined_path(base: Column, *parts: Column) -> Column:
    """A folder and the parts below it as one path, the parts made safe; null parts are left out."""
    from deckweave.functions.text import safe_name

    return F.concat_ws("/", base, *(F.when(p.isNotNull(), safe_name(p)) for p in parts))
