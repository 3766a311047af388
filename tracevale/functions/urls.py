"""URL identity and route patterns, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query values that differ from visit to visit (whole match).
VOLATILE = (
    r"(?i:[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12})",
    r"[0-9]{10,}",
    r"(?i:\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?(?:Z|[+-]\d{2}:?\d{2}))",
    r"(?i:[0-9a-f]{16,})",
    r"[A-Za-z0-9_-]{24,}",
)
#: First path segments that aren't an owner.
RESERVED = "user admin api explore notifications milestones issues org repo login assets attachments -".split()
_OWNER = rf"(?!(?i:{'|'.join(RESERVED)})/)[^/]+"
#: Routes by path, the first that fits counts.
ROUTES = (
    (r"^/user/login$", "/user/login"),
    (rf"^/{_OWNER}/[^/]+/issues/new$", "/{owner}/{repo}/issues/new"),
    (rf"^/{_OWNER}/[^/]+/issues/[0-9]+$", "/{owner}/{repo}/issues/{number}"),
    (rf"^/{_OWNER}/[^/]+/issues$", "/{owner}/{repo}/issues"),
    (rf"^/{_OWNER}/[^/]+$", "/{owner}/{repo}"),
    (r"^/$", "/"),
)


def part(url: Column, n: int) -> Column:
    """Group n of a URL: 1 scheme, 2 userinfo with @, 3 host, 4 port with colon, 5 path, 6 query with ?. Without a scheme all before the query is path."""
    return F.regexp_extract(url, r"^(?:([A-Za-z][A-Za-z0-9+.-]*)://([^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)(:\d+)?)?([^?#]*)(\?[^#]*)?", n)


def _decoded(c: Column) -> Column:
    """Without percent-encoding; what isn't well encoded stays as it is."""
    return F.coalesce(F.try_url_decode(c), c)


def _encoded(c: Column) -> Column:
    """Percent-encoded but for letters, digits and `_.-~`; a space is a plus."""
    return F.replace(F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def trimmed_path(url: Column) -> Column:
    path = part(url, 5)
    return F.when(path == "/", path).otherwise(F.regexp_replace(path, "/+$", ""))


def canonical_query(url: Column) -> Column:
    """Query items without volatile values, sorted and encoded anew; values may be blank."""
    items = F.filter(F.split(F.substring(part(url, 6), 2, 1 << 30), "&"), lambda x: x != "")
    pairs = F.transform(items, lambda x: F.struct(_decoded(F.substring_index(x, "=", 1)).alias("k"), F.when(F.instr(x, "=") > 0, _decoded(F.regexp_replace(x, "^[^=]*=", ""))).otherwise(F.lit("")).alias("v")))
    stay = F.filter(pairs, lambda p: ~p["v"].rlike("^(?:" + "|".join(VOLATILE) + ")$"))
    return F.array_join(F.transform(F.array_sort(stay), lambda p: F.concat(_encoded(p["k"]), F.lit("="), _encoded(p["v"]))), "&")


def canonical_url(url: Column) -> Column:
    """Lower-case scheme and host, no fragment, no slash at the path's end, stable query items in order."""
    query = canonical_query(url)
    site = F.when(part(url, 1) == "", "").otherwise(F.concat(F.lower(part(url, 1)), F.lit("://"), part(url, 2), F.lower(part(url, 3)), part(url, 4)))
    return F.concat(site, trimmed_path(url), F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))


def route_pattern(url: Column) -> Column:
    """The route that a path stands for; a path of no known route has its numbers replaced."""
    path = F.coalesce(F.nullif(trimmed_path(url), F.lit("")), F.lit("/"))
    whole = F.coalesce(F.nullif(part(url, 5), F.lit("")), F.lit("/"))
    out = F.array_join(F.transform(F.split(whole, "/"), lambda s: F.when(s.rlike("^[0-9]+$"), "{number}").otherwise(s)), "/")
    for pattern, route in reversed(ROUTES):
        out = F.when(path.rlike(pattern), route).otherwise(out)
    return out
