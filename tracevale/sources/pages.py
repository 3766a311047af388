"""Interactive elements of stored pages."""

from __future__ import annotations

from collections.abc import Iterable
from itertools import count
from urllib.parse import urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import collapse, fold, stable_id

#: The elements that are scanned, and the attributes that are kept.
ELEMENT = r"(?is)<(a|button|input|select|textarea|form)\b([^>]*)>(?:([^<]*)</\1>)?"
ATTRIBUTES = "href id class name type data-testid action method".split()


def attribute(tag: Column, name: str) -> Column:
    return F.nullif(F.regexp_extract(tag, rf"""(?i)\b{name}\s*=\s*["']([^"']*)["']""", 1), F.lit(""))


def role(tag: Column, type_: Column) -> Column:
    typed = F.coalesce(type_, F.lit("")).isin("submit", "button")
    return F.when(tag == "a", "link").when(tag == "button", "button").when((tag == "input") & typed, "button").when(tag.isin("input", "textarea"), "textbox").when(tag == "select", "combobox").otherwise("form")


def page_elements(pages: DataFrame) -> DataFrame:
    """(screen, ord, role, name, href, attributes, locator, id) of pages (screen, html).

    A name that an element's role already has on its screen gets the number of its occurrence.
    """
    g = lambda i: F.regexp_extract_all("html", F.lit(ELEMENT), F.lit(i))
    e = pages.select("screen", F.posexplode(F.arrays_zip(g(1).alias("tag"), g(2).alias("attrs"), g(3).alias("text"))).alias("ord", "e")).select("screen", "ord", F.lower("e.tag").alias("tag"), "e.attrs", "e.text")
    a = {n: attribute(F.col("attrs"), n) for n in [*ATTRIBUTES, "aria-label", "placeholder", "title", "value"]}
    text = F.nullif(F.left(collapse(F.coalesce("text", F.lit(""))), F.lit(80)), F.lit(""))
    name = F.coalesce(a["aria-label"], text, a["placeholder"], F.when(a["type"] == "submit", a["value"]), a["title"], a["name"], F.col("tag"))
    kept = F.map_filter(F.create_map(*[x for n in ATTRIBUTES for x in (F.lit(n), a[n])]), lambda _, v: v.isNotNull())
    css = F.coalesce(F.concat(F.lit("#"), a["id"]), F.when(F.col("tag").isin("input", "select", "textarea"), F.concat("tag", F.lit("[name="), a["name"], F.lit("]"))), F.when(a["href"].isNull(), F.col("tag")))
    locator = F.map_filter(F.create_map(F.lit("testid"), a["data-testid"], F.lit("css"), css, F.lit("href"), F.when(F.col("tag") == "a", a["href"]), F.lit("text"), text), lambda _, v: v.isNotNull())
    e = e.select("screen", "ord", role(F.col("tag"), a["type"]).alias("role"), name.alias("base"), a["href"].alias("href"), kept.alias("attributes"), locator.alias("locator"))
    return numbered(e).withColumn("id", stable_id("element", F.col("screen"), F.col("role"), F.col("name")))


def free_names(elements: Iterable[tuple[str, str]]) -> list[str]:
    """Names for the (role, name) of a page's elements, in order: a name that its role has already gets the next number that gives a free one."""
    last: dict[tuple[str, str], int] = {}
    taken: set[tuple[str, str]] = set()
    out = []
    for role_, base in elements:
        role_, key = role_.strip().casefold(), base.strip().casefold()
        n = last.get((role_, key), 0) + 1
        numbers = (base if i == 1 else f"{base} #{i}" for i in count(n))
        n, name = next((i, x) for i, x in enumerate(numbers, n) if (role_, x.strip().casefold()) not in taken)
        last[role_, key] = n
        taken.add((role_, name.strip().casefold()))
        out.append(name)
    return out


def numbered(elements: DataFrame) -> DataFrame:
    """Elements (screen, ord, role, base, ...) with a `name` in place of `base`, unlike the others of their screen and role; a page's elements are one group."""
    schema = T.StructType([*(f for f in elements.schema if f.name != "base"), T.StructField("name", T.StringType())])

    def name(t: pa.Table) -> pa.Table:
        t = t.sort_by("ord")
        names = free_names(zip((x or "" for x in t["role"].to_pylist()), (x or "" for x in t["base"].to_pylist()), strict=True))
        return t.drop_columns(["base"]).append_column("name", pa.array(names, pa.string()))

    return elements.groupBy("screen").applyInArrow(name, schema)


#: Where a crawl may go, and the words of actions that destroy.
ALLOWED, ALLOWED_PREFIXES = ("/", "/issues", "/notifications"), ("/user/login", "/demo")
PROHIBITED, DESTRUCTIVE = ("/admin", "/user/settings", "/user/logout", "/api"), "delete remove transfer archive wipe purge".split()


def blocked_reason(role_: Column, name: Column, host: Column, base_host: Column, path: Column, seen: Column, allowed: tuple = ALLOWED, prefixes: tuple = ALLOWED_PREFIXES) -> Column:
    """Why an action isn't taken, or null; the first reason counts. A null host or path is that of an action without a target."""
    starts = lambda ps: F.coalesce(F.array_contains(F.transform(F.array(*map(F.lit, ps)), lambda p: path.startswith(p)), True), F.lit(False))
    out = path.isNotNull() & ~(path.isin(*allowed) | starts(prefixes))
    return (
        F.when(role_ == "form", "not-actionable").when(host.isNotNull() & (host != base_host), "external-host").when(starts(PROHIBITED), "prohibited-route")
        .when(out, "out-of-scope").when(F.lower(name).rlike("|".join(DESTRUCTIVE)), "destructive-action").when(seen, "already-executed")
    )


def _target(base: str, href: str) -> dict[str, str]:
    try:
        to = urlsplit(urljoin(base, href))
        return {"host": to.hostname or "", "path": to.path or "/"}
    except ValueError:  # an address that can't be one is on no host
        return {"host": "", "path": "/"}


def target(base: Column, href: Column) -> Column:
    """Struct of the host and path that an href leads to from the address `base`; null without an href. An address without a host has an empty one, which is no page's."""

    def resolve(bases: pa.Array, hrefs: pa.Array) -> pa.Array:
        found = [_target(b or "", h) if h else None for b, h in zip(bases.to_pylist(), hrefs.to_pylist(), strict=True)]
        return pa.array(found, pa.struct([("host", pa.string()), ("path", pa.string())]))

    return F.arrow_udf(resolve, "host string, path string")(base, href)


#: What goes into a field, by its name.
FILL_KEYS = {"user_name": "username", "password": "password", "title": "issue_title", "content": "issue_body"}


def fill_key(attributes: Column) -> Column:
    """What a field is filled with, by its name or by a placeholder that speaks of a title; null for other fields."""
    by_name = F.create_map(*(F.lit(x) for pair in FILL_KEYS.items() for x in pair))[F.coalesce(attributes["name"], F.lit(""))]
    return F.coalesce(by_name, F.when(F.lower(attributes["placeholder"]).contains("title"), "issue_title"))


def action_kind(role_: Column, type_: Column) -> Column:
    return F.when(role_.isin("textbox", "combobox"), "fill").when((role_ == "button") & (F.coalesce(type_, F.lit("")) == "submit"), "submit").otherwise("click")
