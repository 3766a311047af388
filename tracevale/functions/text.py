"""Scalar functions over text, as Column expressions."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

# (?U) makes Java's \s Unicode-aware
SPACE = r"(?U)\s+"


def strip(c: Column) -> Column:
    """Without white space at both ends, of any kind (`trim` takes spaces only)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


#: What lower case leaves unlike in a full case fold, by rule: ß and ss, ς and σ, ligatures, Greek with iota and such.
UNFOLDED = {c: c.casefold() for c in map(chr, (*range(0x80, 0xD800), *range(0xE000, 0x20000))) if c.lower() == c != c.casefold()}


def fold(c: Column) -> Column:
    """The form in which names are compared: stripped, and with a full Unicode case fold."""
    low = F.lower(strip(c))
    table = F.from_json(F.lit(json.dumps(UNFOLDED)), "map<string,string>")
    each = F.transform(F.split(low, ""), lambda x: F.coalesce(F.try_element_at(table, x), x))
    # most texts are plain, and the class of all those letters is slow to search for
    return F.when(low.rlike(r"[^\x00-\x7F]") & low.rlike(f"[{''.join(UNFOLDED)}]"), F.array_join(each, "")).otherwise(low)


def collapse(c: Column) -> Column:
    return strip(F.regexp_replace(c, SPACE, " "))


def stable_id(kind: str, *parts: Column) -> Column:
    """`kind:` and 16 hex digits that depend on the natural key alone. A null part counts as the word none."""
    return F.concat(F.lit(f"{kind}:"), F.left(F.sha2(F.concat_ws("\x1f", *(fold(F.coalesce(p.cast("string"), F.lit("none"))) for p in parts)), 256), F.lit(16)))


def list_repr(ids: Column) -> Column:
    """An array of ids in the written form of a sorted list, which is part of a finding's key."""
    return F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(ids), lambda x: F.concat(F.lit("'"), x, F.lit("'"))), ", "), F.lit("]"))


def visible_text_hash(c: Column) -> Column:
    return F.left(F.sha2(collapse(c), 256), F.lit(16))


def base_name(c: Column) -> Column:
    """A numbered name without its number."""
    return F.regexp_replace(c, r" #\d+$", "")


def shorten(c: Column, most: int = 40) -> Column:
    """White space collapsed, and cut to `most` characters of which the last is an ellipsis."""
    c = collapse(c)
    return F.when(F.char_length(c) <= most, c).otherwise(F.concat(F.substring(c, 1, most - 1), F.lit("…")))


def percent(c: Column) -> Column:
    """A share in whole percent; halves go to the even number."""
    return F.bround(c * 100).cast("int")
