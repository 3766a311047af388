"""Code symbols, their spans, and the anchors that tie them to the UI."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Declarations by file suffix: pattern of a line, group of the name, kind (null: only ends the symbol before).
DECLARATIONS = {
    ".go": ((r"(?U)^func \(\s*\w+\s+\*?(\w+)\s*\) (\w+)\(", 2, "method"), (r"(?U)^func (\w+)\(", 1, "function"), (r"(?U)^type (\w+) ", 1, "type"), (r"(?U)^(?:func|type|var|const)\b", 0, None)),
    ".ts": ((r"(?U)^(?:export )?(?:async )?function (\w+)", 1, "function"), (r"(?U)^(?:export )?const (\w+) = (?:async )?\(", 1, "function")),
}
#: A block of a template, of which a line can hold several; what ends a line, for counting lines.
DEFINE = r"""(?U)\{\{\s*define\s+"([^"]+)"\s*\}\}"""
LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"
WHOLE_FILE = {".tmpl": "template", ".ts": "ts_module"}
ANCHORS_KEPT = 40
#: Lines of a file whose spans and hunks are swept together.
BIN = 4096


def line_count(content: Column) -> Column:
    """Lines of a text, at least 1; a line end at the text's end begins no line."""
    lines = F.split(content, LINE_END)
    return F.greatest(F.lit(1), F.size(lines) - (F.element_at(lines, -1) == "").cast("int"))


def symbols(files: DataFrame) -> DataFrame:
    """(path, qualified_name, kind, line_start, line_end) of files (path, content): each declaration up to the next one.

    A declaration that isn't a symbol (a variable, a generic function, a group of types) ends the one before it as well. A
    block of a template ends before the line of the next block, which can be its own.
    """
    lines = files.select("path", line_count(F.col("content")).alias("n_lines"), F.posexplode(F.split("content", "\n")).alias("line", "text")).withColumn("line", F.col("line") + 1)
    name, kind, known = F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(False)
    for suffix, rules in DECLARATIONS.items():
        for pattern, group, k in reversed(rules):
            hit = F.col("path").endswith(suffix) & F.col("text").rlike(pattern)
            known = known | hit
            full = F.concat_ws(".", F.regexp_extract("text", pattern, 1), F.regexp_extract("text", pattern, 2)) if group == 2 else F.regexp_extract("text", pattern, group)
            name, kind = F.when(hit, full).otherwise(name), F.when(hit, F.lit(k)).otherwise(kind)
    d = lines.withColumns({"qualified_name": name, "kind": kind}).where(known).select("path", "n_lines", "line", F.lit(0).alias("nth"), "qualified_name", "kind")
    blocks = lines.where(F.col("path").endswith(".tmpl")).select("path", "n_lines", "line", F.posexplode(F.regexp_extract_all("text", F.lit(DEFINE), F.lit(1))).alias("nth", "qualified_name"))
    d = d.unionByName(blocks.withColumn("kind", F.lit("template_block")))
    following = F.lead("line").over(Window.partitionBy("path").orderBy("line", "nth"))
    end = F.coalesce(following - 1, F.col("n_lines"))
    d = d.select("path", "qualified_name", "kind", F.col("line").alias("line_start"), end.alias("line_end")).where("kind is not null")
    whole = F.lit(None).cast("string")
    for suffix, k in WHOLE_FILE.items():
        whole = F.when(F.col("path").endswith(suffix), k).otherwise(whole)
    short = F.when(F.col("path").endswith(".tmpl"), F.regexp_replace(F.regexp_replace("path", "^templates/", ""), r"\.tmpl$", "")).otherwise(F.col("path"))
    f = files.select("path", short.alias("qualified_name"), whole.alias("kind"), F.lit(1).alias("line_start"), line_count(F.col("content")).alias("line_end")).where("kind is not null")
    return d.unionByName(f)


def touched(spans: DataFrame, hunks: DataFrame) -> DataFrame:
    """Symbols (path, line_start, line_end) that a hunk (path, start, count) of their file overlaps.

    A hunk overlaps a span if it starts no later than the span ends, and reaches it: so the furthest end of all hunks that
    start by then decides, which one pass over starts and ends in order gives. A file's lines are dealt out in bins, each of
    which begins with the furthest end of the bins before it, so that no file is one task's work.
    """
    s = spans.where("path is not null and line_start is not null and line_end is not null").select(F.struct(*(F.col(f"`{c}`") for c in spans.columns)).alias("row"), "path", F.col("line_end").cast("long").alias("at"), F.col("line_start").cast("long").alias("low"))
    h = hunks.where("path is not null and start is not null").select("path", F.col("start").cast("long").alias("at"), (F.col("start") + F.greatest("count", F.lit(1)) - 1).cast("long").alias("reach"))
    e = h.withColumn("low", F.lit(None).cast("long")).unionByName(s, allowMissingColumns=True).withColumn("bin", F.floor(F.col("at") / BIN))
    bins = e.groupBy("path", "bin").agg(F.max("reach").alias("furthest"))
    before = F.max("furthest").over(Window.partitionBy("path").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1))
    carried = bins.select("path", "bin", before.alias("before"))
    reached = F.max("reach").over(Window.partitionBy("path", "bin").orderBy("at", F.asc_nulls_first("low")).rowsBetween(Window.unboundedPreceding, 0))
    e = e.withColumn("reached", reached).where("low is not null").join(carried, ["path", "bin"])
    return e.where(F.greatest("reached", "before") >= F.col("low")).select("row.*")


def changed_symbols(base: DataFrame, head: DataFrame, diffs: DataFrame) -> DataFrame:
    """Symbols that a diff touches, with the `side` they are of: of the old file, and those new in the new file; renamed files have none."""
    side = lambda types, s, n: diffs.where(F.col("change_type").isin(*types)).select("path", F.explode("hunks").alias("h")).select("path", F.col(f"h.{s}").alias("start"), F.col(f"h.{n}").alias("count"))
    old = touched(base, side(["modified", "deleted"], "old_start", "old_count"))
    new = touched(head, side(["modified", "added"], "new_start", "new_count"))
    return old.withColumn("side", F.lit("old")).unionByName(new.join(old, ["path", "qualified_name"], "left_anti").select(*old.columns).withColumn("side", F.lit("new")))


def span_text(content: Column, start: Column, end: Column) -> Column:
    return F.array_join(F.slice(F.split(content, "\n"), start, end - start + 1), "\n")


#: What an anchor looks like, by the files that can hold it: prefix, pattern, group.
ANCHORS = {
    ".tmpl": (("locale:", r'Locale\.TrN?\s+"([\w.-]+)"', 1), ("href:", r'href="(/[^"]*)"', 1), ("css:#", r'id="([^"]+)"', 1)),
    ".go": (("route:", r'\bm\.(?:Get|Post|Combo)\(\s*"([^"]+)"', 1), ("template_name:", r'\btemplates\.TplName\s*=\s*"([^"]+)"', 1), ("template_name:", r'\btpl\w*\b[^=\n]*=\s*"([^"]+)"', 1)),
    ".ts": (("css:", r"""querySelector(?:All)?\(\s*(['"])([.#][^'"]*)\1\s*\)""", 2), ("css:", r"""(['"])([.#][^'"\r\n]*)\1""", 2)),
}
ROUTERS = "routers/"


def _prefixed(prefix: str, found: Column) -> Column:
    return F.transform(found, lambda x: F.concat(F.lit(prefix), x))


def _anchors_found(path: Column, text: Column) -> Column:
    """All anchors of a span in the order of the rules, distinct; the template's own name is the last of its anchors."""
    empty = F.array().cast("array<string>")
    found = empty
    for suffix, rules in ANCHORS.items():
        lists = [_prefixed(prefix, F.regexp_extract_all(text, F.lit(pattern), F.lit(group))) for prefix, pattern, group in rules]
        # an address with a template's braces in it isn't known
        own = F.filter(F.concat(*lists), lambda x: ~(x.startswith("href:") & x.contains("{{")))
        if suffix == ".tmpl":
            own = F.concat(own, F.array(F.concat(F.lit("template:"), path)))
        here = path.endswith(suffix) & (path.startswith(ROUTERS) if suffix == ".go" else F.lit(True))
        found = F.when(here, own).otherwise(found)
    return F.array_distinct(found)


def anchors(spans: DataFrame, locales: DataFrame | None = None) -> DataFrame:
    """(path, qualified_name, anchors) of rows (path, qualified_name, text): the first distinct anchors, in the order they are found.

    With `locales` (key, text) a locale anchor is followed by its English text, which counts among the anchors kept.
    """
    rows = spans.select("path", "qualified_name", _anchors_found(F.col("path"), F.col("text")).alias("anchors"))
    if locales is None:
        return rows.withColumn("anchors", F.slice("anchors", 1, ANCHORS_KEPT))
    e = rows.select("path", "qualified_name", F.posexplode_outer("anchors").alias("at", "anchor"))
    e = e.withColumn("key", F.when(F.col("anchor").startswith("locale:"), F.substring("anchor", 8, 1 << 30)))
    known = locales.groupBy("key").agg(F.max("text").alias("english"))
    both = F.array(F.struct("at", F.lit(0).alias("nth"), "anchor"), F.struct("at", F.lit(1).alias("nth"), F.concat(F.lit("text:"), "english").alias("anchor")))
    e = e.join(known, "key", "left").select("path", "qualified_name", F.explode(both).alias("x"))
    g = e.groupBy("path", "qualified_name").agg(F.array_sort(F.collect_list("x")).alias("x"))
    return g.select("path", "qualified_name", F.slice(F.array_distinct(F.filter(F.transform("x", lambda y: y["anchor"]), lambda y: y.isNotNull())), 1, ANCHORS_KEPT).alias("anchors"))


def resolve_locales(rows: DataFrame, locales: DataFrame) -> DataFrame:
    """(path, qualified_name, anchor): every anchor, and the English text of each locale anchor found in (key, text)."""
    a = rows.select("path", "qualified_name", F.explode("anchors").alias("anchor"))
    key = F.when(F.col("anchor").startswith("locale:"), F.substring("anchor", 8, 1 << 30))
    text = a.withColumn("key", key).join(locales, "key").select("path", "qualified_name", F.concat(F.lit("text:"), F.col("text")).alias("anchor"))
    return a.unionByName(text).distinct()


def string_leaves(text: str | None) -> list[tuple[str, str]]:
    """(dotted path, text) of the string leaves of a JSON object, in order; none of anything else, or of what isn't JSON."""
    try:
        rest = [("", json.loads(text or ""))]
    except (ValueError, RecursionError):
        return []
    out = []
    while rest:
        path, value = rest.pop()
        if isinstance(value, dict):
            rest += [(f"{path}.{k}" if path else k, v) for k, v in reversed(value.items())]
        elif isinstance(value, str) and path:
            out.append((path, value))
    return out


def flat_locales(files: DataFrame) -> DataFrame:
    """(key, text) of nested JSON texts in column `value`: dotted paths of string leaves, however deep; malformed texts give none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0):
                found = string_leaves(text.as_py())
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.string()) for k in (0, 1)], ["key", "text"])

    return files.select("value").mapInArrow(run, "key string, text string")
