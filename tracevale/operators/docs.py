"""Documentation pages to articles, segments and requirements, and the gate that requirements' quotes pass.

Pages are parsed and cut in Arrow batches: a page is one row, and its parser and its cuts are linear in its length. Everything
that relates rows to one another (responses by key, first occurrences, counts) is joins and aggregates.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from html.entities import html5
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import collapse, fold, stable_id
from .graph import first_wins

#: A segment ends at a heading once so many characters of body are gathered.
SEGMENT_CHARS = 200
#: Elements that end a line, elements that are left out, a heading's line, what a requirement consists of.
BLOCKS, DROPPED = {"p", "li", "pre", "div"}, {"script", "style", "nav", "aside"}
HEADING = re.compile(r"H([1-4]):\s*(.*)")
REQUIREMENTS = "struct<requirements:array<struct<statement:string,actor:string,action:string,object:string,acceptance_clues:array<string>,source_quote:string>>>"
PROMPT_FIELDS = ("uri", "heading_path", "text")
#: An ampersand with the reference it may begin, by number or by name, that a semicolon ends.
REFERENCE = re.compile(r"&(?:(#\d+;|#[xX][\da-fA-F]+;)|([A-Za-z][A-Za-z\d]*;))?")


class _Tokens(HTMLParser):
    """What a page consists of, in order: ("<", tag), ("/", tag), ("<>", tag) and ("", text).

    A reference to a character counts without its semicolon too, as in a browser; with `bare` false it stays text.
    """

    def __init__(self, html: str, bare: bool = True):
        super().__init__(convert_charrefs=True)
        self.found: list[tuple[str, str]] = []
        stands_for = "" if bare else next(c for c in map(chr, range(0xE000, 0xF900)) if c not in html)  # an ampersand that is text
        if not bare:
            html = REFERENCE.sub(lambda m: m[0] if m[1] or m[2] in html5 else stands_for + m[0][1:], html)
        self.handle_starttag = lambda tag, _: self.found.append(("<", tag))
        self.handle_startendtag = lambda tag, _: self.found.append(("<>", tag))
        self.handle_endtag = lambda tag: self.found.append(("/", tag))
        self.handle_data = lambda text: self.found.append(("", text if bare else text.replace(stands_for, "&")))
        try:
            self.feed(html)
            self.close()
        except AssertionError:  # a marked section that isn't known: what stands before it counts
            pass


def first_article(html: str, bare: bool = True) -> str:
    """The lines of a page's first article; `bare` as in `_Tokens`.

    Articles may be nested; the first one ends where as many have ended as begun, or with the page. Dropped elements are
    skipped with all that is in them. A heading is a line `Hn: title` of its own; markup in a title adds nothing to it.
    """
    out: list[str] = []
    title: list[str] = []
    articles = dropped = level = 0
    for kind, x in _Tokens(html, bare).found:
        if (kind, x) == ("<", "article"):
            articles += 1
        elif not articles:
            continue
        elif dropped:
            dropped += (x in DROPPED) * {"<": 1, "/": -1}.get(kind, 0)
        elif kind == "<" and x in DROPPED:
            dropped = 1
        elif (kind, x) == ("/", "article"):
            articles -= 1
            if not articles:
                break
        elif kind == "<" and re.fullmatch("h[1-4]", x):
            level, title = int(x[1]), []
        elif level and kind == "/" and x == f"h{level}":
            out.append(f"\nH{level}: {_spaced(''.join(title)).strip()}\n")
            level = 0
        elif kind == "<>":
            out.append(" ")
        elif level:
            title += [x] * (not kind)
        elif kind:
            out.append("\n" if kind == "/" and x in BLOCKS else " ")
        else:
            out.append(x)
    lines = (line.strip() for line in _spaced("".join(out)).splitlines())
    return "\n".join(line for line in lines if line)


def _spaced(text: str) -> str:
    return re.sub(r"[^\S\n]+", " ", text)


def article_text(html: Column, bare: bool = True) -> Column:
    """The text of a page's first article, a line for each block; null for a null page.

    References to characters without a semicolon are read, as the reference and browsers read them, unless `bare` is false.
    """
    parse = F.arrow_udf(lambda pages: pa.array([None if p is None else first_article(p, bare) for p in pages.to_pylist()], pa.string()), "string")
    return parse(html)


def cut_segments(text: str) -> Iterator[tuple[list[str], str, int, int]]:
    """(heading_path, text, start_offset, end_offset) of a text's segments.

    A segment ends at the first heading at which SEGMENT_CHARS characters of body have come together, which a search in the
    body's running lengths finds, or at the text's end. Its path is that of the last heading before its end: a heading of
    level n stands behind the outer n - 1 headings, or as many as there are.
    """
    lines = text.splitlines(keepends=True)
    bare = [line.rstrip("\r\n") for line in lines]
    start = np.cumsum([0, *map(len, lines)])
    titles = {i: (int(m[1]), m[2].strip()) for i, line in enumerate(bare) if (m := HEADING.fullmatch(line))}
    heads = np.array(list(titles), np.int64)
    body = np.cumsum([0, *(0 if i in titles else len(line) for i, line in enumerate(bare))])
    paths: list[list[str]] = [[]]
    for level, title in titles.values():
        paths.append([*paths[-1][: level - 1], title])
    line = 0
    while line < len(lines):
        nth = int(np.searchsorted(body[heads], body[line] + SEGMENT_CHARS)) if len(heads) else 0
        end = int(heads[nth]) if nth < len(heads) else len(lines)
        own = [i for i in range(line, end) if bare[i] and i not in titles]
        if own:
            yield paths[min(nth, len(heads))], "\n".join(bare[i] for i in own), int(start[own[0]]), int(start[own[-1]]) + len(bare[own[-1]])
        line = end


def segments(docs: DataFrame) -> DataFrame:
    """(uri, ordinal, heading_path, text, start_offset, end_offset) of texts (uri, text); a text without body gives none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = list(cut_segments(text.as_py() or ""))
                columns = [pa.array([uri] * len(found), pa.string()), pa.array(range(len(found)), pa.int32())]
                kinds = (pa.list_(pa.string()), pa.string(), pa.int32(), pa.int32())
                columns += [pa.array([s[k] for s in found], kind) for k, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays(columns, ["uri", "ordinal", "heading_path", "text", "start_offset", "end_offset"])

    return docs.select(F.col("uri").cast("string"), "text").mapInArrow(run, "uri string, ordinal int, heading_path array<string>, text string, start_offset int, end_offset int")


def snapshot_segments(pages: DataFrame, bare: bool = True) -> DataFrame:
    """Segments of snapshots (uri, html); `bare` as in `article_text`."""
    return segments(pages.select("uri", article_text(F.col("html"), bare).alias("text")))


def _quoted(items: DataFrame) -> Column:
    q, t = fold(collapse(F.coalesce("quote", F.lit("")))), fold(collapse(F.coalesce("text", F.lit(""))))
    return (q != "") & (F.instr(t, q) > 0)


def gate_quotes(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Kept and rejected rows of (text, quote, ...): a quote must be non-empty and stand in the segment's text."""
    ok = _quoted(items)
    return items.where(ok), items.where(~ok)


def request_key(model: Column, prompt: Column, schema: Column) -> Column:
    """The name under which a response is stored: SHA-256 of the request as JSON with sorted keys; `schema` is JSON itself."""

    def key(models: pa.Array, prompts: pa.Array, schemas: pa.Array) -> pa.Array:
        rows = zip(models.to_pylist(), prompts.to_pylist(), schemas.to_pylist(), strict=True)
        texts = (json.dumps({"model": m, "prompt": p, "schema": json.loads(s)}, sort_keys=True) for m, p, s in rows)
        return pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts], pa.string())

    return F.arrow_udf(key, "string")(F.coalesce(model, F.lit("none")), F.coalesce(prompt, F.lit("")), F.coalesce(schema, F.lit("null")))


def cached_responses(requests: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests (model, prompt, schema) with the response stored under their key, and those without one."""
    r = requests.withColumn("cache_key", request_key(F.col("model"), F.col("prompt"), F.col("schema")))
    return r.join(cache, "cache_key"), r.join(cache, "cache_key", "left_anti")


def prompts(segs: DataFrame, template: str) -> Column:
    """A prompt for each segment: `template` with its {uri}, {heading_path} and {text}."""
    of = {"uri": F.col("uri"), "heading_path": F.array_join("heading_path", " > "), "text": F.col("text")}
    parts = re.split(r"\{(" + "|".join(PROMPT_FIELDS) + r")\}", template)
    return F.concat(*(of[x] if i % 2 else F.lit(x) for i, x in enumerate(parts)))


def requirements(segs: DataFrame, cache: DataFrame, template: str, schema: str, model: str, run_id: str, revision: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Requirement records, rejected items and segments without a stored response, of segments and stored responses (cache_key, response).

    An item's quote must stand in its segment. Of items with one id, the first in the order of segments and items stays.
    """
    asked = segs.withColumns({"model": F.lit(model), "prompt": prompts(segs, template), "schema": F.lit(schema)})
    answered, missing = cached_responses(asked, cache)
    parsed, given = F.from_json("response", REQUIREMENTS), F.get_json_object("response", "$.requirements")
    odd = F.coalesce(~F.ltrim("response").startswith("{"), F.lit(True)) | parsed.isNull() | F.coalesce(~given.startswith("["), F.lit(False))
    answered = answered.withColumn("items", F.when(odd, F.raise_error(F.concat(F.lit("not a response: "), "cache_key"))).otherwise(parsed["requirements"]))
    items = answered.select("uri", "ordinal", "heading_path", "text", "start_offset", "end_offset", F.posexplode("items").alias("nth", "item"))
    kept, rejected = gate_quotes(items.withColumn("quote", F.col("item.source_quote")))
    span = F.struct("uri", "heading_path", F.col("quote"), F.col("start_offset"), F.col("end_offset"))
    records = kept.select(
        stable_id("requirement", F.col("uri"), F.col("item.statement")).alias("id"), F.lit("1.0.0").alias("schema_version"), F.lit(run_id).alias("run_id"), F.lit("ingest").alias("source"), F.lit(revision).alias("source_revision"),
        *(F.col(f"item.{c}").alias(c) for c in ("statement", "actor", "action", "object")), F.coalesce("item.acceptance_clues", F.array().cast("array<string>")).alias("acceptance_clues"), span.alias("source_span"), F.lit(True).alias("testable"),
        "ordinal", "nth",
    )
    once = first_wins(records, ["id"], "ordinal", "nth").drop("ordinal", "nth")
    return once, rejected.select("uri", F.col("heading_path").alias("segment"), F.lit("quote-not-found").alias("reason"), "item"), missing


def ingest(pages: DataFrame, cache: DataFrame, template: str, schema: str, model: str, run_id: str, revision: str) -> tuple[DataFrame, DataFrame]:
    """Requirement records of snapshots (uri, html), and one row of counts (segments, requirements, rejects, missing)."""
    segs = snapshot_segments(pages)
    records, rejects, missing = requirements(segs, cache, template, schema, model, run_id, revision)
    named = [df.select(F.lit(n).alias("step")) for n, df in (("segments", segs), ("requirements", records), ("rejects", rejects), ("missing", missing))]
    steps = named[0].unionByName(named[1]).unionByName(named[2]).unionByName(named[3])
    return records, steps.agg(*(F.count_if(F.col("step") == n).alias(n) for n in ("segments", "requirements", "rejects", "missing")))
