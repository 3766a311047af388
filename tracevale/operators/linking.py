"""Evidence joins between elements, code symbols and requirements, and their scores."""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import fold, stable_id

#: Weight of each kind of signal, and the kinds that are strong by themselves.
WEIGHTS = {"route-exact": 0.75, "href-exact": 0.70, "text-exact": 0.65, "clue-element-exact": 0.60, "css-id": 0.55, "clue-element-sub": 0.35, "object-words": 0.30}
STRONG = ("href-exact", "route-exact", "text-exact", "clue-element-exact")
KEY = ["source", "target", "link_type"]
#: Terms of an automaton, and names that a task reads with it, on average.
TERMS, NAMES = 200_000, 1_000_000


def link_type(kind: Column, file: Column) -> Column:
    handled = kind.isin("function", "method", "type", "route")
    return F.when(kind.isin("template", "template_block", "ts_module") | file.endswith(".ts"), "rendered_by").when(handled, "handled_by")


def _signal(rows: DataFrame, source: str, target: str, kind: str, evidence: Column, type_: str | Column = "link_type") -> DataFrame:
    return rows.select(F.col(source).alias("source"), F.col(target).alias("target"), (F.col(type_) if isinstance(type_, str) else type_).alias("link_type"), F.lit(kind).alias("kind"), evidence.alias("evidence"), F.lit(WEIGHTS[kind]).cast("double").alias("weight"))


def ui_code_signals(elements: DataFrame, screens: DataFrame, symbols: DataFrame) -> DataFrame:
    """(source, target, link_type, kind, evidence, weight): an anchor of a symbol equals an element's name, href or css id, or a screen's route.

    All four are equi-joins on the anchor's value.
    """
    a = symbols.withColumn("link_type", link_type(F.col("kind"), F.col("file"))).where("link_type is not null")
    a = a.select(F.col("id").alias("symbol_id"), "link_type", F.explode("ui_anchors").alias("anchor")).where(F.instr("anchor", ":") > 0)
    a = a.select("symbol_id", "link_type", F.substring_index("anchor", ":", 1).alias("prefix"), F.regexp_replace("anchor", r"^[^:]*:", "").alias("value"))
    e = elements.select(F.col("id").alias("element_id"), fold(F.col("name")).alias("name"), F.col("attributes")["href"].alias("href"), F.col("locator_evidence")["css"].alias("css"))

    def of(prefix: str, value: Column = F.col("value")) -> DataFrame:
        return a.where(F.col("prefix") == prefix).withColumn("join_value", value)

    text = e.join(of("text", fold(F.col("value"))).where("join_value <> ''"), F.col("name") == F.col("join_value"))
    href = e.join(of("href"), F.col("href") == F.col("join_value"))
    css = e.join(of("css").where(F.col("value").startswith("#")), F.col("css") == F.col("join_value"))
    route = screens.select(F.col("id").alias("screen_id"), "route_pattern").join(of("route").where("link_type = 'handled_by'"), F.col("route_pattern") == F.col("join_value"))
    out = [_signal(x, s, "symbol_id", k, F.concat(F.lit(f"{p}:"), F.col("value"))) for x, s, k, p in ((text, "element_id", "text-exact", "text"), (href, "element_id", "href-exact", "href"), (css, "element_id", "css-id", "css"), (route, "screen_id", "route-exact", "route"))]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


def contained_in_names(terms: DataFrame, names: DataFrame) -> DataFrame:
    """(term, name) with the folded `term` a proper part of the folded `name`; each table has distinct values of its column.

    Terms and names are dealt into parts of bounded size. Each task has one part of either: it builds an automaton over its
    terms and reads its names once, whatever the terms' lengths and however many names have a piece in common.
    """
    t, n = terms.where("term <> ''"), names.where("name <> ''")
    of = {"terms": max(1, -(-t.count() // TERMS)), "names": max(1, -(-n.count() // NAMES))}
    part = lambda c, k: F.pmod(F.xxhash64(c), F.lit(k)).cast("int")
    each = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    t = t.select(part("term", of["terms"]).alias("i"), each(of["names"]).alias("j"), "term")
    n = n.select(each(of["terms"]).alias("i"), part("name", of["names"]).alias("j"), "name")

    def find(own: pa.Table, texts: pa.Table) -> pa.Table:
        automaton = ahocorasick.Automaton()
        for term in own["term"].to_pylist():
            automaton.add_word(term, term)
        found: list[tuple[str, str]] = []
        if len(automaton):
            automaton.make_automaton()
            for name in texts["name"].to_pylist():
                found += [(term, name) for term in {x for _, x in automaton.iter(name)} if term != name]
        return pa.table({"term": pa.array([x for x, _ in found], pa.string()), "name": pa.array([x for _, x in found], pa.string())})

    return t.groupBy("i", "j").cogroup(n.groupBy("i", "j")).applyInArrow(find, "term string, name string")


def requirement_signals(requirements: DataFrame, elements: DataFrame) -> DataFrame:
    """Signals of acceptance clues that equal a name or stand in it, and of objects all of whose longer words stand in it."""
    e = elements.select(F.col("id").alias("element_id"), fold(F.col("name")).alias("name")).where("name <> ''")
    names, implements = e.select("name").distinct(), F.lit("implements")
    clues = requirements.select(F.col("id").alias("requirement_id"), F.explode("acceptance_clues").alias("clue")).withColumn("term", fold(F.col("clue"))).where("term <> ''")
    exact = clues.join(e, F.col("term") == F.col("name"))
    part = clues.join(contained_in_names(clues.select("term").distinct(), names), "term").join(e, "name")
    words = F.array_distinct(F.filter(F.split(fold(F.col("object")), r"(?U)\s+"), lambda w: F.char_length(w) > 3))
    o = requirements.select(F.col("id").alias("requirement_id"), "object", words.alias("words")).where("size(words) > 0")
    terms = o.select(F.explode("words").alias("term")).distinct()
    # a name has all words if as many of them are in it, or equal it, as there are
    inside = contained_in_names(terms, names).unionByName(terms.join(names, F.col("term") == F.col("name")))
    both = o.select("requirement_id", "object", F.size("words").alias("n"), F.explode("words").alias("term")).join(inside, "term")
    both = both.groupBy("requirement_id", "object", "n", "name").agg(F.count(F.lit(1)).alias("found")).where("found = n").join(e, "name")
    out = [_signal(x, "requirement_id", "element_id", k, F.col(c), implements) for x, k, c in ((exact, "clue-element-exact", "clue"), (part, "clue-element-sub", "clue"), (both, "object-words", "object"))]
    return out[0].unionByName(out[1]).unionByName(out[2])


def score_links(signals: DataFrame, strong: tuple[str, ...] = STRONG) -> DataFrame:
    """(source, target, link_type, confidence, method, evidence, review_status): one link for each pair.

    Of equal evidence the heaviest signal counts. The confidence is one minus the product of what each leaves open,
    multiplied in the order of the evidence, so that it doesn't depend on how rows are dealt out.
    """
    best = signals.groupBy(*KEY, "evidence").agg(F.max(F.struct("weight", "kind")).alias("s"))
    rows = F.array_sort(F.collect_list(F.struct("evidence", F.col("s.weight").alias("weight"), F.col("s.kind").alias("kind"))))
    g = best.groupBy(*KEY).agg(rows.alias("rows"))
    confidence = 1 - F.aggregate("rows", F.lit(1.0).cast("double"), lambda a, x: a * (1 - x["weight"]))
    g = g.withColumn("confidence", confidence)
    is_strong = F.exists("rows", lambda x: x["kind"].isin(*strong))
    band = F.when((F.col("confidence") >= 0.85) & is_strong, "auto_accepted").when(F.col("confidence") >= 0.55, "needs_review").otherwise("unresolved")
    method = F.array_join(F.array_sort(F.array_distinct(F.transform("rows", lambda x: x["kind"]))), "+")
    evidence = F.transform("rows", lambda x: F.concat(x["kind"], F.lit(":"), x["evidence"]))
    return g.select(*KEY, "confidence", method.alias("method"), evidence.alias("evidence"), band.alias("review_status"))


def link_records(elements: DataFrame, screens: DataFrame, symbols: DataFrame, requirements: DataFrame, run_id: str = "unknown", revision: str = "unknown") -> DataFrame:
    """Trace link records, with the columns of their kind."""
    links = score_links(ui_code_signals(elements, screens, symbols).unionByName(requirement_signals(requirements, elements)))
    links = links.withColumn("id", stable_id("trace_link", *(F.col(k) for k in KEY))).withColumnsRenamed({"source": "source_entity_id", "target": "target_entity_id"})
    base = {"schema_version": F.lit("1.0.0"), "run_id": F.lit(run_id), "source": F.lit("linking"), "source_revision": F.lit(revision)}
    return links.select("id", *(c.alias(n) for n, c in base.items()), "source_entity_id", "target_entity_id", "link_type", "confidence", "method", "evidence", "review_status")


def link_run(spark: SparkSession, root: str, run_id: str, code_root: str | None = None, docs_root: str | None = None) -> dict[str, int]:
    """Link the records of a run's folder, with code and requirements from other folders if given; write the links there and count them by status."""
    from ..sources import record_files

    read = {kind: record_files.read(spark, at or root, kind) for kind, at in (("elements", None), ("screens", None), ("requirements", docs_root), ("code_symbols", code_root))}
    first = (df.select("source_revision").head() for df in read.values())  # of the first record there is
    revision = next((r.source_revision for r in first if r), "unknown")
    record_files.save(link_records(read["elements"], read["screens"], read["code_symbols"], read["requirements"], run_id, revision), root, "trace_links")
    return status_counts(record_files.read(spark, root, "trace_links").where(F.col("run_id") == run_id)).first().asDict()


def in_order(links: DataFrame) -> DataFrame:
    return links.orderBy("source_entity_id", "target_entity_id", "link_type")


def status_counts(links: DataFrame) -> DataFrame:
    return links.agg(*(F.count_if(F.col("review_status") == s).alias(s) for s in ("auto_accepted", "needs_review", "unresolved")))
