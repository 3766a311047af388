"""From changed code to what it puts at risk: traversal rows, findings, unmapped changes, absences and coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import list_repr, stable_id

VIABLE = ("auto_accepted", "needs_review")
PATH = ["change_id", "symbol_id", "element_id", "screen_id", "flow_id"]


def viable(links: DataFrame, *types: str) -> DataFrame:
    ok = F.col("review_status").isin(*VIABLE)
    return links.where(ok & F.col("link_type").isin(*types) if types else ok)


def seeds(changes: DataFrame, symbols: DataFrame, pr_number: int | None = None) -> DataFrame:
    c = changes if pr_number is None else changes.where(F.col("pr_number") == pr_number)
    c = c.select(F.col("id").alias("change_id"), "file", "change_type", F.explode("changed_symbol_ids").alias("symbol_id")).distinct()
    return c.join(symbols.select(F.col("id").alias("symbol_id")), "symbol_id", "left_semi")


def impact_rows(changes: DataFrame, symbols: DataFrame, links: DataFrame, elements: DataFrame, screens: DataFrame, interactions: DataFrame, flows: DataFrame, requirements: DataFrame, pr_number: int | None = None) -> DataFrame:
    """One row for each path of a change; the element's branch and the screen's branch. Optional parts are filtered before their left joins."""
    seed = seeds(changes, symbols, pr_number)
    edge = viable(links, "rendered_by", "handled_by").select(F.col("source_entity_id").alias("from_id"), F.col("target_entity_id").alias("symbol_id"), "link_type", F.col("confidence").alias("mapping_confidence"))
    el = elements.select(F.col("id").alias("element_id"), F.col("name").alias("element_name"), "screen_id")
    sc = screens.select(F.col("id").alias("screen_id"), "route_pattern")
    steps = flows.select(F.col("id").alias("flow_id"), F.col("goal").alias("flow_goal"), F.size("interaction_ids").alias("step_count"), F.explode("interaction_ids").alias("interaction_id"))
    it = interactions.select(F.col("id").alias("interaction_id"), "element_id", "source_state_id", "target_state_id")
    by_element = steps.join(it, "interaction_id").select("element_id", "flow_id", "flow_goal", "step_count")
    req = viable(links, "implements").select(F.col("source_entity_id").alias("requirement_id"), F.col("target_entity_id").alias("element_id"), F.col("confidence").alias("req_confidence"))
    req = req.join(requirements.select(F.col("id").alias("requirement_id"), F.col("statement").alias("requirement_statement")), "requirement_id")
    one = seed.join(edge, "symbol_id").join(el, F.col("from_id") == F.col("element_id")).join(sc, "screen_id", "left").join(by_element, "element_id", "left").join(req, "element_id", "left")
    one = one.withColumn("path_confidence", F.least("mapping_confidence", "req_confidence"))
    by_screen = steps.join(it, "interaction_id").select(F.explode(F.array_distinct(F.array("source_state_id", "target_state_id"))).alias("screen_id"), "flow_id", "flow_goal", "step_count").distinct()
    two = seed.join(edge.where("link_type = 'handled_by'"), "symbol_id").join(sc, F.col("from_id") == F.col("screen_id")).join(by_screen, "screen_id", "left")
    null = F.lit(None).cast("string")
    two = two.withColumns({"element_id": null, "element_name": null, "requirement_id": null, "requirement_statement": null, "path_confidence": F.col("mapping_confidence")})
    columns = ["change_id", "file", "change_type", "symbol_id", "element_id", "element_name", "screen_id", "route_pattern", "flow_id", "flow_goal", "step_count", "requirement_id", "requirement_statement", "mapping_confidence", "path_confidence"]
    return one.select(*columns).unionByName(two.select(*columns))


def best_paths(rows: DataFrame) -> DataFrame:
    """(symbol_id, element_id, path): of each pair's paths the surest, then the first in order."""
    path = F.array_compact(F.array(*PATH))
    w = Window.partitionBy("symbol_id", "element_id").orderBy(F.desc("path_confidence"), "path")
    return rows.where("element_id is not null").withColumn("path", path).withColumn("n", F.row_number().over(w)).where("n = 1").select("symbol_id", "element_id", "path")


def severity(has_flow, confidence, has_element):
    return F.when(has_flow & (confidence >= 0.8), "high").when(has_element, "medium").otherwise("low")


def findings(rows: DataFrame) -> DataFrame:
    """One finding for each changed symbol that affects anything."""
    ids = F.array_compact(F.array("element_id", "screen_id", "flow_id", "requirement_id"))
    affected = rows.select("symbol_id", F.explode(ids).alias("id")).distinct().groupBy("symbol_id").agg(F.array_sort(F.collect_list("id")).alias("affected_entity_ids"))
    g = rows.groupBy("symbol_id").agg(
        F.max("mapping_confidence").alias("confidence"),
        F.bool_or(F.col("flow_id").isNotNull()).alias("has_flow"), F.bool_or(F.col("element_id").isNotNull()).alias("has_element"),
        F.array_join(F.array_sort(F.collect_set("file")), ", ").alias("files"),
    )
    p = best_paths(rows).groupBy("symbol_id").agg(F.array_sort(F.collect_list(F.struct("element_id", "path"))).alias("p")).select("symbol_id", F.transform("p", lambda x: x["path"]).alias("path_entity_ids"))
    g = g.join(affected, "symbol_id").join(p, "symbol_id", "left").withColumn("severity", severity(F.col("has_flow"), F.col("confidence"), F.col("has_element")))
    return g.select(stable_id("impact", F.col("symbol_id"), list_repr(F.col("affected_entity_ids"))).alias("id"), F.col("symbol_id").alias("changed_symbol_id"), "path_entity_ids", "affected_entity_ids", "severity", "confidence", "files")


def in_order(rows: DataFrame) -> DataFrame:
    """Impact rows by their ids; missing ones come last."""
    return rows.orderBy(*(F.asc_nulls_last(c) for c in ("change_id", "symbol_id", "element_id", "screen_id", "flow_id", "requirement_id")))


def ranked(found: DataFrame) -> DataFrame:
    return found.orderBy(F.when(F.col("severity") == "high", 0).when(F.col("severity") == "medium", 1).otherwise(2), "id")


def unmapped(changes: DataFrame, symbols: DataFrame, links: DataFrame, viable_only: bool = False) -> DataFrame:
    """Changes none of whose symbols has a link from the UI. Unless `viable_only`, an unresolved link counts as one."""
    ui = (viable(links, "rendered_by", "handled_by") if viable_only else links.where(F.col("link_type").isin("rendered_by", "handled_by"))).select(F.col("target_entity_id").alias("symbol_id")).distinct()
    mapped = seeds(changes, symbols).join(ui, "symbol_id", "left_semi").select(F.col("change_id").alias("id"))
    reason = F.when(F.size(F.coalesce("changed_symbol_ids", F.array().cast("array<string>"))) == 0, "no symbols extracted").otherwise("no UI link found")
    return changes.join(mapped, "id", "left_anti").select("file", "change_type", reason.alias("reason"))


#: Fixed value: why an absence is recorded.
ABSENT = "No accepted or review-pending trace link from this requirement to any observed screen or element in this run."


def absences(requirements: DataFrame, links: DataFrame, crawl_run_id: str) -> DataFrame:
    """Requirements without a viable link; 0.7 is how sure a missing link is a missing feature."""
    r = requirements.join(viable(links).select(F.col("source_entity_id").alias("id")), "id", "left_anti")
    evidence = F.when(F.size("acceptance_clues") > 0, F.col("acceptance_clues")).otherwise(F.array("statement"))
    return r.select(stable_id("absence", F.col("id"), F.lit(crawl_run_id)).alias("id"), F.col("id").alias("requirement_id"), F.lit(crawl_run_id).alias("crawl_run_id"), F.lit(f"crawl-run:{crawl_run_id};screens+elements+links").alias("search_scope"), evidence.alias("expected_evidence"), F.lit(0.7).cast("double").alias("confidence"), F.lit(ABSENT).alias("explanation"))


def coverage(requirements: DataFrame, links: DataFrame, missing: DataFrame) -> DataFrame:
    """(requirement_id, accepted, pending, absent); links are counted before absences are joined, so neither multiplies the other."""
    n = links.where("link_type = 'implements'").groupBy(F.col("source_entity_id").alias("id")).agg(F.count_if(F.col("review_status") == "auto_accepted").alias("a"), F.count_if(F.col("review_status") == "needs_review").alias("p"))
    m = missing.groupBy(F.col("requirement_id").alias("id")).agg(F.countDistinct("id").alias("m"))
    j = requirements.select("id").join(n, "id", "left").join(m, "id", "left")
    return j.select(F.col("id").alias("requirement_id"), *((F.coalesce(F.col(c), F.lit(0)) > 0).alias(name) for c, name in (("a", "accepted"), ("p", "pending"), ("m", "absent"))))
