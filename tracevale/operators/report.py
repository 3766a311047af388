"""Parts of the Markdown report, and the report."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import collapse, percent
from . import lookups

#: Order and badge of each severity, and phrases of the report.
SEVERITIES = {"high": (0, "🔴 HIGH"), "medium": (1, "🟠 MEDIUM"), "low": (2, "🟡 LOW")}
LINKED, NOT_INGESTED = "ingested requirements are linked to affected UI.", "No requirements were ingested in this run"


def label_rollup(rows: DataFrame, group: str, label: str, order: str, most: int = 6) -> DataFrame:
    """(group, labels, more): distinct labels as first seen, with the number of places of those in several; `most` of them, and how many more."""
    n = rows.groupBy(group, label).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    text = F.when(F.col("n") > 1, F.concat(F.col(label), F.lit(" ("), F.col("n").cast("string"), F.lit(" places)"))).otherwise(F.col(label))
    g = n.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("first", text.alias("t")))).alias("x"))
    return g.select(group, F.transform(F.slice("x", 1, most), lambda s: s["t"]).alias("labels"), F.greatest(F.lit(0), F.size("x") - most).alias("more"))


def severity_counts(found: DataFrame) -> DataFrame:
    return found.agg(*(F.count_if(F.col("severity") == s).alias(s) for s in ("high", "medium", "low")))


def path_text(path: Column, labels: Column) -> Column:
    """A path's ids, each under its label, joined by arrows."""
    return F.array_join(F.transform(path, lambda i: F.coalesce(F.element_at(labels, i), i)), " → ")


def _listed(labels: Column, more: Column, between: str = ", ") -> Column:
    """Labels in a row, and how many more there are."""
    return F.concat(F.array_join(labels, between), F.when(more > 0, F.concat(F.lit(", and "), more.cast("string"), F.lit(" more"))).otherwise(""))


def finding_blocks(found: DataFrame, labels: DataFrame, most: int = 5) -> DataFrame:
    """(rank, id, text): a block of Markdown for each finding (id, severity, confidence, files, affected_entity_ids, path_entity_ids, changed_symbol_id)."""
    f = found.withColumn("file", F.coalesce(F.nullif(F.col("files"), F.lit("")), F.lit("unknown file")))
    for kind, name, many, places, width in (("element", "names", 6, True, 40), ("screen", "routes", 5, False, None), ("flow", "flows", 1 << 30, False, None)):
        own = lookups.shown(found, labels, kind, many, places, width).select(F.col("id").alias("of"), F.col("labels").alias(name), F.col("more").alias(f"{name}_more"))
        f = f.join(own, F.col("id") == F.col("of"), "left").drop("of")
    affected = F.coalesce("affected_entity_ids", F.array().cast("array<string>"))
    paths = F.when(F.size(F.coalesce("path_entity_ids", F.array().cast("array<array<string>>"))) > 0, F.col("path_entity_ids")).otherwise(F.transform(affected, lambda i: F.array(F.col("changed_symbol_id"), i)))
    rank, badge = (F.coalesce(*(F.when(F.col("severity") == s, F.lit(x[k])) for s, x in SEVERITIES.items())) for k in (0, 1))
    rest = F.size(paths) - most
    text = F.concat(
        F.lit("### "), badge, F.lit(" — "), "file", F.lit("\n\nChanges to "), "file", F.lit(" affect "), F.coalesce(_listed(F.col("names"), F.col("names_more")), F.lit("screen behavior")),
        F.coalesce(F.concat(F.lit(" across "), _listed(F.col("routes"), F.col("routes_more"))), F.lit("")), F.lit(".\n\n"),
        F.coalesce(F.concat(F.lit("Affected user flows: "), F.array_join("flows", "; "), F.lit("\n\n")), F.lit("")), F.lit("Confidence: "), percent(F.col("confidence")).cast("string"), F.lit("%.\n\nEvidence: `"),
        F.array_join(F.transform(F.slice(paths, 1, most), lambda p: F.array_join(p, " → ")), "`; `"), F.lit("`\n"),
        F.when(rest > 0, F.concat(F.lit("\n… plus "), rest.cast("string"), F.lit(" more recorded paths (see impact records).\n"))).otherwise(""), F.lit("\n\n"),
    )
    return f.select(rank.alias("rank"), "id", text.alias("text"))


def blocks(found: DataFrame, unmapped: DataFrame, labels: DataFrame, context: dict) -> DataFrame:
    """(section, rank, id, text) of the report; in this order, the texts are the report.

    `context` has what the findings don't: `pr` (pr_number, title, url, files_changed, base_sha, head_sha), `stats` (flows,
    requirements of the whole run), run_id, source_revision, generated_at. What it lacks is said to be unknown.
    """
    spark, pr, stats = found.sparkSession, context.get("pr", {}), context.get("stats", {})
    of = {k: pr.get(k) or "unknown" for k in ("pr_number", "base_sha", "head_sha")}
    ingested = int(stats.get("requirements") or 0) > 0
    parts = []

    def add(section: int, rows: DataFrame | str, none: str | None = None) -> None:
        """Rows (rank, id, text); `none` instead where there are none. Or one text."""
        if isinstance(rows, str):
            rows, none = spark.range(1).select(F.lit(0).alias("rank"), F.lit("").alias("id"), F.lit(rows).alias("text")), None
        parts.append(rows.select(F.lit(section).alias("section"), F.col("rank").cast("int").alias("rank"), "id", "text"))
        if none is not None:
            parts.append(rows.agg(F.count(F.lit(1)).alias("n")).where("n = 0").select(F.lit(section).alias("section"), F.lit(0).alias("rank"), F.lit("").alias("id"), F.lit(none).alias("text")))

    reached = found.select(F.explode(lookups.ordered_ids(F.col("path_entity_ids"), F.col("affected_entity_ids"))).alias("id")).distinct().join(labels, "id")
    n = {k: F.count_if(F.col("kind") == k).cast("string") for k in ("element", "screen", "flow", "requirement")}
    linked = F.concat(n["requirement"], F.lit(f" {LINKED}")) if ingested else F.lit(f"{NOT_INGESTED}, so requirement-level coverage is not assessed.")
    summary = F.concat(F.lit(" changed code areas map to "), n["element"], F.lit(" UI elements across "), n["screen"], F.lit(" screens. "), n["flow"], F.lit(f" of {int(stats.get('flows') or 0)} discovered user flows touch affected elements or screens.\n\n"), linked, F.lit("\n\n"))
    number = found.agg(F.count(F.lit(1)).cast("string").alias("found"))  # one row, as the totals
    title = F.lit(f"# Blast-radius report: PR #{of['pr_number']}\n\n## What changed\n\n[{pr.get('title') or 'Untitled pull request'}]({pr.get('url') or '#'}) changes {int(pr.get('files_changed') or 0)} files from `{str(of['base_sha'])[:8]}` to `{str(of['head_sha'])[:8]}`.\n\n## Executive summary\n\n")
    add(0, reached.agg(summary.alias("summary")).join(F.broadcast(number)).select(F.lit(0).alias("rank"), F.lit("").alias("id"), F.concat(title, "found", "summary").alias("text")))
    add(1, "## Impacts by risk\n\n")
    add(2, finding_blocks(found, labels), "No code-to-UI impacts were found from accepted or review-pending links.\n\n")
    add(3, "## User flows to re-test\n\n")
    goal = F.coalesce(F.nullif(collapse(F.col("label")), F.lit("")), F.lit("Unnamed flow"))
    flows = reached.where("kind = 'flow'").select(F.lit(0).alias("rank"), "id", F.concat(F.lit("- "), goal, F.lit(" ("), F.coalesce("step_count", F.lit(0)).cast("string"), F.lit(" steps)\n")).alias("text"))
    add(4, flows, "No discovered user flows are linked to the affected UI.\n")
    add(5, "\n## Requirements at risk\n\n")
    if ingested:
        add(6, reached.where("kind = 'requirement'").select(F.lit(0).alias("rank"), "id", F.concat(F.lit("- "), "label", F.lit("\n")).alias("text")), "No ingested requirements are linked to the affected UI.\n")
    else:
        add(6, f"{NOT_INGESTED}; requirement-level coverage is not assessed.\n")
    add(7, "\n## Not mapped to UI\n\n")
    named = lambda c, default: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(default))
    order = F.concat_ws("\x00", F.coalesce("file", F.lit("")), F.coalesce("change_type", F.lit("")))
    lines = unmapped.select(F.lit(1).alias("rank"), order.alias("id"), F.concat(F.lit("- `"), named("file", "unknown file"), F.lit("` ("), named("change_type", "changed"), F.lit("): "), named("reason", "mapping unavailable"), F.lit("\n")).alias("text"))
    add(8, lines, "Every changed file had at least one accepted or review-pending UI link.\n")
    parts.append(unmapped.limit(1).select(F.lit(8).alias("section"), F.lit(0).alias("rank"), F.lit("").alias("id"), F.lit("These changed files could not be mapped to the discovered UI and remain explicit uncertainty:\n\n").alias("text")))
    run = {k: context.get(k) or "unknown" for k in ("run_id", "source_revision", "generated_at")}
    add(9, f"\n## Run identifiers\n\n- Run ID: `{run['run_id']}`\n- Source revision: `{run['source_revision']}`\n- PR base SHA: `{of['base_sha']}`\n- PR head SHA: `{of['head_sha']}`\n- Generated at: {run['generated_at']}\n")
    return reduce(DataFrame.unionByName, parts)


def markdown(found: DataFrame, unmapped: DataFrame, labels: DataFrame, context: dict) -> str:
    """The report of one pull request as one text."""
    return "".join(r.text for r in blocks(found, unmapped, labels, context).orderBy("section", "rank", "id", "text").toLocalIterator())
