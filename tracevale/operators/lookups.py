"""Names of entities for reports, and the order in which a report shows them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import collapse, shorten

#: What stands for an entity without a name, and the column that names each kind.
NAMES = {"element": ("name", "Unnamed element"), "screen": ("route_pattern", "Unknown route"), "flow": ("goal", "Unnamed flow"), "requirement": ("statement", "Unnamed requirement")}


def entity_labels(tables: dict[str, DataFrame]) -> DataFrame:
    """(id, kind, label, step_count) of the entities in tables by kind."""

    def of(kind: str, df: DataFrame) -> DataFrame:
        column, default = NAMES[kind]
        steps = F.size(F.coalesce("interaction_ids", F.array().cast("array<string>"))) if "interaction_ids" in df.columns else F.lit(None).cast("int")
        return df.select("id", F.lit(kind).alias("kind"), F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit(default)).alias("label"), steps.alias("step_count"))

    return reduce(DataFrame.unionByName, (of(k, df) for k, df in tables.items()))


def overlaid(graph: DataFrame, local: DataFrame) -> DataFrame:
    """Labels of a run's own records over those of the graph."""
    return local.unionByName(graph.join(local, ["id", "kind"], "left_anti"))


def looked_up(ids: DataFrame, labels: DataFrame) -> DataFrame:
    """The labels of the ids in column `id`, whatever their kind, in order."""
    return labels.join(ids.select("id").distinct(), "id", "left_semi").orderBy("id")


def ordered_ids(paths: Column, affected: Column) -> Column:
    """Distinct ids: those of the paths in their order, then the other affected ones."""
    empty = F.array().cast("array<string>")
    return F.array_distinct(F.concat(F.flatten(F.coalesce(paths, F.array().cast("array<array<string>>"))), F.coalesce(affected, empty)))


def shown(findings: DataFrame, labels: DataFrame, kind: str, most: int, places: bool = True, width: int | None = 40) -> DataFrame:
    """(id, labels, more): a finding's labels of one kind as first met, with the number of places of those in several; `most` of them, and how many more.

    Labels are cut to `width` characters, if there is one. Findings without such labels have no row.
    """
    e = findings.select("id", F.posexplode(ordered_ids(F.col("path_entity_ids"), F.col("affected_entity_ids"))).alias("at", "entity"))
    label = F.coalesce(F.nullif(shorten(F.col("label"), width) if width else collapse(F.col("label")), F.lit("")), F.lit(NAMES[kind][1]))
    e = e.join(labels.where(F.col("kind") == kind).select(F.col("id").alias("entity"), label.alias("label")), "entity")
    n = e.groupBy("id", "label").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("at"))
    text = F.when((F.col("n") > 1) & places, F.concat("label", F.lit(" ("), F.col("n").cast("string"), F.lit(" places)"))).otherwise(F.col("label"))
    g = n.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("at", text.alias("t")))).alias("x"))
    return g.select("id", F.transform(F.slice("x", 1, most), lambda s: s["t"]).alias("labels"), F.greatest(F.lit(0), F.size("x") - most).alias("more"))


def affected_totals(findings: DataFrame, labels: DataFrame) -> DataFrame:
    """(elements, screens, flows, requirements): how many distinct ones all findings affect."""
    e = findings.select(F.explode("affected_entity_ids").alias("id")).join(labels, "id")
    return e.agg(*(F.countDistinct(F.when(F.col("kind") == k, F.col("id"))).alias(f"{k}s") for k in NAMES))
