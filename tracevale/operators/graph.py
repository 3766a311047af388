"""Node and edge tables: keyed merge, edges that need both ends, constraints and counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merge_latest(rows: DataFrame, key: list[str], order: str, *ties: str) -> DataFrame:
    """The row with the greatest `order` (then `ties`) of each key; the aggregate combines before the shuffle."""
    rest = [c for c in rows.columns if c not in key]
    best = F.max_by(F.struct(*rest), F.struct(order, *ties)).alias("best")
    return rows.groupBy(*key).agg(best).select(*key, *(F.col(f"best.{c}").alias(c) for c in rest)).select(*rows.columns)


def first_wins(rows: DataFrame, key: list[str], *order: str) -> DataFrame:
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("best")).select(*key, *(F.col(f"best.{c}").alias(c) for c in rest)).select(*rows.columns)


def overlay(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Properties of `new` over those of `old`: a null removes the old value, a column that `new` doesn't have keeps it."""
    values = list(dict.fromkeys(c for c in [*old.columns, *new.columns] if c not in key))
    o, n = (df.select(F.struct(*key).alias("k"), F.struct(*df.columns).alias(name)) for df, name in ((old, "o"), (new, "n")))
    j = o.join(n, "k", "full")

    def pick(c: str):
        if c not in new.columns:
            return F.col("o")[c]
        return F.when(F.col("n").isNull(), F.col("o")[c]).otherwise(F.col("n")[c]) if c in old.columns else F.col("n")[c]

    return j.select(*(F.col("k")[c].alias(c) for c in key), *(pick(c).alias(c) for c in values))


def edges(rows: DataFrame, src_nodes: DataFrame, dst_nodes: DataFrame, *key: str) -> DataFrame:
    """Edges (src, dst, ...) both of whose ends are nodes (by `id`), one for each src, dst and key: that with the greatest properties."""
    e = rows.join(src_nodes.select(F.col("id").alias("src")), "src", "left_semi").join(dst_nodes.select(F.col("id").alias("dst")), "dst", "left_semi")
    keys = ["src", "dst", *key]
    rest = [c for c in rows.columns if c not in keys]
    if not rest:
        return e.select(*keys).distinct()
    return e.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("best")).select(*keys, "best.*").select(*rows.columns)


def duplicate_keys(nodes: DataFrame, *key: str) -> DataFrame:
    """Keys that break uniqueness; an empty table is a constraint that holds."""
    return nodes.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(label, n) of each table."""
    each = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(label).alias("label"), "n") for label, df in tables.items()]
    return reduce(DataFrame.unionByName, each)


def flow_steps(flows: DataFrame) -> DataFrame:
    return flows.select(F.col("id").alias("src"), F.posexplode("interaction_ids").alias("order", "dst"))


def transitions(rows: DataFrame, flow: str, at: list[str], state: str) -> DataFrame:
    """(flow, source, target, order): each state of a flow and the next."""
    w = Window.partitionBy(flow).orderBy(*at)
    t = rows.select(F.col(flow).alias("flow"), F.col(state).alias("source"), F.lead(state).over(w).alias("target"), F.row_number().over(w).alias("order"))
    return t.where("target is not null")


def endpoint_join(screens: DataFrame, interactions: DataFrame) -> DataFrame:
    """Screens with the interactions that start or end there: an OR made an equi-join by listing both ends."""
    ends = interactions.select(F.col("id").alias("interaction_id"), F.explode(F.array_distinct(F.array("source_state_id", "target_state_id"))).alias("id"))
    return screens.join(ends, "id", "left")
