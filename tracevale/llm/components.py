"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import materialize

#: A node is a hub with more neighbours than this share of all edges, and than MANY; so there are at most 2 * SHARE hubs.
SHARE, MANY = 10_000, 1_000


def with_least(edges: DataFrame, limit: int) -> DataFrame:
    """(u, v, m): `edges` (u, v) with the least v of each u; hubs of over `limit` edges are joined by broadcast, so that no task gets all of one's."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("degree"))
    hubs = F.broadcast(least.where(F.col("degree") > limit).select("u", F.col("m").alias("of_hub")))
    dealt = edges.join(hubs, "u", "left")
    rest = dealt.where("of_hub is null").join(least.where(F.col("degree") <= limit), "u").select("u", "v", "m")
    return rest.unionByName(dealt.where("of_hub is not null").select("u", "v", F.col("of_hub").alias("m")))


def components(edges: DataFrame, many: int = MANY) -> DataFrame:
    """(node, component): the smallest node reachable from each node of `edges` (a, b), which holds no nulls.

    Each round halves the depth of what is left, roughly; it ends when no edge changes. A node's neighbours are only ever
    reduced to their least, so no neighbourhood is gathered. Nodes of over `many` edges may be joined as hubs.
    """
    e = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())

    def state(x: DataFrame) -> tuple:
        return tuple(x.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))"), F.sum(F.col("v").cast("decimal(38,0)"))).first())

    was, now = None, state(e)
    while now != was:
        limit = max(many, now[0] // SHARE)
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = with_least(both, limit).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        small = with_least(large, limit).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        e = materialize(small.where("u <> v").distinct())
        was, now = now, state(e)
    roots = e.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return e.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node").unionByName(roots.join(e.select(F.col("u").alias("node")), "node", "left_anti"))
