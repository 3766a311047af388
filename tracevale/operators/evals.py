"""Recall against expectations, set stability between runs, and verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, and 1 where nothing was expected."""
    return F.when(whole == 0, F.lit(1.0).cast("double")).otherwise(part.cast("double") / F.nullif(whole, F.lit(0)))


def recall(expected: DataFrame, found: DataFrame, key: list[str]) -> DataFrame:
    """(n_expected, n_found, recall) of distinct expected keys."""
    e = expected.select(*key).distinct().join(found.select(*key).distinct().withColumn("hit", F.lit(1)), key, "left")
    return e.agg(F.count(F.lit(1)).alias("n_expected"), F.count("hit").alias("n_found")).withColumn("recall", ratio(F.col("n_found"), F.col("n_expected")))


def missed(expected: DataFrame, found: DataFrame, key: list[str]) -> DataFrame:
    return expected.join(found, key, "left_anti")


def violations(forbidden: DataFrame, found: DataFrame, key: list[str]) -> DataFrame:
    return forbidden.join(found, key, "left_semi")


def jaccard(a: Column, b: Column) -> Column:
    return ratio(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)))


def pairwise_jaccard(members: DataFrame, run: str, member: str) -> DataFrame:
    """(a, b, shared, jaccard) for runs a < b that share a member; overlaps are counted by a join on members."""
    m = members.select(F.col(run).alias("run"), F.col(member).alias("member")).distinct()
    n = m.groupBy("run").agg(F.count(F.lit(1)).alias("n"))
    a, b = (m.withColumnRenamed("run", k) for k in "ab")
    shared = a.join(b, "member").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))
    s = shared.join(n.select(F.col("run").alias("a"), F.col("n").alias("na")), "a").join(n.select(F.col("run").alias("b"), F.col("n").alias("nb")), "b")
    return s.select("a", "b", "shared", ratio(F.col("shared"), F.col("na") + F.col("nb") - F.col("shared")).alias("jaccard"))


def run_overlaps(signatures: DataFrame) -> DataFrame:
    """(category, a, b, jaccard) of all pairs of runs a < b of a category, of (run, category, item) rows.

    Items are only counted by which runs have them: one shuffle of the items, whatever their number, and then as many rows as
    there are different sets of runs. Runs without a common item have index 0, runs without any item 1.
    """
    there = signatures.select("category", "run").where("run is not null").distinct()
    having = signatures.where("item is not null and run is not null").groupBy("category", "item").agg(F.array_sort(F.collect_set("run")).alias("runs"))
    counts = having.groupBy("category", "runs").agg(F.count(F.lit(1)).alias("n"))
    sizes = counts.select("category", F.explode("runs").alias("run"), "n").groupBy("category", "run").agg(F.sum("n").alias("n"))
    sizes = there.alias("t").join(sizes.alias("s"), F.col("t.category").eqNullSafe(F.col("s.category")) & (F.col("t.run") == F.col("s.run")), "left").select("t.category", "t.run", F.coalesce("n", F.lit(0)).alias("n"))
    pair = F.flatten(F.transform("runs", lambda a: F.transform(F.filter("runs", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    shared = counts.where(F.size("runs") > 1).select("category", "n", F.explode(pair).alias("p")).groupBy("category", "p").agg(F.sum("n").alias("both"))
    a, b = (sizes.select(F.col("category").alias(f"c{k}"), F.col("run").alias(k), F.col("n").alias(f"n{k}")) for k in "ab")
    pairs = a.join(b, F.col("ca").eqNullSafe(F.col("cb")) & (F.col("a") < F.col("b"))).join(shared, F.col("ca").eqNullSafe(F.col("category")) & (F.struct("a", "b") == F.col("p")), "left")
    both = F.coalesce("both", F.lit(0))
    return pairs.select(F.col("ca").alias("category"), "a", "b", ratio(both, F.col("na") + F.col("nb") - both).alias("jaccard"))


def stability(signatures: DataFrame) -> DataFrame:
    """(category, stability): least Jaccard index over all pairs of runs, of (run, category, item) rows; 1 for a single run."""
    least = run_overlaps(signatures).groupBy(F.col("category").alias("c")).agg(F.min("jaccard").alias("least"))
    found = signatures.select("category").distinct().join(least, F.col("category").eqNullSafe(F.col("c")), "left")
    return found.select("category", F.coalesce("least", F.lit(1.0)).alias("stability"))


def check_rows(checks: DataFrame) -> DataFrame:
    """(name, status, value, least): passed, failed, or skipped where there is no value."""
    status = F.when(F.col("value").isNull(), "skipped").when(F.col("value") >= F.col("least"), "passed").otherwise("failed")
    return checks.select("name", status.alias("status"), "value", "least")


def verdicts(checks: DataFrame) -> DataFrame:
    """(passed): whether no check of (name, value, least) failed; a null value is a check that was skipped."""
    return checks.agg(F.coalesce(F.every(F.coalesce(F.col("value") >= F.col("least"), F.lit(True))), F.lit(True)).alias("passed"))
