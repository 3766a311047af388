"""Unified diffs as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import stable_id

HUNK = r"(?m)^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"


def _path(patch, pattern: str):
    """A path from a header line: without what follows a tab, without its a/ or b/, and null for /dev/null."""
    raw = F.nullif(F.regexp_extract(patch, pattern, 1), F.lit(""))
    return F.regexp_replace(F.when(raw != "/dev/null", raw), "^[ab]/", "")


def file_diffs(texts: DataFrame) -> DataFrame:
    """(ordinal, path, old_path, change_type, hunks, patch) of each file section of the texts in column `value`."""
    d = texts.select(F.posexplode(F.split("value", r"(?m)(?=^diff --git )")).alias("ordinal", "patch")).where(F.col("patch").startswith("diff --git "))
    p = F.col("patch")
    kind = F.when(p.rlike(r"(?m)^new file mode"), "added").when(p.rlike(r"(?m)^deleted file mode"), "deleted").when(p.rlike(r"(?m)^rename from "), "renamed").otherwise("modified")
    old = F.coalesce(_path(p, r"(?m)^rename from ([^\t\n]*)"), _path(p, r"(?m)^--- ([^\t\n]*)"), F.regexp_extract(p, r"^diff --git a/(\S+) b/", 1))
    new = F.coalesce(_path(p, r"(?m)^rename to ([^\t\n]*)"), _path(p, r"(?m)^\+\+\+ ([^\t\n]*)"), F.regexp_extract(p, r"^diff --git a/\S+ b/(\S+)", 1))
    group = lambda i: F.regexp_extract_all(p, F.lit(HUNK), F.lit(i))
    # a missing count is 1, a written 0 stays 0
    hunks = F.transform(F.arrays_zip(*(group(i).alias(n) for i, n in ((1, "a"), (2, "b"), (3, "c"), (4, "d")))), lambda h: F.struct(*(F.coalesce(F.nullif(h[k], F.lit("")), F.lit("1")).cast("int").alias(n) for k, n in (("a", "old_start"), ("b", "old_count"), ("c", "new_start"), ("d", "new_count")))))
    d = d.withColumn("change_type", kind)
    return d.select("ordinal", F.when(F.col("change_type") == "deleted", old).otherwise(new).alias("path"), F.when(F.col("change_type") == "renamed", old).alias("old_path"), "change_type", hunks.alias("hunks"), "patch")


def change_records(diffs: DataFrame, pr: dict[str, str | int]) -> DataFrame:
    """A change record for each file, with the pull request's constant columns."""
    named = diffs.select(F.col("path").alias("file"), "change_type", "patch", *(F.lit(v).alias(k) for k, v in pr.items()))
    return named.withColumn("id", stable_id("pr_change", F.col("pr_number"), F.col("file"))).withColumn("changed_symbol_ids", F.array().cast("array<string>"))
