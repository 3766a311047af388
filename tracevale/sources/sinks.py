"""What a run writes besides its records."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The fields of a flow's result.
FLOW_RESULT = "flow_id string, key string, succeeded boolean, actions_used int"
#: Fixed value: up to so many bytes of different texts in a task, save_changes writes each once. By Parquet's default of 1 MB, longer texts are written once a change.
DIFFERENT = 64 << 20


def property_text(c: Column, kind: T.DataType) -> Column:
    """A nested value as compact JSON with sorted keys; plain values and lists of them as they are."""
    if isinstance(kind, T.MapType):
        return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(c))))
    if isinstance(kind, T.StructType):
        return F.to_json(F.struct(*(c[n].alias(n) for n in sorted(kind.names))))
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.MapType, T.StructType, T.ArrayType)):
        return F.to_json(c)
    return c


def properties(records: DataFrame) -> DataFrame:
    """Records as a property graph stores them."""
    return records.select(*(property_text(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in records.schema.fields))


def append_decisions(decisions: DataFrame, path: str) -> None:
    """One JSON line a step, with its keys in order, behind those that are there."""
    decisions.select(*sorted(decisions.columns)).write.mode("append").json(path)


def save_flow_results(results: DataFrame, path: str) -> None:
    results.select("flow_id", "key", "succeeded", F.col("actions_used").cast("int")).dropDuplicates(["flow_id"]).write.mode("overwrite").json(path)


def read_flow_results(spark: SparkSession, path: str) -> DataFrame:
    """Results by flow; a missing folder is an empty table."""
    try:
        return spark.read.schema(FLOW_RESULT).option("mode", "FAILFAST").json(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], FLOW_RESULT)


def save_screens(screens: DataFrame, path: str) -> None:
    """Pages (id, html, screenshot) of a run, once for each id, apart from their records."""
    screens.select("id", "html", "screenshot").dropDuplicates(["id"]).write.mode("overwrite").parquet(path)


def save_changes(changes: DataFrame, path: str) -> None:
    """Changes with the ids of their file's symbols, as one text each: however long, a text is written once, not once a change."""
    changes.write.mode("overwrite").option("parquet.dictionary.page.size", DIFFERENT).parquet(path)


def fingerprint(rows: DataFrame) -> tuple:
    """Number of rows and a sum of their hashes, which don't depend on their order."""
    h = F.xxhash64(*(F.col(f"`{c}`") for c in rows.columns)).cast("decimal(38,0)")
    return tuple(rows.agg(F.count(F.lit(1)), F.sum(h)).first())


def save_snapshot(rows: DataFrame, path: str) -> bool:
    """Write a table that never changes. The same content once more is fine (false), another content is an error."""
    try:
        rows.write.mode("errorifexists").parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_ALREADY_EXISTS":
            raise
        if fingerprint(rows.sparkSession.read.parquet(path).select(*rows.columns)) != fingerprint(rows):
            raise ValueError(f"{path} holds another content") from None
        return False
    return True


def original_uris(files: DataFrame, names: dict[str, str]) -> DataFrame:
    """Rows with column `name` and the uri that the name stands for; an unknown name is an error when it is read."""
    uri = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))[F.col("name")] if names else F.lit(None).cast("string")
    return files.withColumn("uri", F.when(uri.isNull(), F.raise_error(F.concat(F.lit("unknown document "), F.coalesce("name", F.lit("null"))))).otherwise(uri))


def graph_load(nodes: dict[str, DataFrame], edges: dict[str, tuple[DataFrame, str, str]]) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """Nodes by label, once a key, and edges by type between them, as an ordered load leaves them: nodes first, then the edges both of whose ends are there."""
    from ..operators.graph import edges as between

    kept = {label: properties(df).groupBy("id").agg(F.max(F.struct(*(c for c in df.columns if c != "id"))).alias("x")).select("id", "x.*") if len(df.columns) > 1 else df.distinct() for label, df in nodes.items()}
    return kept, {kind: between(rows, kept[src], kept[dst]) for kind, (rows, src, dst) in edges.items()}


def goals(text: str, known: dict[str, str]) -> list[str]:
    """The goals of a list with commas, in its order; an unknown one is an error."""
    keys = [x.strip().upper() for x in text.split(",") if x.strip()]
    if unknown := [k for k in keys if k not in known]:
        raise ValueError(f"unknown goals: {', '.join(unknown)}")
    return [known[k] for k in keys]


def documents_summary(segments: DataFrame, requirements: DataFrame, rejects: DataFrame) -> DataFrame:
    """(segments, requirements, rejects): how many rows each step of the documents' way has."""
    one = [df.agg(F.count(F.lit(1)).alias(n)) for n, df in (("segments", segments), ("requirements", requirements), ("rejects", rejects))]
    return reduce(lambda a, b: a.join(F.broadcast(b)), one)  # one row each
