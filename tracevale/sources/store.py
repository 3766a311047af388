"""A stored graph that is loaded again and again: node and edge tables in buckets, merged in place, changed by one manifest.

Each table's rows lie in buckets by a hash of their key. A load reads only the buckets that its rows fall into, joins them
with its rows there, writes the buckets that came out different, and names them in a manifest of its own. A manifest is
written aside and renamed, which fails if another load was faster; until then, and after any failure, readers have the version
before. Buckets that no manifest names are waste, which `vacuum` removes.

Merging is that of a property graph: a given property replaces the stored one, a null one removes it, a column that isn't
given leaves it. Nodes come first; edges need both ends among the nodes then stored, and are one for each source, target and
key. Loading the same rows again writes nothing, not even a manifest.
"""

from __future__ import annotations

import json
import tempfile
import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.graph import edges as between
from .sinks import properties

BUCKET, CHANGED = "__bucket", "__changed"


def scratch(spark: SparkSession) -> str:
    """A fresh folder under spark.checkpoint.dir, which all executors see; under a local master without one, a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors see")
    return f"{(root or f'file://{tempfile.gettempdir()}/checkpoints').rstrip('/')}/{uuid.uuid4().hex}"


@dataclass
class Edges:
    """Rows (src, dst, key..., properties...) between nodes of two labels."""

    rows: DataFrame
    src: str
    dst: str
    key: tuple[str, ...] = ()


class LostRace(RuntimeError):
    """Another load has committed meanwhile; load again."""


class GraphStore:
    def __init__(self, spark: SparkSession, root: str, buckets: int = 64):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        self._jvm = spark.sparkContext._jvm
        self._files = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}".rstrip("/"))

    def _names(self, folder: str) -> list[str]:
        at = self._path(folder)
        return [s.getPath().getName() for s in self._files.listStatus(at)] if self._files.exists(at) else []

    def _versions(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self._names("manifests") if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self, version: int | None = None) -> dict:
        """The current version's manifest, or an older one's."""
        versions = self._versions()
        if version is None and not versions:
            return {"version": 0, "buckets": self.buckets, "nodes": {}, "edges": {}}
        at = self._path(f"manifests/{versions[-1] if version is None else version:012d}.json")
        stream = self._files.open(at)
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, manifest: dict) -> int:
        new, aside = self._path(f"manifests/{manifest['version']:012d}.json"), self._path(f"manifests/.{uuid.uuid4().hex}")
        stream = self._files.create(aside, False)
        try:
            stream.write(bytearray(json.dumps(manifest).encode()))
        finally:
            stream.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(aside.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(aside, new, none)
        except Exception as e:
            if manifest["version"] in self._versions():
                self._files.delete(aside, False)
                raise LostRace(f"version {manifest['version']} is another load's") from e
            raise
        return manifest["version"]

    def read(self, kind: str, label: str, version: int | None = None, buckets: set[str] | None = None) -> DataFrame | None:
        """A table of `nodes` or `edges`, or some buckets of it; None if there is none."""
        of = self.manifest(version)[kind].get(label)
        return None if of is None else self._read(of, buckets)

    def _read(self, of: dict, buckets: set[str] | None = None) -> DataFrame:
        schema = T.StructType.fromJson(of["schema"])
        paths = [f"{self.root}/{part}/{BUCKET}={b}" for b, part in of["parts"].items() if buckets is None or b in buckets]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _merge(self, of: dict | None, rows: DataFrame, key: list[str], load: str, buckets: int) -> dict | None:
        """The table's entry with the buckets that `rows` change, or None if they change none."""
        if clash := {BUCKET, CHANGED} & set(rows.columns):
            raise ValueError(f"columns {sorted(clash)} are the store's own")
        given = [c for c in rows.columns if c not in key]
        rows = rows.withColumns({k: F.coalesce(F.col(k).cast("string"), F.raise_error(F.lit(f"a row without {k}")).cast("string")) for k in key})
        # of several rows of a key, one: that with the greatest properties
        rows = rows.groupBy(*key).agg(F.max(F.struct(*given)).alias("p")).select(*key, "p.*") if given else rows.select(*key).distinct()
        bucket = F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")
        aside = f"{self.root}/staged/{load}/{uuid.uuid4().hex}"
        rows.withColumn(BUCKET, bucket).write.parquet(aside)
        new = self.spark.read.parquet(aside)
        touched = {str(r[0]) for r in new.select(BUCKET).distinct().collect()}  # no more than there are buckets
        if not touched:
            self._files.delete(self._jvm.org.apache.hadoop.fs.Path(aside), True)
            return None
        old_schema = T.StructType.fromJson(of["schema"]) if of else T.StructType([f for f in new.schema if f.name in key])
        kinds = {f.name: f.dataType for f in old_schema}
        if odd := [f.name for f in new.schema if f.name in kinds and kinds[f.name] != f.dataType]:
            raise ValueError(f"other types than stored: {odd}")
        schema = T.StructType([*(T.StructField(f.name, f.dataType) for f in old_schema), *(T.StructField(f.name, f.dataType) for f in new.schema if f.name not in kinds and f.name != BUCKET)])
        old = self._read(of | {"schema": schema.jsonValue()}, touched) if of else self.spark.createDataFrame([], schema)
        o, n = old.select(F.struct(*key).alias("k"), F.struct(*old.columns).alias("o")), new.select(F.struct(*key).alias("k"), F.struct(*(c for c in new.columns if c != BUCKET)).alias("n"))
        pairs = o.join(n, "k", "full")
        picked = {f.name: F.when(F.col("n").isNull(), F.col("o")[f.name]).otherwise(F.col("n")[f.name]) if f.name in given else F.col("o")[f.name] for f in schema if f.name not in key}
        picked = {k: F.col("k")[k] for k in key} | picked
        same = reduce(lambda a, b: a & b, (c.eqNullSafe(F.col("o")[x]) for x, c in picked.items()), F.col("o").isNotNull())
        out = pairs.select(*(picked[f.name].alias(f.name) for f in schema), (~same).alias(CHANGED)).withColumn(BUCKET, bucket)
        part = f"data/{load}-{uuid.uuid4().hex}"
        out.repartition(len(touched), BUCKET).write.partitionBy(BUCKET).parquet(f"{self.root}/{part}")
        changed = self.spark.read.parquet(f"{self.root}/{part}").where(CHANGED).select(F.col(BUCKET).cast("string")).distinct().collect()
        self._files.delete(self._jvm.org.apache.hadoop.fs.Path(aside), True)
        if not changed:
            self._files.delete(self._path(part), True)
            return None
        return {"key": key, "schema": schema.jsonValue(), "parts": (of["parts"] if of else {}) | {r[0]: part for r in changed}}

    def load(self, nodes: dict[str, DataFrame], edges: dict[str, Edges] | None = None) -> int:
        """Merge nodes (id, properties...) by label, then edges by type; the version that has them."""
        manifest, load = self.manifest(), uuid.uuid4().hex
        found = {"nodes": dict(manifest["nodes"]), "edges": dict(manifest["edges"])}
        for label, rows in nodes.items():
            found["nodes"][label] = self._merge(found["nodes"].get(label), properties(rows), ["id"], load, manifest["buckets"]) or found["nodes"].get(label)
        ends = {label: self._read(of).select("id") for label, of in found["nodes"].items() if of}
        for kind, e in (edges or {}).items():
            if e.src in ends and e.dst in ends:
                rows = properties(e.rows).withColumns({c: F.col(c).cast("string") for c in ("src", "dst", *e.key)})
                found["edges"][kind] = self._merge(found["edges"].get(kind), between(rows, ends[e.src], ends[e.dst], *e.key), ["src", "dst", *e.key], load, manifest["buckets"]) or found["edges"].get(kind)
        found = {k: {label: of for label, of in tables.items() if of} for k, tables in found.items()}
        if found == {k: manifest[k] for k in found}:
            return manifest["version"]
        return self._commit(manifest | found | {"version": manifest["version"] + 1})

    def counts(self) -> DataFrame:
        """(kind, name, n) of nodes by label and edges by type, in order."""
        manifest = self.manifest()
        named = [self._read(of).agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), F.lit(name).alias("name"), "n") for kind in ("nodes", "edges") for name, of in manifest[kind].items()]
        none = self.spark.createDataFrame([], "kind string, name string, n long")
        return reduce(DataFrame.unionByName, named, none).orderBy(F.desc("kind"), "name")

    def vacuum(self, keep: int = 1) -> list[str]:
        """Remove what only manifests before the last `keep` name, or none does. Nothing may load or read an old version meanwhile."""
        versions = self._versions()
        for v in versions[:-keep]:
            self._files.delete(self._path(f"manifests/{v:012d}.json"), False)
        used = {f"{part}/{BUCKET}={b}" for v in versions[-keep:] for kind in ("nodes", "edges") for of in self.manifest(v)[kind].values() for b, part in of["parts"].items()}
        parts = [f"data/{n}" for n in self._names("data")]
        gone = [f"{part}/{n}" for part in parts for n in self._names(part) if n.startswith(BUCKET) and f"{part}/{n}" not in used]
        for g in gone:
            self._files.delete(self._path(g), True)
        for part in parts:
            if not any(n.startswith(BUCKET) for n in self._names(part)):
                self._files.delete(self._path(part), True)
        self._files.delete(self._path("staged"), True)
        return gone
