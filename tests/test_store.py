"""A stored graph against merging in plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from tracevale.sources.store import Edges, GraphStore, LostRace


@pytest.fixture
def store(spark, tmp_path):
    return GraphStore(spark, f"file://{tmp_path}/graph", buckets=5)


def table(df, key):
    return {tuple(str(r[k]) for k in key): {c: v for c, v in r.asDict().items() if c not in key and v is not None} for r in df.collect()}


def test_loads_merge_as_a_property_graph_does(spark, store):
    rng, nodes, edges = random.Random(1), {}, {}
    for turn in range(4):
        columns = [c for c in ("name", "size", "extra") if rng.random() < 0.7 or c == "name"]
        rows = [(str(i), *(rng.choice([None, f"{c}{rng.randrange(5)}"]) for c in columns)) for i in rng.sample(range(40), 15)]
        links = [(str(rng.randrange(45)), str(rng.randrange(40)), rng.randrange(2), rng.choice([None, 0.5, 0.7])) for _ in range(30)]
        version = store.load(
            {"Screen": spark.createDataFrame(rows, ", ".join(["id string", *(f"{c} string" for c in columns)]))},
            {"LEADS_TO": Edges(spark.createDataFrame(links, "src string, dst string, via long, confidence double"), "Screen", "Screen", ("via",))},
        )
        for i, *values in rows:
            of = nodes.setdefault((i,), {})
            for c, v in zip(columns, values, strict=True):
                of.pop(c, None)
                of |= {} if v is None else {c: v}
        best = {}
        for a, b, via, c in links:
            if (a,) in nodes and (b,) in nodes:
                best[a, b, str(via)] = max([x for x in (best.get((a, b, str(via))), c) if x is not None], default=None)
        edges |= {k: {} if c is None else {"confidence": c} for k, c in best.items()}
        assert version == turn + 1
        assert table(store.read("nodes", "Screen"), ["id"]) == nodes
        assert table(store.read("edges", "LEADS_TO"), ["src", "dst", "via"]) == edges
    assert [tuple(r) for r in store.counts().collect()] == [("nodes", "Screen", len(nodes)), ("edges", "LEADS_TO", len(edges))]


def test_the_same_load_again_changes_nothing(spark, store):
    nodes = {"A": spark.createDataFrame([("1", "x", {"k": "v"}, [1, 2]), ("2", None, None, None)], "id string, name string, attributes map<string,string>, n array<int>")}
    links = {"TO": Edges(spark.createDataFrame([("1", "2"), ("1", "2"), ("1", "9")], "src string, dst string"), "A", "A")}
    assert store.load(nodes, links) == 1
    before = store.manifest()
    assert store.load(nodes, links) == 1 and store.manifest() == before
    assert store.load({"A": nodes["A"].where("false")}) == 1 and store.load({}) == 1
    assert table(store.read("nodes", "A"), ["id"]) == {("1",): {"name": "x", "attributes": '{"k":"v"}', "n": [1, 2]}, ("2",): {}}
    assert store.read("edges", "TO").count() == 1 and store.read("edges", "NONE") is None


def test_only_touched_buckets_are_written(spark, store):
    store.load({"A": spark.range(200).select(F.col("id").cast("string").alias("id"), F.lit("a").alias("x"))})
    first = store.manifest()["nodes"]["A"]["parts"]
    store.load({"A": spark.createDataFrame([("7", "b"), ("8", "a")], "id string, x string")})
    second = store.manifest()["nodes"]["A"]["parts"]
    assert sum(first[b] != second[b] for b in first) == 1 and len(first) == 5
    assert store.read("nodes", "A").where("x = 'b'").count() == 1 and store.read("nodes", "A").count() == 200
    assert store.read("nodes", "A", version=1).where("x = 'b'").count() == 0
    assert store.vacuum() and store.read("nodes", "A").count() == 200 and store._versions() == [2]


def test_a_failed_load_leaves_the_version_before(spark, store):
    store.load({"A": spark.createDataFrame([("1", "x")], "id string, name string")})
    bad = spark.createDataFrame([("1", "y"), ("2", "z")], "id string, name string").withColumn("name", F.when(F.col("id") == "2", F.raise_error(F.lit("lost"))).otherwise(F.col("name")))
    with pytest.raises(Exception, match="lost"):
        store.load({"B": spark.createDataFrame([("5",)], "id string"), "A": bad})
    with pytest.raises(Exception, match="without id"):
        store.load({"A": spark.createDataFrame([(None, "y")], "id string, name string")})
    with pytest.raises(ValueError, match="types"):
        store.load({"A": spark.createDataFrame([("1", 5)], "id string, name int")})
    assert [tuple(r) for r in store.read("nodes", "A").collect()] == [("1", "x")] and store.read("nodes", "B") is None
    assert store.load({"A": spark.createDataFrame([("1", "y")], "id string, name string")}) == 2
    assert store.vacuum() and store.read("nodes", "A").first().name == "y" and len(store._names("data")) == 1


def test_a_load_that_another_overtook_fails(spark, store, monkeypatch):
    store.load({"A": spark.createDataFrame([("1", "x")], "id string, name string")})
    old = store.manifest()
    store.load({"A": spark.createDataFrame([("1", "y")], "id string, name string")})
    monkeypatch.setattr(store, "manifest", lambda version=None: old)
    with pytest.raises(LostRace):
        store.load({"A": spark.createDataFrame([("1", "z")], "id string, name string")})
    monkeypatch.undo()
    assert store.read("nodes", "A").first().name == "y"
