"""Queries with SQL give DuckDB's rows; the pipeline's stages are compared with plain versions."""

import os
import re

import duckdb
import pytest
import corpus_pipeline
from tracevale.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_rows(spark, name):
    c = duckdb.connect()
    for p in os.listdir(SF):
        c.execute(f"CREATE VIEW {p.split('.')[0]} AS SELECT * FROM '{SF}/{p}'")
    df, rel = queries.QUERIES[name](spark, SF), c.sql(queries.ORACLE_SQL[name])
    at = [rel.columns.index(x) for x in df.columns]
    assert sorted(repr(tuple(r)) for r in df.collect()) == sorted(repr(tuple(r[i] for i in at)) for r in rel.fetchall())


def test_pipeline(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    tables = [d]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        tables.append(stage(spark, tables[-1], SF).cache())
        assert tables[-1].schema.names == d.schema.names
    ids = [{r.doc_id for r in t.select("doc_id").collect()} for t in tables]
    assert ids[1] <= ids[0] and ids[2] == ids[1] and ids[3] <= ids[2] and ids[4] <= ids[3]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert sum((i in ids[1]) == bool(q) for i, q in labels.items()) >= 0.95 * len(labels)

    def sets(t):
        return {r.doc_id: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for r in t.collect() if (w := r.text.lower().split())}

    kept, before = sets(tables[3]), sets(tables[2])
    alike = lambda a, b: 10 * len(a & b) >= 8 * len(a | b)
    assert not any(alike(kept[a], kept[b]) for a in kept for b in kept if a < b)
    linked = {i for i in before for j in before if i != j and alike(before[i], before[j])}
    assert ids[2] - ids[3] <= linked
    lost = ids[3] - ids[4]
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({i: i + 32 for i in range(65, 91)}))
    windows = {}
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = split(r.text)
        n = min(10, len(w))
        windows.setdefault(n, set()).update(tuple(w[i : i + n]) for i in range(len(w) - n + 1 if n else 0))
    leaked = {r.doc_id for r in tables[3].collect() if any(tuple(w[i : i + n]) in x for w in [split(r.text)] for n, x in windows.items() if n for i in range(len(w) - n + 1))}
    assert lost == leaked
    first = {r.doc_id: r.text for r in tables[1].collect()}
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({i: i + 32 for i in range(65, 91)})
    where = {}
    for i, t in first.items():
        for x in (t or "").split("\n"):
            where.setdefault(key(x), set()).add(i)
    plain = {i: "\n".join(x for x in (t or "").split("\n") if len(key(x)) < 20 or len(where[key(x)]) < 3 or max(where[key(x)]) == i) for i, t in first.items()}
    assert {r.doc_id: r.text for r in tables[2].collect()} == plain
    pieces = corpus_pipeline.STAGES[-1][1](spark, tables[4], SF).collect()
    assert {r.doc_id for r in pieces} == ids[4]
