"""Embedding whitening against exact fractions and a plain eigendecomposition."""

from fractions import Fraction
from math import floor, isfinite

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracevale.llm import queries, whitening


def plain(rows, scale=256, keep=4):
    """{(vec_id, component): (n, deviation, |whitened|, explained)} and the distinct vectors, in exact arithmetic up to the eigenvectors."""
    ok = [(i, [min(max(floor(scale * float(np.float32(c))), -(2**63)), 2**63 - 1) for c in e]) for i, e in rows if e and all(c is not None and isfinite(c) for c in e)]
    lengths = [len(x) for _, x in ok]
    d = max(set(lengths), key=lambda k: (lengths.count(k), k), default=0)
    ok = [(i, x) for i, x in ok if len(x) == d]
    fit = sorted({tuple(x) for _, x in ok})
    n, s = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    v = np.array([[float(Fraction(n * sum(x[a] * x[b] for x in fit) - s[a] * s[b], n * n)) for b in range(d)] for a in range(d)])
    e, q = np.linalg.eigh(v.reshape(d, d))
    e, q = e[::-1], q[:, ::-1]
    out = []
    for i, x in ok:
        for k in range(min(keep, d)):
            y = sum((n * c - t) / n * w for c, t, w in zip(x, s, q[:, k], strict=True))
            out.append((i, k + 1, n, sum((n * c - t) ** 2 for c, t in zip(x, s, strict=True)), abs(y) / e[k] ** 0.5 if e[k] > 1e-12 * np.trace(v) else None, e[k] / np.trace(v) if np.trace(v) else None))
    return sorted(out, key=lambda r: (r[0] is None, r[0] or 0, r[1], r[3]))


def check(df, rows):
    got = sorted(df.collect(), key=lambda r: (r.vec_id is None, r.vec_id or 0, r.component, r.deviation or 0))
    want = plain(rows)
    assert [(r.vec_id, r.component, r.n) for r in got] == [w[:3] for w in want]
    for r, (_, _, _, deviation, whitened, explained) in zip(got, want, strict=True):
        assert r.deviation == (deviation if deviation < 2**63 else None)
        assert (r.whitened is None) == (whitened is None) and (whitened is None or abs(r.whitened) == pytest.approx(whitened, rel=1e-7, abs=1e-9))
        assert (r.explained is None) == (explained is None) and (explained is None or r.explained == pytest.approx(explained, rel=1e-9, abs=1e-12))
        assert r.identity_error is None or r.identity_error <= 1e-4
    return got


def rows_of(seed, n, d, size=0.2):
    rng = np.random.default_rng(seed)
    mix = rng.normal(size=(d, d)) * np.linspace(1, 3, d)
    return [(i, [float(x) for x in rng.normal(0, size, d) @ mix]) for i in range(n)]


def test_whitening_of_odd_rows(spark):
    rows = rows_of(1, 60, 6) + [(60, None), (61, []), (62, [float("nan")] * 6), (63, [None] * 6), (64, [float("inf")] * 6), (65, [0.1] * 5), (None, [0.5] * 6), (66, [-0.0] * 6)]
    rows += [(70 + i, [0.25, -0.5, 0.125, 1.0, 0.0, 2.0]) for i in range(30)] + rows_of(1, 3, 6)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").select("*", F.lit(1).alias("x"), F.lit("n").alias("n"), F.lit(0).alias("component")).repartition(5)
    got = check(whitening.whiten(df), rows)
    assert {r.component for r in got} == {1, 2, 3, 4} and len({(r.n, r.identity_error) for r in got}) == 1


def test_whitening_of_large_entries_stays_exact(spark):
    rows = rows_of(2, 40, 3, 1e15) + [(50, [3e30, 1.0, 1.0]), (51, [-3e30, -1.0, 0.0])]
    got = check(whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>")), rows)
    assert {r.deviation for r in got} == {None}
    rows = rows_of(3, 40, 2, 1e4)
    assert all(r.deviation > 2**30 for r in check(whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>")), rows))


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [0.5, 0.25])], [(1, [0.5, 0.5]), (2, [0.5, 0.5])], [(1, [0.0, 1.0]), (2, [1.0, 0.0])], [(1, [1.0]), (2, [2.0]), (3, [4.0])]])
def test_whitening_without_variance_in_some_component(spark, rows):
    check(whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>")), rows)


def test_residues_give_the_integers():
    rng = np.random.default_rng(4)
    x = rng.integers(-(2**62), 2**62, (5000, 3))
    moduli = whitening.primes(2 * 5000 * 2**124 + 1)
    one = np.column_stack([np.ones(5000, np.int64), x]).astype(object)
    assert (whitening.remaindered([whitening.modular_scatter(x, p) for p in moduli], moduli) == one.T @ one).all()
    assert all(p < 2**whitening.BITS for p in moduli) and len(set(moduli)) == len(moduli) >= 7


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    df = queries.QUERIES["op13_embedding_whitening"](spark, sf)
    assert df.dtypes == [("vec_id", "bigint"), ("component", "int"), ("n", "bigint"), ("deviation", "bigint"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double")]
    check(df, [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()])
