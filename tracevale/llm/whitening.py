"""Embedding whitening: an exact scatter matrix from modular products, and the components it has in double precision.

Entries become integers, floor(scale * c). Each partition multiplies the matrix of its distinct vectors, with a column of
ones beside them, by its own transpose, modulo several primes so small that a product of doubles holds every sum exactly.
Partial products are added modulo their primes, row by row of the matrix; Chinese remaindering gives the exact number of
vectors, sums and scatter, for as many primes as the vectors' number and largest entry ask for. The covariance is formed
from these integers, each entry rounded once, and its eigenvectors are taken in double precision.

Defined cases: vectors that are null or empty, or hold null or non-finite entries, take no part and give no rows; nor do
vectors of another length than the most frequent one (of two, the longer). Entries beyond 64 bits are cut to its ends.
Repeated rows, and null ids, give a row each. A component without variance has no whitened value (null), and where no
component has any, `explained` and `identity_error` are null. `deviation` is null where it is beyond 64 bits. An empty table
gives no rows. Other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction
from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import materialize

#: Residues are below 2 ** BITS, so that a product of CHUNK rows stays below 2 ** 53.
BITS, CHUNK = 21, 1 << 11
#: A component has variance if its eigenvalue is more than this share of all.
LEAST = 1e-12


def primes(bound: int) -> list[int]:
    """The largest primes below 2 ** BITS, so many that their product is more than `bound`."""
    out, product, p = [], 1, 1 << BITS
    while product <= bound:
        p -= 1
        if all(p % q for q in range(2, isqrt(p) + 1)):
            out.append(p)
            product *= p
    return out


def remaindered(residues: list[np.ndarray], moduli: list[int]) -> np.ndarray:
    """The integers of least size (as Python's) that have these residues."""
    whole = 1
    for p in moduli:
        whole *= p
    total = np.zeros(residues[0].shape, object)
    for r, p in zip(residues, moduli, strict=True):
        rest = whole // p
        total += r.astype(object) * (rest * pow(rest, -1, p))
    total %= whole
    return np.where(total > whole // 2, total - whole, total)


def modular_scatter(x: np.ndarray, p: int) -> np.ndarray:
    """[1, x] transposed times [1, x], modulo p."""
    total = np.zeros((x.shape[1] + 1,) * 2, np.int64)
    for at in range(0, len(x), CHUNK):
        part = np.ones((min(CHUNK, len(x) - at), x.shape[1] + 1))
        part[:, 1:] = x[at : at + CHUNK] % p
        total = (total + (part.T @ part).astype(np.int64)) % p
    return total


def vectors(embeddings: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, x): the integer vectors of the rows that take part."""
    e = F.transform("embedding", lambda c: c.cast("double"))
    whole = F.size("e").between(1, 2**31 - 1) & ~F.exists("e", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    x = F.transform("e", lambda c: F.floor(F.lit(float(scale)) * c).cast("long"))
    rows = embeddings.select(F.col("vec_id"), e.alias("e")).where(F.col("e").isNotNull() & whole).select("vec_id", x.alias("x"))
    lengths = rows.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1)
    return rows.join(F.broadcast(lengths.select("d")), F.size("x") == F.col("d"), "left_semi")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def exact_scatter(fit: DataFrame) -> tuple[int, list[int], np.ndarray]:
    """n, sums and scatter (Python integers) of the vectors `fit` (x), from residues that tasks sum."""
    n, least, most, d = fit.agg(F.count(F.lit(1)), F.min(F.array_min("x")), F.max(F.array_max("x")), F.max(F.size("x"))).first()
    if not n:
        return 0, [], np.zeros((0, 0), object)
    moduli = primes(2 * n * max(abs(least), abs(most), 1) ** 2 + 1)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros((d + 1, d + 1), np.int64) for _ in moduli]
        for batch in batches:
            for at in range(0, batch.num_rows, 4 * CHUNK):
                x = _matrix(batch.column(0).slice(at, 4 * CHUNK))
                for k, p in enumerate(moduli):
                    total[k] = (total[k] + modular_scatter(x, p)) % p
        for k in range(len(moduli)):  # rows from the diagonal on
            yield pa.RecordBatch.from_arrays([pa.array([k] * (d + 1)), pa.array(range(d + 1)), pa.array([total[k][i, i:].astype("<i4").tobytes() for i in range(d + 1)], pa.binary())], ["k", "i", "part"])

    def add(t: pa.Table) -> pa.Table:
        p, total = moduli[t["k"][0].as_py()], 0
        for part in t["part"]:
            total = (total + np.frombuffer(part.as_buffer(), "<i4").astype(np.int64)) % p
        return pa.table({"k": t["k"][:1], "i": t["i"][:1], "part": pa.array([total.astype("<i4").tobytes()], pa.binary())})

    parts = fit.select("x").mapInArrow(partial, "k long, i long, part binary").groupBy("k", "i").applyInArrow(add, "k long, i long, part binary")
    residues = [np.zeros((d + 1, d + 1), np.int64) for _ in moduli]
    for r in parts.toLocalIterator():
        residues[r.k][r.i, r.i :] = residues[r.k][r.i :, r.i] = np.frombuffer(r.part, "<i4")
    whole = remaindered(residues, moduli)
    if whole[0, 0] != n:
        raise ValueError("the vectors changed while they were summed")
    return n, whole[0, 1:].tolist(), whole[1:, 1:]


@dataclass
class Whitening:
    """n and exact sums of the fit list, and up to `keep` components: projections (d, k), eigenvalues and their trace."""

    n: int
    sums: list[int]
    projection: np.ndarray
    values: np.ndarray
    trace: float

    @property
    def varied(self) -> np.ndarray:
        return self.values > LEAST * self.trace

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exactly: as 64-bit integers where they hold it, else as Python's."""
        most = self.n * int(np.abs(x.astype(object)).max(initial=0) if len(x) and x.min() == np.iinfo(np.int64).min else np.abs(x).max(initial=0)) + max(map(abs, self.sums), default=0)
        kind = np.int64 if most < 2**62 else object
        return x.astype(kind) * self.n - np.array(self.sums, kind)

    def whitened(self, centred: np.ndarray) -> np.ndarray:
        x = (centred / self.n).astype(np.float64)
        return (x @ self.projection) / np.where(self.varied, np.sqrt(np.maximum(self.values, 0)), np.nan)


def fit(distinct: DataFrame, keep: int = 4) -> Whitening:
    """The whitening of the vectors `distinct` (x), each once."""
    n, sums, scatter = exact_scatter(distinct)
    if not n:
        return Whitening(0, [], np.zeros((0, 0)), np.zeros(0), 0.0)
    v = np.array([[float(Fraction(n * int(c) - s * t, n * n)) for c, t in zip(row, sums, strict=True)] for row, s in zip(scatter, sums, strict=True)])
    trace = float(np.trace(v))
    largest = float(np.abs(v).max()) or 1.0
    values, axes = np.linalg.eigh(v / largest)
    order = np.argsort(-values, kind="stable")[: min(keep, len(sums))]
    axes = axes[:, order]
    axes = axes * np.where(axes[np.abs(axes).argmax(axis=0), np.arange(len(order))] < 0, -1.0, 1.0)
    return Whitening(n, sums, axes, values[order] * largest, trace)


def identity_error(distinct: DataFrame, w: Whitening) -> float | None:
    """The largest absolute entry of the whitened fit list's covariance minus the identity, over components with variance."""
    keep = np.flatnonzero(w.varied)
    if not len(keep):
        return None
    k = len(keep)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, mean = np.zeros((k, k)), np.zeros(k)
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                y = w.whitened(w.centred(_matrix(batch.column(0).slice(at, CHUNK))))[:, keep]
                total, mean = total + y.T @ y, mean + y.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(range(k * k + k)), pa.array(np.concatenate([total.ravel(), mean]))], ["at", "part"])

    sums = distinct.select("x").mapInArrow(partial, "at long, part double").groupBy("at").agg(F.sum("part").alias("part"))
    got = np.array([r.part for r in sums.orderBy("at").collect()]) / w.n  # k * (k + 1) numbers
    mean = got[k * k :]
    return float(np.abs(got[: k * k].reshape(k, k) - np.outer(mean, mean) - np.eye(k)).max())


def apply(rows: DataFrame, w: Whitening) -> DataFrame:
    """(vec_id, component, deviation, whitened) of the rows (vec_id, x), a row for each component."""
    k = len(w.values)
    kind = rows.schema["vec_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                part = batch.slice(at, CHUNK)
                centred = w.centred(_matrix(part.column(1)))
                wide = centred.dtype == object or bool(len(centred)) and int(np.abs(centred).max()) ** 2 * centred.shape[1] >= 2**63
                squares = (centred.astype(object) if wide else centred) ** 2
                deviation = pa.array([x if x < 2**63 else None for x in squares.sum(axis=1).tolist()], pa.int64())
                y = pc.if_else(pc.is_nan(flat := pa.array(w.whitened(centred).ravel())), pa.scalar(None, pa.float64()), flat)
                each = pa.array(np.repeat(np.arange(part.num_rows), k))
                number = pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), part.num_rows))
                yield pa.RecordBatch.from_arrays([part.column(0).take(each), number, deviation.take(each), y], ["vec_id", "component", "deviation", "whitened"])

    return rows.select("vec_id", "x").mapInArrow(run, f"vec_id {kind}, component int, deviation long, whitened double")


def whiten(embeddings: DataFrame, scale: int = 256, keep: int = 4) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of every vector and its first `keep` components."""
    rows = materialize(vectors(embeddings, scale))
    distinct = materialize(rows.select("x").distinct())
    w = fit(distinct, keep)
    error = identity_error(distinct, w) if w.n else None
    share: list[Column] = [F.lit(float(e) / w.trace if w.trace else None).cast("double") for e in w.values]
    explained = F.element_at(F.array(*share), F.col("component")) if share else F.lit(None).cast("double")
    return apply(rows, w).select("vec_id", "component", F.lit(w.n).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(error).cast("double").alias("identity_error"))
