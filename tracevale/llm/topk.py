"""Exact top-k inner products by a bit-sliced index.

Each component x becomes the integer floor(scale * x). Rows are cut into blocks; a block stores, for each attribute and
each bit of its value above the attribute's least value, a bitmap over its rows. A query's scores come as bit slices too:
the bitmaps that its own bits select are added with carry-save adders, weight by weight. Going from the most significant
slice of the sum downward leaves the rows that are surely in the top k and the ties at the boundary, which are settled by
the smaller vec_id. A query meets every block, and the blocks' k best are merged.

Defined cases: vectors that are null or empty, or hold null or non-finite components, take no part, nor do rows without a
vec_id; scores and components beyond the range of a long are cut to its ends; a vector of another length than the block's most usual one is compared with vectors of its own length only.
A query's own vec_id is no candidate, so repeated rows of it aren't either; repeated candidates are one each. Other
columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import materialize, small

#: Components of the rows of a block of the index, and of a pack of queries at most (32 MB of them), on average.
BLOCK_VALUES, PACK_VALUES = 1 << 22, 1 << 22
#: Packs have at least so many queries, and are no smaller than it takes to make so many pairs of a block and a pack.
PACK_ROWS, PAIRS = 256, 256


def quantised(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """(vec_id, n, v): usable vectors as integers."""
    usable = F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    v = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale))
    return vectors.where(usable).select(F.col("vec_id").cast("long").alias("vec_id"), F.size("embedding").alias("n"), v.alias("v"))


def slice_block(v: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Least value of each attribute, and for each attribute its bitmaps from bit 0 up, as rows of 64-bit words."""
    low = v.min(axis=0)
    u = v.astype(np.uint64) - low.astype(np.uint64)
    pad = -len(v) % 64
    slices = []
    for d in range(v.shape[1]):
        bits = [np.packbits(np.pad((u[:, d] >> np.uint64(b)) & np.uint64(1), (0, pad)).astype(np.uint8), bitorder="little").view(np.uint64) for b in range(int(u[:, d].max()).bit_length())]
        slices.append(np.array(bits, np.uint64).reshape(len(bits), (len(v) + pad) // 64))
    return low, slices


def add_slices(query: np.ndarray, slices: list[np.ndarray], ones: np.ndarray) -> tuple[list[np.ndarray], int]:
    """Slices of a non-negative sum from bit 0 up, and what to add to it for the inner product with `u`.

    A negative factor -q takes the complement: -q * u = q * (top - u) - q * top.
    """
    by_weight: list[list[np.ndarray]] = []
    shift = 0
    for q, s in zip(query.tolist(), slices, strict=True):
        if q < 0:
            shift += q * ((1 << len(s)) - 1)
            s, q = s ^ ones, -q
        for c in range(q.bit_length()):
            if q >> c & 1:
                while len(by_weight) < c + len(s):
                    by_weight.append([])
                for b in range(len(s)):
                    by_weight[b + c].append(s[b : b + 1])
    out, w = [], 0
    while w < len(by_weight):
        a = np.concatenate(by_weight[w]) if by_weight[w] else np.zeros((1, len(ones)), np.uint64)
        if w + 1 == len(by_weight) and len(a) > 1:
            by_weight.append([])
        while len(a) > 1:  # three bitmaps make one of this weight and one of the next
            m = len(a) // 3
            if m:
                x, y, z = a[:m], a[m : 2 * m], a[2 * m : 3 * m]
                xy = x ^ y
                by_weight[w + 1].append((x & y) | (xy & z))
                a = np.concatenate([xy ^ z, a[3 * m :]])
            else:
                by_weight[w + 1].append(a[:1] & a[1:2])
                a = a[:1] ^ a[1:2]
        out.append(a[0])
        w += 1
    return out, shift


def select_top(total: list[np.ndarray], able: np.ndarray, k: int, ids: np.ndarray) -> np.ndarray:
    """Numbers of the k rows with the greatest sums among those set in `able`; ties go to smaller ids."""
    sure, open_ = np.zeros_like(able), able
    count = lambda x: int(np.bitwise_count(x).sum())
    n_sure = 0
    for s in reversed(total):
        x = open_ & s
        n = count(x)
        if n_sure + n > k:
            open_ = x
        else:
            sure, n_sure, open_ = sure | x, n_sure + n, open_ & ~s
        if n_sure == k:
            break
    rows = lambda x: np.flatnonzero(np.unpackbits(x.view(np.uint8), bitorder="little"))
    ties = rows(open_)
    if n_sure + len(ties) > k:
        ties = ties[np.argsort(ids[ties], kind="stable")][: k - n_sure]
    return np.concatenate([rows(sure), ties])


def search(ids: np.ndarray, low: np.ndarray, slices: list[np.ndarray], query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """vec_ids and scores of the block's k best for a query, in no order."""
    words = -(-len(ids) // 64)
    able = np.packbits(np.pad(ids != query_id, (0, words * 64 - len(ids))), bitorder="little").view(np.uint64)
    total, shift = add_slices(query, slices, np.full(words, ~np.uint64(0)))
    best = select_top(total, able, k, ids)
    base = shift + sum(a * b for a, b in zip(query.tolist(), low.tolist(), strict=True))
    at, bit = best // 64, (best % 64).astype(np.uint64)
    if len(total) < 62 and abs(base) < 1 << 62:
        score = np.full(len(best), base, np.int64)
        for b, s in enumerate(total):
            score += ((s[at] >> bit) & np.uint64(1)).astype(np.int64) << b
        return ids[best], score
    ones = [((s[at] >> bit) & np.uint64(1)).tolist() for s in total]
    exact = [base + sum(o[i] << b for b, o in enumerate(ones)) for i in range(len(best))]
    return ids[best], np.array([min(max(x, -(2**63)), 2**63 - 1) for x in exact], np.int64)


def _matrix(blob: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    a = np.frombuffer(blob, np.int64).reshape(-1, n + 1)
    return a[:, 0], a[:, 1:]


def _pack(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One binary of little-endian 64-bit integers a group: vec_id and the components of each row."""

    def pack(t: pa.Table) -> pa.Table:
        n = t["n"][0].as_py()
        v = np.empty((t.num_rows, n + 1), np.int64)
        v[:, 0] = t["vec_id"].to_numpy()
        v[:, 1:] = t["v"].combine_chunks().flatten().to_numpy().reshape(-1, n)
        return pa.table({**{k: t[k][:1] for k in keys}, "blob": pa.array([v.tobytes()], pa.large_binary() if v.nbytes >= 2**31 else pa.binary())})

    return rows.groupBy(*keys).applyInArrow(pack, ", ".join(f"{k} int" for k in keys) + ", blob binary")


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: int = 64) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows that `is_query` selects, against all rows but the query's own."""
    rows = materialize(quantised(vectors, scale))
    sizes = rows.groupBy("n").agg(F.count(F.lit(1)).alias("rows"), F.count(F.when(is_query, 1)).alias("asked"))
    sizes = sizes.where("asked > 0").withColumn("blocks", F.ceil(F.col("rows") * F.col("n") / BLOCK_VALUES).cast("int"))
    # the index is copied once a pack: no more packs than keep tasks busy, or than bound their size
    packs = F.greatest(F.ceil(F.col("asked") * F.col("n") / PACK_VALUES), F.least(F.ceil(F.col("asked") / PACK_ROWS), F.ceil(PAIRS / F.col("blocks"))))
    sizes = sizes.select("n", "blocks", packs.cast("int").alias("packs"))
    rows = rows.join(small(materialize(sizes), 10_000), "n")
    number = lambda of: F.pmod(F.xxhash64("vec_id"), F.col(of)).cast("int")
    # every pack of queries meets every block: both are dealt out to the pairs of their numbers
    index = _pack(rows.withColumn("block", number("blocks")), ["n", "block", "packs"])
    packs = _pack(rows.where(is_query).withColumn("pack", number("packs")), ["n", "pack", "blocks"])
    index = index.withColumn("pack", F.explode(F.sequence(F.lit(0), F.col("packs") - 1))).withColumnRenamed("blob", "index")
    packs = packs.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumnRenamed("blob", "asked")
    pairs = index.join(packs.hint("shuffle_hash"), ["n", "block", "pack"]).select("n", "index", "asked")

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, index_blob, asked in zip(*(batch.column(i) for i in range(3)), strict=True):
                ids, v = _matrix(index_blob.as_buffer(), n.as_py())
                low, slices = slice_block(v)
                query, out, scores = [], [], []
                for q, x in zip(*_matrix(asked.as_buffer(), n.as_py()), strict=True):
                    best, score = search(ids, low, slices, int(q), x, k)
                    query.append(np.full(len(best), q))
                    out.append(best)
                    scores.append(score)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (query, out, scores)], ["query_id", "vec_id", "score"])

    found = pairs.mapInArrow(match, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
