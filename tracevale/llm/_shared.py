"""What several operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ASCII_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())
WHITE = " \t\n\x0b\x0c\r"


#: Spark removes the shuffle files of a query that ran under this setting.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder that the driver and every executor see."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors see")
        root = f"file://{tempfile.gettempdir()}/checkpoints"  # one machine: the driver is the only executor
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Write a table in the shared folder and read it back: lineage ends there, and lost executors cost nothing."""
    spark = df.sparkSession
    path, was = shared_dir(spark), spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, was)
    return spark.read.schema(df.schema).parquet(path)


def hash_sample(df: DataFrame, rows: int, *key: str) -> DataFrame:
    """At most about `rows` rows of `df`, those with the least hashes of their key; only hashes are gathered to choose them."""
    h = df.withColumn("__h", F.xxhash64(*key))
    chosen = h.select("__h").distinct().orderBy("__h").limit(rows)
    return h.join(F.broadcast(chosen), "__h", "left_semi").drop("__h")


def small(df: DataFrame, rows: int) -> DataFrame:
    """Hint a broadcast if the materialized `df` is counted to have at most `rows` rows; else leave the join to Spark."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def box(df: DataFrame) -> DataFrame:
    """All columns of `df` in one struct `r`, so that columns beside it clash with none."""
    return df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("r"))


def unboxed(df: DataFrame, *but: str) -> list[Column]:
    """The columns of `df` out of the struct `r`, but for those named."""
    return [F.col(f"r.`{c}`").alias(c) for c in df.columns if c not in but]


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def signed(h: np.ndarray) -> np.ndarray:
    return h.astype(np.uint64).view(np.int64)


#: Fixed values of the word hash: a base and a number for each byte; words of more bytes than LONG are hashed whole.
BASE, PIECE, LONG = 0x9E3779B97F4A7C15, 1 << 20, 1 << 16
WHITE_BYTE = np.zeros(256, bool)
WHITE_BYTE[list(WHITE.encode())] = True


@lru_cache(None)
def _tables(lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A number for each byte, and the powers of BASE and of its inverse modulo 2 ** 64."""
    of_byte = mix(np.arange(1, 257, dtype=np.uint64)) | np.uint64(1)
    if lower:
        of_byte[65:91] = of_byte[97:123]
    steps = [np.concatenate([np.ones(1, np.uint64), np.full(PIECE - 1, b, np.uint64)]) for b in (BASE, pow(BASE, -1, 1 << 64))]
    return of_byte, np.multiply.accumulate(steps[0]), np.multiply.accumulate(steps[1])


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of a column, laid end to end, and where each begins; a null is an empty text."""
    column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    at = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if at and len(column) else np.zeros(len(column) + 1, np.int64)
    return (np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data else np.empty(0, np.uint8)), at - at[0]


def slices(at: np.ndarray, most: int = 4 * PIECE) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `most` bytes together; a longer text is a range by itself."""
    lo = 0
    while lo < len(at) - 1:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, "right")) - 1)
        yield lo, hi
        lo = hi


def word_hashes(data: np.ndarray, at: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word of texts laid end to end, and the number of each text's first word."""
    hashes, starts = word_starts(data, at, lower)
    return hashes, np.searchsorted(starts, at)


def word_starts(data: np.ndarray, at: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word of texts laid end to end, and the place of its first byte.

    Words are runs of bytes that aren't ASCII white space; `lower` takes A-Z as a-z. Work goes piece by piece, so that
    memory doesn't grow with a text beyond its words' hashes.
    """
    of_byte, power, inverse = _tables(lower)
    hashes, starts, lo = [], [], int(at[0])
    while lo < at[-1]:
        hi = min(lo + PIECE, int(at[-1]))
        if hi < at[-1]:  # a piece ends at a text's end, else behind white space
            k = int(np.searchsorted(at, hi, "right")) - 1
            white = np.flatnonzero(WHITE_BYTE[data[lo:hi]])
            if at[k] > lo:
                hi = int(at[k])
            elif len(white):
                hi = lo + int(white[-1]) + 1
            else:
                end = int(at[k + 1])
                while hi < end and not WHITE_BYTE[data[hi]]:
                    more = np.flatnonzero(WHITE_BYTE[data[hi : hi + PIECE]])
                    hi = min(end, hi + int(more[0]) if len(more) else hi + PIECE)
                hashes.append(_whole(data, [lo], [hi], lower))
                starts.append(np.array([lo]))
                lo = hi
                continue
        b = data[lo:hi]
        edge = np.zeros(len(b) + 1, bool)
        edge[0] = edge[-1] = True
        edge[at[np.searchsorted(at, lo) : np.searchsorted(at, hi, "right")] - lo] = True
        word = ~WHITE_BYTE[b]
        start = word & edge[:-1]
        start[1:] |= word[1:] & ~word[:-1]
        end = word & edge[1:]
        end[:-1] |= word[:-1] & ~word[1:]
        s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
        total = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(of_byte[b] * power[: len(b)], out=total[1:])
        h = mix((total[e] - total[s]) * inverse[s])
        if (e - s > LONG).any():
            long = np.flatnonzero(e - s > LONG)
            h[long] = _whole(data, (s[long] + lo).tolist(), (e[long] + lo).tolist(), lower)
        hashes.append(h)
        starts.append(s + lo)
        lo = hi
    if not hashes:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.concatenate(hashes), np.concatenate(starts)


def _whole(data: np.ndarray, starts: list[int], ends: list[int], lower: bool) -> np.ndarray:
    words = (data[s:e].tobytes() for s, e in zip(starts, ends, strict=True))
    return np.array([xxhash.xxh3_64_intdigest(w.translate(ASCII_LOWER) if lower else w) for w in words], np.uint64)


def runs(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k words, from the words' hashes."""
    n = max(len(h) - k + 1, 0)
    s = np.zeros(n, np.uint64)
    for factor, j in zip((mix(np.arange(1, k + 1, dtype=np.uint64)) | np.uint64(1)).tolist(), range(k), strict=True):
        s += h[j : j + n] * np.uint64(factor)
    return mix(s)
