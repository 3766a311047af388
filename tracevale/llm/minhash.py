"""MinHash near-dedup: signatures from two permutations, bands, and exact similarities of what the bands bring together.

Shingles fall on a universe of 2 ** 32 numbers. One permutation of it scatters a document's shingles; a second one, shifted by
0, 1, 2 and more places in turn, gives the signature's coordinates, each the least image of all shingles. The first
permutation takes away what order the shingles had, so the shifts of a single second one do for many independent ones.

`rows` coordinates make a band, and documents that share a band are candidates. With 32 bands of 4, two documents that are 80 %
alike share none with a probability below 1e-7, and less the more alike they are. Documents with equal sets are one class,
found by 128 bits of hash, and need no band. Links are confirmed on whole sets.

Only what links connect is asked for, so a bucket needs no pair within one component. Each bucket's members are first
compared with one of them, which connects a large group of copies in time linear in its size. What is then left apart in a
bucket of up to BLOCK members is compared in pairs, first by parities of the sets' hashes on a bitmap, which bound their
difference from below, so that only pairs that can link are looked at with their sets. In larger ones, members must share a second
band as well (documents 80 % alike don't with a probability of about 1e-6), and buckets of two bands that are still larger are
compared block by block, those of its largest component only with the rest.

Defined cases: documents without words or text have an empty set and link with nothing; a null doc_id is a document without
a name, which links like any other: its component is the smallest doc_id it reaches, or null, and it is kept if there is none;
repeated rows are copies, and rows that share a kept doc_id are all kept. Other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import materialize, mix, signed
from .components import components
from .ngram_join import BLOCK_BYTES, _of_bytes, class_names, differences, may_link, overlaps, row_products, row_sets, sets_of, signature

#: Members of a bucket that are compared in pairs, and of a block.
BLOCK, REFINE = 256, 16
BANDS, ROWS = 32, 4
#: Most 64-bit words of a set's parities.
PARITY_WORDS = 128
#: What makes the first permutation another one than the second, and multipliers of the second.
SIGMA, M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35)


def permuted(u: np.ndarray, out: np.ndarray, spare: np.ndarray) -> np.ndarray:
    """The second permutation of the 32-bit numbers `u`, into `out`."""
    for shift, factor in ((16, M1), (13, M2)):
        np.right_shift(u, np.uint32(shift), out=spare)
        np.bitwise_xor(u, spare, out=out)
        np.multiply(out, factor, out=out)
        u = out
    np.right_shift(out, np.uint32(16), out=spare)
    return np.bitwise_xor(out, spare, out=out)


def signatures(s: np.ndarray, at: np.ndarray, coordinates: int) -> np.ndarray:
    """(sets, coordinates): the signature of each set of shingle hashes that isn't empty."""
    starts = at[:-1][np.diff(at) > 0]
    u = (mix(s ^ SIGMA) >> np.uint64(32)).astype(np.uint32)
    shifted, out, spare = u.copy(), np.empty_like(u), np.empty_like(u)
    sig = np.empty((coordinates, len(starts)), np.uint32)
    for k in range(coordinates):
        sig[k] = np.minimum.reduceat(permuted(shifted, out, spare), starts) if len(starts) else 0
        shifted += np.uint32(1)
    return sig.T


def band_names(sig: np.ndarray, rows: int) -> np.ndarray:
    """(sets, bands): 64 bits that name each band's number and coordinates."""
    bands = sig.reshape(len(sig), -1, rows)
    name = np.broadcast_to(mix(np.arange(1, bands.shape[1] + 1, dtype=np.uint64)), bands.shape[:2])
    for r in range(rows):
        name = mix(name ^ bands[:, :, r].astype(np.uint64))
    return signed(name)


def parities(s: np.ndarray) -> bytes:
    """A set's `signature`, folded to PARITY_WORDS."""
    x = np.frombuffer(signature(s), np.uint64)
    while len(x) > PARITY_WORDS:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x.tobytes()


def document_bands(docs: DataFrame, shingle: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, text_hash, n, c1, c2, bands, parity): the size and name of every row's set, its bands and parities."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, s, at in sets_of(batch.column(1), shingle):
                n = np.diff(at)
                of = band_names(signatures(s, at, bands * rows), rows)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum((n > 0) * bands)]).astype(np.int32)), pa.array(of.ravel(), pa.int64()))
                parity = pa.array([parities(s[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(lo, len(n)) for i in (0, 2)), pa.array(n), *map(pa.array, class_names(s, at)), lists, parity], ["doc_id", "text_hash", "n", "c1", "c2", "bands", "parity"])

    return docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text")).mapInArrow(run, "doc_id long, text_hash long, n long, c1 long, c2 long, bands array<long>, parity binary")


def buckets(entries: DataFrame) -> DataFrame:
    """The rows (s, ...) of the buckets that hold more than one, with their number `rows`."""
    return entries.join(entries.groupBy("s").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1"), "s")


def star(members: DataFrame, percent: int) -> DataFrame:
    """(a, b): each row of `members` (s, id, n) with the least id of its bucket, where sizes let them link."""
    heads = members.groupBy("s").agg(F.min(F.struct("id", "n")).alias("head"))
    pairs = members.join(heads, "s").select(F.col("id").alias("a"), "n", F.col("head.id").alias("b"), F.col("head.n").alias("m"))
    return pairs.where((F.col("a") != F.col("b")) & (100 * F.least("n", "m") >= percent * F.greatest("n", "m"))).select("a", "b").distinct()


def possible(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose parities don't rule a link out."""
    for x in ("a", "b"):
        pairs = pairs.join(classes.select(F.col("id").alias(x), F.struct("n", "parity").alias(f"of_{x}")), x)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (n, x), (m, y) = (batch.column(i).flatten() for i in (2, 3))
            keep = [may_link(i.as_py() + j.as_py(), differences(_of_bytes(p), _of_bytes(q)), percent) for i, p, j, q in zip(n, x, m, y, strict=True)]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("a", "b", "of_a", "of_b").mapInArrow(run, "a long, b long")


def several(members: DataFrame) -> DataFrame:
    """The rows (s, id, n, component) of buckets that hold more than one component, with their number `rows`."""
    mixed = members.groupBy("s").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count(F.lit(1)).alias("rows")).where("x <> y")
    return members.select("s", "id", "n", "component").join(mixed.select("s", "rows"), "s")


def pairs_apart(members: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(a, b): pairs of different components in the buckets (s, id, n, component), each of BLOCK rows at most, that may link."""

    def pair(t: pa.Table) -> pa.Table:
        ids, n, of, parity = *(t[c].to_numpy() for c in ("id", "n", "component")), [_of_bytes(x) for x in t["parity"]]
        short = min(map(len, parity))
        folded = np.array([np.bitwise_xor.reduce(x.reshape(-1, short), axis=0) for x in parity])
        out = []
        for i in range(len(ids) - 1):
            fits = (of[i + 1 :] != of[i]) & (100 * np.minimum(n[i + 1 :], n[i]) >= percent * np.maximum(n[i + 1 :], n[i]))
            fits &= may_link(n[i + 1 :] + n[i], np.bitwise_count(folded[i + 1 :] ^ folded[i]).sum(axis=1), percent)
            out += [(i, j) for j in (i + 1 + np.flatnonzero(fits)).tolist() if may_link(int(n[i] + n[j]), differences(parity[i], parity[j]), percent)]
        i, j = np.array(out, np.int64).reshape(-1, 2).T
        return pa.table({"a": np.minimum(ids[i], ids[j]), "b": np.maximum(ids[i], ids[j])})

    return members.join(classes.select("id", "parity"), "id").select("s", "id", "n", "component", "parity").groupBy("s").applyInArrow(pair, "a long, b long").distinct()


def blocks_apart(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): links between components, as spanning forests, within the large buckets (s, id, component, rows), block by block.

    Blocks of a bucket's largest component aren't compared with one another.
    """
    parts = members.groupBy("s", "component").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("n"))
    largest = parts.groupBy("s").agg(F.max(F.struct("size", "component", "n")).alias("most"), F.sum("n").alias("all"))
    m = members.join(largest, "s").withColumn("rest", F.col("component") != F.col("most.component"))
    of = lambda rows, n: F.greatest(F.ceil(rows / BLOCK), F.ceil(8 * n / BLOCK_BYTES)).cast("int")
    main, others = of(F.col("most.size"), F.col("most.n")), of(F.col("rows") - F.col("most.size"), F.col("all") - F.col("most.n"))
    dealt = F.when(F.col("rest"), main + F.pmod(F.xxhash64("id"), others).cast("int")).otherwise(F.pmod(F.xxhash64("id"), main).cast("int"))
    m = m.withColumn("block", dealt).withColumn("other", F.explode(F.when(F.col("rest"), F.sequence(F.lit(0), main + others - 1)).otherwise(F.sequence(main, main + others - 1))))
    m = m.select("s", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "id", "component").join(sets, "id")

    def product(t: pa.Table) -> pa.Table:
        ids, of_id, s = t["id"].to_numpy(), t["component"].to_numpy(), [_of_bytes(x) for x in t["set"]]
        size, n = np.array([len(x) for x in s]), overlaps(s)
        link = (100 * n >= percent * (size[:, None] + size[None, :] - n)) & (of_id[:, None] != of_id[None, :])
        first = np.where(link.any(axis=1), link.argmax(axis=1), -1)
        out, root = [], {c: c for c in set(of_id.tolist())}

        def top(c: int) -> int:
            while root[c] != c:
                c = root[c]
            return c

        for i in np.flatnonzero(first >= 0).tolist():
            for j in np.flatnonzero(link[i]).tolist():
                x, y = top(int(of_id[i])), top(int(of_id[j]))
                if x != y:
                    root[x] = y
                    out.append((int(ids[i]), int(ids[j])))
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    return m.select("s", "i", "j", "id", "component", "set").groupBy("s", "i", "j").applyInArrow(product, "a long, b long")


def class_links(docs: DataFrame, classes: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Links (a, b) that connect `classes` (id, n, c1, c2, member, bands, parity) as all links between them do."""
    members = materialize(buckets(classes.select("id", "n", F.explode("bands").alias("s"))))
    pairs = materialize(possible(star(members, percent), classes, percent))
    sets = sets_of_ids(docs, classes, pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), shingle)
    links = materialize(row_products(pairs, sets, percent))
    m = members.select("s", "id", "n").join(components(links).withColumnRenamed("node", "id"), "id", "left")
    left = materialize(several(m.withColumn("component", F.coalesce("component", "id"))))
    if left.isEmpty():
        return links
    most = REFINE * BLOCK
    second = left.where(F.col("rows") > most).select("id", "n", "component", F.col("s").alias("s1")).join(classes.select("id", "bands"), "id")
    second = second.withColumn("s2", F.explode("bands")).where("s1 <> s2").select(F.xxhash64(F.least("s1", "s2"), F.greatest("s1", "s2")).alias("s"), "id", "n", "component").distinct()
    both = materialize(left.where(F.col("rows") <= most).unionByName(several(second)))
    done = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    few, large = materialize(pairs_apart(both.where(F.col("rows") <= BLOCK), classes, percent).join(done, ["a", "b"], "left_anti")), both.where(F.col("rows") > BLOCK)
    needed = few.select(F.explode(F.array("a", "b")).alias("id")).unionByName(large.select("id")).distinct().join(sets.select("id"), "id", "left_anti")
    sets = sets.unionByName(sets_of_ids(docs, classes, needed, shingle))
    return links.unionByName(row_products(few, sets, percent)).unionByName(blocks_apart(large, sets, percent))


def sets_of_ids(docs: DataFrame, classes: DataFrame, ids: DataFrame, shingle: int) -> DataFrame:
    """(id, set, hot) of the classes with these ids; nothing is hot."""
    wanted = classes.select("id", "c1", "c2", "member").join(ids, "id", "left_semi").withColumn("hot", F.array().cast("array<long>"))
    return row_sets(docs, materialize(wanted), shingle)


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row: documents that links of at least `percent` % similarity connect."""
    all_rows = materialize(document_bands(docs, shingle, bands, rows))
    classes = all_rows.where("n > 0").groupBy("c1", "c2").agg(F.min("doc_id").alias("first"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("member"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("parity").alias("parity"))
    classes = materialize(classes.withColumn("id", F.monotonically_increasing_id()))
    reached = components(class_links(docs, classes, shingle, percent))
    named = classes.select("id", "c1", "c2", "first").join(reached, F.col("id") == F.col("node"), "left").withColumn("component", F.coalesce("component", "id"))
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    out = all_rows.select("doc_id", "n", "c1", "c2").join(named.join(least, "component").select("c1", "c2", "component_id"), ["c1", "c2"], "left")
    of = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), of.alias("component_id"), F.col("doc_id").eqNullSafe(of).alias("kept"))
