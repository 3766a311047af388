"""N-gram Jaccard join: exact links between documents whose sets of word shingles are similar enough.

Words are runs without ASCII white space, A-Z lower-cased; a document's set holds 62-bit hashes of its runs of `shingle`
words, or of its whole sequence if it is shorter. Documents with equal sets (by 128 bits of hash) form a class. Classes are
the rows of an incidence matrix, shingles its columns, and overlaps are counts in the product of the matrix with itself.

The product runs over two blocks of columns. The first has each row's first few shingles in an order common to all, so many
that rows which link share one. There each column's outer product goes to a sum for each pair of rows; a pair is dropped if
its count and what its sizes leave room for can't reach the overlap that its sizes ask for. The second has all columns of
the pairs that are left, a row against all its partners at a time, and gives exact overlaps. A column in more than BLOCK
rows is cut into blocks of rows instead: every two blocks are one product over all columns, whose links leave the task as a
spanning forest and a number of links for each row, so that a large group of near copies is never spelt out as pairs. Small
signatures of the sets, which bound differences from below, first drop the rows that no other row of the column can match.

The order puts shingles last that a sample of documents shows to be frequent; it decides the work only, never the result.

Defined cases: documents without words or text have an empty set and link with nothing; a null doc_id is a document
without a name, which links like any other: its component is that of the smallest doc_id it reaches, or null; repeated
rows are copies. Other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import materialize, mix, runs, signed, slices, small, text_bytes, word_hashes
from .components import components

#: Rows of a block, and bytes of its sets, on average.
BLOCK, BLOCK_BYTES = 256, 16 << 20
#: One in SAMPLE documents shows frequent shingles; those it shows at least SHOWN times, and at most FREQUENT of them, go last.
SAMPLE, SHOWN, FREQUENT = 8, 3, 500_000
BITS = np.uint64(2**62 - 1)
LATE = np.uint64(2**62)


def shingle_sets(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of each text, one text behind the other, and where each text's begin."""
    n = np.diff(first)
    size = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    at = np.concatenate([[0], np.cumsum(size)])
    out = np.empty(at[-1], np.uint64)
    g = runs(h, k) & BITS
    for f, words, a, m in zip(first.tolist(), n.tolist(), at.tolist(), size.tolist(), strict=False):
        if words >= k:
            out[a : a + m] = np.sort(g[f : f + m])
        elif words:  # the whole sequence, told apart from a run of k words by its length
            out[a] = (runs(h[f : f + words], words)[0] ^ mix(np.array([words], np.uint64))[0]) & BITS
    doc = np.repeat(np.arange(len(n)), size)
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != out[:-1]) | (doc[1:] != doc[:-1])
    return out[keep], np.concatenate([[0], np.cumsum(np.bincount(doc[keep], minlength=len(n)))]).astype(np.int64)


def sets_of(column: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number of the first text, sets, where each text's begin) for slices of a column of texts."""
    data, at = text_bytes(column)
    for lo, hi in slices(at):
        yield lo, *shingle_sets(*word_hashes(data, at[lo : hi + 1], lower=True), k)


def class_names(s: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that name each set, as two signed columns; those of an empty set are 0."""
    out = []
    for salt in (np.uint64(1), np.uint64(0x5851F42D4C957F2D)):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(mix(s + salt)))])
        out.append(signed(total[at[1:]] - total[at[:-1]]))
    return out[0], out[1]


def signature(s: np.ndarray) -> bytes:
    """Parities of how many hashes fall on each bit of a bitmap of at least 512 bits and twice the set's size."""
    bits = max(512, 1 << (2 * len(s)).bit_length())
    odd = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def differences(x: np.ndarray, y: np.ndarray) -> int:
    """At least so many hashes are in just one of two sets, by their signatures (64-bit words)."""
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def may_link(n, differ, percent: int):
    """Whether sets of n elements together that differ in at least `differ` can be similar enough."""
    return (100 + percent) * (n - differ) >= 2 * percent * n


def document_sets(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, text_hash, n, c1, c2): the size and the name of every row's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, s, at in sets_of(batch.column(1), shingle):
                names = class_names(s, at)
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(lo, len(at) - 1) for i in (0, 2)), pa.array(np.diff(at)), *map(pa.array, names)], ["doc_id", "text_hash", "n", "c1", "c2"])

    return docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text")).mapInArrow(run, "doc_id long, text_hash long, n long, c1 long, c2 long")


def frequent_shingles(docs: DataFrame, shingle: int) -> np.ndarray:
    """At most FREQUENT shingles that are frequent in one in SAMPLE distinct texts."""
    text = docs.select("text").where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, s, _ in sets_of(batch.column(0), shingle):
                value, n = np.unique(s, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(signed(value)), pa.array(n)], ["s", "n"])

    n = text.mapInArrow(run, "s long, n long").groupBy("s").agg(F.sum("n").alias("n")).where(F.col("n") >= SHOWN)
    return np.sort(n.orderBy(F.desc("n"), "s").limit(FREQUENT).select("s").toArrow()["s"].to_numpy().astype(np.int64).view(np.uint64))


def prefix_length(n, percent: int):
    """So many first shingles of a set of n that linked sets share one."""
    return n + (-percent * n // 100) + 1


def entries(docs: DataFrame, shingle: int, percent: int, last: np.ndarray) -> DataFrame:
    """(s, c1, c2): the entries of the first block of columns, for every row of `docs`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, s, at in sets_of(batch.column(0), shingle):
                c1, c2 = class_names(s, at)
                doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
                late = last[np.minimum(np.searchsorted(last, s), len(last) - 1)] == s if len(last) else np.zeros(len(s), bool)
                order = np.lexsort((late, doc))  # stable: sets stay sorted within early and late shingles
                s, nth = np.where(late, s | LATE, s)[order], np.arange(len(s)) - at[doc]
                keep = nth < prefix_length(np.diff(at), percent)[doc]
                d = doc[keep]
                yield pa.RecordBatch.from_arrays([pa.array(signed(s[keep])), pa.array(c1[d]), pa.array(c2[d])], ["s", "c1", "c2"])

    return docs.select("text").mapInArrow(run, "s long, c1 long, c2 long")


def column_products(columns: DataFrame, percent: int) -> DataFrame:
    """(a, b, count) with a < b: overlaps of rows within the columns (s, weight, id, n), each worth its weight; pairs whose sizes rule a link out are left out.

    A task accumulates the counts of what it has at a time; the columns' rows must be together and no more than BLOCK.
    """

    def product(s: np.ndarray, weight: np.ndarray, ids: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        start = np.flatnonzero(np.diff(s, prepend=s[:1] - 1))
        m = np.diff(np.append(start, len(s)))
        # entry i of a column meets those behind it
        behind = np.repeat(start + m, m) - np.arange(len(s)) - 1
        i = np.repeat(np.arange(len(s)), behind)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(behind) - behind, behind)
        fits = 100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])
        i, j = i[fits], j[fits]
        a, b, w = np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j]), weight[i]
        order = np.lexsort((b, a))
        a, b, w = a[order], b[order], w[order]
        head = np.flatnonzero((np.diff(a, prepend=a[:1] - 1) != 0) | (np.diff(b, prepend=b[:1] - 1) != 0))
        return pa.RecordBatch.from_arrays([pa.array(a[head]), pa.array(b[head]), pa.array(np.add.reduceat(w, head) if len(head) else w)], ["a", "b", "count"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            t = [c.to_numpy() for c in batch.columns]
            held = t if held is None else [np.concatenate(x) for x in zip(held, t, strict=True)]
            whole = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0  # the last column may go on
            if whole:
                yield product(*(x[:whole] for x in held))
                held = [x[whole:] for x in held]
        if held is not None and len(held[0]):
            yield product(*held)

    c = columns.select("s", "weight", "id", "n").repartition("s").sortWithinPartitions("s", "id")
    return c.mapInArrow(run, "a long, b long, count long").groupBy("a", "b").agg(F.sum("count").alias("count"))


def row_sets(docs: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """(id, set, hot) for the rows (member, c1, c2, id, hot) of `wanted`; a set is its hashes as bytes."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    d = d.join(small(wanted, 500_000), F.expr("doc_id <=> member.doc_id and text_hash = member.text_hash"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c1, c2 = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for lo, s, at in sets_of(batch.column(0), shingle):
                x, y = class_names(s, at)
                k = len(at) - 1
                mine = np.flatnonzero((c1[lo : lo + k] == x) & (c2[lo : lo + k] == y))  # not what only has an equal hash
                sets = [s[at[i] : at[i + 1]].tobytes() for i in mine.tolist()]
                yield pa.RecordBatch.from_arrays([batch.column(3).take(pa.array(lo + mine)), pa.array(sets, pa.binary()), batch.column(4).take(pa.array(lo + mine))], ["id", "set", "hot"])

    return materialize(d.select("text", "c1", "c2", "id", "hot").mapInArrow(run, "id long, set binary, hot array<long>").dropDuplicates(["id"]))


def _of_bytes(x: pa.Scalar) -> np.ndarray:
    return np.frombuffer(x.as_buffer(), np.uint64)


def row_products(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): the pairs that link, by the overlaps of each row a with all its partners over all columns.

    Pairs that share a column of the large ones are counted there.
    """
    partner = pairs.join(sets.withColumnRenamed("id", "b"), "b").select("a", "b", "set", "hot")
    own = pairs.select("a").distinct().join(sets.withColumnRenamed("id", "a"), "a").select("a", F.lit(None).cast("long").alias("b"), "set", "hot")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, mine, hot = None, None, set()
        for batch in batches:
            a, b = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            out: list[list[int]] = [[], []]
            start = np.flatnonzero(np.diff(a, prepend=a[:1] - 1)).tolist() if len(a) else []
            for lo, hi in zip(start, [*start[1:], len(a)], strict=True):
                if int(a[lo]) != row:  # a row's own set comes first
                    row, mine, hot = int(a[lo]), _of_bytes(batch.column(2)[lo]), set(batch.column(3)[lo].as_py())
                    lo += 1
                if lo == hi:
                    continue
                sets = [_of_bytes(batch.column(2)[i]) for i in range(lo, hi)]
                size = np.array([len(x) for x in sets])
                flat = np.concatenate(sets)
                hit = mine[np.minimum(np.searchsorted(mine, flat), len(mine) - 1)] == flat
                both = np.add.reduceat(hit.astype(np.int64), np.cumsum(size) - size)
                for i in np.flatnonzero(100 * both >= percent * (len(mine) + size - both)).tolist():
                    if hot.isdisjoint(batch.column(3)[lo + i].as_py()):
                        out[0].append(row)
                        out[1].append(b[lo + i])
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["a", "b"])

    x = partner.unionByName(own).repartition("a").sortWithinPartitions("a", F.asc_nulls_first("b"))
    return x.mapInArrow(run, "a long, b long")


def overlaps(sets: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """Sizes of all intersections: the incidence matrix times its transpose, summed over blocks of its columns."""
    rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count > 1
    number = np.cumsum(shared) - 1
    keep = shared[column]
    rows, column = rows[keep], number[column[keep]]
    order = np.argsort(column, kind="stable")
    rows, column = rows[order], column[order]
    out = np.zeros((len(sets), len(sets)), np.float64)
    for start in range(0, int(shared.sum()), columns):
        lo, hi = np.searchsorted(column, [start, start + columns])
        a = np.zeros((len(sets), columns), np.float32)
        a[rows[lo:hi], column[lo:hi] - start] = 1
        out += a @ a.T
    return out


def block_pairs(members: DataFrame) -> DataFrame:
    """(s, i, j, block, id): the rows (s, id, rows and bytes of s), each for all pairs of blocks of its column that it is in."""
    blocks = F.greatest(F.ceil(F.col("rows") / BLOCK), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("int")
    m = members.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    m = m.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return m.select("s", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id")


def possible_members(members: DataFrame, sigs: DataFrame, percent: int) -> DataFrame:
    """The rows of `members` (s, id) that can link with another of the same column."""

    def compare(t: pa.Table) -> pa.Table:
        sig = [_of_bytes(x) for x in t["sig"]]
        n, short = t["n"].to_numpy(), min(map(len, sig))
        folded = np.empty((len(sig), short), np.uint64)
        for k, x in enumerate(sig):
            folded[k] = np.bitwise_xor.reduce(x.reshape(-1, short), axis=0)
        able = np.zeros(len(sig), bool)
        for k in range(len(sig)):
            differ = np.bitwise_count(folded[k] ^ folded).sum(axis=1)
            maybe = may_link(n[k] + n, differ, percent) & (100 * np.minimum(n[k], n) >= percent * np.maximum(n[k], n))
            maybe[k] = False
            able[k] = any(may_link(int(n[k] + n[x]), differences(sig[k], sig[x]), percent) for x in np.flatnonzero(maybe))
        return t.select(["s", "id"]).filter(pa.array(able))

    m = block_pairs(members).join(sigs, "id").select("s", "i", "j", "id", "n", "sig")
    return m.groupBy("s", "i", "j").applyInArrow(compare, "s long, id long").distinct()


def block_products(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b, n): links a-b within the large columns, as a spanning forest of each pair of blocks, and rows (a, null, n) of each row's number of links.

    Rows that share an earlier large column are counted there.
    """
    m = block_pairs(members).join(sets, "id")

    def product(t: pa.Table) -> pa.Table:
        names, block, column = t["id"].to_numpy(), t["block"].to_numpy(), t["s"][0].as_py()
        s = [_of_bytes(x) for x in t["set"]]
        size = np.array([len(x) for x in s])
        n = overlaps(s)
        link = 100 * n >= percent * (size[:, None] + size[None, :] - n)
        if t["i"][0].as_py() != t["j"][0].as_py():
            link &= block[:, None] != block[None, :]
        earlier = overlaps([np.array([x for x in h if x < column], np.int64).view(np.uint64) for h in t["hot"].to_pylist()]) > 0
        np.fill_diagonal(link, False)
        degree = (link & ~earlier).sum(axis=1)
        np.fill_diagonal(link, True)
        root = np.arange(len(s))
        while True:
            new = np.where(link, root[None, :], len(s)).min(axis=1)
            new = np.minimum(new, new[root])
            if (new == root).all():
                break
            root = new
        child, linked = np.flatnonzero(root != np.arange(len(s))), np.flatnonzero(degree)
        a = np.concatenate([names[root[child]], names[linked]])
        b = pa.concat_arrays([pa.array(names[child]), pa.nulls(len(linked), pa.int64())])
        return pa.table({"a": a, "b": b, "n": np.concatenate([np.zeros(len(child), np.int64), degree[linked]])})

    return m.groupBy("s", "i", "j").applyInArrow(product, "a long, b long, n long")


def class_links(docs: DataFrame, classes: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Links (a, b, n) between `classes` (id, c1, c2, n, member): rows (a, b, null) are links, rows (a, b, 0) connect as others do that are only counted, by rows (a, null, n)."""
    last = frequent_shingles(docs, shingle)
    own = F.xxhash64("c1", "c2", F.lit(1)).cast("decimal(20,0)"), F.xxhash64("c2", "c1", F.lit(2)).cast("decimal(20,0)")
    column = Window.partitionBy("s")
    p = entries(docs, shingle, percent, last).repartition("s").distinct()
    p = p.withColumn("rows", F.count(F.lit(1)).over(column)).where("rows > 1").withColumns({f"same{i}": F.sum(x).over(column) for i, x in enumerate(own)})
    p = materialize(p)
    # columns with equal entries are multiplied once, for the first of them, which is worth them all
    heads = p.groupBy("s", "rows", "same0", "same1").agg(F.lit(1).alias("one")).groupBy("rows", "same0", "same1").agg(F.min("s").alias("s"), F.count(F.lit(1)).alias("weight"))
    p = p.drop("rows", "same0", "same1").join(heads.select("s", "rows", "weight"), "s").join(classes.select("c1", "c2", "id", "n", "member"), ["c1", "c2"])
    p = materialize(p.select("s", "weight", "rows", "id", "n", "member", "c1", "c2"))

    counted = column_products(p.where(F.col("rows") <= BLOCK), percent)
    n_of = p.groupBy("id").agg(F.first("n").alias("n"))
    counted = counted.join(n_of.select(F.col("id").alias("a"), F.col("n").alias("na")), "a").join(n_of.select(F.col("id").alias("b"), F.col("n").alias("nb")), "b")
    rest = lambda n: n - (n - F.ceil(F.lit(percent) * n / 100) + 1)
    room = F.col("count") + F.greatest(rest(F.col("na")), rest(F.col("nb")))
    pairs = materialize(counted.where((100 + percent) * room >= percent * (F.col("na") + F.col("nb"))).select("a", "b"))

    large = p.where(F.col("rows") > BLOCK).select("s", "id", "n", "member", "c1", "c2")
    hot = large.groupBy("id").agg(F.sort_array(F.collect_set("s")).alias("hot"))
    sizes = lambda m: m.withColumn("rows", F.count(F.lit(1)).over(column)).withColumn("bytes", 8 * F.sum("n").over(column)).where("rows > 1")
    many = large.select("s", "id", "n")
    some = many.limit(1).count()
    if some:
        sigs = signatures(docs, materialize(large.select("id", "n", "c1", "c2", "member").distinct()), shingle)
        many = materialize(sizes(possible_members(sizes(many), sigs, percent).join(sigs.select("id", "n"), "id")).select("s", "id", "rows", "bytes"))

    met = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).unionByName(many.select("id")).distinct()
    wanted = classes.select("id", "c1", "c2", "member").join(met, "id", "left_semi").join(hot, "id", "left")
    sets = row_sets(docs, materialize(wanted.withColumn("hot", F.coalesce("hot", F.array().cast("array<long>")))), shingle)
    links = row_products(pairs, sets, percent).withColumn("n", F.lit(None).cast("long"))
    return links.unionByName(block_products(many, sets, percent)) if some else links


def signatures(docs: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """(id, n, sig) of the rows (id, n, c1, c2, member)."""
    sets = row_sets(docs, wanted.withColumn("hot", F.array().cast("array<long>")), shingle)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [_of_bytes(x) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in sets], pa.int64()), pa.array([signature(x) for x in sets], pa.binary())], ["id", "n", "sig"])

    return materialize(sets.mapInArrow(run, "id long, n long, sig binary"))


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links, n_copies, text_hash, kept) of every row: documents that links of at least `percent` % similarity connect.

    `n_links` counts the other sets that a document's set links with, `n_copies` the other rows that have the same set. Of
    each component one document is kept, that with the least doc_id (none comes last) and, of rows that share it, the least
    hash of its text; rows equal in both are kept together. Documents without shingles are kept.
    """
    rows = materialize(document_sets(docs, shingle))
    classes = rows.where("n > 0").groupBy("c1", "c2").agg(F.min("doc_id").alias("first"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("member"), F.first("n").alias("n"), F.count(F.lit(1)).alias("copies"))
    classes = materialize(classes.withColumn("id", F.monotonically_increasing_id()))
    links = materialize(class_links(docs, classes, shingle, percent))
    reached = components(links.where("b is not null").select("a", "b"))
    named = classes.select("id", "first", "member").join(reached, F.col("id") == F.col("node"), "left").select("id", "first", "member", F.coalesce("component", "id").alias("component"))
    least = named.groupBy("component").agg(F.min("first").alias("component_id"), F.min("member").alias("kept"))
    both = links.where("n is null").select(F.explode(F.array("a", "b")).alias("id"), F.lit(1).cast("long").alias("n")).unionByName(links.where("b is null").select(F.col("a").alias("id"), "n"))
    degree = both.groupBy("id").agg(F.sum("n").alias("n_links"))
    of_class = classes.join(named.select("id", "component").join(least, "component"), "id").join(degree, "id", "left")
    of_class = of_class.select("c1", "c2", "component_id", "kept", F.coalesce("n_links", F.lit(0)).alias("n_links"), (F.col("copies") - 1).alias("n_copies"))
    out = rows.join(of_class, ["c1", "c2"], "left")
    empty = F.col("n") == 0
    kept = empty | F.col("doc_id").eqNullSafe(F.col("kept.doc_id")) & F.col("text_hash").eqNullSafe(F.col("kept.text_hash"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(empty, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), *(F.when(empty, 0).otherwise(F.col(c)).cast("long").alias(c) for c in ("n_links", "n_copies")), "text_hash", kept.alias("kept"))
