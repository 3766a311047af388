"""Substring dedup by suffix trees, one for each group of suffixes with a common prefix.

Words are runs without ASCII white space. A window is `window` consecutive words of a document; a word goes if a window
covers it whose words also start earlier: in a document with a smaller doc_id, or earlier in the same one.

A suffix is spelt in letters of SYMBOL words each, 64 bits of hash. Suffixes are split by prefixes: of one
letter, or of more where a sample of documents shows that over GROUP_ROWS suffixes begin alike, so that a prefix's
suffixes are one task's small share. The prefix only says where a suffix is worked on, never what comes out. Of each
prefix's suffixes, put in order, the depth that each shares with the one before gives the tree: a node is a run of
suffixes that share at least its depth. A node at least `window` words deep is a repeated string; its first leaf stays,
the others are repeats, and overlapping ones make up the maximal repeats of a document.

Two things keep the trees small. A suffix can only be repeated if the run of ANCHOR words in it with the least hash is (its
anchor, one for about eight words), so anchors are counted first, and suffixes of anchors that occur once are left out. And
what a batch of documents already shows to be a repeat is settled before the shuffle, so that of a frequent passage, or of
a text that repeats itself, each batch sends each suffix once.

Defined cases: null and empty texts have no words; texts of fewer words than a window lose none; a null doc_id is smaller
than any other; rows that share a doc_id are versions of one document, so a window at the same start in both stays in
both. Other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import materialize, mix, runs, signed, slices, text_bytes, word_hashes

#: Words of a letter; suffixes of a prefix, about; one in SAMPLE documents shows prefixes that are too frequent, at most FREQUENT of each length.
SYMBOL, GROUP_ROWS, SAMPLE, FREQUENT = 10, 4_000, 128, 100_000
#: Words of an anchor.
ANCHOR = 5
#: Suffixes that a batch gathers before it sends them.
GATHERED = 400_000
NULL_ID = -(2**63)


class Shape:
    """How windows are spelt: words of a letter, and where a window's letters begin."""

    def __init__(self, window: int):
        self.window, self.symbol, self.anchor = window, min(SYMBOL, window), min(ANCHOR, window)
        self.at = [min(i, window - self.symbol) for i in range(0, window, self.symbol)]


def least_places(g: np.ndarray, width: int) -> np.ndarray:
    """For each `width` consecutive values the place of the first least one, by doubling the width."""
    place, span = np.arange(len(g)), 1
    while span < width and len(place):
        step = min(span, width - span)
        a, b = place[: len(place) - step], place[step:]
        place = np.where(g[b] < g[a], b, a)
        span += step
    return place


def windows(h: np.ndarray, first: np.ndarray, shape: Shape) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of anchors at all places, starts of all windows, their anchors' places, and the text of each word."""
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    g = runs(h, shape.anchor)
    place = least_places(g, shape.window - shape.anchor + 1)
    start = np.flatnonzero(doc[: len(place)] == doc[shape.window - 1 :])
    return g, start, place[start], doc


def is_in(x: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Whether each value is in a sorted array."""
    if not len(among):
        return np.zeros(len(x), bool)
    return among[np.minimum(np.searchsorted(among, x), len(among) - 1)] == x


def repeated_in_text(doc: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For (text, key) rows: whether each has an equal one, and the numbers of the first of each kind."""
    order = np.lexsort((np.arange(len(key)), key, doc))
    same = np.zeros(len(key), bool)
    same[1:] = (doc[order][1:] == doc[order][:-1]) & (key[order][1:] == key[order][:-1])
    twice = same.copy()
    twice[:-1] |= same[1:]
    out = np.zeros(len(key), bool)
    out[order] = twice
    return out, order[~same]


def prefix_keys(letters: list[np.ndarray], frequent: list[np.ndarray]) -> np.ndarray:
    """The hash of each suffix's prefix: of its first letter, and of one more for as long as the prefix is frequent."""
    key, more = letters[0], np.ones(len(letters[0]), bool)
    for letter, known in zip(letters[1:], frequent, strict=True):
        more &= is_in(key, known)
        if not more.any():
            break
        key = np.where(more, mix(key * np.uint64(0x9E3779B97F4A7C15) + letter), key)
    return key


def _rows(docs: DataFrame) -> DataFrame:
    d = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc"), "text")
    return d.withColumn("row", F.xxhash64("doc", "text"))


class Frequent:
    """What a sample of documents shows to be frequent: anchors, and prefixes of each length that are too long for a group."""

    def __init__(self, rows: DataFrame, shape: Shape):
        sample = rows.where(F.pmod(F.col("row"), F.lit(SAMPLE)) == 0).select("text")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                data, at = text_bytes(batch.column(0))
                for lo, hi in slices(at):
                    h, first = word_hashes(data, at[lo : hi + 1])
                    g, start, place, doc = windows(h, first, shape)
                    spelt = runs(h, shape.symbol)
                    anchor = place[np.diff(place, prepend=-1) > 0]
                    prefixes = [np.ones(len(start), np.uint64) * np.uint64(0)]
                    for offset in shape.at[:-1]:
                        letter = spelt[start + offset]
                        prefixes.append(mix(prefixes[-1] * np.uint64(0x9E3779B97F4A7C15) + letter) if offset else letter)
                    for length, (d, key) in enumerate([(doc[anchor], g[anchor]), *((doc[start], p) for p in prefixes[1:])]):
                        # each text counts once for a key: what it repeats by itself is settled in its batch
                        once = repeated_in_text(d, key)[1]
                        value, n = np.unique(key[once], return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(value), length, np.int8)), pa.array(signed(value)), pa.array(n)], ["length", "key", "n"])

        n = sample.mapInArrow(run, "length tinyint, key long, n long").groupBy("length", "key").agg(F.sum("n").alias("n"))
        rank = F.row_number().over(Window.partitionBy("length").orderBy(F.desc("n"), "key"))
        n = n.where(F.col("n") >= max(2, GROUP_ROWS // SAMPLE)).withColumn("rank", rank).where(F.col("rank") <= FREQUENT).select("length", "key").toArrow()
        length, key = n["length"].to_numpy(), n["key"].to_numpy().view(np.uint64)
        of = [np.sort(key[length == i]) for i in range(len(shape.at))]
        self.anchors, self.prefixes = of[0], of[1:]


def anchor_table(rows: DataFrame, shape: Shape, frequent: Frequent) -> DataFrame:
    """(key, row, at): the anchors of each row's windows, once a row each and without those known to be frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, (data, at) = batch.column(0).to_numpy(), text_bytes(batch.column(1))
            for lo, hi in slices(at):
                h, first = word_hashes(data, at[lo : hi + 1])
                g, _, place, doc = windows(h, first, shape)
                place = place[np.diff(place, prepend=-1) > 0]
                place = place[repeated_in_text(doc[place], g[place])[1]]
                place = place[~is_in(g[place], frequent.anchors)]
                d = doc[place]
                yield pa.RecordBatch.from_arrays([pa.array(signed(g[place])), pa.array(row[lo + d]), pa.array((place - first[d]).astype(np.int32))], ["key", "row", "at"])

    return rows.select("row", "text").mapInArrow(run, "key long, row long, at int")


class Gathered:
    """Suffixes of a batch of documents, of which repeats within the batch are settled at once."""

    def __init__(self, shape: Shape, frequent: Frequent):
        self.shape, self.frequent, self.n = shape, frequent, 0
        self.parts: list[list[np.ndarray]] = []

    def add(self, letters: list[np.ndarray], doc: np.ndarray, row: np.ndarray, start: np.ndarray) -> None:
        self.parts.append([*letters, doc, row, start])
        self.n += len(start)

    def take(self) -> pa.RecordBatch:
        """Rows of suffixes (key, letters behind the first, doc, row, start), and of repeats (doc, row, start, end)."""
        *letters, doc, row, start = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        self.parts, self.n = [], 0
        whole = letters[0]
        for letter in letters[1:]:
            whole = mix(whole * np.uint64(0x9E3779B97F4A7C15) + letter)
        order = np.lexsort((start, doc, whole))
        letters, doc, row, start = [x[order] for x in letters], doc[order], row[order], start[order]
        head = np.ones(len(start), bool)
        head[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in letters])
        first = np.maximum.accumulate(np.where(head, np.arange(len(head)), 0))
        late = (doc != doc[first]) | (start != start[first])
        # repeats that overlap in a row are one
        by = np.flatnonzero(late)
        by = by[np.lexsort((start[by], row[by], doc[by]))]
        d, r, s = doc[by], row[by], start[by]
        new = np.ones(len(by), bool)
        new[1:] = (d[1:] != d[:-1]) | (r[1:] != r[:-1]) | (s[1:] > s[:-1] + self.shape.window)
        end = s[np.append(np.flatnonzero(new)[1:], len(by)) - 1] + self.shape.window if len(by) else s
        keep = np.flatnonzero(~late)
        letters = [x[keep] for x in letters]
        n, m = len(keep), int(new.sum())
        none = pa.nulls(m, pa.int64())
        key = np.concatenate([signed(prefix_keys(letters, self.frequent.prefixes)), signed(mix(r[new].view(np.uint64)))])
        columns = [pa.array(key), *(pa.concat_arrays([pa.array(signed(x)), none]) for x in letters[1:])]
        columns += [pa.array(np.concatenate([a[keep], b[new]])) for a, b in ((doc, d), (row, r), (start, s))]
        columns.append(pa.concat_arrays([pa.nulls(n, pa.int32()), pa.array(end.astype(np.int32))]))
        return pa.RecordBatch.from_arrays(columns, names(self.shape))


def names(shape: Shape) -> list[str]:
    return ["key", *(f"l{i}" for i in range(1, len(shape.at))), "doc", "row", "start", "end"]


def suffix_table(rows: DataFrame, wanted: DataFrame, shape: Shape, frequent: Frequent) -> DataFrame:
    """The rows of `Gathered.take` for all suffixes that can be repeated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_id, row, (data, at) = batch.column(0).to_numpy(), batch.column(1).to_numpy(), text_bytes(batch.column(2))
            anchors, gathered = batch.column(3), Gathered(shape, frequent)
            of = np.concatenate([[0], np.cumsum([len(x) if x.is_valid else 0 for x in anchors])])
            flat = anchors.drop_null().flatten().to_numpy().astype(np.int64)
            for lo, hi in slices(at):
                h, first = word_hashes(data, at[lo : hi + 1])
                g, start, place, doc = windows(h, first, shape)
                if not len(start):
                    continue
                able = np.zeros(len(g), bool)
                mark = np.repeat(first[:-1], np.diff(of[lo : hi + 1])) + flat[of[lo] : of[hi]]
                able[mark[mark < len(g)]] = True
                once = place[np.diff(place, prepend=-1) > 0]
                able[once] |= repeated_in_text(doc[once], g[once])[0] | is_in(g[once], frequent.anchors)
                start = start[able[place]]
                d = doc[start]
                spelt = runs(h, shape.symbol)
                gathered.add([spelt[start + i] for i in shape.at], doc_id[lo + d], row[lo + d], (start - first[d]).astype(np.int32))
                if gathered.n > GATHERED:
                    yield gathered.take()
            if gathered.n:
                yield gathered.take()

    kinds = ", ".join(f"{n} {'int' if n in ('start', 'end') else 'long'}" for n in names(shape))
    return rows.join(wanted, "row", "left").select("doc", "row", "text", "at").mapInArrow(run, kinds)


def depths(columns: list[np.ndarray]) -> np.ndarray:
    """Of rows in order, how many columns from the first on each row shares with the row before; the first row shares none."""
    depth = np.zeros(len(columns[0]), np.int64)
    same = np.ones(max(len(depth) - 1, 0), bool)
    for c in columns:
        same = same & (c[1:] == c[:-1])
        depth[1:] += same
    return depth


def repeats_in_trees(suffixes: DataFrame, shape: Shape) -> DataFrame:
    """(doc, row, start, end): the leaves of deep nodes but the first of each, and the repeats already known.

    The suffixes of a partition come in order, so its trees' nodes are runs of rows and nothing is gathered.
    """
    *path, _, _, _, _ = names(shape)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, node = None, None  # the suffix before, and the start of the first leaf of its deep node
        for batch in batches:
            x = pa.Table.from_batches([batch])
            known = x.filter(pa.compute.is_valid(x["end"])).select(["doc", "row", "start", "end"])
            yield from known.to_batches()
            x = x.filter(pa.compute.is_null(x["end"]))
            if not x.num_rows:
                continue
            letters = [x[c].to_numpy() for c in path]
            doc, start = x["doc"].to_numpy(), x["start"].to_numpy()
            if last is not None:
                letters = [np.append(a, b) for a, b in zip(last, letters, strict=True)]
                doc, start = np.append(node[0], doc), np.append(node[1], start)
            else:
                letters, doc, start = [np.append(a[:1] + 1, a) for a in letters], np.append(doc[:1], doc), np.append(start[:1], start)
            deep = depths(letters) == len(path)
            first = np.maximum.accumulate(np.where(deep, 0, np.arange(len(deep))))
            late = (doc != doc[first]) | (start != start[first])
            last, node = [a[-1:] for a in letters], (doc[first[-1:]], start[first[-1:]])
            late = late[1:]
            out = x.select(["doc", "row", "start"]).filter(pa.array(late))
            end = pa.array(out["start"].to_numpy() + np.int32(shape.window), pa.int32())
            yield from out.append_column("end", end).to_batches()

    s = suffixes.repartition("key").sortWithinPartitions(*path, "doc", "start", "row")
    return s.mapInArrow(run, "doc long, row long, start int, end int")


def repeats(rows: DataFrame, window: int = 20) -> DataFrame:
    """(doc, row, spans) of the rows that have repeats: the structs (start, end) cover their words."""
    shape = Shape(window)
    frequent = Frequent(rows, shape)
    n = F.count(F.lit(1)).over(Window.partitionBy("key"))
    wanted = anchor_table(rows, shape, frequent).withColumn("n", n).where("n > 1").groupBy("row").agg(F.collect_list("at").alias("at"))
    wanted = materialize(wanted)
    found = materialize(repeats_in_trees(suffix_table(rows, wanted, shape, frequent), shape))
    return found.groupBy("doc", "row").agg(F.collect_list(F.struct("start", "end")).alias("spans"))


def remove_repeats(docs: DataFrame, window: int = 20) -> DataFrame:
    """(doc_id, n_words, n_removed, kept, repeats) of every row: the kept words joined by a space, and the maximal repeats
    as structs of their first word and the one behind their last."""
    rows = _rows(docs)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, kept, found = [], [], [], []
            for text, spans in zip(batch.column(1), batch.column(2), strict=True):
                words = text.as_py().encode().split() if text.is_valid else []
                stay, maximal = words, []
                if spans.is_valid:
                    x = spans.values
                    gone = np.zeros(len(words) + 1, np.int32)
                    np.add.at(gone, x.field(0).to_numpy(), 1)
                    np.add.at(gone, x.field(1).to_numpy(), -1)
                    off = gone.cumsum()[:-1] > 0
                    edge = np.flatnonzero(np.diff(np.concatenate([[False], off, [False]]).astype(np.int8)))
                    maximal = edge.reshape(-1, 2).tolist()
                    bounds = [0, *edge.tolist(), len(words)]
                    stay = [w for i in range(0, len(bounds), 2) for w in words[bounds[i] : bounds[i + 1]]]
                n_words.append(len(words))
                n_removed.append(len(words) - len(stay))
                kept.append(b" ".join(stay))
                found.append([{"start": a, "end": b} for a, b in maximal])
            span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            columns = [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(found, span)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_removed", "kept", "repeats"])

    d = rows.join(repeats(rows, window), ["doc", "row"], "left").select(F.when(F.col("doc") != NULL_ID, F.col("doc")).alias("doc_id"), "text", "spans")
    return d.mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept string, repeats array<struct<start:int,end:int>>")
