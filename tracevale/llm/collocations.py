"""Phrase collocation mining: counts of all phrases from tries of limited depth, merged by ranges of prefixes.

A shard is so many words of one language in one task. Its phrases of up to `max_words` words are a trie: a node for each
phrase, its children in the order of their last words' hashes, with a count of its own. The sorted trie is serialised in
pieces, one for each range of prefixes, and a task merges the pieces of a range from all shards, level by level: equal nodes
become one, and what is too rare loses its children before they are looked at. The ranges' bounds are whole phrases, taken
from a sample of distinct ones, so that no frequent word or prefix is one task's work; nodes that a range only passes through
are in its pieces with a count of 0 and are filled in afterwards (at most one a level, range and language).

The walk down the merged trie gives the counts of a phrase's first words. Its suffix link leads to the node of all but its
first word, and that node's own link further on, which gives the counts of its last words. A longer phrase has a node for each
phrase inside it, so direct parents and suffix links show whether a candidate is covered.

Words are runs without spaces and tabs, A-Z lower-cased, inside pieces that end at `. , ; : ! ?` and at line ends; they are
named by 64-bit hashes. Counts may be up to 10 ** 15; scores are exact.

Defined cases: a null text is an empty one and a null language is `und`; texts without words give nothing; repeated rows count
each time; ties go by count and then by phrase, in byte order. Other columns aren't read. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import ASCII_LOWER, WHITE_BYTE, materialize, mix, signed, slices, small, text_bytes, word_starts

#: Words of a shard.
SHARD = 1 << 21
#: Range bounds come from at most KEYS distinct phrases, one in THIN of those in one in SAMPLE documents.
SAMPLE, THIN, KEYS = 16, 64, 20_000
#: Lookup tables of at most so many rows are broadcast.
FEW = 500_000
OF_BYTE = np.arange(256, dtype=np.uint8)
OF_BYTE[list(b".,;:!?\x0b\x0c\r")] = 10


def joined_words(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(hashes, whether a word follows the one before it in a piece, bytes, first bytes) for slices of a column of texts."""
    data, at = text_bytes(column)
    for lo, hi in slices(at):
        raw, ends = OF_BYTE[data[at[lo] : at[hi]]], at[lo : hi + 1] - at[lo]
        h, starts = word_starts(raw, ends, lower=True)
        breaks = np.sort(np.concatenate([np.flatnonzero(raw == 10), ends[:-1]]))  # at or before a piece's first byte
        piece = np.searchsorted(breaks, starts, "right")
        yield h, np.diff(piece, prepend=-1) == 0, raw, starts


def levels_of(h: np.ndarray, joined: np.ndarray, depth: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(parent, last word, count) of the nodes of each level of the trie, in order."""
    words, rank, count = np.unique(h, return_inverse=True, return_counts=True)
    levels, start, node = [(np.zeros(len(words), np.int64), words, count)], np.arange(len(h)), rank
    for k in range(1, depth):
        more = start + k < len(h)
        start, node = start[more], node[more]
        more = joined[start + k]
        start, node = start[more], node[more]
        key, node, count = np.unique(node * len(words) + rank[start + k], return_inverse=True, return_counts=True)
        levels.append((key // max(1, len(words)), words[key % max(1, len(words))], count))
    return levels


def cuts_of(levels: list[tuple[np.ndarray, ...]], bounds: np.ndarray) -> np.ndarray:
    """For each bound (a row of hashes) and level, how many nodes aren't beyond it; a phrase comes before its continuations."""
    out = np.empty((len(bounds) + 2, len(levels)), np.int64)
    out[0], out[-1] = 0, [len(x) for _, x, _ in levels]
    for i, bound in enumerate(bounds, 1):
        lo, hi = 0, len(levels[0][1])
        for k, (parent, word, _) in enumerate(levels):
            if k:
                lo, hi = np.searchsorted(parent, [lo, hi])
            cut = lo + np.searchsorted(word[lo:hi], bound[k], "right")
            out[i, k] = cut
            lo, hi = (cut - 1, cut) if cut > lo and word[cut - 1] == bound[k] else (cut, cut)
    return out


def pieces_of(levels: list[tuple[np.ndarray, ...]], names: list[bytes], bounds: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(range, serialised part of the trie): sizes of levels, then each level's words, counts and numbers of children, then names."""
    cuts = cuts_of(levels, bounds)
    for r in range(len(cuts) - 1):
        lo, hi = cuts[r].copy(), cuts[r + 1]
        if (lo == hi).all():
            continue
        for k in range(len(levels) - 1, 0, -1):  # the nodes on the way to the first one
            if lo[k] < hi[k]:
                lo[k - 1] = min(lo[k - 1], levels[k][0][lo[k]])
        out = [(hi - lo).astype("<i8").tobytes()]
        for k, (_, word, count) in enumerate(levels):
            own = count[lo[k] : hi[k]].astype("<u4")
            own[: cuts[r, k] - lo[k]] = 0
            out += [word[lo[k] : hi[k]].tobytes(), own.tobytes()]
            if k + 1 < len(levels):
                out.append(np.bincount(levels[k + 1][0][lo[k + 1] : hi[k + 1]] - lo[k], minlength=hi[k] - lo[k]).astype("<u4").tobytes())
        own_names = names[lo[0] : hi[0]]
        out += [np.array([len(x) for x in own_names], "<u4").tobytes(), *own_names]
        yield r, b"".join(out)


def read_piece(raw: bytes, depth: int) -> tuple[list[tuple[np.ndarray, np.ndarray, np.ndarray | None]], np.ndarray, bytes]:
    """(words, counts, numbers of children) of each level, lengths of names, names."""
    at = 8 * depth

    def take(n: int, kind: str) -> np.ndarray:
        nonlocal at
        x = np.frombuffer(raw, kind, n, at)
        at += x.nbytes
        return x

    sizes = np.frombuffer(raw, "<i8", depth).tolist()
    levels = [(take(n, "<u8"), take(n, "<u4").astype(np.int64), take(n, "<u4") if k + 1 < depth else None) for k, n in enumerate(sizes)]
    return levels, take(sizes[0], "<u4"), raw[at:]


def shards(docs: DataFrame, depth: int, bounds: np.ndarray) -> DataFrame:
    """(part, lang, trie) of the rows (lang, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        words: dict[str, dict[int, bytes]] = {}

        def tries() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                h, joined = (np.concatenate(x) for x in zip(*parts, strict=True))
                levels = levels_of(h, joined, depth)
                names = list(map(words[lang].__getitem__, levels[0][1].tolist()))
                for r, trie in pieces_of(levels, names, bounds):
                    yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([lang]), pa.array([trie], pa.binary())], ["part", "lang", "trie"])
            held.clear()
            words.clear()

        n = 0
        for batch in batches:
            langs = batch.column(0)
            for lang in langs.unique().to_pylist():
                for h, joined, raw, starts in joined_words(batch.column(1).filter(pc.equal(langs, lang))):
                    if not len(h):
                        continue
                    known = words.setdefault(lang, {})
                    distinct, first = np.unique(h, return_index=True)
                    ends = np.append(np.flatnonzero(WHITE_BYTE[raw]), len(raw))
                    for value, a, b in zip(distinct.tolist(), starts[first].tolist(), _word_ends(starts, ends, raw, first), strict=True):
                        if value not in known:
                            known[value] = raw[a:b].tobytes().translate(ASCII_LOWER)
                    held.setdefault(lang, []).append((h, joined))
                    n += len(h)
                    if n >= SHARD:
                        yield from tries()
                        n = 0
        yield from tries()

    return docs.mapInArrow(run, "part int, lang string, trie binary")


def _word_ends(starts: np.ndarray, ends: np.ndarray, raw: np.ndarray, which: np.ndarray) -> list[int]:
    """Where words end: at white space or where the next word starts, if a text ended between."""
    after = np.append(starts[1:], len(raw))[which]
    return np.minimum(ends[np.searchsorted(ends, starts[which])], after).tolist()


def prefix_bounds(docs: DataFrame, depth: int, ranges: int) -> np.ndarray:
    """At most `ranges` - 1 phrases, in order, that part the distinct phrases of the rows (lang, text) about evenly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h, joined, _, _ in joined_words(batch.column(0)):
                key = np.zeros((len(h), depth), np.uint64)
                whole = np.ones(len(h), bool)
                name = np.zeros(len(h), np.uint64)
                for k in range(depth):
                    if k:
                        whole[len(h) - k :] = False
                        whole[: len(h) - k] &= joined[k:]
                    n = max(len(h) - k, 0)
                    key[:n, k] = np.where(whole[:n], h[k:], 0)
                    name = mix(name ^ key[:, k])
                keep = name % np.uint64(THIN) == 0
                yield pa.RecordBatch.from_arrays([pa.array(signed(name[keep])), pa.FixedSizeListArray.from_arrays(pa.array(signed(key[keep]).ravel()), depth).cast(pa.list_(pa.int64()))], ["name", "key"])

    sampled = docs.where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0).select("text")
    rows = sampled.mapInArrow(run, "name long, key array<long>").distinct().orderBy("name", "key").limit(KEYS).collect()
    key = np.array([r.key for r in rows], np.int64).reshape(-1, depth).view(np.uint64)
    key = key[np.lexsort(key.T[::-1])]
    at = np.unique(np.arange(1, ranges) * len(key) // ranges)
    return key[at] if len(key) else key


def _groups(parent: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first row, inverse) of equal (parent, word), in order."""
    order = np.lexsort((word, parent))
    p, w = parent[order], word[order]
    head = np.ones(len(p), bool)
    head[1:] = (p[1:] != p[:-1]) | (w[1:] != w[:-1])
    inverse = np.empty(len(p), np.int64)
    inverse[order] = np.cumsum(head) - 1
    return p[head], w[head], inverse


def merged(tries: DataFrame, depth: int, least: int) -> DataFrame:
    """(lang, depth, h, f, lefts, word) of the nodes with a count of `least` or more; depth 0 has the number of words.

    `lefts` are the counts of the phrase's first 1, 2 and more words, null for a node that another range counts.
    """

    def merge(t: pa.Table) -> pa.Table:
        read = [read_piece(x.as_buffer().to_pybytes(), depth) for x in t["trie"]]
        out: list[pa.Table] = []
        lang = t["lang"][0].as_py()

        def rows(level: int, h: np.ndarray, f: np.ndarray, lefts: np.ndarray, names: list | None) -> None:
            n = len(f)
            lists = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel(), pa.int64(), mask=x.ravel() < 0 if x is lefts else None))
            out.append(pa.table({"lang": pa.array([lang] * n, pa.string()), "depth": pa.array([level] * n, pa.int32()), "h": lists(signed(h)), "f": pa.array(f), "lefts": lists(lefts), "word": pa.array(names or [None] * n, pa.string())}))

        node_of = [np.zeros(len(levels[0][0]), np.int64) for levels, _, _ in read]
        path, lefts = np.zeros((1, 0), np.uint64), np.zeros((1, 0), np.int64)
        for k in range(depth):
            word = np.concatenate([levels[k][0] for levels, _, _ in read])
            count = np.concatenate([levels[k][1] for levels, _, _ in read])
            parent = np.concatenate(node_of)
            live = parent >= 0
            p, w, inverse = _groups(parent[live], word[live])
            f = np.bincount(inverse, count[live], minlength=len(p)).astype(np.int64)
            if not k:
                rows(0, np.zeros((1, 0), np.uint64), np.array([f.sum()]), np.zeros((1, 0), np.int64), None)
                first = np.empty(len(p), np.int64)
                first[inverse[::-1]] = np.arange(len(inverse))[::-1]
                ends = [np.cumsum(size, dtype=np.int64) for _, size, _ in read]
                where = np.concatenate([[0], np.cumsum([len(x) for x in ends])])
            keep = (f == 0) | (f >= least)  # a count of 0: other ranges have it
            number = np.where(keep, np.cumsum(keep) - 1, -1)
            path, lefts = np.column_stack([path[p], w])[keep], np.column_stack([lefts[p], np.where(f == 0, -1, f)])[keep]
            f = f[keep]
            counted, names = f > 0, None
            if not k:
                names = []
                for i in first[keep][counted].tolist():
                    shard = int(np.searchsorted(where, i, "right")) - 1
                    end, size = int(ends[shard][i - where[shard]]), int(read[shard][1][i - where[shard]])
                    names.append(read[shard][2][end - size : end].decode())
            rows(k + 1, path[counted], f[counted], lefts[counted, :-1], names)
            if k + 1 < depth:
                node = np.full(len(parent), -1, np.int64)
                node[live] = number[inverse]
                sizes = np.cumsum([len(levels[k][0]) for levels, _, _ in read])[:-1]
                node_of = [np.repeat(x, levels[k][2]) for x, (levels, _, _) in zip(np.split(node, sizes), read, strict=True)]
        return pa.concat_tables(out)

    return tries.groupBy("part", "lang").applyInArrow(merge, "lang string, depth int, h array<long>, f long, lefts array<long>, word string")


def phrase_counts(docs: DataFrame, max_words: int = 3, least: int = 10) -> DataFrame:
    """The columns of `merged` for all phrases, each once, with the counts that other ranges hold filled in."""
    ranges = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text")
    nodes = materialize(merged(shards(d, max_words, prefix_bounds(d, max_words, ranges)), max_words, least))
    for j in range(1, max_words):
        missing = F.get("lefts", F.lit(j - 1)).isNull() & (F.col("depth") > j)
        wanted = nodes.where(missing).select("lang", F.slice("h", 1, j).alias("head")).distinct()
        heads = nodes.where(F.col("depth") == j).join(wanted, (nodes["lang"] == wanted["lang"]) & (F.col("h") == F.col("head")), "left_semi")
        heads = small(materialize(heads.select(F.col("lang").alias("head_lang"), F.col("h").alias("head"), F.col("f").alias("head_f"))), FEW)
        filled = F.expr(f"transform(lefts, (x, i) -> if(i = {j - 1}, coalesce(x, head_f), x))")
        nodes = nodes.join(heads, (F.col("lang") == F.col("head_lang")) & missing & (F.slice("h", 1, j) == F.col("head")), "left").withColumn("lefts", filled).drop("head_lang", "head", "head_f")
    return materialize(nodes)


def with_rights(nodes: DataFrame, max_words: int) -> DataFrame:
    """(lang, h, f, lefts, rights) of the phrases of 2 words and more; `rights` are the counts of all but the first 1, 2 and more words."""
    level = nodes.where("depth = 1").select("lang", "h", "f", F.array().cast("array<long>").alias("rights"))
    out = None
    for k in range(2, max_words + 1):
        suffix = level.select(F.col("lang").alias("of"), F.col("h").alias("suffix"), F.concat(F.array("f"), "rights").alias("rights"))
        own = nodes.where(F.col("depth") == k).select("lang", "h", "f", "lefts")
        level = materialize(own.join(small(suffix, FEW), (F.col("lang") == F.col("of")) & (F.slice("h", 2, k - 1) == F.col("suffix"))).select("lang", "h", "f", "lefts", "rights"))
        out = level if out is None else out.unionByName(level)
    return out


def collocations(docs: DataFrame, max_words: int = 3, least: int = 10, share: int = 50, top: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best `top` phrases of 2 to `max_words` words.

    a: the phrase's count, at least `least`; l, r: its parts' counts at the cut with the lowest score
    floor(10 ** 6 * a * a / (l * r)). A phrase that stands inside a longer one in `share` % of its places or more is left out.
    """
    nodes = phrase_counts(docs, max_words, least)
    found = with_rights(nodes, max_words)
    cut = F.expr("""array_min(transform(sequence(1, size(lefts)), j -> struct(
        (1000000BD * cast(f as decimal(16,0)) * cast(f as decimal(16,0))) div (cast(lefts[j - 1] as decimal(16,0)) * cast(rights[j - 1] as decimal(16,0))) as score, j, lefts[j - 1] as l, rights[j - 1] as r)))""")
    inside = [found.where(F.size("h") > 2).select("lang", F.slice("h", start, F.size("h") - 1).alias("h"), F.col("f").alias("longer")) for start in (1, 2)]
    longer = inside[0].unionByName(inside[1]).groupBy("lang", "h").agg(F.max("longer").alias("longer"))
    kept = found.join(longer, ["lang", "h"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("f")))
    kept = materialize(kept.withColumn("cut", cut).select("lang", "h", F.col("f").alias("a"), "cut.l", "cut.r", "cut.score"))
    first = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "h")
    last = kept.select("lang", "score", "a", "h").withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= top)
    last = small(materialize(last.groupBy("lang").agg(F.min(F.struct("score", "a")).alias("last"))), FEW)
    best = kept.join(last, "lang").where(F.struct("score", "a") >= F.col("last")).drop("last")  # with all ties
    words = small(nodes.where("depth = 1").select(F.col("lang").alias("of"), F.col("h")[0].alias("name"), "word"), FEW)
    for k in range(max_words):
        best = best.join(words, (F.col("lang") == F.col("of")) & (F.get("h", F.lit(k)) == F.col("name")), "left").drop("of", "name").withColumnRenamed("word", f"word{k}")
    best = best.withColumn("phrase", F.concat_ws(" ", *(f"word{k}" for k in range(max_words))))
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")).cast("long")).where(F.col("rank") <= top)
    n = small(materialize(nodes.where("depth = 0").groupBy("lang").agg(F.sum("f").alias("n"))), FEW)
    return ranked.join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
