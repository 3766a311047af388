"""Benchmark decontamination by a positional inverted index over the training documents.

Words are runs of letters, digits and non-ASCII characters, A-Z lower-cased. A window is `window` consecutive words of a
test item; an item of fewer words, but not none, is one window. The index holds, for terms of the test items, the ascending
positions in every document. A window's lists are shifted by the terms' offsets and intersected from the rarest term on,
rarity counted over all documents. The two rarest terms' lists are stored for all documents; lists of the other terms are
stored for the documents that those two leave, and intersected there. Only DataFrame functions are used.

Defined cases: null and empty texts have no words and never match; repeated documents are judged each for itself; items
that share an id count once; windows of an item whose id is null hit words but aren't listed; without items nothing is
hit. Other columns of the documents pass through, whatever their names, but one named `leak`, which is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import ascii_lower, box, materialize, small, unboxed

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Tables of terms, windows or documents of at most so many counted rows are broadcast; larger ones are shuffled.
BROADCAST_ROWS = 100_000


def words(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def document_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """What tells documents apart; a struct is never null, whatever is in it."""
    return F.struct(F.col(doc_id).alias("doc"), F.xxhash64(text).alias("text_hash"))


def tokenised(docs: DataFrame) -> DataFrame:
    """(key, words) of all documents, split once and written out."""
    return materialize(docs.select(document_key().alias("key"), words(F.col("text")).alias("words")))


def item_windows(items: DataFrame, window: int = 10) -> DataFrame:
    """(terms, item_ids): each distinct window and the items that hold it."""
    w = items.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0)
    n = F.least(F.size("w"), F.lit(window))
    w = w.select("item_id", "w", n.alias("n"), F.explode(F.sequence(F.lit(1), F.size("w") - n + 1)).alias("at"))
    return w.groupBy(F.slice("w", F.col("at"), F.col("n")).alias("terms")).agg(F.collect_set("item_id").alias("item_ids"))


def term_counts(tokens: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, n): occurrences over all documents of each term in the table `terms`.

    Few terms are picked out where they stand; of many, all words are counted first, so that no frequent one is shuffled row by row.
    """
    few, words_, n = small(terms, BROADCAST_ROWS), tokens.select(F.explode("words").alias("term")), F.count(F.lit(1)).alias("n")
    return words_.groupBy("term").agg(n).join(terms, "term") if few is terms else words_.join(few, "term").groupBy("term").agg(n)


def postings(tokens: DataFrame, terms: DataFrame) -> DataFrame:
    """The stored index: (term, key, positions ascending, from 0) for the terms in the table `terms`."""
    t = tokens.select("key", F.posexplode("words").alias("pos", "term")).join(small(terms, BROADCAST_ROWS), "term")
    return materialize(t.groupBy("term", "key").agg(F.sort_array(F.collect_set("pos")).alias("positions")))


def lists_of(tokens: DataFrame, keys: DataFrame, terms: DataFrame) -> DataFrame:
    """(key, lists): of each document in the table `keys` its postings, by term."""
    near = tokens.join(small(materialize(keys.distinct()), BROADCAST_ROWS), "key", "left_semi").dropDuplicates(["key"])
    t = near.select("key", F.posexplode("words").alias("pos", "term")).join(small(terms, BROADCAST_ROWS), "term")
    t = t.groupBy("key", "term").agg(F.sort_array(F.collect_list("pos")).alias("positions"))
    return t.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("term", "positions"))).alias("lists"))


def plan_windows(tokens: DataFrame, items: DataFrame, window: int = 10, percent: int = 100) -> DataFrame:
    """(id, terms, item_ids, rare): windows of whose terms at least `percent` in 100 occur in the documents; `rare` lists the offsets of the terms that do, rarest first."""
    w = materialize(item_windows(items, window).withColumn("id", F.sha2(F.array_join("terms", " "), 256)))
    at = w.select("id", F.posexplode("terms").alias("at", "term"))
    counts = materialize(term_counts(tokens, materialize(at.select("term").distinct())))
    rare = at.join(counts, "term", "left").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("n", "at"))).alias("rare"))
    rare = rare.withColumn("of", F.size("rare")).withColumn("rare", F.expr("filter(rare, r -> r.n is not null)"))
    rare = rare.where((100 * F.size("rare") >= percent * F.col("of")) & (F.size("rare") > 0))
    return materialize(w.join(rare.select("id", F.col("rare.at").alias("rare")), "id"))


def all_terms(windows: DataFrame) -> DataFrame:
    return materialize(windows.select(F.explode("terms").alias("term")).distinct())


def candidates(windows: DataFrame, index: DataFrame) -> DataFrame:
    """(id, key, starts): where the two rarest terms of a window stand as in the window."""
    small_windows = small(windows, BROADCAST_ROWS)

    def shifted(nth: int) -> DataFrame:
        w = small_windows.where(F.size("rare") > nth).select("id", F.expr(f"rare[{nth}]").alias("at"), F.expr(f"terms[rare[{nth}]]").alias("term"))
        return index.join(F.broadcast(w) if small_windows is not windows else w, "term").select("id", "key", F.expr("transform(positions, p -> p - at)").alias(f"starts{nth}"))

    one = shifted(0).join(windows.where(F.size("rare") == 1).select("id"), "id", "left_semi").withColumnRenamed("starts0", "starts")
    both = shifted(0).join(shifted(1), ["id", "key"])
    return one.unionByName(both.select("id", "key", F.array_intersect("starts0", "starts1").alias("starts"))).where(F.size("starts") > 0)


def phrase_matches(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """All rows and columns of `docs`, and a struct `leak`: n_words, hit (positions of hit words, from 0), item_ids."""
    tokens = tokenised(docs)
    windows = plan_windows(tokens, items, window)
    terms = materialize(windows.select(F.explode(F.expr("transform(slice(rare, 1, 2), r -> terms[r])")).alias("term")).distinct())
    found = materialize(candidates(windows, postings(tokens, terms)).join(windows.select("id", "terms", "item_ids", "rare"), "id"))
    found = found.join(lists_of(tokens, found.select("key"), all_terms(windows)), "key")
    # the lists of the third rarest term and so on, each shifted by its offset
    starts = F.expr("aggregate(slice(rare, 3, size(rare)), filter(starts, s -> s >= 0), (left, at) -> array_intersect(left, transform(coalesce(lists[terms[at]], array()), p -> p - at)))")
    exact = found.select("key", "item_ids", F.size("terms").alias("n"), starts.alias("starts")).where(F.size("starts") > 0)
    exact = exact.groupBy("key").agg(F.collect_list(F.struct("item_ids", "n", "starts")).alias("e"))
    hit = F.expr("array_sort(array_distinct(flatten(transform(e, f -> flatten(transform(f.starts, s -> sequence(s, s + f.n - 1)))))))")
    ids = F.expr("array_sort(array_distinct(flatten(transform(e, f -> transform(f.item_ids, i -> cast(i as string))))))")
    n_words = tokens.groupBy("key").agg(F.max(F.size("words").cast("long")).alias("n_words"))
    leak = n_words.join(exact.select("key", hit.alias("hit"), ids.alias("ids")), "key", "left")
    leak = leak.select("key", F.struct("n_words", F.coalesce("hit", F.array().cast("array<int>")).alias("hit"), F.coalesce("ids", F.array().cast("array<string>")).alias("item_ids")).alias("leak"))
    d = box(docs).withColumn("key", document_key("r.doc_id", "r.text")).join(leak, "key")
    return d.select(*unboxed(docs, "leak"), "leak")


def proximity_matches(docs: DataFrame, items: DataFrame, window: int = 10, slop: int = 3, percent: int = 80) -> DataFrame:
    """(doc, item_id, start): at least `percent` in 100 of a window's terms stand in a document within `slop` words of their places.

    Places are counted from `start`, at which one of the rarest terms stands exactly in its place. Where n terms may be
    missing, at least one of any n + 1 is there, so the n + 1 rarest give all starts. Every term's list is then looked at
    around its place. Terms in no document count as missing.
    """
    tokens = tokenised(docs)
    windows = plan_windows(tokens, items, window, percent)
    windows = windows.withColumn("least", F.expr(f"cast(ceil({percent} * size(terms) / 100) as int)"))
    # of the size(terms) - least + 1 rarest terms, those in no document are rarest
    anchors = F.expr("slice(rare, 1, size(rare) - greatest(least, 1) + 1)")
    anchored = materialize(windows.withColumn("at", F.explode(anchors)).withColumn("term", F.expr("terms[at]")))
    index = postings(tokens, materialize(anchored.select("term").distinct()))
    found = index.join(small(anchored, BROADCAST_ROWS), "term").select("id", "terms", "item_ids", "least", "key", F.explode(F.expr("transform(positions, p -> p - at)")).alias("start")).distinct()
    found = materialize(found)
    found = found.join(lists_of(tokens, found.select("key"), all_terms(windows)), "key")
    there = F.expr(f"size(filter(sequence(0, size(terms) - 1), k -> exists(coalesce(lists[terms[k]], array()), p -> abs(p - start - k) <= {slop})))")
    found = found.where(there >= F.greatest("least", F.lit(1)))
    return found.select("key.doc", F.explode("item_ids").alias("item_id"), "start").distinct()
