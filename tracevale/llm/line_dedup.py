"""Line dedup: range-partitioned line hashes, sorted by document and position, give each document a keep bitmap.

A line's key is the line without surrounding ASCII white space and with A-Z lower-cased. A key of at least `min_chars`
code points that is in at least `min_docs` documents keeps its lines in the largest doc_id only. Only DataFrame
functions are used. Lines are hashed once and written out; a key's documents are dealt to as many salts as the session has
shuffle partitions, in the count as in the join that follows, so that no frequent line is one task's work.

Defined cases: a null or empty text is one empty line. Rows that share a doc_id are one document; repeated rows get the
same bitmap, as a bitmap belongs to a doc_id and a text. A null doc_id is a document that sorts below all others. Other
columns of the input, whatever their names, pass through `apply_keep` untouched, but one named `line_dedup`, which is
replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import WHITE, ascii_lower, box, materialize, unboxed


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_hashes(docs: DataFrame, min_chars: int = 20) -> DataFrame:
    """(h1, h2, salt, doc, text_hash, pos) of every line that is long enough; h1 and h2 are 128 bits of its key."""
    salts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lines = docs.select(F.col("doc_id").alias("doc"), F.xxhash64("text").alias("text_hash"), F.posexplode(_lines(F.col("text"))).alias("pos", "line"))
    keys = lines.withColumn("key", F.trim(F.col("line"), F.lit(WHITE))).where(F.char_length("key") >= min_chars)
    key = ascii_lower(F.col("key"))
    salt = F.pmod(F.xxhash64("doc"), F.lit(salts)).cast("int")
    return materialize(keys.select(F.xxhash64(key).alias("h1"), F.xxhash64(F.concat(F.lit("\x01"), key)).alias("h2"), salt.alias("salt"), "doc", "text_hash", "pos"))


def repeated_keys(lines: DataFrame, min_docs: int = 3) -> DataFrame:
    """(h1, h2, salt, keeper): keys in at least `min_docs` documents, for each salt that they occur with, and the largest of these documents.

    Each range holds whole (key, salt) groups, sorted by document and position; the stream through it lets the first line
    of each of the first `min_docs` documents pass, so that few rows of a key are counted afterwards. Ranks count
    documents, however many lines of a key one document has.
    """
    ranged = lines.repartitionByRange("h1", "h2", "salt").sortWithinPartitions("h1", "h2", "salt", F.desc("doc"), "pos")
    group = Window.partitionBy("h1", "h2", "salt")
    nth, before = F.dense_rank().over(group.orderBy(F.desc("doc"))), F.lag(F.struct("doc")).over(group.orderBy(F.desc("doc"), "pos"))
    first = ranged.select("h1", "h2", "salt", "doc", nth.alias("nth"), before.alias("before"))
    first = first.where((F.col("nth") <= min_docs) & (F.col("before").isNull() | ~F.col("doc").eqNullSafe(F.col("before.doc"))))
    keys = first.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc").alias("keeper"), F.collect_set("salt").alias("salts")).where(F.col("n_docs") >= min_docs)
    return keys.select("h1", "h2", F.explode("salts").alias("salt"), "keeper")


def keep_bitmaps(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """(doc, text_hash, dropped) for the documents that lose lines.

    `dropped` has, in order, a (word, bits) struct for each 64 lines of which any go; a set bit is a line that goes.
    Words without a set bit aren't stored.
    """
    lines = line_hashes(docs, min_chars)
    gone = lines.join(repeated_keys(lines, min_docs), ["h1", "h2", "salt"]).where(~F.col("doc").eqNullSafe(F.col("keeper")))
    words = gone.groupBy("doc", "text_hash", F.expr("cast(pos div 64 as int)").alias("word")).agg(F.expr("bit_or(shiftleft(1L, pos % 64))").alias("bits"))
    return words.groupBy("doc", "text_hash").agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("dropped"))


def apply_keep(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """All rows and columns of `docs`, and a struct `line_dedup` of n_lines, n_dropped and the kept text."""
    b = bitmaps.select(F.struct("doc", "text_hash").alias("key"), "dropped")
    # the bitmap, one 64-bit word for each 64 lines up to the last that goes
    b = b.withColumn("of", F.map_from_entries("dropped")).withColumn("bits", F.expr("transform(sequence(0, element_at(dropped, -1).word), w -> coalesce(of[w], 0L))")).drop("of")
    d = box(docs).withColumn("key", F.struct(F.col("r.doc_id").alias("doc"), F.xxhash64("r.text").alias("text_hash")))
    d = d.join(b, "key", "left").withColumn("lines", _lines(F.col("r.text")))
    kept = F.expr("array_join(filter(lines, (l, i) -> coalesce(shiftright(get(bits, i div 64), i % 64) & 1, 0) = 0), '\n')")
    n_dropped = F.expr("coalesce(aggregate(dropped, 0L, (n, w) -> n + bit_count(w.bits)), 0L)")
    out = F.struct(F.size("lines").cast("long").alias("n_lines"), n_dropped.alias("n_dropped"), F.when(F.col("dropped").isNull(), F.coalesce("r.text", F.lit(""))).otherwise(kept).alias("kept"))
    return d.select(*unboxed(docs, "line_dedup"), out.alias("line_dedup"))
