"""From raw documents to packed training sequences, in five stages."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracevale.llm import decontaminate, line_dedup, ngram_join, packing, quality_crf
from tracevale.llm._shared import materialize, table
from tracevale.llm.queries import learnable_labels


def _free(docs: DataFrame) -> str:
    """A column name that `docs` doesn't have."""
    return "_" * (1 + max(map(len, docs.columns)))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line model scores 0.3 or more.

    Null and empty texts are one empty line and go by its score; equal texts get equal scores; without labels of both kinds
    all documents stay. All columns stay as they are.
    """
    name = _free(docs)
    model = quality_crf.fit(docs, learnable_labels(spark, sf_dir))
    return quality_crf.score(docs, model, name).where(F.col(name) >= 0.3).drop(name)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their kept lines as text; lines that many documents share stay in the one with the largest doc_id.

    A null text becomes an empty one; a document that loses all its lines stays, empty; rows that share a doc_id are one
    document, and null ids are one document that sorts below all others. `n_chars`, if there, is that of the new text.
    """
    d = docs.select("doc_id", "text", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    kept = line_dedup.apply_keep(d, line_dedup.keep_bitmaps(d))
    text = F.col("line_dedup.kept")
    new = {"text": text, "n_chars": F.char_length(text).cast("long")}
    return kept.select(*(new.get(c, F.col("row")[c]).alias(c) for c in docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the smallest id; empty texts stay.

    A document is a doc_id and a text: of rows that share an id, or have none, with unlike texts each is judged for itself,
    and rows that are equal in both stay or go together. All columns stay as they are.
    """
    groups = ngram_join.near_duplicates(docs, shingle=5, percent=80)
    name = _free(docs)
    gone = groups.where(~F.col("kept")).select(F.struct("doc_id", "text_hash").alias(name)).distinct()
    d = docs.withColumn(name, F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash")))
    return d.join(gone, name, "left_anti").drop(name).select(*(f"`{c}`" for c in docs.columns))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark; texts without words stay. All columns stay as they are."""
    d = docs.select("doc_id", "text", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    return decontaminate.phrase_matches(d, table(spark, sf_dir, "benchmark")).where(F.size("leak.hit") == 0).select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences of 1024 tokens; a null or empty text is one piece, its end id."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), added=packing.added_tokens(public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [
    ("quality", keep_good),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]
#: No SQL says what a fitted model keeps or where best-fit decreasing puts a piece; tests/llm compare each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
