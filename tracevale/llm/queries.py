"""The operators' queries over the driver's tables: name -> (spark, sf_dir) -> DataFrame, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, decontaminate, html_extract, license_scan, line_dedup, minhash, ngram_join, packing, quality_crf, sql, substring_dedup, topk, warc, whitening
from ._shared import table


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.phrase_matches(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), window=10)
    n_hit = F.size("leak.hit").cast("long")
    return found.select(
        "doc_id", "leak.n_words", n_hit.alias("n_hit"), F.size("leak.item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("leak.item_ids", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), shingle=3, percent=90).select("doc_id", "n_shingles", "component_id", "n_links", "n_copies")


def op3_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 20 == 0, k=20, scale=64)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), window=20)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the ranks are the vocabulary of byte_bpe_50k.json and, with its added tokens, give the same ids
    added = packing.added_tokens(public_tokenizers.path("byte_bpe_50k.json"))
    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"), window=1024, end_id=0, added=added)


def learnable_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of the documents that a model may learn from: crc32 of the id as text, modulo 5, isn't 0."""
    return table(spark, sf_dir, "labels").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0).select("doc_id", "quality")


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality_crf.score(docs, quality_crf.fit(docs, learnable_labels(spark, sf_dir)))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))  # a document without an id isn't labelled
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = line_dedup.apply_keep(docs, line_dedup.keep_bitmaps(docs, min_chars=20, min_docs=3))
    return kept.select("doc_id", "line_dedup.n_lines", "line_dedup.n_dropped", F.sha2("line_dedup.kept", 256).alias("kept_sha256"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.round_trip(spark, table(spark, sf_dir, "pages").select("page_id", "url", "html"), least_bytes=0)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_texts(table(spark, sf_dir, "pages"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), shingle=4, percent=80)


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents").select("lang", "text"), max_words=3, least=10, share=50, top=2000)


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), scale=256, keep=4)


QUERIES = {f.__name__: f for f in (op1_decontamination, op2_ngram_jaccard_join, op3_top_k, op4_substring_dedup, op5_packing, op6_quality_classifier, op7_line_dedup, op8_warc, op9_html_extraction, op10_license_scan, op11_minhash, op12_phrase_collocations, op13_embedding_whitening)}
ORACLE_SQL = {"op1_decontamination": sql.DECONTAMINATION, "op2_ngram_jaccard_join": sql.near_duplicates(3, 90, counts=True), "op11_minhash": sql.near_duplicates(4, 80, kept=True), "op3_top_k": sql.TOP_K, "op4_substring_dedup": sql.SUBSTRING_DEDUP, "op7_line_dedup": sql.LINE_DEDUP, "op12_phrase_collocations": sql.COLLOCATIONS, "op9_html_extraction": sql.HTML_EXTRACTION, "op10_license_scan": sql.license_scan()}
