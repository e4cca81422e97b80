"""Registered queries of the operators: thin digests of what the operators in this subpackage return."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattlane.llm import bpe, crosspolytope, infill, kmeanstree, lines, mixing, ngram, packing, periodic, quality, rlz, suffix, urls

TOKENIZER = "word_bpe_49k.json"
#: One vocabulary in the forms of two libraries.
PIECE_TOKENIZER, PIECE_RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Shares of a mix of as many tokens as the corpus has.
WEIGHTS = {"clean": 0.90, "low": 0.05, "toxic": 0.05}


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = mixing.mix(docs, labels, WEIGHTS, carry=False)
    return out.select("doc_id", F.col(mixing.N).alias("n_tokens"), *[F.col(p).alias(f"p_{d}") for p, d in zip(mixing.P, mixing.DOMAINS, strict=True)],
                      F.col(mixing.RATE).alias("rate"), F.col(mixing.COPIES).alias("copies"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op3_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.md5("text").alias("text_md5"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = quality.score_quality(docs.select("doc_id", "text"), quality.fit_quality(docs, labels))
    return scored.select(
        "doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op5_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rlz.removal_digests(table(spark, sf_dir, "documents"))


def op6_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.removal_digests(table(spark, sf_dir, "documents"))


def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, labels = table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")
    return urls.judge_urls(pages, urls.page_labels(pages, labels)).withColumn("purity", F.round("purity", 9))


def op10_ngram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram.near_duplicates(table(spark, sf_dir, "documents"))


def op8_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crosspolytope.near_vectors(table(spark, sf_dir, "embeddings"))


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmeanstree.nearest_vectors(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op11_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.run_digests(table(spark, sf_dir, "documents"), periodic.repeat_tail)


def op12_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.infill_digests(table(spark, sf_dir, "documents"))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECE_TOKENIZER), public_tokenizers.path(PIECE_RANKS))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_bpe": op2_bpe,
    "op3_lines": op3_lines,
    "op4_quality": op4_quality,
    "op5_substring": op5_substring,
    "op6_suffix": op6_suffix,
    "op7_urls": op7_urls,
    "op8_embedding": op8_embedding,
    "op9_neighbours": op9_neighbours,
    "op10_ngram": op10_ngram,
    "op11_periodic": op11_periodic,
    "op12_infill": op12_infill,
    "op13_packing": op13_packing,
}
ORACLE_SQL: dict[str, str] = {
    "op3_lines": lines.ORACLE_SQL,
    "op7_urls": urls.ORACLE_SQL,
}
