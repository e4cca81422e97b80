"""Corpus pipeline: documents through five of the training-data operators, in STAGES.

Each stage takes what its predecessor kept, and its decisions take effect.  All
but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from wattlane.llm import bpe, lines, mixing, ngram, quality
from wattlane.llm.common import cut

TOKENIZER = "word_bpe_49k.json"
#: The corpus should be clean text, and no document may be repeated: low and toxic tokens get no share.
WEIGHTS = {"clean": 1.0, "low": 0.0, "toxic": 0.0}


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents that the quality classifier rejects go."""
    return quality.keep_quality(docs, _labels(spark, sf_dir))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: later repeated runs of lines go; n_chars follows the text, and a document with no word left goes."""
    out = lines.dedup_lines(docs).where("text is null or n_removed = 0 or n_removed < n_lines")
    return out.selectExpr(*["case when n_removed > 0 then cast(char_length(text) as bigint) else n_chars end n_chars" if c == "n_chars" else f"`{c}`"
                            for c in docs.columns])


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: one document of each group of near duplicates stays."""
    return ngram.keep_one_of_each(docs)


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: documents stay as often as their rates say, here once or not at all."""
    return mixing.mixed(docs, _labels(spark, sf_dir), WEIGHTS, max_rate=1.0)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: token ids of every document."""
    return bpe.encode_rows(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("quality_classifier", keep_quality),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard_join", keep_one_of_each),
    ("mixing", mix_domains),
    ("bpe", encode),
]
#: The classifiers, MinHash and the tokenizer have no SQL form; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
