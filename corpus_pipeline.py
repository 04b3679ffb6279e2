"""The corpus pipeline: each stage takes (spark, docs, sf_dir) and returns a DataFrame, the next one's docs.

Language ID, line dedup, near-dedup and mixing return the columns of documents; tokenising ends the pipeline and
returns each document's place in the mix beside its tokens.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.llm import byte_bpe, language_id, line_dedup, near_dedup, pfair_mix
from siftwell.llm.common import materialise


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; the model learns from the docs outside its held-out fold."""
    model = language_id.train(docs.where(~language_id.held_out()))
    return language_id.keep_identified(docs, model)


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the boilerplate lines of their source; n_chars follows the text. No document goes."""
    out = line_dedup.drop_boilerplate(docs).drop("_siftwell_lines", "_siftwell_dropped")
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: shingles of five words, similarity 0.8."""
    return near_dedup.keep_first(docs, words=5, threshold=0.8)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the sources' schedule."""
    return pfair_mix.in_mix_order(docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, slot and position in the sources' schedule, n_tokens and token_ids of every whole text.

    The schedule depends on the documents only, so these are the places of the mix stage, whose row order files do not keep.
    """
    placed = pfair_mix.with_places(docs.select("doc_id", "source", "text"))
    # written first, so that no sort is held while workers encode
    placed = materialise(placed.withColumnsRenamed({"_siftwell_slot": "slot", "_siftwell_position": "position"}), "pipeline-places")
    encoded = byte_bpe.encode(placed, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, out="ids", keep=("slot", "position"), kept=50_000)
    return encoded.select("doc_id", "slot", "position", "n_tokens", "token_ids")


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_common_lines),
    ("near_dedup", drop_near_copies),
    ("mix", mix_sources),
    ("byte_bpe", tokenise),
]

#: Language models, similarity classes and tokens are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each keeps is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
