"""The registered queries of the corpus operators and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bin_completion, block_search, byte_bpe, collocations, hard_negatives, language_id, line_dedup, near_dedup, pfair_mix, quality_rules, substring_dedup, url_filter, warc
from .oracles import ORACLES

RULES = (
    url_filter.Rule("com", "/", "allow"),
    url_filter.Rule("example.com", "/en/", "block"),
    url_filter.Rule("www.example.com", "/en/", "allow"),
    url_filter.Rule("net", "/es/", "block"),
    url_filter.Rule("net", "/fr/", "block"),
)

#: Target weights of the mix: four sources by name, all others share the rest.
TARGETS, TARGET_REST = {"src0": 0.2, "src1": 0.15, "src2": 0.1, "src3": 0.05}, 0.5


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(substring_dedup.remove_repeats(_table(spark, sf_dir, "documents"), window=13))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.clean(_table(spark, sf_dir, "documents"), texts=False)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(_table(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.round_trip(_table(spark, sf_dir, "pages"), revisit_bytes=1000)
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_block_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_search.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op6_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pfair_mix.mix(_table(spark, sf_dir, "documents"), TARGETS, TARGET_REST)


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(_table(spark, sf_dir, "documents"), words=3, threshold=0.85)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(_table(spark, sf_dir, "documents"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.judge(_table(spark, sf_dir, "pages"), RULES, url_filter.train(spark))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode(
        _table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, out="digests"
    )


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.expr("case when vec_id % 7 = 0 then (label + 1) % 10 else label end")
    return hard_negatives.mine(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(_table(spark, sf_dir, "documents"))


def op13_bin_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bin_completion.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), capacity=2048)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_substring_dedup, op2_quality_rules, op3_language_id, op4_warc, op5_block_search, op6_pfair_mix, op7_near_dedup, op8_line_dedup,
        op9_url_filter, op10_byte_bpe, op11_hard_negatives, op12_collocations, op13_bin_completion,
    )
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
