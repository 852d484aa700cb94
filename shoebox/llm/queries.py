"""Registered queries of the corpus operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoebox.llm import bpe, classifier, license, negatives, packing, resampling, rules, sharding, simhash, substring, suffixes, syncmers, warc
from shoebox.llm.common import documents

#: Shards of equal weight, and tokens of a sequence.
SHARDS, SEQUENCE = 24, 4096


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(documents(spark, sf_dir), [1.0] * SHARDS)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.op2(documents(spark, sf_dir))


def op3_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.scan(documents(spark, sf_dir))


def op4_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.compare(documents(spark, sf_dir))


def op5_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(documents(spark, sf_dir))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), SEQUENCE)


def op7_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op9_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.op11(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op13_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(documents(spark, sf_dir)).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_sharding, op2_simhash, op3_license, op4_syncmers, op5_rules, op6_packing, op7_substring, op8_warc, op9_classifier, op10_bpe, op11_negatives, op12_resampling, op13_suffixes)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op1_sharding": sharding.oracle(SHARDS), "op3_license": license.oracle(), "op8_warc": warc.oracle(), "op11_negatives": negatives.oracle(), "op12_resampling": resampling.oracle()}
