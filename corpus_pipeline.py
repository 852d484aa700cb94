"""The corpus pipeline: from ``documents`` to packed training sequences.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a
DataFrame, which is written as Parquet and read again as the next one's docs. All but
the last return the columns of documents; other columns of docs are ignored, repeated rows are
rows like others, and an empty table gives an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shoebox.llm import classifier, near, packing, rules, substring
from shoebox.llm.common import cut, documents

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _key() -> Column:
    """What tells a row from others of its doc_id; whole rows that are alike share it."""
    return F.xxhash64("doc_id", "text", "lang", "source").alias("key")


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` but for the rows of ``gone`` (doc_id, key), with or without a doc_id."""
    gone = gone.select(F.col("doc_id").alias("_doc"), F.col("key").alias("_key")).distinct()
    keyed = docs.select(*COLUMNS, _key())
    return keyed.join(gone, keyed["doc_id"].eqNullSafe(gone["_doc"]) & (keyed["key"] == gone["_key"]), "left_anti").select(*COLUMNS)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier takes for bad go. It learns from the labels of the documents at hand.

    Null and blank texts are scored as texts without words; where labels of one kind are missing every row stays.
    """
    model = classifier.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return classifier.scores(docs.select(*COLUMNS), model, keep=COLUMNS).where("score >= 0.5").select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the base rule or their source's fences reject go, null and blank texts among them; each row is judged by itself, whatever doc_id it has."""
    judged = rules.judge(docs.select(*COLUMNS, _key()), keep=("key",))
    return _without(docs, judged.where("not kept"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates - linked by similarities of 0.8 or more over shingles of five words - one row stays: that of the least doc_id, of several the one of least key.

    SimHash fingerprints that op2's trie self-join brings within three bits come first, settled on the whole sets; as most pairs
    at this similarity differ in more bits, an exact join finds the links that are left, so none is missing (``near``).
    Rows without a doc_id come last; null and blank texts are copies of each other.
    """
    rows = cut(near.near_classes(docs.select(*COLUMNS, _key()), keep=("key",)), "classes")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    first = rows.groupBy("root").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    placed = rows.join(first, "root").withColumn("gone", place != F.col("first"))
    kept = _without(docs, placed.where("gone"))
    # whole rows that are alike and stand for their group: they have a doc_id and a key in common
    alike = cut(placed.where("not gone").groupBy("doc_id", "key").count().where("count > 1").select("doc_id", "key"), "alike")
    if alike.isEmpty():
        return kept
    keyed = kept.select(*COLUMNS, _key())
    twice = alike.select(F.col("doc_id").alias("_doc"), F.col("key").alias("_key"))
    same = keyed["doc_id"].eqNullSafe(twice["_doc"]) & (keyed["key"] == twice["_key"])
    one = keyed.join(twice, same, "left_semi").dropDuplicates(["doc_id", "key"])
    return keyed.join(twice, same, "left_anti").unionByName(one).select(*COLUMNS)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that a document of smaller doc_id has go; a text that loses none stays as it is, a null text becomes empty."""
    left = substring.remove_repeats(docs, carry=("lang", "source"))
    return left.select("doc_id", "text", "lang", "source", F.length("text").cast("bigint").alias("n_chars"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every text with its sequence and its place there."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("best_fit_packing", best_fit_packing),
]

#: The quality classifier is trained, so SQL can't express the pipeline; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
