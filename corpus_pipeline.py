"""A corpus from documents to packed sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; its
result is written as Parquet and read again. All but the last return the columns of
``documents``. Near duplicates are documents whose sets of five-word shingles have a
Jaccard similarity of 0.8 or more.

Defined cases. Null texts count as empty: they fail the base rules of the second stage, so
the later ones meet none in a run; by themselves exact dedup keeps one of all empty texts,
near duplicates all, and packing gives each a separator. Texts of any length are taken
whole. Of equal or near rows the one with the smallest doc_id stays, a null id last, and of
rows alike in id and text one. Toxicity keeps all rows where labels of one class are
missing, and the base rules alone decide then. An empty table gives no rows. Further
columns, whatever their names, are carried through all stages but the last.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from emrecon.llm import exact_dedup, jaccard_join, packing, quality_rules, toxicity
from emrecon.llm.common import cut, new_path


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, _labels(spark, sf_dir))


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs, _labels(spark, sf_dir))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_first(spark, docs, new_path(spark, "digest-index"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_one(docs, words=5, percent=80)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(packing.tokenize(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality_rules", drop_poor),
    ("exact_dedup", drop_copies),
    ("ngram_jaccard_join", drop_near_copies),
    ("best_fit_packing", pack),
]

#: Classifiers and BPE cannot be told in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name)
    return docs
