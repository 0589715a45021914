"""Corpus pipeline: toxicity, near-duplicates, repeated passages, benchmark passages, token ids.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; all but the last
return the columns of documents. A document survives as it is unless a stage's own decision concerns it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from datelode.llm import bpe, decontaminate, simhash, suffix_dedup, toxicity
from datelode.llm.common import column, materialize, numbered


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine, trained on the labels of what is left, rejects go."""
    return toxicity.without_toxic(docs, _table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each SimHash component one row stays: that with the smallest doc_id or, where ids are null or repeated, the smallest row number."""
    rows, number = numbered(docs)
    groups = simhash.near_duplicates(rows.select(F.col(number).alias("doc_id"), "text"))
    first = groups.where("doc_id = component_id").select(F.col("doc_id").alias(number))
    return rows.join(first, number, "left_semi").select(*map(column, docs.columns))


#: Runs of as many words are cut out where they repeat.
PASSAGE_WORDS = 50


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of PASSAGE_WORDS words that start twice are cut out, all copies; what is left of a text stays, empty or not."""
    return suffix_dedup.removed(docs, by_words=PASSAGE_WORDS)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of benchmark phrases are cut out."""
    return decontaminate.decontaminated(docs, _table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, and their decoding: counts and digests."""
    import public_tokenizers

    return bpe.encode_decode(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("repeats", cut_repeats), ("benchmark", cut_benchmark), ("bpe", encode)]

#: Neither the models nor the hashes of the stages can be put in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs)
    return docs
