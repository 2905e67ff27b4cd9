"""A training corpus from raw documents: five stages, each over all that its
predecessor kept, written as Parquet in the shared checkpoint folder and read
again.

1. quality rules: failing lines go, then failing documents;
2. n-gram Jaccard join (5 words, 0.8): one document of each group stays;
3. suffix-array dedup: bytes of strings of 200 bytes that occur twice go, and
   documents without a word left;
4. mixing: sources to their target weights, documents repeated by epochs;
5. packing: sequences of at most 2048 tokens.

Null ids, null texts, repeated rows and empty tables pass through as the
operators define it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from synthlens.llm import mixing, ngram_join, packing, quality_rules, suffix_dedup
from synthlens.llm.common import WORD_PATTERN, table, written
from synthlens.llm.queries import MAX_EPOCHS, SOURCE_WEIGHTS, tokenizer_path


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.clean_documents(docs)


def ngram_join_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one(docs, n_words=5, percent=80)


def suffix_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(docs).where(F.col("text").rlike(WORD_PATTERN))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(docs, SOURCE_WEIGHTS, MAX_EPOCHS, carry=docs.columns)
    times = F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))).alias("_copy")
    return mixed.select("row", times).select("row.*")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [("quality_rules", quality_rules_stage), ("ngram_join", ngram_join_stage),
          ("suffix_dedup", suffix_dedup_stage), ("mixing", mixing_stage), ("packing", packing_stage)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
