"""A training corpus from raw documents: five stages, each an operator over all that the stage before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docflow.llm import jaccard, langid, mixing, packing, pii
from docflow.llm.common import stored
from docflow.llm.queries import mix_levels, tokenizer_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learn rank-order profiles from the labelled rows; texts without a language go, missing labels are filled."""
    got = langid.predict(docs, langid.learn(docs), names=("__lang_pred", "__score")).where("__lang_pred <> 'und'")
    return got.withColumn("lang", F.coalesce("lang", "__lang_pred")).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that the n-gram Jaccard join links at five words and similarity 0.8, the one with the smallest id stays."""
    return jaccard.deduplicated(docs, k=5, num=4, den=5)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span found, by form or by context, is replaced by its kind in brackets."""
    return pii.redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Nine tenths of the tokens, shared among sources by target weights; a document stands once for each epoch it is in."""
    levels, weights = mix_levels()
    return mixing.repeated(docs, levels, share=0.9, weights=weights, max_epochs=2, seed=17)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of several lengths."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("language_id", language),
    ("ngram_jaccard", near_copies),
    ("pii", personal_data),
    ("mixing", mixture),
    ("packing", packed),
]

#: tokenizer ids and rank-order profiles are beyond SQL; tests/llm holds the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
