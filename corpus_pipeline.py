"""A training-data pipeline over ``documents``: toxic texts go, one of each group of near copies stays, contaminated texts
go, personal data is replaced, and sources are mixed to target weights.

``ORACLE_SQL`` is None: a trained model, shingle components and a random field have no SQL. tests/llm checks the stages
against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetsight.llm import decontaminate, jaccard_join, mixing, pii, toxicity
from fleetsight.llm.stage import table, written

#: Target share of a source: its number of documents to this power, so that rare sources weigh more than by size alone.
TEMPER = 0.5


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model scores below one half."""
    model = toxicity.fit(toxicity.learnable(docs), table(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs, model)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies the document with the smallest id."""
    return jaccard_join.one_of_each(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark."""
    return decontaminate.keep_uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; n_chars follows the text."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that sources have their target weights in expectation, in random order."""
    weights = docs.groupBy("source").agg(F.pow(F.count("*"), F.lit(TEMPER)).alias("weight"))
    return mixing.mix(docs, weights=weights)


STAGES = [
    ("toxicity", without_toxic),
    ("ngram_jaccard_join", without_near_copies),
    ("benchmark_decontamination", without_benchmark),
    ("personal_data", without_personal_data),
    ("source_mixing", mixed_sources),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
