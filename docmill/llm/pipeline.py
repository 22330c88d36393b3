"""A pipeline that prepares a training corpus: each stage takes what its predecessor kept.

Toxic documents go; of near-duplicates one document stays; documents that hold benchmark items go; secrets in texts
give way to a mark; and the rest is mixed to the sources' target weights.

Defined cases: every stage takes empty tables, nulls in any column, repeated rows and columns of any names, and all but
the last give the columns that they take, ids as they are; what the operators say of such cases holds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.llm import decontamination, mixing, near_sets, secret_scan, toxicity
from docmill.llm.common import Tables


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose toxicity is under one half."""
    return toxicity.without_toxic(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates, texts that share four fifths of their five-word shingles: operator 9's
    fingerprints and trie find the nearest, checked exactly, and similar sets what is over the trie's budget."""
    return near_sets.one_of_each(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in which no benchmark item occurs."""
    return decontamination.without_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with marks in place of secrets."""
    return secret_scan.without_secrets(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) of the rows that the mix takes words of."""
    return mixing.mix(docs).filter(F.col("taken") > 0)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
]

#: No SQL: the classifier, similar sets, edit distances and entropies are beyond it; tests hold each stage to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's result over ``documents``; what a stage keeps is written to the shared checkpoint folder and goes
    once the next one's is there. The table that the result reads stays."""
    tables, docs = Tables(spark), spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        read = [*tables.paths]
        docs = tables.written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if read:
            tables.removed(*read)
    return STAGES[-1][1](spark, docs, sf_dir)
