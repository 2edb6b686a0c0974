"""A corpus from raw documents in five stages; each is written as Parquet and reread as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinloom.llm import decontaminate, langid, mixing, neardup, toxicity
from kinloom.llm.common import held_out, stored, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents whose language is undetermined."""
    return langid.keep_identified(docs, langid.fit(docs.where(~held_out(F.col("doc_id"), 3, 1))))


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that the machine, trained on labelled documents, calls toxic."""
    learn = ~held_out(F.col("doc_id"), 5, 0)
    return toxicity.keep_clean(docs, toxicity.fit(docs.where(learn), table(spark, sf_dir, "labels").where(learn)))


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group of near duplicates (five words, 0.8)."""
    return neardup.keep_first(docs)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes documents that hold the benchmark's passages."""
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds ``taken``, the words the mix takes of each document, and drops those of which it takes none."""
    return mixing.mix(docs)


STAGES = [
    ("language", identify_language),
    ("toxicity", remove_toxic),
    ("near_duplicates", remove_near_duplicates),
    ("decontamination", decontaminate_benchmark),
    ("mixing", mix_sources),
]

#: Trained stages have no SQL; tests/llm/test_pipeline.py checks each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stored(docs)
    return docs
