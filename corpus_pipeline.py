"""Corpus pipeline: toxic documents go, repeated lines go, one document of each group of near
copies stays, documents with benchmark passages go, and the rest is packed into sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and
read again as the next stage's documents. All stages but the last keep the columns of
documents, with whatever extra columns there are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkvane.llm import common, decontam, linededup, nearcopies, packing, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxicity (operator 7): documents that score at the threshold or above are left out."""
    model = toxicity.fit(toxicity.training_rows(docs, common.read(spark, sf_dir, "labels", "doc_id", "toxic")))
    return toxicity.clean(docs, model)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup (operator 10): later repeated runs of lines are deleted from the texts."""
    return linededup.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-dedup (operator 5) at a similarity of 0.8 in shingles of five words: one document of
    each group stays. Fingerprints and BK-trees find the closest copies, a prefix filter the rest."""
    return nearcopies.deduplicate(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination (operator 9): documents that hold a benchmark window are left out."""
    return decontam.clean(docs, common.read(spark, sf_dir, "benchmark", "item_id", "text"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packing (operator 3): pieces of the documents' tokens in sequences."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("simhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("packing", pack),
]

#: Tokens of a vocabulary file, SimHash groups and a fitted score are beyond SQL; tests hold each
#: stage against a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
