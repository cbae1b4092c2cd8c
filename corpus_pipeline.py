"""The document pipeline: classify, drop exact copies, keep one of similar texts, mix the sources, encode.

Every stage takes ``(spark, docs, sf_dir)``.  All but the last return the columns of the documents table.

Null texts count as empty, null ids and sources as values of their own; of rows that repeat id and text one stays after the
second stage; equal texts keep the longest original, then the smallest id; empty tables give empty results; further columns
are kept by all but the last stage, whatever their names.  Long texts are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendgrid.llm import exact_dedup, mixing, ngram_join, pieces, quality
from spendgrid.llm.shared import documents, stored

#: The mix of the pipeline: flatter than the sources are, with the least budget that passes every source once.
MIX_ENTROPY = 0.9


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one document stays."""
    return exact_dedup.drop_copies(docs)


def drop_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of a group of similar texts one document stays."""
    return ngram_join.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of small sources are taken more often; none is left out."""
    return mixing.mixed_documents(docs, budget=None, entropy=MIX_ENTROPY)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document."""
    rows = pieces.encoded(docs.select("doc_id", "source", "text"), pieces.read_model())
    return rows.select("doc_id", "source", F.col("_n_tokens").alias("n_tokens"), F.col("_round_trip").alias("round_trip"),
                       F.col("_parity").alias("parity"), F.col("_ids").alias("ids"))


STAGES = [("quality", keep_good), ("exact", drop_copies), ("similar", drop_similar), ("mix", mix_sources), ("encode", encode)]

#: Training, permutation and encoding have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what a stage returns is written and read again as the next one's documents."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
