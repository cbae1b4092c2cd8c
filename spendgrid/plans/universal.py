"""Categorise without training: label one representative per group, give the label to all members."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendgrid import fixed_values as fv
from spendgrid.functions import text as X
from spendgrid.operators.encoding import Encoder, char_encoder
from spendgrid.operators.grouping import SCOPE, clean_and_group, group_representatives
from spendgrid.plans.classify import valid_suggestions
from spendgrid.session import settled

Labeller = Callable[[DataFrame], DataFrame]


def predefined_categories(spark) -> DataFrame:
    """The thirteen category names, in order."""
    rows = [(i, name, name) for i, name in enumerate(fv.PREDEFINED_CATEGORIES)]
    return spark.createDataFrame(rows, "seq long, id string, name string")


def table_labeller(suggestions: DataFrame) -> Labeller:
    """A labeller that looks descriptions up in a table of ``description, suggested_category, seq``."""
    def label(representatives: DataFrame) -> DataFrame:
        return suggestions.join(representatives.select("description").distinct(), "description", "left_semi")

    return label


def batch_labeller(load: Callable[[], Callable[[list[dict]], list[dict]]], batch: int = fv.LABELLER_BATCH) -> Labeller:
    """A labeller around an external service: ``load`` runs once per task and returns a function from
    at most ``batch`` rows (description, amount, money_in) to answers (description, suggested_category)."""
    def label(representatives: DataFrame) -> DataFrame:
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ask = load()
            for frame in frames:
                for start in range(0, len(frame), batch):
                    part = frame.iloc[start:start + batch]
                    answers = pd.DataFrame(ask(part[["description", "amount", "money_in"]].to_dict("records")),
                                           columns=["description", "suggested_category"])
                    answers["seq"] = range(len(answers))
                    yield answers

        return representatives.select("description", "amount", "money_in").mapInPandas(
            run, "description string, suggested_category string, seq long")

    return label


def categorise(df: DataFrame, categories: DataFrame, labeller: Labeller, config: X.CleaningConfig = X.CleaningConfig(),
               encoder: Encoder = char_encoder, default: str = fv.DEFAULT_GROUP_CATEGORY, by: list[str] | None = None) -> DataFrame:
    """One result row per transaction; groups without a valid label get the default.

    ``by`` names the columns whose values are requests of their own: groups, representatives and sizes
    are each request's, and the labeller is asked about its representatives only.
    """
    wanted = dict.fromkeys([*(by or []), "tx_id", "seq", "description", "amount", "money_in"])
    rows = settled(lambda: clean_and_group(df.select(*wanted), "description", config, encoder, by)[0])
    representatives = settled(lambda: group_representatives(rows))
    labels = valid_suggestions(labeller(representatives), categories)
    labelled = representatives.join(labels, "description", "left").select(
        SCOPE, "representative", "group_size", F.coalesce("suggested_category", F.lit(default)).alias("predicted_category"))
    return rows.join(labelled, [SCOPE, "representative"]).select(
        "tx_id", F.col("description").alias("narrative"), F.col("cleaned").alias("cleaned_narrative"),
        "predicted_category", F.lit(1.0).alias("similarity_score"),
        F.lit(None).cast("string").alias("second_predicted_category"), F.lit(0.0).alias("second_similarity_score"),
        "money_in", "amount", F.col("representative").alias("group_representative"), F.lit(True).alias("llm_assisted"),
        "group_size")


def summary(results: DataFrame, categories: DataFrame) -> DataFrame:
    """Transactions, groups and categories offered."""
    groups = results.groupBy("group_representative").agg(F.count(F.lit(1)).alias("n"))
    counts = groups.agg(F.sum("n").alias("total_transactions"), F.count(F.lit(1)).alias("unique_groups"))
    offered = categories.agg(F.count_distinct("name").alias("categories_used"))
    return counts.join(F.broadcast(offered))  # one row each
