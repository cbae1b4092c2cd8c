"""Classify: score transactions against their user's model, merge suggestions, pair transfers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendgrid import fixed_values as fv
from spendgrid.functions import text as X
from spendgrid.operators import neighbours as K
from spendgrid.operators.cleaning import with_cleaned
from spendgrid.operators.encoding import Encoder, char_encoder, encode_sparse
from spendgrid.operators.prepare import finite_amounts, valid_descriptions
from spendgrid.operators.transfers import pair_transfers
from spendgrid.plans.train import sparse_vectors
from spendgrid.session import cut_lineage, settled

WRONG_DIMENSION = "The vector does not have the length of the user's model."

def _owner(df: DataFrame) -> list[str]:
    """The user column where a table belongs to users, nothing where it holds for all."""
    return ["user_id"] if "user_id" in df.columns else []


def valid_suggestions(suggestions: DataFrame, categories: DataFrame) -> DataFrame:
    """One suggestion per description: the first, if it names a known category; "None" is no label.

    ``suggestions`` holds ``description``, ``suggested_category`` and ``seq``.  A ``user_id`` column in
    either table limits its rows to that user.
    """
    owner = _owner(suggestions)
    first = suggestions.groupBy(*owner, "description").agg(
        F.min(F.struct("seq", "suggested_category")).alias("f")).select(
        *owner, "description", F.col("f.suggested_category").alias("suggested_category"))
    known = categories.select(*_owner(categories), F.col("name").alias("suggested_category"))
    shared = [k for k in owner if k in known.columns]
    return (first.where(F.col("suggested_category") != "None")
            .join(known, [*shared, "suggested_category"], "left_semi"))


def last_category_ids(categories: DataFrame) -> DataFrame:
    """Name to id, the last entry of a repeated name winning; ``categories`` holds id, name and seq."""
    owner = _owner(categories)
    return categories.groupBy(*owner, "name").agg(F.max(F.struct("seq", "id")).alias("l")).select(
        *owner, "name", F.col("l.id").alias("id"))


def merge_suggestions(results: DataFrame, suggestions: DataFrame, categories: DataFrame) -> DataFrame:
    """Low-confidence rows take the id of a valid suggestion for their description; others stay.

    Suggestions and categories with a ``user_id`` count for that user alone.
    """
    ids = last_category_ids(categories).withColumnRenamed("name", "suggested_category")
    valid = valid_suggestions(suggestions, categories)
    shared = [k for k in _owner(valid) if k in ids.columns]
    usable = valid.join(ids, [*shared, "suggested_category"])
    owner = _owner(usable)
    usable = usable.select(*owner, F.col("description").alias("narrative"), F.col("id").alias("_suggested"))
    joined = results.join(usable, [*owner, "narrative"], "left")
    taken = F.col("is_low_confidence") & F.col("_suggested").isNotNull()
    return joined.withColumns({
        "llm_assisted": taken,
        "original_embedding_category": F.when(taken, F.col("predicted_category")),
        "original_similarity_score": F.when(taken, F.col("similarity_score")),
        "reason": F.when(taken, F.lit(fv.REASON_SUGGESTED)).otherwise(F.col("reason")),
        "predicted_category": F.when(taken, F.col("_suggested")).otherwise(F.col("predicted_category")),
    }).drop("_suggested")


def score(df: DataFrame, model: DataFrame, encoder: Encoder = char_encoder,
          config: X.CleaningConfig = X.CleaningConfig()) -> DataFrame:
    """Transactions with their two best categories and the confidence decision.

    Each distinct (user, cleaned text) is scored once; its result goes back to every transaction.
    Users without a model get ``Unknown`` with score 0; so do texts whose vector has not the length of
    their user's model, with a reason, so that one wrong model cannot fail the others.
    """
    rows = finite_amounts(valid_descriptions(df)).select(
        "tx_id", "user_id", "seq", F.col("description").alias("narrative"), "money_in", "amount")
    given = rows
    rows = settled(lambda: with_cleaned(cut_lineage(given), "narrative", config, "cleaned_narrative"))  # read for the texts and again
    texts = rows.select("user_id", F.col("cleaned_narrative").alias("text")).distinct()
    encoded = settled(lambda: encode_sparse(cut_lineage(texts), "text", encoder))  # compared and scored, encoded once
    vectors = settled(lambda: sparse_vectors(model.select("user_id", "item_id", "category", *(c for c in ("codes", "scale", "vector") if c in model.columns))))
    wrong = K.dimension_mismatch(encoded, vectors, row_id="text").select("user_id", "text")
    usable = encoded.join(wrong, ["user_id", "text"], "left_anti")
    found = K.nearest(usable, vectors, row_id="text")
    decided = K.confidence(K.pivot_neighbours(found, row_id="text"))
    misfits = wrong.select("user_id", "text", F.lit(False).alias("is_low_confidence"), F.lit(WRONG_DIMENSION).alias("reason"))
    decided = decided.unionByName(misfits, allowMissingColumns=True).withColumnRenamed("text", "cleaned_narrative")
    joined = rows.join(decided, ["user_id", "cleaned_narrative"], "left")
    return joined.select(
        "tx_id", "user_id", "seq", "narrative", "cleaned_narrative",
        F.coalesce("best_category", F.lit("Unknown")).alias("predicted_category"),
        F.coalesce("best_score", F.lit(0.0)).alias("similarity_score"),
        F.coalesce("second_category", F.lit("Unknown")).alias("second_predicted_category"),
        F.coalesce("second_score", F.lit(0.0)).alias("second_similarity_score"),
        "money_in", "amount", F.coalesce("is_low_confidence", F.lit(False)).alias("is_low_confidence"),
        "reason", "debug_info")


def classify(df: DataFrame, model: DataFrame, categories: DataFrame | None = None,
             suggestions: DataFrame | None = None, encoder: Encoder = char_encoder,
             config: X.CleaningConfig = X.CleaningConfig(), transfers: bool = True) -> DataFrame:
    """The whole job; one result row per valid transaction with nested adjustment and debug fields."""
    results = score(df, model, encoder, config)
    if suggestions is not None and categories is not None:
        results = merge_suggestions(results, suggestions, categories)
    else:
        results = results.withColumns({
            "llm_assisted": F.lit(False), "original_embedding_category": F.lit(None).cast("string"),
            "original_similarity_score": F.lit(None).cast("double")})
    if transfers:
        results = pair_transfers(cut_lineage(results))  # read twice there, scored once
    else:
        results = results.withColumns({
            "adjusted": F.lit(False), "original_category": F.lit(None).cast("string"),
            "transfer_detection_reason": F.lit(None).cast("string"), "matched_transfer_key": F.lit(None).cast("string")})
    adjustment = F.struct(
        "is_low_confidence", "reason", F.lit(False).alias("is_refund_candidate"), "llm_assisted",
        "original_embedding_category", "original_similarity_score", "adjusted", "original_category",
        "transfer_detection_reason", "matched_transfer_key", F.lit(None).cast("string").alias("group_representative"))
    return results.select(
        "tx_id", "user_id", "narrative", "cleaned_narrative", "predicted_category", "similarity_score",
        "second_predicted_category", "second_similarity_score", "money_in", "amount",
        adjustment.alias("adjustment_info"), "debug_info")
