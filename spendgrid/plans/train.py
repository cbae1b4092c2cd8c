"""Train: labelled transactions of all users to one model table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendgrid import fixed_values as fv
from spendgrid.functions import text as X
from spendgrid.functions import vectors as V
from spendgrid.operators.cleaning import with_cleaned
from spendgrid.functions.amounts import int8_scale
from spendgrid.operators.encoding import Encoder, char_encoder, vector_side
from spendgrid.operators.ordered import dense_position
from spendgrid.operators.prepare import enough_rows, rejected_descriptions, too_few_rows, truncated, valid_descriptions
from spendgrid.session import cut_lineage, settled

TOO_FEW_ROWS = f"fewer than {fv.MIN_TRAINING_ROWS} rows of this user"
NO_CATEGORY = "no category"

def training_index(labelled: DataFrame, config: X.CleaningConfig = X.CleaningConfig()) -> DataFrame:
    """Cleaned descriptions, the first row of each kept, with dense item ids per user.

    Rows without a category are left out (they would otherwise be trained as a category of their own).
    The first row is an aggregate with partial combination, not a window over the copies.
    """
    valid = valid_descriptions(labelled).select("user_id", "seq", "description", "category")
    rows = settled(lambda: enough_rows(cut_lineage(valid)).where(F.col("category").isNotNull()))  # read for the texts and again
    cleaned = with_cleaned(rows, "description", config, "_cleaned").drop("description").withColumnRenamed("_cleaned", "description")
    first = cleaned.groupBy("user_id", "description").agg(
        F.min(F.struct("seq", "category")).alias("f"))
    first = first.select("user_id", F.col("f.seq").alias("seq"), "description", F.col("f.category").alias("category"))
    return dense_position(first, ["user_id"], ["seq", "description"], "item_id").select(
        "user_id", "item_id", "description", "category")


def training_rejects(labelled: DataFrame) -> DataFrame:
    """The rows that :func:`training_index` leaves out, each with the first reason that applies."""
    blank = rejected_descriptions(labelled)
    valid = valid_descriptions(labelled)
    few = too_few_rows(valid).withColumn("reject_reason", F.lit(TOO_FEW_ROWS))
    unlabelled = (enough_rows(valid).where(F.col("category").isNull())
                  .withColumn("reject_reason", F.lit(NO_CATEGORY)))
    return blank.unionByName(few).unionByName(unlabelled)


def index_copy(index: DataFrame) -> DataFrame:
    """The index as it is shown: texts shortened to the published lengths; models keep whole texts."""
    return index.withColumns({"description": truncated("description", fv.INDEX_DESCRIPTION),
                              "category": truncated("category", fv.INDEX_CATEGORY)})


def training_summary(labelled: DataFrame, index: DataFrame) -> DataFrame:
    """Rows given, unique descriptions and categories per user, and rows without a category."""
    given = labelled.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("category").isNull()).alias("rows_without_category"))
    unique = index.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("unique_descriptions"), F.count_distinct("category").alias("categories"))
    return given.join(unique, "user_id")


def train(labelled: DataFrame, encoder: Encoder = char_encoder, quantise: bool = True,
          config: X.CleaningConfig = X.CleaningConfig(), sparse: bool = False) -> DataFrame:
    """The model table: one row per user and unique cleaned description, with int8 codes and scale.

    With ``quantise=False`` the vectors are kept as they are.  The index and the vector of every text are written
    once: a scale needs the largest entry of a text alone, so vectors meet the index where codes are made and are not
    moved with it.  Every row of the index is kept, with the vector of its whole text.  ``sparse`` leaves vectors and
    codes in the form of :func:`V.sparse`, which scoring takes as well.
    """
    index = settled(lambda: training_index(labelled, config))
    vectors = cut_lineage(encoder(index.select("description").distinct(), "description", "vector"))
    side = vector_side(cut_lineage(V.as_sparse(vectors)) if sparse else vectors)
    if not quantise:
        return index.join(side, "description", "left").select("description", "user_id", "item_id", "category", "vector")
    largest = vectors.select("description", V.largest_magnitude("vector").alias("_largest"))
    scales = index.join(largest, "description", "left").groupBy("user_id").agg(int8_scale(F.max("_largest")).alias("scale"))
    return index.join(cut_lineage(scales), "user_id").join(side, "description", "left").select(
        "user_id", "description", "item_id", "category", "scale", (V.sparse_codes if sparse else V.codes)("vector", "scale").alias("codes"))


def model_vectors(model: DataFrame) -> DataFrame:
    """A stored model with its vectors restored."""
    if "codes" not in model.columns:
        return V.as_dense(model)
    return V.as_dense(model, "codes").withColumn("vector", V.dequantise()).drop("codes", "scale")


def sparse_vectors(model: DataFrame) -> DataFrame:
    """:func:`model_vectors` in the sparse form."""
    if "codes" not in model.columns:
        return V.as_sparse(model)
    packed = model.withColumn("vector", F.col("codes") if V.is_sparse(model, "codes") else V.sparse("codes"))
    value = F.transform("vector.value", lambda x: x.cast("double") * F.col("scale"))
    return packed.withColumn("vector", F.when(F.col("vector").isNotNull(), F.struct("vector.size", "vector.at", value.alias("value")))).drop("codes", "scale")
