"""Text encoders: the built-in character vectors and a hook for a learned model."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendgrid.functions import vectors as V
from spendgrid.session import cut_lineage

Encoder = Callable[[DataFrame, str, str], DataFrame]


def char_encoder(texts: DataFrame, column: str, output: str) -> DataFrame:
    """Character-frequency vectors, computed in the JVM."""
    return texts.withColumn(output, V.char_vector(column))


def batch_encoder(load: Callable[[], Callable[[list[str]], list]]) -> Encoder:
    """An encoder around a learned model.

    ``load`` runs once per Python worker and returns a function from a list of texts to a list of
    vectors; texts arrive in Arrow batches.
    """
    def encode(texts: DataFrame, column: str, output: str) -> DataFrame:
        @F.pandas_udf("array<double>")
        def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = load()
            for batch in batches:
                yield pd.Series([list(map(float, v)) for v in model(batch.tolist())])

        return texts.withColumn(output, vectors(F.col(column)))

    return encode


#: Numbers in the vectors of a side that may be broadcast (40 MB); compressed files would understate its size.
BROADCAST_NUMBERS = 5_000_000


def vector_side(vectors: DataFrame, vector: str = "vector") -> DataFrame:
    """Written vectors as a side to join by text: broadcast where their counted numbers are within the bound, else merged."""
    held = F.size(f"{vector}.at") * 2 if V.is_sparse(vectors, vector) else F.size(vector)
    numbers = vectors.agg(F.sum(F.greatest(held, F.lit(1)))).first()[0] or 0
    return F.broadcast(vectors) if numbers <= BROADCAST_NUMBERS else vectors.hint("merge")


def encode_sparse(df: DataFrame, column: str, encoder: Encoder = char_encoder, output: str = "vector") -> DataFrame:
    """:func:`encode_distinct` with the vectors of all texts written first, and joined in their sparse form."""
    vectors = cut_lineage(encoder(df.select(column).distinct(), column, output))
    packed = cut_lineage(vectors.select(column, V.sparse(output).alias(output)))
    return df.join(vector_side(packed, output), column, "left")


def encode_distinct(df: DataFrame, column: str, encoder: Encoder = char_encoder, output: str = "vector") -> DataFrame:
    """Encode every distinct text once and join the vectors back by text.

    A popular text makes a skewed join key; the vector side has one row per text, so the planner
    either broadcasts it by its measured size or splits the heavy partition at run time.
    """
    texts = df.select(column).distinct()
    return df.join(encoder(texts, column, output), column, "left")
