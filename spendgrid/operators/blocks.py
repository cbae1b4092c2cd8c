"""All-against-all comparisons in bounded blocks.

A nearest-neighbour search compares every left row with every right row of its key.  The rows of a
pair are never joined into a pair row: both sides are cut into blocks of bounded size, each pair of
blocks becomes one group, and a matrix product inside the group keeps only the matches.  A key with a
third of all rows simply has more blocks, spread over all tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendgrid.session import ship_package

DEFAULT_BLOCK = 8192
TILE = 512
EVERYTHING = "_all"


def everything() -> Column:
    """The single key of a comparison of everything with everything."""
    return F.lit(0).alias(EVERYTHING)


def _blocked(df: DataFrame, key: str, row_id: str, block_rows: int, name: str) -> tuple[DataFrame, DataFrame]:
    """Rows with a block number, and the number of blocks per key."""
    blocks = df.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / F.lit(block_rows)).cast("int").alias(name))
    if key == EVERYTHING:
        blocks = F.broadcast(blocks)  # a single row
    number = F.pmod(F.xxhash64(row_id), F.col(name)).cast("int")
    return df.join(blocks, key).withColumn(f"_{name}", number).drop(name), blocks


def compare_blocks(left: DataFrame, right: DataFrame, key: str, left_id: str, right_id: str,
                   match: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str,
                   block_rows: int = DEFAULT_BLOCK, upper_only: bool = False, tile: int | None = TILE) -> DataFrame:
    """Run ``match`` on every pair of blocks with the same key and return what it emits.

    ``upper_only`` is for a table compared with itself: of two mirrored pairs of blocks one is run.
    ``match`` sees ``tile`` left rows at a time (all of the block for ``None``) next to the whole right
    block, so a matrix of scores has ``tile`` rows; what it emits must not depend on other left rows.
    """
    ship_package(left.sparkSession)
    left, left_blocks = _blocked(left, key, left_id, block_rows, "lb")
    right, right_blocks = _blocked(right, key, right_id, block_rows, "rb")

    def every(count: Column) -> Column:
        return F.explode(F.sequence(F.lit(0), count - 1))

    left = left.join(right_blocks, key).withColumn("_rb", every(F.col("rb"))).drop("rb")
    right = right.join(left_blocks, key).withColumn("_lb", every(F.col("lb"))).drop("lb")
    if upper_only:
        left, right = left.where("_lb <= _rb"), right.where("_lb <= _rb")

    right = right.toDF(*right.columns)  # columns of its own, also when both sides are one table

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if tile is None or len(a) <= tile:
            return match(a, b)
        return pd.concat([match(a.iloc[start:start + tile], b) for start in range(0, len(a), tile)])

    return (left.groupBy(key, "_lb", "_rb").cogroup(right.groupBy(key, "_lb", "_rb"))
            .applyInPandas(run, schema))


def whole_keys(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Batches of rows sorted by ``key`` as tables that end where a key ends; at most a batch and a key are held."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key)
        start = pc.index(keys, keys[-1]).as_py()  # rows from here on are of a key that may go on
        if start:
            yield pa.Table.from_batches([*held, batch.slice(0, start)])
            held = [batch.slice(start)]
        elif held and held[0].column(key)[0] != keys[-1]:
            yield pa.Table.from_batches(held)
            held = [batch]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def key_bounds(keys: pa.ChunkedArray) -> np.ndarray:
    """Where each key of a sorted column starts, and its end."""
    codes = keys.combine_chunks().dictionary_encode().indices.to_numpy()
    return np.concatenate([[0], np.flatnonzero(np.diff(codes)) + 1, [len(codes)]])


def dense_rows(vectors: pa.ChunkedArray) -> np.ndarray:
    """Sparse vectors as rows as long as the longest."""
    size, at, value = vectors.combine_chunks().flatten()
    out = np.zeros((len(size), pc.max(size).as_py()))
    rows = np.repeat(np.arange(len(size)), pc.list_value_length(at).to_numpy())
    out[rows, at.flatten().to_numpy()] = value.flatten().to_numpy(zero_copy_only=False)
    return out


def matrix(vectors: pd.Series) -> np.ndarray:
    return np.vstack(vectors.to_numpy()).astype(np.float64)


def unit_rows(m: np.ndarray) -> np.ndarray:
    norms = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return m / np.where(norms > 0, norms, 1.0)


def best_per_row(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column numbers of the k highest scores per row, ties by the lower id."""
    if scores.shape[1] > k:
        kth = -np.partition(-scores, k - 1, axis=1)[:, k - 1]
        rows, cols = np.nonzero(scores >= kth[:, None])
    else:
        rows, cols = np.nonzero(np.ones_like(scores, dtype=bool))
    order = np.lexsort((ids[cols], -scores[rows, cols], rows))
    rows, cols = rows[order], cols[order]
    starts = np.searchsorted(rows, np.arange(scores.shape[0]))
    keep = np.arange(len(rows)) - starts[rows] < k
    return rows[keep], cols[keep]
