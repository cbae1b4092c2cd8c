"""Exact dedup with counting quotient filters.

Every partition builds a counting quotient filter of its fingerprints: a fingerprint is cut into a quotient, kept
as the place of a run, and a remainder, kept sorted within the run.  Filters of the same quotient slice merge
without loss by merging the sorted remainders and adding the counters.  Fingerprints counted more than once go to
byte verification, where whole normalised texts are compared.

Rows: a null text counts as empty and equals other empty texts; null ids sort after all others; of rows that repeat
id and text one stays; an empty table gives an empty result; further columns are ignored by the decisions and kept
by :func:`drop_copies`.  A very long text is one row of the verification like any other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendgrid.llm.shared import apart, once_each, ship, small_side, stored, text_of

QUOTIENT_BITS = 14  # quotients in a slice
SLICE_ROWS = 1 << 20  # fingerprints of a slice, about; the number of slices follows the number of rows
FINGERPRINTS_IN_MEMORY = 1 << 20


def normalised(name: str = "text") -> Column:
    """The text without white space."""
    return F.translate(text_of(name), " \t\n\x0b\x0c\r", "")


def build_filter(fingerprints: np.ndarray, counts: np.ndarray, bits: int) -> bytes:
    """A filter of sorted distinct fingerprints of one slice: occupied quotients, run ends, remainders of ``bits`` bits, counters."""
    shift = np.uint64(bits)
    quotients = ((fingerprints >> shift) & np.uint64((1 << QUOTIENT_BITS) - 1)).astype(np.int64)
    occupied = np.zeros(1 << QUOTIENT_BITS, bool)
    occupied[quotients] = True
    run_ends = np.append(quotients[1:] != quotients[:-1], True) if len(quotients) else np.zeros(0, bool)
    remainders = (fingerprints & ((np.uint64(1) << shift) - np.uint64(1))).astype("<u8").view(np.uint8).reshape(-1, 8)
    width = (bits + 7) // 8
    more = counts > 1
    return b"".join((np.int64(len(fingerprints)).tobytes(), np.packbits(occupied).tobytes(),
                     np.packbits(run_ends).tobytes(), remainders[:, :width].tobytes(), np.packbits(more).tobytes(),
                     counts[more].astype("<i8").tobytes()))


def read_filter(blob: bytes, part: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted fingerprints and counts of a filter."""
    n = int(np.frombuffer(blob, "<i8", 1)[0])
    width, flags, at = (bits + 7) // 8, (n + 7) // 8, 8
    occupied = np.unpackbits(np.frombuffer(blob, np.uint8, (1 << QUOTIENT_BITS) // 8, at)).astype(bool)
    at += (1 << QUOTIENT_BITS) // 8
    run_ends = np.unpackbits(np.frombuffer(blob, np.uint8, flags, at), count=n)
    at += flags
    wide = np.zeros((n, 8), np.uint8)
    wide[:, :width] = np.frombuffer(blob, np.uint8, n * width, at).reshape(n, width)
    at += n * width
    more = np.unpackbits(np.frombuffer(blob, np.uint8, flags, at), count=n).astype(bool)
    counts = np.ones(n, np.int64)
    counts[more] = np.frombuffer(blob, "<i8", int(more.sum()), at + flags)
    run = np.cumsum(run_ends) - run_ends
    quotients = np.flatnonzero(occupied).astype(np.uint64)[run] if n else np.zeros(0, np.uint64)
    high = (np.uint64(part) << np.uint64(QUOTIENT_BITS)) | quotients
    return (high << np.uint64(bits)) | wide.view("<u8").ravel(), counts


def merge_filters(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted remainders side by side, counters of equal ones added."""
    values = np.concatenate([v for v, _ in parts]) if parts else np.zeros(0, np.uint64)
    counts = np.concatenate([c for _, c in parts]) if parts else np.zeros(0, np.int64)
    order = np.argsort(values, kind="stable")
    values, counts = values[order], counts[order]
    first = np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.zeros(0, np.int64)
    return values[first], (np.add.reduceat(counts, first) if len(values) else counts)


def _slices(values: np.ndarray, counts: np.ndarray, bits: int) -> pd.DataFrame:
    part = values >> np.uint64(bits + QUOTIENT_BITS)
    starts = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
    rows = [(int(part[a]), build_filter(values[a:b], counts[a:b], bits))
            for a, b in zip(starts, np.append(starts[1:], len(part)))]
    return pd.DataFrame(rows, columns=["slice", "filter"])


def _build(batches: Iterator[pd.DataFrame], bits: int) -> Iterator[pd.DataFrame]:
    """One filter a slice and partition, or several where a partition holds more than fits in memory."""
    held, size = [], 0
    for batch in batches:
        values, counts = np.unique(batch["fp"].to_numpy(np.int64).view(np.uint64), return_counts=True)
        if not len(values):
            continue
        held, size = [*held, (values, counts)], size + len(values)
        if size >= FINGERPRINTS_IN_MEMORY:
            held = [merge_filters(held)]
            size = len(held[0][0])
            if size >= FINGERPRINTS_IN_MEMORY // 2:
                yield _slices(*held[0], bits)
                held, size = [], 0
    if held:
        yield _slices(*merge_filters(held), bits)


def _merge_by_remainder(group: pd.DataFrame, bits: int) -> pd.DataFrame:
    part = int(group["slice"].iloc[0])
    values, counts = merge_filters([read_filter(b, part, bits) for b in group["filter"]])
    often = counts > 1
    return pd.DataFrame({"fp": values[often].view(np.int64), "copies": counts[often]})


def filters(rows: DataFrame, bits: int) -> DataFrame:
    """``(slice, filter)`` of every partition of ``rows`` with a long column ``fp``."""
    ship(rows.sparkSession)
    return rows.select("fp").mapInPandas(lambda batches: _build(batches, bits), "slice long, filter binary")


def repeated_fingerprints(built: DataFrame, bits: int) -> DataFrame:
    """``(fp, copies)`` of fingerprints counted more than once over all filters."""
    return built.groupBy("slice").applyInPandas(lambda group: _merge_by_remainder(group, bits), "fp long, copies long")


def remainder_bits(rows: int) -> int:
    """Bits of a remainder: what the quotient and the slice leave of 64."""
    return 64 - QUOTIENT_BITS - max(6, (rows // SLICE_ROWS).bit_length())


def exact_copies(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Of equal texts the row with the most code points in the original text stays, then the smallest id.
    """
    rows = stored(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(normalised()).alias("fp"),
        F.length(text_of()).cast("long").alias("n_chars"), F.sha2(normalised(), 256).alias("text_sha256"),
    ).withColumn("row", F.monotonically_increasing_id()), "exact-rows")
    bits = remainder_bits(rows.count())
    repeated = stored(repeated_fingerprints(filters(rows, bits), bits), "exact-repeated")
    many = small_side(repeated.select("fp"), repeated.count())
    texts = docs.select(normalised().alias("normal")).withColumn("fp", F.xxhash64("normal"))
    confirmed = (texts.join(many, "fp", "left_semi").groupBy("fp", "normal").agg(F.count(F.lit(1)).alias("size"))
                 .groupBy("fp", F.sha2("normal", 256).alias("text_sha256"))
                 .agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("texts")).where("texts = 1 AND size > 1"))
    rank = F.struct("n_chars", F.col("doc_id").isNotNull().alias("named"), (-F.col("doc_id")).alias("low"),
                    (-F.col("row")).alias("first"))
    best = rows.join(many, "fp", "left_semi").groupBy("fp", "text_sha256").agg(F.max(rank).alias("best"))
    groups = confirmed.join(best, ["fp", "text_sha256"]).select(
        "fp", "text_sha256", "size", (-F.col("best.low")).alias("keep"), (-F.col("best.first")).alias("keep_row"))
    joined = rows.join(groups, ["fp", "text_sha256"], "left")
    grouped = F.col("size").isNotNull()
    return joined.select(
        "doc_id", F.when(grouped, F.col("keep")).otherwise(F.col("doc_id")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        (~grouped | (F.col("row") == F.col("keep_row"))).alias("kept"), "text_sha256")


@apart
def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; of rows that repeat id and text one stays."""
    found = exact_copies(docs).where("kept").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha"))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.sha2(normalised(), 256) == F.col("_sha"))
    return once_each(docs.join(found, same, "left_semi"), docs)
