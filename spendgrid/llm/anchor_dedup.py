"""Substring dedup with fixed-block anchors, on words.

Non-overlapping blocks of :data:`ANCHOR` words of every text are the reference index; every rolling window of as many
words probes it.  A window of :data:`WINDOW` words holds a whole reference block wherever it begins, so each repeated
window shows a hit.  Hits are extended: the windows around them are compared by their own hashes, and overlapping
repeated windows join to maximal repeats, whose words are removed.

Rows: a null, empty or blank text has no words; texts shorter than a window lose nothing; equal texts of a window's
length or more lose everything; rows that repeat one another count as texts of their own; an empty table gives an empty
result; further columns are ignored.  Long texts are read whole.

Words and windows are compared by hashes of 64 bits that are not linear, texts by 64 bits made from their SHA-256; the
first probe uses fewer bits and only adds windows to compare.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendgrid.llm.exchange import RANGE_KEYS, repeated_hashes, short_keys, unpacked
from spendgrid.llm.shared import nodes_of, ship, small_side, stored, text_node, text_of
from spendgrid.llm.words import Words, chunks

WINDOW = 35
ANCHOR = (WINDOW + 1) // 2  # any window of 2 * ANCHOR - 1 words holds a whole block


def joined_words(words: Words, kept: np.ndarray) -> list[bytes]:
    """The kept words of every text, joined by one space."""
    data = words.data.copy()
    keep = np.zeros(len(data) + 1, np.int32)
    np.add.at(keep, words.starts[kept], 1)
    np.add.at(keep, words.ends[kept], -1)
    mask = np.cumsum(keep[:-1]) > 0 if len(data) else np.zeros(0, bool)
    chosen = np.flatnonzero(kept)
    inner = chosen[:-1][words.doc[chosen[:-1]] == words.doc[chosen[1:]]]
    data[words.ends[inner]] = 32
    mask[words.ends[inner]] = True
    sizes = np.add.reduceat(np.append(mask, False).astype(np.int64), np.minimum(words.offsets[:-1], len(data)))
    sizes[np.diff(words.offsets) == 0] = 0
    out, ends = data[mask].tobytes(), np.cumsum(sizes)
    return [out[e - n:e] for n, e in zip(sizes, ends)]


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, data, offsets in chunks(batch.column("text")):
            words = Words(data, offsets, lower=False)
            whole = joined_words(words, np.ones(len(words.hash), bool))
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id").slice(first, len(offsets) - 1), "node": batch.column("node").slice(first, len(offsets) - 1),
                "n_words": pa.array(words.counts), "whole_sha256": [hashlib.sha256(t).hexdigest() for t in whole]})


def _anchors(batch: pa.RecordBatch):
    """Rolling windows of a block's length; those of the reference index are marked."""
    nodes = nodes_of(batch)
    for first, data, offsets in chunks(batch.column("text")):
        words = Words(data, offsets, lower=False)
        at, hashes = words.windows(ANCHOR)
        marked = (at - words.edges[words.doc[at]]) % ANCHOR == 0
        yield nodes[first:first + len(offsets) - 1], np.searchsorted(at, words.edges), hashes, marked


def _around_hits(parts: int, window: int):
    """Windows that hold a hit."""
    def read(batch: pa.RecordBatch):
        keys, nodes = batch.column("keys").to_pylist(), nodes_of(batch)
        for first, data, offsets in chunks(batch.column("text")):
            words = Words(data, offsets, lower=False)
            at, hashes = words.windows(ANCHOR)
            short = short_keys(hashes, parts)
            hit = np.zeros(len(words.hash) + 1, np.int64)
            edges = np.searchsorted(at, words.edges)
            for i, (a, b) in enumerate(zip(edges, edges[1:])):
                own = at[a:b]
                hit[own[np.isin(short[a:b], unpacked(keys[first + i]))] + 1] = 1
            before = np.cumsum(hit)
            at, hashes = words.windows(window)
            near = before[at + window - ANCHOR + 1] > before[at]
            at, hashes = at[near], hashes[near]
            yield nodes[first:first + len(offsets) - 1], np.searchsorted(at, words.edges), hashes, np.zeros(len(at), bool)
    return read


def _remove(window: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("keys").to_pylist()
            for first, data, offsets in chunks(batch.column("text")):
                words = Words(data, offsets, lower=False)
                at, hashes = words.windows(window)
                edges = np.searchsorted(at, words.edges)
                cover = np.zeros(len(words.hash) + 1, np.int64)
                for i, (a, b) in enumerate(zip(edges, edges[1:])):
                    begin = at[a:b][np.isin(hashes[a:b], unpacked(keys[first + i]))]
                    cover[begin] += 1
                    np.subtract.at(cover, begin + window, 1)
                gone = np.cumsum(cover[:-1]) > 0
                kept = joined_words(words, ~gone)
                spans = []
                for a, b in zip(words.edges, words.edges[1:]):
                    steps = np.diff(np.concatenate([[0], gone[a:b].astype(np.int8), [0]]))
                    spans.append(np.stack([np.flatnonzero(steps == 1), np.flatnonzero(steps == -1)], axis=1).ravel())
                removed = np.add.reduceat(np.append(gone, False).astype(np.int64), np.minimum(words.edges[:-1], len(gone)))
                removed[words.counts == 0] = 0
                yield pa.RecordBatch.from_pydict({
                    "node": batch.column("node").slice(first, len(offsets) - 1), "n_removed": pa.array(removed),
                    "kept_sha256": [hashlib.sha256(t).hexdigest() for t in kept], "spans": pa.array(spans, pa.list_(pa.int64()))})
    return rows


def repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_words, n_removed, kept_sha256, spans``; spans are begins and ends of removed words."""
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    rows = rows.withColumn("node", text_node())
    described = stored(rows.mapInArrow(_describe, "doc_id long, node long, n_words long, whole_sha256 string"), "anchor-texts")
    texts = rows.select("node", "text")
    parts = max(1, -(-(described.agg(F.coalesce(F.sum("n_words"), F.lit(0))).first()[0]) // RANGE_KEYS))
    hits = stored(repeated_hashes(texts, _anchors, parts, short=True, only_marked=True), "anchor-hits")
    named = (texts.join(small_side(hits.select("node"), hits.count()), "node", "left_semi")
             .groupBy("node").agg(F.any_value("text").alias("text")))
    candidates = stored(named.join(hits, "node"), "anchor-candidates")
    found = stored(repeated_hashes(candidates, _around_hits(parts, window), parts), "anchor-repeats")
    removed = candidates.select("node", "text").join(found, "node").mapInArrow(
        _remove(window), "node long, n_removed long, kept_sha256 string, spans array<long>")
    copies = described.groupBy("node").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
    both = described.join(removed, "node", "left").join(copies, "node", "left")
    copied = F.col("copies").isNotNull() & (F.col("n_words") >= window)
    return both.select(
        "doc_id", "n_words", F.when(copied, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(copied, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha256", "whole_sha256")).alias("kept_sha256"),
        F.when(copied, F.array(F.lit(0).cast("long"), F.col("n_words"))).otherwise(F.coalesce("spans", F.array().cast("array<long>"))).alias("spans"))
