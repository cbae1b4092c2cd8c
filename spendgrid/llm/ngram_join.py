"""N-gram Jaccard join by vertical partitioning.

A text is the set of its distinct runs of :data:`GRAM` words, lower-cased.  Shared runs are counted in ranges of run
hashes; a text whose shared runs are too few for any partner leaves.  The others order their runs globally, rarest
first, and the order is cut into fragments.  Candidates share a run of their first (rarest) runs; for a candidate pair
the overlaps of each fragment's segments are counted separately and summed per pair, which gives the exact similarity.

Groups of copies.  Texts with equal sets are one node.  Of the texts that share a rare run only the one with the
fewest unshared runs meets all others at first; what its links leave in different components is then compared pair by
pair, behind bounds on sizes, shared runs and segment sizes.  No link between different components is lost, and a group
of n copies costs about n comparisons.

Rows: a null, empty or blank text has the empty set, links with nothing and is its own component; texts with fewer
words than a run have one run, the whole text; repeated rows and equal texts share a component; the component is the
smallest id in it, null ids not counted (null where there is no other); an empty table gives an empty result; further
columns are ignored, and kept by :func:`one_of_each`.  Long texts are read whole.

Run hashes have 64 bits (48 within the global order); an overlap counts equal hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendgrid.llm.exchange import BLOCK_KEYS, RANGE_KEYS, part_of, repeated_hashes
from spendgrid.llm.shared import apart, discard, once_each, ship, small_side, stored, text_of
from spendgrid.llm.words import Words, chunks, joined, mixed
from spendgrid.operators.components import connected_components

GRAM = 5
SIMILARITY = 80  # per cent
FRAGMENTS = 16
_LOW48 = (1 << 48) - 1
_FIRST, _SECOND = np.uint64(0xA54FF53A5F1D36F1), np.uint64(0x510E527FADE682D1)


def gram_sets(data: np.ndarray, offsets: np.ndarray, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct run hashes of every text of a chunk, sorted within the text, and where each text's begin."""
    words = Words(data, offsets, lower=True)
    at, hashes = words.windows(gram)
    short = np.flatnonzero((words.counts > 0) & (words.counts < gram))
    if len(short):
        first, size = words.edges[short], words.counts[short]
        whole = mixed(size.astype(np.uint64))
        for k in range(gram - 1):
            own = size > k
            whole[own] = joined(whole[own], words.hash[first[own] + k])
        order = np.argsort(np.concatenate([at, first]), kind="stable")
        at, hashes = np.concatenate([at, first])[order], np.concatenate([hashes, whole])[order]
    edges = np.searchsorted(at, words.edges)
    for a, b in zip(edges, edges[1:]):
        hashes[a:b].sort()
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(edges))
    new = np.append(True, (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])) if len(hashes) else np.zeros(0, bool)
    counts = np.bincount(doc[new], minlength=len(offsets) - 1)
    return hashes[new], np.concatenate([[0], np.cumsum(counts)])


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    total = np.concatenate([[np.uint64(0)], np.cumsum(values)])
    return total[starts[1:]] - total[starts[:-1]]


def _digests(hashes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two digests of a set, from sums over its members."""
    return mixed(_sums(mixed(hashes ^ _FIRST), starts)), mixed(_sums(mixed(hashes ^ _SECOND), starts))


def _set_rows(gram: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offsets in chunks(batch.column("text")):
                hashes, starts = gram_sets(data, offsets, gram)
                node, second = _digests(hashes, starts)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column("doc_id").slice(first, len(offsets) - 1), "n_shingles": pa.array(np.diff(starts)),
                    "node": pa.array(node.view(np.int64)), "second": pa.array(second.view(np.int64))})
    return rows


def _runs(gram: int):
    def read(batch: pa.RecordBatch):
        for _, data, offsets in chunks(batch.column("text")):
            hashes, starts = gram_sets(data, offsets, gram)
            yield _digests(hashes, starts)[0], starts, hashes, np.zeros(len(hashes), bool)
    return read


def _all_sets(gram: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, offsets in chunks(batch.column("text")):
                hashes, starts = gram_sets(data, offsets, gram)
                node = _digests(hashes, starts)[0].view(np.int64)
                yield pa.RecordBatch.from_pydict({
                    "node": pa.array(node), "runs": pa.array([hashes[a:b].tobytes() for a, b in zip(starts, starts[1:])], pa.binary())})
    return rows


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of many sets in one row."""
    def out(nodes: list, runs: list) -> pa.RecordBatch:
        ids = np.array(nodes, np.int64)
        return pa.RecordBatch.from_pydict({
            "block": pa.array([int(mixed(ids.view(np.uint64)).sum(dtype=np.uint64).view(np.int64))]),
            "nodes": pa.array([ids.tobytes()], pa.binary()),
            "sizes": pa.array([np.array([len(r) // 8 for r in runs], "<u4").tobytes()], pa.binary()),
            "keys": pa.array([b"".join(runs)], pa.binary())})

    nodes, runs, size = [], [], 0
    for batch in batches:
        for node, run in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            nodes.append(node)
            runs.append(run)
            size += len(run) // 8
            if size >= BLOCK_KEYS // 4:
                yield out(nodes, runs)
                nodes, runs, size = [], [], 0
    if nodes:
        yield out(nodes, runs)


def _block_keys(parts: int):
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for block, blob in zip(batch["block"], batch["keys"]):
                keys, counts = np.unique(np.frombuffer(blob, "<u8"), return_counts=True)
                part = part_of(keys, parts)
                order = np.argsort(part, kind="stable")
                keys, counts, part = keys[order], counts[order], part[order]
                edges = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.zeros(0, np.int64)
                yield pd.DataFrame([(int(part[a]), block, keys[a:b].tobytes(), counts[a:b].astype("<u4").tobytes())
                                    for a, b in zip(edges, np.append(edges[1:], len(part)))],
                                   columns=["part", "block", "keys", "counts"])
    return rows


def _frequencies(group: pd.DataFrame) -> pd.DataFrame:
    """For every block of a range: its runs with the number of sets, over all blocks, that hold them."""
    keys = [np.frombuffer(k, "<u8") for k in group["keys"]]
    values, back = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(back, np.concatenate([np.frombuffer(c, "<u4") for c in group["counts"]]), len(values)).astype("<u4")
    ends = np.cumsum([len(k) for k in keys])
    found = [total[back[e - len(k):e]] for k, e in zip(keys, ends)]
    return pd.DataFrame({"block": group["block"].to_numpy(), "keys": [k[f > 1].tobytes() for k, f in zip(keys, found)],
                         "counts": [f[f > 1].tobytes() for f in found]})


_RANKED = "node long, n long, unshared long, ranks array<long>"


def _rank(block: pd.DataFrame, counted: pd.DataFrame) -> pd.DataFrame:
    """Sets of a block with their shared runs in the global order: by number of holders, then by hash."""
    if not len(block):
        return pd.DataFrame({"node": [], "n": [], "unshared": [], "ranks": []})
    keys = np.concatenate([np.frombuffer(k, "<u8") for k in counted["keys"]]) if len(counted) else np.zeros(0, np.uint64)
    often = np.concatenate([np.frombuffer(c, "<u4") for c in counted["counts"]]) if len(counted) else np.zeros(0, np.uint32)
    order = np.argsort(keys)
    keys, often = keys[order], often[order]
    out = []
    for nodes, sizes, blob in zip(block["nodes"], block["sizes"], block["keys"]):
        nodes, sizes, own = np.frombuffer(nodes, "<i8"), np.frombuffer(sizes, "<u4").astype(np.int64), np.frombuffer(blob, "<u8")
        at = np.minimum(np.searchsorted(keys, own), max(0, len(keys) - 1))
        shared = keys[at] == own if len(keys) else np.zeros(len(own), bool)
        rank = np.zeros(len(own), np.int64)
        rank[shared] = (np.minimum(often[at[shared]], 32767).astype(np.int64) << 48) | (own[shared] & np.uint64(_LOW48)).astype(np.int64)
        ends = np.cumsum(sizes)
        for node, n, e in zip(nodes, sizes, ends):
            mine = rank[e - n:e][shared[e - n:e]]
            if 100 * len(mine) >= SIMILARITY * n:
                mine.sort()
                out.append((node, n, n - len(mine), mine))
    return pd.DataFrame(out, columns=["node", "n", "unshared", "ranks"])


def _segments(pivots: np.ndarray):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ranks = batch.column("ranks")
            flat, starts = ranks.values.to_numpy(zero_copy_only=False), ranks.offsets.to_numpy()
            fragment = np.searchsorted(pivots, flat, "right")
            owner = np.repeat(np.arange(len(ranks)), np.diff(starts))
            flat, fragment = flat[starts[0]:starts[-1]], fragment[starts[0]:starts[-1]]
            if not len(flat):
                continue
            edges = np.flatnonzero(np.append(True, (fragment[1:] != fragment[:-1]) | (owner[1:] != owner[:-1])))
            yield pa.RecordBatch.from_arrays(
                [batch.column("node").take(pa.array(owner[edges])), pa.array(fragment[edges].astype(np.int32)),
                 pa.ListArray.from_arrays(pa.array(np.append(edges, len(flat)).astype(np.int32)), pa.array(flat))],
                names=["node", "fragment", "segment"])
    return rows


def _cut(ranked: DataFrame) -> np.ndarray:
    """Pivots that cut the global order into fragments of about equal numbers of entries."""
    marks = ranked.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(FRAGMENTS - 1)), lambda i: F.element_at(
        "ranks", (F.floor(F.size("ranks") * (i + 0.5) / FRAGMENTS) + 1).cast("int")))).alias("mark"))
    found = marks.agg(F.percentile_approx("mark", [i / FRAGMENTS for i in range(1, FRAGMENTS)], 1000)).first()[0]
    return np.array(sorted(set(found or [])), np.int64)


def _between(low: int | None, high: int | None):
    def inside(rank: Column) -> Column:
        return (F.lit(True) if low is None else rank >= low) & (F.lit(True) if high is None else rank < high)
    return inside


def _similar(pairs: DataFrame, ranked: DataFrame, segments: DataFrame) -> DataFrame:
    """The pairs ``(a, b)`` that link: overlaps of the fragments' segments, summed per pair."""
    left = segments.select(F.col("node").alias("a"), "fragment", F.col("segment").alias("left"))
    right = segments.select(F.col("node").alias("b"), "fragment", F.col("segment").alias("right"))
    partial = (pairs.join(left, "a").join(right, ["b", "fragment"])
               .select("a", "b", "n_a", "n_b", F.size(F.array_intersect("left", "right")).alias("partial")))
    return (partial.groupBy("a", "b", "n_a", "n_b").agg(F.sum("partial").alias("both"))
            .where(F.col("both") * 100 >= (F.col("n_a") + F.col("n_b") - F.col("both")) * SIMILARITY).select("a", "b"))


def _components(links: DataFrame) -> DataFrame:
    if links.limit(1).count() == 0:
        return links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return connected_components(links)


def _links(ranked: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Links between different sets that hold all components together."""
    pivots = _cut(ranked)
    segments = ranked.select("node", "ranks").mapInArrow(_segments(pivots), "node long, fragment int, segment array<long>")
    sizes = F.array(*[F.size(F.filter("ranks", _between(low, high)))
                      for low, high in zip([None, *pivots.tolist()], [*pivots.tolist(), None])])
    need = F.ceil(F.col("n") * SIMILARITY / 100)
    first = F.greatest(F.lit(0), F.col("n") - need + 1 - F.col("unshared")).cast("int")
    entries = ranked.select("node", "n", "unshared", F.explode(F.slice("ranks", 1, first)).alias("rank"))
    leaders = entries.groupBy("rank").agg(F.min(F.struct("unshared", "node", "n")).alias("lead"), F.count(F.lit(1)).alias("holders")).where("holders > 1")
    fitting = lambda x, y: F.least(x, y) * 100 >= F.greatest(x, y) * SIMILARITY
    pairs = (entries.join(leaders, "rank").where(F.col("node") != F.col("lead.node")).where(fitting(F.col("n"), F.col("lead.n")))
             .select(F.col("lead.node").alias("a"), F.col("node").alias("b"), F.col("lead.n").alias("n_a"), F.col("n").alias("n_b")).distinct())
    links = stored(_similar(pairs, ranked, segments), "shingle-links")
    components = stored(_components(links), "shingle-components")
    # What shares a rare run and lies in different components: all pairs that the bounds leave.
    labelled = (entries.join(components, "node", "left").withColumn("component", F.coalesce("component", "node"))
                .select("rank", "node", "n", "unshared", "component"))
    mixed_lists = labelled.groupBy("rank").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("rank")
    shared_rest = stored(labelled.join(mixed_lists, "rank", "left_semi"), "shingle-rest")
    vectors = ranked.select("node", sizes.alias("sizes")).join(shared_rest.select("node").distinct(), "node", "left_semi")
    rest = stored(shared_rest.join(vectors, "node"), "shingle-open")
    x, y = rest.alias("x"), rest.alias("y")
    least_both = (F.col("x.n") + F.col("y.n")) * SIMILARITY / (100 + SIMILARITY)
    most_both = F.least(F.col("x.n") - F.col("x.unshared"), F.col("y.n") - F.col("y.unshared"))
    by_segment = F.aggregate(F.zip_with("x.sizes", "y.sizes", lambda p, q: F.least(p, q)), F.lit(0), lambda s, v: s + v)
    close = (fitting(F.col("x.n"), F.col("y.n")) & (most_both >= least_both) & (by_segment >= least_both)
             & (F.col("x.component") != F.col("y.component")) & (F.col("x.node") < F.col("y.node")))
    others = (x.join(y, (F.col("x.rank") == F.col("y.rank")) & close)
              .select(F.col("x.node").alias("a"), F.col("y.node").alias("b"), F.col("x.n").alias("n_a"), F.col("y.n").alias("n_b")).distinct())
    return links.unionByName(_similar(others, ranked, segments)), [links, components, shared_rest, rest]


def similar_groups(docs: DataFrame, gram: int = GRAM) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_shingles, component_id``."""
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    sets = stored(rows.mapInArrow(_set_rows(gram), "doc_id long, n_shingles long, node long, second long"), "shingle-sets")
    parts = max(1, -(-sets.agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0] // RANGE_KEYS))
    texts = rows.select("text")
    shared = repeated_hashes(texts, _runs(gram), parts, short=True).select("node", (F.length("keys") / 8).alias("shared"))
    sizes = sets.groupBy("node").agg(F.max("n_shingles").alias("n"))
    left = stored(shared.join(sizes, "node").where(F.col("n") > 1).where(F.col("shared") * 100 >= F.col("n") * SIMILARITY)
                  .select("node", "n"), "shingle-shared")
    totals = left.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("n"), F.lit(0)).alias("runs")).first()
    if totals["rows"] == 0:
        labels = spark.createDataFrame([], "node long, component long")
    else:
        chosen = texts.mapInArrow(_all_sets(gram), "node long, runs binary").join(small_side(left.select("node"), totals["rows"]), "node", "left_semi")
        packed = stored(chosen.groupBy("node").agg(F.any_value("runs").alias("runs")).mapInArrow(
            _pack, "block long, nodes binary, sizes binary, keys binary"), "shingle-blocks")
        ranges = max(1, -(-totals["runs"] // RANGE_KEYS))
        counted = (packed.select("block", "keys").mapInPandas(_block_keys(ranges), "part long, block long, keys binary, counts binary")
                   .groupBy("part").applyInPandas(_frequencies, "block long, keys binary, counts binary"))
        ranked = stored(packed.groupBy("block").cogroup(counted.groupBy("block")).applyInPandas(_rank, _RANKED), "shingle-ranked")
        discard(left)
        discard(packed)
        if ranked.limit(1).count():
            links, used = _links(ranked)
            links = stored(links, "shingle-all-links")
            for table in used:
                discard(table)
            labels = stored(_components(links), "shingle-labels")
            discard(links)
        else:
            labels = spark.createDataFrame([], "node long, component long")
        discard(ranked)
    keyed = sets.join(labels, "node", "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "node").alias("key"),
        F.when(F.col("component").isNull(), F.col("second")).otherwise(F.lit(0)).alias("key2"))
    lowest = keyed.where("n_shingles > 0").groupBy("key", "key2").agg(F.min("doc_id").alias("lowest"))
    return keyed.join(lowest, ["key", "key2"], "left").select(
        "doc_id", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("lowest")).alias("component_id"))


@apart
def one_of_each(docs: DataFrame, gram: int = GRAM) -> DataFrame:
    """The rows of ``docs`` whose id is that of their component, with all their columns; of repeated rows one."""
    kept = (similar_groups(docs, gram).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
            .select(F.col("doc_id").alias("_id")).distinct())
    return once_each(docs.join(kept, F.col("doc_id").cast("long").eqNullSafe(F.col("_id")), "left_semi"), docs)
