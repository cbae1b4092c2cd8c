"""Grouping of near-identical merchant names.

Input is one row per distinct name with ``name`` and ``first_seq`` (and ``vector`` for the cosine
methods), and optionally ``scope``: names of one scope, a user say, are grouped among themselves.
Output is ``scope, name, representative``.  The order of names is their first appearance, then the
name, so results do not depend on partitioning.

Names fall into *units* that cannot influence one another: a scope of bounded size, or a connected
component of names in reach within a larger scope.  Units of up to ``local`` names are settled whole,
several in a task (:mod:`linkage`).  Larger ones are compared by blocks: cosine comparisons are pruned
by pivot cells (:mod:`cells`), text ratios by an index of letter pairs (:mod:`text_index`), and neither
loses a pair in reach.  No pair rows are emitted for a crowd of similar names, and no crowd is gathered
in one place.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendgrid import fixed_values as fv
from spendgrid.functions import text as X
from spendgrid.functions import vectors as V
from spendgrid.operators import blocks as B
from spendgrid.operators import cells, linkage, text_index
from spendgrid.operators.cleaning import cleaned_names, with_cleaned
from spendgrid.operators.components import connected_components
from spendgrid.operators.encoding import Encoder, char_encoder, vector_side
from spendgrid.operators.ordered import dense_position, place
from spendgrid.session import cut_lineage, settled, ship_package

LOCAL_NAMES = 1024
DIGITS = linkage.DIGITS
SCOPE = "scope"


def scoped(names: DataFrame) -> DataFrame:
    """Names with a scope; without one they are all of the same."""
    return names if SCOPE in names.columns else names.withColumn(SCOPE, F.lit(""))


def with_positions(names: DataFrame) -> DataFrame:
    """Names with their position 0, 1, 2 ... by scope and first appearance, written once."""
    return place(scoped(names), [SCOPE, "first_seq", "name"], "pos")


def with_sizes(names: DataFrame) -> DataFrame:
    """Names with the size ``n`` of their scope and its first position ``unit``, if they have none yet."""
    if "unit" in names.columns:
        return names
    return names.join(names.groupBy(SCOPE).agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("unit")), SCOPE)


def with_vectors(names: DataFrame, vectors: DataFrame | None) -> DataFrame:
    """Names with the vectors of a side of their own, joined where they are read; names may hold them already."""
    return names if vectors is None else names.join(vectors, "name", "left")


# --- the two similarities ---------------------------------------------------------------------------------

def cosine_block(a: pd.DataFrame, b: pd.DataFrame, threshold: float) -> np.ndarray:
    return np.round(B.unit_rows(B.matrix(a["vector"])) @ B.unit_rows(B.matrix(b["vector"])).T, DIGITS)


def ratio_block(a: pd.DataFrame, b: pd.DataFrame, threshold: float) -> np.ndarray:
    """Text ratios; pairs that cannot reach the threshold stay 0."""
    return text_index.ratios(a["name"].tolist(), b["name"].tolist(), threshold)


def _cosine_keys(left: DataFrame, right: DataFrame, threshold: float, scope: str, half: bool) -> tuple[DataFrame, DataFrame]:
    return cells.keyed(left, right, threshold, scope, half)


def _ratio_keys(left: DataFrame, right: DataFrame, threshold: float, scope: str, half: bool) -> tuple[DataFrame, DataFrame]:
    return text_index.keyed(left, right, threshold, scope)


class Similarity:
    """How names are compared: scores of two blocks, the columns they need, and the keys under which names in reach meet."""

    def __init__(self, block: Callable, column: str, keys: Callable):
        self.block, self.columns, self.keys = block, ["pos", column], keys

    def held(self, rows: pa.Table | pd.DataFrame) -> np.ndarray | list[str]:
        """What is compared of some names: vectors of length one, or texts."""
        if self.block is cosine_block:
            return B.unit_rows(B.dense_rows(rows["vector"]) if isinstance(rows, pa.Table) else B.matrix(rows["vector"]))
        return rows["name"].to_pylist() if isinstance(rows, pa.Table) else rows["name"].tolist()

    def scores(self, held: np.ndarray | list[str], threshold: float) -> linkage.Scores:
        if self.block is cosine_block:
            return lambda i, j, k: np.round(held[i:j] @ held[:k].T, DIGITS)
        return lambda i, j, k: text_index.ratios(held[i:j], held[:k], threshold)


SIMILARITIES = {"cosine": Similarity(cosine_block, "vector", _cosine_keys), "ratio": Similarity(ratio_block, "name", _ratio_keys)}


def _compared(left: DataFrame, right: DataFrame, kind: str, threshold: float, scope: str, match: Callable, schema: str,
              block_rows: int, half: bool = False) -> DataFrame:
    """Run ``match`` on blocks of names that can be in reach of one another."""
    a, b = SIMILARITIES[kind].keys(left, right, threshold, scope, half)

    def run(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame() if x.empty or y.empty else match(x, y)

    return B.compare_blocks(a, b, cells.KEY, "pos", "pos", run, schema, block_rows)


def _forest(rows: np.ndarray, cols: np.ndarray, a: np.ndarray, b: np.ndarray, order: np.ndarray | None = None) -> pd.DataFrame:
    """A spanning forest of the given edges, taken in ``order``: the same components with at most one edge per node."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    kept = []
    for k in range(len(rows)) if order is None else order:
        i, j = a[rows[k]], b[cols[k]]
        x, y = find(i), find(j)
        if x != y:
            root[max(x, y)] = min(x, y)
            kept.append((i, j, k))
    return pd.DataFrame(kept, columns=["a", "b", "k"], dtype="int64")


def near_pairs(names: DataFrame, threshold: float, block_rows: int = B.DEFAULT_BLOCK) -> DataFrame:
    """Pairs (a < b) with cosine at least ``threshold``; the output is as large as the answer."""
    def pairs(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        scores = cosine_block(x, y, threshold)
        a, b = x["pos"].to_numpy(), y["pos"].to_numpy()
        same = x["_home"].to_numpy()[:, None] == y["_home"].to_numpy()[None, :]
        rows, cols = np.nonzero((scores >= threshold) & (~same | (a[:, None] < b[None, :])))
        return pd.DataFrame({"a": np.minimum(a[rows], b[cols]), "b": np.maximum(a[rows], b[cols]), "similarity": scores[rows, cols]})

    side = scoped(names).select("pos", "vector", SCOPE)
    left, right = cells.keyed(side, side, threshold, SCOPE, half=True)
    homes = cut_lineage(right.select("pos", F.col(cells.KEY).alias("_home")))
    left = left.join(homes, "pos", "left").withColumn("_home", F.coalesce("_home", F.lit("")))
    right = right.withColumn("_home", F.col(cells.KEY))
    return B.compare_blocks(left, right, cells.KEY, "pos", "pos",
                            lambda x, y: pd.DataFrame() if x.empty or y.empty else pairs(x, y), "a long, b long, similarity double", block_rows)


def near_forest(names: DataFrame, kind: str, threshold: float, scope: str = SCOPE, block_rows: int = B.DEFAULT_BLOCK,
                reaches: Callable[[pd.DataFrame, np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """``(a, b, similarity)``: edges among names in reach that connect whatever all such edges connect, at every level.

    Blocks report spanning forests of their closest edges, so a crowd of n similar names costs n edges a block pair, and
    edges of at least any similarity connect the same names as all pairs of that similarity do.
    """
    def forest(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        scores = SIMILARITIES[kind].block(x, y, threshold)
        a, b = x["pos"].to_numpy(), y["pos"].to_numpy()
        near = scores >= threshold if reaches is None else reaches(x, scores)
        rows, cols = np.nonzero(near & (a[:, None] != b[None, :]))
        found = _forest(rows, cols, a, b, np.argsort(-scores[rows, cols], kind="stable"))
        return pd.DataFrame({"a": np.minimum(found["a"], found["b"]), "b": np.maximum(found["a"], found["b"]),
                             "similarity": scores[rows, cols][found["k"]]})

    edges = _compared(names, names, kind, threshold, scope, forest, "a long, b long, similarity double", block_rows, half=True)
    return edges.groupBy("a", "b").agg(F.max("similarity").alias("similarity"))


# --- units ---------------------------------------------------------------------------------------------------

def with_units(names: DataFrame, kind: str, threshold: float, local: int, block_rows: int, vectors: DataFrame | None = None) -> DataFrame:
    """Names with ``unit`` and its size ``n``: small scopes whole, larger ones by connected names."""
    names = with_sizes(names)
    small = with_vectors(names.where(F.col("n") <= local), vectors)  # joined where it is read, not written with its vectors
    if names.where(F.col("n") > local).isEmpty():
        return small
    own = with_vectors(names.where(F.col("n") > local), vectors).drop("n", "unit")
    large = cut_lineage(V.as_dense(own) if "vector" in own.columns else own)
    found = connected_components(near_forest(large, kind, threshold, SCOPE, block_rows))
    joined = large.join(found.withColumnRenamed("node", "pos"), "pos", "left").withColumn("unit", F.coalesce("component", "pos")).drop("component")
    joined = joined.join(joined.groupBy("unit").agg(F.count(F.lit(1)).alias("n")), "unit")
    if "vector" in own.columns:
        small, joined = V.as_sparse(small), V.as_sparse(joined)
    return cut_lineage(small.unionByName(joined))


def _settled_whole(units: DataFrame, prepare: Callable[[pa.Table], object], solve: Callable[[object, int, int], np.ndarray],
                   columns: list[str], ids: str = "pos") -> DataFrame:
    """``(pos, rep)`` of units of bounded size, which pass through a task one after the other.

    ``prepare`` turns a table of whole units, each sorted, into what ``solve`` is given with the first row of a unit and
    its end; ``solve`` returns the number of every name's representative within the unit, or -1.
    """
    ship_package(units.sparkSession)
    alone = units.where(F.col("n") == 1).select(F.col(ids).alias("pos"), F.col(ids).alias("rep"))
    rows = units.where(F.col("n") > 1).select("unit", ids, *columns)
    rows = V.as_sparse(rows) if "vector" in columns else rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in B.whole_keys(batches, "unit"):
            pos, bounds, held = table[ids].to_numpy(), B.key_bounds(table["unit"]), prepare(table)
            reps = np.empty(len(pos), np.int64)
            for i, j in zip(bounds[:-1], bounds[1:]):
                rep = solve(held, i, j)
                reps[i:j] = np.where(rep >= 0, pos[i + np.maximum(rep, 0)], -1)
            yield pa.RecordBatch.from_arrays([pa.array(pos), pa.array(reps)], names=["pos", "rep"])

    return rows.repartition("unit").sortWithinPartitions("unit", ids).mapInArrow(run, "pos long, rep long").unionByName(alone)


def _named(names: DataFrame, settled: DataFrame) -> DataFrame:
    reps = names.select(F.col("pos").alias("rep"), F.col("name").alias("representative"))
    return names.select("pos", SCOPE, "name").join(settled, "pos").join(reps, "rep").select(SCOPE, "name", "representative")


# --- ordered rules -------------------------------------------------------------------------------------------

def leader_groups(names: DataFrame, threshold: float = fv.SIMILARITY_THRESHOLD, kind: str = "ratio",
                  block_rows: int = B.DEFAULT_BLOCK, local: int = LOCAL_NAMES) -> DataFrame:
    """Each name joins the most similar earlier canonical name in reach, else becomes canonical.

    In a large unit a name without an undecided earlier name in reach is canonical, and what it reaches
    later is not: each step decides all such names at once, so the number of steps follows the longest
    chain of names in reach of one another, not their number.  Then every name looks for its best
    canonical name.
    """
    names = scoped(names)
    similarity = SIMILARITIES[kind]
    column = similarity.columns[1]
    units = with_units(names, kind, threshold, local, block_rows)
    whole = _settled_whole(units.where(F.col("n") <= local), similarity.held,
                           lambda held, i, j: linkage.leaders(j - i, similarity.scores(held[i:j], threshold), threshold), [column])
    large = units.where(F.col("n") > local).select("pos", column, "unit")
    large = cut_lineage(V.as_dense(large) if column == "vector" else large)
    if large.isEmpty():
        return _named(names, whole)

    def earlier(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("pos")
        own, others = a["pos"].to_numpy(), b["pos"].to_numpy()
        scores = np.where(others[None, :] < own[:, None], similarity.block(a, b, threshold), -1.0)
        j = scores.argmax(axis=1)
        found = pd.DataFrame({"pos": own, "rep": others[j], "score": scores[np.arange(len(own)), j]})
        return found[found["score"] >= threshold]

    def reached(left: DataFrame, right: DataFrame) -> DataFrame:
        """The best earlier name of ``right`` for every name of ``left`` that has one in reach."""
        found = cut_lineage(_compared(left, right, kind, threshold, "unit", earlier, "pos long, rep long, score double", block_rows))
        best = found.groupBy("pos").agg(F.max("score").alias("score"))
        return found.join(best, ["pos", "score"]).groupBy("pos").agg(F.min("rep").alias("rep"))

    undecided, canonical = large, None
    while True:
        now = cut_lineage(undecided.join(reached(undecided, undecided).select("pos"), "pos", "left_anti"))
        canonical = now if canonical is None else canonical.unionByName(now)
        rest = undecided.join(now.select("pos"), "pos", "left_anti")
        undecided = cut_lineage(rest.join(reached(rest, now).select("pos"), "pos", "left_anti"))
        if undecided.isEmpty():
            break
    joined = large.select("pos").join(reached(large, cut_lineage(canonical)), "pos", "left")
    return _named(names, whole.unionByName(joined.select("pos", F.coalesce("rep", "pos").alias("rep"))))


def complete_link_groups(names: DataFrame, threshold: float = fv.SIMILARITY_THRESHOLD, kind: str = "cosine",
                         block_rows: int = B.DEFAULT_BLOCK, local: int = LOCAL_NAMES, vectors: DataFrame | None = None) -> DataFrame:
    """Each name joins the group all of whose members are in reach, the closest such group first.

    A large unit advances by its earliest ``local`` unsettled names a round, all large units at once: a
    round's names meet the members settled before in blocks, which report the groups in reach with their
    least score and how many members that is; a group counts if these are all.  The round's names of a
    unit are then settled together.
    """
    names = scoped(names)
    similarity = SIMILARITIES[kind]
    column = similarity.columns[1]
    units = with_units(names, kind, threshold, local, block_rows, vectors)
    whole = _settled_whole(units.where(F.col("n") <= local), similarity.held, lambda held, i, j: linkage.complete_link(
        j - i, similarity.scores(held[i:j], threshold), threshold), [column])
    large = units.where(F.col("n") > local).select("pos", column, "unit")
    if large.isEmpty():
        return _named(names, whole)
    large = V.as_dense(large) if column == "vector" else large
    large = cut_lineage(dense_position(large, ["unit"], ["pos"], "_number").withColumn("round", F.floor(F.col("_number") / local).cast("int")).drop("_number"))

    def reach(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        scores = similarity.block(a, b, threshold)
        rows, cols = np.nonzero(scores >= threshold)
        return pd.DataFrame({"pos": a["pos"].to_numpy()[rows], "member": b["pos"].to_numpy()[cols], "rep": b["rep"].to_numpy()[cols],
                             "score": scores[rows, cols]}).groupby(["pos", "rep"], as_index=False).agg(
            score=("score", "min"), near=("member", "nunique"))

    def settle(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        a = a.sort_values("pos").reset_index(drop=True)
        groups: dict[int, dict[int, float]] = {}
        for pos, rep, score in zip(b["pos"], b["rep"], b["score"]):
            groups.setdefault(pos, {})[rep] = score
        before = [groups.get(p, {}) for p in a["pos"]]
        return pd.DataFrame({"pos": a["pos"], "rep": linkage.complete_link(len(a), similarity.scores(similarity.held(a), threshold), threshold, before, a["pos"].to_numpy())})

    settled = None
    for number in range(large.agg(F.max("round")).first()[0] + 1):
        now = large.where(F.col("round") == number).drop("round")
        if settled is None:
            before = now.select("unit", "pos", F.col("pos").alias("rep"), F.lit(0.0).alias("score")).limit(0)
        else:
            members = large.drop("round").join(settled, "pos")
            found = cut_lineage(_reached_members(now, members, kind, threshold, reach, block_rows))
            sizes = settled.groupBy("rep").agg(F.count(F.lit(1)).alias("size"))
            before = (found.join(sizes, "rep").where(F.col("near") == F.col("size"))
                      .join(now.select("pos", "unit"), "pos").select("unit", "pos", "rep", "score"))
        before = before.toDF(*before.columns)  # columns of its own
        part = now.groupBy("unit").cogroup(before.groupBy("unit")).applyInPandas(settle, "pos long, rep long")
        settled = cut_lineage(part if settled is None else settled.unionByName(part))
    return _named(names, whole.unionByName(settled))


def _reached_members(now: DataFrame, members: DataFrame, kind: str, threshold: float, reach: Callable, block_rows: int) -> DataFrame:
    """Groups in reach of each name: least score, and members in reach, each counted once."""
    if kind == "cosine":  # a pair meets once
        found = _compared(now, members, kind, threshold, "unit", reach, "pos long, rep long, score double, near long", block_rows)
        return found.groupBy("pos", "rep").agg(F.min("score").alias("score"), F.sum("near").alias("near"))

    def pairs(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        scores = SIMILARITIES[kind].block(a, b, threshold)
        rows, cols = np.nonzero(scores >= threshold)
        return pd.DataFrame({"pos": a["pos"].to_numpy()[rows], "member": b["pos"].to_numpy()[cols], "rep": b["rep"].to_numpy()[cols], "score": scores[rows, cols]})

    found = _compared(now, members, kind, threshold, "unit", pairs, "pos long, member long, rep long, score double", block_rows)
    found = found.groupBy("pos", "member", "rep").agg(F.min("score").alias("score"))
    return found.groupBy("pos", "rep").agg(F.min("score").alias("score"), F.count(F.lit(1)).alias("near"))


def batched_groups(names: DataFrame, threshold: float = fv.SIMILARITY_THRESHOLD, batch: int = fv.GROUPING_BATCH,
                   block_rows: int = B.DEFAULT_BLOCK, local: int = LOCAL_NAMES) -> DataFrame:
    """Complete-link groups within batches of names, then their representatives merged as leaders.

    The batches are independent of each other; only the merge of representatives is ordered.
    """
    names = scoped(names)
    first = names.groupBy(SCOPE).agg(F.min("pos").alias("_first"))
    units = names.join(first, SCOPE).withColumn("unit", F.col("_first") + F.floor((F.col("pos") - F.col("_first")) / batch).cast("long") * batch)
    similarity = SIMILARITIES["cosine"]
    found = cut_lineage(_settled_whole(units.withColumn("n", F.lit(batch)), similarity.held, lambda held, i, j: linkage.complete_link(
        j - i, similarity.scores(held[i:j], threshold), threshold), ["vector"]))
    reps = names.drop("n", "unit").join(found.where(F.col("pos") == F.col("rep")).select("pos"), "pos", "left_semi")
    merged = leader_groups(reps, threshold, "cosine", block_rows, local).withColumnRenamed("name", "_own")
    own = names.select(F.col("pos").alias("rep"), F.col("name").alias("_own"))
    return (names.select("pos", SCOPE, "name").join(found, "pos").join(own, "rep")
            .join(merged, [SCOPE, "_own"]).select(SCOPE, "name", "representative"))


# --- methods on the similarity graph ---------------------------------------------------------------------------

def groups_from_labels(labelled: DataFrame) -> DataFrame:
    """The first name of a label represents it; label -1 is noise and represents itself."""
    labelled = scoped(labelled)
    first = labelled.where(F.col("label") != -1).groupBy("label").agg(F.min("pos").alias("_first"))
    named = first.join(labelled.select(F.col("pos").alias("_first"), F.col("name").alias("_name")), "_first").select("label", "_name")
    joined = labelled.join(named, "label", "left")
    return joined.select(SCOPE, "name", F.when(F.col("label") == -1, F.col("name")).otherwise(F.col("_name")).alias("representative"))


def adaptive_eps(eps: float, n: Column, least: float = fv.DBSCAN_LEAST_EPS) -> Column:
    """The distance shrinks with the number of names, down to a least value and above it at most ``eps``."""
    by_size = F.lit(fv.DBSCAN_EPS_AT_ZERO) - n / 1000 * fv.DBSCAN_EPS_PER_THOUSAND
    return F.greatest(F.lit(float(least)), F.least(F.lit(float(eps)), by_size))


def density_groups(names: DataFrame, eps: float = fv.DBSCAN_EPS, min_samples: int = fv.DBSCAN_MIN_SAMPLES,
                   block_rows: int = B.DEFAULT_BLOCK, local: int = LOCAL_NAMES, eps_by_size: Column | None = None,
                   vectors: DataFrame | None = None) -> DataFrame:
    """Density clusters on cosine distance; noise names stand for themselves.

    ``eps_by_size`` makes the distance a function of ``n``, the names of a scope, at most ``eps``.  With
    two samples a cluster is a connected component; otherwise core names are connected and border names
    take the earliest cluster with a core name in reach.
    """
    names = scoped(names)
    held = with_sizes(names).withColumn("eps", F.lit(float(eps)) if eps_by_size is None else eps_by_size)
    similarity = SIMILARITIES["cosine"]

    def prepare(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        return similarity.held(table), table["eps"].to_numpy()

    def whole(unit: tuple[np.ndarray, np.ndarray], i: int, j: int) -> np.ndarray:
        rows, own = unit[0][i:j], float(unit[1][i])
        return linkage.density(j - i, similarity.scores(rows, 1.0 - own), own, min_samples)

    small = held.where(F.col("n") <= local).withColumn("n", F.greatest("n", F.lit(2)))  # one name may be noise
    found = _settled_whole(with_vectors(small, vectors), prepare, whole, ["vector", "eps"]).withColumnRenamed("rep", "label")
    widest = held.where(F.col("n") > local).agg(F.max("eps")).first()[0]
    if widest is not None:
        large = with_vectors(held.where(F.col("n") > local), vectors).select("pos", "vector", SCOPE, "eps")
        found = found.unionByName(_density_by_blocks(cut_lineage(V.as_dense(large)), widest, min_samples, block_rows))
    found = cut_lineage(found)  # read three times below, settled once
    labelled = names.select("pos", SCOPE, "name").join(found, "pos", "left").withColumn("label", F.coalesce("label", F.lit(-1)))
    return groups_from_labels(labelled)


def _density_by_blocks(side: DataFrame, eps: float, min_samples: int, block_rows: int) -> DataFrame:
    def near(x: pd.DataFrame, scores: np.ndarray) -> np.ndarray:
        return 1.0 - scores <= x["eps"].to_numpy()[:, None]

    core_side = side
    if min_samples > 2:
        def degrees(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"pos": x["pos"].to_numpy(), "n": near(x, cosine_block(x, y, 0.0)).sum(axis=1)})

        counts = _compared(side, side, "cosine", 1.0 - eps, SCOPE, degrees, "pos long, n long", block_rows)
        core = counts.groupBy("pos").agg(F.sum("n").alias("n")).where(F.col("n") >= min_samples).select("pos")
        core_side = cut_lineage(side.join(core, "pos", "left_semi"))
    found = connected_components(near_forest(core_side, "cosine", 1.0 - eps, SCOPE, block_rows, near)).select(
        F.col("node").alias("pos"), F.col("component").alias("label"))
    if min_samples > 2:
        alone = core_side.join(found, "pos", "left_anti").select("pos", F.col("pos").alias("label"))
        clustered = cut_lineage(found.unionByName(alone))

        def reached(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
            y = y.sort_values("label")
            hits = near(x, cosine_block(x, y, 0.0))
            hit = hits.any(axis=1)
            return pd.DataFrame({"pos": x["pos"].to_numpy()[hit], "label": y["label"].to_numpy()[hits[hit].argmax(axis=1)]})

        others = side.join(clustered, "pos", "left_anti")
        borders = _compared(others, core_side.join(clustered, "pos"), "cosine", 1.0 - eps, SCOPE, reached, "pos long, label long", block_rows)
        found = clustered.unionByName(borders.groupBy("pos").agg(F.min("label").alias("label")))
    return found


def density_grid(names: DataFrame, distances: list[float], block_rows: int = B.DEFAULT_BLOCK) -> DataFrame:
    """``(distance, scope, name, representative)``: density groups of two samples for every distance, from one comparison.

    The closest edges that hold all names together up to the largest distance hold them together up to
    any smaller one as well, so each distance is a cut of the same forest.
    """
    names = scoped(names)
    widest = max(distances)
    edges = cut_lineage(near_forest(names.select("pos", "vector", SCOPE), "cosine", 1.0 - widest, SCOPE, block_rows,
                                    lambda x, scores: 1.0 - scores <= widest))
    out = None
    for distance in distances:
        found = connected_components(edges.where(1.0 - F.col("similarity") <= distance))
        labelled = names.select("pos", SCOPE, "name").join(found.select(F.col("node").alias("pos"), F.col("component").alias("label")), "pos", "left")
        groups = groups_from_labels(labelled.withColumn("label", F.coalesce("label", F.lit(-1)))).select(F.lit(float(distance)).alias("distance"), "*")
        out = groups if out is None else out.unionByName(groups)
    return out


def hierarchical_groups(names: DataFrame, distance: float = fv.HIERARCHICAL_DISTANCE,
                        block_rows: int = B.DEFAULT_BLOCK, local: int = LOCAL_NAMES) -> DataFrame:
    """Average-linkage groups cut at a distance.

    Average linkage never merges across components of the graph of pairs within the distance, so units
    are settled each for itself.  In a unit too large for that all mutually nearest groups merge at
    once, round by round, until few enough groups are left to go on whole: average linkage never brings
    a merged group closer to a third one than its parts were, so the rounds reach the same groups, and a
    group needs only its mean vector.  Of equally near groups the earliest counts as nearest.
    """
    names = V.as_dense(scoped(names))
    length = V.norm("vector")
    unit = F.transform("vector", lambda v: F.coalesce(F.try_divide(v.cast("double"), length), F.lit(0.0)))
    units = V.as_dense(with_units(names, "cosine", 1.0 - distance, local, block_rows))
    groups = cut_lineage(units.select("unit", F.col("pos").alias("label"), unit.alias("mean"), F.lit(1).cast("long").alias("count"), "n"))
    members = names.select("pos", F.col("pos").alias("label"))

    def prepare(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        return np.vstack(table["mean"].to_numpy()), table["count"].to_numpy()

    def whole(unit: tuple[np.ndarray, np.ndarray], i: int, j: int) -> np.ndarray:
        return linkage.average_link(unit[0][i:j], unit[1][i:j], distance)

    def closest(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if x.empty or y.empty:
            return pd.DataFrame()
        y = y.sort_values("label")
        scores = np.round(B.matrix(x["mean"]) @ B.matrix(y["mean"]).T, DIGITS)
        a, b = x["label"].to_numpy(), y["label"].to_numpy()
        scores[a[:, None] == b[None, :]] = -np.inf
        j = scores.argmax(axis=1)
        found = pd.DataFrame({"label": a, "other": b[j], "score": scores[np.arange(len(a)), j]})
        return found[np.isfinite(found["score"])]

    ended = None
    while True:
        done = _settled_whole(groups.where(F.col("n") <= local), prepare, whole, ["mean", "count"], "label")
        ended = done if ended is None else ended.unionByName(done)
        groups = groups.where(F.col("n") > local)
        if groups.isEmpty():
            break
        near = cut_lineage(B.compare_blocks(groups, groups, "unit", "label", "label", closest, "label long, other long, score double", block_rows))
        best = near.groupBy("label").agg(F.max("score").alias("score"))
        near = cut_lineage(near.join(best, ["label", "score"]).groupBy("label", "score").agg(F.min("other").alias("other")))
        back = near.select(F.col("label").alias("other"), F.col("other").alias("label"))
        merges = cut_lineage(near.where((F.col("label") < F.col("other")) & (1 - F.col("score") <= distance))
                             .join(back, ["label", "other"]).select(F.col("other").alias("label"), F.col("label").alias("into")))
        merging = groups.join(merges.select(F.col("into").alias("label")), "label", "left_semi").select("unit").distinct()
        final = groups.join(merging, "unit", "left_anti").select(F.col("label").alias("pos"), F.col("label").alias("rep"))
        ended = cut_lineage(ended.unionByName(final))
        members = cut_lineage(members.join(merges, "label", "left").select("pos", F.coalesce("into", "label").alias("label")))
        gone = groups.select(F.col("label").alias("gone"), F.col("mean").alias("mean2"), F.col("count").alias("count2"))
        stays = groups.drop("n").join(merging, "unit", "left_semi").join(merges, "label", "left_anti").join(
            merges.select(F.col("into").alias("label"), F.col("label").alias("gone")), "label", "left").join(gone, "gone", "left")
        total = F.col("count") + F.coalesce("count2", F.lit(0))
        mean = F.when(F.col("count2").isNull(), F.col("mean")).otherwise(
            F.zip_with("mean", "mean2", lambda p, q: (p * F.col("count") + q * F.col("count2")) / total))
        left = stays.select("unit", "label", mean.alias("mean"), total.alias("count"))
        groups = cut_lineage(left.join(left.groupBy("unit").agg(F.count(F.lit(1)).alias("n")), "unit"))
    labels = members.join(ended.withColumnRenamed("pos", "label"), "label").select("pos", F.col("rep").alias("label"))
    return groups_from_labels(names.select("pos", SCOPE, "name").join(cut_lineage(labels), "pos"))


# --- choice of method ----------------------------------------------------------------------------------------------

def group_names(names: DataFrame, config: X.CleaningConfig = X.CleaningConfig(), encoder: Encoder = char_encoder) -> DataFrame:
    """``scope, name, representative`` for every name by the configured method; blank names stand for themselves.

    The density hierarchy is not available and takes the complete-link rule, as the published fallback
    does.  ``batch_mode`` reproduces the published batches of 25; otherwise the method sees all names.
    With ``size_rules`` the published switches hold in every scope: up to five names are linked
    completely whatever the method, and the density distance shrinks with the number of names.
    """
    names = scoped(names)
    blank = names.where(F.length(F.trim("name")) == 0).select(SCOPE, "name", F.col("name").alias("representative"))
    names = names.where(F.length(F.trim("name")) > 0)
    if not config.use_embedding_grouping:
        if config.use_fuzzy_matching:
            grouped = leader_groups(with_positions(names), config.similarity_threshold, local=config.local_names)
            return grouped.unionByName(blank)
        return names.select(SCOPE, "name", F.col("name").alias("representative")).unionByName(blank)
    # positions and sizes are settled on names alone; each text's vector is written once and joined where it is compared
    texts = names.select("name").distinct()
    vectors = cut_lineage(encoder(texts, "name", "vector"))
    encoded = vectors.where(F.col("vector").isNotNull())
    placed = with_positions(names).select(SCOPE, "name", "first_seq", "pos")
    if encoded.count() < texts.count():  # names that a caller's encoder has no vector for
        blank = blank.unionByName(placed.join(encoded, "name", "left_anti").select(SCOPE, "name", F.col("name").alias("representative")))
        placed = placed.join(encoded, "name", "left_semi")
    packed = encoded.select("name", V.sparse("vector").alias("vector"))
    return _grouped_by_vector(cut_lineage(with_sizes(placed)), vector_side(packed), config).unionByName(blank)


def _grouped_by_vector(placed: DataFrame, vectors: DataFrame, config: X.CleaningConfig) -> DataFrame:
    theta, method, local = config.similarity_threshold, config.clustering_method, config.local_names
    if not config.size_rules:
        return _by_method(placed, vectors, config, method, None)
    few = fv.SMALL_INPUT if not config.batch_mode else 0
    small, rest = placed.where(F.col("n") <= few), placed.where(F.col("n") > few)
    grouped = _by_method(rest, vectors, config, method, adaptive_eps(config.dbscan_eps, F.col("n"), config.dbscan_least_eps))
    return grouped.unionByName(complete_link_groups(small, theta, local=local, vectors=vectors)) if few and not small.isEmpty() else grouped


def _by_method(placed: DataFrame, vectors: DataFrame, config: X.CleaningConfig, method: str, eps_by_size: Column | None) -> DataFrame:
    local = config.local_names
    if config.batch_mode:
        return batched_groups(with_vectors(placed, vectors), config.similarity_threshold, config.batch_size, local=local)
    if method == "dbscan":
        return density_groups(placed, config.dbscan_eps, config.dbscan_min_samples, local=local, eps_by_size=eps_by_size, vectors=vectors)
    if method == "hierarchical":
        return hierarchical_groups(with_vectors(placed, vectors), config.hierarchical_distance, local=local)
    return complete_link_groups(placed, config.similarity_threshold, local=local, vectors=vectors)


def scope_of(by: list[str]) -> Column:
    """One text for the values of the given columns; null is a value of its own."""
    return F.to_json(F.struct(*by), {"ignoreNullFields": "false"}) if by else F.lit("")


def clean_and_group(df: DataFrame, column: str = "description", config: X.CleaningConfig = X.CleaningConfig(),
                    encoder: Encoder = char_encoder, by: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows with ``cleaned`` and ``representative``, and the grouping of the distinct names.

    ``by`` names the columns, a user's say, within which names are grouped and representatives chosen.
    The cleaned rows are written: names, representatives and results read them, each in a pass of its own.
    """
    cleaned = settled(lambda: with_cleaned(df, column, config).withColumn(SCOPE, scope_of(by or [])))
    groups = settled(lambda: group_names(cut_lineage(cleaned_names(cleaned, by=[SCOPE])), config, encoder))
    return with_representatives(cleaned, groups), groups


def with_representatives(cleaned: DataFrame, groups: DataFrame) -> DataFrame:
    """Every row gets the representative of its name, or its own name."""
    named = groups.select(SCOPE, F.col("name").alias("cleaned"), "representative")
    return cleaned.join(named, [SCOPE, "cleaned"], "left").withColumn("representative", F.coalesce("representative", "cleaned"))


def group_members(rows: DataFrame) -> DataFrame:
    """Representative and member, one row per scope and cleaned name with its first order key.

    The listing is long rather than one array per group, so a popular group needs no single row.
    """
    return scoped(rows).groupBy(SCOPE, "representative", "cleaned").agg(F.min("seq").alias("first_seq"), F.count(F.lit(1)).alias("n"))


def group_representatives(rows: DataFrame) -> DataFrame:
    """The first row of each scope's group (description, amount, direction) and the group size.

    Rows are reduced once, before they are shuffled; a group without any order key has no first row.
    """
    kept = F.when(F.col("seq").isNotNull(), F.struct("seq", "description", "amount", "money_in"))
    first = scoped(rows).groupBy(SCOPE, "representative").agg(F.min(kept).alias("f"), F.count(F.lit(1)).alias("group_size"))
    return first.where(F.col("f").isNotNull()).select(
        SCOPE, "representative", F.col("f.description").alias("description"), F.col("f.amount").alias("amount"),
        F.col("f.money_in").alias("money_in"), F.col("f.seq").alias("seq"), "group_size")
