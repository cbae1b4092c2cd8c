"""Grouping against straightforward single-process rules on small inputs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spendgrid.functions import vectors as V
from spendgrid.functions.text import CleaningConfig
from spendgrid.operators import cells, text_index
from spendgrid.operators import components as CC
from spendgrid.operators import grouping as G
from spendgrid.operators import ordered
from spendgrid.plans import universal as U


def clustered(n, seed, spread=0.35):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, 5))
    return (centres[rng.integers(0, 6, n)] + spread * rng.normal(size=(n, 5))).round(4)


def frame(spark, vectors):
    rows = [(i, f"n{i:03d}", v.tolist()) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "pos long, name string, vector array<double>").repartition(3)


def cosines(vectors):
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.round(unit @ unit.T, G.DIGITS)


def result(df):
    return {int(r["name"][1:]): int(r.representative[1:]) for r in df.collect()}


def brute_complete(s, threshold):
    groups, rep = {}, {}
    for i in range(len(s)):
        best, best_score = None, 0.0
        for g, members in groups.items():
            low = min(s[i, m] for m in members)
            if low >= threshold and low > best_score:
                best, best_score = g, low
        rep[i] = i if best is None else best
        groups.setdefault(rep[i], []).append(i)
    return rep


def brute_leader(s, order, threshold):
    rep, leaders = {}, []
    for i in order:
        best, score = i, 0.0
        for c in leaders:
            if s[i, c] >= threshold and s[i, c] > score:
                best, score = c, s[i, c]
        rep[i] = best
        if best == i:
            leaders.append(i)
    return rep


@pytest.mark.parametrize("local, block_rows", [(1000, 8192), (4, 8192), (3, 7)])
def test_complete_link(spark, local, block_rows):
    vectors = clustered(40, 1)
    got = result(G.complete_link_groups(frame(spark, vectors), 0.85, block_rows=block_rows, local=local))
    assert got == brute_complete(cosines(vectors), 0.85)


def test_leader_on_text(spark):
    rng = random.Random(2)
    words = ["countdown", "woolworths", "new world", "kmart"]
    names = sorted({"".join(ch for ch in rng.choice(words) if rng.random() > 0.12) + rng.choice(["", "s", " nz"]) for _ in range(60)})
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "pos long, name string")
    s = np.array([[V.text_ratio(a, b) for b in names] for a in names])
    wanted = {names[k]: names[v] for k, v in brute_leader(s, range(len(names)), 0.85).items()}
    for size, local in ((1000, 1000), (11, 3)):
        assert {r["name"]: r.representative for r in G.leader_groups(df, 0.85, block_rows=size, local=local).collect()} == wanted
    complete = {names[k]: names[v] for k, v in brute_complete(s, 0.85).items()}
    for local in (1000, 3):
        assert {r["name"]: r.representative for r in G.complete_link_groups(df, 0.85, "ratio", local=local).collect()} == complete


def test_batched(spark):
    vectors = clustered(40, 4)
    s, rep = cosines(vectors), {}
    for start in range(0, 40, 10):
        local = brute_complete(s[start:start + 10, start:start + 10], 0.85)
        rep.update({start + k: start + v for k, v in local.items()})
    merged = brute_leader(s, sorted(set(rep.values())), 0.85)
    df = frame(spark, vectors).withColumn("first_seq", F.col("pos"))
    assert result(G.batched_groups(df, 0.85, batch=10)) == {k: merged[v] for k, v in rep.items()}


@pytest.mark.parametrize("min_samples", [2, 4])
def test_density(spark, min_samples):
    vectors = clustered(45, 7, 0.45)
    near = 1 - cosines(vectors) <= 0.1
    core = [i for i in range(45) if near[i].sum() >= min_samples]
    label, current = {}, 0
    for i in core:                                   # grow clusters from core points in order
        if i in label:
            continue
        stack, label[i] = [i], current
        while stack:
            x = stack.pop()
            if near[x].sum() < min_samples:
                continue
            for y in np.nonzero(near[x])[0]:
                if y not in label:
                    label[int(y)] = current
                    stack.append(int(y))
        current += 1
    first = {}
    for i in range(45):
        if i in label:
            first.setdefault(label[i], i)
    wanted = {i: first[label[i]] if i in label else i for i in range(45)}
    for local in (1000, 5):
        assert result(G.density_groups(frame(spark, vectors), 0.1, min_samples, block_rows=11, local=local)) == wanted


def test_hierarchical(spark):
    vectors = clustered(26, 9, 0.3)
    s = cosines(vectors)
    groups = [[i] for i in range(26)]
    while len(groups) > 1:
        best = min(((1 - s[np.ix_(a, b)].mean(), x, y) for x, a in enumerate(groups) for y, b in enumerate(groups) if x < y))
        if best[0] > 0.3:
            break
        groups[best[1]] = groups[best[1]] + groups.pop(best[2])
    wanted = {i: min(g) for g in groups for i in g}
    df = frame(spark, vectors)
    assert result(G.hierarchical_groups(df, 0.3)) == wanted
    assert result(G.hierarchical_groups(df, 0.3, block_rows=9, local=3)) == wanted


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 30)] + [(100 + rng.randint(0, 40), 100 + rng.randint(0, 40)) for _ in range(25)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    wanted = {n: find(n) for n in list(root)}
    got = {r.node: r.component for r in CC.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: min(m for m in wanted if wanted[m] == wanted[n]) for n in wanted}


def test_labels_and_noise(spark):
    df = spark.createDataFrame([(0, "a", -1), (1, "b", 5), (2, "c", 5)], "pos long, name string, label long")
    assert {r["name"]: r.representative for r in G.groups_from_labels(df).collect()} == {"a": "a", "b": "b", "c": "b"}


def test_unrelated_names_stay_apart(spark):
    names = ["countdown", "petrol station", "zoo", "kmart", "book shop", "jazz quartet"]
    df = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "name string, first_seq long")
    groups = {r["name"]: r.representative for r in G.group_names(df, CleaningConfig(similarity_threshold=0.95)).collect()}
    assert groups == {n: n for n in names}


def test_groups_are_partitions_with_similar_members(spark):
    vectors = clustered(50, 12)
    s = cosines(vectors)
    got = result(G.complete_link_groups(frame(spark, vectors), 0.8, local=16))
    for i in got:
        assert got[got[i]] == got[i]
        for j in got:
            if got[i] == got[j]:
                assert s[i, j] >= 0.8 or i == j


def test_universal_with_batch_labeller(spark):
    calls = U.batch_labeller(lambda: lambda rows: [{"description": r["description"], "suggested_category": "Groceries"
                                                     if "COUNTDOWN" in r["description"] else "Nonsense"} for r in rows], batch=2)
    tx = spark.createDataFrame([(f"t{i}", i, d, 1.0, False) for i, d in enumerate(
        ["COUNTDOWN AUCKLAND", "COUNTDOWN AUCKLAND", "JAZZ QUARTET", "BOOKSHOP"])], "tx_id string, seq long, description string, amount double, money_in boolean")
    got = {r.tx_id: r.predicted_category for r in U.categorise(tx, U.predefined_categories(spark), calls,
                                                             CleaningConfig(similarity_threshold=0.99)).collect()}
    assert got == {"t0": "Groceries", "t1": "Groceries", "t2": "GENERAL_SERVICES", "t3": "GENERAL_SERVICES"}


def test_average_linkage_of_a_thousand_names(spark):
    rng = np.random.default_rng(5)
    vectors = np.abs(rng.normal(size=(40, 12)))[rng.integers(0, 40, 1000)] + 0.1 * rng.normal(size=(1000, 12))
    df = spark.createDataFrame([(i, f"n{i:04d}", v.tolist()) for i, v in enumerate(vectors)], "pos long, name string, vector array<double>")
    whole = result(G.hierarchical_groups(df, 0.05))
    assert result(G.hierarchical_groups(df, 0.05, local=100)) == whole and 40 <= len(set(whole.values())) < 500


def test_cells_lose_no_pair(spark):
    vectors = clustered(300, 3, 0.2)
    s = cosines(vectors)
    side = frame(spark, vectors).withColumn("scope", F.lit("x"))
    for threshold in (0.99, 0.9, 0.3, -0.2):
        left, right = cells.keyed(side, side, threshold, "scope", half=True, cell_rows=20)
        meet = {(r.a, r.b) for r in left.select(F.col("pos").alias("a"), cells.KEY).join(right.select(F.col("pos").alias("b"), cells.KEY), cells.KEY).collect()}
        reach = {(i, j) for i in range(300) for j in range(i) if s[i, j] >= threshold}
        assert all((i, j) in meet or (j, i) in meet for i, j in reach)
        if threshold == 0.99:
            n = cells.pair_counts(left, right).first()
            assert n.compared < n.everything / 5
    got = {(r.a, r.b) for r in G.near_pairs(frame(spark, vectors), 0.9).collect()}
    assert got == {(j, i) for i, j in {(i, j) for i in range(300) for j in range(i) if s[i, j] >= 0.9}}


def test_text_index_loses_no_pair(spark):
    rng = random.Random(4)
    words = ["countdown", "woolworths", "new world", "kmart", "a", "bp", "the warehouse group", "x" * 70 + "yz" * 20]
    names = sorted({"".join(ch for ch in rng.choice(words) if rng.random() > 0.1) + rng.choice(["", "s", " nz", "é"]) for _ in range(150)} - {""})
    s = np.array([[V.text_ratio(a, b) for b in names] for a in names])
    df = spark.createDataFrame([(i, n, "x") for i, n in enumerate(names)], "pos long, name string, scope string")
    for threshold in (0.85, 0.6):
        left, right = text_index.keyed(df, df, threshold, "scope")
        meet = {(r.a, r.b) for r in left.select(F.col("pos").alias("a"), cells.KEY).join(right.select(F.col("pos").alias("b"), cells.KEY), cells.KEY).collect()}
        assert {(i, j) for i, j in zip(*np.nonzero(s >= threshold))} <= meet
        assert len(meet) < len(names) ** 2 / 2 or threshold < 0.8
        got = text_index.ratios(names, names, threshold)
        assert (np.where(s >= threshold, s, 0) == np.where(got >= threshold, got, 0)).all()


def test_grid_is_a_cut_of_one_forest(spark):
    df = frame(spark, clustered(60, 8, 0.4))
    distances = [0.02, 0.1, 0.3]
    rows = G.density_grid(df, distances, block_rows=13).collect()
    for d in distances:
        own = {int(r["name"][1:]): int(r.representative[1:]) for r in rows if r.distance == d}
        assert own == result(G.density_groups(df, d))


@pytest.mark.parametrize("config", [dict(), dict(clustering_method="dbscan", dbscan_eps=0.05, dbscan_least_eps=0.01), dict(clustering_method="hierarchical", hierarchical_distance=0.1),
                                    dict(use_embedding_grouping=False, use_fuzzy_matching=True), dict(batch_mode=True, batch_size=3), dict(size_rules=True, clustering_method="dbscan")])
def test_scopes_are_grouped_apart(spark, config):
    rng = random.Random(6)
    words = ["countdown", "woolworths", "new world", "kmart", "bp connect"]
    rows = [(f"u{u}", "".join(ch for ch in rng.choice(words) if rng.random() > 0.1), u * 100 + k) for u in range(3) for k in range(3 + 5 * u)] + [("u1", " ", 999)]
    df = spark.createDataFrame(rows, "scope string, name string, first_seq long").dropDuplicates(["scope", "name"])
    apart = sorted((f"u{u}", r["name"], r.representative) for u in range(3)
                   for r in G.group_names(df.where(F.col("scope") == f"u{u}").drop("scope"), CleaningConfig(**config)).collect())
    for local in (1000, 4):
        got = sorted((r.scope, r["name"], r.representative) for r in G.group_names(df, CleaningConfig(**config, local_names=local)).collect())
        assert got == apart and ("u1", " ", " ") in got


def test_vectors_are_written_once_a_text(spark, monkeypatch):
    written = []

    def cut(df):
        written.append(set(df.columns))
        return real(df)

    real = G.cut_lineage
    monkeypatch.setattr(G, "cut_lineage", cut)
    monkeypatch.setattr(ordered, "cut_lineage", cut)
    rows = spark.createDataFrame([(u, 10 * u + i, n, 1.0, True) for u in range(3) for i, n in enumerate(("acme gym", "acme gyms", "zoo", "acme gym"))],
                                 "user_id long, seq long, description string, amount double, money_in boolean")
    for method in ("dbscan", "similarity"):
        config = CleaningConfig(clustering_method=method, dbscan_eps=0.1)
        named, groups = G.clean_and_group(rows, config=config, by=["user_id"])
        assert groups.count() == 9
        first = {(r.scope, r.representative): (r.seq, r.description) for r in G.group_representatives(named).collect()}
        assert first['{"user_id":1}', "acme gym"] == (10, "acme gym")
    # once a scope and name before, in several steps
    assert [c for c in written if "vector" in c] == [{"name", "vector"}] * 2


def test_representatives_come_from_one_reduction(spark):
    rows = spark.createDataFrame([("a", 2, "x", 1.0, True), ("a", 1, "z", 2.0, None), ("a", 1, "y", 3.0, True), ("a", None, "w", 0.0, True), ("b", None, "v", 0.0, True)],
                                 "representative string, seq long, description string, amount double, money_in boolean")
    found = G.group_representatives(rows)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()  # joined to its rows again before
    assert [(r.representative, r.description, r.amount, r.seq, r.group_size) for r in found.collect()] == [("a", "y", 3.0, 1, 4)]


def test_cleaned_rows_are_written_once(spark):
    rows = spark.range(40).select(F.col("id").alias("seq"), F.concat(F.lit("shop number "), (F.col("id") % 4).cast("string")).alias("description"))
    named, _ = G.clean_and_group(rows)
    plan = named._jdf.queryExecution().optimizedPlan().toString()
    assert "Range (" not in plan  # the rows were built and joined to their cleaned texts anew in every pass
    assert named.count() == 40
