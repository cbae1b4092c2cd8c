"""Steps that move narrow rows and compare many users in a task, against plain rules."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from spendgrid.functions import vectors as V
from spendgrid.operators import blocks as B
from spendgrid.operators import grouping as G
from spendgrid.operators import neighbours as K
from spendgrid.plans import classify as C
from spendgrid.plans import train as TR


def test_users_are_compared_as_they_pass(spark):
    rng = np.random.default_rng(8)
    vectors = np.where(rng.random((40, 9)) < 0.6, 0, rng.integers(1, 4, (40, 9))).astype(float)
    trained = [(u, i, f"c{i % 3}", vectors[(u + i) % 40].tolist()) for u in range(30) for i in range(u % 7)] + [(99, i, "c", vectors[i].tolist()) for i in range(40)]
    wanted = [(u, f"t{i}", vectors[(3 * u + i) % 40].tolist()) for u in range(30) for i in range(u % 5)] + [(99, "t", vectors[7].tolist()), (None, "t", vectors[0].tolist()), (3, "no", None)]
    model = spark.createDataFrame(trained, "user_id long, item_id long, category string, vector array<double>").repartition(3)
    score = spark.createDataFrame(wanted, "user_id long, tx_id string, vector array<double>").repartition(3)
    want = {}
    unit = lambda v: np.array(v) / (np.linalg.norm(v) or 1.0)
    for user, tx, vector in wanted:
        if vector is not None:
            best = sorted((-round(float(unit(vector) @ unit(v)), 12), i, c) for u, i, c, v in trained if u == user)[:5]
            want |= {(user, tx, rank): (i, c) for rank, (_, i, c) in enumerate(best, 1)}
    for block_rows in (8192, 20):  # all users together; user 99 by blocks, the others together
        found = K.nearest(score, model, block_rows=block_rows)
        assert {(r.user_id, r.tx_id, r["rank"]): (r.item_id, r.category) for r in found.collect()} == want
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert ("CoGroups" in plan) == (block_rows == 20) and "MapInArrow" in plan  # a call for every user before


def test_whole_keys():
    rng = random.Random(2)
    keys = sorted(rng.choice("abcdefg") for _ in range(60)) + ["z"] * 30
    rows = pa.table({"k": keys, "n": list(range(90))})
    for size in (1, 4, 7, 200):
        tables = list(B.whole_keys(iter(rows.to_batches(max_chunksize=size)), "k"))
        assert [n for t in tables for n in t["n"].to_pylist()] == list(range(90))
        seen = [set(t["k"].to_pylist()) for t in tables]
        assert sum(map(len, seen)) == len(set(keys))
        for t in tables:
            bounds, own = B.key_bounds(t["k"]), t["k"].to_pylist()
            assert [own[i] for i in bounds[:-1]] == sorted(set(own)) and bounds[-1] == len(own)


def test_sparse_vectors(spark):
    given = {0: [0.0, 1.5, 0.0, -2.0], 1: [0.0, 0.0], 2: [], 3: None, 4: [3.0]}
    df = V.as_sparse(spark.createDataFrame(list(given.items()), "id long, vector array<double>"))
    rows = {r.id: r.vector for r in df.collect()}
    assert rows[0].at == [1, 3] and rows[0].value == [1.5, -2.0] and rows[0].size == 4 and rows[3] is None
    assert {r.id: r.vector for r in V.as_dense(df).collect()} == given
    table = pa.table({"v": pa.array([r.asDict() for k, r in sorted(rows.items()) if r and k != 2], pa.struct({"size": pa.int32(), "at": pa.list_(pa.int32()), "value": pa.list_(pa.float64())}))})
    assert B.dense_rows(table["v"]).tolist() == [[0, 1.5, 0, -2], [0, 0, 0, 0], [3, 0, 0, 0]]


def _labelled(spark):
    rows = [(u, 100 * u + i, f"{w.upper()} {n.upper()}", f"c{i % 3}") for u in range(4)
            for i, (w, n) in enumerate((a, b) for a in ("coffee", "garden", "petrol", "music") for b in ("corner", "centre", "station"))]
    return spark.createDataFrame(rows, "user_id long, seq long, description string, category string")


def test_vectors_do_not_travel_with_the_model(spark, monkeypatch):
    written, real = [], TR.cut_lineage
    monkeypatch.setattr(TR, "cut_lineage", lambda df: written.append(set(df.columns)) or real(df))
    model = TR.train(_labelled(spark))
    assert model.count() == 48 and not [c for c in written if {"user_id", "vector"} <= c]  # every row's vector was written before
    whole = V.quantise(TR.train(_labelled(spark), quantise=False))
    key = ["user_id", "item_id"]
    assert [tuple(r) for r in model.select(*key, "scale", "codes").orderBy(*key).collect()] == [tuple(r) for r in whole.select(*key, "scale", "codes").orderBy(*key).collect()]


def test_sparse_models_score_alike(spark):
    tx = spark.createDataFrame([(f"t{u}{i}", u, i, d, False, -1.0) for u in range(5) for i, d in enumerate(("COFFEE CORNERS", "MUSIC SHOP", "PETROL STATION"))],
                               "tx_id string, user_id long, seq long, description string, money_in boolean, amount double")
    for quantise in (True, False):
        both = [C.score(tx, TR.train(_labelled(spark), quantise=quantise, sparse=sparse)).orderBy("tx_id").collect() for sparse in (False, True)]
        assert both[0] == both[1] and len(both[0]) == 15 and both[0][0].similarity_score > 0.9 and both[0][-1].similarity_score == 0


def test_units_pass_through_a_task(spark):
    rows = [(f"u{u}", f"shop {'abcdefgh'[k % 8]}{'x' * (k // 8)}", 10 * u + k) for u in range(12) for k in range(3 + u)]
    names = G.with_positions(spark.createDataFrame(rows, "scope string, name string, first_seq long"))
    names = names.withColumn("vector", V.char_vector("name"))
    units = G.with_sizes(names)
    found = G._settled_whole(units, lambda t: t["name"].to_pylist(), lambda held, i, j: np.zeros(j - i, np.int64), ["name"])
    first = {r.scope: r.p for r in names.groupBy("scope").agg(F.min("pos").alias("p")).collect()}
    got = {(r.scope, r.rep) for r in names.join(found, "pos").collect()}
    assert got == set(first.items()) and found.count() == len(rows)
    assert "FlatMapGroupsInPandas" not in G.density_groups(names, 0.05)._jdf.queryExecution().executedPlan().toString()
