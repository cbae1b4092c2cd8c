"""Ordered helpers, blocked comparisons, training, scoring and transfers against brute force."""

import random
import time
from datetime import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from spendgrid.catalog.model_queries import QUERIES as MODEL_QUERIES
from spendgrid.functions import vectors as V
from spendgrid.operators import analytics as AN
from spendgrid.operators import neighbours as K
from spendgrid.operators import transfers as T
from spendgrid.operators.encoding import batch_encoder, encode_distinct
from spendgrid.operators.ordered import dense_position
from spendgrid.plans import classify as C
from spendgrid.plans import train as TR


def test_dense_position(spark):
    rows = [("a" if i % 3 else "b", (i * 37) % 101, i) for i in range(101)]
    df = spark.createDataFrame(rows, "k string, o long, i long").repartition(5)
    got = {r.i: r.p for r in dense_position(df, ["k"], ["o"], "p").collect()}
    for k in "ab":
        ordered = sorted((o, i) for key, o, i in rows if key == k)
        assert [got[i] for _, i in ordered] == list(range(len(ordered)))


def test_text_ratio_is_insert_delete():
    def slow(a, b):
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1, j + 1] = table[i, j] + 1 if x == y else max(table[i, j + 1], table[i + 1, j])
        return 2 * table[-1, -1] / (len(a) + len(b)) if a or b else 1.0

    rng = random.Random(1)
    for _ in range(200):
        a, b = ("".join(rng.choice("abcd") for _ in range(rng.randint(0, 9))) for _ in range(2))
        assert V.text_ratio(a, b) == slow(a, b)


def test_nearest_over_several_blocks(spark):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(90, 6)).round(3)
    vectors[10] = vectors[4]
    model = [(u, i, f"c{i % 4}", vectors[i].tolist()) for u in (1, 2) for i in range(60) if u == 1 or i < 7]
    score = [(u, i, vectors[i].tolist()) for u in (1, 2) for i in range(90)]
    m = spark.createDataFrame(model, "user_id long, item_id long, category string, vector array<double>")
    s = spark.createDataFrame(score, "user_id long, tx_id long, vector array<double>")
    got = {}
    for r in K.nearest(s, m, k=5, block_rows=13).collect():
        got.setdefault((r.user_id, r.tx_id), {})[r["rank"]] = r.item_id
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    for u, count in ((1, 60), (2, 7)):
        scores = np.round(unit @ unit[:count].T, K.SCORE_DIGITS)
        for i in range(90):
            wanted = sorted(range(count), key=lambda j: (-scores[i, j], j))[:5]
            assert [got[u, i][r] for r in range(1, 6)] == wanted


def test_confidence_rules(spark):
    rows = [(0, 1, "a", 0.59, "a", 0.1), (0, 2, "a", 0.9, "b", 0.88), (0, 3, "a", 0.9, "a", 0.89), (0, 4, "a", 0.9, "b", 0.8)]
    df = spark.createDataFrame(rows, "user_id long, tx_id long, best_category string, best_score double, second_category string, second_score double")
    df = df.withColumns({"neighbor_categories": F.array(F.lit("a")), "neighbor_scores": F.array(F.lit(0.9))})
    got = {r.tx_id: (r.is_low_confidence, r.debug_info.reason_code) for r in K.confidence(df).collect()}
    assert got == {1: (True, "LOW_ABS_CONF"), 2: (True, "LOW_REL_CONF_AND_CONFLICTING_NEIGHBORS"), 3: (False, None), 4: (False, None)}


def test_quantise_truncates(spark):
    df = spark.createDataFrame([(1, [1.27, -0.019, 0.0]), (2, [0.0, 0.0, 0.0])], "user_id long, vector array<double>")
    got = {r.user_id: (r.codes, r.scale) for r in V.quantise(df).collect()}
    assert got[1][0] == [127, -1, 0] and abs(got[1][1] - 0.01) < 1e-12
    assert got[2] == ([0, 0, 0], 1.0)


def _labelled(spark):
    names = ["coffee corner", "petrol station", "super market", "book shop", "train ticket", "green grocer", "bike repair",
             "music hall", "garden centre", "fish market", "shoe outlet"]
    rows = [(1, i, n.upper(), f"c{i % 3}") for i, n in enumerate(names)] + [(1, 99, "COFFEE CORNER", "other")]
    rows += [(1, 100, "PIZZA PLACE", None), (2, 0, "ONLY ONE", "c")]
    return spark.createDataFrame(rows, "user_id long, seq long, description string, category string")


def test_train_and_classify(spark):
    labelled = _labelled(spark)
    model = TR.train(labelled)
    rows = {r.item_id: (r.description, r.category) for r in model.collect()}
    assert rows[0] == ("coffee corner", "c0") and len(rows) == 11       # first kept, user 2 has too few, no null category
    tx = spark.createDataFrame([("t1", 1, 0, "COFFEE CORNER", False, -3.0), ("t2", 2, 1, "ONLY ONE", None, None),
                                ("t3", 1, 2, "  ", None, 1.0), ("t4", 1, 3, "BIKE REPAIR", True, float("nan"))],
                               "tx_id string, user_id long, seq long, description string, money_in boolean, amount double")
    got = {r.tx_id: r for r in C.classify(tx, model).collect()}
    assert set(got) == {"t1", "t2"}
    assert got["t1"].predicted_category == "c0" and got["t1"].similarity_score > 0.99
    assert got["t2"].predicted_category == "Unknown" and got["t2"].similarity_score == 0.0


def test_suggestions(spark):
    results = spark.createDataFrame([("x", "old", 0.5, True, "why"), ("y", "old", 0.5, True, "why"), ("z", "old", 0.9, False, None), ("n", "old", 0.1, True, "why")],
                                    "narrative string, predicted_category string, similarity_score double, is_low_confidence boolean, reason string")
    categories = spark.createDataFrame([(0, "id1", "Food"), (1, "id2", "Food"), (2, "id3", "Fuel")], "seq long, id string, name string")
    suggestions = spark.createDataFrame([("x", "Food", 0), ("x", "Fuel", 1), ("y", "Bogus", 0), ("y", "Fuel", 1), ("z", "Fuel", 0), ("n", "None", 0)],
                                        "description string, suggested_category string, seq long")
    got = {r.narrative: r for r in C.merge_suggestions(results, suggestions, categories).collect()}
    assert got["x"].predicted_category == "id2" and got["x"].llm_assisted and got["x"].original_embedding_category == "old"
    assert [got[k].predicted_category for k in "yzn"] == ["old"] * 3


def test_suggestions_of_each_user(spark):
    results = spark.createDataFrame([(1, "x", "old", 0.5, True, "why"), (2, "x", "old", 0.5, True, "why"), (3, "x", "old", 0.5, True, "why")],
                                    "user_id long, narrative string, predicted_category string, similarity_score double, is_low_confidence boolean, reason string")
    categories = spark.createDataFrame([(1, 0, "a1", "Food"), (2, 0, "b1", "Fuel"), (2, 1, "b2", "Food"), (3, 0, "c1", "Fuel")],
                                       "user_id long, seq long, id string, name string")
    suggestions = spark.createDataFrame([(1, "x", "Food", 0), (2, "x", "Food", 3), (3, "x", "Food", 1)],
                                        "user_id long, description string, suggested_category string, seq long")
    got = {r.user_id: r.predicted_category for r in C.merge_suggestions(results, suggestions, categories).collect()}
    assert got == {1: "a1", 2: "b2", 3: "old"}  # user 3 has no such category


def test_every_text_is_trained(spark):
    names = ["MĀORI ARTS", "ŻABKA", "東京", "\U0001F600 SHOP"] + [f"SHOP {'ABCDEFGH'[i]}" for i in range(7)] + ["LONG " + "WORDS AND " * 100 + "END"]
    rows = [(1, i, n, f"c{i}") for i, n in enumerate(names)] + [(1, 50, " ", "c"), (1, 51, "SHOP A", None), (2, 0, "FEW", "c")]
    labelled = spark.createDataFrame(rows, "user_id long, seq long, description string, category string")
    model = TR.train(labelled, quantise=False)
    found = {r.category: r for r in model.collect()}
    assert len(found) == len(names) and all(len(r.vector) == 256 and abs(sum(r.vector) - 1) < 1e-9 for r in found.values())
    assert len(found["c11"].description) > 500  # the whole text
    text = found["c1"].description
    assert [found["c1"].vector[ord(ch) % 256] > 0 for ch in text] == [True] * len(text)
    reasons = sorted((r.user_id, r.seq, r.reject_reason) for r in TR.training_rejects(labelled).collect())
    assert reasons == [(1, 50, "description must not be blank"), (1, 51, TR.NO_CATEGORY), (2, 0, TR.TOO_FEW_ROWS)]
    assert max(len(r.description) for r in TR.index_copy(model.drop("vector")).collect()) == 256


def test_a_wrong_model_fails_nobody_else(spark):
    model = TR.train(_labelled(spark), quantise=False).select("user_id", "item_id", "description", "category", "vector")
    wrong = spark.createDataFrame([(7, 0, "d", "c", [1.0, 2.0])], model.schema)
    tx = spark.createDataFrame([("t1", 1, 0, "COFFEE CORNER", False, -3.0), ("t2", 7, 1, "BOOK SHOP", False, -1.0)],
                               "tx_id string, user_id long, seq long, description string, money_in boolean, amount double")
    got = {r.tx_id: r for r in C.classify(tx, model.unionByName(wrong)).collect()}
    assert got["t1"].predicted_category == "c0"
    assert got["t2"].predicted_category == "Unknown" and got["t2"].adjustment_info.reason == C.WRONG_DIMENSION


def test_learned_encoder_hook(spark):
    df = spark.createDataFrame([("aa",), ("b",), ("aa",)], "t string")
    encoder = batch_encoder(lambda: lambda texts: [[len(t), 1.0] for t in texts])
    assert sorted((r.t, r.vector) for r in encode_distinct(df, "t", encoder).collect()) == [
        ("aa", [2.0, 1.0]), ("aa", [2.0, 1.0]), ("b", [1.0, 1.0])]


def _brute_transfers(rows):
    pairs, taken = set(), set()
    by_key = {}
    for r in rows:
        by_key.setdefault((r["user_id"], r["cleaned_narrative"]), []).append(r)
    for group in by_key.values():
        group.sort(key=lambda r: (r["seq"], r["tx_id"]))
        for inc in (r for r in group if r["money_in"] and r["predicted_category"] != "Transfer in"):
            for exp in (r for r in group if not r["money_in"]):
                if exp["tx_id"] not in taken and abs(abs(inc["amount"]) - abs(exp["amount"])) < 0.01:
                    taken.add(exp["tx_id"])
                    pairs.add((inc["tx_id"], exp["tx_id"]))
                    break
    return pairs


def test_transfers_match_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for i in range(400):
        hot = rng.random() < 0.6
        cents = rng.choice([1000, 5000]) + (rng.randint(0, 3) if hot else rng.randint(0, 40))
        amount = cents / 100 + (rng.choice([0, 0.004, 0.007]) if rng.random() < 0.3 else 0)
        money_in = rng.random() < 0.5
        rows.append(dict(tx_id=f"t{i:03d}", user_id=1 if hot else rng.randint(1, 3), seq=rng.randint(0, 300), narrative="n",
                         cleaned_narrative="save" if hot else rng.choice(["save", "rent"]),
                         predicted_category="Transfer in" if rng.random() < 0.05 else "x", money_in=money_in,
                         amount=amount if money_in else -amount))
    schema = "tx_id string, user_id long, seq long, narrative string, cleaned_narrative string, predicted_category string, money_in boolean, amount double"
    df = spark.createDataFrame(pd.DataFrame(rows), schema).repartition(3)
    wanted = _brute_transfers(rows)
    assert len(wanted) > 60
    assert {tuple(r) for r in T.transfer_pairs(df).collect()} == wanted
    assert {tuple(r) for r in T.transfer_pairs(df, batch=7).collect()} == wanted


def test_transfer_edge_cases(spark):
    rows = [("a", 1, 0, "To Savings 1234567", "", "x", True, 5.0), ("b", 1, 1, "to  savings", "", "x", False, -5.0),
            ("c", 1, 2, "n", "k", "x", None, 5.0), ("d", 1, 3, "n", "k", "x", False, None), ("e", 1, 4, "n", "k", "x", True, 5.0)]
    schema = "tx_id string, user_id long, seq long, narrative string, cleaned_narrative string, predicted_category string, money_in boolean, amount double"
    got = {r.tx_id: r for r in T.pair_transfers(spark.createDataFrame(rows, schema)).collect()}
    assert got["a"].predicted_category == "Transfer in" and got["b"].predicted_category == "Transfer out"
    assert got["a"].matched_transfer_key == "to savings" and got["a"].original_category == "x"
    assert not any(got[k].adjusted for k in "cde")


def test_transfer_segments_on_chains(spark):
    """Sizes a fraction of a cent apart: what one segment takes changes what the next finds."""
    rng = random.Random(12)
    rows = [("t%04d" % k, 1, k, "x", "to savings", "x", rng.random() < 0.5, 10 + rng.randint(0, 12) * 0.004) for k in range(150)]
    rows += [("h%04d" % k, 2, k, "x", "to savings", "x", k % 3 == 0, 20 + (k % 2) * 0.005) for k in range(90)]
    df = spark.createDataFrame(rows, "tx_id string, user_id long, seq long, narrative string, cleaned_narrative string, predicted_category string, money_in boolean, amount double")
    wanted = set()
    for user in (1, 2):
        free = [(r[2], r[0], r[7]) for r in rows if r[1] == user and not r[6]]
        for r in (r for r in rows if r[1] == user and r[6]):
            hit = next((e for e in free if abs(e[2] - r[7]) < 0.01), None)
            if hit:
                free.remove(hit)
                wanted.add((r[0], hit[1]))
    for batch in (1000, 30):
        assert {tuple(r) for r in T.transfer_pairs(df, batch=batch).collect()} == wanted


def test_moments_of_large_amounts(spark):
    """Cents on top of amounts around 10^7: sums of squares would cancel."""
    rng = random.Random(3)
    rows = [(u, f"v{rng.randint(0, 2)}", f"c{rng.randint(0, 3)}", False, 1e7 + rng.randint(0, 99) / 100, k, datetime(2024, 1, 1)) for u in range(3) for k in range(200)]
    df = spark.createDataFrame(rows, "user_id long, vendor string, category string, money_in boolean, amount_abs double, seq long, date timestamp")
    got = {r.user_id: r for r in AN.with_spread(AN.spending_cube(df), ["user_id"]).collect()}
    for r in df.groupBy("user_id").agg(F.stddev_samp("amount_abs").alias("s"), F.avg("amount_abs").alias("m")).collect():
        assert got[r.user_id].deviation == pytest.approx(r.s, rel=1e-6) and got[r.user_id].mean == pytest.approx(r.m) and got[r.user_id].n == 200


def test_a_vectors_total_is_summed_once(spark):
    texts = spark.range(0, 4000, 1, 4).select(F.concat(F.lit("merchant name "), F.col("id").cast("string")).alias("t"))
    assert texts.limit(1).select(V.char_vector("t").alias("v")).first().v[ord("m")] == pytest.approx(2 / len("merchant name 0"))

    def seconds(vector):
        started = time.perf_counter()
        texts.select(vector("t").alias("v")).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - started

    seconds(V.char_counts)
    assert seconds(V.char_vector) < 5 * seconds(V.char_counts) + 1  # the sum once a slot took over twenty times as long


def test_long_chains_take_few_passes(spark, monkeypatch):
    rng = np.random.default_rng(5)
    n = 400
    frame = pd.DataFrame({"tx_id": [f"t{i:04d}" for i in range(n)], "seq": rng.permutation(n), "size": 10 + 0.004 * rng.integers(0, 23, n),
                          "money_in": rng.random(n) < 0.4})
    rows = spark.createDataFrame([(1, r.tx_id, int(r.seq), float(r.size), bool(r.money_in), "Unknown", "key", "key") for r in frame.itertuples()],
                                 "user_id long, tx_id string, seq long, amount double, money_in boolean, predicted_category string, narrative string, cleaned_narrative string")
    passes = []
    real = T.cut_lineage

    def cut(df):
        passes.append(set(df.columns) >= {"income_id", "segment"})
        return real(df)

    monkeypatch.setattr(T, "cut_lineage", cut)
    got = {(r.income_id, r.expense_id) for r in T.transfer_pairs(rows, batch=4).collect()}
    incomes, expenses = frame[frame["money_in"]].reset_index(drop=True), frame[~frame["money_in"]].reset_index(drop=True)
    assert got == {(incomes["tx_id"][i], expenses["tx_id"][e]) for i, e in T.match_in_order(incomes, expenses)}
    assert sum(passes) <= 4  # segments of 4, 32 and 256 incomes; one pass more for every few segments before


def test_cents_in_one_direction_are_not_put_in_order(spark, monkeypatch):
    rows = [(f"t{i}", 1, i, "shop", "shop", "x", i in (3, 7), 5.0 if i in (3, 4, 7) else float(100 + i)) for i in range(40)]
    rows += [("n1", None, 90, "shop", "shop", "x", True, 5.0), ("n2", None, 91, "shop", "shop", "x", False, 5.0)]
    results = spark.createDataFrame(rows, "tx_id string, user_id long, seq long, narrative string, cleaned_narrative string, "
                                    "predicted_category string, money_in boolean, amount double")
    ordered, position = [], T.dense_position
    monkeypatch.setattr(T, "dense_position", lambda df, *others: ordered.append(df.count()) or position(df, *others))
    assert [tuple(r) for r in T.transfer_pairs_by_cents(results).collect()] == [("t3", "t4")]
    assert ordered == [3]  # 42 rows before


def test_labels_read_written_results(spark):
    plan = MODEL_QUERIES["transfer_labels"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Relation [" not in plan  # the rows were built and cleaned for the pairs and again for the labels
