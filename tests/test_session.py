"""Written rows: what they hold, what they leave behind, and which queries go through them."""

import os
import time
from datetime import datetime

from pyspark.sql import functions as F

from spendgrid import session as S
from spendgrid.operators import analytics as N
from spendgrid.operators import ordered
from spendgrid.operators import transfers as T


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}


def local(table):
    return table.written_at.removeprefix("file:")


def test_written_rows_are_narrow_and_leave_no_shuffle(spark):
    before = shuffle_files(spark)
    rows = spark.range(200_000).repartition(4, "id").select("id", F.concat(F.lit("a long text that repeats "), (F.col("id") % 9).cast("string")).alias("t"),
                                                          F.timestamp_micros("id").alias("at"), F.when(F.col("id") % 3 > 0, F.array("id")).alias("a"))
    table = S.cut_lineage(rows)
    size = sum(os.path.getsize(f"{d}/{f}") for d, _, fs in os.walk(local(table)) for f in fs)
    assert size < 200_000 * 12  # rows of over 80 bytes
    until = time.time() + 10
    while shuffle_files(spark) - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffle_files(spark) - before  # they stayed until the driver collected its garbage
    assert table.exceptAll(rows).isEmpty() and table.count() == 200_000


def test_rows_that_columns_cannot_hold(spark):
    odd = spark.range(3).select("id", F.lit(None).alias("nothing"), F.col("id").alias("ID"))
    assert [tuple(r) for r in S.cut_lineage(odd).orderBy(F.col("nothing")).collect()].__len__() == 3
    twice = spark.range(2).select(F.col("id").alias("x"), F.col("id").alias("x"))
    assert sorted(tuple(r) for r in S.cut_lineage(twice).collect()) == [(0, 0), (1, 1)]


def test_only_the_result_stays(spark):
    made = []

    def build():
        a = S.cut_lineage(spark.range(10))
        b = S.settled(lambda: made.append(S.cut_lineage(a.withColumn("x", F.col("id") * 2))) or made[-1].where("x > 4"))
        made.extend((a, b))
        return a.join(b, "id")

    result = S.settled(build)
    assert sorted(tuple(r) for r in result.collect()) == [(i, 2 * i) for i in range(3, 10)]
    assert os.path.isdir(local(result)) and not any(os.path.exists(local(t)) for t in made)
    S.discard(result)
    assert not os.path.exists(local(result))


def test_places_need_one_exchange(spark, monkeypatch):
    rows = spark.createDataFrame([(i * 7 % 50, f"n{i}") for i in range(50)] * 2, "o long, n string").repartition(5)
    placed = ordered.place(rows.dropDuplicates(["n"]), ["o", "n"], "p")
    assert [r.o for r in placed.orderBy("p").collect()] == list(range(50))
    assert sorted(r.p for r in placed.collect()) == list(range(50))
    assert "rangepartitioning" not in placed._jdf.queryExecution().executedPlan().toString()


def test_recurring_vendors_in_one_exchange(spark):
    day = datetime(2024, 1, 1)
    rows = [(u, "GYM", c, False, 10.0 + (k == 2), 100 * u + k, day) for u in (1, 2) for k, c in enumerate(("b", "a", "b", "a"))]
    rows += [(1, "SHOP", "a", False, float(10 ** k), 50 + k, day) for k in range(4)] + [(1, "TWICE", "a", False, 5.0, 60, day)] * 2
    rows += [(None, "GYM", "a", False, 10.0, 900 + k, day) for k in range(3)]
    df = spark.createDataFrame(rows, "user_id long, vendor string, category string, money_in boolean, amount_abs double, seq long, date timestamp")
    flags = N.spending_cube(df).withColumns({"is_expense": F.lit(True), "kind": F.lit("spending")})
    found = N.recurring_vendors(flags)
    assert [tuple(r) for r in found.orderBy("user_id").collect()] == [(1, "GYM", 10.25, 4, "b", "low", 100), (2, "GYM", 10.25, 4, "b", "low", 200)]
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()  # sums, spreads and names were joined by vendor


def test_lone_directions_are_not_numbered(spark, monkeypatch):
    rows = [(f"t{i}", 1, i, "n", f"key{i % 20}", "x", i < 21 and i % 20 == 0, 5.0) for i in range(60)]
    df = spark.createDataFrame(rows, "tx_id string, user_id long, seq long, narrative string, cleaned_narrative string, predicted_category string, money_in boolean, amount double")
    counted, runs = [], T._runs
    monkeypatch.setattr(T, "_runs", lambda r: counted.append(r.count()) or runs(r))
    assert {tuple(r) for r in T.transfer_pairs(df).collect()} == {("t0", "t40")}
    assert counted == [3]  # all 60 rows were put in buckets and joined to their runs before
