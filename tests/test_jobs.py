"""Sources, sinks, streams, reports and the registered queries."""

import datetime as dt
import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from spendgrid import schema
from spendgrid.catalog import domain as D
from spendgrid.catalog.analytics_queries import QUERIES as ANALYTICS
from spendgrid.operators import analytics as N
from spendgrid.operators import prepare as P
from spendgrid.plans import analytics as R
from spendgrid.plans import train as TR
from spendgrid.sources import readers, sinks, versions
from spendgrid.streaming import jobs as ST

SMALL = "/root/testdata/sf0.001"


def test_csv_sources(spark, tmp_path):
    train = tmp_path / "train.csv"
    train.write_text("Narrative , CATEGORY,Amount Spent,Other\nshop,Food,\"$1,200.50\",x\n,Food,1,x\nbus,,2,x\ncar,Fuel,abc,x\n")
    rows = readers.labelled_rows(readers.read_csv(spark, str(train)))
    assert sorted((r.description, r.category, r.amount, r.money_in) for r in rows.collect()) == [
        ("car", "Fuel", None, None), ("shop", "Food", 1200.5, True)]
    score = tmp_path / "score.csv"
    score.write_text("Details;Amount;Code\nshop;-3;C1\n")
    assert [tuple(r) for r in readers.scoring_rows(readers.read_csv(spark, str(score), sep=";")).collect()] == [("shop", -3.0, "C1", False)]
    merchants = tmp_path / "m.csv"
    merchants.write_text("description,Merchant,category\n,Kmart,Retail\nBP,x,Fuel\n,,Retail\n")
    got = readers.merchant_rows(readers.read_csv(spark, str(merchants))).collect()
    assert sorted(tuple(r) for r in got) == [("BP", "Fuel"), ("Kmart", "Retail")]
    bank = tmp_path / "b.csv"
    bank.write_text("row,Details,Particulars,Code\n1, a ,,c\n2,,,\n3,x,y,z\n")
    got = readers.statement_rows(readers.read_csv(spark, str(bank)), limit=2, order="row").collect()
    assert [r.description for r in got] == ["a c"]
    names = tmp_path / "d.csv"
    names.write_text("ENTITY_NAME\n Kmart \n\"\"\nkmart\nZ Energy\n")
    assert sorted(r[0] for r in readers.business_dictionary(spark, str(names)).collect()) == ["kmart", "z energy"]
    with pytest.raises(ValueError):
        readers.labelled_rows(spark.createDataFrame([("a",)], "nothing string"))


def test_json_sources(spark, tmp_path):
    requests = spark.createDataFrame([(1, json.dumps(["plain", {"description": "d", "amount": 2.5, "money_in": True}, "{odd", {"description": "e"}])),
                                      (2, "[broken")], "id int, transactions string")
    got = [tuple(r) for r in readers.request_elements(requests).orderBy("index").collect()]
    assert got == [(1, 0, "plain", None, None), (1, 1, "d", True, 2.5), (1, 2, "{odd", None, None), (1, 3, "e", None, None)]
    body = tmp_path / "r.json"
    body.write_text(json.dumps({"user_id": 7, "transactions": [
        {"description": "Salary", "amount": 100.0, "category": "Income", "date": "2024-05-01T10:00:00Z", "money_in": True},
        {"Narrative": "Shop", "Amount_Spent": -5.0, "cat": "Food", "transaction_date": "2024-05-02"}]}))
    rows = P.prepare_transactions(readers.analytics_requests(spark, str(body))).orderBy("seq").collect()
    assert [(r.description, r.amount, r.category, r.money_in) for r in rows] == [("Salary", 100.0, "Income", True), ("Shop", -5.0, "Food", False)]
    assert rows[0].date == dt.datetime(2024, 5, 1, 10)
    names = tmp_path / "c.json"
    names.write_text(json.dumps(["A", "B"], indent=1))
    assert [tuple(r) for r in readers.category_list(spark, str(names)).collect()] == [(0, "A", "A"), (1, "B", "B")]


def test_prepare_rules(spark):
    df = spark.createDataFrame([("EFTPOS SHOP", 5.0, "x")], "desc string, amount double, cat string")
    r = P.prepare_transactions(df, now=F.lit(dt.datetime(2024, 6, 1))).first()
    assert r.money_in is True and r.vendor == "SHOP" and (r.month, r.day_of_week, r.is_weekend) == (6, 5, True)
    df = spark.createDataFrame([(5.0, None), (-5.0, None), (1.0, False)], "amount double, money_in boolean").withColumns(
        {"description": F.lit("d"), "category": F.lit("")})
    plain = [r.money_in for r in P.prepare_transactions(df).collect()]
    inferred = [r.money_in for r in P.prepare_transactions(df, infer_missing_direction=True).collect()]
    assert plain == [False, False, False] and inferred == [True, False, False]
    with pytest.raises(ValueError):
        P.prepare_transactions(df.drop("amount"))


def test_model_store(spark, tmp_path):
    path = str(tmp_path / "models")
    first = spark.createDataFrame([(u, i, u * 10 + i) for u in range(40) for i in range(3)], "user_id long, item_id long, v long")
    sinks.write_models(first, path, buckets=8)
    sinks.write_models(spark.createDataFrame([(3, 0, -1)], "user_id long, item_id long, v long"), path)  # the store's own number
    stored = sinks.read_models(spark, path)
    assert stored.count() == 39 * 3 + 1
    assert [tuple(r) for r in sinks.read_models(spark, path, [3]).collect()] == [(3, 0, -1)]
    assert sinks.read_models(spark, path, list(range(40))).count() == 39 * 3 + 1
    plan = sinks.read_models(spark, path, [3])._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "user_bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_file_sinks(spark, tmp_path):
    results = spark.createDataFrame([(2, "", "Food", 0.5, True), (1, "Fuel", "x", 0.9, None)],
                                    "seq long, predicted_category string, category string, confidence double, money_in boolean")
    sinks.write_sheet(results, str(tmp_path / "sheet"))
    rows = spark.read.csv(str(tmp_path / "sheet"), header=True).orderBy("seq").collect()
    assert [(r.category_out, r.confidence_out, r.direction_out) for r in rows] == [("Fuel", "0.9", None), ("Food", "0.5", "IN")]
    nested = spark.createDataFrame([("a", [1, 2])], "k string, v array<int>")
    sinks.write_csv(nested, str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).first().v == "[1,2]"
    sinks.write_json(nested, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).first().v == [1, 2]
    events = spark.createDataFrame([("j", 1)], "job_id string, n int")
    sinks.append_job_events(events, str(tmp_path / "jobs"))
    sinks.append_job_events(events, str(tmp_path / "jobs"))
    assert versions.read(spark, str(tmp_path / "jobs")).count() == 2


def test_stream_scoring_equals_batch(spark, tmp_path):
    tx = D.transactions(spark, SMALL)
    one = tx.where(F.col("user_id") < 20)
    model = TR.train(one.where(F.col("category").isNotNull()), quantise=False)
    model.write.parquet(str(tmp_path / "model"))
    model = spark.read.parquet(str(tmp_path / "model"))
    one.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(one.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    ST.score_stream(stream, model, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    from spendgrid.plans.classify import classify
    batch = {(r.tx_id, r.narrative): r.predicted_category for r in classify(one, model, transfers=False).collect()}
    streamed = {(r.tx_id, r.narrative): r.predicted_category for r in spark.read.parquet(str(tmp_path / "out") + "/batch=*").collect()}
    assert streamed == batch and batch


def test_report_tables(spark):
    tx = D.transactions(spark, SMALL)
    tables = R.report(tx, excluded=["Cash"])
    assert {"vendors", "anomalies", "subscriptions", "subscription_summary", "opportunities", "cash_flow", "categories_found"} <= set(tables)
    assert tables["vendors"].where(F.col("most_common_category") == "Cash").count() == 0
    assert set(R.report(tx, analyses=["cash_flow_prediction"])) == {"analysis_period", "categories_found", "cash_flow", "cash_flow_insights"}
    with pytest.raises(ValueError):
        R.report(tx, analyses=["nothing"])


def test_vendor_containment_is_literal(spark):
    vendors = spark.createDataFrame([(1, "SPOTIFY AB"), (1, "MY SPOTIFY"), (1, "A.B"), (1, "AXB"), (2, "SPOTIFY")], "user_id long, vendor string")
    wanted = spark.createDataFrame([(1, "spotify"), (1, "A.B"), (1, "A")], "user_id long, vendor string")
    got = sorted((r.wanted, r.vendor) for r in N.vendors_containing(vendors, wanted).collect())
    assert got == [("A", "A.B"), ("A", "AXB"), ("A", "SPOTIFY AB"), ("A.B", "A.B"), ("spotify", "MY SPOTIFY"), ("spotify", "SPOTIFY AB")]


def test_registered_queries(spark):
    queries, oracles = entry_module.queries(), entry_module.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 90
    assert entry_module.entry(spark).count() > 0


def test_schemas():
    assert schema.LABELLED["description"].nullable is False
    assert "transactions" in schema.ANALYTICS_REQUEST.names


def test_folds_keep_answers_and_bound_files(spark, tmp_path):
    path = str(tmp_path / "versions")
    with pytest.raises(FileNotFoundError):
        versions.read(spark, path)
    want = {}
    for batch in range(7):
        rows = [(k, batch * 10 + k % 3, f"s{batch}-{k}") for k in range(batch, 20 + batch)]
        want |= {k: (v, s) for k, v, s in rows if k not in want or (v, s) > want[k]}
        sinks.append_results(spark.createDataFrame(rows, "k long, v long, s string"), path, "k", F.col("v"), fold_after=2)
        got = {r.k: r.version for r in sinks.read_results(spark, path, "k").collect()}
        assert got == {k: v for k, (v, _) in want.items()}
        assert len(versions.waiting(spark, path)) <= 3
    folders = [p for p in (tmp_path / "versions").glob("*/*") if p.is_dir()]
    assert len(folders) <= 2 * 3 + 4 + 3
    # a fold whose list of batches was never written does not count, and a retried batch replaces itself
    before = sorted(map(tuple, sinks.read_results(spark, path, "k").collect()))
    spark.createDataFrame([(1, 999, "x")], "k long, version long, results string").write.parquet(f"{path}/base/fold=99")
    assert sorted(map(tuple, sinks.read_results(spark, path, "k").collect())) == before
    one = spark.createDataFrame([(500, 1, "y")], "k long, version long, results string")
    assert versions.append(one, path, "again") == versions.append(one, path, "again")
    assert versions.read(spark, path).where("k = 500").count() == 1


def test_finished_jobs_leave_the_state(spark, tmp_path):
    def write(number, rows):
        frame = spark.createDataFrame([(j, datetime(2024, 1, d, h), s, st) for j, d, h, s, st in rows], "job_id string, updated_at timestamp, event_seq long, status string")
        frame.coalesce(1).write.parquet(str(tmp_path / "in" / f"part{number}"))

    def run():
        stream = spark.readStream.schema("job_id string, updated_at timestamp, event_seq long, status string").option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        query = ST.run_updates(ST.job_state_stream(stream), str(tmp_path / "out"), str(tmp_path / "checkpoint"), ["job_id"], fold_after=1)
        sizes = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
        return sizes[-1], {r.job_id: r.status for r in ST.newest_updates(spark, str(tmp_path / "out"), ["job_id"]).collect()}

    write(1, [("a", 1, 1, 1, "PENDING"), ("a", 1, 3, 3, "COMPLETED"), ("a", 1, 2, 2, "PROCESSING"), ("b", 1, 1, 4, "PENDING")])
    size, now = run()
    assert size == 2 and now == {"a": "COMPLETED", "b": "PENDING"}
    write(2, [("c", 5, 1, 5, "PENDING")])
    run()
    write(3, [("a", 1, 4, 9, "PROCESSING"), ("b", 5, 2, 6, "PROCESSING")])  # the first is far behind the watermark
    size, now = run()
    assert now == {"a": "COMPLETED", "b": "PROCESSING", "c": "PENDING"} and size == 2  # a is gone


def test_jobs_share_few_states(spark, tmp_path):
    def write(number, rows):
        spark.createDataFrame([(j, datetime(2024, 1, day, hour), n, s) for j, day, hour, n, s in rows],
                              "job_id string, updated_at timestamp, event_seq long, status string").coalesce(1).write.parquet(str(tmp_path / "in" / f"part={number}"))

    def run():
        stream = spark.readStream.schema("job_id string, updated_at timestamp, event_seq long, status string").option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        query = ST.run_updates(ST.job_state_stream(stream, slots=4), str(tmp_path / "out"), str(tmp_path / "checkpoint"), ["job_id"])
        sizes = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
        return sizes[-1], {r.job_id: (r.status, r.event_seq) for r in ST.newest_updates(spark, str(tmp_path / "out"), ["job_id"]).collect()}

    jobs = [f"job-{i}" for i in range(200)]
    write(1, [(j, 1, 2, 2, "COMPLETED" if i % 2 else "PROCESSING") for i, j in enumerate(jobs)] + [(j, 1, 1, 1, "PENDING") for j in jobs] + [(None, 1, 1, None, "PENDING")])
    size, now = run()
    assert size == 4  # one state a job before: 201
    assert now == {j: ("COMPLETED" if i % 2 else "PROCESSING", 2) for i, j in enumerate(jobs)} | {None: ("PENDING", None)}
    write(2, [("late", 5, 1, 3, "PENDING")])
    run()
    # a job that has left begins again, one that has not moves on, and one behind the watermark stays
    write(3, [("job-1", 5, 2, 9, "PENDING"), ("job-2", 5, 2, 9, "FAILED"), ("job-4", 1, 3, 9, "FAILED")])
    size, now = run()
    assert size == 4 and now["job-1"] == ("PENDING", 9) and now["job-2"] == ("FAILED", 9)
    assert now["job-4"] == ("PROCESSING", 2) and now["job-3"] == ("COMPLETED", 2)


def test_sql_rows_and_bounds(spark):
    df = spark.createDataFrame([(1, "x'y"), (5, "z")], "id long, name string")
    assert [r.id for r in readers.sql_rows(spark, "SELECT id FROM {t} WHERE name = :n", {"n": "x'y"}, t=df).collect()] == [1]
    assert readers.partition_bounds(df, "id") == (1, 6) and readers.partition_bounds(df.limit(0), "id") == (0, 0)


def test_subscriptions_join_few_pieces(spark):
    names = ["ACME", "ACME GYM", "The acme shop", "GYM", "A", "ZOO CLUB", "OTHER NAME LONG"]
    vendors = spark.createDataFrame([(u, v, i) for u in range(40) for i, v in enumerate(names)] + [(None, "ACME", 9)], "user_id long, vendor string, spent int")
    wanted = spark.createDataFrame([(1, "acme"), (1, "ZOO"), (2, "A"), (3, "OTHER NAME LONG"), (3, "GYM"), (None, "ACME")], "user_id long, vendor string")
    want = sorted((u, w, v) for u, w in ((1, "acme"), (1, "ZOO"), (2, "A"), (3, "OTHER NAME LONG"), (3, "GYM")) for v in names if w.upper() in v.upper())
    assert sorted((r.user_id, r.wanted, r.vendor) for r in N.vendors_containing(vendors, wanted).collect()) == want
    heads = wanted.select("user_id", F.substring(F.upper("vendor"), 1, 3).alias("_gram"))
    # every piece of every name of every user met the join before: 40 users times 7 names times 1 to 42 pieces
    assert N.vendor_pieces(vendors, heads).count() <= 4 * len(names)


def test_outliers_read_written_rows(spark):
    for name in ("outliers", "outliers_excluding", "union_anomalies", "anomaly_insights"):
        plan = ANALYTICS[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "Relation [" not in plan and "(?iUd)" not in plan  # rows were built, and vendors found, for the cube and again


def test_vendors_once_a_text(spark):
    texts = ["EFTPOS POSTAL SHOP", "EFTPOS POSTAL SHOP", "PAK N SAVE", "", None, "   ", None]
    df = spark.createDataFrame([(i, t, 1.0, "c", True, dt.datetime(2024, 6, 1)) for i, t in enumerate(texts)],
                               "seq long, description string, amount double, category string, money_in boolean, date timestamp")
    got = {r.seq: r.vendor for r in P.prepared_once(df).collect()}
    assert got == {r.seq: r.vendor for r in P.prepare_transactions(df).collect()} and len(got) == len(texts)
