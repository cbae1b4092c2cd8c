"""Registered queries for accounts, usage, jobs, sources, sinks and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from spendgrid.catalog import domain as D
from spendgrid.catalog.domain_sql import ACCOUNTS, JOBS, RAW, SUBSCRIPTIONS, TX, USERS
from spendgrid.functions import amounts as A
from spendgrid.operators import accounts as AC
from spendgrid.operators import jobs as J
from spendgrid.operators import prepare as P
from spendgrid.sources import readers as R
from spendgrid.sources import sinks as K
from spendgrid.streaming import jobs as ST
from spendgrid.session import ensure_checkpoint_dir

QUERIES = {}
ORACLES = {}


def register(name, oracle=None):
    def add(build):
        QUERIES[name] = build
        if oracle is not None:
            ORACLES[name] = "WITH " + oracle.strip()
        return build
    return add


def scratch(spark, name):
    """A new folder below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/spendgrid-{name}-{uuid.uuid4().hex}"


# --- accounts ------------------------------------------------------------------------------------------

NEWEST = SUBSCRIPTIONS + """,
newest AS (SELECT * FROM subs QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) = 1)"""


@register("latest_subscription", NEWEST + """
SELECT user_id, id AS subscription_id, status, plan, strftime(created_at, '%Y-%m-%d') AS created_at FROM newest""")
def _(spark, sf_dir):
    return AC.latest_subscription(D.subscriptions(spark, sf_dir)).withColumn("created_at", A.iso_date("created_at"))


@register("live_users", NEWEST + " SELECT user_id FROM newest WHERE status IN ('ACTIVE', 'TRIALING')")
def _(spark, sf_dir):
    return AC.live_users(D.subscriptions(spark, sf_dir))


@register("usage", "calls AS (SELECT * FROM events) SELECT user_id, count(*) AS requests_count, strftime(max(ts), '%Y-%m-%dT%H:%M:%S') AS last_used FROM calls GROUP BY user_id")
def _(spark, sf_dir):
    return AC.usage(D.api_calls(spark, sf_dir)).withColumn("last_used", A.iso_timestamp("last_used"))


@register("usage_stats", NEWEST + "," + USERS + "," + ACCOUNTS + """,
calls AS (SELECT user_id, count(*) AS n, max(ts) AS last FROM events GROUP BY user_id),
stored AS (SELECT vec_id AS user_id, count(*) AS n FROM embeddings GROUP BY vec_id)
SELECT u.user_id, u.email, coalesce(c.n, 0) AS requests_count, strftime(c.last, '%Y-%m-%dT%H:%M:%S') AS last_used,
  coalesce(s.n, 0) AS embeddings_count, x.plan AS subscription_plan, x.status AS subscription_status
FROM users u JOIN accounts a USING (user_id) LEFT JOIN calls c USING (user_id) LEFT JOIN stored s USING (user_id) LEFT JOIN newest x USING (user_id)""")
def _(spark, sf_dir):
    models = D.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("user_id"))
    stats = AC.usage_statistics(D.users(spark, sf_dir), D.accounts(spark, sf_dir), D.subscriptions(spark, sf_dir),
                                D.api_calls(spark, sf_dir), models)
    return stats.withColumn("last_used", A.iso_timestamp("last_used"))


@register("api_key_chain", NEWEST + "," + USERS + "," + ACCOUNTS + """,
calls AS (SELECT event_id AS call_id, 'key-' || user_id AS api_key FROM events)
SELECT call_id, api_key, u.user_id, a.account_id, x.status, x.plan, coalesce(x.status IN ('ACTIVE', 'TRIALING'), false) AS allowed
FROM calls LEFT JOIN users u USING (api_key) LEFT JOIN accounts a ON a.user_id = u.user_id LEFT JOIN newest x ON x.user_id = u.user_id""")
def _(spark, sf_dir):
    calls = D.api_calls(spark, sf_dir).select("call_id", F.concat(F.lit("key-"), F.col("user_id").cast("string")).alias("api_key"))
    return AC.resolve_api_keys(calls, D.users(spark, sf_dir), D.accounts(spark, sf_dir), D.subscriptions(spark, sf_dir))


@register("usage_windows", """calls AS (SELECT * FROM events)
SELECT user_id, count(*) FILTER (ts > TIMESTAMP '2024-01-30 00:00:00' AND ts <= TIMESTAMP '2024-01-31 00:00:00') AS daily,
  count(*) FILTER (ts > TIMESTAMP '2024-01-24 00:00:00' AND ts <= TIMESTAMP '2024-01-31 00:00:00') AS weekly,
  count(*) FILTER (ts > TIMESTAMP '2024-01-01 00:00:00' AND ts <= TIMESTAMP '2024-01-31 00:00:00') AS monthly FROM calls GROUP BY user_id""")
def _(spark, sf_dir):
    return AC.usage_windows(D.api_calls(spark, sf_dir), F.to_timestamp(F.lit("2024-01-31 00:00:00")))


# --- jobs ----------------------------------------------------------------------------------------------------

STATE = JOBS + """,
state AS (SELECT * FROM jobs QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY updated_at DESC, event_seq DESC) = 1)"""


@register("job_state", STATE + " SELECT job_id, user_id, status, event_seq, result_data, error FROM state")
def _(spark, sf_dir):
    return J.latest_state(D.job_events(spark, sf_dir)).drop("updated_at")


# The requester of a job is the user of its newest event; user 1 asks for every job in the second query.
STATUS = STATE + """,
seen AS (SELECT *, {denied} AS denied, status IN ('PENDING', 'PROCESSING') AS running, status = 'COMPLETED' AS done,
  status = 'FAILED' AS failed, coalesce(starts_with(result_data, '{broken'), false) AS broken FROM state)
SELECT job_id, user_id, CASE WHEN denied THEN 'error' WHEN running THEN 'processing' WHEN done AND broken THEN 'failed' WHEN done THEN 'completed'
   WHEN failed THEN 'failed' ELSE 'error' END AS client_status,
  CASE WHEN denied THEN 'Access denied to job status.' WHEN running THEN 'Job is currently ' || lower(status) || '.'
   WHEN done AND broken THEN 'Failed to parse results from completed job.' WHEN done AND result_data IS NULL THEN 'Job completed but no result data found.'
   WHEN failed THEN 'Job processing failed.' WHEN NOT done THEN 'Unknown or inconsistent job status: ' || status END AS message,
  CASE WHEN denied THEN 403 WHEN done AND broken THEN 500 WHEN NOT running AND NOT done AND NOT failed THEN 500 END AS error_code,
  CASE WHEN NOT denied AND done AND NOT broken THEN result_data END AS payload,
  CASE WHEN NOT denied AND failed THEN coalesce(error, 'No error details provided.') END AS error_details FROM seen"""


@register("job_status", STATUS.replace("{denied}", "false"))
def _(spark, sf_dir):
    return J.status_view(J.latest_state(D.job_events(spark, sf_dir)))


@register("job_status_owner", STATUS.replace("{denied}", "user_id <> 1"))
def _(spark, sf_dir):
    return J.status_view(J.latest_state(D.job_events(spark, sf_dir)), F.lit(1).cast("long"))


# --- sources ----------------------------------------------------------------------------------------------------

@register("labelled_upload", RAW + r"""
SELECT tx_id, description, category, TRY_CAST(nullif(regexp_extract(regexp_replace(amount_text, '[^0-9.-]', '', 'g'), '^-?(\d+\.?\d*|\.\d+)'), '') AS DOUBLE) AS amount
FROM raw WHERE length(description) > 0 AND length(category) > 0""")
def _(spark, sf_dir):
    upload = D.raw_transactions(spark, sf_dir).select("tx_id", F.col("description").alias(" Description "),
                                                      F.col("Category").alias("CATEGORY"), F.col("`Amount Spent`"))
    return R.labelled_rows(upload).select("tx_id", "description", "category", "amount")


@register("distinct_categories", TX + " SELECT DISTINCT category FROM tx WHERE category IS NOT NULL")
def _(spark, sf_dir):
    upload = D.transactions(spark, sf_dir).select("description", "category")
    return R.distinct_categories(R.labelled_rows(upload))


@register("scoring_upload", RAW + r""",
p AS (SELECT *, TRY_CAST(nullif(regexp_extract(regexp_replace(amount_text, '[^0-9.-]', '', 'g'), '^-?(\d+\.?\d*|\.\d+)'), '') AS DOUBLE) AS parsed FROM raw)
SELECT tx_id, narrative AS description, parsed AS amount, parsed >= 0 AS money_in, category AS code FROM p""")
def _(spark, sf_dir):
    upload = D.raw_transactions(spark, sf_dir).select("tx_id", F.col("narrative").alias("Details"),
                                                      F.col("`Amount Spent`").alias("Amount"), F.col("Category").alias("Code"))
    return R.scoring_rows(upload).select("tx_id", "description", "amount", "money_in", "code")


@register("merchant_upload", RAW + """
SELECT tx_id, coalesce(nullif(description, ''), nullif(narrative, '')) AS description, category FROM raw
WHERE coalesce(nullif(description, ''), nullif(narrative, '')) IS NOT NULL AND nullif(category, '') IS NOT NULL""")
def _(spark, sf_dir):
    upload = D.raw_transactions(spark, sf_dir).select("tx_id", "description", F.col("narrative").alias("Merchant"), "Category")
    return R.merchant_rows(upload)


@register("statement_rows", """
s AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_returnflag, l_linestatus, p_name FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber) AS tx_id,
  concat_ws(' ', nullif(p_name, ''), CASE WHEN l_linestatus = 'O' THEN 'OPEN' END, nullif(CASE l_returnflag WHEN 'N' THEN '' ELSE l_returnflag END, '')) AS description FROM s""")
def _(spark, sf_dir):
    line, part = D.table(spark, sf_dir, "lineitem"), D.table(spark, sf_dir, "part")
    rows = line.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")]).alias("tx_id"),
        F.concat(F.lit(" "), F.col("p_name"), F.lit(" ")).alias("Details"),
        F.when(F.col("l_linestatus") == "O", "OPEN").alias("Particulars"),
        F.when(F.col("l_returnflag") == "N", "  ").otherwise(F.col("l_returnflag")).alias("Code"))
    return R.statement_rows(rows).select("tx_id", "description")


@register("combine_code", TX + """
SELECT tx_id, trim(concat_ws(' ', description, category)) AS combined FROM tx WHERE trim(concat_ws(' ', description, category)) <> ''""")
def _(spark, sf_dir):
    rows = D.transactions(spark, sf_dir).select("tx_id", P.combine_code(F.col("description"), F.col("category")).alias("combined"))
    return rows.where(F.col("combined").isNotNull())


@register("request_elements", TX + """
SELECT request_id, description, CASE WHEN seq % 3 = 0 THEN NULL ELSE money_in END AS money_in, CASE WHEN seq % 3 = 0 THEN NULL ELSE amount END AS amount FROM tx""")
def _(spark, sf_dir):
    rows = D.transactions(spark, sf_dir)
    text = F.to_json(F.struct("description", "money_in", "amount"))
    bare = F.get_json_object(F.to_json(F.struct(F.array("description").alias("d"))), "$.d")
    element = F.when(F.col("seq") % 3 == 0, F.substring(bare, F.lit(2), F.length(bare) - 2)).otherwise(text)
    requests = rows.groupBy("request_id").agg(F.concat(F.lit("["), F.array_join(F.array_sort(F.collect_list(element)), ","), F.lit("]")).alias("transactions"))
    return R.request_elements(requests).drop("index")


@register("analytics_request", TX + """
SELECT request_id AS user_id, description, coalesce(category, 'Unknown') AS category, amount, coalesce(money_in, false) AS money_in FROM tx""")
def _(spark, sf_dir):
    rows = D.transactions(spark, sf_dir).select("request_id", F.struct(
        F.col("description"), F.lit(None).cast("string").alias("Narrative"), F.lit(None).cast("double").alias("amount"),
        F.col("amount").alias("Amount_Spent"), F.lit(None).cast("string").alias("category"), F.col("category").alias("cat"),
        A.iso_timestamp("date").alias("date"), F.lit(None).cast("string").alias("transaction_date"), F.col("money_in"),
        F.lit("bank").alias("Source")).alias("t"))
    requests = rows.groupBy(F.col("request_id").alias("user_id")).agg(F.collect_list("t").alias("transactions"))
    return P.prepare_transactions(R.explode_analytics(requests)).select("user_id", "description", "category", "amount", "money_in")


# --- sinks ----------------------------------------------------------------------------------------------------------

@register("writeback", TX + """
SELECT tx_id, coalesce(nullif(category, ''), '') AS category_out, amount AS confidence_out,
  CASE WHEN money_in THEN 'IN' WHEN NOT money_in THEN 'OUT' ELSE '' END AS direction_out FROM tx""")
def _(spark, sf_dir):
    results = D.transactions(spark, sf_dir).select("tx_id", "category", F.col("amount").alias("score"), "money_in")
    return K.sheet_columns(results)


@register("versioned_results", JOBS + """,
newest AS (SELECT job_id, event_seq, status, error FROM jobs QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY event_seq DESC) = 1)
SELECT job_id, event_seq AS version, status, error FROM newest""")
def _(spark, sf_dir):
    path = scratch(spark, "results")
    K.append_results(D.job_events(spark, sf_dir).select("job_id", "event_seq", "status", "error"), path, "job_id", F.col("event_seq"))
    newest = K.read_results(spark, path, "job_id")
    return newest.select("job_id", "version", F.get_json_object("results", "$.status").alias("status"),
                         F.get_json_object("results", "$.error").alias("error"))


@register("stored_models", "m AS (SELECT o_custkey AS user_id, o_orderkey AS item_id, o_totalprice AS scale FROM orders) SELECT * FROM m")
def _(spark, sf_dir):
    rows = D.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("item_id"),
                                                   F.col("o_totalprice").alias("scale"))
    path = scratch(spark, "models")
    K.write_models(rows.withColumn("scale", F.lit(0.0)), path, 16)
    K.write_models(rows, path, 16)
    return K.read_models(spark, path)


# --- streams --------------------------------------------------------------------------------------------------------

def _event_stream(spark, sf_dir):
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


@register("stream_job_state", STATE + " SELECT job_id, status, event_seq FROM state")
def _(spark, sf_dir):
    stream = _event_stream(spark, sf_dir)
    status = (F.when(F.col("event_type") == "signup", "PENDING").when(F.col("event_type") == "view", "PROCESSING")
              .when(F.col("event_type") == "purchase", "COMPLETED").when(F.col("event_type") == "error", "FAILED").otherwise("STALLED"))
    events = stream.select(F.concat(F.lit("job-"), F.col("user_id").cast("string"), F.lit("-"), F.get_json_object("props", "$.k")).alias("job_id"),
                           F.col("ts").alias("updated_at"), F.col("event_id").alias("event_seq"), status.alias("status"))
    path = scratch(spark, "job-state")
    ST.run_updates(ST.job_state_stream(events), f"{path}/out", f"{path}/checkpoint", ["job_id"])
    return ST.newest_updates(spark, f"{path}/out", ["job_id"]).select("job_id", "status", "event_seq")


@register("stream_usage", "calls AS (SELECT * FROM events) SELECT strftime(ts, '%Y-%m-%d') AS day, user_id, count(*) AS requests FROM calls GROUP BY ALL")
def _(spark, sf_dir):
    calls = _event_stream(spark, sf_dir).select(F.col("ts").alias("called_at"), "user_id")
    path = scratch(spark, "usage")
    ST.run_updates(ST.usage_stream(calls), f"{path}/out", f"{path}/checkpoint", ["day", "user_id"])
    return ST.newest_updates(spark, f"{path}/out", ["day", "user_id"]).withColumn("day", A.iso_date("day"))


# --- statements -----------------------------------------------------------------------------------------------------

@register("sql_scan", """
calls AS (SELECT user_id, event_type, value FROM events WHERE event_type <> 'error' AND value >= 10)
SELECT user_id, event_type, count(*) AS calls, max(value) AS most FROM calls GROUP BY ALL""")
def _(spark, sf_dir):
    return R.sql_rows(spark, "SELECT user_id, event_type, count(*) AS calls, max(value) AS most FROM {events} "
                      "WHERE event_type <> :kind AND value >= :least GROUP BY user_id, event_type",
                      {"kind": "error", "least": 10.0}, events=D.table(spark, sf_dir, "events"))


@register("folded_results", """
rows AS (SELECT event_id % 500 AS job_id, event_id AS event_seq, event_type AS status FROM events)
SELECT job_id, max(event_seq) AS version, '{"event_seq":' || max(event_seq) || ',"status":"' || arg_max(status, event_seq) || '"}' AS results FROM rows GROUP BY job_id""")
def _(spark, sf_dir):
    # eight appends, folded whenever three batches wait
    path = scratch(spark, "folded")
    rows = D.table(spark, sf_dir, "events").select((F.col("event_id") % 500).alias("job_id"), F.col("event_id").alias("event_seq"), F.col("event_type").alias("status"))
    for part in range(8):
        K.append_results(rows.where(F.pmod(F.xxhash64("event_seq"), F.lit(8)) == part), path, "job_id", F.col("event_seq"), fold_after=2)
    return K.read_results(spark, path, "job_id")
