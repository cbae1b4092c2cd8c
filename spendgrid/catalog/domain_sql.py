"""The domain tables of :mod:`spendgrid.catalog.domain` as SQL text for the oracle."""

from __future__ import annotations

from spendgrid.catalog.domain import TYPE_CATEGORIES



def rounded(expression: str, places: int = 2) -> str:
    """Round the binary value half to even, in plain double arithmetic."""
    x, f = f"CAST({expression} AS DOUBLE)", f"{10 ** places}.0::DOUBLE"
    high = f"({x} * 134217729.0::DOUBLE - ({x} * 134217729.0::DOUBLE - {x}))"
    error = f"(({high} * {f} - {x} * {f}) + ({x} - {high}) * {f})"
    below = f"floor({x} * {f})"
    return (f"(CASE WHEN {x} * {f} - {below} = 0.5 THEN CASE WHEN {error} > 0 THEN {below} + 1 WHEN {error} < 0 THEN {below} "
            f"WHEN {below}::BIGINT % 2 = 0 THEN {below} ELSE {below} + 1 END ELSE round({x} * {f}) END / {f})")


_TYPES = " ".join(f"WHEN '{kind}' THEN '{category}'" for kind, category in TYPE_CATEGORIES)

TX = f"""
tx AS MATERIALIZED (
  SELECT concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber) AS tx_id,
    o_custkey AS user_id, (l_orderkey * 8 + l_linenumber) * 1024 + l_partkey % 1024 AS seq,
    l_shipdate + to_hours(l_linenumber * 3) AS date,
    CASE WHEN l_linenumber = 1 THEN 'EFTPOS ' || CASE l_suppkey % 5 WHEN 0 THEN 'WOOLWORTHS' WHEN 1 THEN 'COUNTDOWN'
           WHEN 2 THEN 'NEW WORLD' WHEN 3 THEN 'PAK N SAVE' ELSE 'FOUR SQUARE' END || ' QUEENSTREET NZ'
         WHEN l_linenumber = 2 THEN '4835-****-****-' || lpad(CAST(l_orderkey % 10000 AS VARCHAR), 4, '0') || ' Df ' || upper(p_name) || ' AUCKLAND'
         WHEN l_linenumber = 3 AND l_linestatus = 'O' THEN 'The ' || upper(p_name) || ' Ltd https://shop.example.com/a1'
         WHEN l_linenumber = 3 THEN upper(p_name) || ' STORE ' || CAST(l_partkey % 1000 AS VARCHAR) || ' AU'
         WHEN l_linenumber = 4 THEN 'VISA PURCHASE ' || upper(p_name) || ' REF' || CAST(l_orderkey + 100000 AS VARCHAR)
         WHEN l_linenumber = 5 THEN 'DD STREAMING ' || upper(split_part(p_name, ' ', -1))
         WHEN l_linenumber = 6 AND l_returnflag = 'R' THEN 'SALARY ACME PAYROLL ' || CAST(l_suppkey AS VARCHAR)
         WHEN l_linenumber = 6 THEN 'ATM WITHDRAWAL ' || upper(p_name)
         ELSE 'TRANSFER TO SAVINGS ' || upper(split_part(p_name, ' ', -1)) END AS description,
    CASE WHEN l_returnflag = 'N' THEN NULL WHEN l_linenumber = 1 THEN 'Groceries'
         WHEN l_linenumber = 5 AND l_returnflag = 'R' THEN 'Payroll' WHEN l_linenumber = 5 THEN 'Utility'
         WHEN l_linenumber = 6 AND l_returnflag = 'R' THEN 'Salary' WHEN l_linenumber = 6 THEN 'Cash'
         WHEN l_linenumber = 7 THEN 'Transfer'
         ELSE CASE p_type {_TYPES} END END AS category,
    CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE -1.0 END::DOUBLE * (
      CASE WHEN l_linenumber = 1 THEN 20 + CAST(l_quantity AS BIGINT) * 0.75::DOUBLE
           WHEN l_linenumber = 5 THEN 12.5::DOUBLE + (CAST(l_quantity AS BIGINT) % 2) * 0.25::DOUBLE
           WHEN l_linenumber = 6 AND l_returnflag = 'R' THEN 2000.0::DOUBLE + (l_suppkey % 10) * 100
           WHEN l_linenumber = 6 THEN 20.0::DOUBLE * (1 + CAST(l_quantity AS BIGINT) % 10)
           WHEN l_linenumber = 7 THEN 10.0::DOUBLE * (1 + CAST(l_quantity AS BIGINT) % 10)
           ELSE ((CAST(round(l_extendedprice * 100) AS BIGINT) * (100 - CAST(round(l_discount * 100) AS BIGINT))) // 250000) * 0.25::DOUBLE
      END) AS amount,
    CASE WHEN l_returnflag = 'R' THEN true WHEN l_returnflag = 'A' AND l_linenumber = 2 THEN NULL ELSE false END AS money_in,
    l_orderkey AS request_id
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey
)"""

RAW = TX + r""",
raw0 AS (SELECT *, (seq // 1024) % 8 AS spelling, abs(amount) AS size, CAST(floor(abs(amount)) AS BIGINT) AS whole FROM tx),
raw1 AS (SELECT *, lpad(CAST(CAST(round((size - whole) * 100) AS BIGINT) AS VARCHAR), 2, '0') AS cents FROM raw0),
raw2 AS (SELECT *, whole || '.' || cents AS plain,
   CASE WHEN whole >= 1000 THEN (whole // 1000) || ',' || lpad(CAST(whole % 1000 AS VARCHAR), 3, '0') || '.' || cents
        ELSE whole || '.' || cents END AS grouped FROM raw1),
raw AS (SELECT tx_id, user_id, seq, CASE WHEN spelling < 4 THEN description END AS description,
   CASE WHEN spelling >= 4 THEN description END AS narrative,
   CASE spelling WHEN 1 THEN '$' || grouped WHEN 2 THEN '(' || grouped || ')' WHEN 3 THEN ' -' || plain || ' '
        WHEN 4 THEN 'n/a' WHEN 5 THEN NULL WHEN 6 THEN '$(' || grouped || ')' ELSE plain END AS amount_text,
   category, CASE WHEN spelling = 7 THEN 'not a date' ELSE strftime(date, '%Y-%m-%dT%H:%M:%SZ') END AS date_text,
   money_in FROM raw2)"""

SUBSCRIPTIONS = """
subs AS (SELECT o_orderkey AS id, o_custkey AS user_id,
   CASE o_orderstatus WHEN 'O' THEN 'ACTIVE' WHEN 'P' THEN 'TRIALING' ELSE 'CANCELED' END AS status,
   o_orderpriority AS plan, o_orderdate AS created_at FROM orders)"""

USERS = """
users AS (SELECT c_custkey AS user_id, 'key-' || c_custkey AS api_key,
   lower(c_mktsegment) || c_custkey || '@example.com' AS email FROM customer)"""

ACCOUNTS = """
accounts AS (SELECT c_custkey + 1000000 AS account_id, c_custkey AS user_id, c_mktsegment AS provider
   FROM customer WHERE c_acctbal >= 0)"""

JOBS = """
jobs0 AS (SELECT 'job-' || user_id || '-' || (props->>'$.k') AS job_id, user_id, ts AS updated_at, event_id, props,
   CASE event_type WHEN 'signup' THEN 'PENDING' WHEN 'view' THEN 'PROCESSING' WHEN 'purchase' THEN 'COMPLETED'
        WHEN 'error' THEN 'FAILED' ELSE 'STALLED' END AS status FROM events),
jobs AS (SELECT job_id, user_id, status, updated_at, event_id AS event_seq,
   CASE WHEN status = 'COMPLETED' THEN CASE event_id % 10 WHEN 0 THEN '{broken' WHEN 1 THEN NULL ELSE props END END AS result_data,
   CASE WHEN status = 'FAILED' THEN 'code ' || event_id END AS error FROM jobs0)"""

NAMES = "names AS (SELECT p_name AS name, min(p_partkey) AS first_seq FROM part GROUP BY p_name)"

MODEL = """
model AS (SELECT 0::BIGINT AS user_id, vec_id AS item_id, 'category-' || label AS category,
   embedding::DOUBLE[] AS vector FROM embeddings)"""

BLENDED = """
blended AS (SELECT 0::BIGINT AS user_id, a.vec_id AS tx_id,
   list_transform(list_zip(a.embedding::DOUBLE[], coalesce(b.embedding, a.embedding)::DOUBLE[]), lambda p: p[1] + p[2]) AS vector
   FROM embeddings a LEFT JOIN embeddings b ON b.vec_id = a.vec_id + 1)"""
