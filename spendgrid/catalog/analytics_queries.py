"""Registered queries for request preparation and spending analytics, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from spendgrid import fixed_values as fv
from spendgrid.catalog import domain as D
from spendgrid.catalog.domain_sql import RAW, TX, rounded as R
from spendgrid.functions import amounts as A
from spendgrid.functions import text as X
from spendgrid.operators import analytics as N
from spendgrid.operators import prepare as P
from spendgrid.session import cut_lineage, settled

QUERIES = {}
ORACLES = {}


def _quote(words):
    return ", ".join(f"'{w}'" for w in words)


def _any(expression, words):
    return "(" + " OR ".join(f"contains(lower({expression}), '{w}')" for w in words) + ")"


VENDOR_SQL = (
    "CASE WHEN {c} IS NULL OR {c} = '' THEN 'Unknown' ELSE (SELECT CASE "
    "WHEN len(w) > 0 THEN array_to_string(w[1:2], ' ') "
    r"WHEN regexp_extract(t, '\S+') <> '' THEN upper(regexp_extract(t, '\S+')) ELSE 'UNKNOWN' END FROM ("
    "SELECT t, list_filter(regexp_extract_all(upper(t), '" + fv.VENDOR_WORD + "'), lambda x: x NOT IN ("
    + _quote(fv.VENDOR_STOP_WORDS) + ")) AS w FROM (SELECT regexp_replace(regexp_replace(trim({c}), '"
    + fv.VENDOR_PREFIX + "', '', 'i'), '" + fv.VENDOR_SUFFIX + "', '', 'i') AS t))) END")

PREP = TX + """,
vendors0 AS MATERIALIZED (SELECT description, """ + VENDOR_SQL.replace("{c}", "description") + """ AS vendor
   FROM (SELECT DISTINCT description FROM tx)),
prep AS MATERIALIZED (
  SELECT tx_id, user_id, seq, date, tx.description, coalesce(nullif(category, ''), 'Unknown') AS category, amount,
    abs(amount) AS amount_abs, coalesce(money_in, false) AS money_in, vendor,
    month(date) AS month, isodow(date) - 1 AS day_of_week, isodow(date) >= 6 AS is_weekend, request_id
  FROM tx JOIN vendors0 USING (description))"""

KINDS = PREP + f""",
kinds AS (SELECT user_id, category, rows, rows_in, CASE
    WHEN {_any('category', fv.INCOME_KEYWORDS)} THEN 'income'
    WHEN {_any('category', fv.TRANSFER_KEYWORDS)} THEN 'transfer'
    WHEN rows_in / rows > 0.7 THEN 'income' ELSE 'spending' END AS kind
  FROM (SELECT user_id, category, count(*) AS rows, sum(CASE WHEN money_in THEN 1 ELSE 0 END)::BIGINT AS rows_in
        FROM prep GROUP BY ALL)),
flagged AS MATERIALIZED (SELECT p.*, k.kind, (NOT money_in OR kind = 'spending') AS is_expense, (money_in OR kind = 'income') AS is_income
  FROM prep p JOIN kinds k USING (user_id, category))"""

DAYS = "floor((epoch_us({b}) - epoch_us({a})) / 86400000000)::BIGINT"

PROFILE = KINDS + """,
fine AS (SELECT user_id, vendor, category, sum(amount_abs) AS spent, count(*) AS visits, min(date) AS first, max(date) AS last
  FROM flagged WHERE is_expense GROUP BY ALL),
modes AS (SELECT user_id, vendor, category FROM fine
  QUALIFY row_number() OVER (PARTITION BY user_id, vendor ORDER BY visits DESC, category) = 1),
profile0 AS (SELECT user_id, vendor, sum(spent) AS total_spent, sum(visits)::BIGINT AS visit_count, min(first) AS first_visit,
  max(last) AS last_visit FROM fine GROUP BY ALL),
profile1 AS (SELECT p.*, m.category AS most_common_category, """ + DAYS.format(a="first_visit", b="last_visit") + """ AS days
  FROM profile0 p JOIN modes m USING (user_id, vendor)),
profile AS (SELECT user_id, vendor, total_spent, total_spent / visit_count AS avg_transaction, visit_count, first_visit, last_visit,
  most_common_category, CASE WHEN days > 0 THEN visit_count / days * 30 END AS visits_per_month FROM profile1),
top AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY total_spent DESC, vendor) AS rank FROM profile
  QUALIFY rank <= 10)"""

RECURRING = KINDS + """,
recurring AS (SELECT user_id, vendor, avg(amount_abs) AS amount, count(*) AS frequency,
    arg_min(category, (seq, category)) AS category, 'low' AS severity, min(seq) AS first_seq
  FROM flagged WHERE is_expense GROUP BY user_id, vendor
  HAVING count(*) >= 3 AND avg(amount_abs) > 0 AND stddev_samp(amount_abs) / avg(amount_abs) < 0.15)"""

OUTLIERS = """,
stats AS (SELECT user_id, avg(amount_abs) AS mean_amount, avg(amount_abs) + 2 * stddev_samp(amount_abs) AS threshold
  FROM flagged WHERE is_expense GROUP BY user_id HAVING count(*) > 5),
large AS (SELECT user_id, tx_id, seq, description, amount_abs AS amount, date, vendor, category,
    CASE WHEN amount_abs > threshold * 1.5 THEN 'high' ELSE 'medium' END AS severity, mean_amount
  FROM flagged JOIN stats USING (user_id) WHERE is_expense AND amount_abs > threshold)"""

DETAIL = RECURRING + """,
per_vendor AS (SELECT user_id, vendor, sum(amount_abs) AS spent, min(date) AS first, max(date) AS last FROM prep GROUP BY ALL),
matched AS (SELECT r.user_id, r.vendor, sum(v.spent) AS total_spent_so_far, min(v.first) AS first, max(v.last) AS last
  FROM recurring r JOIN per_vendor v ON v.user_id = r.user_id AND contains(upper(v.vendor), upper(r.vendor)) GROUP BY ALL),
detail0 AS (SELECT r.*, m.total_spent_so_far, m.first, m.last,
    greatest(""" + DAYS.format(a="m.first", b="m.last") + """, 1) AS date_range_days
  FROM recurring r JOIN matched m USING (user_id, vendor)),
detail AS (SELECT user_id, vendor, category, frequency, amount AS average_amount, total_spent_so_far,
    frequency / date_range_days * 365 * amount AS projected_annual_cost, severity, date_range_days,
    strftime(first, '%Y-%m-%d') AS first_transaction, strftime(last, '%Y-%m-%d') AS last_transaction,
    frequency / date_range_days * 365 * amount / 12 AS monthly_estimate, first_seq FROM detail0)"""

SUMMARY = DETAIL + f""",
rounded_detail AS (SELECT user_id, vendor, first_seq, {R('total_spent_so_far')} AS spent,
    {R('projected_annual_cost')} AS cost FROM detail),
summary0 AS (SELECT user_id, count(*) AS n, sum(spent) AS spent, sum(cost) AS cost,
    arg_min(vendor, (-cost, first_seq, vendor)) AS highest_cost_subscription, max(cost) AS highest_annual_cost
  FROM rounded_detail GROUP BY user_id),
summary AS (SELECT user_id, n AS total_subscriptions_detected, {R('spent')} AS total_spent_so_far,
    {R('cost')} AS total_projected_annual_cost, CASE WHEN cost > 0 THEN {R('cost / 12')} ELSE 0 END AS average_monthly_cost,
    highest_cost_subscription, highest_annual_cost FROM summary0)"""

SAVINGS = KINDS + f""",
totals AS (SELECT user_id, category, sum(amount_abs) AS current_spending FROM flagged WHERE is_expense GROUP BY ALL),
ranked AS (SELECT *, avg(current_spending) OVER (PARTITION BY user_id) AS mean_spending,
    row_number() OVER (PARTITION BY user_id ORDER BY current_spending DESC, category) AS rank FROM totals),
reductions AS (SELECT user_id, rank, 'category_reduction' AS type, category, current_spending,
    current_spending * 0.2::DOUBLE AS potential_savings, 'Reduce ' || category || ' spending by 20%' AS recommendation
  FROM ranked WHERE rank <= 5 AND ({_any('category', fv.DISCRETIONARY_KEYWORDS)} OR current_spending > mean_spending)),
grocery AS (SELECT user_id, vendor, sum(amount_abs) AS spent FROM flagged
  WHERE is_expense AND {_any('vendor', fv.GROCERY_KEYWORDS)} GROUP BY ALL),
consolidation AS (SELECT user_id, 'vendor_consolidation' AS type, 'Groceries' AS category,
    string_agg(vendor, '|' ORDER BY spent DESC, vendor) AS vendors, sum(spent) AS current_spending,
    sum(spent) * 0.1::DOUBLE AS potential_savings,
    'Consolidate grocery shopping to save ~$' || CAST(CAST(round_even(sum(spent) * 0.1::DOUBLE, 0) AS BIGINT) AS VARCHAR) AS recommendation
  FROM grocery GROUP BY user_id HAVING count(*) > 1)"""

FLOW = KINDS + """,
flow0 AS (SELECT user_id, sum(CASE WHEN is_income THEN amount_abs ELSE 0 END) AS total_income,
    sum(CASE WHEN is_expense THEN amount_abs ELSE 0 END) AS total_expenses,
    greatest(""" + DAYS.format(a="min(date)", b="max(date)") + """, 1) AS days FROM flagged GROUP BY user_id),
flow1 AS (SELECT *, total_income / days * 7 AS weekly_income_estimate, total_expenses / days * 7 AS weekly_spending_estimate FROM flow0),
flow AS (SELECT *, weekly_income_estimate - weekly_spending_estimate AS weekly_net,
    (weekly_income_estimate - weekly_spending_estimate) * 4.33::DOUBLE AS monthly_net_estimate,
    CASE WHEN weekly_income_estimate > 0 THEN (weekly_income_estimate - weekly_spending_estimate) / weekly_income_estimate * 100 END AS savings_rate
  FROM flow1)"""


def prepared(spark, sf_dir):
    return P.prepare_transactions(D.transactions(spark, sf_dir))


def cube(spark, sf_dir):
    """The cube, written once: every use below reads the reduced rows instead of the transactions."""
    return cut_lineage(N.spending_cube(prepared(spark, sf_dir)))


def flagged(spark, sf_dir):
    facts = cube(spark, sf_dir)
    return N.with_flow_flags(facts, N.category_kinds(facts))


def rows_and_flagged(spark, sf_dir):
    """The transactions that outliers are looked up in, written once, and the flagged cube of the same rows."""
    rows = P.prepared_once(D.transactions(spark, sf_dir), ["tx_id", "user_id", "seq", "date", "category", "amount_abs", "money_in"])

    def flags():
        facts = cut_lineage(N.spending_cube(rows))
        return N.with_flow_flags(facts, N.category_kinds(facts))

    return rows, settled(flags)


def register(name, oracle=None):
    def add(build):
        QUERIES[name] = build
        if oracle is not None:
            ORACLES[name] = "WITH " + oracle.strip()
        return build
    return add


DOLLARS = "CAST(CAST(round_even({0}, 0) AS BIGINT) AS VARCHAR)"


@register("prepare_transactions", PREP + """
SELECT tx_id, user_id, category, amount_abs, money_in, vendor, month, day_of_week, is_weekend FROM prep""")
def _(spark, sf_dir):
    return prepared(spark, sf_dir).select(
        "tx_id", "user_id", "category", "amount_abs", "money_in", "vendor", "month", "day_of_week", "is_weekend")


@register("prepare_ragged_upload", RAW + r""",
parsed AS (SELECT *, CASE WHEN contains(amount_text, '(') AND contains(amount_text, ')') THEN '-' || translate(amount_text, '()', '')
   ELSE amount_text END AS t FROM raw)
SELECT tx_id, coalesce(description, narrative) AS description, coalesce(category, 'Unknown') AS category,
   coalesce(TRY_CAST(trim(translate(t, ',$', '')) AS DOUBLE), 0) AS amount,
   strftime(TRY_CAST(replace(replace(date_text, 'T', ' '), 'Z', '') AS TIMESTAMP), '%Y-%m-%dT%H:%M:%S') AS date FROM parsed""")
def _(spark, sf_dir):
    rows = P.prepare_transactions(D.raw_transactions(spark, sf_dir))
    return rows.select("tx_id", "description", "category", "amount", A.iso_timestamp("date").alias("date"))


@register("parse_amount", RAW + r""",
parsed AS (SELECT *, CASE WHEN contains(amount_text, '(') AND contains(amount_text, ')') THEN '-' || translate(amount_text, '()', '')
   ELSE amount_text END AS t FROM raw)
SELECT tx_id, coalesce(TRY_CAST(trim(translate(t, ',$', '')) AS DOUBLE), 0) AS parsed FROM parsed""")
def _(spark, sf_dir):
    return D.raw_transactions(spark, sf_dir).select("tx_id", A.parse_amount("Amount Spent").alias("parsed"))


@register("sheet_amount", RAW + r"""
SELECT tx_id, TRY_CAST(nullif(regexp_extract(regexp_replace(amount_text, '[^0-9.-]', '', 'g'), '^-?(\d+\.?\d*|\.\d+)'), '') AS DOUBLE) AS parsed,
   TRY_CAST(nullif(regexp_extract(regexp_replace(amount_text, '[^0-9.-]', '', 'g'), '^-?(\d+\.?\d*|\.\d+)'), '') AS DOUBLE) >= 0 AS money_in FROM raw""")
def _(spark, sf_dir):
    amount = A.sheet_amount("Amount Spent")
    return D.raw_transactions(spark, sf_dir).select("tx_id", amount.alias("parsed"), A.sheet_direction(amount).alias("money_in"))


@register("vendor_name", PREP + " SELECT DISTINCT description, vendor FROM prep")
def _(spark, sf_dir):
    return (D.transactions(spark, sf_dir).select("description").distinct()
            .select("description", X.vendor_name("description").alias("vendor")))


@register("analysis_period", PREP + """
SELECT user_id, strftime(min(date), '%Y-%m-%dT%H:%M:%S') AS first_date, strftime(max(date), '%Y-%m-%dT%H:%M:%S') AS last_date,
   count(*) AS total_transactions FROM prep GROUP BY user_id""")
def _(spark, sf_dir):
    period = N.analysis_period(cube(spark, sf_dir))
    return period.select("user_id", A.iso_timestamp("first_date").alias("first_date"),
                         A.iso_timestamp("last_date").alias("last_date"), "total_transactions")


@register("category_kinds", KINDS + " SELECT user_id, category, rows, rows_in, kind FROM kinds")
def _(spark, sf_dir):
    return N.category_kinds(cube(spark, sf_dir))


@register("category_lists", KINDS + """
SELECT user_id, string_agg(category, '|' ORDER BY category) AS all_categories,
   coalesce(string_agg(category, '|' ORDER BY category) FILTER (kind = 'spending'), '') AS spending_categories,
   coalesce(string_agg(category, '|' ORDER BY category) FILTER (kind = 'income'), '') AS income_categories,
   coalesce(string_agg(category, '|' ORDER BY category) FILTER (kind = 'transfer'), '') AS transfer_categories
FROM kinds GROUP BY user_id""")
def _(spark, sf_dir):
    lists = N.category_lists(N.category_kinds(cube(spark, sf_dir)))
    return lists.select("user_id", *[F.array_join(c, "|").alias(c) for c in lists.columns if c != "user_id"])


@register("flow_flags", KINDS + """
SELECT user_id, category, count(*) FILTER (is_expense) AS expenses, count(*) FILTER (is_income) AS incomes FROM flagged GROUP BY ALL""")
def _(spark, sf_dir):
    return flagged(spark, sf_dir).groupBy("user_id", "category").agg(
        F.sum(F.when(F.col("is_expense"), F.col("n")).otherwise(0)).alias("expenses"),
        F.sum(F.when(F.col("is_income"), F.col("n")).otherwise(0)).alias("incomes"))


@register("vendor_profile", PROFILE + """
SELECT user_id, vendor, total_spent, avg_transaction, visit_count, strftime(first_visit, '%Y-%m-%dT%H:%M:%S') AS first_visit,
   strftime(last_visit, '%Y-%m-%dT%H:%M:%S') AS last_visit, most_common_category, visits_per_month FROM profile""")
def _(spark, sf_dir):
    profile = N.vendor_profile(flagged(spark, sf_dir))
    return profile.withColumns({c: A.iso_timestamp(c) for c in ("first_visit", "last_visit")})


@register("vendor_top10", PROFILE + """
SELECT user_id, rank, vendor, total_spent, avg_transaction, visit_count, most_common_category, visits_per_month FROM top""")
def _(spark, sf_dir):
    top = N.top_vendors(N.vendor_profile(flagged(spark, sf_dir)))
    return top.select("user_id", F.col("rank").cast("long").alias("rank"), "vendor", "total_spent", "avg_transaction",
                      "visit_count", "most_common_category", "visits_per_month")


@register("vendor_insights", PROFILE + f"""
SELECT user_id, rank, CASE
  WHEN lower(most_common_category) IN ({_quote(fv.HOUSING_CATEGORIES)}) THEN
    'Housing: ' || vendor || ' is your largest recurring expense ($' || {DOLLARS.format('total_spent')} || ', ' || visit_count || ' payments)'
  WHEN lower(most_common_category) IN ({_quote(fv.GROCERY_CATEGORIES)}) THEN
    'Groceries: You spend ~$' || {DOLLARS.format('total_spent / visit_count * 4.33::DOUBLE')} || '/month at ' || vendor || ' (' || visit_count || ' visits)'
  WHEN lower(most_common_category) IN ({_quote(fv.TRANSPORT_CATEGORIES)}) THEN
    'Transport: Regular spending at ' || vendor || ' ($' || {DOLLARS.format('total_spent')} || ', avg $' || {DOLLARS.format(R('avg_transaction'))} || '/visit)'
  ELSE most_common_category || ': ' || vendor || ' - $' || {DOLLARS.format('total_spent')} || ' (' || visit_count || ' visits, avg $'
    || {DOLLARS.format(R('avg_transaction'))} || '/visit)' END AS insight
FROM top WHERE visit_count > 5""")
def _(spark, sf_dir):
    found = N.vendor_insights(N.top_vendors(N.vendor_profile(flagged(spark, sf_dir))))
    return found.withColumn("rank", F.col("rank").cast("long"))


@register("outliers", KINDS + OUTLIERS + """
SELECT user_id, tx_id, description, amount, strftime(date, '%Y-%m-%dT%H:%M:%S') AS date, vendor, category, severity FROM large""")
def _(spark, sf_dir):
    return (N.outliers(*rows_and_flagged(spark, sf_dir)).drop("mean_amount", "seq")
            .withColumn("date", A.iso_timestamp("date")))


@register("outliers_excluding", KINDS.replace("'spending') AS is_expense", "'spending') AND category NOT IN ('Unknown', 'Cash') AS is_expense")
          + OUTLIERS + " SELECT user_id, tx_id, amount, severity FROM large")
def _(spark, sf_dir):
    return N.outliers(*rows_and_flagged(spark, sf_dir), ["Unknown", "Cash"]).select("user_id", "tx_id", "amount", "severity")


@register("recurring_vendors", RECURRING + " SELECT user_id, vendor, amount, frequency, category, severity, first_seq FROM recurring")
def _(spark, sf_dir):
    return N.recurring_vendors(flagged(spark, sf_dir))


@register("union_anomalies", RECURRING + OUTLIERS + """
SELECT user_id, type, vendor, category, severity, amount, frequency, tx_id FROM (
 SELECT user_id, 'large_transaction' AS type, vendor, category, severity, amount, NULL::BIGINT AS frequency, tx_id FROM large
 UNION ALL SELECT user_id, 'potential_subscription', vendor, category, severity, amount, frequency, NULL FROM recurring)""")
def _(spark, sf_dir):
    return N.anomalies(*rows_and_flagged(spark, sf_dir)).select(
        "user_id", "type", "vendor", "category", "severity", "amount", "frequency", "tx_id")


@register("anomaly_insights", RECURRING + OUTLIERS + f"""
SELECT user_id, seq, 'Unusual charge: $' || {DOLLARS.format('amount')} || ' at ' || vendor || ' (you typically spend <$'
   || {DOLLARS.format('mean_amount')} || '/transaction)' AS insight FROM large
UNION ALL SELECT user_id, first_seq, 'Potential subscription: ' || vendor || ' $' || printf('%.2f', {R('amount')}) || ' ('
   || frequency || ' similar transactions)' FROM recurring""")
def _(spark, sf_dir):
    rows, facts = rows_and_flagged(spark, sf_dir)
    return N.anomaly_insights(N.outliers(rows, facts), N.recurring_vendors(facts))


def _subscriptions(spark, sf_dir):
    facts = cube(spark, sf_dir)
    return N.subscription_detail(facts, N.recurring_vendors(N.with_flow_flags(facts, N.category_kinds(facts))))


@register("subscription_detail", DETAIL + """
SELECT user_id, vendor, category, frequency, average_amount, total_spent_so_far, projected_annual_cost,
   date_range_days, first_transaction, last_transaction, monthly_estimate FROM detail""")
def _(spark, sf_dir):
    return _subscriptions(spark, sf_dir).select("user_id", "vendor", "category", "frequency", "average_amount", "total_spent_so_far",
                                                 "projected_annual_cost", "date_range_days",
                                                 "first_transaction", "last_transaction", "monthly_estimate")


@register("subscription_ranking", SUMMARY + """
SELECT user_id, vendor, cost AS projected_annual_cost, row_number() OVER (PARTITION BY user_id ORDER BY cost DESC, first_seq, vendor) AS rank FROM rounded_detail""")
def _(spark, sf_dir):
    return N.ranked_subscriptions(_subscriptions(spark, sf_dir)).select("user_id", "vendor", "projected_annual_cost", "rank")


@register("subscription_summary", SUMMARY + " SELECT * FROM summary")
def _(spark, sf_dir):
    return N.subscription_summary(_subscriptions(spark, sf_dir))


@register("subscription_insights", SUMMARY + f"""
SELECT user_id, first_seq AS seq, CASE
   WHEN projected_annual_cost > 500 THEN vendor || ': High-cost subscription - projected $' || {DOLLARS.format('projected_annual_cost')}
     || '/year ($' || {DOLLARS.format(R('monthly_estimate'))} || '/month)'
   WHEN projected_annual_cost > 100 THEN vendor || ': Medium-cost subscription - projected $' || {DOLLARS.format('projected_annual_cost')} || '/year'
   ELSE vendor || ': Low-cost subscription - projected $' || {DOLLARS.format('projected_annual_cost')} || '/year' END AS insight FROM detail
UNION ALL SELECT user_id, NULL, CASE WHEN total_projected_annual_cost > 1000 THEN 'Warning: Your subscriptions could cost $'
     || {DOLLARS.format('total_projected_annual_cost')} || ' annually ($' || {DOLLARS.format('average_monthly_cost')} || '/month)'
   ELSE 'Moderate subscription spending: $' || {DOLLARS.format('total_projected_annual_cost')} || ' annually projected' END
 FROM summary WHERE total_projected_annual_cost > 500""")
def _(spark, sf_dir):
    detail = cut_lineage(_subscriptions(spark, sf_dir))  # used twice
    return N.subscription_insights(detail, N.subscription_summary(detail))


@register("category_savings", SAVINGS + " SELECT * FROM reductions")
def _(spark, sf_dir):
    return N.category_savings(flagged(spark, sf_dir)).withColumn("rank", F.col("rank").cast("long"))


@register("vendor_consolidation", SAVINGS + " SELECT * FROM consolidation")
def _(spark, sf_dir):
    return N.vendor_consolidation(flagged(spark, sf_dir)).withColumn("vendors", F.array_join("vendors", "|"))


@register("savings_opportunities", SAVINGS + """
SELECT user_id, type, category, current_spending, potential_savings, recommendation FROM reductions
UNION ALL SELECT user_id, type, category, current_spending, potential_savings, recommendation FROM consolidation""")
def _(spark, sf_dir):
    return N.savings_opportunities(flagged(spark, sf_dir)).select(
        "user_id", "type", "category", "current_spending", "potential_savings", "recommendation")


@register("savings_insights", SAVINGS + f"""
SELECT user_id, rank, 'Reduce ' || category || ' spending by 20% to save ~$' || {DOLLARS.format('potential_savings')} AS insight FROM reductions""")
def _(spark, sf_dir):
    found = N.savings_insights(N.category_savings(flagged(spark, sf_dir)))
    return found.withColumn("rank", F.col("rank").cast("long"))


@register("cash_flow", FLOW + """
SELECT user_id, total_income, total_expenses, days, weekly_income_estimate, weekly_spending_estimate,
   weekly_net, monthly_net_estimate, savings_rate FROM flow""")
def _(spark, sf_dir):
    return N.cash_flow(flagged(spark, sf_dir))


@register("cash_flow_insights", FLOW + f"""
SELECT user_id, CASE WHEN weekly_spending_estimate > weekly_income_estimate THEN 'Warning: You''re spending $'
   || {DOLLARS.format('weekly_spending_estimate - weekly_income_estimate')} || ' more than you earn per week on average'
  ELSE 'You save approximately $' || {DOLLARS.format('weekly_net')} || ' per week (' || printf('%.1f', {R('savings_rate', 1)}) || '% savings rate)' END AS insight
FROM flow WHERE weekly_income_estimate > 0""")
def _(spark, sf_dir):
    return N.cash_flow_insights(N.cash_flow(flagged(spark, sf_dir)))


@register("weekday_weekend", KINDS + """
SELECT user_id, is_weekend, count(*) AS transactions, avg(amount_abs) AS average_amount, sum(amount_abs) AS total_amount
FROM flagged WHERE is_expense GROUP BY ALL""")
def _(spark, sf_dir):
    return N.weekday_weekend(prepared(spark, sf_dir), N.category_kinds(cube(spark, sf_dir)))


@register("category_share", KINDS + """
SELECT user_id, category, sum(amount_abs) AS total_amount, sum(amount_abs) / sum(sum(amount_abs)) OVER (PARTITION BY user_id) AS share
FROM flagged WHERE is_expense GROUP BY user_id, category""")
def _(spark, sf_dir):
    return N.category_share(flagged(spark, sf_dir))
