"""The domain tables, derived from the driver's TPC-H-like tables.

Each builder reads the whole table; :mod:`spendgrid.catalog.domain_sql` states the same rules as SQL
for the oracle.  Text is ASCII and amounts are multiples of a quarter, so sums are exact in doubles
whatever the order of addition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendgrid.session import spread

CHAINS = ("WOOLWORTHS", "COUNTDOWN", "NEW WORLD", "PAK N SAVE", "FOUR SQUARE")
TYPE_CATEGORIES = (
    ("STANDARD", "Groceries"), ("MEDIUM", "Shopping"), ("PROMO", "DinnerBars"),
    ("LARGE", "Living"), ("SMALL", "Transport"), ("ECONOMY", "Utility"),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One bank transaction per line item: id, user, order, date, description, category, amount, direction."""
    number = F.col("l_linenumber")
    returned = F.col("l_returnflag") == "R"
    quantity = F.col("l_quantity").cast("long")
    supplier = F.col("l_suppkey")
    money_in = (F.when(returned, F.lit(True))
                .when((F.col("l_returnflag") == "A") & (number == 2), F.lit(None).cast("boolean"))
                .otherwise(F.lit(False)))

    net = (F.round(F.col("l_extendedprice") * 100).cast("long")
           * (100 - F.round(F.col("l_discount") * 100).cast("long")))
    size = (
        F.when(number == 1, 20 + quantity * 0.75)
        .when(number == 5, 12.5 + (quantity % 2) * 0.25)
        .when((number == 6) & returned, 2000.0 + (supplier % 10) * 100)
        .when(number == 6, 20.0 * (1 + quantity % 10))
        .when(number == 7, 10.0 * (1 + quantity % 10))
        .otherwise(F.floor(net / F.lit(250000)).cast("double") * 0.25))
    amount = F.when(returned, size).otherwise(-size)

    # what the line alone decides is found before the joins, which then move less
    line = spread(table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
        "l_discount", "l_returnflag", "l_linestatus", "l_shipdate"))
    line = line.withColumns({"_amount": amount, "_money_in": money_in}).drop("l_quantity", "l_extendedprice", "l_discount")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    rows = (line.join(part, F.col("l_partkey") == F.col("p_partkey"))
            .join(orders, F.col("l_orderkey") == F.col("o_orderkey")))

    name = F.upper("p_name")
    noun = F.upper(F.substring_index("p_name", " ", -1))

    chain = F.element_at(F.array(*[F.lit(c) for c in CHAINS]), (supplier % 5 + 1).cast("int"))
    description = (
        F.when(number == 1, F.concat(F.lit("EFTPOS "), chain, F.lit(" QUEENSTREET NZ")))
        .when(number == 2, F.concat(F.lit("4835-****-****-"), F.lpad((F.col("l_orderkey") % 10000).cast("string"), 4, "0"),
                                    F.lit(" Df "), name, F.lit(" AUCKLAND")))
        .when((number == 3) & (F.col("l_linestatus") == "O"),
              F.concat(F.lit("The "), name, F.lit(" Ltd https://shop.example.com/a1")))
        .when(number == 3, F.concat(name, F.lit(" STORE "), (F.col("l_partkey") % 1000).cast("string"), F.lit(" AU")))
        .when(number == 4, F.concat(F.lit("VISA PURCHASE "), name, F.lit(" REF"), (F.col("l_orderkey") + 100000).cast("string")))
        .when(number == 5, F.concat(F.lit("DD STREAMING "), noun))
        .when((number == 6) & returned, F.concat(F.lit("SALARY ACME PAYROLL "), supplier.cast("string")))
        .when(number == 6, F.concat(F.lit("ATM WITHDRAWAL "), name))
        .otherwise(F.concat(F.lit("TRANSFER TO SAVINGS "), noun)))

    by_type = F.lit(None).cast("string")
    for kind, category in TYPE_CATEGORIES:
        by_type = F.when(F.col("p_type") == kind, F.lit(category)).otherwise(by_type)
    category = (
        F.when(F.col("l_returnflag") == "N", F.lit(None).cast("string"))
        .when(number == 1, F.lit("Groceries"))
        .when((number == 5) & returned, F.lit("Payroll"))
        .when(number == 5, F.lit("Utility"))
        .when((number == 6) & returned, F.lit("Salary"))
        .when(number == 6, F.lit("Cash"))
        .when(number == 7, F.lit("Transfer"))
        .otherwise(by_type))

    return rows.select(
        F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")]).alias("tx_id"),
        F.col("o_custkey").alias("user_id"),
        ((F.col("l_orderkey") * 8 + number) * 1024 + F.col("l_partkey") % 1024).alias("seq"),
        (F.col("l_shipdate") + F.expr("make_dt_interval(0, l_linenumber * 3)")).alias("date"),
        description.alias("description"),
        category.alias("category"),
        F.col("_amount").alias("amount"),
        F.col("_money_in").alias("money_in"),
        F.col("l_orderkey").alias("request_id"),
    )


def raw_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same transactions as a ragged upload: text amounts in several spellings, alias headers."""
    tx = transactions(spark, sf_dir)
    size = F.abs("amount")
    whole = F.floor(size).cast("long")
    cents = F.lpad(F.round((size - whole) * 100).cast("long").cast("string"), 2, "0")
    plain = F.concat(whole.cast("string"), F.lit("."), cents)
    grouped = F.when(whole >= 1000, F.concat(
        F.floor(whole / 1000).cast("string"), F.lit(","), F.lpad((whole % 1000).cast("string"), 3, "0"),
        F.lit("."), cents)).otherwise(plain)
    spelling = F.floor(F.col("seq") / 1024) % 8
    text = (F.when(spelling == 1, F.concat(F.lit("$"), grouped))
            .when(spelling == 2, F.concat(F.lit("("), grouped, F.lit(")")))
            .when(spelling == 3, F.concat(F.lit(" -"), plain, F.lit(" ")))
            .when(spelling == 4, F.lit("n/a"))
            .when(spelling == 5, F.lit(None).cast("string"))
            .when(spelling == 6, F.concat(F.lit("$("), grouped, F.lit(")")))
            .otherwise(plain))
    return tx.select(
        "tx_id", "user_id", "seq",
        F.when(spelling < 4, F.col("description")).alias("description"),
        F.when(spelling >= 4, F.col("description")).alias("narrative"),
        text.alias("Amount Spent"),
        F.col("category").alias("Category"),
        F.when(spelling == 7, F.lit("not a date")).otherwise(F.date_format("date", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("Date"),
        "money_in")


def subscriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subscription periods: one row per order of a user."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"),
        F.when(F.col("o_orderstatus") == "O", "ACTIVE").when(F.col("o_orderstatus") == "P", "TRIALING")
        .otherwise("CANCELED").alias("status"),
        F.col("o_orderpriority").alias("plan"), F.col("o_orderdate").alias("created_at"))


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("user_id"),
        F.concat(F.lit("key-"), F.col("c_custkey").cast("string")).alias("api_key"),
        F.concat(F.lower("c_mktsegment"), F.col("c_custkey").cast("string"), F.lit("@example.com")).alias("email"))


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accounts exist for users with a non-negative balance."""
    return (table(spark, sf_dir, "customer").where(F.col("c_acctbal") >= 0)
            .select((F.col("c_custkey") + 1000000).alias("account_id"), F.col("c_custkey").alias("user_id"),
                    F.col("c_mktsegment").alias("provider")))


def api_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("call_id"), "user_id", F.col("ts").alias("called_at"), F.col("event_type").alias("kind"))


def job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status events of asynchronous jobs: the job number sits in the JSON properties."""
    status = (F.when(F.col("event_type") == "signup", "PENDING").when(F.col("event_type") == "view", "PROCESSING")
              .when(F.col("event_type") == "purchase", "COMPLETED").when(F.col("event_type") == "error", "FAILED")
              .otherwise("STALLED"))
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("job-"), F.col("user_id").cast("string"), F.lit("-"), F.get_json_object("props", "$.k")).alias("job_id"),
        "user_id", status.alias("status"), F.col("ts").alias("updated_at"), F.col("event_id").alias("event_seq"),
        F.when(status == "COMPLETED",
               F.when(F.col("event_id") % 10 == 0, F.lit("{broken"))
               .when(F.col("event_id") % 10 == 1, F.lit(None).cast("string"))
               .otherwise(F.col("props"))).alias("result_data"),
        F.when(status == "FAILED", F.concat(F.lit("code "), F.col("event_id").cast("string"))).alias("error"))


def labelled_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding as a trained row of one of ten models' categories."""
    return table(spark, sf_dir, "embeddings").select(
        F.lit(0).cast("long").alias("user_id"), F.col("vec_id").alias("item_id"),
        F.concat(F.lit("category-"), F.col("label").cast("string")).alias("category"),
        F.col("embedding").alias("vector"))


def blended_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding plus its successor, as rows to score: halfway between two known points."""
    first = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("a"))
    second = first.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b"))
    both = first.join(second, "vec_id", "left").withColumn("b", F.coalesce("b", "a"))
    return both.select(
        F.lit(0).cast("long").alias("user_id"), F.col("vec_id").alias("tx_id"),
        F.zip_with("a", "b", lambda x, y: x.cast("double") + y.cast("double")).alias("vector"))


def merchant_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct part names with the first key that uses each."""
    return table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("first_seq"))
