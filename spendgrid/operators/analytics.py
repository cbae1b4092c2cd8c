"""Spending analytics over prepared transactions, for all users in one job.

Almost every report needs only sums, counts, extremes and first rows, so the transactions are reduced
once to a cube with one row per user, vendor, category and direction (:func:`spending_cube`).  That one
pass combines partially before its shuffle, and a user or vendor with a large share of the rows costs
no more than any other.  All other functions work on the cube, except the outliers, which read the
transactions a second time against a small table of limits.  Measures are left unrounded;
:func:`rounded` gives the two-decimal presentation.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spendgrid import fixed_values as fv
from spendgrid.functions import amounts as A
from spendgrid.functions import text as X
from spendgrid.operators.prepare import without_categories
from spendgrid.session import cut_lineage


def rounded(df: DataFrame, columns: Sequence[str], scale: int = 2) -> DataFrame:
    return df.withColumns({c: A.round_half_even(c, scale) for c in columns})


# --- categories ------------------------------------------------------------------------------------

def keyword_kind(category: Column) -> Column:
    """Kind of a category by name alone; income words are tested first."""
    return (F.when(X.contains_any(category, fv.INCOME_KEYWORDS), F.lit("income"))
            .when(X.contains_any(category, fv.TRANSFER_KEYWORDS), F.lit("transfer"))
            .otherwise(F.lit("spending")))


def spending_cube(df: DataFrame) -> DataFrame:
    """One row per user, vendor, category and direction with every sum the reports need.

    Only primitive sums, extremes and a central moment (``spread``, the sum of squared distances from the
    mean), so both aggregation sides are hash based.
    """
    return df.groupBy("user_id", "vendor", "category", "money_in").agg(
        F.count(F.lit(1)).alias("n"), F.sum("amount_abs").alias("total"),
        (F.var_pop("amount_abs") * F.count("amount_abs")).alias("spread"),
        F.min("seq").alias("first_seq"), F.min("date").alias("first"), F.max("date").alias("last"))


def category_kinds(cube: DataFrame) -> DataFrame:
    """Kind of every category of every user: by name, then spending refined by the share of money in."""
    shares = cube.groupBy("user_id", "category").agg(
        F.sum("n").alias("rows"), F.sum(F.when(F.col("money_in"), F.col("n")).otherwise(0)).alias("rows_in"))
    named = keyword_kind(F.col("category"))
    share = F.col("rows_in") / F.col("rows")
    kind = F.when((named == "spending") & (share > fv.INCOME_SHARE), F.lit("income")).otherwise(named)
    return shares.select("user_id", "category", "rows", "rows_in", kind.alias("kind"))


def category_lists(kinds: DataFrame) -> DataFrame:
    """Sorted category names per user, all and by kind (names of a user, so short lists)."""
    def listed(kind: str) -> Column:
        return F.array_sort(F.collect_set(F.when(F.col("kind") == kind, F.col("category")))).alias(f"{kind}_categories")
    return kinds.groupBy("user_id").agg(
        F.array_sort(F.collect_set("category")).alias("all_categories"),
        listed("spending"), listed("income"), listed("transfer"))


def with_flow_flags(df: DataFrame, kinds: DataFrame) -> DataFrame:
    """Add ``is_expense`` and ``is_income`` to cube rows or transactions; a row may be both.

    The kinds are one row per user and category.  No broadcast is forced: the planner broadcasts them
    when their measured size allows, otherwise the join is skew-split at run time.
    """
    flagged = df.join(kinds.select("user_id", "category", "kind"), ["user_id", "category"], "left")
    return flagged.withColumns({
        "is_expense": ~F.col("money_in") | (F.col("kind") == "spending"),
        "is_income": F.col("money_in") | (F.col("kind") == "income"),
    })


def expenses(flagged: DataFrame, excluded: Sequence[str] = ()) -> DataFrame:
    return without_categories(flagged.where("is_expense"), excluded)


def analysis_period(cube: DataFrame) -> DataFrame:
    return cube.groupBy("user_id").agg(
        F.min("first").alias("first_date"), F.max("last").alias("last_date"), F.sum("n").alias("total_transactions"))


# --- vendors ----------------------------------------------------------------------------------------

def vendor_profile(flagged: DataFrame, excluded: Sequence[str] = ()) -> DataFrame:
    """Spend, mean, visits, first and last visit and most common category per user and vendor.

    The most common category comes from the counts of the finer grouping (smallest name on ties), so
    no per-vendor map of categories is built.  One exchange by user and vendor serves both groupings.
    """
    fine = (expenses(flagged, excluded).repartition("user_id", "vendor")
            .groupBy("user_id", "vendor", "category").agg(
                F.sum("total").alias("spent"), F.sum("n").alias("visits"),
                F.min("first").alias("first"), F.max("last").alias("last")))
    profile = fine.groupBy("user_id", "vendor").agg(
        F.sum("spent").alias("total_spent"), F.sum("visits").alias("visit_count"),
        F.min("first").alias("first_visit"), F.max("last").alias("last_visit"),
        F.min_by("category", F.struct(-F.col("visits"), F.col("category"))).alias("most_common_category"))
    days = A.elapsed_days("first_visit", "last_visit")
    return profile.select(
        "user_id", "vendor", "total_spent",
        (F.col("total_spent") / F.col("visit_count")).alias("avg_transaction"),
        "visit_count", "first_visit", "last_visit", "most_common_category",
        F.when(days > 0, F.col("visit_count") / days * fv.DAYS_PER_MONTH).alias("visits_per_month"))


def top_vendors(profile: DataFrame, limit: int = fv.TOP_VENDORS) -> DataFrame:
    """The best vendors of each user by spend; rows beyond the limit are dropped before the shuffle."""
    order = W.partitionBy("user_id").orderBy(F.desc("total_spent"), "vendor")
    return (profile.withColumn("rank", F.row_number().over(order))
            .where(F.col("rank") <= limit))


def vendor_insights(top: DataFrame) -> DataFrame:
    """One sentence per top vendor with more than five visits."""
    category = F.lower("most_common_category")
    total = A.round_half_even("total_spent", 2)
    mean = A.round_half_even("avg_transaction", 2)
    visits = F.col("visit_count").cast("string")
    name = F.col("vendor")
    monthly = total / F.col("visit_count") * fv.WEEKS_PER_MONTH
    sentence = (
        F.when(category.isin(*fv.HOUSING_CATEGORIES),
               F.concat(F.lit("Housing: "), name, F.lit(" is your largest recurring expense ($"),
                        A.whole_dollars(total), F.lit(", "), visits, F.lit(" payments)")))
        .when(category.isin(*fv.GROCERY_CATEGORIES),
              F.concat(F.lit("Groceries: You spend ~$"), A.whole_dollars(monthly), F.lit("/month at "), name,
                       F.lit(" ("), visits, F.lit(" visits)")))
        .when(category.isin(*fv.TRANSPORT_CATEGORIES),
              F.concat(F.lit("Transport: Regular spending at "), name, F.lit(" ($"), A.whole_dollars(total),
                       F.lit(", avg $"), A.whole_dollars(mean), F.lit("/visit)")))
        .otherwise(F.concat(F.col("most_common_category"), F.lit(": "), name, F.lit(" - $"), A.whole_dollars(total),
                            F.lit(" ("), visits, F.lit(" visits, avg $"), A.whole_dollars(mean), F.lit("/visit)"))))
    return top.where(F.col("visit_count") > 5).select("user_id", "rank", sentence.alias("insight"))


# --- anomalies ------------------------------------------------------------------------------------------

def with_spread(rows: DataFrame, by: Sequence[str], *others: Column) -> DataFrame:
    """Count ``n``, ``total``, ``mean`` and sample ``deviation`` of cube rows merged by ``by``; null below two rows.

    Spreads are merged around the common mean, found first, so that large amounts do not cancel.
    """
    by = list(by)
    sums = rows.groupBy(*by).agg(F.sum("n").alias("_n"), F.sum("total").alias("_total"), *others)
    sums = sums.withColumn("mean", F.col("_total") / F.col("_n"))
    shift = F.col("total") / F.col("n") - F.col("mean")
    around = (rows.select(*by, "n", "total", "spread").join(sums.select(*by, "mean"), by)
              .groupBy(*by).agg(F.sum(F.col("spread") + F.col("n") * shift * shift).alias("_spread")))
    merged = sums.join(around, by).withColumn("deviation", F.sqrt(F.when(F.col("_n") > 1, F.col("_spread") / (F.col("_n") - 1))))
    return merged.withColumnsRenamed({"_n": "n", "_total": "total"}).drop("_spread")


def outliers(df: DataFrame, flagged: DataFrame, excluded: Sequence[str] = ()) -> DataFrame:
    """Expenses above mean plus two sample deviations of the user's expenses.

    ``df`` holds the transactions, ``flagged`` the flagged cube they were reduced to.  The limits come
    from the cube, one row per user and category that may hold expenses, and meet the transactions in
    a single join; a window over the user would put a heavy user into one task.
    """
    sums = with_spread(expenses(flagged, excluded), ["user_id"])
    limits = sums.where(F.col("n") > fv.OUTLIER_MIN_ROWS).select(
        "user_id", F.col("mean").alias("mean_amount"), (F.col("mean") + fv.OUTLIER_DEVIATIONS * F.col("deviation")).alias("threshold"))
    categories = without_categories(flagged, excluded).groupBy("user_id", "category").agg(
        F.max(F.col("kind") == "spending").alias("spends"))
    limits = cut_lineage(categories.join(limits, "user_id"))  # small, and found before the transactions are moved
    large = df.join(limits, ["user_id", "category"]).where(
        (F.col("amount_abs") > F.col("threshold")) & (~F.col("money_in") | F.col("spends")))
    return large.select(
        "user_id", "tx_id", "seq", "description", F.col("amount_abs").alias("amount"), "date", "vendor", "category",
        F.when(F.col("amount_abs") > F.col("threshold") * fv.OUTLIER_HIGH_FACTOR, F.lit("high"))
        .otherwise(F.lit("medium")).alias("severity"),
        "mean_amount")


def recurring_vendors(flagged: DataFrame, excluded: Sequence[str] = ()) -> DataFrame:
    """Vendors with at least three expenses of nearly the same size: potential subscriptions.

    Means, spreads around them and the first category come from one exchange by user and vendor.  The window holds
    the cube rows of one vendor of one user, one per category and direction, however many transactions they stand for.
    """
    rows = expenses(flagged, excluded).where(F.col("user_id").isNotNull() & F.col("vendor").isNotNull())
    pair = W.partitionBy("user_id", "vendor")
    rows = rows.withColumn("mean", F.sum("total").over(pair) / F.sum("n").over(pair))
    shift = F.col("total") / F.col("n") - F.col("mean")
    first = F.when(F.col("first_seq").isNotNull(), F.struct("first_seq", F.col("category").isNull().alias("blank"), "category"))
    stats = rows.groupBy("user_id", "vendor").agg(
        F.sum("n").alias("n"), F.max("mean").alias("mean"), F.sum(F.col("spread") + F.col("n") * shift * shift).alias("spread"),
        F.min(first).alias("first"))
    deviation = F.sqrt(F.when(F.col("n") > 1, F.col("spread") / (F.col("n") - 1)))
    variation = F.try_divide(deviation, F.col("mean"))
    steady = stats.where((F.col("n") >= fv.RECURRING_MIN_ROWS) & (F.col("mean") > 0) & (variation < fv.RECURRING_MAX_VARIATION)
                         & F.col("first").isNotNull())
    return steady.select("user_id", "vendor", F.col("mean").alias("amount"), F.col("n").alias("frequency"),
                         F.col("first.category").alias("category"), F.lit("low").alias("severity"), F.col("first.first_seq").alias("first_seq"))


def anomalies(df: DataFrame, flagged: DataFrame, excluded: Sequence[str] = ()) -> DataFrame:
    """Outlier rows and recurring vendors in one list; fields of the other kind are null."""
    large = outliers(df, flagged, excluded).drop("mean_amount").withColumn("type", F.lit("large_transaction"))
    steady = recurring_vendors(flagged, excluded).drop("first_seq").withColumn("type", F.lit("potential_subscription"))
    return large.unionByName(steady, allowMissingColumns=True)


def anomaly_insights(large: DataFrame, steady: DataFrame) -> DataFrame:
    charge = F.concat(F.lit("Unusual charge: $"), A.whole_dollars(F.col("amount")), F.lit(" at "), F.col("vendor"),
                      F.lit(" (you typically spend <$"), A.whole_dollars(F.col("mean_amount")), F.lit("/transaction)"))
    repeat = F.concat(F.lit("Potential subscription: "), F.col("vendor"), F.lit(" $"), A.two_decimals(F.col("amount")),
                      F.lit(" ("), F.col("frequency").cast("string"), F.lit(" similar transactions)"))
    return (large.select("user_id", "seq", charge.alias("insight"))
            .unionByName(steady.select("user_id", F.col("first_seq").alias("seq"), repeat.alias("insight"))))


# --- subscriptions -------------------------------------------------------------------------------------------

#: Slots that the first characters of a user's wanted vendors are hashed to, so the most numbers a user's list has.
GRAM_SLOTS = 4096


def _gram_slot(gram: Column) -> Column:
    return F.pmod(F.hash(gram), F.lit(GRAM_SLOTS))


def vendor_pieces(vendors: DataFrame, heads: DataFrame) -> DataFrame:
    """``vendors`` with every piece (``_gram``, up to three characters) that a vendor its user wants may begin with.

    Of a name only the pieces stay that hash like one of the user's ``heads``; users without heads drop out.
    """
    grams = F.array_distinct(F.flatten(F.transform(
        F.sequence(F.lit(1), F.greatest(F.length("vendor"), F.lit(1))),
        lambda i: F.array(*[F.substring(F.upper("vendor"), i, F.lit(n)) for n in (1, 2, 3)]))))
    slots = heads.groupBy("user_id").agg(F.collect_set(_gram_slot(F.col("_gram"))).alias("_slots"))
    usable = F.filter(grams, lambda g: F.array_contains("_slots", _gram_slot(g)))
    return vendors.join(slots, "user_id").withColumn("_gram", F.explode(usable)).drop("_slots")


def vendors_containing(vendors: DataFrame, wanted: DataFrame) -> DataFrame:
    """Pairs (wanted vendor, vendor of the same user whose name contains it, ignoring case).

    Matching goes through an equi-join: a name that contains the wanted text also contains its first
    three characters, so those are the join key and the substring test only runs on such pairs.
    Both sides hold one row per user and vendor, never transactions.
    """
    right = wanted.select("user_id", F.col("vendor").alias("wanted"), F.substring(F.upper("vendor"), 1, 3).alias("_gram"))
    return (vendor_pieces(vendors, right).join(right, ["user_id", "_gram"])
            .where(F.contains(F.upper("vendor"), F.upper("wanted"))).drop("_gram"))


def subscription_detail(cube: DataFrame, recurring: DataFrame, excluded: Sequence[str] = ()) -> DataFrame:
    """Totals, span and projected cost of each recurring vendor.

    The frequency is that of the exact vendor; span and total cover every transaction, income
    included, of any vendor whose name contains it.  The recurring vendors are found once and written; only
    vendors of users who have any are summed.
    """
    wanted = cut_lineage(without_categories(recurring, excluded, ignore_case=True))
    per_vendor = cube.join(wanted.select("user_id").distinct(), "user_id", "left_semi").groupBy("user_id", "vendor").agg(
        F.sum("total").alias("spent"), F.min("first").alias("first"), F.max("last").alias("last"))
    matched = (vendors_containing(per_vendor, wanted.select("user_id", "vendor"))
               .groupBy("user_id", "wanted")
               .agg(F.sum("spent").alias("total_spent_so_far"), F.min("first").alias("first"), F.max("last").alias("last"))
               .withColumnRenamed("wanted", "vendor"))
    days = A.at_least_one_day(A.elapsed_days("first", "last"))
    detail = wanted.join(matched, ["user_id", "vendor"]).withColumn("date_range_days", days)
    projected = F.when(F.col("date_range_days") > 0,
                       F.col("frequency") / F.col("date_range_days") * fv.DAYS_PER_YEAR * F.col("amount")
                       ).otherwise(F.col("amount") * 12)
    return detail.select(
        "user_id", "vendor", "category", "frequency", F.col("amount").alias("average_amount"),
        "total_spent_so_far", projected.alias("projected_annual_cost"), "severity", "date_range_days",
        A.iso_date("first").alias("first_transaction"), A.iso_date("last").alias("last_transaction"),
        (projected / 12).alias("monthly_estimate"), "first_seq")


def rounded_subscriptions(detail: DataFrame) -> DataFrame:
    return rounded(detail, ["average_amount", "total_spent_so_far", "projected_annual_cost", "monthly_estimate"])


def ranked_subscriptions(detail: DataFrame) -> DataFrame:
    """Subscriptions of each user by projected cost, dearest first; a user's recurring vendors, never transactions."""
    order = W.partitionBy("user_id").orderBy(F.desc("projected_annual_cost"), "first_seq", "vendor")
    return rounded_subscriptions(detail).withColumn("rank", F.row_number().over(order))


def subscription_summary(detail: DataFrame) -> DataFrame:
    """Count, totals and the most expensive subscription per user (from the rounded detail)."""
    summed = rounded_subscriptions(detail).groupBy("user_id").agg(
        F.count(F.lit(1)).alias("total_subscriptions_detected"),
        F.sum("total_spent_so_far").alias("total_spent_so_far"),
        F.sum("projected_annual_cost").alias("total_projected_annual_cost"),
        F.min(F.struct((-F.col("projected_annual_cost")).alias("cost"), F.col("first_seq"), F.col("vendor"))).alias("top"))
    total = F.col("total_projected_annual_cost")
    return summed.select(
        "user_id", "total_subscriptions_detected", A.round_half_even("total_spent_so_far", 2).alias("total_spent_so_far"),
        A.round_half_even(total, 2).alias("total_projected_annual_cost"),
        F.when(total > 0, A.round_half_even(total / 12, 2)).otherwise(F.lit(0.0)).alias("average_monthly_cost"),
        F.col("top.vendor").alias("highest_cost_subscription"),
        (-F.col("top.cost")).alias("highest_annual_cost"))


def subscription_insights(detail: DataFrame, summary: DataFrame) -> DataFrame:
    cost = A.whole_dollars(F.col("projected_annual_cost"))
    sentence = (
        F.when(F.col("projected_annual_cost") > 500,
               F.concat(F.col("vendor"), F.lit(": High-cost subscription - projected $"), cost, F.lit("/year ($"),
                        A.whole_dollars(A.round_half_even("monthly_estimate", 2)), F.lit("/month)")))
        .when(F.col("projected_annual_cost") > 100,
              F.concat(F.col("vendor"), F.lit(": Medium-cost subscription - projected $"), cost, F.lit("/year")))
        .otherwise(F.concat(F.col("vendor"), F.lit(": Low-cost subscription - projected $"), cost, F.lit("/year"))))
    total = F.col("total_projected_annual_cost")
    overall = (
        F.when(total > 1000, F.concat(F.lit("Warning: Your subscriptions could cost $"), A.whole_dollars(total),
                                      F.lit(" annually ($"), A.whole_dollars(F.col("average_monthly_cost")), F.lit("/month)")))
        .when(total > 500, F.concat(F.lit("Moderate subscription spending: $"), A.whole_dollars(total),
                                    F.lit(" annually projected"))))
    return (detail.select("user_id", F.col("first_seq").alias("seq"), sentence.alias("insight"))
            .unionByName(summary.where(total > 500).select("user_id", F.lit(None).cast("long").alias("seq"), overall.alias("insight"))))


# --- savings -----------------------------------------------------------------------------------------------------

def category_savings(flagged: DataFrame, excluded: Sequence[str] = ()) -> DataFrame:
    """Reduction candidates among the five largest categories: discretionary, or above the mean category."""
    totals = expenses(flagged, excluded).groupBy("user_id", "category").agg(F.sum("total").alias("current_spending"))
    means = totals.groupBy("user_id").agg(F.avg("current_spending").alias("mean_spending"))
    order = W.partitionBy("user_id").orderBy(F.desc("current_spending"), "category")
    top = (totals.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= fv.TOP_CATEGORIES)
           .join(means, "user_id"))
    worth = X.contains_any(F.col("category"), fv.DISCRETIONARY_KEYWORDS) | (F.col("current_spending") > F.col("mean_spending"))
    return top.where(worth).select(
        "user_id", "rank", F.lit("category_reduction").alias("type"), "category", "current_spending",
        (F.col("current_spending") * fv.CATEGORY_SAVING).alias("potential_savings"),
        F.concat(F.lit("Reduce "), F.col("category"), F.lit(" spending by 20%")).alias("recommendation"))


def vendor_consolidation(flagged: DataFrame, excluded: Sequence[str] = ()) -> DataFrame:
    """Users with more than one grocery vendor, their vendors by spend, and a tenth of the total."""
    totals = (expenses(flagged, excluded).where(X.contains_any(F.col("vendor"), fv.GROCERY_KEYWORDS))
              .groupBy("user_id", "vendor").agg(F.sum("total").alias("spent")))
    merged = totals.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("spent").alias("current_spending"),
        F.array_sort(F.collect_list(F.struct((-F.col("spent")).alias("spent"), F.col("vendor")))).alias("listed"))
    savings = F.col("current_spending") * fv.CONSOLIDATION_SAVING
    return merged.where(F.col("n") > 1).select(
        "user_id", F.lit("vendor_consolidation").alias("type"), F.lit("Groceries").alias("category"),
        F.transform("listed", lambda v: v["vendor"]).alias("vendors"), "current_spending",
        savings.alias("potential_savings"),
        F.concat(F.lit("Consolidate grocery shopping to save ~$"), A.whole_dollars(savings)).alias("recommendation"))


def savings_opportunities(flagged: DataFrame, excluded: Sequence[str] = ()) -> DataFrame:
    return category_savings(flagged, excluded).unionByName(
        vendor_consolidation(flagged, excluded), allowMissingColumns=True)


def savings_insights(reductions: DataFrame) -> DataFrame:
    sentence = F.concat(F.lit("Reduce "), F.col("category"), F.lit(" spending by 20% to save ~$"),
                        A.whole_dollars(F.col("potential_savings")))
    return reductions.where(F.col("type") == "category_reduction").select("user_id", "rank", sentence.alias("insight"))


# --- cash flow ---------------------------------------------------------------------------------------------------------

def cash_flow(flagged: DataFrame, excluded: Sequence[str] = ()) -> DataFrame:
    """Weekly and monthly estimates per user in one aggregation."""
    spends = F.col("is_expense")
    if excluded:
        spends = spends & ~F.col("category").isin(*excluded)
    totals = flagged.groupBy("user_id").agg(
        F.sum(F.when(F.col("is_income"), F.col("total")).otherwise(0.0)).alias("total_income"),
        F.sum(F.when(spends, F.col("total")).otherwise(0.0)).alias("total_expenses"),
        A.at_least_one_day(A.elapsed_days(F.min("first"), F.max("last"))).alias("days"))
    weekly = totals.withColumns({
        "weekly_income_estimate": F.col("total_income") / F.col("days") * 7,
        "weekly_spending_estimate": F.col("total_expenses") / F.col("days") * 7,
    }).withColumn("weekly_net", F.col("weekly_income_estimate") - F.col("weekly_spending_estimate"))
    return weekly.withColumns({
        "monthly_net_estimate": F.col("weekly_net") * fv.WEEKS_PER_MONTH,
        "savings_rate": F.when(F.col("weekly_income_estimate") > 0,
                               F.try_divide("weekly_net", "weekly_income_estimate") * 100),
    })


def cash_flow_insights(flow: DataFrame) -> DataFrame:
    income, spending = F.col("weekly_income_estimate"), F.col("weekly_spending_estimate")
    sentence = (
        F.when(spending > income,
               F.concat(F.lit("Warning: You're spending $"), A.whole_dollars(spending - income),
                        F.lit(" more than you earn per week on average")))
        .otherwise(F.concat(F.lit("You save approximately $"), A.whole_dollars(F.col("weekly_net")),
                            F.lit(" per week ("), A.one_decimal(F.col("savings_rate")), F.lit("% savings rate)"))))
    return flow.where(income > 0).select("user_id", sentence.alias("insight"))


# --- documented summaries ------------------------------------------------------------------------------------------------

def weekday_weekend(df: DataFrame, kinds: DataFrame) -> DataFrame:
    """Mean and total expense of transactions on week days and at weekends."""
    return with_flow_flags(df, kinds).where("is_expense").groupBy("user_id", "is_weekend").agg(
        F.count(F.lit(1)).alias("transactions"), F.avg("amount_abs").alias("average_amount"),
        F.sum("amount_abs").alias("total_amount"))


def category_share(flagged: DataFrame) -> DataFrame:
    """Share of each category in the user's expenses, from category totals."""
    totals = flagged.where("is_expense").groupBy("user_id", "category").agg(F.sum("total").alias("total_amount"))
    whole = totals.groupBy("user_id").agg(F.sum("total_amount").alias("all_categories"))
    return totals.join(whole, "user_id").select(
        "user_id", "category", "total_amount", F.try_divide("total_amount", "all_categories").alias("share"))
