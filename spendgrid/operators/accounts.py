"""Users, accounts, subscriptions and usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendgrid import fixed_values as fv


def latest_subscription(subscriptions: DataFrame) -> DataFrame:
    """Newest subscription per user; an aggregate with partial combination, not a window."""
    newest = subscriptions.groupBy("user_id").agg(F.max(F.struct("created_at", "id", "status", "plan")).alias("s"))
    return newest.select("user_id", F.col("s.id").alias("subscription_id"), F.col("s.status").alias("status"),
                         F.col("s.plan").alias("plan"), F.col("s.created_at").alias("created_at"))


def live_users(subscriptions: DataFrame) -> DataFrame:
    """Users whose newest subscription is active or on trial."""
    return latest_subscription(subscriptions).where(F.col("status").isin(*fv.LIVE_SUBSCRIPTION_STATUSES)).select("user_id")


def usage(calls: DataFrame) -> DataFrame:
    """Request count and last use per user."""
    return calls.groupBy("user_id").agg(F.count(F.lit(1)).alias("requests_count"), F.max("called_at").alias("last_used"))


def usage_statistics(users: DataFrame, accounts: DataFrame, subscriptions: DataFrame, calls: DataFrame,
                     models: DataFrame) -> DataFrame:
    """Usage, stored model rows and newest plan of every user that has an account."""
    stored = models.groupBy("user_id").agg(F.count(F.lit(1)).alias("embeddings_count"))
    newest = latest_subscription(subscriptions).select(
        "user_id", F.col("plan").alias("subscription_plan"), F.col("status").alias("subscription_status"))
    joined = (users.join(accounts.select("user_id", "account_id"), "user_id")
              .join(usage(calls), "user_id", "left").join(stored, "user_id", "left").join(newest, "user_id", "left"))
    return joined.select(
        "user_id", "email", F.coalesce("requests_count", F.lit(0)).alias("requests_count"), "last_used",
        F.coalesce("embeddings_count", F.lit(0)).alias("embeddings_count"), "subscription_plan", "subscription_status")


def resolve_api_keys(calls: DataFrame, users: DataFrame, accounts: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Presented API keys with their user, account, newest subscription and whether access is allowed."""
    newest = latest_subscription(subscriptions).select("user_id", "status", "plan")
    return (calls.join(users.select("api_key", "user_id"), "api_key", "left")
            .join(accounts.select("user_id", "account_id"), "user_id", "left")
            .join(newest, "user_id", "left")
            .withColumn("allowed", F.coalesce(F.col("status").isin(*fv.LIVE_SUBSCRIPTION_STATUSES), F.lit(False))))


def usage_windows(calls: DataFrame, now: Column) -> DataFrame:
    """Requests of the last day, week and month before ``now`` per user."""
    at = F.col("called_at").cast("timestamp")

    def within(days: int) -> Column:
        start = now.cast("timestamp") - F.expr(f"make_dt_interval({days})")
        return F.count_if((at > start) & (at <= now.cast("timestamp")))

    return calls.groupBy("user_id").agg(
        within(1).alias("daily"), within(7).alias("weekly"), within(30).alias("monthly"))
