"""Schemas of requests, canonical transactions and stored models."""

from pyspark.sql import types as T

LABELLED = T.StructType([
    T.StructField("description", T.StringType(), False),
    T.StructField("Category", T.StringType()),
])

ANALYTICS_ROW = T.StructType([
    T.StructField("description", T.StringType()),
    T.StructField("Narrative", T.StringType()),
    T.StructField("amount", T.DoubleType()),
    T.StructField("Amount_Spent", T.DoubleType()),
    T.StructField("category", T.StringType()),
    T.StructField("cat", T.StringType()),
    T.StructField("date", T.StringType()),
    T.StructField("transaction_date", T.StringType()),
    T.StructField("money_in", T.BooleanType()),
    T.StructField("Source", T.StringType()),
])

ANALYTICS_REQUEST = T.StructType([
    T.StructField("user_id", T.LongType()),
    T.StructField("transactions", T.ArrayType(ANALYTICS_ROW)),
    T.StructField("analysis_types", T.ArrayType(T.StringType())),
    T.StructField("excluded_categories", T.ArrayType(T.StringType())),
])
