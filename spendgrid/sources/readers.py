"""Readers: spreadsheet exports, bank statements, JSON requests, tables and stored models.

The CSV readers split into reading (all text, header row) and a function on a DataFrame with those
headers, so any other source of the same columns can be used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spendgrid import schema
from spendgrid.functions import amounts as A
from spendgrid.functions.text import strip
from spendgrid.operators.cleaning import dictionary_names

LABELLED_HEADERS = {"description": "description", "narrative": "description", "category": "category",
                    "amount": "amount", "amount spent": "amount"}
SCORING_HEADERS = {"description": "description", "narrative": "description", "details": "description",
                   "amount": "amount", "amount spent": "amount", "code": "code"}


def read_csv(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """A CSV with a header row; every column is text, so nothing is inferred from the data."""
    return spark.read.csv(path, header=True, sep=sep, inferSchema=False, multiLine=False, escape='"')


def _mapped(df: DataFrame, headers: dict[str, str], required: tuple[str, ...]) -> DataFrame:
    """Columns by header, ignoring case and outer spaces; the first column of a name counts."""
    found: dict[str, Column] = {}
    for name in df.columns:
        target = headers.get(name.strip().lower())
        if target and target not in found:
            found[target] = F.col(f"`{name}`")
    missing = [r for r in required if r not in found]
    if missing:
        raise ValueError(f"missing columns {missing} among {df.columns}")
    known = {n.strip().lower() for n in headers}
    extra = [F.col(f"`{n}`") for n in df.columns if n.strip().lower() not in known]
    return df.select(*extra, *[c.alias(t) for t, c in found.items()])


def _with_amount(df: DataFrame) -> DataFrame:
    if "amount" not in df.columns:
        return df.withColumns({"amount": F.lit(None).cast("double"), "money_in": F.lit(None).cast("boolean")})
    parsed = A.sheet_amount("amount")
    return df.withColumns({"amount": parsed, "money_in": A.sheet_direction(parsed)})


def labelled_rows(df: DataFrame) -> DataFrame:
    """Training rows with description, category, amount and direction; incomplete rows are dropped."""
    rows = _mapped(df, LABELLED_HEADERS, ("description", "category"))
    complete = (F.length("description") > 0) & (F.length("category") > 0)
    return _with_amount(rows.where(complete))


def distinct_categories(labelled: DataFrame) -> DataFrame:
    return labelled.select("category").distinct()


def scoring_rows(df: DataFrame) -> DataFrame:
    """Rows to score with description, amount, direction and code."""
    rows = _with_amount(_mapped(df, SCORING_HEADERS, ("description",)))
    return rows if "code" in rows.columns else rows.withColumn("code", F.lit(None).cast("string"))


def merchant_rows(df: DataFrame) -> DataFrame:
    """Training rows whose description may sit under description or merchant."""
    by_name = {}
    for name in df.columns:
        by_name.setdefault(name.strip().lower(), []).append(F.col(f"`{name}`"))
    first = [F.nullif(c, F.lit("")) for n in ("description", "merchant") for c in by_name.get(n, [])]
    category = [F.nullif(c, F.lit("")) for c in by_name.get("category", [])]
    if not first or not category:
        raise ValueError(f"no description or category among {df.columns}")
    used = ("description", "merchant", "category")
    extra = [F.col(f"`{n}`") for n in df.columns if n.strip().lower() not in used]
    rows = df.select(*extra, F.coalesce(*first).alias("description"), F.coalesce(*category).alias("category"))
    return rows.where(F.col("description").isNotNull() & F.col("category").isNotNull())


def statement_rows(df: DataFrame, limit: int | None = None, order: str | None = None) -> DataFrame:
    """Bank statement rows: non-empty details, particulars and code joined by a space.

    ``limit`` keeps the first rows by ``order``, counted before empty rows are dropped.
    """
    if limit is not None:
        if order is None:
            raise ValueError("a limit needs an order column")
        df = df.orderBy(order).limit(limit)
    parts = [F.nullif(strip(F.coalesce(F.col(c), F.lit(""))), F.lit("")) for c in ("Details", "Particulars", "Code")]
    rows = df.withColumn("description", F.concat_ws(" ", *parts))
    return rows.where(F.length("description") > 0)


def request_elements(requests: DataFrame, column: str = "transactions") -> DataFrame:
    """Elements of JSON arrays that hold plain strings and objects side by side.

    Adds ``index``, ``description``, ``money_in`` and ``amount``; for a string only the description is set.
    """
    elements = F.try_variant_get(F.try_parse_json(F.col(column)), "$", "array<variant>")
    kept = [c for c in requests.columns if c != column]
    rows = requests.select(*kept, F.posexplode(elements).alias("index", "_e"))
    is_object = F.schema_of_variant("_e").startswith("OBJECT")

    def field(name: str, kind: str) -> Column:
        return F.when(is_object, F.try_variant_get("_e", f"$.{name}", kind))

    text = F.when(is_object, F.try_variant_get("_e", "$.description", "string")).otherwise(
        F.try_variant_get("_e", "$", "string"))
    return rows.select(*kept, "index", text.alias("description"), field("money_in", "boolean").alias("money_in"),
                       field("amount", "double").alias("amount"))


def analytics_requests(spark: SparkSession, path: str) -> DataFrame:
    """Analytics requests, one JSON object per line, as one row per transaction."""
    return explode_analytics(spark.read.schema(schema.ANALYTICS_REQUEST).json(path))


def explode_analytics(requests: DataFrame) -> DataFrame:
    rows = requests.select("user_id", F.posexplode("transactions").alias("seq", "t"))
    return rows.select("user_id", F.col("seq").cast("long").alias("seq"), "t.*")


def category_list(spark: SparkSession, path: str) -> DataFrame:
    """Category names from a JSON file that holds one array of strings."""
    text = spark.read.text(path, wholetext=True)
    names = text.select(F.posexplode(F.from_json("value", "array<string>")).alias("seq", "name"))
    return names.select(F.col("seq").cast("long").alias("seq"), F.col("name").alias("id"), "name")


def business_dictionary(spark: SparkSession, path: str) -> DataFrame:
    return dictionary_names(read_csv(spark, path))


def read_jdbc(spark: SparkSession, url: str, table: str, column: str | None = None, lower: int = 0, upper: int = 0,
              partitions: int = 1, **options: str) -> DataFrame:
    """A database table; with a numeric ``column`` the read is split over ``partitions`` tasks.

    Filters and column choices on the result reach the database.
    """
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if column is not None:
        reader = reader.options(partitionColumn=column, lowerBound=lower, upperBound=upper, numPartitions=partitions)
    return reader.load()


def sql_rows(spark: SparkSession, text: str, args: dict | None = None, **tables: DataFrame) -> DataFrame:
    """Rows of an SQL text with named parameters (``:name``) over DataFrames that stand in it as ``{name}``.

    Parameters are values, never text of the statement; filters on them reach the scans like any others.
    """
    return spark.sql(text, args=args or {}, **tables)


def partition_bounds(rows: DataFrame, column: str) -> tuple[int, int]:
    """Least and greatest value of a numeric column, as bounds for :func:`read_jdbc`; (0, 0) for no rows."""
    low, high = rows.agg(F.min(column), F.max(column)).first()
    return (0, 0) if low is None else (int(low), int(high) + 1)
