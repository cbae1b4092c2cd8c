"""Request rows to canonical transactions, and the row rules that go with them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendgrid import fixed_values as fv
from spendgrid.functions import amounts as A
from spendgrid.functions import text as X
from spendgrid.session import cut_lineage, settled

ALIASES = {
    "amount": ("amount", "Amount Spent", "amount_spent", "Amount_Spent"),
    "description": ("description", "Description", "desc", "narrative"),
    "category": ("category", "Category", "cat"),
    "date": ("date", "Date", "transaction_date"),
}


def _quoted(name: str) -> Column:
    return F.col(f"`{name}`")


def resolve_aliases(df: DataFrame, now: Column | None = None) -> DataFrame:
    """Amount, description, category and date from whichever alias columns exist.

    Where several aliases exist the first non-null value of the row counts, so a typed request frame
    (which always has every column) behaves like a ragged one.  A missing date column means ``now``.
    """
    present = {name.lower(): name for name in df.columns}
    chosen = {}
    for target, names in ALIASES.items():
        columns = list(dict.fromkeys(present[n.lower()] for n in names if n.lower() in present))
        if columns:
            chosen[target] = F.coalesce(*[_quoted(c) for c in columns])
        elif target == "date":
            chosen[target] = now if now is not None else F.current_timestamp()
        else:
            raise ValueError(f"no {target} column among {df.columns}")
    used = {n.lower() for names in ALIASES.values() for n in names}
    kept = [_quoted(c) for c in df.columns if c.lower() not in used]
    return df.select(*kept, *[value.alias(target) for target, value in chosen.items()])


def prepare_transactions(df: DataFrame, infer_missing_direction: bool = False,
                         now: Column | None = None) -> DataFrame:
    """Canonical transactions with parsed amount, category, direction, vendor and calendar features.

    A missing direction counts as money out unless ``infer_missing_direction`` is set; the sign of the
    amount decides only when there is no direction column at all.
    """
    df = resolve_aliases(df, now)
    amount_type = df.schema["amount"].dataType
    textual = isinstance(amount_type, T.StringType)
    amount = A.parse_amount("amount") if textual else A.numeric_amount("amount")
    date_is_text = isinstance(df.schema["date"].dataType, T.StringType)
    df = df.withColumns({
        "amount": amount,
        "date": A.lenient_timestamp("date") if date_is_text else F.col("date"),
        "category": A.category_or_unknown("category"),
    })
    if "money_in" in df.columns:
        missing = (F.col("amount") > 0) if infer_missing_direction else F.lit(False)
        direction = F.coalesce("money_in", missing)
    else:
        direction = F.col("amount") > 0
    weekday = A.day_of_week("date")
    return df.withColumns({
        "amount_abs": F.abs("amount"),
        "money_in": direction,
        "vendor": X.vendor_name("description"),
        "month": F.month("date"),
        "day_of_week": weekday,
        "is_weekend": F.coalesce(weekday.isin(5, 6), F.lit(False)),
    })


def with_vendors(df: DataFrame, column: str = "description", output: str = "vendor") -> DataFrame:
    """Add the vendor, found once for every distinct text, written, and joined back."""
    texts = df.select(F.col(column).alias("_text")).distinct()
    table = cut_lineage(texts.select("_text", X.vendor_name("_text").alias(output)))
    return df.drop(output).join(table, F.col(column).eqNullSafe(F.col("_text")), "left").drop("_text")


def prepared_once(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Canonical transactions for steps that read them several times: vendors found once a text, rows written.

    ``columns`` names those that are wanted, besides the vendor.  The rows that texts are taken from and vendors joined
    to are written first, so they are built once and not for each.
    """
    rows = prepare_transactions(df).drop("vendor")
    return settled(lambda: with_vendors(cut_lineage(rows if columns is None else rows.select("description", *columns))))


def valid_descriptions(df: DataFrame, column: str = "description") -> DataFrame:
    """Rows with a non-blank description, trimmed."""
    return df.withColumn(column, X.strip(F.col(column))).where(F.length(column) > 0)


def rejected_descriptions(df: DataFrame, column: str = "description") -> DataFrame:
    """The rows :func:`valid_descriptions` leaves out, with a reason."""
    blank = F.coalesce(F.length(X.strip(F.col(column))), F.lit(0)) == 0
    return df.where(blank).withColumn("reject_reason", F.lit("description must not be blank"))


def finite_amounts(df: DataFrame, column: str = "amount") -> DataFrame:
    return df.where(A.finite_or_null(column))


def enough_rows(df: DataFrame, by: Sequence[str] = ("user_id",), least: int = fv.MIN_TRAINING_ROWS) -> DataFrame:
    """Rows of the groups that have at least ``least`` rows (a semi join on a small aggregate)."""
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") >= least)
    return df.join(sizes.select(*by), list(by), "left_semi")


def too_few_rows(df: DataFrame, by: Sequence[str] = ("user_id",), least: int = fv.MIN_TRAINING_ROWS) -> DataFrame:
    """The rows :func:`enough_rows` leaves out."""
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") >= least)
    return df.join(sizes.select(*by), list(by), "left_anti")


def without_categories(df: DataFrame, excluded: Sequence[str], ignore_case: bool = False) -> DataFrame:
    """Drop rows of user-listed categories; the list is an argument, never data."""
    if not excluded:
        return df
    if ignore_case:
        return df.where(~F.lower("category").isin(*[c.lower() for c in excluded]))
    return df.where(~F.col("category").isin(*excluded))


def length_warnings(df: DataFrame, index: str = "seq", column: str = "description",
                    longest: int = fv.MAX_DESCRIPTION) -> DataFrame:
    """One warning row per description that is missing or too long."""
    head = F.concat(F.substring(F.coalesce(F.col(column), F.lit("None")), 1, fv.WARNING_PREFIX), F.lit("..."))
    message = (F.when(F.col(column).isNull(), F.lit("Description must be a string"))
               .otherwise(F.lit(f"Description too long (max {longest} characters)")))
    return (df.where(F.col(column).isNull() | (F.length(column) > longest))
            .select(F.col(index).alias("index"), head.alias("description"), message.alias("error")))


def truncated(c: Column | str, length: int) -> Column:
    return F.substring(F.col(c) if isinstance(c, str) else c, 1, length)


def combine_code(description: Column, code: Column) -> Column:
    """Description and code joined by a space, null when both are blank."""
    text = F.trim(F.concat_ws(" ", description, code))
    return F.when(F.length(text) > 0, text)
