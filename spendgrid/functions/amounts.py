"""Amount parsing, directions, calendar features and small arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spendgrid import fixed_values as fv
from spendgrid.functions.text import strip

NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
LEADING_NUMBER = r"^-?(\d+\.?\d*|\.\d+)"
MICROS_PER_DAY = 86_400_000_000


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_amount(c: Column | str) -> Column:
    """Text amount to double: parentheses mean negative, ``,`` and ``$`` are dropped, bad text is 0."""
    c = _col(c).cast("string")
    bracketed = F.contains(c, F.lit("(")) & F.contains(c, F.lit(")"))
    text = F.when(bracketed, F.concat(F.lit("-"), F.translate(c, "()", ""))).otherwise(c)
    text = strip(F.translate(text, ",$", ""))
    return F.when(F.rlike(text, F.lit(NUMBER)), text.try_cast("double")).otherwise(F.lit(0.0))


def numeric_amount(c: Column | str) -> Column:
    """A numeric amount with missing values as 0."""
    c = _col(c).cast("double")
    return F.when(c.isNull() | F.isnan(c), F.lit(0.0)).otherwise(c)


def sheet_amount(c: Column | str) -> Column:
    """Keep digits, dots and minus signs, then the longest numeric prefix; null when there is none."""
    text = F.regexp_replace(_col(c), r"[^0-9.-]", "")
    return F.regexp_extract(text, LEADING_NUMBER, 0).try_cast("double")


def sheet_direction(amount: Column | str) -> Column:
    return _col(amount) >= 0


def direction_label(money_in: Column | str) -> Column:
    c = _col(money_in)
    return F.when(c, F.lit("IN")).when(~c, F.lit("OUT")).otherwise(F.lit(""))


def category_or_unknown(c: Column | str) -> Column:
    c = _col(c)
    return F.when(c.isNull() | (c == ""), F.lit("Unknown")).otherwise(c)


def finite_or_null(c: Column | str) -> Column:
    """Whether an amount is absent or a finite number."""
    c = _col(c)
    return c.isNull() | (~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))


def lenient_timestamp(c: Column | str) -> Column:
    """Text to timestamp, bad text to null."""
    return _col(c).try_cast("timestamp")


def day_of_week(c: Column | str) -> Column:
    """Monday is 0."""
    return F.weekday(_col(c))


def iso_timestamp(c: Column | str) -> Column:
    return F.date_format(_col(c), "yyyy-MM-dd'T'HH:mm:ss")


def iso_date(c: Column | str) -> Column:
    return F.date_format(_col(c), "yyyy-MM-dd")


def elapsed_days(first: Column | str, last: Column | str) -> Column:
    """Whole periods of 24 hours between two timestamps (not a calendar difference)."""
    micros = F.unix_micros(_col(last).cast("timestamp")) - F.unix_micros(_col(first).cast("timestamp"))
    return F.floor(micros / F.lit(MICROS_PER_DAY)).cast("long")


def at_least_one_day(days: Column) -> Column:
    return F.when(days == 0, F.lit(1)).otherwise(days)


def round_half_even(c: Column | str, places: int = 2) -> Column:
    """Round the binary value half to even, as correctly rounded decimal conversion does.

    ``bround`` works on the shortest decimal text of a double, so 0.545 (which is stored slightly
    above) would go down.  Here the rounding error of the scaling product decides exact halves; it is
    the usual split of a double into two halves whose products are exact.
    """
    c = _col(c).cast("double")
    factor = float(10 ** places)
    scaled = c * factor
    split = c * F.lit(134217729.0)
    high = split - (split - c)
    error = (high * factor - scaled) + (c - high) * factor
    below = F.floor(scaled)
    even = F.when(F.pmod(below, F.lit(2)) == 0, below).otherwise(below + 1)
    half = F.when(error > 0, below + 1).when(error < 0, below).otherwise(even)
    return F.when(scaled - below == 0.5, half).otherwise(F.rint(scaled)).cast("double") / factor


def whole_dollars(c: Column) -> Column:
    """Text of an amount rounded half to even."""
    return F.bround(c, 0).cast("long").cast("string")


def one_decimal(c: Column) -> Column:
    return F.format_string("%.1f", round_half_even(c, 1))


def two_decimals(c: Column) -> Column:
    return F.format_string("%.2f", round_half_even(c, 2))


def int8_scale(largest: Column) -> Column:
    return F.when(largest > 0, largest / F.lit(float(fv.INT8_LEVELS))).otherwise(F.lit(1.0))
