"""Cleaning as DataFrame jobs: distinct texts once, then back to every row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spendgrid import fixed_values as fv
from spendgrid.functions import text as X
from spendgrid.session import cut_lineage, cut_rows


def clean(df: DataFrame, column: str = "description", output: str = "cleaned",
          config: X.CleaningConfig = X.CleaningConfig()) -> DataFrame:
    """Add the cleaned text; a narrow projection, no shuffle."""
    return df.withColumn(output, X.clean_description(column, config))


def with_cleaned(df: DataFrame, column: str = "description", config: X.CleaningConfig = X.CleaningConfig(), output: str = "cleaned") -> DataFrame:
    """Add the cleaned text, computed once for every distinct text, written, and joined back.

    The written side has one row per text, so a popular text is a skewed key of one side only, which the
    planner broadcasts by its measured size or splits at run time.
    """
    texts = df.select(F.col(column).alias("_text")).distinct()
    table = cut_rows(texts.select("_text", X.clean_description("_text", config).alias(output)))
    return df.join(table, F.col(column).eqNullSafe(F.col("_text")), "left").drop("_text")


def cleaned_names(df: DataFrame, cleaned: str = "cleaned", order: str = "seq", by: list[str] | None = None) -> DataFrame:
    """Distinct non-empty cleaned names, of each value of ``by``, with the first order key that has each.

    Emptiness is tested on an aggregate: a filter on the name itself would be pushed below the
    cleaning and run the whole chain a second time.
    """
    names = df.groupBy(*(by or []), F.col(cleaned).alias("name")).agg(
        F.min(order).alias("first_seq"), F.max(F.length(cleaned)).alias("_length"))
    return names.where(F.col("_length") > 0).drop("_length")


def dictionary_names(df: DataFrame, column: str = "ENTITY_NAME") -> DataFrame:
    """Business names of a dictionary: trimmed, lower-cased, blanks dropped, distinct."""
    name = F.lower(X.strip(F.col(column)))
    return df.select(name.alias("business")).where(F.length("business") > 0).distinct()


def match_dictionary(names: DataFrame, dictionary: DataFrame, column: str = "name") -> DataFrame:
    """The longest business name that occurs in each text at word boundaries of the text.

    A text is cut into its runs of consecutive words and those meet the dictionary in an equi-join, so
    no text is compared with every business.  Both sides are distinct; the answer is one row per text.
    """
    longest = dictionary.agg(F.max(F.size(F.split("business", " "))).alias("_words"))
    words = F.split(F.lower(column), " ")
    runs = F.flatten(F.transform(
        F.sequence(F.lit(0), F.size(words) - 1),
        lambda i: F.transform(F.sequence(F.lit(1), F.least(F.size(words) - i, F.col("_words"))),
                              lambda n: F.array_join(F.slice(words, i + 1, n), " "))))
    texts = names.select(column).distinct().join(F.broadcast(longest))  # one row
    found = (texts.where(F.length(column) > 0)
             .select(column, F.explode(F.array_distinct(runs)).alias("business"))
             .join(dictionary, "business"))
    best = found.groupBy(column).agg(F.min(F.struct((-F.length("business")).alias("l"), "business")).alias("m"))
    return best.select(column, F.col("m.business").alias("business"))


# --- effectiveness of cleaning -----------------------------------------------------------------------

def reduction(df: DataFrame, original: str = "description", cleaned: str = "cleaned") -> DataFrame:
    """Row, distinct and changed counts before and after cleaning, with their ratios."""
    pairs = df.groupBy(original, cleaned).agg(F.count(F.lit(1)).alias("n"))
    counts = pairs.agg(
        F.sum("n").alias("total"), F.count_distinct(original).alias("original_unique"),
        F.count_distinct(cleaned).alias("cleaned_unique"),
        F.sum(F.when(F.col(original) != F.col(cleaned), F.col("n")).otherwise(0)).alias("transformed"))
    before, after, total = F.col("original_unique"), F.col("cleaned_unique"), F.col("total")
    return counts.withColumns({
        "duplicate_ratio_before": F.try_divide(total - before, total),
        "duplicate_ratio_after": F.try_divide(total - after, total),
        "reduction_ratio": F.try_divide(before - after, before),
        "reduction_percent": F.coalesce(F.try_divide(before - after, before) * 100, F.lit(0.0)),
        "transformed_ratio": F.try_divide("transformed", "total"),
    })


def variations(df: DataFrame, original: str = "description", cleaned: str = "cleaned",
               order: str = "seq") -> DataFrame:
    """Every (cleaned, original) pair with its count and first order key: one row per variation.

    A list per cleaned text would gather all variations of a popular merchant in one row; the long
    form holds the same information and stays distributed.
    """
    return df.groupBy(cleaned, original).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first_seq"))


def variation_counts(pairs: DataFrame, cleaned: str = "cleaned") -> DataFrame:
    return pairs.groupBy(cleaned).agg(
        F.sum("n").alias("occurrence_count"), F.count(F.lit(1)).alias("variation_count"))


def first_variations(pairs: DataFrame, keep: int, original: str = "description", cleaned: str = "cleaned") -> DataFrame:
    """At most ``keep`` variations per cleaned text, earliest first, as a short list."""
    order = W.partitionBy(cleaned).orderBy("first_seq", original)
    return (pairs.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= keep)
            .groupBy(cleaned).agg(F.array_sort(F.collect_list(F.struct("_rank", original))).alias("_list"))
            .select(cleaned, F.transform("_list", lambda v: v[original]).alias("variations")))


def top_cleaned(pairs: DataFrame, limit: int = 10, samples: int = 3, cleaned: str = "cleaned") -> DataFrame:
    """The most frequent cleaned texts with sample variations and the number left out."""
    pairs = cut_lineage(pairs)  # the reduced pairs are used twice, the cleaning should not run twice
    top = variation_counts(pairs, cleaned).orderBy(F.desc("occurrence_count"), cleaned).limit(limit)
    shown = first_variations(pairs.join(F.broadcast(top.select(cleaned)), cleaned, "left_semi"), samples, cleaned=cleaned)
    return top.join(shown, cleaned).withColumn(
        "more_variations", F.greatest(F.col("variation_count") - samples, F.lit(0)))


def group_totals(df: DataFrame, groups: str = "representative", original: str = "description",
                 keep: int = 10) -> DataFrame:
    """Rows, amount and up to ten first variations per group."""
    pairs = cut_lineage(df.groupBy(groups, original).agg(
        F.count(F.lit(1)).alias("n"), F.sum("amount").alias("amount"), F.min("seq").alias("first_seq")))
    totals = pairs.groupBy(groups).agg(F.sum("n").alias("transactions"), F.sum("amount").alias("total_amount"))
    return totals.join(first_variations(pairs, keep, original, groups), groups)
