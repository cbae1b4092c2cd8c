"""Mixing sources to target weights by temperature.

The token shares of the sources are raised to an exponent and normalised.  The exponent is bisected until the weights
reach a target entropy (as a share of the greatest possible one) or until no source is repeated more often than a
limit.  The weights are realised as a budget of tokens per source: whole passes over the source, and one partial pass
over a permutation of its blocks, cut by running token totals.  Only one block per source straddles its cut, and only
its rows are ordered one by one.

Rows: a null source is a source of its own; a null or empty text has no tokens, is part of whole passes and of the
partial pass where its place falls before the cut; ties of the permutation are broken by id and text; repeated rows
are taken together; an empty table or a budget of 0 gives no copies; further columns are kept by
:func:`mixed_documents`.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spendgrid.llm.shared import apart, small_side, stored, text_of
from spendgrid.operators.ordered import running_sum

BLOCK_ROWS = 1024
ENTROPY = 0.97
REPEATS = 4.0
BUDGET = 1.0
STEPS = 60
SEED = "mix"
LEAST_EXPONENT = 0.0


def weights_at(tokens: list[int], exponent: float) -> list[float]:
    """Normalised powers of the token shares; sources without tokens weigh nothing."""
    total = sum(tokens)
    powers = [(t / total) ** exponent if t > 0 else 0.0 for t in tokens]
    whole = sum(powers)
    return [p / whole for p in powers]


def _entropy(weights: list[float]) -> float:
    return -sum(w * math.log(w) for w in weights if w > 0)


def _least_budget(tokens: list[int], weights: list[float]) -> int:
    """The least budget by which every source is passed once."""
    return max(math.ceil((t + 1) / w) for t, w in zip(tokens, weights) if t)


def find_exponent(tokens: list[int], budget: float | None, entropy: float | None = ENTROPY, repeats: float | None = REPEATS) -> float:
    """The largest exponent up to 1 with the target entropy, raised again where a source would pass the repetition limit.

    Entropy falls and the repetition of small sources falls as the exponent grows, so both are bisected.  Without a budget
    the repetition is that of the least budget that passes every source once, which depends on the exponent itself; where
    even the token shares repeat a source more often (one of very few tokens), they are what is taken.
    """
    live = [t for t in tokens if t > 0]
    if len(live) < 2:
        return 1.0

    def bisect(enough) -> float:
        low, high = LEAST_EXPONENT, 1.0
        for _ in range(STEPS):
            middle = (low + high) / 2
            low, high = (middle, high) if enough(middle) else (low, middle)
        return low

    exponent = 1.0
    if entropy is not None:
        target = entropy * math.log(len(live))
        if _entropy(weights_at(live, 1.0)) < target:
            exponent = bisect(lambda x: _entropy(weights_at(live, x)) >= target)
    if repeats is not None:
        def most(x: float) -> float:
            weights = weights_at(live, x)
            aim = _least_budget(live, weights) if budget is None else budget
            return max(w * aim / t for w, t in zip(weights, live))

        if most(exponent) > repeats and (budget is None or budget / sum(live) <= repeats):
            low, high = exponent, 1.0
            for _ in range(STEPS):
                middle = (low + high) / 2
                low, high = (middle, high) if most(middle) > repeats else (low, middle)
            exponent = high
    return exponent


def word_count(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text."""
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def measured(docs: DataFrame, tokens: Column | None = None) -> DataFrame:
    """Written rows ``(doc_id, source, text_sha256, n_tokens, same, place)``: ``same`` rows repeat one another, ``place`` is their hash."""
    text = text_of()
    count = word_count(text) if tokens is None else tokens
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
                       F.sha2(text, 256).alias("text_sha256"), count.alias("n_tokens"))
    rows = rows.groupBy("doc_id", "source", "text_sha256").agg(F.min("n_tokens").alias("n_tokens"), F.count(F.lit(1)).alias("same"))
    return stored(rows.withColumn("place", F.md5(F.concat_ws(":", F.lit(SEED), "source", "doc_id", "text_sha256"))), "mix-rows")


def source_weights(rows: DataFrame, budget: float | None = BUDGET, entropy: float | None = ENTROPY,
                   repeats: float | None = REPEATS) -> DataFrame:
    """``(source, rows, tokens, weight, quota, passes, rest)``; ``budget`` is a share of all tokens.

    Without a budget the least one is taken by which every source is passed once, so that no row is left out; a source
    without tokens is passed once as well.

    The driver sees the exponent's target only as sums over sources: one row per source, bounded by their number.
    """
    spark = rows.sparkSession
    sums = rows.groupBy("source").agg(F.sum("same").alias("rows"), F.sum(F.col("n_tokens") * F.col("same")).alias("tokens")).orderBy("source").collect()
    tokens = [r["tokens"] for r in sums]
    live = sum(tokens) > 0
    aim = None if budget is None else math.floor(budget * sum(tokens))
    weights = weights_at(tokens, find_exponent(tokens, aim, entropy, repeats)) if live else [0.0] * len(sums)
    if budget is None:
        aim = _least_budget(tokens, weights) if live else 0
    out = []
    for r, w in zip(sums, weights):
        quota = math.floor(w * aim)
        passes, rest = divmod(quota, r["tokens"]) if r["tokens"] else (int(budget is None), 0)
        out.append((r["source"], r["rows"], r["tokens"], float(w), quota, passes, rest))
    return spark.createDataFrame(out, "source string, rows long, tokens long, weight double, quota long, passes long, rest long")


def _block_starts(totals: DataFrame) -> DataFrame:
    """``totals`` with ``before``: tokens of the blocks that come before in the permutation of the source.

    One order over all sources, summed in ranges, so that the blocks of a hot source fill many tasks.
    """
    ordered = totals.withColumn("_turn", F.md5(F.concat_ws(":", F.lit(SEED), "source", "block")))
    summed = running_sum(ordered, ["source", "_turn", "block"], F.col("in_block"), "_up_to")
    first = summed.groupBy(F.col("source").alias("_of")).agg(F.min(F.col("_up_to") - F.col("in_block")).alias("_first"))
    joined = summed.join(first, F.col("source").eqNullSafe(F.col("_of")))
    return joined.select("source", "block", "in_block", (F.col("_up_to") - F.col("in_block") - F.col("_first")).alias("before"))


def permuted_copies(rows: DataFrame, weights: DataFrame) -> DataFrame:
    """``rows`` with ``weight, copies, start``: how often each is taken, and where it begins in its source's permutation."""
    weights = small_side(weights.withColumnRenamed("source", "_source"), weights.count())
    placed = rows.join(weights, rows["source"].eqNullSafe(weights["_source"])).drop("_source")
    blocks = F.ceil(F.col("rows") / BLOCK_ROWS)
    placed = placed.withColumn("block", F.pmod(F.conv(F.substring("place", 1, 8), 16, 10).cast("long"), blocks))
    totals = placed.groupBy("source", "block").agg(F.sum(F.col("n_tokens") * F.col("same")).alias("in_block"))
    totals = _block_starts(totals)
    totals = totals.withColumnsRenamed({"source": "_source", "block": "_block"})
    joined = placed.join(totals, placed["source"].eqNullSafe(totals["_source"]) & (placed["block"] == totals["_block"])).drop("_source", "_block")
    inside = Window.partitionBy("source", "block").orderBy("place", "doc_id", "text_sha256")
    straddling = (F.col("before") < F.col("rest")) & (F.col("before") + F.col("in_block") > F.col("rest"))
    cut = joined.where(straddling).withColumn("start", F.col("before") + F.sum(F.col("n_tokens") * F.col("same")).over(inside) - F.col("n_tokens") * F.col("same"))
    whole = joined.where(~straddling).withColumn("start", F.col("before"))
    both = cut.unionByName(whole)
    taken = F.when(straddling, F.col("start") < F.col("rest")).otherwise(F.col("before") + F.col("in_block") <= F.col("rest"))
    return both.withColumn("copies", F.col("passes") + F.when(taken & (F.col("rest") > 0), 1).otherwise(0))


def mix(docs: DataFrame, budget: float | None = BUDGET, entropy: float | None = ENTROPY, repeats: float | None = REPEATS) -> DataFrame:
    """Per row of ``docs``: ``doc_id, source, n_tokens, weight, block, copies``; rows not taken have 0 copies."""
    rows = measured(docs)
    placed = permuted_copies(rows, source_weights(rows, budget, entropy, repeats))
    each = placed.withColumn("_same", F.explode(F.sequence(F.lit(1), F.col("same").cast("int"))))
    return each.select("doc_id", "source", "n_tokens", "weight", "block", "copies")


@apart
def mixed_documents(docs: DataFrame, budget: float | None = BUDGET, entropy: float | None = ENTROPY,
                    repeats: float | None = REPEATS) -> DataFrame:
    """The rows of ``docs``, each as often as it is taken, with all their columns."""
    rows = measured(docs)
    taken = permuted_copies(rows, source_weights(rows, budget, entropy, repeats)).where("copies > 0").select(
        F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("text_sha256").alias("_sha"), F.col("copies").alias("_copies"))
    same = (F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & F.col("source").cast("string").eqNullSafe(F.col("_source"))
            & (F.sha2(text_of(), 256) == F.col("_sha")))
    joined = docs.join(taken, same)
    return joined.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))).alias("_copy")).drop("_copy")
