"""Secret scans: base patterns and character Markov models, in built-in expressions only.

Base spans come from three patterns.  Further spans come from two character Markov models, one of random strings and
one of ordinary identifiers, trained on labelled samples: a token is a secret when its log-likelihood ratio passes a
margin.  Base spans always stay; a model span never overlaps one.

Rows: a null text counts as empty and has no span; texts are scanned whole; repeated rows give repeated results; an
empty table gives an empty result; further columns are ignored.  Spans at the same start are ordered by kind.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendgrid.llm.shared import text_of

# The patterns of the base scan, their least lengths, the order of the kinds.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
ASSIGN_LEAST = 6
KINDS = ["assign", "access", "hex", "model"]

#: Tokens that the models judge, from the least length that they learn from.
TOKEN_LEAST = 6
TOKEN = r"[A-Za-z0-9+/_=-]{%d,}" % TOKEN_LEAST
#: Letters of the models; state 0 stands for the beginning.
LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
STATES = len(LETTERS) + 1
#: Rows of either label that the models learn from, the mean log ratio a transition must reach, and the
#: least sum of a token (measured on sf0.1, see the README; from 20 characters on the mean decides).
SAMPLE_ROWS = 20_000
MARGIN = 0.25
LEAST_TOTAL = 5.0

_SPANS = "array<struct<start:int,end:int,value:string>>"


def pattern_spans(text: Column, pattern: str, group: int = 0, keep: Callable[[Column], Column] | None = None) -> Column:
    """Leftmost non-overlapping matches with code-point positions: what lies between matches gives their places.

    ``keep`` says which values are returned; the others only count for the places.
    """
    between = F.split(text, pattern, -1)
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    lengths = F.zip_with(between, whole, lambda gap, hit: F.struct(F.length(gap).alias("gap"), F.length(hit).alias("hit")))
    wanted = F.transform(value, keep if keep else lambda _: F.lit(True))
    both = F.arrays_zip(F.slice(lengths, 1, F.size(whole)).alias("size"), value.alias("value"), wanted.alias("wanted"))

    def placed(done: Column, one: Column) -> Column:
        start = done["end"] + one["size"]["gap"]
        end = start + one["size"]["hit"]
        span = F.array(F.struct(start.alias("start"), end.alias("end"), one["value"].alias("value")))
        spans = F.when(one["wanted"], F.concat(done["spans"], span)).otherwise(done["spans"])
        return F.struct(end.alias("end"), spans.alias("spans"))

    none = F.struct(F.lit(0).alias("end"), F.array().cast(_SPANS).alias("spans"))
    found = F.aggregate(both, none, placed, lambda done: done["spans"])
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(_SPANS))


def _of_kind(spans: Column, kind: str) -> Column:
    order = KINDS.index(kind)
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("kind"), s["end"].alias("end")))


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.concat_ws(",", F.transform(F.array_sort(spans), lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))))


def with_base_spans(rows: DataFrame, text: str = "text") -> DataFrame:
    """``rows`` with ``_assign``, ``_access`` and ``_hex``, arrays of spans."""
    assign = F.filter(pattern_spans(F.col(text), ASSIGN, 2), lambda s: F.length(s["value"]) >= ASSIGN_LEAST)
    return rows.withColumns({"_assign": assign, "_access": pattern_spans(F.col(text), ACCESS),
                             "_hex": pattern_spans(F.col(text), HEX)})


def labelled_samples(docs: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """``(token, random)``: values of base spans, and ordinary words, ``rows`` of either label at most.

    Words of all plain texts are drawn from, each once.  The sample is bounded and drawn by hash, so that it does not depend on the order of rows.
    """
    texts = docs.select(text_of().alias("text"))
    secret = texts.where(F.col("text").rlike(f"{ACCESS}|{HEX}|{ASSIGN}"))
    found = with_base_spans(secret)
    values = found.select(F.explode(F.concat("_assign", "_access", "_hex")).alias("hit")).select(F.col("hit.value").alias("token"))
    # A random string stays one when written in capitals, or its digest in base 64: other alphabets are learnt as well.
    values = values.select(F.explode(F.array("token", F.upper("token"), F.base64(F.unhex(F.sha2("token", 256))))).alias("token"))
    plain = texts.where(~F.col("text").rlike(f"{ACCESS}|{HEX}|{ASSIGN}"))
    words = (plain.select(F.explode(F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0))).alias("token")).distinct()
             .select(F.explode(F.array("token", F.upper("token"))).alias("token")))

    def bounded(side: DataFrame, label: bool) -> DataFrame:
        return (side.where(F.length("token") >= 6).distinct().orderBy(F.xxhash64("token"), "token").limit(rows)
                .withColumn("random", F.lit(label)))

    return bounded(values, True).unionByName(bounded(words, False))


class Markov:
    """Log ratios of the transitions of two models with add-one smoothing."""

    def __init__(self, ratios: list[float]):
        self.ratios = ratios

    @staticmethod
    def train(samples: DataFrame) -> Markov:
        """From ``(token, random)``.  Only the bounded table of transitions reaches the driver."""
        steps = samples.select("random", F.explode(_transitions(F.col("token"))).alias("step"))
        counts = {(r["random"], r["step"]): r["n"] for r in steps.groupBy("random", "step").agg(F.count(F.lit(1)).alias("n")).collect()}
        ratios = []
        for before in range(STATES):
            sums = [sum(counts.get((label, before * STATES + after), 0) for after in range(STATES)) for label in (True, False)]
            for after in range(STATES):
                p = [math.log((counts.get((label, before * STATES + after), 0) + 1) / (total + STATES))
                     for label, total in zip((True, False), sums)]
                ratios.append(p[0] - p[1])
        return Markov(ratios)

    def total(self, token: Column) -> Column:
        """Summed log-likelihood ratio of the transitions; above 0 the token looks random."""
        table = F.from_json(F.lit(json.dumps(self.ratios)), "array<double>")  # folded to one constant
        return F.aggregate(_transitions(token), F.lit(0.0), lambda total, step: total + F.element_at(table, step + 1))

    def score(self, token: Column) -> Column:
        """Mean log-likelihood ratio of a transition."""
        return self.total(token) / F.length(token)

    def is_random(self, token: Column, margin: float = MARGIN) -> Column:
        """Whether the sum passes the margin of a transition for each, and :data:`LEAST_TOTAL`, which short tokens need."""
        return self.total(token) > F.greatest(F.length(token) * margin, F.lit(LEAST_TOTAL))


def _transitions(token: Column) -> Column:
    """Numbers of the transitions of a token, the first one from the beginning; letters not listed share state 0."""
    def state(place: Column) -> Column:
        return F.instr(F.lit(LETTERS), F.substring(token, place, F.lit(1)))

    return F.transform(F.sequence(F.lit(1), F.length(token)),
                       lambda i: F.when(i > 1, state(i - 1)).otherwise(F.lit(0)) * STATES + state(i))


def scan(docs: DataFrame, model: Markov, margin: float = MARGIN) -> DataFrame:
    """Per row ``doc_id, n_assign, n_access, n_hex, base_sha256, spans``."""
    base = with_base_spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")))
    kinds = F.concat(_of_kind(F.col("_assign"), "assign"), _of_kind(F.col("_access"), "access"), _of_kind(F.col("_hex"), "hex"))
    tokens = pattern_spans(F.col("text"), TOKEN, keep=lambda value: model.is_random(value, margin))
    judged = base.withColumn("_base", kinds).withColumn("_tokens", tokens)
    added = F.filter("_tokens", lambda t: ~F.exists("_base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
    return judged.select(
        "doc_id", F.size("_assign").cast("long").alias("n_assign"), F.size("_access").cast("long").alias("n_access"),
        F.size("_hex").cast("long").alias("n_hex"), F.sha2(_joined(F.col("_base")), 256).alias("base_sha256"),
        _joined(F.concat("_base", _of_kind(added, "model"))).alias("spans"))
