"""The text functions as nested SQL expressions, from the same pattern text."""

from __future__ import annotations

from spendgrid import fixed_values as fv
from spendgrid.functions.text import STOP_WORDS


def _lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def replace_all(x: str, patterns, replacement: str, flags: str = "gi") -> str:
    for pattern in patterns:
        x = f"regexp_replace({x}, {_lit(pattern)}, {_lit(replacement)}, '{flags}')"
    return x


def rules(x: str, pairs, flags: str = "gi") -> str:
    for pattern, replacement in pairs:
        x = f"regexp_replace({x}, {_lit(pattern)}, {_lit(replacement)}, '{flags}')"
    return x


def collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def urls(x):
    return replace_all(x, fv.URL_EMAIL_PATTERNS, "", "g")


def prefixes(x):
    return strip(replace_all(x, fv.PREFIX_PATTERNS, ""))


def cards(x):
    return replace_all(x, fv.CARD_PATTERNS, " ")


def references(x):
    return replace_all(x, fv.REFERENCE_PATTERNS, " ")


def banks(x):
    return replace_all(x, fv.BANK_PATTERNS, " ")


def merchants(x):
    return replace_all(x, fv.MERCHANT_PATTERNS, " ")


def normalised(x):
    return f"trim({rules(f'lower({x})', fv.NORMALISE_RULES)})"


def first_containing(x: str, table, default: str) -> str:
    branches = []
    for result, words in table:
        hit = " OR ".join(f"contains(lower({x}), {_lit(w)})" for w in words)
        branches.append(f"WHEN {hit} THEN {_lit(result)}")
    return "CASE " + " ".join(branches) + f" ELSE {default} END"


_WORDS = ", ".join(_lit(w) for w in fv.NOISE_WORDS + STOP_WORDS)
_SHAPES = _lit("|".join(f"(?:{s})" for s in fv.NOISE_SHAPES))


def clean_ctes(source: str, column: str, name: str = "cleaned") -> str:
    """CTEs that end in ``name(column, cleaned)`` over the distinct texts of ``source``."""
    step1 = prefixes(urls("original"))
    return f"""
{name}0 AS MATERIALIZED (SELECT DISTINCT coalesce({column}, '') AS original FROM {source}),
{name}1 AS MATERIALIZED (SELECT original, {cards(step1)} AS t FROM {name}0),
{name}2 AS MATERIALIZED (SELECT original, {references('t')} AS t FROM {name}1),
{name}3 AS MATERIALIZED (SELECT original, {collapse(merchants(banks('t')))} AS t FROM {name}2),
{name}4 AS MATERIALIZED (SELECT original, t, regexp_extract(t, '"([^"]+)"', 1) AS quoted,
   array_to_string(list_filter(string_split({replace_all('t', fv.NOISE_PHRASES, ' ')}, ' '),
     lambda w: NOT (lower(w) IN ({_WORDS}) OR regexp_matches(w, {_SHAPES}) OR regexp_matches(w, '^[^\\p{{L}}\\p{{N}}]*$'))), ' ') AS kept FROM {name}3),
{name}5 AS MATERIALIZED (SELECT original, CASE WHEN quoted <> '' THEN {strip('quoted')} WHEN length(trim(kept)) <= 2 THEN t ELSE kept END AS t FROM {name}4),
{name}6 AS MATERIALIZED (SELECT original, {collapse(f'lower({normalised("t")})')} AS t,
   {collapse(replace_all(cards('original'), [fv.FALLBACK_LONG_NUMBER], '', 'g'))} AS simple,
   {collapse(replace_all('original', [fv.FALLBACK_CARD_MASK], '', 'g'))} AS minimal FROM {name}5),
{name} AS MATERIALIZED (SELECT original, CASE WHEN length(t) > 3 THEN t WHEN length(simple) > 3 THEN lower(simple)
   WHEN length(minimal) > 3 THEN lower(minimal) ELSE t END AS cleaned FROM {name}6)"""


def vendor_key(x):
    return collapse(f"regexp_replace({collapse(f'lower({x})')}, {_lit(fv.LONG_NUMBER)}, '', 'g')")


# Longest common subsequences of the texts in pairs(a, b, x, y), a letter of y a step; v has a bit for every letter of x.
COMMON = """,
letters AS MATERIALIZED (SELECT x, c, bit_or(1::HUGEINT << (i - 1)::INT) AS mask FROM (SELECT DISTINCT x, unnest(string_split(x, '')) AS c, unnest(range(1, length(x) + 1)) AS i FROM texts) GROUP BY ALL),
common(x, y, k, v) AS (SELECT DISTINCT x, y, 1, (1::HUGEINT << length(x)::INT) - 1 FROM texts UNION ALL
  SELECT common.x, y, k + 1, ((v + (v & coalesce(mask, 0::HUGEINT))) | (v - (v & coalesce(mask, 0::HUGEINT)))) & ((1::HUGEINT << length(common.x)::INT) - 1)
  FROM common LEFT JOIN letters ON letters.x = common.x AND letters.c = substr(y, k, 1) WHERE k <= length(y)),
ratios AS MATERIALIZED (SELECT x, y, 2.0::DOUBLE * (length(x) - bit_count(v)) / (length(x) + length(y)) AS ratio FROM common WHERE k = length(y) + 1)"""
