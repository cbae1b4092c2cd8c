"""Registered queries for text cleaning and its evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from spendgrid import fixed_values as fv
from spendgrid.catalog import domain as D
from spendgrid.catalog import text_sql as S
from spendgrid.catalog.domain_sql import TX
from spendgrid.functions import text as X
from spendgrid.operators import cleaning as C
from spendgrid.operators import evaluate as V
from spendgrid.operators import prepare as P

QUERIES = {}
ORACLES = {}

CLEAN = TX + "," + S.clean_ctes("tx", "description")
DISTINCT = TX + ", d AS (SELECT DISTINCT description FROM tx)"


def register(name, oracle=None):
    def add(build):
        QUERIES[name] = build
        if oracle is not None:
            ORACLES[name] = "WITH " + oracle.strip()
        return build
    return add


def distinct_descriptions(spark, sf_dir):
    return D.transactions(spark, sf_dir).select("description").distinct()


def cleaned_transactions(spark, sf_dir):
    return C.with_cleaned(D.transactions(spark, sf_dir))


def _text_step(name, function, sql):
    register(name, DISTINCT + f" SELECT description, {sql('description')} AS result FROM d")(
        lambda spark, sf_dir: distinct_descriptions(spark, sf_dir).select("description", function("description").alias("result")))


_text_step("remove_urls_emails", X.remove_urls_emails, S.urls)
_text_step("remove_prefixes", X.remove_prefixes, S.prefixes)
_text_step("remove_card", X.remove_card_numbers, S.cards)
_text_step("remove_reference", X.remove_reference_codes, S.references)
_text_step("remove_bank", X.remove_bank_codes, S.banks)
_text_step("remove_merchant", X.remove_merchant_codes, S.merchants)
_text_step("normalize_merchant", X.normalize_merchant, S.normalised)
_text_step("clean_minimal", X.minimal_clean, lambda x: f"lower({S.collapse(S.rules(x, fv.MINIMAL_RULES, 'g'))})")
_text_step("clean_moderate", X.moderate_clean, lambda x: f"lower({S.collapse(S.rules(x, fv.MODERATE_RULES, 'g'))})")
_text_step("variants", X.normalize_variants, lambda x: S.strip(S.rules(f"lower({x})", fv.VARIANT_RULES)))
_text_step("aliases", X.resolve_alias, lambda x: S.first_containing(x, fv.MERCHANT_ALIASES, x))
_text_step("keyword_category", X.keyword_category, lambda x: S.first_containing(x, fv.MERCHANT_CATEGORIES, "'other'"))
_text_step("transfer_key", X.transfer_key, S.vendor_key)


@register("clean_full", CLEAN + " SELECT tx_id, cleaned FROM tx JOIN cleaned ON description = original")
def _(spark, sf_dir):
    return cleaned_transactions(spark, sf_dir).select("tx_id", "cleaned")


# No oracle: its word boundaries are ASCII only and the documents are not.
@register("clean_documents")
def _(spark, sf_dir):
    return C.clean(D.table(spark, sf_dir, "documents"), "text").select("doc_id", "cleaned")


@register("length_warnings", """
w AS (SELECT doc_id AS index, substr(text, 1, 50) || '...' AS description, 'Description too long (max 500 characters)' AS error
  FROM documents WHERE length(text) > 500) SELECT * FROM w""")
def _(spark, sf_dir):
    return P.length_warnings(D.table(spark, sf_dir, "documents"), "doc_id", "text")


@register("valid_descriptions", r"""
lines AS (SELECT conv_id, turn, regexp_replace(text, '^\s+|\s+$', '', 'g') AS text FROM conversations)
SELECT conv_id, turn, text FROM lines WHERE length(text) > 0""")
def _(spark, sf_dir):
    return P.valid_descriptions(D.table(spark, sf_dir, "conversations"), "text").select("conv_id", "turn", "text")


@register("dictionary_match", CLEAN + """,
business AS (SELECT DISTINCT lower(trim(p_name)) AS business FROM part WHERE length(trim(p_name)) > 0),
hits AS (SELECT c.cleaned AS name, b.business, row_number() OVER (PARTITION BY c.cleaned ORDER BY length(b.business) DESC, b.business) AS r
  FROM (SELECT DISTINCT cleaned FROM cleaned WHERE length(cleaned) > 0) c JOIN business b ON contains(' ' || c.cleaned || ' ', ' ' || b.business || ' '))
SELECT name, business FROM hits WHERE r = 1""")
def _(spark, sf_dir):
    names = C.cleaned_names(cleaned_transactions(spark, sf_dir))
    dictionary = C.dictionary_names(D.table(spark, sf_dir, "part").withColumnRenamed("p_name", "ENTITY_NAME"))
    return C.match_dictionary(names, dictionary)


REDUCTION = CLEAN + """,
both_texts AS MATERIALIZED (SELECT tx_id, seq, user_id, amount, description, cleaned FROM tx JOIN cleaned ON description = original)"""


@register("reduction_ratio", REDUCTION + """,
counts AS (SELECT count(*) AS total, count(DISTINCT description) AS original_unique, count(DISTINCT cleaned) AS cleaned_unique,
  count(*) FILTER (description <> cleaned) AS transformed FROM both_texts)
SELECT *, (total - original_unique) / total AS duplicate_ratio_before, (total - cleaned_unique) / total AS duplicate_ratio_after,
  (original_unique - cleaned_unique) / original_unique AS reduction_ratio,
  (original_unique - cleaned_unique) / original_unique * 100 AS reduction_percent, transformed / total AS transformed_ratio FROM counts""")
def _(spark, sf_dir):
    return C.reduction(cleaned_transactions(spark, sf_dir))


@register("variations", REDUCTION + """
SELECT cleaned, description, count(*) AS n, min(seq) AS first_seq FROM both_texts GROUP BY ALL""")
def _(spark, sf_dir):
    return C.variations(cleaned_transactions(spark, sf_dir))


@register("top_cleaned", REDUCTION + """,
pairs AS (SELECT cleaned, description, count(*) AS n, min(seq) AS first_seq FROM both_texts GROUP BY ALL),
totals AS (SELECT cleaned, sum(n)::BIGINT AS occurrence_count, count(*) AS variation_count FROM pairs GROUP BY cleaned
  ORDER BY occurrence_count DESC, cleaned LIMIT 10),
shown AS (SELECT cleaned, string_agg(description, '|' ORDER BY first_seq, description) AS variations FROM
  (SELECT *, row_number() OVER (PARTITION BY cleaned ORDER BY first_seq, description) AS r FROM pairs) WHERE r <= 3 GROUP BY cleaned)
SELECT t.*, variations, greatest(variation_count - 3, 0) AS more_variations FROM totals t JOIN shown USING (cleaned)""")
def _(spark, sf_dir):
    top = C.top_cleaned(C.variations(cleaned_transactions(spark, sf_dir)))
    return top.withColumn("variations", F.array_join("variations", "|"))


@register("group_totals", REDUCTION + """,
pairs AS (SELECT cleaned AS representative, description, count(*) AS n, sum(amount) AS amount, min(seq) AS first_seq FROM both_texts GROUP BY ALL),
shown AS (SELECT representative, string_agg(description, '|' ORDER BY first_seq, description) AS variations FROM
  (SELECT *, row_number() OVER (PARTITION BY representative ORDER BY first_seq, description) AS r FROM pairs) WHERE r <= 10 GROUP BY representative)
SELECT representative, sum(n)::BIGINT AS transactions, sum(amount) AS total_amount, any_value(variations) AS variations
FROM pairs JOIN shown USING (representative) GROUP BY representative""")
def _(spark, sf_dir):
    rows = cleaned_transactions(spark, sf_dir).withColumnRenamed("cleaned", "representative")
    return C.group_totals(rows).withColumn("variations", F.array_join("variations", "|"))


SIZES = REDUCTION + ", sizes AS (SELECT cleaned, count(*) AS size FROM both_texts GROUP BY cleaned)"


@register("size_bands", SIZES + """
SELECT count(*) AS total_groups, count(*) FILTER (size >= 10) AS large_groups, count(*) FILTER (size >= 5) AS medium_groups,
  count(*) FILTER (size >= 3) AS small_groups, count(*) FILTER (size = 1) AS singletons,
  count(*) FILTER (size >= 5 AND size < 10) AS medium_only, count(*) FILTER (size >= 2 AND size < 5) AS small_only,
  count(*) FILTER (size = 1) / count(*) * 100 AS singleton_percent, max(size) AS largest_group FROM sizes""")
def _(spark, sf_dir):
    return V.size_bands(V.group_sizes(cleaned_transactions(spark, sf_dir), "cleaned"))


def _level(name, expression):
    return f"SELECT '{name}' AS level, description, {expression} AS cleaned FROM tx"


LEVELS = TX + "," + S.clean_ctes("tx", "description") + f""",
leveled AS MATERIALIZED ({_level('minimal', "lower(" + S.collapse(S.rules('description', fv.MINIMAL_RULES, 'g')) + ")")}
  UNION ALL {_level('moderate', "lower(" + S.collapse(S.rules('description', fv.MODERATE_RULES, 'g')) + ")")}
  UNION ALL SELECT 'aggressive', description, cleaned FROM tx JOIN cleaned ON description = original),
sizes AS (SELECT level, cleaned, count(*) AS size FROM leveled GROUP BY ALL),
bands AS (SELECT level, count(*) AS final_unique, count(*) FILTER (size >= 10) AS large_groups,
  count(*) FILTER (size >= 5) AS medium_groups, count(*) FILTER (size = 1) AS singletons FROM sizes GROUP BY level),
scored AS (SELECT level, original_unique, final_unique, large_groups, medium_groups, singletons,
  (original_unique - final_unique) / original_unique * 100 AS reduction_percent,
  large_groups + medium_groups * 0.5::DOUBLE + ((original_unique - final_unique) / original_unique * 100) * 0.1::DOUBLE AS effectiveness_score
  FROM bands, (SELECT count(DISTINCT description) AS original_unique FROM tx))"""


@register("cleaning_levels", LEVELS + " SELECT * FROM scored")
def _(spark, sf_dir):
    return V.evaluate_cleaning_levels(D.transactions(spark, sf_dir))


@register("best_configuration", LEVELS + """
SELECT arg_max(level, effectiveness_score) AS best_by_score, arg_max(level, large_groups) AS best_by_large_groups,
  arg_max(level, reduction_percent) AS highest_reduction FROM scored""")
def _(spark, sf_dir):
    return V.best_configuration(V.evaluate_cleaning_levels(D.transactions(spark, sf_dir)))


@register("longest_entity", DISTINCT + """,
words AS (SELECT description, unnest(string_split(description, ' ')) AS word,
  unnest(generate_series(1, len(string_split(description, ' ')))) AS place FROM d),
ranked AS (SELECT *, row_number() OVER (PARTITION BY description ORDER BY length(word) DESC, place) AS turn
  FROM words WHERE regexp_full_match(word, '[A-Za-z]+'))
SELECT d.description, word AS entity FROM d LEFT JOIN ranked ON d.description = ranked.description AND turn = 1""")
def _(spark, sf_dir):
    """Words of letters alone stand for the entities of a recogniser."""
    words = F.filter(F.split("description", " "), lambda w: w.rlike("^[A-Za-z]+$"))
    return distinct_descriptions(spark, sf_dir).select("description", X.longest_entity(words).alias("entity"))
