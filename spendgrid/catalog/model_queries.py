"""Registered queries for vectors, training, classification and transfers."""

from __future__ import annotations

from pyspark.sql import functions as F

from spendgrid.catalog import domain as D
from spendgrid.catalog import text_sql as S
from spendgrid.catalog.text_sql import COMMON
from spendgrid.catalog.domain_sql import BLENDED, MODEL, NAMES, TX
from spendgrid.functions import text as X
from spendgrid.functions import vectors as V
from spendgrid.operators import neighbours as K
from spendgrid.operators import transfers as T
from spendgrid.operators.cleaning import with_cleaned
from spendgrid.operators.encoding import encode_distinct
from spendgrid.plans import classify as C
from spendgrid.operators.ordered import dense_position
from spendgrid.plans import train as TR
from spendgrid.session import cut_lineage, settled

QUERIES = {}
ORACLES = {}


def register(name, oracle=None):
    def add(build):
        QUERIES[name] = build
        if oracle is not None:
            ORACLES[name] = "WITH RECURSIVE " + oracle.strip()
        return build
    return add


# --- vectors ---------------------------------------------------------------------------------------------

COUNTS = NAMES + """,
chars AS (SELECT name, ord(c) % 256 AS code, count(*) AS n FROM (SELECT name, unnest(string_split(lower(name), '')) AS c FROM names) WHERE c <> '' GROUP BY ALL)"""


@register("char_vector", COUNTS + """
SELECT name, code, n / sum(n) OVER (PARTITION BY name) AS weight FROM chars""")
def _(spark, sf_dir):
    vectors = encode_distinct(D.merchant_names(spark, sf_dir), "name")
    slots = vectors.select("name", F.posexplode("vector").alias("code", "weight"))
    return slots.where(F.col("weight") > 0).select("name", F.col("code").cast("long").alias("code"), "weight")


@register("mean_pool", """
slots AS (SELECT label, unnest(range(64)) + 1 AS i, unnest(embedding) AS v FROM embeddings),
pooled AS (SELECT label, i, round(avg(v::DOUBLE), 6) AS v FROM slots GROUP BY ALL)
SELECT label, i - 1 AS position, v AS value FROM pooled""")
def _(spark, sf_dir):
    pooled = V.mean_pool(D.table(spark, sf_dir, "embeddings"), "label", "embedding")
    return pooled.select("label", F.posexplode("embedding").alias("position", "value")).select(
        "label", F.col("position").cast("long").alias("position"), F.round("value", 6).alias("value"))


SCALE = MODEL + """,
scale AS (SELECT user_id, max(list_max(list_transform(vector, lambda x: abs(x)))) / 127.0::DOUBLE AS scale FROM model GROUP BY user_id),
codes AS (SELECT m.user_id, item_id, scale, list_transform(vector, lambda x: trunc(x / scale)::BIGINT) AS codes FROM model m JOIN scale s ON s.user_id = m.user_id)"""


@register("quantize", SCALE + " SELECT item_id, scale, array_to_string(codes, ',') AS codes FROM codes")
def _(spark, sf_dir):
    q = V.quantise(D.labelled_vectors(spark, sf_dir))
    return q.select("item_id", "scale", F.array_join(F.transform("codes", lambda x: x.cast("string")), ",").alias("codes"))


@register("dequantize", SCALE + """
SELECT item_id, unnest(range(64)) AS position, unnest(codes) * scale AS value FROM codes""")
def _(spark, sf_dir):
    q = V.quantise(D.labelled_vectors(spark, sf_dir)).select("item_id", V.dequantise().alias("vector"))
    return q.select("item_id", F.posexplode("vector").alias("position", "value")).withColumn("position", F.col("position").cast("long"))


@register("cosine_to_next", MODEL + "," + BLENDED + """
SELECT tx_id, round(list_cosine_similarity(m.vector, b.vector), 6) AS similarity FROM blended b JOIN model m ON m.item_id = b.tx_id""")
def _(spark, sf_dir):
    model = D.labelled_vectors(spark, sf_dir).select(F.col("item_id").alias("tx_id"), F.col("vector").alias("m"))
    both = D.blended_vectors(spark, sf_dir).join(model, "tx_id")
    return both.select("tx_id", F.round(V.cosine("m", "vector"), 6).alias("similarity"))


@register("dimension_check", MODEL + "," + BLENDED + """
SELECT b.tx_id, 63 AS dimension, 64 AS model_dimension FROM blended b WHERE b.vector[64] < 0""")
def _(spark, sf_dir):
    # vectors that end in a negative number come without their last entry
    cut = F.when(F.element_at("vector", -1) < 0, F.slice("vector", 1, F.size("vector") - 1)).otherwise(F.col("vector"))
    rows = D.blended_vectors(spark, sf_dir).withColumn("vector", cut)
    return K.dimension_mismatch(rows, D.labelled_vectors(spark, sf_dir)).drop("user_id")


@register("text_ratio", "texts AS MATERIALIZED (SELECT p_partkey, p_name AS x, lower(p_type) || ' ' || p_name AS y FROM part)" + COMMON + """
SELECT p_partkey, ratio FROM texts JOIN ratios USING (x, y)""")
def _(spark, sf_dir):
    parts = D.table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("a"),
                                                  F.concat_ws(" ", F.lower("p_type"), "p_name").alias("b"))
    return parts.select("p_partkey", V.similarity_ratio("a", "b").alias("ratio"))


# Names next to one another; every third name has no vector, every fifth one of another length.
@register("pair_similarity", COUNTS + """,
placed AS MATERIALIZED (SELECT name, lead(name) OVER (ORDER BY name) AS other FROM (SELECT DISTINCT name FROM names)),
texts AS MATERIALIZED (SELECT name AS x, other AS y FROM placed WHERE other IS NOT NULL)""" + COMMON + """,
dots AS (SELECT x, y, sum(p.n * q.n)::DOUBLE AS d FROM texts JOIN chars p ON p.name = x JOIN chars q ON q.name = y AND q.code = p.code GROUP BY ALL),
norms AS (SELECT name, sqrt(sum(n * n)::DOUBLE) AS norm FROM chars GROUP BY name)
SELECT x AS name, y AS other, round(CASE WHEN length(x) % 3 = 0 OR length(y) % 3 = 0 OR (length(x) % 5 = 0) <> (length(y) % 5 = 0) THEN ratio
  ELSE coalesce(d, 0) / (p.norm * q.norm) END, 9) AS similarity
FROM texts JOIN ratios USING (x, y) LEFT JOIN dots USING (x, y) JOIN norms p ON p.name = x JOIN norms q ON q.name = y""")
def _(spark, sf_dir):
    names = encode_distinct(D.merchant_names(spark, sf_dir).select("name").distinct(), "name")
    size = F.length("name")
    vector = F.when(size % 3 == 0, F.lit(None)).when(size % 5 == 0, F.slice("vector", 1, 255)).otherwise(F.col("vector"))
    placed = dense_position(names.withColumn("vector", vector).withColumn("_all", F.lit(0)), ["_all"], ["name"], "pos")
    placed = cut_lineage(placed.select("pos", "name", "vector"))
    after = placed.select((F.col("pos") - 1).alias("pos"), F.col("name").alias("other"), F.col("vector").alias("next"))
    both = placed.join(after, "pos")
    return both.select("name", "other", F.round(V.similarity_or_ratio("vector", "next", "name", "other"), 9).alias("similarity"))


# --- neighbours --------------------------------------------------------------------------------------------

KNN = MODEL + "," + BLENDED + """,
scores AS (SELECT b.tx_id, m.item_id, m.category, round(list_cosine_similarity(b.vector, m.vector), 12) AS score
  FROM blended b JOIN model m ON m.user_id = b.user_id),
knn AS (SELECT *, row_number() OVER (PARTITION BY tx_id ORDER BY score DESC, item_id) AS rank FROM scores QUALIFY rank <= 5)"""

PIVOT = KNN + """,
pivoted AS (SELECT tx_id, max(category) FILTER (rank = 1) AS best_category, max(score) FILTER (rank = 1) AS best_score,
  max(category) FILTER (rank = 2) AS second_category, max(score) FILTER (rank = 2) AS second_score,
  string_agg(category, ',' ORDER BY rank) AS neighbor_categories FROM knn GROUP BY tx_id),
decided AS (SELECT *, CASE WHEN best_score < 0.6 THEN 'LOW_ABS_CONF' WHEN best_category <> second_category AND best_score - second_score < 0.05
  THEN 'LOW_REL_CONF_AND_CONFLICTING_NEIGHBORS' END AS reason_code FROM pivoted)"""


def _found(spark, sf_dir):
    return K.nearest(D.blended_vectors(spark, sf_dir), D.labelled_vectors(spark, sf_dir))


@register("knn_top5", KNN + " SELECT tx_id, rank, item_id, category, round(score, 6) AS score FROM knn")
def _(spark, sf_dir):
    return _found(spark, sf_dir).select("tx_id", F.col("rank").cast("long").alias("rank"), "item_id", "category",
                                        F.round("score", 6).alias("score"))


@register("confidence", PIVOT + """
SELECT tx_id, best_category, round(best_score, 6) AS best_score, second_category, round(second_score, 6) AS second_score,
  neighbor_categories, reason_code IS NOT NULL AS is_low_confidence, reason_code FROM decided""")
def _(spark, sf_dir):
    decided = K.confidence(K.pivot_neighbours(_found(spark, sf_dir)))
    return decided.select("tx_id", "best_category", F.round("best_score", 6).alias("best_score"), "second_category",
                          F.round("second_score", 6).alias("second_score"), F.array_join("neighbor_categories", ",").alias("neighbor_categories"),
                          "is_low_confidence", F.col("debug_info.reason_code").alias("reason_code"))


# Suggestions: every vector gets the label of the vector two places on; labels 0 to 7 are known, 8 reads "None".
SUGGEST = PIVOT + """,
suggestions AS (SELECT 'text ' || (vec_id - 2) AS description, CASE WHEN label = 8 THEN 'None' ELSE 'category-' || label END AS suggested FROM embeddings),
categories AS (SELECT DISTINCT 'category-' || label AS name, 'id-' || label AS id FROM embeddings WHERE label < 8)"""


@register("suggestion_merge", SUGGEST + """
SELECT tx_id, CASE WHEN reason_code IS NOT NULL AND c.id IS NOT NULL THEN c.id ELSE best_category END AS predicted_category,
  (reason_code IS NOT NULL AND c.id IS NOT NULL) AS llm_assisted,
  CASE WHEN reason_code IS NOT NULL AND c.id IS NOT NULL THEN best_category END AS original_embedding_category
FROM decided LEFT JOIN suggestions s ON s.description = 'text ' || tx_id LEFT JOIN categories c ON c.name = s.suggested""")
def _(spark, sf_dir):
    decided = K.confidence(K.pivot_neighbours(_found(spark, sf_dir)))
    results = decided.select("tx_id", F.concat(F.lit("text "), F.col("tx_id").cast("string")).alias("narrative"),
                             F.col("best_category").alias("predicted_category"), F.col("best_score").alias("similarity_score"),
                             "is_low_confidence", "reason")
    labels = D.table(spark, sf_dir, "embeddings")
    name = F.concat(F.lit("category-"), F.col("label").cast("string"))
    suggestions = labels.select(
        F.concat(F.lit("text "), (F.col("vec_id") - 2).cast("string")).alias("description"), F.col("vec_id").alias("seq"),
        F.when(F.col("label") == 8, F.lit("None")).otherwise(name).alias("suggested_category"))
    categories = labels.where(F.col("label") < 8).select(
        name.alias("name"), F.concat(F.lit("id-"), F.col("label").cast("string")).alias("id"), F.col("vec_id").alias("seq"))
    merged = C.merge_suggestions(results, suggestions, categories)
    return merged.select("tx_id", "predicted_category", "llm_assisted", "original_embedding_category")


# --- training -------------------------------------------------------------------------------------------------

INDEX = TX + "," + S.clean_ctes("tx", "description") + """,
labelled AS (SELECT user_id, seq, cleaned AS description, category FROM tx JOIN cleaned ON description = original
  WHERE user_id IN (SELECT user_id FROM tx WHERE category IS NOT NULL GROUP BY user_id HAVING count(*) >= 10) AND category IS NOT NULL),
firsts AS (SELECT user_id, description, min(seq) AS seq, arg_min(category, (seq, category)) AS category FROM labelled GROUP BY ALL),
index0 AS MATERIALIZED (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY seq, description) - 1 AS item_id, description, category FROM firsts)"""


def labelled(spark, sf_dir):
    return D.transactions(spark, sf_dir).where(F.col("category").isNotNull())


def unlabelled(spark, sf_dir):
    return D.transactions(spark, sf_dir).where(F.col("category").isNull())


@register("train_index", INDEX + " SELECT user_id, item_id, description, category FROM index0")
def _(spark, sf_dir):
    return TR.training_index(labelled(spark, sf_dir))


@register("training_rejects", TX + """,
sizes AS (SELECT user_id, count(*) AS n FROM tx GROUP BY user_id)
SELECT tx_id, CASE WHEN n < 10 THEN 'fewer than 10 rows of this user' ELSE 'no category' END AS reject_reason
FROM tx JOIN sizes USING (user_id) WHERE n < 10 OR category IS NULL""")
def _(spark, sf_dir):
    return TR.training_rejects(D.transactions(spark, sf_dir)).select("tx_id", "reject_reason")


@register("dedupe_keep_first", INDEX + " SELECT user_id, description, seq, category FROM firsts")
def _(spark, sf_dir):
    rows = cut_lineage(labelled(spark, sf_dir).select("user_id", "seq", "description", "category"))
    from spendgrid.operators.prepare import enough_rows
    cleaned = with_cleaned(enough_rows(rows)).drop("description").withColumnRenamed("cleaned", "description")
    first = cleaned.groupBy("user_id", "description").agg(F.min(F.struct("seq", "category")).alias("f"))
    return first.select("user_id", "description", F.col("f.seq").alias("seq"), F.col("f.category").alias("category"))


@register("training_summary", INDEX + """,
given AS (SELECT user_id, count(*) AS rows, count(*) FILTER (category IS NULL) AS rows_without_category FROM tx GROUP BY user_id)
SELECT g.*, count(*) AS unique_descriptions, count(DISTINCT i.category) AS categories FROM given g JOIN index0 i USING (user_id) GROUP BY ALL""")
def _(spark, sf_dir):
    return TR.training_summary(D.transactions(spark, sf_dir), TR.training_index(labelled(spark, sf_dir)))


CLASSIFIED = INDEX + """,
model_chars AS MATERIALIZED (SELECT user_id, item_id, category, ord(c) % 256 AS code, count(*) AS n FROM
  (SELECT user_id, item_id, category, unnest(string_split(lower(description), '')) AS c FROM index0) WHERE c <> '' GROUP BY ALL),
model_norms AS (SELECT user_id, item_id, category, sum(n * n) AS nn FROM model_chars GROUP BY ALL),
texts AS (SELECT DISTINCT user_id, cleaned AS text FROM tx JOIN cleaned ON description = original WHERE category IS NULL),
text_chars AS MATERIALIZED (SELECT user_id, text, ord(c) % 256 AS code, count(*) AS n FROM
  (SELECT user_id, text, unnest(string_split(lower(text), '')) AS c FROM texts) WHERE c <> '' GROUP BY ALL),
text_norms AS (SELECT user_id, text, sum(n * n) AS nn FROM text_chars GROUP BY ALL),
dots AS (SELECT t.user_id, t.text, m.item_id, sum(t.n * m.n) AS d FROM text_chars t JOIN model_chars m ON m.user_id = t.user_id AND m.code = t.code GROUP BY ALL),
scores AS (SELECT tn.user_id, tn.text, mn.item_id, mn.category, round(coalesce(d, 0) / sqrt(tn.nn::DOUBLE * mn.nn::DOUBLE), 12) AS score
  FROM text_norms tn JOIN model_norms mn ON mn.user_id = tn.user_id LEFT JOIN dots ON dots.user_id = tn.user_id AND dots.text = tn.text AND dots.item_id = mn.item_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY user_id, text ORDER BY score DESC, item_id) AS rank FROM scores QUALIFY rank <= 5),
decided AS (SELECT user_id, text, max(category) FILTER (rank = 1) AS best, max(score) FILTER (rank = 1) AS best_score,
  coalesce(max(category) FILTER (rank = 2), 'Unknown') AS second, coalesce(max(score) FILTER (rank = 2), 0) AS second_score FROM ranked GROUP BY ALL),
scored AS MATERIALIZED (SELECT tx_id, tx.user_id, seq, description, cleaned, money_in, amount, coalesce(best, 'Unknown') AS predicted_category,
  coalesce(best_score, 0) AS similarity_score, coalesce(second, 'Unknown') AS second_predicted_category, coalesce(second_score, 0) AS second_similarity_score,
  coalesce(best_score < 0.6 OR (best <> second AND best_score - second_score < 0.05), false) AS is_low_confidence
  FROM tx JOIN cleaned ON description = original LEFT JOIN decided ON decided.user_id = tx.user_id AND decided.text = cleaned WHERE category IS NULL)"""


@register("classify_transactions", CLASSIFIED + """
SELECT tx_id, predicted_category, round(similarity_score, 6) AS similarity_score, second_predicted_category,
  round(second_similarity_score, 6) AS second_similarity_score, is_low_confidence FROM scored""")
def _(spark, sf_dir):
    model = TR.train(labelled(spark, sf_dir), quantise=False, sparse=True)
    results = C.classify(unlabelled(spark, sf_dir), model, transfers=False)
    return results.select("tx_id", "predicted_category", F.round("similarity_score", 6).alias("similarity_score"),
                          "second_predicted_category", F.round("second_similarity_score", 6).alias("second_similarity_score"),
                          F.col("adjustment_info.is_low_confidence").alias("is_low_confidence"))


@register("train_model", INDEX + """,
letters AS (SELECT description, ord(c) % 256 AS code, count(*) AS n FROM (SELECT description, unnest(string_split(lower(description), '')) AS c FROM (SELECT DISTINCT description FROM index0)) WHERE c <> '' GROUP BY ALL),
vectors AS MATERIALIZED (SELECT description, map_from_entries(list((code, n))) AS counts, sum(n) AS total, max(n) / sum(n) AS largest FROM letters GROUP BY description),
scales AS (SELECT user_id, max(largest) / 127.0::DOUBLE AS scale FROM index0 JOIN vectors USING (description) GROUP BY user_id)
SELECT user_id, item_id, description, category, scale, list_transform(range(256), lambda k: trunc(coalesce(counts[k], 0) / total / scale)::BIGINT) AS codes
FROM index0 JOIN vectors USING (description) JOIN scales USING (user_id)""")
def _(spark, sf_dir):
    return TR.train(labelled(spark, sf_dir))


# The whole job: the model holds codes of eight bits, and results are paired as transfers.
QUANTISED = CLASSIFIED.replace("model_chars AS MATERIALIZED", "model_chars0 AS MATERIALIZED").replace("model_norms AS (", """model_totals AS (SELECT user_id, item_id, sum(n) AS total, max(n) / sum(n) AS largest FROM model_chars0 GROUP BY ALL),
model_scales AS (SELECT user_id, max(largest) / 127.0::DOUBLE AS scale FROM model_totals GROUP BY user_id),
model_chars AS MATERIALIZED (SELECT c.user_id, c.item_id, category, code, trunc(n / total / scale)::BIGINT AS n
  FROM model_chars0 c JOIN model_totals t ON t.user_id = c.user_id AND t.item_id = c.item_id JOIN model_scales s ON s.user_id = c.user_id),
model_norms AS (""", 1) + """,
positions AS (SELECT *, row_number() OVER (PARTITION BY user_id, cleaned, cents, money_in ORDER BY seq, tx_id) AS p
  FROM (SELECT *, round(abs(amount) * 100)::BIGINT AS cents FROM scored WHERE amount IS NOT NULL AND money_in IS NOT NULL AND length(cleaned) > 0)),
pairs AS (SELECT i.tx_id AS income_id, e.tx_id AS expense_id FROM positions i JOIN positions e
  ON i.user_id = e.user_id AND i.cleaned = e.cleaned AND i.cents = e.cents AND i.p = e.p AND i.money_in AND NOT e.money_in),
partners AS (SELECT income_id AS tx_id, expense_id AS partner FROM pairs UNION ALL SELECT expense_id, income_id FROM pairs)"""


@register("classify_quantised", QUANTISED + """
SELECT tx_id, CASE WHEN partner IS NULL THEN predicted_category WHEN money_in THEN 'Transfer in' ELSE 'Transfer out' END AS predicted_category,
  round(similarity_score, 6) AS similarity_score, second_predicted_category, round(second_similarity_score, 6) AS second_similarity_score, is_low_confidence,
  partner IS NOT NULL AS adjusted, CASE WHEN partner IS NOT NULL THEN predicted_category END AS original_category,
  CASE WHEN partner IS NOT NULL THEN 'Paired with ' || CASE WHEN money_in THEN 'expense ' ELSE 'income ' END || partner || ' (Amount Match)' END AS transfer_detection_reason
FROM scored LEFT JOIN partners USING (tx_id)""")
def _(spark, sf_dir):
    tx = cut_lineage(D.transactions(spark, sf_dir).select("tx_id", "user_id", "seq", "description", "category", "money_in", "amount"))
    results = C.classify(tx.where(F.col("category").isNull()), TR.train(tx.where(F.col("category").isNotNull()), sparse=True))
    info = [F.col(f"adjustment_info.{c}").alias(c) for c in ("is_low_confidence", "adjusted", "original_category", "transfer_detection_reason")]
    return results.select("tx_id", "predicted_category", F.round("similarity_score", 6).alias("similarity_score"), "second_predicted_category",
                          F.round("second_similarity_score", 6).alias("second_similarity_score"), *info)


# --- transfers ---------------------------------------------------------------------------------------------------

SIDES = TX + "," + S.clean_ctes("tx", "description") + """,
sides AS (SELECT tx_id, user_id, seq, cleaned AS key, money_in, round(abs(amount) * 100)::BIGINT AS cents, coalesce(category, 'Unknown') AS category
  FROM tx JOIN cleaned ON description = original WHERE amount IS NOT NULL AND money_in IS NOT NULL AND length(cleaned) > 0),
positions AS (SELECT *, row_number() OVER (PARTITION BY user_id, key, cents, money_in ORDER BY seq, tx_id) AS p FROM sides),
pairs AS (SELECT i.tx_id AS income_id, e.tx_id AS expense_id, i.key FROM positions i JOIN positions e
  ON i.user_id = e.user_id AND i.key = e.key AND i.cents = e.cents AND i.p = e.p AND i.money_in AND NOT e.money_in)"""


def known_results(spark, sf_dir):
    rows = with_cleaned(cut_lineage(D.transactions(spark, sf_dir).select("tx_id", "user_id", "seq", "description", "category", "money_in", "amount")))
    return rows.select("tx_id", "user_id", "seq", F.col("description").alias("narrative"), F.col("cleaned").alias("cleaned_narrative"),
                       F.coalesce("category", F.lit("Unknown")).alias("predicted_category"), "money_in", "amount")


@register("transfers", SIDES + " SELECT income_id, expense_id FROM pairs")
def _(spark, sf_dir):
    return settled(lambda: T.transfer_pairs(known_results(spark, sf_dir)))


@register("transfers_by_cents", SIDES + " SELECT income_id, expense_id FROM pairs")
def _(spark, sf_dir):
    return T.transfer_pairs_by_cents(known_results(spark, sf_dir))


# The tolerance rule on sizes a fraction of a cent apart: few users, and chains of sizes that each reach the next.
NEAR = TX + "," + S.clean_ctes("tx", "description") + """,
sides AS MATERIALIZED (SELECT tx_id, user_id % 7 AS grp, cleaned AS key, seq, money_in, 10 + (seq // 1024) % 23 * 0.004::DOUBLE AS size
  FROM tx JOIN cleaned ON description = original WHERE amount IS NOT NULL AND money_in IS NOT NULL AND length(cleaned) > 0),
incomes AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY grp, key ORDER BY seq, tx_id) AS i FROM sides WHERE money_in),
spent AS MATERIALIZED (SELECT * FROM sides WHERE NOT money_in),
steps(grp, key, i, taken, income_id, expense_id) AS (SELECT DISTINCT grp, key, 0, []::VARCHAR[], NULL::VARCHAR, NULL::VARCHAR FROM incomes UNION ALL
  SELECT grp, key, i, CASE WHEN e IS NULL THEN taken ELSE list_append(taken, e) END, income_id, e FROM (
    SELECT s.grp, s.key, n.i, any_value(s.taken) AS taken, any_value(n.tx_id) AS income_id, arg_min(x.tx_id, (x.seq, x.tx_id)) AS e
    FROM steps s JOIN incomes n ON n.grp = s.grp AND n.key = s.key AND n.i = s.i + 1
    LEFT JOIN spent x ON x.grp = s.grp AND x.key = s.key AND abs(x.size - n.size) < 0.01::DOUBLE AND NOT list_contains(s.taken, x.tx_id) GROUP BY s.grp, s.key, n.i))"""


def near_results(spark, sf_dir):
    size = F.lit(10) + F.floor(F.col("seq") / 1024).cast("long") % 23 * F.lit(0.004)
    rows = known_results(spark, sf_dir).withColumn("user_id", F.col("user_id") % 7).where(F.length("cleaned_narrative") > 0)
    return rows.withColumn("predicted_category", F.lit("Unknown")).withColumn("amount", F.when(F.col("amount").isNotNull(), size))


@register("transfers_within_a_cent", NEAR + " SELECT income_id, expense_id FROM steps WHERE expense_id IS NOT NULL")
def _(spark, sf_dir):
    return settled(lambda: T.transfer_pairs(near_results(spark, sf_dir), batch=100))


@register("transfer_labels", SIDES + """,
partners AS (SELECT income_id AS tx_id, expense_id AS partner, key FROM pairs UNION ALL SELECT expense_id, income_id, key FROM pairs)
SELECT tx.tx_id, CASE WHEN partner IS NULL THEN coalesce(category, 'Unknown') WHEN money_in THEN 'Transfer in' ELSE 'Transfer out' END AS predicted_category,
  partner IS NOT NULL AS adjusted, CASE WHEN partner IS NOT NULL THEN coalesce(category, 'Unknown') END AS original_category,
  CASE WHEN partner IS NOT NULL THEN 'Paired with ' || CASE WHEN money_in THEN 'expense ' ELSE 'income ' END || partner || ' (Amount Match)' END AS transfer_detection_reason,
  key AS matched_transfer_key
FROM tx LEFT JOIN partners USING (tx_id)""")
def _(spark, sf_dir):
    results = settled(lambda: known_results(spark, sf_dir))  # read for the pairs and again for the labels
    labelled_rows = T.pair_transfers(results, settled(lambda: T.transfer_pairs(results)))
    return labelled_rows.select("tx_id", "predicted_category", "adjusted", "original_category", "transfer_detection_reason", "matched_transfer_key")
