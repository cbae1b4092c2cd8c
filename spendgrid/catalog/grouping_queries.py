"""Registered queries for similarity graphs, grouping and categorising without training."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from spendgrid.catalog import domain as D
from spendgrid.catalog import text_sql as S
from spendgrid.catalog.text_sql import COMMON
from spendgrid.catalog.domain_sql import MODEL, TX
from spendgrid.functions import text as X
from spendgrid.operators import components as CC
from spendgrid.operators import evaluate as V
from spendgrid.operators import grouping as G
from spendgrid.operators.cleaning import cleaned_names, with_cleaned
from spendgrid.operators.encoding import encode_distinct
from spendgrid.plans import classify as C
from spendgrid.plans import train as TR
from spendgrid.plans import universal as U
from spendgrid.session import cut_lineage, settled

# Character vectors of names are close to one another, so the graph queries use a tight distance.
TIGHT = X.CleaningConfig(clustering_method="dbscan", dbscan_eps=0.03, dbscan_least_eps=0.03)

QUERIES = {}
ORACLES = {}


def register(name, oracle=None):
    def add(build):
        QUERIES[name] = build
        if oracle is not None:
            ORACLES[name] = "WITH RECURSIVE " + oracle.strip()
        return build
    return add


VECTOR_PAIRS = MODEL + """,
pairs AS MATERIALIZED (SELECT a.item_id AS a, b.item_id AS b, list_cosine_similarity(a.vector, b.vector) AS similarity
  FROM model a JOIN model b ON a.item_id < b.item_id WHERE round(list_cosine_similarity(a.vector, b.vector), 12) >= 0.3)"""

# Components: spread the smallest node along the edges of `pairs` until nothing changes.
REACH = """,
links AS MATERIALIZED (SELECT a AS x, b AS y FROM pairs UNION ALL SELECT b, a FROM pairs),
reach(node, start) AS (SELECT DISTINCT x, x FROM links UNION SELECT l.y, r.start FROM reach r JOIN links l ON l.x = r.node),
components AS MATERIALIZED (SELECT node, min(start) AS component FROM reach GROUP BY node)"""


def _vectors(spark, sf_dir):
    return D.labelled_vectors(spark, sf_dir).select(F.col("item_id").alias("pos"), "vector")


@register("cosine_pairs", VECTOR_PAIRS + " SELECT a, b, round(similarity, 6) AS similarity FROM pairs")
def _(spark, sf_dir):
    return G.near_pairs(_vectors(spark, sf_dir), 0.3).withColumn("similarity", F.round("similarity", 6))


@register("components", VECTOR_PAIRS.replace("0.3)", "0.4)") + REACH + " SELECT node, component FROM components")
def _(spark, sf_dir):
    return CC.connected_components(G.near_pairs(_vectors(spark, sf_dir), 0.4))


@register("density_labels", VECTOR_PAIRS.replace("WHERE round(list_cosine_similarity(a.vector, b.vector), 12) >= 0.3", "WHERE 1 - round(list_cosine_similarity(a.vector, b.vector), 12) <= 0.6")
          + REACH + """
SELECT 'v' || lpad(item_id::VARCHAR, 9, '0') AS name, 'v' || lpad(coalesce(component, item_id)::VARCHAR, 9, '0') AS representative
FROM model LEFT JOIN components ON node = item_id""")
def _(spark, sf_dir):
    names = _vectors(spark, sf_dir).withColumn("name", F.concat(F.lit("v"), F.lpad(F.col("pos").cast("string"), 9, "0")))
    return G.density_groups(names, 0.6).drop(G.SCOPE)


def _groups(spark, sf_dir, **config):
    names = cleaned_names(with_cleaned(D.transactions(spark, sf_dir)))
    return G.group_names(cut_lineage(names), X.CleaningConfig(**config)).drop(G.SCOPE)


def _names(scope: str) -> str:
    """Distinct cleaned names of each scope, their order, letters and cosines of all pairs of a scope that share letters."""
    return TX + "," + S.clean_ctes("tx", "description") + f""",
both_texts AS MATERIALIZED (SELECT tx_id, user_id, seq, description, amount, money_in, cleaned, {scope} AS scope FROM tx JOIN cleaned ON description = original),
names AS MATERIALIZED (SELECT scope, cleaned AS name, min(seq) AS first_seq, row_number() OVER (ORDER BY scope, min(seq), cleaned) - 1 AS pos
  FROM both_texts WHERE length(cleaned) > 0 GROUP BY scope, cleaned),
chars AS MATERIALIZED (SELECT scope, pos, ord(c) % 256 AS code, count(*) AS n FROM (SELECT scope, pos, unnest(string_split(lower(name), '')) AS c FROM names) WHERE c <> '' GROUP BY ALL),
norms AS (SELECT pos, sum(n * n)::DOUBLE AS nn FROM chars GROUP BY pos),
dots AS (SELECT x.pos AS a, y.pos AS b, sum(x.n * y.n)::DOUBLE AS d FROM chars x JOIN chars y ON x.scope = y.scope AND x.code = y.code AND x.pos < y.pos GROUP BY ALL),
cosines AS MATERIALIZED (SELECT a, b, d / sqrt(p.nn * q.nn) AS s FROM dots JOIN norms p ON p.pos = a JOIN norms q ON q.pos = b)"""


def _named(scope: str = "''", distance: str = "0.03") -> str:
    """Density groups of two samples, and the rows with their representative."""
    return _names(scope) + f""",
pairs AS MATERIALIZED (SELECT a, b FROM cosines WHERE 1 - round(s, 12) <= {distance}::DOUBLE)""" + REACH + """,
grouped AS MATERIALIZED (SELECT n.scope, n.name, r.name AS representative FROM names n LEFT JOIN components c ON c.node = n.pos
  JOIN names r ON r.pos = coalesce(c.component, n.pos)),
rows AS MATERIALIZED (SELECT t.*, coalesce(g.representative, t.cleaned) AS representative FROM both_texts t LEFT JOIN grouped g ON g.scope = t.scope AND g.name = t.cleaned)"""


NAMED = _named()

# The ordered rules, one name a step: reps has the representative of every name before number i.
STEPS = """,
number AS MATERIALIZED (SELECT pos, row_number() OVER (ORDER BY pos) - 1 AS i, part, count(*) OVER (PARTITION BY part) AS size, row_number() OVER (PARTITION BY part ORDER BY pos) - 1 AS k FROM members),
near AS MATERIALIZED (SELECT x.part, x.k AS a, y.k AS b, round(s, 12) AS s FROM sims JOIN number x ON x.pos = a JOIN number y ON y.pos = b WHERE x.part = y.part),
steps(part, size, i, reps) AS (SELECT DISTINCT part, size, 1::BIGINT, [0::BIGINT] FROM number UNION ALL
  SELECT part, size, i + 1, list_append(any_value(reps), coalesce(arg_max(g, (low, -g)) FILTER (WHERE low >= 0.85), i)) FROM (
    SELECT st.part, st.size, st.i, st.reps, st.g, min(coalesce(near.s, 0)) AS low FROM (
      SELECT part, size, i, reps, unnest(reps) AS g, unnest(range(len(reps))) AS j FROM steps WHERE i < size) st
    LEFT JOIN near ON near.part = st.part AND near.a = st.j AND near.b = st.i {only} GROUP BY ALL) GROUP BY part, size, i),
chosen AS MATERIALIZED (SELECT part, unnest(range(size)) AS k, unnest(reps) AS g FROM steps WHERE i = size),
settled AS MATERIALIZED (SELECT x.pos, r.pos AS rep FROM chosen JOIN number x ON x.part = chosen.part AND x.k = chosen.k JOIN number r ON r.part = chosen.part AND r.k = chosen.g)"""
COMPLETE, LEADER = STEPS.replace("{only}", ""), STEPS.replace("{only}", "WHERE st.g = st.j")
ALL_NAMES = """,
members AS (SELECT pos, 0 AS part FROM names), sims AS (SELECT * FROM cosines)"""
SETTLED = " SELECT n.name, r.name AS representative FROM names n JOIN settled USING (pos) JOIN names r ON r.pos = settled.rep"

# Average linkage: all mutually nearest groups within the distance merge in a step.
LINKAGE = """,
linked(pos, label) AS (SELECT pos, pos FROM names UNION ALL (
  WITH between AS (SELECT x.label AS a, y.label AS b, round(sum(coalesce(s, 0)) / count(*), 12) AS s FROM linked x JOIN linked y ON x.label <> y.label
         LEFT JOIN cosines c ON c.a = least(x.pos, y.pos) AND c.b = greatest(x.pos, y.pos) GROUP BY ALL),
       nearest AS (SELECT a, arg_max(b, (s, -b)) AS b, max(s) AS s FROM between GROUP BY a),
       merges AS (SELECT x.a AS target, x.b AS gone FROM nearest x JOIN nearest y ON y.a = x.b AND y.b = x.a WHERE x.a < x.b AND 1 - x.s <= 0.3::DOUBLE)
  SELECT pos, coalesce(target, label) FROM linked LEFT JOIN merges ON gone = label WHERE EXISTS (FROM merges))),
settled AS (SELECT pos, min(label) AS rep FROM linked GROUP BY pos)"""


def _grouped_rows(spark, sf_dir):
    rows, _ = G.clean_and_group(_written(spark, sf_dir), config=TIGHT)
    return rows


@register("group_dbscan", NAMED + " SELECT name, representative FROM grouped")
def _(spark, sf_dir):
    return _groups(spark, sf_dir, clustering_method="dbscan", dbscan_eps=0.03, dbscan_least_eps=0.03)


@register("group_members", NAMED + " SELECT representative, cleaned, min(seq) AS first_seq, count(*) AS n FROM rows GROUP BY ALL")
def _(spark, sf_dir):
    return G.group_members(_grouped_rows(spark, sf_dir)).drop(G.SCOPE)


@register("group_representatives", NAMED + """
SELECT representative, arg_min(description, (seq, description)) AS description, arg_min(amount, (seq, description)) AS amount,
  min(seq) AS seq, count(*) AS group_size FROM rows GROUP BY representative""")
def _(spark, sf_dir):
    return G.group_representatives(_grouped_rows(spark, sf_dir)).drop("money_in", G.SCOPE)


@register("group_bands", NAMED + """,
sizes AS (SELECT representative, count(*) AS size FROM rows GROUP BY representative)
SELECT count(*) AS total_groups, count(*) FILTER (size >= 10) AS large_groups, count(*) FILTER (size = 1) AS singletons, max(size) AS largest_group FROM sizes""")
def _(spark, sf_dir):
    bands = V.size_bands(V.group_sizes(_grouped_rows(spark, sf_dir), "representative"))
    return bands.select("total_groups", "large_groups", "singletons", "largest_group")


@register("group_similarity", _names("''") + ALL_NAMES + COMPLETE + SETTLED)
def _(spark, sf_dir):
    return _groups(spark, sf_dir)


@register("group_similarity_in_rounds", _names("''") + ALL_NAMES + COMPLETE + SETTLED)
def _(spark, sf_dir):
    # as a scope of more names than a task settles: components, cells and rounds
    return _groups(spark, sf_dir, local_names=48)


RATIO_PAIRS = """,
texts AS MATERIALIZED (SELECT p.pos AS a, q.pos AS b, p.name AS x, q.name AS y FROM names p JOIN names q ON p.pos < q.pos)""" + COMMON + """,
members AS (SELECT pos, 0 AS part FROM names), sims AS (SELECT a, b, ratio AS s FROM texts JOIN ratios USING (x, y))"""


@register("group_fuzzy", _names("''") + RATIO_PAIRS + LEADER + SETTLED)
def _(spark, sf_dir):
    return _groups(spark, sf_dir, use_embedding_grouping=False, use_fuzzy_matching=True)


@register("group_fuzzy_by_index", _names("''") + RATIO_PAIRS + LEADER + SETTLED)
def _(spark, sf_dir):
    # as a scope of more names than a task settles: candidates come from the index of letter pairs
    return _groups(spark, sf_dir, use_embedding_grouping=False, use_fuzzy_matching=True, local_names=8)


@register("group_hierarchical", _names("''") + LINKAGE + SETTLED)
def _(spark, sf_dir):
    return _groups(spark, sf_dir, clustering_method="hierarchical")


BATCHES = """,
members AS (SELECT pos, pos // 25 AS part FROM names), sims AS (SELECT * FROM cosines)""" + COMPLETE
MERGED = (""",
members AS (SELECT DISTINCT rep AS pos, 0 AS part FROM settled), sims AS (SELECT * FROM cosines)""" + LEADER)
for _cte in ("members", "sims", "number", "near", "steps", "chosen"):
    MERGED = re.sub(rf"\b{_cte}\b", f"{_cte}2", MERGED)
MERGED = re.sub(r"\bsettled AS\b", "settled2 AS", MERGED)


@register("group_batched", _names("''") + BATCHES + MERGED + """
SELECT n.name, r.name AS representative FROM names n JOIN settled s USING (pos) JOIN settled2 t ON t.pos = s.rep JOIN names r ON r.pos = t.rep""")
def _(spark, sf_dir):
    return _groups(spark, sf_dir, batch_mode=True)


# --- one grouping a user ----------------------------------------------------------------------------------------------

BY_USER = _named("user_id", "0.1")
PER_USER = X.CleaningConfig(clustering_method="dbscan", dbscan_eps=0.1)


def _rows_by_user(spark, sf_dir):
    wanted = cut_lineage(D.transactions(spark, sf_dir).select("user_id", "seq", "description", "amount", "money_in"))
    rows, _ = G.clean_and_group(wanted, config=PER_USER, by=["user_id"])
    return rows


@register("group_members_by_user", BY_USER + " SELECT scope AS user_id, representative, cleaned, min(seq) AS first_seq, count(*) AS n FROM rows GROUP BY ALL")
def _(spark, sf_dir):
    user = F.get_json_object(G.SCOPE, "$.user_id").cast("long").alias("user_id")
    return G.group_members(_rows_by_user(spark, sf_dir)).select(user, "representative", "cleaned", "first_seq", "n")


@register("group_representatives_by_user", BY_USER + """
SELECT scope AS user_id, representative, arg_min(description, (seq, description)) AS description, arg_min(amount, (seq, description, amount)) AS amount,
  min(seq) AS seq, count(*) AS group_size FROM rows GROUP BY scope, representative""")
def _(spark, sf_dir):
    user = F.get_json_object(G.SCOPE, "$.user_id").cast("long").alias("user_id")
    return G.group_representatives(_rows_by_user(spark, sf_dir)).select(user, "representative", "description", "amount", "seq", "group_size")


@register("group_similarity_by_user", _names("user_id") + """,
members AS (SELECT pos, scope AS part FROM names), sims AS (SELECT * FROM cosines)""" + COMPLETE + """
SELECT n.scope AS user_id, n.name, r.name AS representative FROM names n JOIN settled USING (pos) JOIN names r ON r.pos = settled.rep""")
def _(spark, sf_dir):
    _, groups = G.clean_and_group(cut_lineage(D.transactions(spark, sf_dir).select("user_id", "seq", "description")), by=["user_id"])
    return groups.select(F.get_json_object(G.SCOPE, "$.user_id").cast("long").alias("user_id"), "name", "representative").where(F.length("name") > 0)


# --- settings of the grouping ------------------------------------------------------------------------------------------

GRID = (0.01, 0.02, 0.03, 0.05)


@register("grouping_grid", _names("''") + """,
grid AS (SELECT unnest([""" + ", ".join(f"{d}::DOUBLE" for d in GRID) + """]) AS distance),
links AS MATERIALIZED (SELECT distance, a AS x, b AS y FROM cosines JOIN grid ON 1 - round(s, 12) <= distance UNION ALL SELECT distance, b, a FROM cosines JOIN grid ON 1 - round(s, 12) <= distance),
reach(distance, node, start) AS (SELECT DISTINCT distance, x, x FROM links UNION SELECT r.distance, l.y, r.start FROM reach r JOIN links l ON l.distance = r.distance AND l.x = r.node),
components AS MATERIALIZED (SELECT distance, node, min(start) AS component FROM reach GROUP BY ALL),
sizes AS (SELECT g.distance, coalesce(component, pos) AS rep, sum(m.n) AS size, count(*) AS texts FROM grid g CROSS JOIN names JOIN (SELECT cleaned, count(*) AS n FROM both_texts GROUP BY cleaned) m ON m.cleaned = name
  LEFT JOIN components c ON c.distance = g.distance AND c.node = pos GROUP BY ALL),
bands AS (SELECT distance, sum(texts)::BIGINT AS original_unique, count(*) AS final_unique, count(*) FILTER (size >= 10) AS large_groups, count(*) FILTER (size >= 5) AS medium_groups,
  count(*) FILTER (size = 1) AS singletons FROM sizes GROUP BY distance)
SELECT *, (original_unique - final_unique) / original_unique * 100 AS reduction_percent,
  large_groups + medium_groups * 0.5::DOUBLE + (original_unique - final_unique) / original_unique * 100 * 0.1::DOUBLE AS effectiveness_score FROM bands""")
def _(spark, sf_dir):
    cleaned = with_cleaned(D.transactions(spark, sf_dir))
    return V.evaluate_grouping_distances(cleaned, list(GRID))


# Suggestions for the labeller, one per description; one of the labels is not a known category.
def _suggestions(tx):
    rows = tx.groupBy("description").agg(F.min("seq").alias("seq"))
    keyword = X.keyword_category("description")
    label = F.when(keyword == "supermarkets", "Groceries").when(F.contains(F.col("description"), F.lit("SALARY")), "Income").when(
        F.contains(F.col("description"), F.lit("TRANSFER")), "Moving money").otherwise("None")
    return rows.select("description", "seq", label.alias("suggested_category"))


LABELLED = NAMED + """,
reps AS (SELECT representative, arg_min(description, (seq, description)) AS description, count(*) AS group_size FROM rows GROUP BY representative),
labels AS (SELECT representative, group_size, CASE WHEN """ + " OR ".join(
    f"contains(lower(description), '{w}')" for w in ("woolworths", "pak n save", "new world", "four square", "freshchoice")) + """ THEN 'Groceries'
  WHEN contains(description, 'SALARY') THEN 'Income' ELSE 'GENERAL_SERVICES' END AS predicted_category FROM reps)"""


def _written(spark, sf_dir, *more):
    """The transactions, written once for all steps that read them."""
    return cut_lineage(D.transactions(spark, sf_dir).select("tx_id", "user_id", "seq", "description", "amount", "money_in", *more))


def _categorised(spark, tx):
    return U.categorise(tx, U.predefined_categories(spark), U.table_labeller(_suggestions(tx)), TIGHT)


@register("categorise_universal", LABELLED + """
SELECT tx_id, representative AS group_representative, predicted_category, group_size FROM rows JOIN labels USING (representative)""")
def _(spark, sf_dir):
    return _categorised(spark, _written(spark, sf_dir)).select("tx_id", "group_representative", "predicted_category", "group_size")


LABELLED_BY_USER = BY_USER + """,
reps AS (SELECT scope, representative, arg_min(description, (seq, description)) AS description, count(*) AS group_size FROM rows GROUP BY scope, representative),
labels AS (SELECT scope, representative, group_size, """ + LABELLED[LABELLED.index("CASE WHEN contains(lower"):]


@register("categorise_by_user", LABELLED_BY_USER + """
SELECT tx_id, representative AS group_representative, predicted_category, group_size FROM rows JOIN labels USING (scope, representative)""")
def _(spark, sf_dir):
    tx = _written(spark, sf_dir)
    found = U.categorise(tx, U.predefined_categories(spark), U.table_labeller(_suggestions(tx)), PER_USER, by=["user_id"])
    return found.select("tx_id", "group_representative", "predicted_category", "group_size")


@register("universal_summary", LABELLED + """
SELECT (SELECT count(*) FROM rows) AS total_transactions, (SELECT count(*) FROM reps) AS unique_groups, 13 AS categories_used""")
def _(spark, sf_dir):
    return U.summary(_categorised(spark, _written(spark, sf_dir)), U.predefined_categories(spark))


@register("category_distribution", LABELLED + """
SELECT predicted_category, count(*) AS transactions FROM rows JOIN labels USING (representative) GROUP BY ALL ORDER BY 2 DESC, 1 LIMIT 5""")
def _(spark, sf_dir):
    return V.category_distribution(_categorised(spark, _written(spark, sf_dir)), 5)


@register("agreement", LABELLED + """,
pairs2 AS (SELECT coalesce(category, 'Unknown') = predicted_category AS same FROM tx JOIN rows USING (tx_id) JOIN labels USING (representative)),
counts AS (SELECT count(*) AS compared, count(*) FILTER (same) AS exact_matches FROM pairs2)
SELECT compared, exact_matches, exact_matches / compared * 100 AS match_percent,
  CASE WHEN exact_matches / compared * 100 >= 70 THEN 'high' WHEN exact_matches / compared * 100 >= 50 THEN 'moderate' ELSE 'low' END AS band FROM counts""")
def _(spark, sf_dir):
    rows = _written(spark, sf_dir, "category")
    own = rows.select("tx_id", F.coalesce("category", F.lit("Unknown")).alias("predicted_category"), F.lit(1.0).alias("similarity_score"))
    return V.agreement(V.align_results(own, _categorised(spark, rows)))


@register("agreement_of_classifiers")
def _(spark, sf_dir):
    rows = _written(spark, sf_dir, "category")
    scored = settled(lambda: C.score(rows, TR.train(rows.where(F.col("category").isNotNull()), sparse=True)).select("tx_id", "predicted_category", "similarity_score"))
    return V.agreement(V.align_results(scored, _categorised(spark, rows)))
