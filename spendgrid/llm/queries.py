"""Registered queries of the document operators, over whole tables with production parameters, and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendgrid.llm import (anchor_dedup, attention_lm, collocations, exact_dedup, license_scan, mixing, ngram_join, pieces, quality, secret_scan,
                           suffix_dedup, turn_repair, version_sketch)
from spendgrid.llm.shared import documents


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected grade, chance of the top grade and decision for every document."""
    docs = documents(spark, sf_dir)
    model = quality.train(docs, quality.graded(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return quality.rated(docs, model).select("doc_id", "_rating.expected_grade", "_rating.top_chance", "_rating.kept")


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of the shingle set and component of every document."""
    return ngram_join.similar_groups(documents(spark, sf_dir))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often every document is taken when the sources are mixed by temperature within a budget of all tokens."""
    return mixing.mix(documents(spark, sf_dir))


def op4_anchor_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document, how many repeats remove, and the digest of what stays."""
    return anchor_dedup.repeats(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row that stays for every document."""
    return exact_dedup.exact_copies(documents(spark, sf_dir))


def op6_version_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited version, and their likeness."""
    return version_sketch.versions(documents(spark, sf_dir))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document, how many repeats remove in how many spans, and the digest of what stays."""
    return suffix_dedup.repeats(documents(spark, sf_dir))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, how many come from byte fallback, whether they decode to the text and, for a share, agree with the reference."""
    rows = pieces.encoded(documents(spark, sf_dir).select("doc_id", "text"), pieces.read_model())
    return rows.select("doc_id", F.col("_n_tokens").alias("n_tokens"), F.col("_n_bytes").alias("n_bytes"),
                       F.col("_round_trip").alias("round_trip"), F.col("_parity").alias("parity"), F.col("_ids").alias("ids"))


def op9_attention_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base score and model score of every document."""
    return attention_lm.scores(documents(spark, sf_dir))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and model spans of every document."""
    docs = documents(spark, sf_dir)
    return secret_scan.scan(docs, secret_scan.Markov.train(secret_scan.labelled_samples(docs)))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best phrases of two and three words of every language."""
    return collocations.collocations(documents(spark, sf_dir))


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence labels of every document, where they stand, and how sure they are."""
    docs = documents(spark, sf_dir)
    return license_scan.scan(docs, license_scan.weighed_index(docs))


def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, least cost and edits of every damaged conversation."""
    return turn_repair.repair(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


QUERIES = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_ngram_join": op2_ngram_join,
    "op3_source_mixing": op3_source_mixing,
    "op4_anchor_dedup": op4_anchor_dedup,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_version_fingerprints": op6_version_fingerprints,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_attention_lm": op9_attention_lm,
    "op10_secret_scan": op10_secret_scan,
    "op11_collocations": op11_collocations,
    "op12_license_scan": op12_license_scan,
    "op13_turn_repair": op13_turn_repair,
}

ORACLES = {
    "op5_exact_dedup": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text,
                          regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS normal FROM documents)
        SELECT doc_id, first_value(doc_id) OVER g AS keep_id, count(*) OVER (PARTITION BY normal) AS group_size,
               row_number() OVER g = 1 AS kept, sha256(normal) AS text_sha256
        FROM d WINDOW g AS (PARTITION BY normal ORDER BY length(text) DESC, doc_id)""",
    "op11_collocations": r"""
        WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                               'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
             lists AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
             f AS (SELECT lang, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS phrase, count(*) AS f
                   FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM lists, (VALUES (1), (2), (3)) sizes(k)) GROUP BY ALL),
             cand AS (SELECT *, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 10),
             totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM lists GROUP BY lang),
             cuts AS (SELECT c.lang, c.k, c.phrase, c.a, cut, x.f AS l, y.f AS r,
                             ((1000000::HUGEINT * c.a * c.a) // (x.f::HUGEINT * y.f))::BIGINT AS score
                      FROM (SELECT *, unnest(range(1, k)) AS cut FROM cand) c
                      JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(list_slice(w, 1, cut), ' ')
                      JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(list_slice(w, cut + 1, c.k), ' ')),
             low AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
             longer AS (SELECT lang, inside, max(a) AS a FROM (SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS inside
                        FROM cand WHERE k = 3) GROUP BY ALL),
             kept AS (SELECT low.* FROM low LEFT JOIN longer g ON g.lang = low.lang AND g.inside = low.phrase
                      WHERE low.k = 3 OR g.a IS NULL OR 100 * g.a < 50 * low.a)
        SELECT kept.lang, row_number() OVER (PARTITION BY kept.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
        FROM kept JOIN totals USING (lang) QUALIFY rank <= 2000""",
}
