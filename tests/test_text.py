"""Hand-derived results of the text functions, quirks included."""

import pytest
from pyspark.sql import functions as F

from spendgrid import fixed_values as fv
from spendgrid.catalog.model_queries import QUERIES as MODEL_QUERIES
from spendgrid.catalog.text_queries import QUERIES
from spendgrid.functions import amounts as A
from spendgrid.functions import text as X


def run(spark, function, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.select("i", function(F.col("v")).alias("r")).orderBy("i").select("r").collect()]


def check(spark, function, cases):
    got = run(spark, function, [given for given, _ in cases])
    assert got == [wanted for _, wanted in cases]


def test_steps(spark):
    check(spark, X.remove_urls_emails, [
        ("pay https://x.example.com/a?b=1 now", "pay  now"),
        ("mail bob.smith@example.co.nz please", "mail  please"),
        ("HTTPS://UPPER stays", "HTTPS://UPPER stays"),
    ])
    check(spark, X.remove_prefixes, [
        ("DF COUNTDOWN", "COUNTDOWN"),          # one to four leading letters
        ("IF VISA COUNTDOWN", "COUNTDOWN"),     # then an explicit payment word
        ("EFTPOS 4835-**** x", "x"),            # then a card fragment
        ("COUNTDOWN", "COUNTDOWN"),
    ])
    check(spark, X.remove_card_numbers, [
        ("a 4835-****-****-0311 b", "a   b"),
        ("a xx1234 b", "a   b"),
        ("card 4835 **** **** b", " b"),
        ("no card", "no card"),
    ])
    check(spark, X.remove_reference_codes, [
        ("refund store", "  store"),            # "ref" swallows the rest of the word
        ("uber 123456 x", "uber   x"),
        ("shop S3D7741", "shop  "),
        ("plain", "plain"),
    ])
    check(spark, X.remove_bank_codes, [
        ("WOOLWORTHS 1234 BONDI", "  BONDI"),   # letters before a number vanish
        ("x converted at 1.05 y", "x converted  .05 y"),
        ("x includes 2.5 conversion charge y", "x  .5 conversion charge y"),
        ("x includes a conversion charge y", "x   y"),
    ])
    check(spark, X.normalize_merchant, [
        ("The Coffee Co Ltd", "coffee"),
        ("Main St Cafe", "main street cafe"),
        ("amazon.com * books", "amazon books"),
    ])


def test_whole_cleaning(spark):
    check(spark, X.clean_description, [
        ("4835-****-****-0311 Df RED WIDGET AUCKLAND", "red widget auckland"),
        ("VISA PURCHASE RED WIDGET REF150000", "red widget"),
        ('DD PAYMENT "Joe\'s Diner" 123456', "joe's diner"),
        ("", ""),
        (None, ""),
        ("WOOLWORTHS 1234", "woolworths"),      # nothing left: fall back to the text without long numbers
        (" COUNTDOWN AUCKLAND", "countdown auckland"),
        ("CAFÉ PARIS", "café paris"),           # an accented letter is part of the word
        ("CAFE PARIS", "paris"),
    ])


def test_cleaning_switches(spark):
    config = X.CleaningConfig(use_nlp_extraction=False, normalize_merchant_names=False, to_lowercase=False,
                              remove_card_numbers=False, remove_reference_codes=False, remove_bank_codes=False,
                              remove_merchant_codes=False)
    check(spark, lambda c: X.clean_description(c, config), [("COUNTDOWN  The 123456 Shop", "COUNTDOWN The 123456 Shop")])
    config = X.CleaningConfig(drop_location_noise=True)
    check(spark, lambda c: X.clean_description(c, config), [("COUNTDOWN AUCKLAND New Zealand NZ", "countdown auckland")])


def test_entity_hook(spark):
    df = spark.createDataFrame([
        ("paid countdown store today", ["shop", "countdown"]), ("paid countdown or newmarket", ["countdown", "newmarket"]),
        ("paid nobody", []), ("paid nobody", None), ('paid "corner cafe" countdown', ["countdown"]),
    ], "v string, orgs array<string>")
    rows = df.select(X.clean_description("v", entity=X.longest_entity("orgs")), X.clean_description("v")).collect()
    assert [r[0] for r in rows[:2]] == ["countdown", "countdown"]
    assert all(r[0] == r[1] for r in rows[2:])  # without an entity the tokens decide, quoted text comes before one


def test_vendor(spark):
    check(spark, X.vendor_name, [
        ("EFTPOS POSTAL SHOP", "POSTAL SHOP"),  # only one prefix is stripped
        ("POSTAL SHOP", "TAL SHOP"),            # no word boundary after the prefix
        ("BIG PLATEAU", "BIG PLATE"),           # nor before the suffix
        ("PAK N SAVE", "PAK SAVE"),
        ("THE CARD", "THE"),
        ("12 34", "12"),
        ("", "Unknown"), (None, "Unknown"), ("   ", "UNKNOWN"),
        ("WATER WATER", "WATER WATER"),
    ])


def test_lookups(spark):
    check(spark, X.resolve_alias, [("Woolies Metro", "woolworths"), ("pak n save p", "pak n save"), ("other", "other"), (None, "")])
    check(spark, X.keyword_category, [("BP Connect", "fuel"), ("Chemist Warehouse", "retail"), ("nothing", "other"), (None, "other")])
    check(spark, X.normalize_variants, [("The Woolies x", "woolworths"), ("ANZ S3D7741", "anz atm"), ("four  square", "four square")])
    check(spark, X.minimal_clean, [("4835-****-****-0311 Shop 1234567890", "shop")])
    check(spark, X.moderate_clean, [("AB123 Shop * 123456", "shop")])
    check(spark, X.transfer_key, [("To  Savings 1234567", "to savings")])


def test_amounts(spark):
    check(spark, A.parse_amount, [
        ("(1,234.50)", -1234.5), ("$12.25", 12.25), (" -3 ", -3.0), ("", 0.0), (None, 0.0), ("-", 0.0),
        ("n/a", 0.0), ("1e3", 1000.0), ("1.5d", 0.0), ("$(5)", -5.0)])
    check(spark, A.sheet_amount, [("$1,200.50 DR", 1200.5), ("-3-4", -3.0), ("abc", None), (None, None), ("1.2.3", 1.2)])


@pytest.mark.parametrize("value,places,wanted", [
    (0.545, 2, 0.55), (2.675, 2, 2.67), (0.125, 2, 0.12), (0.375, 2, 0.38), (-0.125, 2, -0.12), (10.075, 2, 10.07),
    (1.25, 1, 1.2), (1234567.005, 2, round(1234567.005, 2))])
def test_round_half_even(spark, value, places, wanted):
    assert round(value, places) == wanted
    assert spark.range(1).select(A.round_half_even(F.lit(value), places)).first()[0] == wanted


def test_elapsed_days(spark):
    df = spark.createDataFrame([("2024-01-01 23:00:00", "2024-01-02 22:00:00", 0), ("2024-01-01 01:00:00", "2024-01-03 02:00:00", 2)],
                               "a string, b string, wanted long")
    for r in df.select("wanted", A.elapsed_days(F.col("a").cast("timestamp"), F.col("b").cast("timestamp")).alias("got")).collect():
        assert r.got == r.wanted


def test_transactions_are_cleaned_once_a_text(spark):
    for name in ("clean_full", "variations", "reduction_ratio", "size_bands", "dictionary_match"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "LogicalRDD" in plan and "(?iUd)" not in plan  # the texts, cleaned and written; every row ran the chain before


def test_hints_skip_only_what_cannot_match(spark):
    """The skipped patterns, run one after the other, change nothing either."""
    pieces = ["shop", "XX1234", "xxxx-****-XXXX-xxxx", "Card number 1234 - * 12", "12345678", "4835-****-****-0311", "ref", "S3D7741", "branch 12",
              "AUD 2 converted", "Converted at 1.05", "includes a CONVERSION charge", "a.b@c.nz", "https://x.nz/a", "٤٨٣٥-****-****-٠٣١١", "ſ"]
    texts = [f"{a} {b}" for a in pieces for b in pieces]
    for step, plain in ((X.remove_urls_emails, lambda c: X.replace_in_order(c, fv.URL_EMAIL_PATTERNS, "", X.SAME_CASE)),
                        (X.remove_card_numbers, lambda c: X.replace_in_order(c, fv.CARD_PATTERNS, " ")),
                        (X.remove_bank_codes, lambda c: X.replace_in_order(c, fv.BANK_PATTERNS, " "))):
        assert run(spark, step, texts) == run(spark, plain, texts)


def test_first_rows_are_cleaned_once_a_text(spark):
    plan = MODEL_QUERIES["dedupe_keep_first"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "(?iUd)" not in plan and "Relation [" not in plan  # every row ran the chain, and the rows were built twice
