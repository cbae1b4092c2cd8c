"""Text cleaning as Column -> Column functions.

Everything here is a native expression, so a scan that cleans descriptions stays inside one codegen
stage.  Patterns run with Unicode classes and newline-only line ends, which is what the published
results assume.

A chain whose steps use their input several times is a list of steps that :func:`as_column` binds one
after the other, so the expression stays linear in size wherever the planner moves it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from spendgrid import fixed_values as fv

# Function words the token filter drops when no trained tagger is at hand.
STOP_WORDS = (
    "a", "an", "the", "and", "or", "but", "of", "in", "on", "at", "by", "to", "for", "from", "with",
    "is", "are", "was", "were", "be", "been", "this", "that", "these", "those", "it", "its",
    "i", "you", "he", "she", "we", "they", "my", "your", "our", "their",
)

ANY_CASE = "(?iUd)"
SAME_CASE = "(?Ud)"


@dataclass(frozen=True)
class CleaningConfig:
    """Switches of the cleaning steps and the grouping that may follow."""

    remove_urls_emails: bool = True
    remove_card_numbers: bool = True
    remove_reference_codes: bool = True
    remove_bank_codes: bool = True
    remove_merchant_codes: bool = True
    normalize_whitespace: bool = True
    use_nlp_extraction: bool = True
    normalize_merchant_names: bool = True
    to_lowercase: bool = True
    drop_location_noise: bool = False
    stop_words: tuple[str, ...] = STOP_WORDS
    # grouping
    use_embedding_grouping: bool = True
    use_fuzzy_matching: bool = False
    clustering_method: str = "similarity"
    similarity_threshold: float = fv.SIMILARITY_THRESHOLD
    hierarchical_distance: float = fv.HIERARCHICAL_DISTANCE
    dbscan_eps: float = fv.DBSCAN_EPS
    dbscan_least_eps: float = fv.DBSCAN_LEAST_EPS
    dbscan_min_samples: int = fv.DBSCAN_MIN_SAMPLES
    batch_size: int = fv.GROUPING_BATCH
    batch_mode: bool = False
    size_rules: bool = False  # published switches by the number of names
    local_names: int = 1024  # names of a unit that one task settles


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


Step = Callable[[Column], Column]


def as_column(c: Column, steps: Sequence[Step]) -> Column:
    """All steps in one expression; a one-element array binds each intermediate value to a name."""
    for step in steps:
        c = F.transform(F.array(c), step)[0]
    return c


def replace_in_order(c: Column, patterns: Iterable[str], replacement: str, flags: str = ANY_CASE) -> Column:
    """Apply each pattern to the result of the one before it."""
    for pattern in patterns:
        c = F.regexp_replace(c, flags + pattern, replacement)
    return c


def apply_rules(c: Column, rules: Iterable[tuple[str, str]], flags: str = ANY_CASE) -> Column:
    for pattern, replacement in rules:
        c = F.regexp_replace(c, flags + pattern, replacement)
    return c


def strip(c: Column) -> Column:
    """Drop white space of any kind at both ends (``trim`` drops spaces only)."""
    return F.regexp_replace(c, SAME_CASE + r"^\s+|\s+\z", "")


def collapse(c: Column) -> Column:
    """White-space runs to one space, then trim."""
    return F.trim(F.regexp_replace(c, SAME_CASE + r"\s+", " "))


def _only_where(c: Column, hint: str, changed: Column) -> Column:
    """Skip a pattern chain on text that cannot match any of its patterns."""
    return F.when(F.rlike(c, F.lit(hint)), changed).otherwise(c)


def remove_urls_emails(c: Column | str) -> Column:
    c = _col(c)
    return _only_where(c, "://|@", replace_in_order(c, fv.URL_EMAIL_PATTERNS, "", SAME_CASE))


def remove_prefixes(c: Column | str) -> Column:
    return strip(replace_in_order(_col(c), fv.PREFIX_PATTERNS, ""))


def remove_card_numbers(c: Column | str) -> Column:
    c = _col(c)
    # every card shape holds a star, two x in a row, or the word
    return _only_where(c, ANY_CASE + r"\*|xx|card", replace_in_order(c, fv.CARD_PATTERNS, " "))


def remove_reference_codes(c: Column | str) -> Column:
    c = _col(c)
    # digits, or one of the words that introduce a reference
    return _only_where(c, r"(?iU)\d|ref|txn|transaction", replace_in_order(c, fv.REFERENCE_PATTERNS, " "))


def remove_bank_codes(c: Column | str) -> Column:
    # the first four are codes with digits, the others phrases around "converted" or "conversion"
    return as_column(_col(c), [
        lambda t: _only_where(t, r"(?U)\d", replace_in_order(t, fv.BANK_PATTERNS[:4], " ")),
        lambda t: _only_where(t, ANY_CASE + "conver", replace_in_order(t, fv.BANK_PATTERNS[4:], " "))])


def remove_merchant_codes(c: Column | str) -> Column:
    return replace_in_order(_col(c), fv.MERCHANT_PATTERNS, " ")


def is_noise_token(token: Column, config: CleaningConfig = CleaningConfig()) -> Column:
    """True for one white-space separated token that carries no merchant information."""
    words = fv.NOISE_WORDS + config.stop_words + (fv.LOCATION_WORDS if config.drop_location_noise else ())
    shapes = "|".join(f"(?:{shape})" for shape in fv.NOISE_SHAPES)
    return (
        F.lower(token).isin(*words)
        | F.rlike(token, F.lit(shapes))
        | F.rlike(token, F.lit(r"^[^\p{L}\p{N}]*$"))
    )


def informative_tokens(c: Column, config: CleaningConfig = CleaningConfig()) -> Column:
    """The text without noise phrases and noise tokens."""
    phrases = fv.NOISE_PHRASES + (fv.LOCATION_PHRASES if config.drop_location_noise else ())
    tokens = F.split(replace_in_order(c, phrases, " "), " ")
    return F.array_join(F.filter(tokens, lambda t: ~is_noise_token(t, config)), " ")


def longest_entity(entities: Column | str) -> Column:
    """The longest of an array of entity texts, the earliest of equally long ones; null where there is none."""
    return F.aggregate(_col(entities), F.lit(None).cast("string"),
                       lambda best, e: F.when(best.isNull() | (F.length(e) > F.length(best)), e).otherwise(best))


def merchant_steps(config: CleaningConfig = CleaningConfig(), entity: Column | None = None) -> list[Step]:
    """Quoted text first, then a supplied organisation entity, then the informative tokens.

    ``entity`` is the hook for a trained recogniser: a nullable column a caller computed with their
    own model (:func:`longest_entity` of what it found).  Without it the token filter decides; the input comes back if little is left.
    """
    def parts(c: Column) -> Column:
        kept = informative_tokens(c, config)
        return F.struct(c.alias("text"), F.regexp_extract(c, r'"([^"]+)"', 1).alias("quoted"), kept.alias("kept"))

    def choose(p: Column) -> Column:
        kept = F.when(F.length(F.trim(p["kept"])) <= fv.SHORT_TOKEN_RESULT, p["text"]).otherwise(p["kept"])
        if entity is not None:
            kept = F.coalesce(entity, kept)
        return F.when(F.length(p["quoted"]) > 0, strip(p["quoted"])).otherwise(kept)

    return [parts, choose]


def extract_merchant(c: Column | str, config: CleaningConfig = CleaningConfig(),
                     entity: Column | None = None) -> Column:
    return as_column(_col(c), merchant_steps(config, entity))


def normalize_merchant(c: Column | str) -> Column:
    return F.trim(apply_rules(F.lower(_col(c)), fv.NORMALISE_RULES))


def cleaning_steps(original: Column, config: CleaningConfig = CleaningConfig(),
                   entity: Column | None = None) -> list[Step]:
    """The whole cleaning chain, with the two-level fallback for results of three characters or less."""
    def cased(value: Column) -> Column:
        return F.lower(value) if config.to_lowercase else value

    def first(c: Column) -> Column:
        return remove_prefixes(remove_urls_emails(c) if config.remove_urls_emails else c)

    def last(c: Column) -> Column:
        if config.normalize_merchant_names:
            c = normalize_merchant(c)
        return collapse(cased(c))

    def fallback(text: Column) -> Column:
        bare = replace_in_order(original, fv.CARD_PATTERNS, " ")
        simple = collapse(replace_in_order(bare, [fv.FALLBACK_LONG_NUMBER], "", SAME_CASE))
        minimal = collapse(replace_in_order(original, [fv.FALLBACK_CARD_MASK], "", SAME_CASE))
        return (F.when(F.length(text) > fv.SHORT_RESULT, text)
                .when(F.length(simple) > fv.SHORT_RESULT, cased(simple))
                .when(F.length(minimal) > fv.SHORT_RESULT, cased(minimal))
                .otherwise(text))

    steps: list[Step] = [first]
    if config.remove_card_numbers:
        steps.append(remove_card_numbers)
    if config.remove_reference_codes:
        steps.append(remove_reference_codes)
    if config.remove_bank_codes:
        steps.append(remove_bank_codes)
    if config.remove_merchant_codes:
        steps.append(remove_merchant_codes)
    if config.normalize_whitespace:
        steps.append(collapse)
    if config.use_nlp_extraction:
        steps += merchant_steps(config, entity)
    return steps + [last, fallback]


def clean_description(c: Column | str, config: CleaningConfig = CleaningConfig(),
                      entity: Column | None = None) -> Column:
    """The cleaned text of a description."""
    original = F.coalesce(_col(c), F.lit(""))
    return as_column(original, cleaning_steps(original, config, entity))


def minimal_clean(c: Column | str) -> Column:
    return F.lower(collapse(apply_rules(_col(c), fv.MINIMAL_RULES, SAME_CASE)))


def moderate_clean(c: Column | str) -> Column:
    return F.lower(collapse(apply_rules(_col(c), fv.MODERATE_RULES, SAME_CASE)))


def normalize_variants(c: Column | str) -> Column:
    return strip(apply_rules(F.lower(_col(c)), fv.VARIANT_RULES))


def _first_containing(text: Column, rules: Iterable[tuple[str, tuple[str, ...]]], default: Column) -> Column:
    branches = None
    for result, words in rules:
        hit = F.lit(False)
        for word in words:
            hit = hit | F.contains(text, F.lit(word))
        branches = F.when(hit, F.lit(result)) if branches is None else branches.when(hit, F.lit(result))
    return branches.otherwise(default)


def resolve_alias(c: Column | str) -> Column:
    """The first canonical merchant one of whose aliases occurs in the name, else the name."""
    c = F.coalesce(_col(c), F.lit(""))
    return _first_containing(F.lower(c), fv.MERCHANT_ALIASES, c)


def keyword_category(c: Column | str) -> Column:
    c = F.coalesce(_col(c), F.lit(""))
    return _first_containing(F.lower(c), fv.MERCHANT_CATEGORIES, F.lit(fv.DEFAULT_MERCHANT_CATEGORY))


def contains_any(c: Column, words: Iterable[str]) -> Column:
    """Whether any of the words occurs in the lower-cased text."""
    text = F.lower(c)
    hit = F.lit(False)
    for word in words:
        hit = hit | F.contains(text, F.lit(word))
    return hit


def vendor_steps() -> list[Step]:
    def bare(c: Column) -> Column:
        text = F.regexp_replace(strip(c), ANY_CASE + fv.VENDOR_PREFIX, "")
        return F.struct(c.alias("given"), F.regexp_replace(text, ANY_CASE + fv.VENDOR_SUFFIX, "").alias("text"))

    def words(p: Column) -> Column:
        found = F.regexp_extract_all(F.upper(p["text"]), F.lit(SAME_CASE + fv.VENDOR_WORD), F.lit(0))
        found = F.slice(F.filter(found, lambda w: ~w.isin(*fv.VENDOR_STOP_WORDS)), 1, 2)
        return F.struct(p["given"].alias("given"), p["text"].alias("text"), F.array_join(found, " ").alias("name"))

    def choose(p: Column) -> Column:
        first_token = F.upper(F.regexp_extract(p["text"], SAME_CASE + r"\S+", 0))
        return (F.when(p["given"].isNull() | (p["given"] == ""), F.lit("Unknown"))
                .when(F.length(p["name"]) > 0, p["name"])
                .when(F.length(first_token) > 0, first_token)
                .otherwise(F.lit("UNKNOWN")))

    return [bare, words, choose]


def vendor_name(c: Column | str) -> Column:
    """The first two informative upper-case words, or the first word, or the first token."""
    return as_column(_col(c), vendor_steps())


def transfer_key(c: Column | str) -> Column:
    """Lower-case, collapsed text without numbers of six digits or more."""
    text = collapse(F.lower(_col(c)))
    return collapse(F.regexp_replace(text, SAME_CASE + fv.LONG_NUMBER, ""))
