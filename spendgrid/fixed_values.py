"""Fixed values.

Every list, pattern and constant below must equal the published behaviour for results to match, so
they are stated as plain text, in their natural order, and nowhere else in the package.  Patterns
are written once and used with the same text by every engine; matching is case-insensitive unless a
comment says otherwise.
"""

# --- cleaning: step 1, case-sensitive, replaced by nothing -----------------------------------
URL_EMAIL_PATTERNS = (
    r"https?://\S+",
    r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
)

# --- cleaning: leading prefixes, replaced by nothing -------------------------------------------
PREFIX_PATTERNS = (
    r"^\s*[A-Z]{1,4}\s+",
    r"^\s*(?:debit|credit|visa|eftpos|mastercard)\s+",
    r"^\s*\d{4}-\*+\s*",
)

# --- cleaning: card shapes, each replaced by a space -------------------------------------------
CARD_PATTERNS = (
    r"\b\d{4}[-\s]?\*{4}[-\s]?\*{4}[-\s]?\d{4}\b",
    r"\b\d{4}[-\s]?\d{2}\*{2}[-\s]?\*{4}[-\s]?\d{4}\b",
    r"\b\*{4}[-\s]?\*{4}[-\s]?\*{4}[-\s]?\d{4}\b",
    r"\b\d{4}[-\s]?\*{4}[-\s]?\*{4}[-\s]?\*{4}\b",
    r"\b\d{4}[-\s]?\*+[-\s]?\*+[-\s]?\d{1,4}\b",
    r"\bxx\d+\b",
    r"\b\*{4,}\b",
    r"\bcard\s*(?:number\s*)?\d{4}[-\s\*]{4,}\d{0,4}\b",
    r"\b\d{4}-\*{4}-\*{4}-\d{4}\s*[A-Z]{1,3}\b",
    r"\b[*xX]{4}-[*xX]{4}-[*xX]{4}-[*xX]{4}\b",
    r"\b\d{4}[-\s]\*+[-\s]\*+[-\s]\d{4}\s*[A-Z]{1,3}\b",
    r"\b\d{4}\*+\d{1,4}\s*[A-Z]{1,3}\b",
    r"\b\*{8,16}\s*[A-Z]{1,3}\b",
)

# --- cleaning: reference codes, each replaced by a space -----------------------------------------
REFERENCE_PATTERNS = (
    r"\b(?:ref|reference|txn|transaction)[:.]?\s*[A-Z0-9]{3,}\b",
    r"\b[A-Z]{1,3}\s*\d{6,}\b",
    r"\b\d{6,}\b",
    r"\b[A-Z]\d+[A-Z]?\d*\b",
    r"\b\d+[A-Z]+\d*\b",
    r"\b\d{6,}[A-Z]*\b",
    r"\b[A-Z]{2,4}\d+\b",
    r"\b\d+[A-Z]{2,4}\b",
)

# --- cleaning: bank codes, each replaced by a space ------------------------------------------------
BANK_PATTERNS = (
    r"\banz\s+s\d[a-z]\d+\b",
    r"\bs\d[a-z]\d+\b",
    r"\b(?:br|branch)\s*\d+\b",
    r"\b[A-Z]{2,}\s+\d+\b",
    r"\bconverted\s+at\s+[\d.]+\b",
    r"\bincludes?\s+.*?conversion\s+charge\b",
    r"\b[A-Z]{3}\s+[\d.]+\s+converted\b",
)

# --- cleaning: merchant codes, each replaced by a space ----------------------------------------------
MERCHANT_PATTERNS = (
    r"\b(?:store|branch|outlet|location)\s*#?\d+\b",
    r"\b#\d{3,}\b",
    r"\b-\s*\d{3,5}$",
    r"\b[A-Z]+\s*\d{3,5}$",
    r"\b(?:mt|bl|ra|pt|rd|st|av|pk|sh|ctr|ct)\b$",
    r"\b[A-Z]\s*\d+[A-Z]?$",
    r"\b\d{4,8}[A-Z]*\b",
)

# --- cleaning: merchant-name normalisation on lower-case text, (pattern, replacement) ------------------
NORMALISE_RULES = (
    (r"\b(?:the|a|an)\s+", ""),
    (r"\s+(?:inc|ltd|llc|corp|co|limited|corporation)\b", ""),
    (r"\s+(?:pty|gmbh|ag|bv)\b", ""),
    (r"\bst\b", "street"),
    (r"\brd\b", "road"),
    (r"\bave?\b", "avenue"),
    (r"\bdr\b", "drive"),
    (r"\bmt\b", "mount"),
    (r"[*#@$%&]", ""),
    (r"\.com\b", ""),
    (r"\s+", " "),
)

# --- cleaning: short-result fallback --------------------------------------------------------------------
FALLBACK_LONG_NUMBER = r"\b\d{4,}\b"
FALLBACK_CARD_MASK = r"\d{4}-\*{4}-\*{4}-\d{4}"
SHORT_RESULT = 3
SHORT_TOKEN_RESULT = 2

# --- noise tokens: several words in a row ------------------------------------------------------------------
NOISE_PHRASES = (
    r"\btap\s+(?:(?:and|&)\s+)?(?:pay|go)\b",
    r"\bchip\s+(?:(?:and|&)\s+)?pin\b",
    r"\bdirect\s+(?:debit|credit)\b",
    r"\bautomatic\s+payment\b",
)

# --- noise tokens: single words, compared in lower case ------------------------------------------------------
NOISE_WORDS = (
    "visa", "eftpos", "mastercard", "amex", "debit", "credit",
    "contactless",
    "purchase", "payment", "transfer", "withdrawal", "deposit",
    "atm", "pos", "eft",
    "authorised", "netbank", "commbank", "app",
    "df", "if", "sp",
    "card", "value", "date", "ref", "reference", "txn",
)

# --- noise tokens: shapes of a whole token, case-sensitive (the bank code is tested in both cases) ---------------
NOISE_SHAPES = (
    r"^[A-Z]{2,4}\d{2,4}$",
    r"^\d{3,6}$",
    r"^[A-Z]\d+[A-Z]?$",
    r"^[sS]\d[a-zA-Z]\d+$",
    r"^\*{4,}$",
    r"^\d{5,}$",
)

# --- location noise: defined but not part of the default pipeline ---------------------------------------------------
LOCATION_PHRASES = (
    r"\bunited\s+(?:states|kingdom)\b",
    r"\bnew\s+zealand\b",
)
LOCATION_WORDS = (
    "au", "aus", "australia", "us", "usa", "gb", "gbr", "uk", "ca", "can", "canada", "nz", "nzl",
    "nsw", "vic", "qld", "wa", "sa", "tas", "act", "nt", "dee", "ns",
)

# --- lighter cleaning levels: (pattern, replacement), case-sensitive, then collapse and lower-case -----------------------
MINIMAL_RULES = (
    (r"\d{4}-\*{4}-\*{4}-\d{4}", ""),
    (r"\b\d{10,}\b", ""),
)
MODERATE_RULES = (
    (r"\d{4}-\*{4}-\*{4}-\d{4}", ""),
    (r"\b\d{6,}\b", ""),
    (r"\b[A-Z]{2,3}\d{3,}\b", ""),
    (r"\*", ""),
)

# --- chain-specific variants on lower-case text, (pattern, replacement) ----------------------------------------------------
VARIANT_RULES = (
    (r"woolworths?\s*[a-z]?", "woolworths"),
    (r"woolies?\s*[a-z]?", "woolworths"),
    (r"pak\s*n\s*save\s*[a-z]?", "pak n save"),
    (r"new\s*world\s*[a-z]{2}", "new world"),
    (r"^the\s+", ""),
    (r"\s+the$", ""),
    (r"anz\s+s\d[a-z]\d+", "anz atm"),
    (r"kiwi\s+fuels?", "kiwi fuel"),
    (r"four\s+square", "four square"),
)

# --- merchant aliases: canonical name, substrings; first canonical wins -------------------------------------------------------
MERCHANT_ALIASES = (
    ("woolworths", ("woolworths n", "woolworths o", "woolies")),
    ("pak n save", ("pak n save p", "pak n save fuel")),
    ("new world", ("new world mt", "new world bl", "new world ra")),
    ("four square", ("four square",)),
    ("warehouse", ("the warehous", "warehouse st")),
    ("anz atm", ("anz s3d7741", "anz s3c7711", "anz s3a1490")),
)

# --- merchant keyword categories: first category with a keyword substring wins, else "other" ---------------------------------------
MERCHANT_CATEGORIES = (
    ("supermarkets", ("woolworths", "pak n save", "new world", "four square", "freshchoice")),
    ("fuel", ("z energy", "bp", "mobil", "caltex", "gull", "rd petroleum", "kiwi fuel")),
    ("retail", ("kmart", "warehouse", "farmers", "cotton on", "noel leeming")),
    ("health", ("chemist warehouse", "life pharmacy", "unichem")),
    ("food", ("uber eats", "menulog", "pizza", "burger", "coffee", "cafe")),
)
DEFAULT_MERCHANT_CATEGORY = "other"

# --- vendor name --------------------------------------------------------------------------------------------------------------------
VENDOR_PREFIX = r"^(EFTPOS|ATM|POS)\s*"
VENDOR_SUFFIX = r"\s*(AU|AUS|NZ|NZL)\s*$"
VENDOR_WORD = r"\b[A-Za-z]{3,}\b"
VENDOR_STOP_WORDS = ("THE", "AND", "FOR", "WITH", "FROM", "CARD", "DATE", "VALUE")

# --- category kinds --------------------------------------------------------------------------------------------------------------------
INCOME_KEYWORDS = ("income", "salary", "deposit", "credit", "refund", "dividend", "interest")
TRANSFER_KEYWORDS = ("transfer", "atm", "withdrawal", "cash")
INCOME_SHARE = 0.7

# --- analytics ---------------------------------------------------------------------------------------------------------------------------
DISCRETIONARY_KEYWORDS = ("dinner", "bars", "shopping", "entertainment", "coffee")
GROCERY_KEYWORDS = ("woolworths", "pak n save", "new world", "coles", "countdown")
HOUSING_CATEGORIES = ("living", "rent", "housing")
GROCERY_CATEGORIES = ("groceries", "food")
TRANSPORT_CATEGORIES = ("transport", "fuel", "gas")
TOP_VENDORS = 10
TOP_CATEGORIES = 5
OUTLIER_MIN_ROWS = 5
OUTLIER_DEVIATIONS = 2
OUTLIER_HIGH_FACTOR = 1.5
RECURRING_MIN_ROWS = 3
RECURRING_MAX_VARIATION = 0.15
CATEGORY_SAVING = 0.2
CONSOLIDATION_SAVING = 0.1
WEEKS_PER_MONTH = 4.33
DAYS_PER_YEAR = 365
DAYS_PER_MONTH = 30

# --- classification ------------------------------------------------------------------------------------------------------------------------
MIN_SCORE = 0.60
MIN_GAP = 0.05
NEIGHBOURS_KEPT = 5
REASON_LOW_SCORE = "Match score was below the confidence threshold."
REASON_CONFLICT = "Top two matches were very similar and had conflicting neighbor categories."
REASON_SUGGESTED = "Categorized by LLM assist."
TRANSFER_IN = "Transfer in"
TRANSFER_OUT = "Transfer out"
AMOUNT_TOLERANCE = 0.01
LONG_NUMBER = r"\b\d{6,}\b"

# --- training and requests --------------------------------------------------------------------------------------------------------------------
MIN_TRAINING_ROWS = 10
MAX_DESCRIPTION = 500
WARNING_PREFIX = 50
INDEX_DESCRIPTION = 256
INDEX_CATEGORY = 128
LABELLER_BATCH = 15

# --- vectors -----------------------------------------------------------------------------------------------------------------------------------
CHAR_SLOTS = 256
INT8_LEVELS = 127

# --- grouping ------------------------------------------------------------------------------------------------------------------------------------
SIMILARITY_THRESHOLD = 0.85
HIERARCHICAL_DISTANCE = 0.3
DBSCAN_EPS = 0.25
DBSCAN_LEAST_EPS = 0.1
DBSCAN_EPS_AT_ZERO = 0.5
DBSCAN_EPS_PER_THOUSAND = 0.1
DBSCAN_MIN_SAMPLES = 2
GROUPING_BATCH = 25
SMALL_INPUT = 5

# --- categories ------------------------------------------------------------------------------------------------------------------------------------
PREDEFINED_CATEGORIES = (
    "Groceries", "Shopping", "DinnerBars", "Medical", "Transport", "Utility", "Travel", "Kids",
    "Business", "Living", "Tax", "Transfer", "Income",
)
DEFAULT_GROUP_CATEGORY = "GENERAL_SERVICES"

# --- accounts and jobs -------------------------------------------------------------------------------------------------------------------------------
LIVE_SUBSCRIPTION_STATUSES = ("ACTIVE", "TRIALING")
AGREEMENT_HIGH = 70
AGREEMENT_MODERATE = 50
