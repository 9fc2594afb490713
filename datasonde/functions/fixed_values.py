"""Word lists, patterns, labels and limits that define the results.

Nothing here is tuned; changing a value changes what the operators mean.
"""

# Text that stands for "no value" once stripped and lowercased.
SENTINEL_STRINGS = (
    "", "n/a", "na", "-", "?", "null", "none", "nan", "missing", "unknown",
)

# Characters that count as whitespace at the ends of a text.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Numbers that stand for "no value".
NUMERIC_SENTINELS = (-999, -9999)

# CSV tokens read as missing.
CSV_MISSING_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)

# Personal-data kinds in priority order: (kind, label, whole-value pattern).
PII_KINDS = (
    ("email", "email address", r"^[\w.+-]+@[\w-]+\.[\w.-]+$"),
    ("ssn", "US Social Security Number", r"^\d{3}-\d{2}-\d{4}$"),
    ("credit_card", "credit card number", r"^\d{4}[\s-]?\d{4}[\s-]?\d{4}[\s-]?\d{3,4}$"),
    ("ip_address", "IP address", r"^(25[0-5]|2[0-4]\d|1?\d?\d)(\.(25[0-5]|2[0-4]\d|1?\d?\d)){3}$"),
    ("phone", "phone number", r"^\+?1?[\s.-]?\(?\d{3}\)?[\s.-]?\d{3}[\s.-]?\d{4}$"),
)
PII_MIN_VALUES = 3
PII_MIN_RATIO = 0.6

# A whole value that reads as a number once thousands commas are removed.
NUMBER_PATTERN = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$|^[+-]?(inf|Inf|INF|infinity|Infinity)$"

# A whole value in ISO 8601 shape, extended (2024-01-05T10:30:00Z) or basic (20240105).
ISO_PATTERN = (
    r"^\d{4}(-\d{2}(-\d{2}([T ]\d{2}(:\d{2}(:\d{2}(\.\d{1,9})?)?)?(Z|[+-]\d{2}(:?\d{2})?)?)?)?)?$"
    r"|^\d{8}(T\d{2}(\d{2}(\d{2}(\.\d{1,9})?)?)?(Z|[+-]\d{2}(:?\d{2})?)?)?$"
)
ISO_OFFSET_PATTERN = r"[T ]\d{2}[\d:.]*(Z|[+-]\d{2}(:?\d{2})?)$"

# Date layouts besides ISO 8601 that count as "a date stored as text".
DATE_FORMATS = (
    ("M/d/yyyy", r"^\d{1,2}/\d{1,2}/\d{4}$"),
    ("d/M/yyyy", r"^\d{1,2}/\d{1,2}/\d{4}$"),
    ("M/d/yy", r"^\d{1,2}/\d{1,2}/\d{2}$"),
    ("M-d-yyyy", r"^\d{1,2}-\d{1,2}-\d{4}$"),
    ("d-M-yyyy", r"^\d{1,2}-\d{1,2}-\d{4}$"),
    ("M.d.yyyy", r"^\d{1,2}\.\d{1,2}\.\d{4}$"),
    ("d.M.yyyy", r"^\d{1,2}\.\d{1,2}\.\d{4}$"),
    ("yyyy-M-d", r"^\d{4}-\d{1,2}-\d{1,2}$"),
    ("yyyy/M/d", r"^\d{4}/\d{1,2}/\d{1,2}$"),
    ("yyyy.M.d", r"^\d{4}\.\d{1,2}\.\d{1,2}$"),
    ("d MMM yyyy", r"^\d{1,2} [A-Z][a-z]{2} \d{4}$"),
    ("d-MMM-yyyy", r"^\d{1,2}-[A-Z][a-z]{2}-\d{4}$"),
    ("d MMMM yyyy", r"^\d{1,2} [A-Z][a-z]{3,8} \d{4}$"),
    ("MMM d yyyy", r"^[A-Z][a-z]{2} \d{1,2} \d{4}$"),
    ("MMM d, yyyy", r"^[A-Z][a-z]{2} \d{1,2}, \d{4}$"),
    ("MMMM d yyyy", r"^[A-Z][a-z]{3,8} \d{1,2} \d{4}$"),
    ("MMMM d, yyyy", r"^[A-Z][a-z]{3,8} \d{1,2}, \d{4}$"),
)

# Share of non-blank values that must parse before a text column is flagged.
TEXT_PARSE_RATIO = 0.6

# Advice per quality check.
CHECK_ADVICE = (
    ("whitespace", "strip leading and trailing whitespace"),
    ("numeric_as_text", "convert the text column to a number"),
    ("dates_as_text", "parse the text column as dates"),
    ("sentinels", "replace placeholder text with nulls"),
    ("mixed_case", "settle on one letter case per category"),
    ("numeric_sentinel", "replace -999/-9999 with nulls or document them"),
)
CONSISTENCY_CHECKS = ("whitespace", "mixed_case")
VALIDITY_CHECKS = ("numeric_as_text", "dates_as_text", "sentinels", "numeric_sentinel")

# Health score.
HEALTH_WEIGHTS = (("completeness", 40), ("uniqueness", 20), ("consistency", 20), ("validity", 20))
HEALTH_DEDUCTION = 15.0
HEALTH_GRADES = ((90, "A"), (80, "B"), (70, "C"), (60, "D"))

# Sizes of the reported results. Columns are never left out unless a caller asks for it.
LOW_CARDINALITY = 20
MIN_ID_ROWS = 10

# Plan limits.
MAX_FILTER_NODES = 40
MAX_IN_VALUES = 50
MAX_GROUP_COLUMNS = 3
MAX_RESULT_GROUPS = 20
