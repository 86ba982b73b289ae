"""Schemas and the fixed values the results depend on."""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values (must stay exactly as written for results to match).
# ---------------------------------------------------------------------------

# Raw claim columns, in file order (headerless TSV).
RAW_COLUMNS = [
    "id", "label", "statement", "subject", "speaker", "speaker_job", "state_info",
    "party", "barely_true_counts", "false_counts", "half_true_counts",
    "mostly_true_counts", "pants_on_fire_counts", "context",
]

# Six-class label -> binary (0 = fake, 1 = real) and ordinal (0 .. 5).
BINARY_LABELS = {
    "pants-fire": 0, "false": 0, "barely-true": 0,
    "half-true": 1, "mostly-true": 1, "true": 1,
}
ORDINAL_LABELS = {
    "pants-fire": 0, "false": 1, "barely-true": 2,
    "half-true": 3, "mostly-true": 4, "true": 5,
}

# Speaker credit-history count columns (there is no count for "true").
CREDIT_COLUMNS = [
    "barely_true_counts", "false_counts", "half_true_counts",
    "mostly_true_counts", "pants_on_fire_counts",
]

# Categorical columns cleaned with fill value "unknown".
CATEGORICAL_COLUMNS = ["subject", "speaker", "speaker_job", "state_info", "party", "context"]
CATEGORICAL_FILL = "unknown"

# Keywords that flag a political context (substring match on the cleaned context).
POLITICAL_KEYWORDS = ["congress", "senate", "president", "republican", "democrat", "white house"]

# Strings a CSV reader treats as missing in addition to the empty field.
NA_STRINGS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
    "n/a", "nan", "null",
]

# Unicode whitespace (what Python's str.isspace accepts), as a Java regex class.
WS_CLASS = "[\\s\\x1c-\\x1f\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"
# The same class for RE2 (DuckDB): RE2's \s lacks \x0B.
WS_CLASS_RE2 = ("[\\s\\x0B\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}"
                "\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]")

# Prediction class names by id; ties in argmax go to id 0.
CLASS_NAMES = {0: "FAKE", 1: "REAL"}

# Error-table columns: always-shown, then optional ones kept when present.
ERROR_DISPLAY_COLUMNS = ["true_label", "predicted_label", "label"]
ERROR_OPTIONAL_COLUMNS = ["statement_len", "speaker_lie_rate", "party", "speaker", "context"]

# Evidence messages.
NO_RESULTS = "No search results found."
AMBIGUOUS_PREFIX = "Search is too ambiguous. Possible matches: "

# Sequence-encoding special ids (begin, pad, end, unknown).
BOS_ID, PAD_ID, EOS_ID, UNK_ID = 0, 1, 2, 3

DEFAULT_MODEL_VERSION = "claimspark_rule_v1"

# ---------------------------------------------------------------------------
# Schemas
# ---------------------------------------------------------------------------

RAW_SCHEMA = T.StructType([T.StructField(c, T.StringType(), True) for c in RAW_COLUMNS])

DERIVED_COLUMNS = [
    "label_binary", "label_ordinal", "statement_clean", "statement_len",
    "statement_char_len", "exclamation_count", "question_count",
    "capitalized_word_ratio", "speaker_lie_rate", "speaker_total_statements",
    "is_political_context",
]

PROCESSED_COLUMNS = RAW_COLUMNS + DERIVED_COLUMNS
SPLITS = ("train", "valid", "test")
