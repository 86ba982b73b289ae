"""Preparation steps: missing values, labels, features, audits, class balance.

Every step is a narrow DataFrame -> DataFrame transformation (no shuffle) except
the audits and the class balance, which are small aggregations with map-side
partial aggregation.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimspark.functions.numeric import coerce_count, parse_count, safe_ratio
from claimspark.functions.text import (
    capitalized_word_ratio,
    clean_categorical,
    clean_text,
    count_char,
    word_count,
)
from claimspark.schema import (
    BINARY_LABELS,
    CATEGORICAL_COLUMNS,
    CREDIT_COLUMNS,
    NA_STRINGS,
    ORDINAL_LABELS,
    POLITICAL_KEYWORDS,
)


def _lookup(mapping: dict[str, int], key):
    """Literal map lookup; an unknown key gives null."""
    m = F.create_map(*[x for k, v in mapping.items() for x in (F.lit(k), F.lit(v))])
    return F.try_element_at(m, key)


# -- PIPE-1: missing values -------------------------------------------------

def drop_missing_statement(df: DataFrame) -> DataFrame:
    """FLT-1: drop rows whose statement is null; a blank statement stays."""
    return df.dropna(subset=["statement"])


def coerce_counts(df: DataFrame, columns: Sequence[str] = CREDIT_COLUMNS) -> DataFrame:
    """PRJ-5: the five counts as bigint (non-numbers, NaN, inf, null -> 0)."""
    return df.withColumns({c: coerce_count(F.col(c)) for c in columns})


def clean_categoricals(df: DataFrame, columns: Sequence[str] = CATEGORICAL_COLUMNS,
                       fill: str = "unknown") -> DataFrame:
    """PRJ-2: null -> fill, strip, lower, "" -> fill."""
    return df.withColumns({c: clean_categorical(F.col(c), fill) for c in columns})


def handle_missing(df: DataFrame) -> DataFrame:
    return df.transform(drop_missing_statement).transform(coerce_counts).transform(clean_categoricals)


# -- PIPE-2: labels ---------------------------------------------------------

def known_label(label_col: str = "label"):
    return F.col(label_col).isin(list(BINARY_LABELS))


def map_labels(df: DataFrame, label_col: str = "label") -> DataFrame:
    """FLT-2 + PRJ-3/4: drop unknown and null labels (exact match), add binary and ordinal."""
    return (df.where(known_label(label_col))
            .withColumns({
                "label_binary": _lookup(BINARY_LABELS, F.col(label_col)).cast("int"),
                "label_ordinal": _lookup(ORDINAL_LABELS, F.col(label_col)).cast("int"),
            }))


def map_labels_join(df: DataFrame, label_col: str = "label") -> DataFrame:
    """JN-1: the same mapping as an inner join with a broadcast six-row dimension."""
    spark = df.sparkSession
    dim = spark.createDataFrame(
        [(k, BINARY_LABELS[k], ORDINAL_LABELS[k]) for k in BINARY_LABELS],
        f"{label_col} string, label_binary int, label_ordinal int")
    return df.join(F.broadcast(dim), label_col, "inner")


# -- PIPE-3: features -------------------------------------------------------

def political_flag(context_col: str = "context",
                   keywords: Sequence[str] = POLITICAL_KEYWORDS):
    """PRJ-12: 1 if any keyword is a substring of the (already cleaned) context."""
    hit = F.lit(False)
    for kw in keywords:
        hit = hit | F.coalesce(F.col(context_col).contains(kw), F.lit(False))
    return hit.cast("int")


def text_features(df: DataFrame, text_col: str = "statement") -> DataFrame:
    """PRJ-1, PRJ-6..9: cleaned text and its lengths; punctuation and capitals on the raw text."""
    clean = clean_text(F.col(text_col))
    return (df.withColumn("statement_clean", clean)
            .withColumns({
                "statement_len": word_count(F.col("statement_clean")),
                "statement_char_len": F.char_length("statement_clean"),
                "exclamation_count": count_char(F.col(text_col), "!"),
                "question_count": count_char(F.col(text_col), "?"),
                "capitalized_word_ratio": capitalized_word_ratio(F.col(text_col)),
            }))


def credit_features(df: DataFrame) -> DataFrame:
    """PRJ-10/11: lie rate = (false + pants-fire) / sum of five (0 -> 0.0); total = sum of five."""
    total = sum((F.col(c) for c in CREDIT_COLUMNS[1:]), F.col(CREDIT_COLUMNS[0]))
    return df.withColumns({
        "speaker_lie_rate": safe_ratio(F.col("false_counts") + F.col("pants_on_fire_counts"), total),
        "speaker_total_statements": total.cast("bigint"),
    })


def engineer_features(df: DataFrame, keywords: Sequence[str] = POLITICAL_KEYWORDS) -> DataFrame:
    return (df.transform(text_features).transform(credit_features)
            .withColumn("is_political_context", political_flag("context", keywords)))


def prepare_claims(raw: DataFrame, keywords: Sequence[str] = POLITICAL_KEYWORDS) -> DataFrame:
    """PIPE-4 minus I/O: missing -> labels -> features, one narrow plan over one scan."""
    return raw.transform(handle_missing).transform(map_labels).transform(
        lambda d: engineer_features(d, keywords))


# -- audits -----------------------------------------------------------------

def missing_audit(raw: DataFrame) -> DataFrame:
    """Rows in, rows dropped for a missing statement, and rows out, per split."""
    return (raw.groupBy("split").agg(
        F.count(F.lit(1)).alias("rows_in"),
        F.count_if(F.col("statement").isNull()).alias("rows_dropped"),
        F.count_if(F.col("statement").isNotNull()).alias("rows_out"),
        *[F.count_if(F.col("statement").isNotNull() & parse_count(F.col(c)).isNull())
          .alias(f"{c}_filled") for c in CREDIT_COLUMNS],
    ))


def unknown_label_audit(df: DataFrame) -> DataFrame:
    """One row per (split, unknown label) with its row count; a null label is its own row."""
    return (df.where(~F.coalesce(known_label(), F.lit(False)))
            .groupBy("split", "label").agg(F.count(F.lit(1)).alias("n_rows")))


# -- FLT-3 / SET-1: model input ---------------------------------------------

def model_input(df: DataFrame, text_col: str = "statement_clean", label_col: str = "label_binary",
                splits: Sequence[str] | None = None) -> DataFrame:
    """Rows usable for modelling: text and label present, text not a missing-value spelling.

    A CSV round trip turns cleaned text such as "" or "null" into a missing
    value, so those rows are filtered explicitly; the label becomes int.
    """
    if splits is not None:
        df = df.where(F.col("split").isin(list(splits)))
    return (df.dropna(subset=[text_col, label_col])
            .where(~F.col(text_col).isin(NA_STRINGS))
            .withColumn(label_col, F.col(label_col).cast("int")))


# -- AGG-1 / SRT-1: class balance -------------------------------------------

def class_balance(df: DataFrame) -> DataFrame:
    """Counts per split of the six-class and of the binary label, ranked by count (desc).

    One GROUPING SETS aggregation: a single scan and a single shuffle.
    """
    g = (df.groupingSets([["split", "label"], ["split", "label_binary"]],
                         "split", "label", "label_binary")
         .agg(F.count(F.lit(1)).alias("n_rows"), F.grouping_id().alias("gid")))
    by_label = F.col("gid") == 1  # label_binary rolled up
    out = g.select(
        "split",
        F.when(by_label, F.lit("label")).otherwise(F.lit("label_binary")).alias("level"),
        F.when(by_label, F.col("label")).otherwise(F.col("label_binary").cast("string")).alias("value"),
        "n_rows")
    w = Window.partitionBy("split", "level").orderBy(F.desc("n_rows"), F.asc("value"))
    return out.withColumn("rank", F.row_number().over(w))
