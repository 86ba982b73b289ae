"""Driver tables -> raw claims (the 14 string columns plus `split`).

documents LEFT JOIN labels on doc_id:
  id = doc_id, statement = text, speaker = source, party = lang,
  subject = ' ' || upper(lang) || ' ' (exercises strip + lower),
  speaker_job / state_info = null (exercise the "unknown" fill),
  context = lang || ' ' || source,
  label = by quality and doc_id % 3 (unlabelled -> null, dropped later),
  five counts = the speaker's labelled statements per class, as strings,
  split = (doc_id div 20 + doc_id) % 10: 0-7 train, 8 valid, 9 test.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimspark.operators.joins import join_checked, spread
from claimspark.schema import RAW_COLUMNS
from claimspark.sources.tables import read_table

# Label chosen by doc_id % 3 within each quality class.
FAKE_LABELS_BY_MOD = ["pants-fire", "false", "barely-true"]
REAL_LABELS_BY_MOD = ["half-true", "mostly-true", "true"]

# Which label each credit count column counts.
COUNT_LABEL = {
    "barely_true_counts": "barely-true",
    "false_counts": "false",
    "half_true_counts": "half-true",
    "mostly_true_counts": "mostly-true",
    "pants_on_fire_counts": "pants-fire",
}


def split_of(doc_id: Column) -> Column:
    bucket = (F.floor(doc_id / 20) + doc_id) % 10
    return (F.when(bucket <= 7, F.lit("train"))
            .when(bucket == 8, F.lit("valid"))
            .otherwise(F.lit("test")))


def label_of(doc_id: Column, quality: Column) -> Column:
    idx = (doc_id % 3 + 1).cast("int")
    fake = F.element_at(F.array(*[F.lit(x) for x in FAKE_LABELS_BY_MOD]), idx)
    real = F.element_at(F.array(*[F.lit(x) for x in REAL_LABELS_BY_MOD]), idx)
    return F.when(quality == 0, fake).when(quality == 1, real)


def speaker_history(claims: DataFrame, speaker_col: str = "speaker",
                    label_col: str = "label") -> DataFrame:
    """Per-speaker count of statements in each credit class (partial aggregation map-side)."""
    return claims.groupBy(speaker_col).agg(*[
        F.count_if(F.col(label_col) == lab).alias(c) for c, lab in COUNT_LABEL.items()
    ])


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, statement) of every claim, straight from `documents`: no label and no speaker is looked up."""
    docs = spread(read_table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id")
    return docs.select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("statement"))


def claims_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the text work downstream is CPU-bound: spread a narrow input (few files) over all cores
    docs = spread(read_table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source"), "doc_id")
    labels = read_table(spark, sf_dir, "labels", "doc_id", "quality")
    base = (docs.join(labels, "doc_id", "left")
            .select("doc_id", "text", "lang", "source",
                    label_of(F.col("doc_id"), F.col("quality")).alias("label"),
                    split_of(F.col("doc_id")).alias("split")))
    history = speaker_history(base, "source", "label")
    joined = join_checked(base, history, "source", "left")
    out = joined.select(
        F.col("doc_id").cast("string").alias("id"),
        F.col("label"),
        F.col("text").alias("statement"),
        F.concat(F.lit(" "), F.upper("lang"), F.lit(" ")).alias("subject"),
        F.col("source").alias("speaker"),
        F.lit(None).cast("string").alias("speaker_job"),
        F.lit(None).cast("string").alias("state_info"),
        F.col("lang").alias("party"),
        *[F.coalesce(F.col(c), F.lit(0)).cast("string").alias(c) for c in COUNT_LABEL],
        F.concat_ws(" ", "lang", "source").alias("context"),
        F.col("split"),
    )
    return out.select(*RAW_COLUMNS, "split")
