"""TF-IDF in long form: (doc, term, tf, df, idf, weight).

Plan shape:
  docs --deal(id)--> explode terms --groupBy(id, term)--> tf           (texts move once, term counts don't; a task's share is bounded)
  tf --groupBy(term), partial agg--> df, corpus tf                     (term shuffle)
  tf JOIN vocabulary                                                  (broadcast behind a size
      check; else shuffle join with AQE skew split)
  L2 norm, only where asked for: sum(w^2) OVER (PARTITION BY id)       (in place, on the documents' partitioning)

Definitions: tokens are lower-cased runs of 2+ word characters; n-grams are
built from the tokens; idf = ln((1 + n) / (1 + df)) + 1; sublinear tf = 1 + ln(tf);
rows are L2-normalised. The vocabulary keeps the `max_features` terms with the
highest corpus frequency (ties by term), indexed in term order. `id_col` names the document: it must
be unique (the model classes make a key of their own).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimspark.functions.text import ngrams, tokens
from claimspark.operators.joins import deal, join_checked


def term_frequencies(df: DataFrame, id_col: str = "id", text_col: str = "statement_clean",
                     ngram_max: int = 1) -> DataFrame:
    """(id, term, tf). Documents are dealt by id first, so the counts of a document's terms need no shuffle of their own."""
    dealt = deal(df.select(id_col, text_col), id_col)
    terms = dealt.select(id_col, F.explode(ngrams(tokens(F.col(text_col)), ngram_max)).alias("term"))
    return terms.groupBy(id_col, "term").agg(F.count(F.lit(1)).alias("tf"))


def document_frequencies(tf: DataFrame) -> DataFrame:
    """(term, df, corpus_tf) with map-side partial aggregation (hot terms pre-aggregated)."""
    return tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("corpus_tf"))


def idf_expr(df_col, n_docs: int):
    return F.log((F.lit(1) + F.lit(n_docs)) / (F.lit(1) + df_col)) + F.lit(1.0)


def vocabulary(tf: DataFrame, n_docs: int, max_features: int | None = None) -> DataFrame:
    """(term, idx, df, corpus_tf, idf). With max_features, the top terms by corpus
    frequency (a distributed top-k: per-partition top-k, then merge)."""
    dfs = document_frequencies(tf)
    if max_features is not None:
        dfs = dfs.orderBy(F.desc("corpus_tf"), F.asc("term")).limit(max_features)
        w = Window.orderBy("term")  # at most max_features rows
        dfs = dfs.withColumn("idx", (F.row_number().over(w) - 1).cast("int"))
    else:
        dfs = dfs.withColumn("idx", F.lit(None).cast("int"))
    return dfs.withColumn("idf", idf_expr(F.col("df"), n_docs))


def weigh(tf: DataFrame, vocab: DataFrame, id_col: str = "id", sublinear: bool = True,
          normalize: bool = True, small: bool | None = None) -> DataFrame:
    """Join term frequencies to the vocabulary and compute (optionally normalised) weights.

    `small` says what is known of the vocabulary's size: True fits a broadcast, False does not, None is measured.
    """
    v = vocab.select("term", "idx", "df", "idf")
    if small is None:
        joined = join_checked(tf, v, "term", "inner")
    else:
        joined = tf.join(F.broadcast(v) if small else v, "term", "inner")
    tfw = (F.lit(1.0) + F.log(F.col("tf").cast("double"))) if sublinear else F.col("tf").cast("double")
    out = joined.withColumn("weight", tfw * F.col("idf"))
    if normalize:
        norm = F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(Window.partitionBy(id_col)))
        out = out.withColumn("weight", F.col("weight") / norm)
    return out


def tfidf_long(df: DataFrame, id_col: str = "id", text_col: str = "statement_clean",
               ngram_max: int = 1, max_features: int | None = None, sublinear: bool = True,
               normalize: bool = True) -> DataFrame:
    """Fit and apply on the same corpus; returns (id, term, idx, tf, df, idf, weight)."""
    n_docs = df.count()
    tf = term_frequencies(df, id_col, text_col, ngram_max)
    return weigh(tf, vocabulary(tf, n_docs, max_features), id_col, sublinear, normalize)
