"""ML-14: fixed-length token-id sequences with an attention mask.

Each text is tokenised in full; the encoding keeps the first (max_length - 2)
tokens between a begin and an end id, maps them through a vocabulary (unknown
-> UNK), and pads with PAD to max_length; the mask is 1 on real positions.
The vocabulary is broadcast behind a size check; only the kept positions are exploded, and each
document's group holds at most max_length rows. Rows get a key of their own, fixed by a checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimspark.functions.text import tokens
from claimspark.operators.joins import join_checked
from claimspark.operators.tfidf import term_frequencies, vocabulary
from claimspark.schema import BOS_ID, EOS_ID, PAD_ID, UNK_ID
from claimspark.session import materialize

FIRST_TERM_ID = 4  # ids 0-3 are the special ids


def token_vocabulary(corpus: DataFrame, id_col: str, text_col: str, max_features: int) -> DataFrame:
    """(term, token_id): the most frequent corpus terms, ids in term order after the specials."""
    v = vocabulary(term_frequencies(corpus, id_col, text_col, 1), 1, max_features)
    return v.select("term", (F.col("idx") + F.lit(FIRST_TERM_ID)).alias("token_id"))


def encode(df: DataFrame, vocab: DataFrame, id_col: str = "id", text_col: str = "statement_clean",
           max_length: int = 128, label_col: str | None = None) -> DataFrame:
    """(id[, label], input_ids array<int>, attention_mask array<int>, n_tokens int)."""
    if max_length < 2:
        raise ValueError("max_length must leave room for the begin and end ids")
    keep = max_length - 2
    label = [label_col] if label_col else []
    tok = df.select(id_col, *label, tokens(F.coalesce(F.col(text_col), F.lit(""))).alias("__tok"))
    base = tok.select(id_col, *label, F.size("__tok").alias("n_tokens"), F.slice("__tok", 1, keep).alias("__kept"))
    keyed = materialize(base.withColumn("__row", F.monotonically_increasing_id()))  # equal ids keep sequences of their own
    pos = keyed.select("__row", id_col, *label, "n_tokens", F.posexplode_outer("__kept").alias("pos", "term"))
    known = join_checked(pos, vocab, "term", "left")
    tid = F.coalesce("token_id", F.lit(UNK_ID)).cast("int")
    entry = F.when(F.col("pos").isNotNull(), F.struct("pos", tid.alias("tid")))
    seq = known.groupBy("__row", id_col, *label, "n_tokens").agg(F.array_sort(F.collect_list(entry)).alias("__s"))
    body = F.concat(F.array(F.lit(BOS_ID)), F.transform("__s", lambda x: x["tid"]), F.array(F.lit(EOS_ID)))
    n_real = F.size("__s") + 2
    pad = F.array_repeat(F.lit(PAD_ID), F.lit(max_length) - n_real)
    mask = F.concat(F.array_repeat(F.lit(1), n_real), F.array_repeat(F.lit(0), F.lit(max_length) - n_real))
    cols = [id_col, *([F.col(label_col).cast("long").alias("labels")] if label_col else [])]
    return seq.select(*cols, F.concat(body, pad).alias("input_ids"), mask.alias("attention_mask"), "n_tokens")
