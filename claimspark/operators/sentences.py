"""Sentence ends learned from a corpus (PRJ-21): abbreviations found by their statistics, applied with built-in functions.

A period ends a sentence unless its word is an abbreviation or an initial. Nothing but counts of the corpus decides (the
unsupervised statistic of Kiss and Strunk, 2006): words that nearly always carry a period (log-likelihood ratio), that are short, and that hold
inner periods are abbreviations; each occurrence without a period speaks against one. A word whose period a lower-case word
follows more often than not, five times or more, is one as well.

Words are runs without white space, without quotes and brackets around them; only A-Z are folded. Counts are summed map-side, so a
frequent word is no hot group. Null and empty texts hold no word; an empty corpus has no abbreviations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimspark.functions.text import strip_ws
from claimspark.operators.joins import join_checked

WORD = "[^\\x20\\x09-\\x0D]+"
QUOTES = "\"'()[]{}"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Least score of an abbreviation, the share of periods that an abbreviation is expected to carry, and the periods before
#: lower-case words that suffice.
THRESHOLD = 0.3
EXPECTED = 0.99
LOWER_CASES = 5


def bare(word: Column) -> Column:
    """A word without the quotes and brackets around it."""
    return F.trim(word, F.lit(QUOTES))


def _base(word: Column) -> Column:
    return F.rtrim(F.translate(bare(word), UPPER, LOWER), F.lit(",;:!?"))


def word_type(word: Column) -> Column:
    """What is counted: the folded word without punctuation after it."""
    return F.rtrim(_base(word), F.lit("."))


def words_with_next(docs: DataFrame, text_col: str, *keep: str) -> DataFrame:
    """A row per word: kept columns, word, next (null at the text's end)."""
    words = F.regexp_extract_all(F.col(text_col), F.lit(WORD), 0)
    pairs = docs.select(*keep, words.alias("w")).select(
        *keep, F.explode(F.arrays_zip(F.col("w").alias("word"), F.slice("w", 2, F.greatest(F.size("w"), F.lit(1))).alias("next"))).alias("p"))
    return pairs.select(*keep, "p.word", "p.next")


def period_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """type, n_period, n_plain, n_lower (periods that a lower-case word follows), score, abbreviation."""
    words = words_with_next(docs, text_col).select(
        word_type(F.col("word")).alias("type"), _base(F.col("word")).endswith(".").alias("period"),
        F.coalesce(bare(F.col("next")).rlike("^\\p{Ll}"), F.lit(False)).alias("lower"))
    counts = words.where("type <> ''").groupBy("type").agg(
        F.count_if("period").alias("n_period"), F.count_if(~F.col("period")).alias("n_plain"),
        F.count_if(F.col("period") & F.col("lower")).alias("n_lower"))
    totals = counts.agg(F.coalesce(F.sum("n_period"), F.lit(0)), F.coalesce(F.sum("n_plain"), F.lit(0))).first()
    share = min(max(totals[0] / max(totals[0] + totals[1], 1), 1e-9), 1 - 1e-9)
    a, b = F.col("n_period"), F.col("n_plain")
    ratio = 2 * (a * (F.log(F.lit(EXPECTED)) - F.log(F.lit(share))) + b * (F.log(F.lit(1 - EXPECTED)) - F.log(F.lit(1 - share))))
    inner = F.char_length("type") - F.char_length(F.replace("type", F.lit("."), F.lit("")))
    length = (F.char_length("type") - inner).cast("double")
    score = F.when((a == 0) | (length == 0), 0.0).otherwise(
        ratio * F.exp(-length) * (inner + 1) * F.exp(-b * F.log(F.greatest(length, F.lit(1.0)))))
    return (counts.withColumn("score", score)
            .withColumn("abbreviation", (F.col("score") >= THRESHOLD)
                        | (F.col("n_lower") >= LOWER_CASES) & (F.col("n_lower") * 2 > F.col("n_period"))))


def abbreviations(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(type): the corpus's abbreviations."""
    return period_statistics(docs, text_col).where("abbreviation").select("type")


def _marked(rows: DataFrame, word: str, abbreviated: DataFrame) -> DataFrame:
    """`ends`: whether a sentence ends after the row's word. The list is broadcast behind a size check."""
    known = abbreviated.select(F.col("type"), F.lit(True).alias("known"))
    mark = F.substr(bare(F.col(word)), F.lit(-1))
    joined = join_checked(rows.withColumn("type", word_type(F.col(word))), known, "type", "left")
    spared = F.col("known").isNotNull() | F.col("type").rlike("^\\p{L}$")
    return joined.withColumn("ends", F.coalesce(mark.isin("!", "?") | (mark == ".") & ~spared, F.lit(False))).drop("type", "known")


def sentence_counts(docs: DataFrame, abbreviated: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, n_sentences of each document; what follows the last end is a sentence too."""
    marked = _marked(words_with_next(docs, text_col, id_col), "word", abbreviated)
    counted = marked.groupBy(id_col).agg(F.count("*").alias("n_words"),
                                         F.count_if(F.col("ends") | F.col("next").isNull()).alias("n_sentences"))
    own = docs.select(F.col(id_col).alias("__id"))
    return (own.join(counted, F.col("__id").eqNullSafe(F.col(id_col)), "left").select(
        F.col("__id").alias(id_col), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_words", "n_sentences")]))


def leading_sentences(docs: DataFrame, abbreviated: DataFrame, id_col: str, text_col: str, n: int = 3) -> DataFrame:
    """id, sentences: the first n sentences, white space inside as it is. `id_col` must be unique."""
    parts = docs.select(id_col, F.posexplode(F.split(F.col(text_col), "(?<=[.!?])(?=\\s)")).alias("pos", "part"))
    last = parts.withColumn("last", F.regexp_extract("part", f"({WORD})\\s*$", 1))
    marked = _marked(last, "last", abbreviated)
    before = Window.partitionBy(id_col).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)  # one text
    kept = (marked.withColumn("done", F.coalesce(F.count_if("ends").over(before), F.lit(0))).where(F.col("done") < n)
            .groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("pos", "part"))).alias("parts")))
    return kept.select(id_col, strip_ws(F.array_join(F.col("parts.part"), "")).alias("sentences"))
