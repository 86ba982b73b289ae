"""Evidence retrieval: best matching document per statement, by TF-IDF cosine similarity.

Scoring: documents and statements are sublinear TF-IDF vectors with the corpus
idf, L2-normalised over in-vocabulary terms; score(q, d) = sum_t wq(t) * wd(t).

Exact max-score plan (no all-pairs join on common terms):
  1. each statement's rarest terms give a first set of documents, scored exactly; the best
     score is a lower bound L(q);
  2. a term adds at most wq(t) * max_d wd(t). Terms in rising order of that bound are non-essential as long
     as their sum stays below L(q): a document with such terms only cannot win;
  3. documents with an essential term are the candidates; they are scored exactly, once.
Ties are decided on scores rounded to 9 places; ties on the best score make the
result ambiguous and list the first three documents by id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimspark.functions.text import clean_text, first_sentences
from claimspark.operators.joins import join_checked, spread
from claimspark.operators.tfidf import document_frequencies, idf_expr, term_frequencies
from claimspark.schema import AMBIGUOUS_PREFIX, NO_RESULTS
from claimspark.session import materialize

SCORE_DECIMALS = 9


def _normalise(w: DataFrame, key: str) -> DataFrame:
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))
    return w.withColumn("w", F.col("w") / norm)


def _terms_of(df: DataFrame, id_col: str, text_col: str, key: str) -> DataFrame:
    raw = spread(df.select(F.col(id_col).alias(key), F.col(text_col).alias("t")), key)
    return term_frequencies(raw.select(key, clean_text(F.col("t")).alias("t")), key, "t", 1)


def corpus_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text"):
    """(postings(doc, term, w), terms(term, df, idf), n_docs) for a document table; postings stay a plan."""
    n_docs = docs.count()  # from the scan (parquet metadata)
    tf = _terms_of(docs, id_col, text_col, "doc")
    terms = materialize(document_frequencies(tf).withColumn("idf", idf_expr(F.col("df"), n_docs)))
    joined = join_checked(tf, terms.select("term", "idf"), "term", "inner")
    postings = _normalise(joined.select(
        "doc", "term", ((F.lit(1.0) + F.log(F.col("tf").cast("double"))) * F.col("idf")).alias("w")),
        "doc")
    return postings, terms, n_docs


def query_terms(queries: DataFrame, terms: DataFrame, id_col: str = "item_id",
                text_col: str = "text") -> DataFrame:
    """(q, term, w, df): statement vectors over the corpus vocabulary."""
    tf = _terms_of(queries, id_col, text_col, "q")
    joined = join_checked(terms.select("term", "idf", "df"), tf, "term", "inner")
    w = joined.select("q", "term", "df",
                      ((F.lit(1.0) + F.log(F.col("tf").cast("double"))) * F.col("idf")).alias("w"))
    return materialize(_normalise(w, "q"))


def all_pair_scores(qt: DataFrame, postings: DataFrame) -> DataFrame:
    """sum_t wq * wd for every statement and document that share a term (the plain definition)."""
    joined = join_checked(postings.select("doc", "term", F.col("w").alias("wd")),
                          qt.select("q", "term", F.col("w").alias("wq")), "term", "inner")
    return joined.groupBy("q", "doc").agg(F.sum(F.col("wq") * F.col("wd")).alias("score"))


def _score_pairs(pairs: DataFrame, qt: DataFrame, postings: DataFrame) -> DataFrame:
    """Exact scores of given (q, doc) pairs: their statement terms joined to postings on (doc, term)."""
    asked = join_checked(pairs, qt.select("q", "term", F.col("w").alias("wq")), "q", "inner")
    return (asked.join(postings.select("doc", "term", F.col("w").alias("wd")), ["doc", "term"])
            .groupBy("q", "doc").agg(F.sum(F.col("wq") * F.col("wd")).alias("score")))


def candidate_pairs(qt: DataFrame, postings: DataFrame, seed_terms: int = 3) -> DataFrame:
    """(q, doc) pairs that can hold a statement's best score; windows run over one statement's terms.

    The documents of its rarest terms give a statement a lower bound. Terms that cannot reach it together are left out; the
    others are summed for each document, and the pair stays where this sum and the most that the rest can add reach the bound.
    """
    by_df = Window.partitionBy("q").orderBy("df", "term")
    seeds = qt.withColumn("n", F.row_number().over(by_df)).where(F.col("n") <= seed_terms).select("q", "term")
    first = join_checked(postings.select("doc", "term"), seeds, "term").select("q", "doc").distinct()
    lower = _score_pairs(first, qt, postings).groupBy("q").agg(F.max("score").alias("lower"))
    most = postings.groupBy("term").agg(F.max("w").alias("max_w"))
    bounds = (qt.join(most, "term").join(lower, "q", "left")
              .withColumn("most", F.col("w") * F.col("max_w"))
              .withColumn("lower", F.coalesce("lower", F.lit(0.0)) - 10.0 ** -SCORE_DECIMALS))
    rising = Window.partitionBy("q").orderBy("most", "term").rowsBetween(Window.unboundedPreceding, 0)
    reach = bounds.withColumn("reach", F.sum("most").over(rising)).withColumn("leads", F.col("reach") >= F.col("lower"))
    needed = F.col("lower") - F.coalesce(F.sum(F.when(~F.col("leads"), F.col("most"))).over(Window.partitionBy("q")), F.lit(0.0))
    essential = reach.withColumn("needed", needed).where("leads").select("q", "term", F.col("w").alias("wq"), "needed")
    partly = join_checked(postings.select("doc", "term", F.col("w").alias("wd")), essential, "term")
    sums = partly.groupBy("q", "doc").agg(F.sum(F.col("wq") * F.col("wd")).alias("part"), F.first("needed").alias("needed"))
    return sums.where(F.col("part") >= F.col("needed") - 10.0 ** -SCORE_DECIMALS).select("q", "doc")


def retrieval_scores(queries: DataFrame, docs: DataFrame, q_id: str, q_text: str, d_id: str, d_text: str,
                     seed_terms: int | None = 3) -> DataFrame:
    """(q, doc, r): rounded scores of every document that can be a statement's best match, kept; None: of all pairs."""
    postings, terms, _ = corpus_index(docs, d_id, d_text)
    qt = query_terms(queries, terms, q_id, q_text)
    # only the statements' own terms matter from here on
    own = materialize(join_checked(postings, qt.select("term").distinct(), "term", "left_semi"))
    scores = (all_pair_scores(qt, own) if seed_terms is None
              else _score_pairs(candidate_pairs(qt, own, seed_terms), qt, own))
    return materialize(scores.withColumn("r", F.round("score", SCORE_DECIMALS)))


def best_evidence(queries: DataFrame, docs: DataFrame, q_id: str = "item_id", q_text: str = "text",
                  d_id: str = "doc_id", d_text: str = "text", sentences: int = 3,
                  seed_terms: int | None = 3, candidates_shown: int = 3, scores: DataFrame | None = None) -> DataFrame:
    """JN-3 + WIN-2 + PRJ-21: per statement, the best document and its first sentences.

    `seed_terms` rarest terms give the first lower bound (None scores all pairs); results do not depend on it.
    `scores` (q, doc, r) come from a stored index (`evidence_index.search`) instead, where given.

    Output: q_id, best_doc_id (null unless one clear winner), best_score, n_best (documents
    tied on the best score), evidence (summary, ambiguity message, or no-result message).
    """
    if scores is None:
        scores = retrieval_scores(queries, docs, q_id, q_text, d_id, d_text, seed_terms)
    top = scores.groupBy("q").agg(F.max("r").alias("r"))
    tied = join_checked(scores, top, ["q", "r"], "inner")  # only documents on the best score
    w = Window.partitionBy("q").orderBy("doc")
    shown = (tied.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= candidates_shown)
             .groupBy("q").agg(F.array_sort(F.collect_list("doc")).alias("shown")))
    summary = tied.groupBy("q").agg(F.count(F.lit(1)).alias("n_best"), F.min("doc").alias("first_doc"),
                                    F.max("r").alias("best_score"))
    per_q = materialize(summary.join(shown, "q", "inner"))
    # the few winning documents are looked up in the corpus, whose texts stay where they are
    winners = per_q.where("n_best = 1").select(F.col("first_doc").alias(d_id)).distinct()
    texts = join_checked(docs.select(d_id, d_text), winners, d_id, "inner").select(
        F.col(d_id).alias("first_doc"), F.col(d_text).alias("doc_text"))
    per_q = per_q.join(texts, "first_doc", "left")
    out = queries.select(F.col(q_id).alias("q")).join(per_q, "q", "left")
    evidence = (F.when(F.col("n_best").isNull(), F.lit(NO_RESULTS))
                .when(F.col("n_best") > 1, F.concat(
                    F.lit(AMBIGUOUS_PREFIX), F.lit("["),
                    F.array_join(F.transform("shown", lambda x: x.cast("string")), ", "), F.lit("]")))
                .otherwise(first_sentences(F.col("doc_text"), sentences)))
    return out.select(
        F.col("q").alias(q_id),
        F.when(F.col("n_best") == 1, F.col("first_doc")).alias("best_doc_id"),
        F.col("best_score"),
        F.coalesce(F.col("n_best"), F.lit(0)).cast("bigint").alias("n_best"),
        evidence.alias("evidence"))


# -- PRJ-18/19/20: prompts and verdicts --------------------------------------

STYLE_SENTENCE = "Writing style: %s (confidence %.2f%%)."


def classifier_sentence(label_col: str = "pred_label", conf_col: str = "pred_confidence"):
    """'Writing style: REAL (confidence 94.12%).'"""
    return F.format_string(STYLE_SENTENCE,
                           F.col(label_col), F.col(conf_col).cast("double") * 100)


# Prompt layout: statement, the two evidence lines, and the verdict instruction.
PROMPT_TEMPLATE = (
    "Decide whether a claim holds up, and say briefly why.\n"
    "Statement: \"%s\"\n"
    "Style check: %s\n"
    "Corpus search: %s\n"
    "Trust the corpus over the style check wherever the two disagree.\n"
    "End with \"FINAL VERDICT: [TRUE/FALSE/UNVERIFIED]\"")


def prompt_column(statement_col: str, evidence1_col: str, evidence2_col: str):
    return F.format_string(PROMPT_TEMPLATE, F.col(statement_col), F.col(evidence1_col),
                           F.col(evidence2_col))


VERDICT_PATTERN = "(?i)FINAL VERDICT:\\s*\\[?(TRUE|FALSE|UNVERIFIED)"


def parse_verdict(response_col: str):
    """PRJ-20: TRUE / FALSE / UNVERIFIED from a response; no verdict -> UNVERIFIED."""
    v = F.upper(F.regexp_extract(F.coalesce(F.col(response_col), F.lit("")), VERDICT_PATTERN, 1))
    return F.when(v == "", F.lit("UNVERIFIED")).otherwise(v)


def fact_check_records(statements: DataFrame, scored: DataFrame, evidence: DataFrame, responses: DataFrame,
                       id_col: str = "item_id", text_col: str = "text", prediction_col: str = "prediction",
                       response_col: str = "response") -> DataFrame:
    """PIPE-6: one record per statement: statement, nested prediction, search evidence, prompt, response and verdict.

    `scored` has the nested prediction, `evidence` the evidence text, `responses` the answers to the prompts (a
    statement without one is UNVERIFIED), each keyed by `id_col`.
    """
    p = F.col(prediction_col)
    out = (statements.select(id_col, F.col(text_col).alias("statement"))
           .join(scored.select(id_col, p), id_col).join(evidence.select(id_col, F.col("evidence").alias("search_evidence")), id_col)
           .join(responses.select(id_col, F.col(response_col).alias("response")), id_col, "left")
           .withColumn("classifier_evidence", F.format_string(
               STYLE_SENTENCE, p["label"], p["confidence"].cast("double") * 100)))
    return out.select(id_col, "statement", prediction_col, "search_evidence",
                      prompt_column("statement", "classifier_evidence", "search_evidence").alias("prompt"),
                      "response", parse_verdict("response").alias("agent_decision"))
