"""Learned sentence ends: statistics by brute force, abbreviations and initials end no sentence."""

import math
import re
from collections import Counter

from claimspark.operators import sentences as SE
from tests.conftest import SF_SMALL

TEXTS = ["Dr. Smith met Dr. Jones. They spoke.", "The U.S. economy grew. The U.S. dollar fell!", "Prof. Dr. Miller (of the U.S.) left. He said \"no.\"",
         "Approx. five people came, approx. six left.", "They came. He left. We spoke. The people left.", "J. R. Hill won. End", None, "", " ... ",
         "We say approx. ten, approx. two or approx. one."] * 3
TEXTS += ["He left and no one spoke of it when they won and fell here and jones said no ten times to one of the six"] * 6


def brute(texts):
    period, plain, lower = Counter(), Counter(), Counter()
    for t in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        for w, nxt in zip(words, [*words[1:], ""]):
            base = "".join(c.lower() if "A" <= c <= "Z" else c for c in w.strip("\"'()[]{}")).rstrip(",;:!?")
            kind = base.rstrip(".")
            if not kind:
                continue
            (period if base.endswith(".") else plain)[kind] += 1
            if base.endswith(".") and nxt.strip("\"'()[]{}")[:1].islower():
                lower[kind] += 1
    share = sum(period.values()) / (sum(period.values()) + sum(plain.values()))
    out = {}
    for kind in period.keys() | plain.keys():
        a, b, inner = period[kind], plain[kind], kind.count(".")
        n = len(kind) - inner
        ratio = 2 * (a * math.log(.99 / share) + b * math.log(.01 / (1 - share)))
        score = ratio * math.exp(-n) * (inner + 1) * n ** -b if a and n else 0.0
        out[kind] = (a, b, lower[kind], round(score, 6), score >= .3 or (lower[kind] >= 5 and 2 * lower[kind] > a))
    return out


def frame(spark, texts=TEXTS):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")


def test_statistics_match_brute_force(spark):
    got = {r["type"]: (r["n_period"], r["n_plain"], r["n_lower"], round(r["score"], 6), r["abbreviation"])
           for r in SE.period_statistics(frame(spark)).collect()}
    assert got == brute(TEXTS)
    assert {k for k, v in got.items() if v[4]} >= {"dr", "u.s", "approx"} and not got["left"][4] and not got["spoke"][4]
    assert SE.period_statistics(frame(spark, [])).isEmpty()


def test_statistics_of_the_tables(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    got = {r["type"]: (r["n_period"], r["n_plain"], r["n_lower"]) for r in SE.period_statistics(docs).collect()}
    assert got == {k: v[:3] for k, v in brute([r["text"] for r in docs.select("text").collect()]).items()}


def test_abbreviations_end_no_sentence(spark):
    docs = frame(spark)
    known = SE.abbreviations(docs)
    got = {r["doc_id"]: r["sentences"] for r in SE.leading_sentences(docs, known, "doc_id", "text", 1).collect()}
    assert got[0] == "Dr. Smith met Dr. Jones." and got[1] == "The U.S. economy grew." and got[5] == "J. R. Hill won."
    assert got[3] == "Approx. five people came, approx. six left."
    two = {r["doc_id"]: r["sentences"] for r in SE.leading_sentences(docs, known, "doc_id", "text", 2).collect()}
    assert two[4] == "They came. He left." and two[5] == TEXTS[5] and two[7] == ""
    counts = {r["doc_id"]: (r["n_words"], r["n_sentences"]) for r in SE.sentence_counts(docs, known).collect()}
    assert counts[0] == (7, 2) and counts[1] == (8, 2) and counts[5] == (5, 2) and counts[6] == counts[7] == (0, 0) and len(counts) == len(TEXTS)
