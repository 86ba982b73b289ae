"""Evidence retrieval (pruned = unpruned = brute force), prompts and verdict parsing."""

import math
import re
from collections import Counter

import pytest

from claimspark.operators import evidence as EV
from claimspark.schema import AMBIGUOUS_PREFIX, NO_RESULTS
from tests.conftest import SF_SMALL

DOCS = [(10, "Paris is the capital of France. It is big. Many people live there. More text."),
        (11, "Berlin is the capital of Germany."),
        (12, "Berlin is the capital of Germany."),        # exact copy: ties with 11
        (13, "Bananas are yellow fruit.")]
QUERIES = [(1, "Paris, France"), (2, "Berlin capital Germany"), (3, "zzz qqq"),
           (4, "yellow bananas")]


def py_best(docs, queries):
    tok = lambda t: re.findall(r"\b\w\w+\b", t.lower())
    dtf = {d: Counter(tok(t)) for d, t in docs}
    n = len(docs)
    df = Counter(t for c in dtf.values() for t in c)
    idf = {t: math.log((1 + n) / (1 + v)) + 1 for t, v in df.items()}

    def vec(c):
        w = {t: (1 + math.log(v)) * idf[t] for t, v in c.items() if t in idf}
        s = math.sqrt(sum(x * x for x in w.values())) or 1.0
        return {t: x / s for t, x in w.items()}
    dv = {d: vec(c) for d, c in dtf.items()}
    out = {}
    for q, t in queries:
        qv = vec(Counter(tok(t)))
        scores = {d: round(sum(qv[x] * v.get(x, 0.0) for x in qv), 9) for d, v in dv.items()
                  if set(qv) & set(v)}
        if not scores:
            out[q] = (None, 0)
            continue
        best = max(scores.values())
        tied = sorted(d for d, s in scores.items() if s == best)
        out[q] = (tied[0] if len(tied) == 1 else None, len(tied))
    return out


@pytest.mark.parametrize("seeds", [None, 1, 2, 9])
def test_pruned_equals_brute_force(spark, seeds):
    d = spark.createDataFrame(DOCS, "doc_id long, text string")
    q = spark.createDataFrame(QUERIES, "item_id long, text string")
    got = {r["item_id"]: r for r in EV.best_evidence(q, d, seed_terms=seeds).collect()}
    exp = py_best(DOCS, QUERIES)
    assert {k: (v["best_doc_id"], v["n_best"]) for k, v in got.items()} == exp
    assert got[1]["evidence"] == "Paris is the capital of France. It is big. Many people live there."
    assert got[2]["evidence"] == AMBIGUOUS_PREFIX + "[11, 12]"
    assert got[3]["evidence"] == NO_RESULTS


def test_pruned_equals_unpruned_on_driver_data(spark):
    d = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text")
    q = spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").select("item_id", "text")
    a = {tuple(r) for r in EV.best_evidence(q, d).collect()}
    b = {tuple(r) for r in EV.best_evidence(q, d, seed_terms=None).collect()}
    assert a == b and len(a) == q.count()


def test_verdicts(spark):
    df = spark.createDataFrame([("... FINAL VERDICT: [FALSE]",), ("final verdict: true",), ("no idea",), (None,),
                                ("FINAL VERDICT: UNVERIFIED",)], "r string")
    assert [r[0] for r in df.select(EV.parse_verdict("r")).collect()] == [
        "FALSE", "TRUE", "UNVERIFIED", "UNVERIFIED", "UNVERIFIED"]


def test_classifier_sentence_and_prompt(spark):
    df = spark.createDataFrame([("REAL", 0.9412, "S", "E2")], "pred_label string, pred_confidence double, s string, e string")
    out = df.select(EV.classifier_sentence().alias("c")).first()["c"]
    assert out == "Writing style: REAL (confidence 94.12%)."
    p = df.select(EV.prompt_column("s", "pred_label", "e").alias("p")).first()["p"]
    assert 'Statement: "S"' in p and p.endswith('"FINAL VERDICT: [TRUE/FALSE/UNVERIFIED]"')
