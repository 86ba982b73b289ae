"""TF-IDF, vocabulary, vectors, exact bucketed ranks and stratified folds vs brute force."""

import math
import random
import re
from collections import Counter

import pytest

from claimspark.operators import folds as FO
from claimspark.operators import tfidf as TF

DOCS = ["the cat sat on the mat", "the dog sat", "a b c", "", "cat cat cat dog", "mat mat the"]


def py_tokens(t):
    return re.findall(r"\b\w\w+\b", t.lower())


def py_ngrams(tok, n_max):
    return tok + ([f"{a} {b}" for a, b in zip(tok, tok[1:])] if n_max == 2 else [])


def py_tfidf(docs, n_max=1, max_features=None, sublinear=True):
    tfs = [Counter(py_ngrams(py_tokens(d), n_max)) for d in docs]
    n = len(docs)
    df = Counter(t for c in tfs for t in c)
    corpus = Counter()
    for c in tfs:
        corpus.update(c)
    vocab = sorted(df)
    if max_features is not None:
        vocab = sorted(sorted(df, key=lambda t: (-corpus[t], t))[:max_features])
    out = {}
    for i, c in enumerate(tfs):
        w = {t: ((1 + math.log(v)) if sublinear else v) * (math.log((1 + n) / (1 + df[t])) + 1)
             for t, v in c.items() if t in vocab}
        norm = math.sqrt(sum(x * x for x in w.values()))
        for t, x in w.items():
            out[(i, t)] = x / norm
    return out, vocab


@pytest.fixture()
def docs(spark):
    return spark.createDataFrame(list(enumerate(DOCS)), "id int, statement_clean string")


@pytest.mark.parametrize("n_max,max_features", [(1, None), (2, None), (1, 3), (2, 4)])
def test_tfidf_matches_python(spark, docs, n_max, max_features):
    got = TF.tfidf_long(docs, ngram_max=n_max, max_features=max_features).collect()
    exp, vocab = py_tfidf(DOCS, n_max, max_features)
    assert {(r["id"], r["term"]): r["weight"] for r in got} == pytest.approx(exp)
    if max_features is not None:
        v = TF.vocabulary(TF.term_frequencies(docs, ngram_max=n_max), len(DOCS), max_features).collect()
        assert sorted(r["term"] for r in v) == vocab
        assert sorted(r["idx"] for r in v) == list(range(len(vocab)))
        assert [r["term"] for r in sorted(v, key=lambda r: r["idx"])] == vocab


def test_term_in_every_document_keeps_weight(spark):
    df = spark.createDataFrame([(0, "aa bb"), (1, "aa cc")], "id int, statement_clean string")
    w = {(r["id"], r["term"]): r for r in TF.tfidf_long(df, normalize=False).collect()}
    assert w[(0, "aa")]["idf"] == pytest.approx(1.0)  # smoothed idf: ln(3/3) + 1


def py_stratified_folds(labels, k):
    """Unshuffled stratified k-fold assignment written directly from its definition."""
    classes = sorted(set(labels))
    order = sorted(labels)
    folds = [None] * len(labels)
    for c in classes:
        start = order.index(c)
        n_c = order.count(c)
        sizes = [sum(1 for j in range(start, start + n_c) if j % k == i) for i in range(k)]
        assignment = [f for f, s in enumerate(sizes) for _ in range(s)]
        positions = [i for i, lab in enumerate(labels) if lab == c]
        for pos, f in zip(positions, assignment):
            folds[pos] = f
    return folds


@pytest.mark.parametrize("seed,k,bucket", [(1, 5, 1), (2, 3, 7), (3, 5, 14)])
def test_stratified_folds_match_definition(spark, seed, k, bucket):
    rng = random.Random(seed)
    labels = [rng.choice([0, 0, 0, 1, 2]) for _ in range(57)]
    ids = rng.sample(range(10_000), len(labels))
    order = sorted(range(len(labels)), key=lambda i: ids[i])
    in_order = [labels[i] for i in order]
    exp = py_stratified_folds(in_order, k)
    df = spark.createDataFrame([(ids[i], labels[i]) for i in range(len(labels))], "id int, label int")
    got = {r["id"]: r["fold"] for r in FO.stratified_folds(df, "label", "id", k, buckets=bucket).collect()}
    assert [got[ids[i]] for i in order] == exp


def test_rank_within_many_buckets(spark):
    rng = random.Random(5)
    data = [(i, rng.choice("ab"), rng.random()) for i in range(200)]
    df = spark.createDataFrame(data, "id int, g string, key double")
    got = {r["id"]: r["rank0"] for r in FO.rank_within(df, ["g"], "key", buckets=9).collect()}
    for g in "ab":
        ordered = sorted((k, i) for i, gg, k in data if gg == g)
        assert [got[i] for _, i in ordered] == list(range(len(ordered)))


def test_bounded_vocabulary_is_broadcast(spark, docs):
    out = TF.tfidf_long(docs, max_features=3)
    assert "BroadcastHashJoin" in out._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("kind", ["int", "string", "name"])
def test_folds_do_not_depend_on_the_buckets(spark, kind):
    rng = random.Random(8)
    ids = rng.sample(range(10_000), 100)
    shown = {"int": ids, "string": [str(i) for i in ids], "name": [f"{i}.json" for i in ids]}[kind]
    df = spark.createDataFrame([(k, rng.choice([0, 1, 1])) for k in shown], f"id {'int' if kind == 'int' else 'string'}, label int")
    got = [sorted(map(tuple, FO.stratified_folds(df, "label", "id", 5, buckets=b).collect())) for b in (1, 3, 10, None)]
    assert got[0] == got[1] == got[2] == got[3]
    ranks = {r["id"]: r["rank0"] for r in FO.rank_within(df, ["label"], "id", buckets=7).collect()}
    labels = {r["id"]: r["label"] for r in df.collect()}
    for c in (0, 1):
        own = sorted(i for i in labels if labels[i] == c)  # the order of the column's own type
        assert [ranks[i] for i in own] == list(range(len(own)))


def test_texts_move_once_and_term_counts_stay(spark, docs):
    from claimspark.operators.tfidf import term_frequencies
    plan = term_frequencies(docs, ngram_max=2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Exchange hashpartitioning(id" in plan and "Python" not in plan
