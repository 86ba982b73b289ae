"""The blocked solver against dense numpy solutions, and the map-side vectors against the long form."""

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from claimspark.operators import tfidf as TF
from claimspark.operators import vectorize as V
from claimspark.operators.folds import stratified_folds
from claimspark.plans import models as MD
from claimspark.plans import solver as S

WORDS = "tax jobs crime vote border health school budget war climate energy court".split()


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(7)
    rows = []
    for i in range(120):
        lean = rng.random() < 0.5
        words = [WORDS[int(rng.integers(0, 8)) + (4 if lean else 0)] for _ in range(int(rng.integers(0, 12)))]
        rows.append((i, " ".join(words), int(lean if rng.random() < 0.85 else not lean)))
    return rows


@pytest.fixture(scope="module")
def claims(spark, texts):
    return spark.createDataFrame(texts, "id int, statement_clean string, label_binary int")


def dense(rows, ngram_max, max_features, train):
    """(vectors of all rows, terms) of a vocabulary and idf fitted on the rows of `train`."""
    def terms(t):
        tok = t.split()
        return tok + ([f"{a} {b}" for a, b in zip(tok, tok[1:])] if ngram_max == 2 else [])

    tf, df = {}, {}
    for i in train:
        for t in terms(rows[i][1]):
            tf[t] = tf.get(t, 0) + 1
        for t in set(terms(rows[i][1])):
            df[t] = df.get(t, 0) + 1
    vocab = sorted(sorted(tf, key=lambda t: (-tf[t], t))[:max_features])
    x = np.zeros((len(rows), len(vocab)))
    for i, r in enumerate(rows):
        own = terms(r[1])
        for j, t in enumerate(vocab):
            if t in own:
                x[i, j] = (1 + np.log(own.count(t))) * (np.log((1 + len(train)) / (1 + df[t])) + 1)
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm == 0, 1, norm), vocab


def solve(x, y, kind, C):
    """Newton's method with halving on the dense problem, to a gradient of 1e-12."""
    a = np.hstack([x, np.ones((len(x), 1))])
    s, pen = 2.0 * y - 1, np.ones(a.shape[1])
    if kind == "lr":
        pen[-1] = 0
    w = np.zeros(a.shape[1])

    def value(w):
        m = s * (a @ w)
        loss = np.logaddexp(0, -m) if kind == "lr" else np.maximum(1 - m, 0) ** 2
        return 0.5 * w @ (pen * w) + C * loss.sum()

    for _ in range(200):
        m = s * (a @ w)
        if kind == "lr":
            q = 1 / (1 + np.exp(m))
            g, h = pen * w - C * a.T @ (s * q), q * (1 - q)
        else:
            gap = np.maximum(1 - m, 0)
            g, h = pen * w - 2 * C * a.T @ (s * gap), 2.0 * (gap > 0)
        if np.linalg.norm(g) < 1e-11:
            break
        step = np.linalg.solve(np.diag(pen) + C * (a.T * h) @ a + 1e-13 * np.eye(len(w)), g)
        t = 1.0
        while value(w - t * step) > value(w) and t > 1e-8:
            t /= 2
        w = w - t * step
    return w, value(w)


def macro(y, p):
    out = []
    for c in (0, 1):
        hit, said, true = ((y == c) & (p == c)).sum(), (p == c).sum(), (y == c).sum()
        if said + true:
            out.append(2 * hit / (said + true))
    return float(np.mean(out))


@pytest.mark.parametrize("kind, C", [("lr", 0.1), ("lr", 10.0), ("svm", 0.01), ("svm", 1.0)])
def test_weights_equal_a_dense_solution(claims, texts, kind, C):
    clf = MD.TfidfClassifier(MD.Params(kind, 2, 30, True, C, 500, 1e-10)).fit(claims)
    x, vocab = dense(texts, 2, 30, range(len(texts)))
    y = np.array([r[2] for r in texts])
    w, best = solve(x, y, kind, C)
    assert clf.pipeline.stages[1].vocabulary == vocab
    assert clf.settled and clf.fitted.gradient < 1e-9
    np.testing.assert_allclose(np.append(clf.fitted.weights, clf.fitted.bias), w, atol=1e-6)
    assert clf.fitted.objective == pytest.approx(best, rel=1e-9)
    np.testing.assert_allclose(clf.model.coefficients.toArray(), w[:-1], atol=1e-6)


def test_all_folds_and_penalties_equal_separate_fits(spark, claims, texts):
    grid = [MD.Params(k, n, m, True, C, 500, 1e-9) for k in ("lr", "svm") for n in (1, 2) for m in (6, 40) for C in (0.1, 1.0)]
    res = MD.grid_search(claims, grid, folds=3, refit=False, check=True)
    folds = {r["id"]: r["fold"] for r in stratified_folds(claims, "label_binary", "id", 3).collect()}
    y = np.array([r[2] for r in texts])
    for r in res.results:
        for f in range(3):
            train = [i for i in range(len(texts)) if folds[i] != f]
            held = [i for i in range(len(texts)) if folds[i] == f]
            x, _ = dense(texts, r["ngram_max"], r["max_features"], train)
            w, _ = solve(x[train], y[train], r["kind"], r["C"])
            want = macro(y[held], (x[held] @ w[:-1] + w[-1] > 0).astype(int))
            assert r["fold_scores"][f] == pytest.approx(want, abs=1e-6)
        assert all(r["settled"])


def test_small_blocks_and_many_tasks_give_the_same_fit(claims, monkeypatch):
    p = MD.Params("svm", 2, 30, True, 1.0, 500, 1e-10)
    one = MD.TfidfClassifier(p).fit(claims).fitted
    monkeypatch.setattr(S, "ROWS_PER_TASK", 5)
    monkeypatch.setattr(S, "DIRECT_TASKS", 2)
    monkeypatch.setattr(S, "BLOCK_ENTRIES", 9)
    many = MD.TfidfClassifier(p).fit(claims.repartition(30)).fitted
    np.testing.assert_allclose(one.weights, many.weights, atol=1e-8)


def test_blocks_hold_any_rows():
    indptr = np.array([0, 0, 2, 2, 5, 5])
    got = S.row_sums(indptr, np.arange(10.0).reshape(5, 2).T)
    assert got.T.tolist() == [[0, 0], [2, 4], [0, 0], [18, 21], [0, 0]]


def test_macro_f1_counts():
    assert S.macro_f1(np.array([3, 1, 2, 4])) == pytest.approx((2 * 3 / 9 + 2 * 4 / 11) / 2)
    assert S.macro_f1(np.array([5, 0, 0, 0])) == 1.0 and S.macro_f1(np.zeros(4)) == 0.0
    assert S.macro_f1(np.array([0, 0, 3, 0])) == 0.0


# -- the stages --------------------------------------------------------------------------

def test_vectors_equal_the_long_form_and_need_no_shuffle(spark, claims):
    fitted = MD.TfidfClassifier(MD.Params("lr", 2, 25, True, 1.0, 50)).fit(claims)
    out = PipelineModel(fitted.pipeline.stages[:-1]).transform(claims)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
    got = {(r["id"], i): v for r in out.select("id", vector_to_array("features").alias("x")).collect() for i, v in enumerate(r["x"]) if v}
    long = TF.tfidf_long(claims, ngram_max=2, max_features=25).collect()
    want = {(r["id"], r["idx"]): r["weight"] for r in long}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_plain_counts_without_sublinear(spark, claims):
    stages = V.vector_stages(["jobs", "tax"], np.array([1.0, 2.0]), 1, False, "statement_clean")
    df = spark.createDataFrame([("tax tax jobs",), ("",), ("other",), (None,)], "statement_clean string")
    rows = PipelineModel(stages).transform(df).select(vector_to_array("features").alias("x")).collect()
    assert rows[0]["x"] == pytest.approx(list(np.array([1, 4]) / np.sqrt(17)))
    assert all(r["x"] == [0.0, 0.0] for r in rows[1:])


def test_pipeline_model_round_trip(spark, claims, tmp_path):
    clf = MD.TfidfClassifier(MD.Params("svm", 2, 25, True, 1.0, 100)).fit(claims)
    clf.save(f"{tmp_path}/m")
    clf.save(f"{tmp_path}/m")  # overwrites
    plain = PipelineModel.load(f"{tmp_path}/m")  # the saved folder is an ordinary pipeline
    a = {r["id"]: (r["prediction"], r["score"]) for r in clf.predict(claims).collect()}
    b = {r["id"]: r["prediction"] for r in plain.transform(claims).collect()}
    again = {r["id"]: (r["prediction"], r["score"]) for r in MD.TfidfClassifier.load(spark, f"{tmp_path}/m").predict(claims).collect()}
    assert again == a and {k: int(v) for k, v in b.items()} == {k: v[0] for k, v in a.items()}


def test_clean_text_stage(spark):
    df = spark.createDataFrame([("  A B é! ",), (None,)], "raw string")
    out = V.CleanText(inputCol="raw", outputCol="clean").transform(df)
    assert [r["clean"] for r in out.collect()] == ["a b  !", ""]


def test_no_terms_raise(spark):
    df = spark.createDataFrame([(1, "", 0), (2, "a b", 1)], "id int, statement_clean string, label_binary int")
    with pytest.raises(ValueError, match="empty vocabulary"):
        MD.TfidfClassifier(MD.Params()).fit(df)
    with pytest.raises(ValueError, match="unknown model kind"):
        MD.TfidfClassifier(MD.Params("tree"))


def test_folds_need_not_fit_the_vocabulary_of_all(spark, claims, texts):
    docs = V.NgramTerms(inputCol="statement_clean", outputCol="terms", ngramMax=1).transform(claims).select(
        "terms", (F.col("id") % 2).alias("fold"))
    stats = V.term_statistics(docs, "terms", "fold")
    both, first = V.fold_vocabularies(stats, [None, 0], 5)
    count = {}
    for i, t, _ in texts:
        for w in set(t.split()):
            count.setdefault(w, [0, 0])[i % 2] += 1
    assert len(both) == len(first) == 5
    assert all(df == sum(count[t]) for t, df in both.items()) and all(df == count[t][1] for t, df in first.items())


def test_a_pass_in_parts_is_the_whole_pass_and_never_has_more_tasks_than_cores(claims, monkeypatch):
    """Tasks, each with sums of all columns, grew with the rows: their shuffles filled the disk."""
    import threading

    from pyspark.sql import functions as F

    from claimspark import session

    spark = claims.sparkSession
    monkeypatch.setattr(S, "ROWS_PER_TASK", 1)
    rows = claims.limit(60).repartition(20).select(F.col("label_binary").alias("label"), F.lit(0).alias("fold"), "statement_clean")
    terms = MD.NgramTerms(inputCol="statement_clean", outputCol="terms", ngramMax=1).transform(rows)
    counted = MD.CountVectorizerModel.from_vocabulary(["aa", "bb", "cc"], inputCol="terms", outputCol="counts").transform(terms)
    table = S.feature_table(counted, "counts", "label", "fold", 60, np.ones((3, 1)), [-1], True)
    assert table.tasks <= spark.sparkContext.defaultParallelism
    points = [(S.Column(0, k, 1.0), np.arange(4.0) / (i + 1)) for i, k in enumerate(("lr", "svm", "lr", "svm"))]
    turns = [(c, w, w[::-1].copy()) for c, w in points[:3]]
    whole = S.pass_over(table, points, turns)
    monkeypatch.setattr(S, "PASS_BYTES", 1)
    parts = S.pass_over(table, points, turns)
    np.testing.assert_allclose(np.stack(whole[0]), np.stack(parts[0]), atol=1e-9)
    np.testing.assert_allclose(whole[1], parts[1])
    assert whole[2].tolist() == parts[2].tolist()
    table.close()

    sent = []
    monkeypatch.setattr(session, "_ship", lambda s: (sent.append(1), setattr(s.sparkContext, "_claimspark_shipped", True)))
    monkeypatch.setattr(spark.sparkContext, "_claimspark_shipped", False, raising=False)
    asking = [threading.Thread(target=session.ship_package, args=(spark,)) for _ in range(8)]
    [t.start() for t in asking]
    [t.join() for t in asking]
    assert sent == [1]


def test_stored_numbers_keep_their_values():
    for top in (5, 65535, 65536, 1 << 30):
        n = np.array([0, 3, top])
        assert S._wide(S._narrow(n), 3).tolist() == n.tolist()
    assert S._wide(S._narrow(np.array([], dtype=np.int32)), 0).tolist() == []


def packed(rows, idf, sublinear=True):
    """Blocks of (label, fold, {term: count}) rows."""
    from types import SimpleNamespace

    import pyarrow as pa

    cols = {"indices": [sorted(c) for *_, c in rows], "values": [[float(c[t]) for t in sorted(c)] for *_, c in rows],
            "label": pa.array([r[0] for r in rows], pa.int32()), "fold": pa.array([r[1] for r in rows], pa.int32())}
    batch = pa.RecordBatch.from_arrays([pa.array(v) for v in cols.values()], names=list(cols))
    return list(S._pack(SimpleNamespace(value=idf), sublinear)([batch]))


def test_sums_equal_dense_sums_and_a_block_stores_four_bytes_an_entry():
    """A pass was a third longer on the way to Python, and took the logarithm of every count again."""
    from types import SimpleNamespace

    rng = np.random.default_rng(3)
    rows = [(int(rng.integers(2)), int(rng.integers(3)), {int(t): int(n) for t, n in zip(rng.choice(40, 12, False), rng.integers(1, 9, 12))})
            for _ in range(50)]
    rows += [(1, 0, {}), (0, 1, {3: 5000, 7: 4096}), (1, 2, {39: 1})]
    idf = rng.uniform(0.5, 3, (40, 2))
    blocks = packed(rows, idf)
    entries = sum(len(r[2]) for r in rows)
    parts = [p for b in blocks for p in b.to_pylist()]
    beside = sum(len(p[f]) for p in parts for f in ("indptr", "label", "fold", "norm"))
    assert sum(len(v) for p in parts for v in p.values() if isinstance(v, bytes)) - beside == 4 * entries

    raw = np.zeros((len(rows), 40))
    for i, (*_, c) in enumerate(rows):
        for t, n in c.items():
            raw[i, t] = 1 + np.log(n)
    y = np.array([2.0 * r[0] - 1 for r in rows])
    fold = np.array([r[1] for r in rows])
    points, bias, view, kind = rng.normal(size=(3, 40)), np.array([0.3, -0.2, 0.1]), np.array([1, 0]), np.array([0, 1])
    shared = {"u": np.stack([points[0] * idf[:, 1], points[1] * idf[:, 0], points[2] * idf[:, 0]]), "bias": bias, "view": view,
              "kind": kind, "held": np.array([0, 1]), "evals": 1, "turns": 1, "sublinear": True}
    got = np.frombuffer(next(S._sum_blocks(SimpleNamespace(value=shared))(iter(blocks))).column("sums")[0].as_py())
    x = [raw * idf[:, v] for v in (0, 1)]
    x = [m / np.where(m.any(axis=1), np.linalg.norm(m, axis=1), 1.0)[:, None] for m in x]
    z = x[1] @ points[0] + bias[0]
    slope = -y / (1 + np.exp(y * z)) * (fold != 1)
    gap = 1 - y * (x[0] @ points[1] + bias[1])
    turn = 2.0 * (gap > 0) * (x[0] @ points[2] + bias[2]) * (fold != 0)
    want = [np.append(raw.T @ (slope / np.where(raw.any(axis=1), np.linalg.norm(raw * idf[:, 1], axis=1), 1.0)), slope.sum()),
            np.append(raw.T @ (turn / np.where(raw.any(axis=1), np.linalg.norm(raw * idf[:, 0], axis=1), 1.0)), turn.sum())]
    np.testing.assert_allclose(got[:82].reshape(2, 41), want, atol=1e-9)
    assert got[82] == pytest.approx(float((np.logaddexp(0, -y * z) * (fold != 1)).sum()))
    assert got[83:].sum() == (fold == 1).sum()


def test_a_search_goes_no_further_than_the_fit_asks_for():
    """The last search of a fit went on to a gradient far below its tolerance: a tenth of all passes."""
    state = S._State(S.Column(0, "lr", 1.0, tol=1e-6), 4)
    state.start, state.g, state.w = 1.0, np.full(5, 1e-6), np.zeros(5)
    state._turn()
    assert state.aim >= 0.99e-7
    state.g = np.full(5, 1e-3)
    state._turn()
    assert state.aim < 0.1 * np.linalg.norm(state.g)
