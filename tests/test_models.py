"""Classifier wrapper: fit/predict shape, binary output, error before fit, save/load, grid search."""

import tempfile
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from claimspark.plans import models as MD

TEXTS = ["the economy is growing fast", "taxes went down for everyone", "crime rates fell sharply",
         "aliens built the pyramids", "the moon landing was staged", "vaccines contain microchips",
         "jobs report beat forecasts", "the earth is flat and hollow"]
LABELS = [1, 1, 1, 0, 0, 0, 1, 0]


@pytest.fixture()
def data(spark):
    rows = [(i, TEXTS[i % 8], LABELS[i % 8]) for i in range(40)]
    return spark.createDataFrame(rows, "id int, statement_clean string, label_binary int")


PARAMS = MD.Params("lr", 1, 50, True, 1.0, 30, 1e-4)


def test_predict_before_fit_raises(data):
    with pytest.raises(RuntimeError, match="not been trained"):
        MD.TfidfClassifier(PARAMS).predict(data)


@pytest.mark.parametrize("kind", ["lr", "svm"])
def test_fit_predict_binary(spark, data, kind):
    clf = MD.TfidfClassifier(replace(PARAMS, kind=kind)).fit(data)
    out = clf.predict(data)
    assert out.count() == 40
    preds = [r["prediction"] for r in out.collect()]
    assert set(preds) <= {0, 1}
    acc = sum(p == LABELS[r["id"] % 8] for p, r in zip(preds, out.collect())) / 40
    assert acc >= 0.9  # separable repeated texts


def test_save_and_load_same_predictions(spark, data):
    clf = MD.TfidfClassifier(PARAMS).fit(data)
    path = tempfile.mkdtemp(prefix="claimspark-model-", dir="/tmp") + "/lr"
    clf.save(path)
    again = MD.TfidfClassifier.load(spark, path)
    a = {r["id"]: (r["prediction"], round(r["score"], 9)) for r in clf.predict(data).collect()}
    b = {r["id"]: (r["prediction"], round(r["score"], 9)) for r in again.predict(data).collect()}
    assert a == b


def test_param_grid_reference_size():
    lr = MD.param_grid(MD.REFERENCE_GRIDS["lr"], "lr")
    svm = MD.param_grid(MD.REFERENCE_GRIDS["svm"], "svm")
    assert len(lr) == 12 and len(svm) == 12
    assert {p.ngram_max for p in lr} == {1, 2} and {p.C for p in svm} == {0.01, 0.1, 1.0}


def test_grid_search_picks_and_refits(spark, data):
    grid = [replace(PARAMS, C=c) for c in (0.01, 10.0)]
    res = MD.grid_search(data, grid, folds=2, parallelism=2)
    assert len(res.results) == 2 and all(len(r["fold_scores"]) == 2 for r in res.results)
    assert res.best in grid and res.model is not None
    frame = res.to_frame(spark)
    assert frame.count() == 2 and frame.where(F.col("rank_test_score") == 1).count() >= 1


def test_equal_ids_keep_their_own_features(spark, data):
    clf = MD.TfidfClassifier(PARAMS).fit(data)
    twice = spark.createDataFrame([(1, TEXTS[0]), (1, TEXTS[3])], "id int, statement_clean string")
    apart = spark.createDataFrame([(1, TEXTS[0]), (2, TEXTS[3])], "id int, statement_clean string")
    assert sorted(r["score"] for r in clf.predict(twice).collect()) == sorted(r["score"] for r in clf.predict(apart).collect())
    repeated = data.withColumn("id", F.lit(1))
    assert MD.TfidfClassifier(PARAMS).fit(repeated).model.coefficients == clf.model.coefficients


def test_unknown_grid_keys_raise():
    cfg = MD.REFERENCE_GRIDS["lr"]
    with pytest.raises(ValueError, match="penalty"):
        MD.param_grid({**cfg, "classifier": {**cfg["classifier"], "penalty": ["l1"]}}, "lr")
    with pytest.raises(ValueError, match="saga"):
        MD.param_grid({**cfg, "classifier": {**cfg["classifier"], "solver": ["saga"]}}, "lr")
    with pytest.raises(ValueError, match="min_df"):
        MD.param_grid({**cfg, "tfidf": {**cfg["tfidf"], "min_df": [2]}}, "lr")


@pytest.mark.parametrize("kind", ["lr", "svm"])
def test_solver_settles_or_says_so(data, kind):
    done = MD.TfidfClassifier(replace(PARAMS, kind=kind, max_iter=500, tol=1e-8)).fit(data, check=True)
    cut = MD.TfidfClassifier(replace(PARAMS, kind=kind, max_iter=1)).fit(data, check=True)
    assert done.settled is True and cut.settled is False


def test_trained_model_serves_batch_stream_and_python(spark, data, tmp_path):
    from claimspark.operators.scoring import FLAT_PREDICTION_COLUMNS, score_in_pandas
    from claimspark.session import scratch_path
    from claimspark.streaming import score_stream as ST

    path = scratch_path(spark, "t-model")
    MD.TfidfClassifier(replace(PARAMS, ngram_max=2)).fit(data).save(path)
    model = MD.TfidfClassifier.load(spark, path)
    rows = [(i, t) for i, t in enumerate([*TEXTS, None, "", "Café TAXES, the  Earth!", "unseen words only"])]
    requests = spark.createDataFrame(rows, "id int, text string")
    requests.repartition(3).write.parquet(f"{tmp_path}/in")
    flat = ["id", *FLAT_PREDICTION_COLUMNS, "version"]
    batch = sorted(map(tuple, model.predict_flat(requests, "text", "v1").select(*flat).collect()))
    assert len(batch) == len(rows) and {r[-1] for r in batch} == {"v1"}
    assert all(r[1] == ("REAL" if r[2] else "FAKE") and r[3] == max(r[4], r[5]) for r in batch)
    stream = ST.request_stream(spark, f"{tmp_path}/in", requests.schema, max_files_per_trigger=1)
    out = scratch_path(spark, "t-out")
    ST.start_model_scoring(stream, model, "id", "text", out, scratch_path(spark, "t-ck"), "v1").awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(out).select(*flat).collect())) == batch
    scores = ST.model_scores(stream, model, "id", "text", "v1")
    logical = scores._jdf.queryExecution().analyzed().toString()
    assert scores.isStreaming and not any(node in logical for node in ("Join", "Aggregate", "Repartition", "MapInArrow"))
    plan = ST.model_scores(requests, model, "id", "text", "v1")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
    # the checkpoint holds what was read: a restart scores new files only
    requests.where("id < 3").withColumn("id", F.col("id") + 100).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    ck = scratch_path(spark, "t-ck2")
    out2 = scratch_path(spark, "t-out2")
    for _ in range(2):
        ST.start_model_scoring(stream, model, "id", "text", out2, ck, "v1").awaitTermination()
    assert spark.read.parquet(out2).count() == len(batch) + 3
    python = score_in_pandas(requests, model.python_scorer(), "text", "v1")
    for a, b in zip(sorted(map(tuple, python.select(*flat).collect())), batch, strict=True):
        assert (*a[:3], a[-1]) == (*b[:3], b[-1]) and a[3:6] == pytest.approx(b[3:6], abs=2e-4)
    nested = model.predict_flat(requests, "text", "v1", nested=True).first()["prediction"]
    assert set(nested["probabilities"]) == {"FAKE", "REAL"}
