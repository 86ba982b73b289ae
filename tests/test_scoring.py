"""Prediction shaping, batch and Python scorers, streaming = batch, sequence encoding."""

import numpy as np
from pyspark.sql import functions as F

from claimspark.operators import scoring as S
from claimspark.operators import sequences as SQ
from claimspark.session import scratch_path
from claimspark.streaming import score_stream as ST
from tests.conftest import SF_SMALL


def test_tie_goes_to_fake_and_rounding(spark):
    df = spark.createDataFrame([(0.0,), (2.0,), (-1.0,)], "z double")
    got = S.score_with_rule(df, F.col("z"), nested=True).collect()
    assert got[0]["pred_label"] == "FAKE" and got[0]["prob_real"] == 0.5 and got[0]["pred_label_id"] == 0
    assert got[1]["pred_label"] == "REAL" and got[1]["pred_confidence"] == round(1 / (1 + np.exp(-2.0)), 4)
    assert got[1]["prediction"]["probabilities"]["REAL"] == got[1]["prob_real"]
    assert got[2]["pred_label_id"] == 0


def test_batch_score_keeps_missing_text(spark):
    df = spark.createDataFrame([(1, None), (2, "FAKE NEWS EVERYWHERE")], "id int, statement string")
    out = {r["id"]: r for r in S.batch_score(df).collect()}
    assert len(out) == 2 and out[1]["pred_label"] == "REAL" and out[2]["pred_label"] == "FAKE"
    assert out[1]["version"] == S.DEFAULT_MODEL_VERSION


def test_python_scorer_equals_jvm_rule(spark):
    raw = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select(
        F.col("doc_id").alias("id"), F.col("text").alias("statement"))
    a = {r["id"]: tuple(r[c] for c in S.FLAT_PREDICTION_COLUMNS) for r in S.batch_score(raw).collect()}
    b = {r["id"]: tuple(r[c] for c in S.FLAT_PREDICTION_COLUMNS)
         for r in S.score_in_pandas(raw, S.python_text_rule).collect()}
    assert a == b


def test_stream_equals_batch(spark):
    schema = spark.read.parquet(f"{SF_SMALL}/documents.parquet").schema
    req = ST.request_stream(spark, SF_SMALL, schema, glob="documents.parquet")
    out, ck = scratch_path(spark, "t-stream"), scratch_path(spark, "t-ckpt")
    ST.start_scoring(ST.score_requests(req, "doc_id", "text"), out, ck).awaitTermination()
    streamed = {tuple(r) for r in spark.read.parquet(out).collect()}
    batch = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    batched = {tuple(r) for r in ST.score_requests(batch, "doc_id", "text").collect()}
    assert streamed == batched and len(streamed) == batch.count()


def test_sequence_encoding(spark):
    corpus = spark.createDataFrame([(1, "aa bb cc"), (2, ""), (3, " ".join(["zz"] * 10)), (4, None)],
                                   "id int, statement_clean string")
    vocab = SQ.token_vocabulary(corpus.where(F.col("id") != 3), "id", "statement_clean", 2)
    enc = {r["id"]: r for r in SQ.encode(corpus, vocab, max_length=6).collect()}
    assert all(len(r["input_ids"]) == 6 and len(r["attention_mask"]) == 6 for r in enc.values())
    assert enc[2]["input_ids"] == [0, 2, 1, 1, 1, 1] and enc[2]["attention_mask"] == [1, 1, 0, 0, 0, 0]
    assert enc[3]["input_ids"] == [0, 3, 3, 3, 3, 2]       # truncated, unknown token id 3
    assert enc[1]["input_ids"][:2] == [0, 4] and enc[1]["n_tokens"] == 3
    assert enc[4]["n_tokens"] == 0


def test_score_csv_table_and_write_predictions(spark):
    from claimspark.plans import queries as Q
    from claimspark.sources.processed import read_for_scoring, write_processed, write_table

    path = write_processed(Q.q_feature_table(spark, SF_SMALL), scratch_path(spark, "t-csv"), fmt="csv")
    table = read_for_scoring(spark, path, fmt="csv")
    scored = S.batch_score(table, text_col="statement_clean")
    assert scored.count() == Q.q_feature_table(spark, SF_SMALL).count()
    out = write_table(scored.select("id", *S.FLAT_PREDICTION_COLUMNS), scratch_path(spark, "t-pred"), "csv")
    back = spark.read.option("header", True).csv(out)
    assert set(back.columns) == {"id", *S.FLAT_PREDICTION_COLUMNS}


def test_sequence_encoding_with_labels(spark):
    corpus = spark.createDataFrame([(1, "aa bb", 1), (2, "cc", 0)], "id int, statement_clean string, y int")
    vocab = SQ.token_vocabulary(corpus, "id", "statement_clean", 10)
    enc = {r["id"]: r for r in SQ.encode(corpus, vocab, max_length=4, label_col="y").collect()}
    assert enc[1]["labels"] == 1 and enc[2]["labels"] == 0
    assert enc[1]["input_ids"] == [0, 4, 5, 2] and enc[2]["input_ids"] == [0, 6, 2, 1]


def factory(value):
    def make_predict():
        return lambda texts: np.array([[1 - value, value]] * len(texts))
    return make_predict


def test_worker_cache_tells_models_apart(spark):
    df = spark.createDataFrame([(1, "a")], "id int, statement string")
    got = [S.score_in_pandas(df, factory(v)).first()["prob_real"] for v in (0.9, 0.2, 0.9)]
    assert got == [0.9, 0.2, 0.9]


def test_certain_probabilities_keep_their_class(spark):
    df = spark.createDataFrame([(1, "a")], "id int, statement string")
    for value, name in ((1.0, "REAL"), (0.0, "FAKE")):
        r = S.score_in_pandas(df, factory(value)).first()
        assert (r["pred_label"], r["pred_confidence"], r["prob_real"], r["prob_fake"]) == (name, 1.0, value, 1 - value)


def test_only_the_text_crosses_to_python(spark):
    df = spark.createDataFrame([(1, "a", "wide")], "id int, statement string, other string")
    plan = S.score_in_pandas(df, factory(0.5))._jdf.queryExecution().executedPlan().toString()
    udf = [line for line in plan.splitlines() if "ArrowEvalPython" in line]
    assert udf and all("other" not in line.split("],")[0] for line in udf)


def test_a_table_of_one_or_many_files_is_streamed_whole(spark):
    """A folder of part files gave an empty stream: the name pattern was matched against its parts."""
    from claimspark.plans import queries as Q

    root = scratch_path(spark, "t-tables")
    docs = spark.createDataFrame([(i, f"Text number {i}") for i in range(20)] + [(20, None)], "doc_id long, text string")
    docs.repartition(3).write.parquet(f"{root}/documents.parquet")
    assert sorted(r["doc_id"] for r in Q.q_stream_score(spark, root).collect()) == list(range(21))
    one = scratch_path(spark, "t-file")
    docs.coalesce(1).write.parquet(one)
    (part,) = [f for f in spark.read.parquet(one).inputFiles()]
    out, ck = scratch_path(spark, "t-out"), scratch_path(spark, "t-ck")
    requests = ST.table_stream(spark, part, docs.schema)
    ST.start_scoring(ST.score_requests(requests, "doc_id", "text"), out, ck).awaitTermination()
    assert spark.read.parquet(out).count() == 21
