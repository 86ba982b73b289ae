"""Plan shape checks and the driver contract."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from claimspark.plans import queries as Q
from tests.conftest import SF_SMALL


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_feature_plan_stays_in_the_jvm(spark):
    p = plan(Q.q_feature_table(spark, SF_SMALL))
    assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p and "PythonUDF" not in p


def test_label_join_is_broadcast(spark):
    p = plan(Q.q_label_map_join(spark, SF_SMALL))
    assert "BroadcastHashJoin" in p or "BroadcastExchange" in p


def test_scan_prunes_columns(spark):
    df = Q.q_clean_text(spark, SF_SMALL)
    p = df._jdf.queryExecution().executedPlan().toString()
    schemas = [x.split("]")[0] for x in p.split("ReadSchema: ")[1:]]
    docs = [x for x in schemas if "text:string" in x]
    assert docs and all("n_chars" not in x for x in docs)  # unused columns never leave the file


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0 and df.columns == ["split", "level", "value", "n_rows", "rank"]


def test_every_query_has_an_oracle():
    from claimspark.plans.oracle_queries import SQL
    from claimspark.plans.queries import QUERIES

    assert set(QUERIES) == set(SQL)


def test_text_queries_read_documents_only(spark):
    """No label or speaker is looked up, no job runs while the plan is built, and text moves at most once, to fill the cores."""
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("text-plans", "plans")
    names = ("clean_text", "text_features", "tokens", "ngrams", "batch_score_rule")
    for name in names:
        p = plan(E.queries()[name](spark, SF_SMALL))
        assert "quality" not in p and "Join" not in p and p.count("Exchange") <= 1, name
    assert len(tracker.getJobIdsForGroup("text-plans")) <= len(names)  # reading the Parquet schema is a job of its own
    spark.sparkContext.setJobGroup("other", "other")
    p = plan(Q.q_tfidf(spark, SF_SMALL))
    assert "quality" not in p and p.count("Exchange hashpartitioning(term") <= 1


@pytest.mark.parametrize("name", ["class_balance", "missing_audit", "tokens", "verdict_parse"])
def test_small_queries_run(spark, name):
    assert E.queries()[name](spark, SF_SMALL).count() > 0


def test_reference_grids_are_registered():
    assert len(Q.GRIDS["lr"]) == len(Q.GRIDS["svm"]) == 12 and Q.QUERY_FOLDS == 5
    assert {p.max_features for p in Q.GRIDS["lr"]} == {10_000, 50_000}
    assert {p.max_iter for p in Q.GRIDS["lr"] + Q.GRIDS["svm"]} == {1000, 2000}


def test_fold_rows_of_a_search(spark):
    from claimspark.plans import models as MD

    data = Q.trainval(spark, SF_SMALL)
    grid = [MD.Params("lr", 1, 100, True, c, 200, 1e-6) for c in (0.1, 1.0)]
    res = MD.grid_search(data, grid, 3, order_col="id_num", refit=False, check=True)
    rows = res.folds_frame(spark).collect()
    n = data.count()
    assert len(rows) == 6 and all(r["n_train"] + r["n_valid"] == n and r["settled"] for r in rows)
    assert sum(r["n_valid"] for r in rows) == 2 * n


def test_run_pipeline_from_tsv(spark):
    from claimspark.plans.experiment import run_pipeline
    from claimspark.session import scratch_path
    from claimspark.sources.adapter import claims_raw
    from claimspark.sources.tsv import write_splits_tsv

    raw_dir = write_splits_tsv(claims_raw(spark, SF_SMALL), scratch_path(spark, "t-raw"))
    out = scratch_path(spark, "t-processed")
    report = run_pipeline(spark, raw_dir, out, pattern="split={split}")
    labelled = spark.read.parquet(f"{SF_SMALL}/labels.parquet").count()
    assert spark.read.parquet(out).count() == labelled
    assert report.where(F.col("level") == "label_binary").groupBy().sum("n_rows").first()[0] == labelled
    # partition pruning: only the test split is read
    test_only = spark.read.parquet(out).where(F.col("split") == "test")
    assert "PartitionFilters: [isnotnull(split" in test_only._jdf.queryExecution().executedPlan().toString()


def test_experiment_writes_tables(spark):
    from claimspark.plans import models as MD
    from claimspark.plans.experiment import run_baseline_experiment
    from claimspark.session import scratch_path

    data = Q.labelled(spark, SF_SMALL)
    grids = {"lr": [MD.Params("lr", 1, 200, True, 1.0, 20, 1e-4)],
             "svm": [MD.Params("svm", 1, 200, True, 1.0, 20, 1e-4)]}
    res_dir = scratch_path(spark, "t-results")
    summary = run_baseline_experiment(data, grids, folds=2, order_col="id_num", results_dir=res_dir)
    got = {r["model"]: r for r in summary.collect()}
    assert set(got) == {"TF-IDF + LR", "TF-IDF + SVM"}
    assert all(0.0 <= r["f1"] <= 1.0 for r in got.values())
    cmp_rows = spark.read.option("header", True).csv(f"{res_dir}/comparison").collect()
    assert len(cmp_rows) == 2
    errs = spark.read.option("header", True).option("multiLine", True).csv(f"{res_dir}/error_analysis_lr")
    assert errs.count() <= 20 and "true_label" in errs.columns


def test_retrieval_scores_few_pairs_and_leaves_texts_in_place(spark):
    from claimspark.operators import evidence as EV
    from claimspark.sources.tables import read_table

    docs = read_table(spark, SF_SMALL, "documents", "doc_id", "text")
    qs = read_table(spark, SF_SMALL, "benchmark", "item_id", "text")
    postings, terms, _ = EV.corpus_index(docs)
    qt = EV.query_terms(qs, terms)
    few, every = EV.candidate_pairs(qt, postings).count(), EV.all_pair_scores(qt, postings).count()
    assert few < every
    p = plan(EV.best_evidence(qs, docs))
    text_scan = [line for line in p.splitlines() if "Exchange hashpartitioning(doc_id" in line]
    assert not text_scan and "BroadcastHashJoin" in p


def test_hot_speaker_rollup_joined_by_broadcast(spark):
    # one source may hold a third of all rows: its rollup row is broadcast, never shuffled to
    # one task with all of that source's claims
    from claimspark.sources.adapter import claims_raw

    p = plan(claims_raw(spark, SF_SMALL))
    join_lines = [line for line in p.splitlines() if "Join" in line and "source" in line]
    assert join_lines and all("BroadcastHashJoin" in line for line in join_lines)
