"""Checked broadcast and spread: the plan they choose on each side of the bound."""

from pyspark.sql import functions as F

from claimspark.operators.joins import join_checked, spread


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_join_checked_broadcasts_under_bound(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        big = spark.range(1000).withColumn("k", F.col("id") % 3)
        small = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "k long, v string")
        out = join_checked(big, small, "k", "inner", max_bytes=1000)
        assert "BroadcastHashJoin" in plan(out) and out.count() == 1000
        out2 = join_checked(big, small, "k", "inner", max_bytes=2)
        p2 = plan(out2)
        assert "BroadcastHashJoin" not in p2 and out2.count() == 1000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_spread_only_when_the_scan_is_small(spark):
    narrow = spark.range(100).coalesce(1)
    assert spread(narrow, "id").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8")  # the same bytes now make enough splits
    try:
        assert spread(narrow, "id") is narrow
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_measured_bytes_counts_text_in_utf8(spark):
    from claimspark.operators.joins import ROW_BYTES, measured_bytes

    df = spark.createDataFrame([("é" * 10, 1, [1, 2]), (None, 2, None)], "s string, n long, a array<int>")
    assert measured_bytes(df) == 2 * (ROW_BYTES + 8 + 8) + 20 + len('{"a":[1,2]}') + len("{}")
    assert measured_bytes(df.limit(0)) == 0


def test_tasks_that_take_documents_apart_grow_with_the_table(spark, tmp_path):
    """AQE merged the dealt partitions by their shuffled bytes, so a task's words grew with the table."""
    from claimspark.operators.joins import DEAL_BYTES, deal
    from claimspark.operators.tfidf import term_frequencies

    path = f"{tmp_path}/docs"
    spark.range(40).selectExpr("id", "repeat(sha2(string(id), 512), 600) AS text").write.option("compression", "none").option("parquet.enable.dictionary", "false").parquet(path)
    docs = spark.read.parquet(path)
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    wanted = -(-size // DEAL_BYTES)
    assert wanted > 4 and deal(docs, "id").rdd.getNumPartitions() == wanted
    assert "hashpartitioning(id#" in term_frequencies(docs, "id", "text")._jdf.queryExecution().executedPlan().toString()
    assert deal(spark.createDataFrame([(1, "a")], "id int, text string"), "id").rdd.getNumPartitions() <= 4
