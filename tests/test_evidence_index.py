"""The stored index: blocks hold the postings, search equals the plain scoring, one index serves several searches."""

import pytest
from pyspark.sql import functions as F

from claimspark.functions.text import clean_text, tokens
from claimspark.operators import evidence as EV
from claimspark.operators import evidence_index as EI
from claimspark.operators import index_build as IB
from claimspark.session import scratch_path
from tests.conftest import SF_SMALL
from tests.test_evidence import DOCS, QUERIES


def tables(spark):
    return (spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text"),
            spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").select("item_id", "text"))


@pytest.mark.parametrize("block", [1, 3, 64])
@pytest.mark.parametrize("seeds", [1, 3])
def test_search_equals_the_plain_scoring(spark, monkeypatch, block, seeds):
    monkeypatch.setattr(EI, "BLOCK_POSTINGS", block)
    d = spark.createDataFrame([*DOCS, (14, None), (15, "")], "doc_id long, text string")
    q = spark.createDataFrame([*QUERIES, (5, None), (6, "is the of"), (7, "people people fruit")], "item_id long, text string")
    index = EI.write_index(d, scratch_path(spark, "index"), shards=5)
    assert EI.read_index(spark, index.path) == index
    got = EV.best_evidence(q, d, scores=EI.search(q, index, seed_terms=seeds))
    want = EV.best_evidence(q, d, seed_terms=None)
    rows = lambda f: sorted(tuple(r) for r in f.withColumn("best_score", F.round("best_score", 8)).collect())
    assert rows(got) == rows(want)


def test_search_of_the_tables(spark):
    d, q = tables(spark)
    index = EI.write_index(d, scratch_path(spark, "index"))
    got = {tuple(r) for r in EV.best_evidence(q, d, scores=EI.search(q, index)).select("item_id", "best_doc_id", "n_best", "evidence").collect()}
    want = {tuple(r) for r in EV.best_evidence(q, d, seed_terms=None).select("item_id", "best_doc_id", "n_best", "evidence").collect()}
    assert got == want and len(got) == q.count()


def test_blocks_are_bounded_and_hold_every_posting(spark):
    d, q = tables(spark)
    index = EI.write_index(d, scratch_path(spark, "index"), shards=8)
    postings, terms, n = EV.corpus_index(d)
    blocks = index.table(spark, "postings")
    flat = blocks.select("term", F.explode("postings").alias("p")).select("term", "p.doc", F.round("p.w", 12).alias("w"))
    want = postings.select("term", "doc", F.round("w", 12).alias("w"))
    assert index.n_docs == n and flat.exceptAll(want).isEmpty() and want.exceptAll(flat).isEmpty()
    assert blocks.agg(F.max("n")).first()[0] <= 3 * EI.BLOCK_POSTINGS
    assert blocks.where("n <> size(postings) or max_w <> array_max(transform(postings, p -> p.w))").isEmpty()
    assert index.table(spark, "terms").select("term", "df").exceptAll(terms.select("term", "df")).isEmpty()


def test_only_blocks_that_can_win_are_unpacked(spark):
    d, q = tables(spark)
    index = EI.write_index(d, scratch_path(spark, "index"))
    qt, used = EI.statement_terms(q, index)
    blocks = index.table(spark, "postings", used)
    best = EI.search(q, index).groupBy("q").agg(F.max("score").alias("lower"))
    left = EI.surviving_blocks(qt, blocks, best).agg(F.sum("n")).first()[0]
    assert left * 2 < blocks.join(qt.select("q", "term"), "term").agg(F.sum("n")).first()[0]
    one = EI.statement_terms(q.limit(1), index)[1]
    plan = index.table(spark, "postings", one[:1])._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(shard" in plan or "PartitionFilters: [(shard" in plan


def test_an_index_is_shared_and_renewed(spark, tmp_path):
    path = str(tmp_path / "docs.parquet")
    spark.createDataFrame(DOCS, "doc_id long, text string").write.parquet(path)
    first = EI.index_of_file(spark, path)
    assert EI.index_of_file(spark, path) == first
    spark.createDataFrame([(99, "new text")], "doc_id long, text string").write.mode("append").parquet(path)
    second = EI.index_of_file(spark, path)
    assert second.path != first.path and second.n_docs == first.n_docs + 1


def test_empty_corpus(spark):
    d = spark.createDataFrame([], "doc_id long, text string")
    q = spark.createDataFrame(QUERIES, "item_id long, text string")
    index = EI.write_index(d, scratch_path(spark, "index"))
    assert EI.search(q, index).isEmpty()


def test_tokens_of_a_piece_are_those_of_the_cleaned_text(spark):
    import pyarrow as pa

    texts = ["Café TAXES, the  Earth! a_b x 42", None, "", "Kelvin İstanbul Über\x1cjobs　tax", "a b", "end", "ing \U0001f600ok 5G"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc long, t string")
    want = {r["doc"]: r["x"] for r in df.select("doc", tokens(clean_text("t")).alias("x")).collect()}
    at, got = IB.word_tokens(pa.array(["cut off", *texts], pa.string()).slice(1))
    assert list(zip(at.tolist(), got.to_pylist())) == [(d, t) for d in sorted(want) for t in want[d]]


@pytest.mark.parametrize("slot, batch", [(EI.SLOT_DOCS, "10000"), (2, "1")])
def test_rows_that_share_an_id_are_one_document(spark, monkeypatch, slot, batch):
    monkeypatch.setattr(EI, "SLOT_DOCS", slot)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)  # a batch is a piece or more
    rows = [*DOCS, (10, "Paris again"), (None, "Rome is a city"), (None, "Rome"), (10, None), (20, ""), (21, "x")]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    index = EI.write_index(d, scratch_path(spark, "index"), shards=3)
    postings, terms, n = EV.corpus_index(d)
    flat = index.table(spark, "postings").select("term", F.explode("postings").alias("p")).select("term", "p.doc", F.round("p.w", 12).alias("w"))
    want = postings.select("term", "doc", F.round("w", 12).alias("w"))
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert index.n_docs == n == len(rows) and flat.exceptAll(want).isEmpty() and want.exceptAll(flat).isEmpty()
    assert index.table(spark, "terms").select("term", "df").exceptAll(terms.select("term", "df")).isEmpty()


def test_what_is_stored_and_sent_is_small_beside_the_texts(spark):
    """Texts were shuffled four times, postings once with all their columns, and every pair of a statement and a document once more."""
    d, q = tables(spark)
    packed = EI.packed_postings(d.toDF("doc", "text"), d.count(), 8)
    sizes = [F.octet_length(c) for c in ("lengths", "terms", "counts", "places", "tfs")]
    sent = packed.where("shard >= 0").select(F.sum(sum(sizes[1:], sizes[0]))).first()[0]
    index = EI.write_index(d, scratch_path(spark, "index"))
    qt, used = EI.statement_terms(q, index)
    blocks = index.table(spark, "postings", used)
    assert sent < 16 * blocks.agg(F.sum("n")).first()[0] and sent < d.agg(F.sum(F.octet_length("text"))).first()[0]
    best = EI.search(q, index).groupBy("q").agg(F.max("score").alias("lower"))
    pairs = EI.candidate_pairs(qt, blocks, best)
    assert pairs.count() * 5 < q.count() * d.count() and best.join(pairs, "q", "left_anti").isEmpty()
