"""A stored inverted index of the evidence corpus, written once and read by every search (SRC-5, JN-3).

Layout, below one folder of the shared storage:
  postings  one row per block: term, band, part, n, max_w and the block's (doc, w); partitioned by shard, files sorted by term
  terms     term, df, max_w; partitioned by shard
  meta      the numbers of documents and of shards, the type of the ids

A term's postings are cut by weight (a band spans a factor of two) and, within it, by a hash of the document into parts of about
`BLOCK_POSTINGS`. Blocks have a bounded size whatever the term's frequency, and a term that a third of all documents hold is dealt over
many tasks. Cutting by weight makes a block's largest weight a tight bound; cutting by document says in which part a document must stand.

It is written from packed postings of about four bytes (`index_build`): texts are read once and stay where they lie, and the
vocabulary is never sent around.

Search, exact (block-max pruning):
  1. only shards of the statements' terms are read (partition pruning), and of these only the terms' own blocks;
  2. the best document by a statement's rarest terms is scored: a lower bound of the statement's best score;
  3. a statement's most frequent terms whose bound, by largest weights and by length, stays below a share of the lower bound are not
     searched for candidates; a block whose largest weight, with the most that the other terms can add, stays below the lower
     bound holds no winner, and its postings are not unpacked;
  4. what is left is dealt by document and summed by (statement, document); pairs that can still win are scored exactly.
A winner's postings are never pruned: each of its blocks reaches at least the winner's own score.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from claimspark.operators import evidence as EV
from claimspark.operators import index_build as IB
from claimspark.operators.joins import join_checked, spread
from claimspark.operators.tfidf import idf_expr
from claimspark.session import drop_shuffles, materialize, release, scratch_path, ship_package

BLOCK_POSTINGS = 64
SHARDS = 64
#: Share of a statement's lower bound that the terms left out of the search for candidates may add.
REST = 0.5
#: What sums of four-byte weights may be off by, with room to spare.
ROUNDED = 1e-5
#: Documents whose postings of a shard a task holds at once.
SLOT_DOCS = 1 << 18
#: Documents of the corpus for each task that holds shards, up to a task a shard.
TASK_DOCS = 1 << 11
#: Tables under this many bytes are dealt over the cores; larger ones have row groups enough, and their texts stay in place.
SPREAD_BYTES = 64 << 20


@dataclass(frozen=True)
class Index:
    """A stored index: its folder, and what `meta` says (`doc_type`: SQL type of the documents' ids)."""
    path: str
    n_docs: int
    shards: int
    doc_type: str

    def schema(self, name: str) -> str:
        columns = {"postings": f"band int, part long, n long, max_w double, postings array<struct<doc: {self.doc_type}, w: double>>",
                   "terms": "df long, max_w double"}[name]
        return f"term string, {columns}, shard int"

    def table(self, spark: SparkSession, name: str, shards: list[int] | None = None) -> DataFrame:
        out = spark.read.schema(self.schema(name)).parquet(f"{self.path}/{name}")
        return out if shards is None else out.where(F.col("shard").isin(shards))


def _shard(term: Column, shards: int) -> Column:
    return (F.crc32(term.cast("binary")) % shards).cast("int")


def _part(doc: Column, df: Column) -> Column:
    """The part of a term's postings in which a document stands."""
    return F.pmod(F.hash(doc).cast("long"), F.ceil(df / F.lit(BLOCK_POSTINGS)))


def _once(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(rows whose id no other row has, the rest or None), by a shuffle of the ids alone. A missing id is in the rest."""
    ids = materialize(docs.groupBy("doc").agg(F.count("*").alias("n")).where("n > 1 or doc is null").select("doc"))
    if ids.isEmpty():
        return docs, None
    shared = ids.where("doc is not null")
    rest = join_checked(docs, shared, "doc", "left_semi").unionAll(docs.where("doc is null"))
    return join_checked(docs.where("doc is not null"), shared, "doc", "left_anti"), rest


def packed_postings(docs: DataFrame, n_docs: int, shards: int) -> DataFrame:
    """Rows of `index_build.packed_schema` of (doc, text), kept, the rows of a shard in one task, in the order of their slots.

    Texts stay where they lie; those of an id that several rows share are counted together first.
    """
    schema = IB.packed_schema(docs.schema["doc"].dataType.simpleString())
    arrow = to_arrow_schema(T.StructType.fromDDL(schema))
    slots = max(1, -(-n_docs // SLOT_DOCS))
    once, rest = _once(docs)
    rows = once.select("doc", F.hash("doc").alias("hash"), "text").mapInArrow(IB.take_apart(shards, slots, False, arrow), schema)
    if rest is not None:
        tf = EV._terms_of(rest, "doc", "text", "doc")
        of_doc = tf.groupBy("doc").agg(F.collect_list("term").alias("terms"), F.collect_list("tf").alias("tfs"))
        rows = rows.unionAll(of_doc.select("doc", F.hash("doc").alias("hash"), "terms", "tfs").mapInArrow(
            IB.take_apart(shards, slots, True, arrow), schema))
    tasks = min(shards, max(docs.sparkSession.sparkContext.defaultParallelism, -(-n_docs // TASK_DOCS)))
    return materialize(rows.repartition(tasks, "shard").sortWithinPartitions("shard", "slot"))


def write_index(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS) -> Index:
    """Write the index of a document table. The weights are those of `evidence.corpus_index`.

    Two passes over the packed postings, shard by shard: documents' lengths, then blocks. Of what a pass shuffles or keeps, nothing
    outlives the next (see `index_build`).
    """
    spark = docs.sparkSession
    ship_package(spark)
    n_docs = docs.count()  # from the scan (parquet metadata)
    source = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    small = int(source._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) < SPREAD_BYTES
    packed = packed_postings(spread(source, "doc") if small else source, n_docs, shards)
    drop_shuffles(spark)
    rows = packed.where(F.col("shard") != IB.DOCUMENTS)
    squares = rows.mapInArrow(IB.squares(n_docs), IB.SQUARES).groupBy("piece").applyInArrow(IB.add_squares, IB.SQUARES)
    pieces = packed.where(F.col("shard") == IB.DOCUMENTS).select("piece", "ids", "hashes").join(squares, "piece", "left").orderBy("piece").toArrow()
    known = spark.sparkContext.broadcast(IB.document_table(pieces))
    index = Index(path, n_docs, shards, docs.schema[id_col].dataType.simpleString())
    schema = index.schema("postings")
    blocks = rows.mapInArrow(IB.cut_blocks(known, n_docs, BLOCK_POSTINGS, to_arrow_schema(T.StructType.fromDDL(schema))), schema)
    blocks.write.partitionBy("shard").option("compression", "zstd").parquet(f"{path}/postings")
    known.destroy()
    release(packed)
    of_term = index.table(spark, "postings").groupBy("shard", "term").agg(F.sum("n").alias("df"), F.max("max_w").alias("max_w"))
    of_term.repartition("shard").sortWithinPartitions("shard", "term").write.partitionBy("shard").parquet(f"{path}/terms")
    meta = spark.createDataFrame([(n_docs, shards, index.doc_type)], "n_docs long, shards int, doc_type string")
    meta.coalesce(1).write.parquet(f"{path}/meta")
    drop_shuffles(spark)
    return index


def read_index(spark: SparkSession, path: str) -> Index:
    meta = spark.read.parquet(f"{path}/meta").first()
    return Index(path, meta["n_docs"], meta["shards"], meta["doc_type"])


def index_of_file(spark: SparkSession, path: str, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """The application's index of a Parquet table: written at the first call, written anew when files, sizes or times have changed."""
    docs = spark.read.parquet(path)
    files = docs.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    state = (path, id_col, text_col, *files.agg(F.count("*"), F.bit_xor(F.xxhash64(*files.columns))).first())
    known = spark.sparkContext.__dict__.setdefault("_claimspark_indexes", {})
    if state in known:
        try:
            return read_index(spark, known[state])
        except AnalysisException:  # the folder was cleared
            del known[state]
    index = write_index(docs, scratch_path(spark, "evidence-index"), id_col, text_col)
    known[state] = index.path
    return index


def statement_terms(queries: DataFrame, index: Index, id_col: str = "item_id", text_col: str = "text") -> tuple[DataFrame, list[int]]:
    """(q, term, shard, wq, df, max_w) over the corpus vocabulary, and the shards that hold the terms."""
    spark = queries.sparkSession
    tf = materialize(EV._terms_of(queries, id_col, text_col, "q").withColumn("shard", _shard(F.col("term"), index.shards)))
    used = sorted(r["shard"] for r in tf.select("shard").distinct().collect())  # at most `shards`
    joined = join_checked(index.table(spark, "terms", used), tf, ["shard", "term"], "inner")
    weight = (F.lit(1.0) + F.log(F.col("tf").cast("double"))) * idf_expr(F.col("df"), index.n_docs)
    out = EV._normalise(joined.select("q", "term", "shard", "df", "max_w", weight.alias("w")), "q")
    return materialize(out.withColumnRenamed("w", "wq")), used


def _score_pairs(pairs: DataFrame, qt: DataFrame, blocks: DataFrame) -> DataFrame:
    """(q, doc, score): exact scores of given pairs. The pairs go to the postings, by document; the postings stay where they lie."""
    held = blocks.select("term", F.explode("postings").alias("p")).select("term", "p.doc", "p.w")
    entry = join_checked(join_checked(held, pairs, "doc"), qt.select("q", "term", "wq"), ["q", "term"])
    return entry.groupBy("q", "doc").agg(F.sum(F.col("wq") * F.col("w")).alias("score"))


def _bounds(qt: DataFrame, lower: DataFrame) -> DataFrame:
    """`qt` with each statement's bounds; windows run over one statement's terms.

    What terms add to a score is at most the sum of their largest weights, and, since documents have length 1, at most the
    length of the statement's own part. The most frequent terms that stay below `REST` of the statement's lower bound are not
    searched for candidates (`leads` is false); `rest_sum` and `rest_length` are the bounds of what they add. `least` is what a
    document must have from this term alone to reach the lower bound with the help of all others.
    """
    of_q = Window.partitionBy("q")
    falling = of_q.orderBy(F.desc("df"), "term").rowsBetween(Window.unboundedPreceding, 0)
    of_rest = lambda c: F.coalesce(F.sum(F.when(~F.col("leads"), c)).over(of_q), F.lit(0.0))
    square = F.col("wq") * F.col("wq")
    return (qt.join(lower, "q").withColumn("most", F.col("wq") * F.col("max_w"))
            .withColumn("lower", F.col("lower") - 10.0 ** -EV.SCORE_DECIMALS)
            .withColumn("leads", F.least(F.sum("most").over(falling), F.sqrt(F.sum(square).over(falling))) >= REST * F.col("lower"))
            .withColumn("rest_sum", of_rest(F.col("most"))).withColumn("rest_length", F.sqrt(of_rest(square)))
            .withColumn("least", F.col("lower") - F.least(F.sum("most").over(of_q) - F.col("most"),
                                                          F.sqrt(F.greatest(F.sum(square).over(of_q) - square, F.lit(0.0))))))


def _floors(bounds: DataFrame) -> DataFrame:
    """(term, floor): the smallest weight with which a document can be some statement's winner, of the terms that lead."""
    least = (F.col("least") - 10.0 ** -EV.SCORE_DECIMALS) / F.col("wq")
    return bounds.where("leads").groupBy("term").agg(F.min(least).alias("floor"))


def surviving_blocks(qt: DataFrame, blocks: DataFrame, lower: DataFrame) -> DataFrame:
    """The blocks that can hold a winner, of the terms that are searched for candidates."""
    return join_checked(blocks, _floors(_bounds(qt, lower)), "term").where("max_w >= floor").drop("floor")


def candidate_pairs(qt: DataFrame, blocks: DataFrame, lower: DataFrame) -> DataFrame:
    """(q, doc) pairs whose sum over the leading terms, with the most that the rest can add, reaches the lower bound.

    A document that has `filled` of its squared length in the leading terms has the rest of it at most in the others. Postings are
    dealt by document before they meet the statements, once however many statements share a term, their weights in four bytes.
    """
    bounds = materialize(_bounds(qt, lower))
    names = materialize(bounds.where("leads").select("term").distinct().withColumn("name", F.monotonically_increasing_id()))
    left = join_checked(surviving_blocks(qt, blocks, lower), names, "term").select("name", F.explode("postings").alias("p"))
    dealt = left.select("name", F.col("p.doc").alias("doc"), F.col("p.w").cast("float").alias("w")).repartition("doc")
    asked = bounds.where("leads").join(names, "term").select("name", "q", "wq")
    partly = join_checked(dealt, asked, "name").groupBy("q", "doc").agg(
        F.sum(F.col("wq") * F.col("w")).alias("part"), F.sum(F.col("w") * F.col("w")).alias("filled"))
    of_q = bounds.select("q", "lower", "rest_sum", "rest_length").distinct()
    rest = F.least("rest_sum", F.col("rest_length") * F.sqrt(F.greatest(1.0 - F.col("filled"), F.lit(0.0)) + ROUNDED))
    return join_checked(partly, of_q, "q").where(F.col("part") + rest >= F.col("lower") - ROUNDED).select("q", "doc")


def search(queries: DataFrame, index: Index, q_id: str = "item_id", q_text: str = "text", seed_terms: int = 3) -> DataFrame:
    """(q, doc, r): rounded scores of every document that can be a statement's best match, kept. Same best rows as a full scoring.

    Blocks are read from the index in each step, and no step stores or shuffles them.
    """
    spark = queries.sparkSession
    qt, used = statement_terms(queries, index, q_id, q_text)
    blocks = join_checked(index.table(spark, "postings", used), qt.select("shard", "term").distinct(), ["shard", "term"], "left_semi")
    by_df = Window.partitionBy("q").orderBy("df", "term")
    seeds = qt.withColumn("rank", F.row_number().over(by_df)).where(F.col("rank") <= seed_terms).select("q", "term", "wq")
    held = join_checked(blocks.select("term", "postings"), seeds, "term").select("q", "wq", F.explode("postings").alias("p"))
    sums = held.groupBy("q", F.col("p.doc").alias("doc")).agg(F.sum(F.col("wq") * F.col("p.w")).alias("part"))
    first = materialize(sums.groupBy("q").agg(F.max_by("doc", F.struct("part", "doc")).alias("doc")))
    parts = first.join(qt.select("q", "term", "df"), "q").select("term", _part(F.col("doc"), F.col("df")).alias("part")).distinct()
    own = join_checked(blocks, parts, ["term", "part"], "left_semi")  # each term's posting is in the part where the document must stand
    lower = materialize(_score_pairs(first, qt, own).select("q", F.col("score").alias("lower")))
    pairs = candidate_pairs(qt, blocks, lower)
    return materialize(_score_pairs(pairs, qt, blocks).withColumn("r", F.round("score", EV.SCORE_DECIMALS)))
