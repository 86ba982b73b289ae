"""Source divergence audit: how the term use of each source differs from the other sources of its language.

Terms are counted by a sort of token-start pointers. A task lays the texts of an Arrow batch end to end (a shard), notes where
each term starts, and sorts these pointers by multikey quicksort on slices of eight bytes: pointers with equal slices form a
run, and only runs whose terms go on are sorted again by the next slice. An equal run is a term; inside it the texts' groups
and numbers give the occurrences and the document frequency of each (lang, source). Spark sums the shards.

Kept terms, per lang: those in at least `min_docs` of its documents. All further arithmetic is on integers:

    p = 1 + floor(SCALE * (count + ADDED) / (N + ADDED * V))       for a (lang, source) group and for the whole lang
    f = floor((p - q)^2 / (p + q))

Part `pair` compares a group with each other source of its lang, over all kept terms; part `term` lists the kept terms that the
group uses more than its lang does, the `top` highest f.

Results for special input: null text, lang and source are read as ''; a text without a term still makes its group occur; a lang
without kept terms has pairs of value 0 and no terms; equal values rank by the item's UTF-8 bytes; repeated rows count as often
as they stand there; an empty table gives no rows; only the columns named are read, whatever other columns exist. A long text is
one shard of its own.

Skew: a language or source may hold any share of the rows, since counts are summed in the shard, in the task and then by
(lang, source, term). A lang's list of sources is held by each task that compares them; its pairs are part of the result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimspark.llm.common import column_bytes, lower_ascii, pieces, prepare, stored
from claimspark.operators.joins import join_checked

SCALE = 1_000_000_000
ADDED = 2
#: Bytes of text sorted at once (a longer single text is one shard).
SHARD_BYTES = 4 << 20
#: Kept terms that one task compares for all pairs of a lang's sources.
SLICE_TERMS = 1 << 13
#: Cells of the (term, source) matrix that a task works on at once.
TILE_CELLS = 1 << 18
#: Largest N + ADDED * V whose product with SCALE fits 64 bits; beyond it Python's integers are used.
WIDE_TOTAL = 9_000_000_000

_TERM = np.ones(256, dtype=bool)
_TERM[0x00:0x41] = False
_TERM[0x5B:0x61] = False
_TERM[0x7B:0x80] = False


# -- a shard: pointers, runs, counts ---------------------------------------------

def term_bounds(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the terms; a term never crosses the end of a text."""
    inside = _TERM[buf]
    cut = np.zeros(len(buf) + 1, dtype=bool)
    cut[offs] = True
    first, last = inside.copy(), inside.copy()
    if len(buf):
        first[1:] &= ~inside[:-1] | cut[1:-1]
        last[:-1] &= ~inside[1:] | cut[1:-1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def run_names(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number for each pointer, equal for equal terms: multikey quicksort by slices of eight bytes.

    Terms hold no zero byte, so a slice padded with zeros tells a term that ends from one that goes on.
    """
    names = np.zeros(len(starts), dtype=np.int64)
    lengths = ends - starts
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    slices = np.ndarray((len(buf) + 1,), dtype=">u8", buffer=padded, strides=(1,))
    live, depth, fresh = np.arange(len(starts)), 0, 1
    while len(live):
        part = slices[np.minimum(starts[live] + depth, len(buf))].astype(np.uint64)
        rest = np.minimum(lengths[live] - depth, 8).astype(np.uint64)
        shift = (np.uint64(8) - rest) * np.uint64(8)
        part = np.where(rest == 0, np.uint64(0), (part >> (shift % np.uint64(64))) << (shift % np.uint64(64)))
        order = np.argsort(part) if depth == 0 else np.lexsort((part, names[live]))
        run = np.ones(len(live), dtype=bool)
        run[1:] = part[order[1:]] != part[order[:-1]]
        if depth:
            run[1:] |= names[live[order[1:]]] != names[live[order[:-1]]]
        of = np.cumsum(run) - 1
        live = live[order]
        names[live] = fresh + of
        fresh += int(run.sum())
        depth += 8
        live = live[(np.bincount(of)[of] > 1) & (lengths[live] >= depth)]  # alone in its run, or ended: done
    return names


def shard_counts(buf: np.ndarray, offs: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, ...]:
    """(start, end, group, occurrences, documents) of each distinct (term, group) of a shard; `group` numbers each text's."""
    buf = lower_ascii(buf)
    starts, ends = term_bounds(buf, offs)
    if not len(starts):
        none = np.zeros(0, dtype=np.int64)
        return buf, none, none, none, none, none
    text = np.searchsorted(offs, starts, "right") - 1
    wide = int(group.max()) + 1
    keys = run_names(buf, starts, ends) * wide + group[text]
    order = np.argsort(keys, kind="stable")  # pointers stand in the order of their texts
    k, t = keys[order], text[order]
    new = np.ones(len(k), dtype=bool)
    new[1:] = k[1:] != k[:-1]
    at = np.flatnonzero(new)
    other = new.copy()
    other[1:] |= t[1:] != t[:-1]
    some = order[at]
    return (buf, starts[some], ends[some], k[at] % wide, np.diff(np.append(at, len(k))),
            np.add.reduceat(other.astype(np.int64), at))


def strings(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The byte ranges as an Arrow string column."""
    lengths = ends - starts
    offsets = np.zeros(len(starts) + 1, dtype=np.int32)
    np.cumsum(lengths, out=offsets[1:])
    place = np.arange(offsets[-1]) - np.repeat(offsets[:-1], lengths) + np.repeat(starts, lengths)
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets.tobytes()), pa.py_buffer(buf[place].tobytes()))


def _count_shards(batches):
    for batch in batches:
        table = pa.table({"lang": batch.column("lang"), "source": batch.column("source")})
        groups = table.group_by(["lang", "source"], use_threads=False).aggregate([])
        groups = groups.append_column("g", pa.array(np.arange(len(groups))))
        numbered = table.append_column("row", pa.array(np.arange(len(table)))).join(groups, ["lang", "source"], use_threads=False)
        group = np.empty(len(table), dtype=np.int64)
        group[numbered["row"].to_numpy()] = numbered["g"].to_numpy()
        buf, offs = column_bytes(batch.column("text"))
        for row, end, part, at in pieces(buf, offs, SHARD_BYTES):
            low, s, e, g, n, docs = shard_counts(part, at, group[row:end])
            if len(s):
                yield pa.RecordBatch.from_arrays(
                    [groups["lang"].take(pa.array(g)).combine_chunks(), groups["source"].take(pa.array(g)).combine_chunks(),
                     strings(low, s, e), pa.array(n, pa.int64()), pa.array(docs, pa.int64())],
                    names=["lang", "source", "term", "n", "docs"])


# -- the comparison ----------------------------------------------------------------

def share(count, total, n_terms):
    """p of a count, for columns; exact by integer division of decimals."""
    up = F.lit(SCALE).cast("decimal(10,0)") * (count + ADDED).cast("decimal(20,0)")
    down = (total + ADDED * n_terms).cast("decimal(20,0)")
    return F.lit(1) + F.call_function("div", up, down)


def shares(counts: np.ndarray, totals: np.ndarray, n_terms: int) -> np.ndarray:
    """p of a matrix of counts, one column for each total."""
    down = totals + ADDED * n_terms
    if int(down.max()) > WIDE_TOTAL:
        return (1 + SCALE * (counts.astype(object) + ADDED) // down.astype(object)).astype(np.int64)
    return 1 + SCALE * (counts + ADDED) // down


def _pair_sums(key, kept, groups):
    """Sum of f over this slice's terms, for both directions of each pair of the lang's sources."""
    names = groups["source"].to_pylist()
    place = {name: i for i, name in enumerate(names)}
    totals = groups["total"].to_numpy()
    n_terms = int(groups["n_terms"][0].as_py()) if names else 0
    sums = np.zeros((len(names), len(names)), dtype=np.int64)
    tile = max(1, TILE_CELLS // max(1, len(names)))
    for begin in range(0, len(kept), tile):
        lists = kept["uses"].slice(begin, tile).combine_chunks()
        flat = lists.flatten()
        row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
        column = np.array([place[s] for s in flat.field("source").to_pylist()], dtype=np.int64)
        counts = np.zeros((len(lists), len(names)), dtype=np.int64)
        counts[row, column] = flat.field("n").to_numpy()
        p = shares(counts, totals, n_terms)
        for i in range(len(names) - 1):
            mine, other = p[:, i:i + 1], p[:, i + 1:]
            sums[i, i + 1:] += ((mine - other) ** 2 // (mine + other)).sum(axis=0)
    a, b = np.nonzero(~np.eye(len(names), dtype=bool))
    both = sums + sums.T
    text = pa.array(names, pa.string())
    return pa.table({"lang": pa.array([key[0].as_py()] * len(a), pa.string()), "source": text.take(pa.array(a)),
                     "item": text.take(pa.array(b)), "value": pa.array(both[a, b], pa.int64())})


def kept_terms(docs: DataFrame, min_docs: int = 10) -> DataFrame:
    """(lang, term, n, docs, uses): the kept terms of each lang, with the occurrences in each of its sources."""
    prepare(docs.sparkSession)
    texts = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("text", "lang", "source")])
    counts = (texts.mapInArrow(_count_shards, "lang string, source string, term string, n long, docs long")
              .groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    # one term of one lang: as many entries as the lang has sources
    return (counts.groupBy("lang", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"),
                                               F.collect_list(F.struct("source", "n")).alias("uses"))
            .where(F.col("docs") >= min_docs))


def audit(docs: DataFrame, min_docs: int = 10, top: int = 10) -> DataFrame:
    """(lang, source, part, item, value, rank) for the columns text, lang and source of `docs`; see the module."""
    groups = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    kept = stored(kept_terms(docs, min_docs), "audit-terms")
    langs = kept.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.count(F.lit(1)).alias("n_terms"))
    uses = kept.select("lang", "term", F.col("n").alias("lang_n"), F.explode("uses").alias("u")).select(
        "lang", "term", "lang_n", "u.source", "u.n")
    totals = uses.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    stats = stored(groups.join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
                   .fillna(0, ["total", "lang_total", "n_terms"]), "audit-groups")

    p = share(F.col("n"), F.col("total"), F.col("n_terms"))
    q = share(F.col("lang_n"), F.col("lang_total"), F.col("n_terms"))
    terms = (join_checked(uses, stats, ["lang", "source"]).select("lang", "source", F.col("term").alias("item"),
                                                                  p.alias("p"), q.alias("q"))
             .where("p > q").select("lang", "source", F.lit("term").alias("part"), "item",
                                    F.expr("(p - q) * (p - q) div (p + q)").alias("value")))

    slices = F.expr(f"1 + n_terms div {SLICE_TERMS}")  # by the lang's terms: each slice gives a row for every pair
    left = join_checked(kept.select("lang", "term", "uses"), langs, "lang").select(
        "lang", F.pmod(F.xxhash64("term"), slices).alias("slice"), "uses")
    right = stats.select("lang", F.explode(F.sequence(F.lit(0).cast("long"), slices - 1)).alias("slice"), "source", "total", "n_terms")
    pairs = (left.groupBy("lang", "slice").cogroup(right.groupBy("lang", "slice"))
             .applyInArrow(_pair_sums, "lang string, source string, item string, value long")
             .groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
             .select("lang", "source", F.lit("pair").alias("part"), "item", "value"))

    def ranked(df):
        order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
        return df.withColumn("rank", F.row_number().over(order))

    return ranked(pairs).unionByName(ranked(terms).where(F.col("rank") <= top)).select(
        "lang", "source", "part", "item", "value", "rank")
