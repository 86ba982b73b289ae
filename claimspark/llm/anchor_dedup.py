"""Substring dedup by difference-cover anchors: word windows that a document with a smaller doc_id has are removed.

COVER is a difference cover modulo PERIOD: any two places i and j have a shift s < PERIOD with both (i + s) % PERIOD and
(j + s) % PERIOD in COVER. Only words at such places carry an anchor, the hash of the next `width - PERIOD + 1` words. Two equal
windows of `width` words therefore have an anchor at the same place inside them, whatever their alignment. Steps:

1. Equal texts become one text with its smallest doc_id.
2. Anchors of all texts are counted; those of two different doc_ids or more are shared. (hash, smallest id, largest id) are
   summed in the task before they are shuffled.
3. The places of shared anchors return to their texts. Each shared anchor is extended: every window of `width` words around it
   gets a name of 96 bits, and the smallest doc_id of each name is found.
4. A text loses the words of its windows whose name a smaller doc_id has.

Words are `[^\\x20\\x09-\\x0D]+`, unchanged. Results for special input: null and empty texts have no words; texts shorter than a
window lose nothing; rows with one doc_id take nothing from each other; a row with a null doc_id neither loses words nor takes any
from others; of equal texts under different ids only those with the smallest id keep words; an empty table gives no rows; only the
columns doc_id and text are read, whatever other columns exist; a text of any length is one row.

Skew: a passage or a text may stand in any share of the rows. Equal texts collapse by partial aggregation, shared anchors and
window names are summed in the task first, and the joins back to the texts split hot keys by AQE.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimspark.llm.common import (column_bytes, drop_shuffles, mix, pieces, prefix_sums, prepare, release, span_hash, stored,
                                   word_bounds)

#: A perfect difference set: each residue modulo 7 is the difference of two of its members.
PERIOD, COVER = 7, (0, 1, 3)
#: Anchors are counted and placed in so many slices of their hashes, one slice after the other: a slice's shuffles are gone
#: before those of the next one are written.
SLICES = 2

_IN_COVER = np.isin(np.arange(PERIOD), COVER)
_SECOND = np.random.default_rng(20260202).permutation(256).astype(np.uint8)
_STEPS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


# -- kernels ---------------------------------------------------------------------

def word_names(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each word, of the bytes and of the permuted bytes with the word's length."""
    one = mix(span_hash(prefix_sums(buf), starts, ends))
    two = mix(span_hash(prefix_sums(_SECOND[buf]), starts, ends) + (ends - starts).astype(np.uint64))
    return one, two


def windows(names: np.ndarray, at: np.ndarray, width: int, step: np.uint64) -> np.ndarray:
    """Hash of the `width` words from each place of `at` on."""
    acc = names[at].copy()
    for j in range(1, width):
        acc *= step
        acc += names[at + j]
    return mix(acc)


def anchor_places(first: np.ndarray, width: int, shared: int) -> tuple[np.ndarray, np.ndarray]:
    """(word, text) of the anchors: words at cover places of their text with `shared` words to come inside a text of
    `width` words or more."""
    counts = np.diff(first)
    n = np.where(counts >= width, counts - shared + 1, 0)
    text = np.repeat(np.arange(len(n)), n)
    place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    own = _IN_COVER[place % PERIOD]
    return (place + first[:-1][text])[own], text[own]


def kept_bytes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray,
               keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The kept words of each text joined by one space: (bytes, offsets). The white space after a word is its separator."""
    buf = np.append(buf, np.uint8(32))
    kept = np.flatnonzero(keep)
    text = np.searchsorted(first, kept, "right") - 1
    more = np.zeros(len(kept), dtype=bool)
    more[:-1] = text[1:] == text[:-1]
    sizes = ends[kept] - starts[kept] + more
    out = buf[np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(starts[kept], sizes)]
    sums = np.zeros(len(kept) + 1, dtype=np.int64)
    np.cumsum(sizes, out=sums[1:])
    out[sums[1:][more] - 1] = 32
    return out, sums[np.searchsorted(kept, first)]


def _hashed(batch):
    """Pieces of a batch's texts with their words: (first row, end row, bytes, starts, ends, first word of each text)."""
    buf, offs = column_bytes(batch.column("text"))
    for row, end, part, at in pieces(buf, offs):
        yield (row, end, part, *word_bounds(part, at))


# -- steps -------------------------------------------------------------------------

def _sliced(names, at, text, shared, part):
    """(hash, word, text) of the anchors whose hash falls into slice `part`."""
    h = windows(names, at, shared, _STEPS[0])
    own = h % np.uint64(SLICES) == part
    return h[own].view(np.int64), at[own], text[own]


def _emit_anchors(width, slice_no):
    shared = width - PERIOD + 1

    def run(batches):
        for batch in batches:
            low = batch.column("lo").to_numpy(zero_copy_only=False)
            for row, _, part, starts, ends, first in _hashed(batch):
                at, text = anchor_places(first, width, shared)
                if not len(at):
                    continue
                h, at, text = _sliced(mix(span_hash(prefix_sums(part), starts, ends)), at, text, shared, slice_no)
                if not len(at):
                    continue
                ids = low[row + text]
                order = np.lexsort((ids, h))
                h, ids = h[order], ids[order]
                new = np.ones(len(h), dtype=bool)
                new[1:] = h[1:] != h[:-1]
                last = np.append(np.flatnonzero(new)[1:], len(h)) - 1
                yield pa.RecordBatch.from_arrays([pa.array(h[new]), pa.array(ids[new]), pa.array(ids[last])], names=["h", "lo", "hi"])
    return run


def _emit_places(width, slice_no):
    shared = width - PERIOD + 1

    def run(batches):
        for batch in batches:
            key, low = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "lo"))
            for row, _, part, starts, ends, first in _hashed(batch):
                at, text = anchor_places(first, width, shared)
                if not len(at):
                    continue
                h, at, text = _sliced(mix(span_hash(prefix_sums(part), starts, ends)), at, text, shared, slice_no)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h), pa.array(key[row + text]), pa.array(low[row + text]), pa.array((at - first[text]).astype(np.int32))],
                    names=["h", "key", "own", "place"])
    return run


def _lists(column) -> tuple[np.ndarray, np.ndarray]:
    """(row, value) of the entries of a list column; null lists are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.where(column.is_null().to_numpy(zero_copy_only=False), 0,
                     column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)).astype(np.int64)
    return np.repeat(np.arange(len(column)), sizes), column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)


def _extend(width, asking):
    """Names of the windows of `width` words around the shared anchors of each text, each once: all of them, or with `asking`
    only those around an anchor that a smaller doc_id has, with their places."""
    shared = width - PERIOD + 1

    def run(batches):
        for batch in batches:
            key, low = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "lo"))
            listed, marked = _lists(batch.column("places"))
            if asking:
                older = marked % 2 == 1
                listed, marked = listed[older], marked[older]
            places = marked // 2
            for row, end, part, starts, ends, first in _hashed(batch):
                lo, hi = np.searchsorted(listed, (row, end))
                anchor = first[listed[lo:hi] - row] + places[lo:hi]
                inside = np.zeros(len(starts) + width + 1, dtype=np.int64)  # +1 where a window may start, -1 after
                begin = np.maximum(anchor - (width - shared), first[listed[lo:hi] - row])
                np.add.at(inside, begin, 1)
                np.add.at(inside, anchor + 1, -1)
                at = np.flatnonzero(np.cumsum(inside)[:len(starts)] > 0)
                text = np.searchsorted(first, at, "right") - 1
                fits = at + width <= first[text + 1]
                at, text = at[fits], text[fits]
                if not len(at):
                    continue
                one, two = (windows(n, at, width, s).view(np.int64) for n, s in zip(word_names(part, starts, ends), _STEPS))
                columns = [pa.array(one), pa.array((two >> 32).astype(np.int32)), pa.array(low[row + text])]
                if asking:
                    columns += [pa.array(key[row + text]), pa.array((at - first[text]).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names=["a", "b", "lo", "key", "place"][:len(columns)])
    return run


def _cut(width, with_text):
    """Each text without the words of its listed windows."""
    def run(batches):
        for batch in batches:
            listed, places = _lists(batch.column("gone"))
            sigs, low = batch.column("sig"), batch.column("lo")
            for row, end, part, starts, ends, first in _hashed(batch):
                lo, hi = np.searchsorted(listed, (row, end))
                at = first[listed[lo:hi] - row] + places[lo:hi]
                gone = np.zeros(len(starts) + width + 1, dtype=np.int64)
                np.add.at(gone, at, 1)
                np.add.at(gone, at + width, -1)
                keep = np.cumsum(gone)[:len(starts)] == 0
                sums = np.zeros(len(keep) + 1, dtype=np.int64)
                np.cumsum(keep, out=sums[1:])
                n = np.diff(first)
                out, bounds = kept_bytes(part, starts, ends, first, keep)
                whole, ends_at = kept_bytes(part, starts, ends, first, np.ones(len(starts), dtype=bool))
                got = [out[bounds[k]:bounds[k + 1]].tobytes() for k in range(end - row)]
                full = [whole[ends_at[k]:ends_at[k + 1]].tobytes() for k in range(end - row)]
                columns = [sigs.slice(row, end - row), low.slice(row, end - row), pa.array(n, pa.int64()),
                           pa.array(n - np.diff(sums[first]), pa.int64()), *[pa.array([hashlib.sha256(t).hexdigest() for t in u], pa.string()) for u in (got, full)]]
                fields = ["sig", "lo", "n_words", "n_removed", "kept_sha256", "whole_sha256"]
                if with_text:
                    columns += [pa.array([t.decode() for t in u], pa.string()) for u in (got, full)]
                    fields += ["kept_text", "whole_text"]
                yield pa.RecordBatch.from_arrays(columns, names=fields)
    return run


def remove_repeats(docs: DataFrame, width: int = 13, with_text: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) for each row of `docs` (doc_id, text); `with_text` adds kept_text.

    `width` is the window's length in words, at least PERIOD + 2 so that an anchor has three words or more.
    """
    if width < PERIOD + 2:
        raise ValueError(f"width must be at least {PERIOD + 2}")
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn(
        "sig", F.unhex(F.md5(F.col("text").cast("binary"))))

    # 1. one row for each text; its key is fixed by the written table
    texts = stored(rows.groupBy("sig").agg(F.min("doc_id").alias("lo"), F.first("text").alias("text"))
                   .withColumn("key", F.monotonically_increasing_id()), "anchor-texts")
    drop_shuffles(spark)
    named = texts.where(F.col("lo").isNotNull())  # texts that only rows without id have stay whole

    # 2. anchors that two ids share, and 3. their places (times 2, and 1 more where a smaller id has the anchor)
    mark = F.col("place") * 2 + (F.col("least") < F.col("own")).cast("int")
    found = []
    for part in range(SLICES):
        shared = stored(named.select("lo", "text").mapInArrow(_emit_anchors(width, part), "h long, lo long, hi long")
                        .groupBy("h").agg(F.min("lo").alias("least"), F.max("hi").alias("hi")).where("least < hi")
                        .select("h", "least"), "anchor-shared")
        drop_shuffles(spark)
        found.append(stored(named.select("key", "lo", "text").mapInArrow(_emit_places(width, part), "h long, key long, own long, place int")
                            .join(shared, "h").select("key", mark.alias("mark")).groupBy("key")
                            .agg(F.collect_list("mark").alias("places")), "anchor-places"))
        drop_shuffles(spark)
        release(shared)
    places = reduce(DataFrame.unionAll, found).groupBy("key").agg(F.sort_array(F.flatten(F.collect_list("places"))).alias("places"))

    # the windows around them
    placed = stored(texts.join(places, "key", "left"), "anchor-placed")
    drop_shuffles(spark)
    for part in found:
        release(part)
    release(texts)  # each text is kept once
    around = placed.where(F.col("places").isNotNull())
    # kept, so that the join below deals plain shuffles, whose hot keys AQE splits
    owners = stored(around.mapInArrow(_extend(width, False), "a long, b int, lo long").groupBy("a", "b")
                    .agg(F.min("lo").alias("owner"), F.max("lo").alias("hi")).where("owner < hi").select("a", "b", "owner"),
                    "anchor-owners")
    drop_shuffles(spark)
    asked = around.mapInArrow(_extend(width, True), "a long, b int, lo long, key long, place int")
    repeats = stored(asked.join(owners, ["a", "b"]).where("owner < lo").select("key", "place").groupBy("key")
                     .agg(F.sort_array(F.collect_list("place")).alias("gone")), "anchor-repeats")
    drop_shuffles(spark)
    release(owners)

    # 4. texts without them, and the verdict for each row
    extra = ", kept_text string, whole_text string" if with_text else ""
    cut = stored(placed.select("sig", "lo", "key", "text").join(repeats, "key", "left").select("sig", "lo", "text", "gone").mapInArrow(
        _cut(width, with_text), "sig binary, lo long, n_words long, n_removed long, kept_sha256 string, whole_sha256 string" + extra),
        "anchor-cut")
    drop_shuffles(spark)
    release(repeats)
    release(placed)
    whole = F.col("doc_id").isNull() | (F.col("n_words") < width)
    copy = F.col("doc_id") > F.col("lo")

    def pick(none, all_gone, own):
        return F.when(whole, none).when(copy, all_gone).otherwise(own)

    return rows.select("doc_id", "sig").join(cut, "sig").select(
        "doc_id", "n_words", pick(F.lit(0), F.col("n_words"), F.col("n_removed")).cast("long").alias("n_removed"),
        pick(F.col("whole_sha256"), F.lit(hashlib.sha256(b"").hexdigest()), F.col("kept_sha256")).alias("kept_sha256"),
        *([pick(F.col("whole_text"), F.lit(""), F.col("kept_text")).alias("kept_text")] if with_text else []))
