"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search, exact verification.

The benchmark is a stated query set; it is read in blocks of at most `BLOCK_ITEMS` items, and each block is searched in one pass over
all documents, without a shuffle. For every item length (in words) that a document's n-grams hint at, each window of
that many words is fingerprinted (of a document with fewer words, the whole document as one window): the 64 signs of the sum of its weighted n-gram hashes, from running sums. Item
fingerprints are indexed by `RADIUS + 1` bit blocks: two fingerprints within the radius agree in at least one block
(they differ in at most `RADIUS` bits), so the index returns every pair within it. Candidates within the radius are verified by the exact
weighted Jaccard similarity of n-gram multisets: sum of weight * min(count) over sum of weight * max(count). An n-gram
weighs the bytes of its words, so weights depend on no other text and results on no block.

Windows without any n-gram of the block's items have similarity 0 and are not fingerprinted.

SimHash is the candidate filter: at similarity 0.8 the expected distance is about 10 bits (deviation 3), so the radius of 22 lies
four deviations away; verification is exact. Words are `[^\\x20\\x09-\\x0D]+`, A-Z lower-cased; an item of fewer
words than the n-gram width is one n-gram of all its words, and so is a window of its length.

Defined results: null or word-free texts and items match nothing; repeated rows are reported each; a null id is kept; items
with equal texts are reported each; empty tables give an empty result; other columns are ignored (or kept by
`drop_contaminated`). Of equally similar windows the first is reported.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimspark.llm import common as C

BLOCK_ITEMS = 2000
RADIUS = 22
_BITS = np.arange(64, dtype=np.uint64)


def _utf8(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    return C.column_bytes(pa.array(texts, pa.string()))


def _words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, word lengths in bytes, and each text's first word."""
    buf = C.lower_ascii(buf)
    starts, ends, first = C.word_bounds(buf, offs)
    return C.word_hashes(buf, starts, ends), (ends - starts).astype(np.int32), first


def gram_weights(sizes: np.ndarray, width: int) -> np.ndarray:
    """Bytes of the words of each n-gram of one text."""
    sums = np.concatenate([[0], np.cumsum(sizes)])
    return (sums[width:] - sums[:-width] if len(sizes) >= width else sums[-1:] - sums[:1]).astype(np.int32)


def counted(grams: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct n-grams, their counts and weights."""
    values, at, counts = np.unique(grams, return_index=True, return_counts=True)
    return values, counts, weights[at].astype(np.int64)


def fingerprints(grams: np.ndarray, weights: np.ndarray, starts: np.ndarray, count: int) -> np.ndarray:
    """SimHash of the windows of `count` n-grams that begin at `starts`."""
    signs = ((grams[:, None] >> _BITS) & np.uint64(1)).astype(np.int32) * 2 - 1
    sums = np.zeros((len(grams) + 1, 64), dtype=np.int32)
    np.cumsum(signs * weights[:, None], axis=0, out=sums[1:])
    bits = sums[starts + count] - sums[starts] > 0
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64).ravel()


def block_edges(radius: int) -> np.ndarray:
    """Bit positions that cut 64 bits into `radius + 1` blocks."""
    return np.linspace(0, 64, radius + 2).astype(int)


class ItemBlock:
    """The index of one block of items."""

    def __init__(self, ids: list, texts: list[str | None], width: int, radius: int) -> None:
        words, sizes, first = _words(*_utf8(texts))
        self.width, self.radius, self.ids = width, radius, ids
        self.lengths = np.diff(first)
        grams, at = C.shingle_hashes(words, first, width)
        own = [grams[at[k]:at[k + 1]] for k in range(len(ids))]
        weights = [gram_weights(sizes[first[k]:first[k + 1]], width) for k in range(len(ids))]
        self.known = np.unique(grams)
        self.items = [counted(g, w[:len(g)]) for g, w in zip(own, weights)]
        # lengths of the items that hold a known n-gram
        pairs = {(int(np.searchsorted(self.known, g)), int(self.lengths[k])) for k, gs in enumerate(own) for g in gs}
        held: dict[int, set[int]] = {}
        for place, length in pairs:
            held.setdefault(place, set()).add(length)
        self.lengths_of = [np.array(sorted(held.get(i, ())), dtype=np.int64) for i in range(len(self.known))]
        # a hash filter in front of the sorted search
        self.filter = np.zeros(1 << 20, dtype=bool)
        self.filter[(self.known & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        # multi-index: per length, (block, bits) -> items
        self.edges = block_edges(radius)
        self.index: dict[int, tuple] = {}
        for length in np.unique(self.lengths[self.lengths > 0]).tolist():
            members = np.flatnonzero(self.lengths == length)
            prints = np.concatenate([fingerprints(own[k], weights[k], np.array([0]), len(own[k]))
                                     for k in members])
            keys = self.block_keys(prints)
            order = np.argsort(keys.ravel(), kind="stable")
            self.index[length] = (members, prints, keys.ravel()[order], order % len(members))

    def block_keys(self, prints: np.ndarray) -> np.ndarray:
        """(block, print) table of each fingerprint's bits in each block, with the block number on top."""
        out = np.empty((self.radius + 1, len(prints)), dtype=np.uint64)
        for b in range(self.radius + 1):
            low, high = int(self.edges[b]), int(self.edges[b + 1])
            out[b] = (prints >> np.uint64(low)) & np.uint64((1 << (high - low)) - 1) | np.uint64(b << 56)
        return out

    def candidates(self, length: int, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) pairs of one length whose fingerprints differ in at most `radius` bits."""
        members, own, keys, who = self.index[length]
        unique, back = np.unique(prints, return_inverse=True)
        asked = self.block_keys(unique).ravel()
        low, high = np.searchsorted(keys, asked), np.searchsorted(keys, asked, "right")
        n = high - low
        rows = np.repeat(np.arange(len(asked)) % max(len(unique), 1), n)
        hits = who[np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)]
        pair = np.unique(rows * len(members) + hits)
        rows, hits = pair // len(members), pair % len(members)
        near = np.bitwise_count(unique[rows] ^ own[hits]) <= self.radius
        rows, hits = rows[near], hits[near]
        order = np.argsort(back, kind="stable")
        cut = np.searchsorted(back[order], np.arange(len(unique) + 1))
        windows = [order[cut[r]:cut[r + 1]] for r in rows]
        return (np.concatenate(windows) if windows else np.zeros(0, np.int64),
                np.repeat(members[hits], [len(w) for w in windows]) if windows else np.zeros(0, np.int64))

    def similarity(self, grams: np.ndarray, weights: np.ndarray, item: int) -> float:
        own, own_counts, own_weights = counted(grams, weights)
        values, counts, weights = self.items[item]
        both = np.intersect1d(values, own, return_indices=True)
        shared = float((np.minimum(counts[both[1]], own_counts[both[2]]) * weights[both[1]]).sum())
        total = float((counts * weights).sum() + (own_counts * own_weights).sum()) - shared
        return shared / total if total else 0.0

    def search(self, words: np.ndarray, sizes: np.ndarray, threshold: float) -> dict[int, tuple[int, float, int]]:
        """item -> (first word of the best window, similarity, windows that reach the threshold) for one text."""
        found: dict[int, tuple[int, float, int]] = {}
        grams, _ = C.shingle_hashes(words, np.array([0, len(words)]), self.width, short=False)
        jobs: dict[int, np.ndarray] = {}
        longer = []  # lengths of hinted items with more words than the text
        if len(grams):
            place = np.minimum(np.searchsorted(self.known, grams), max(len(self.known) - 1, 0))
            hits = np.flatnonzero(self.known[place] == grams) if len(self.known) else np.zeros(0, np.int64)
            for length in np.unique(np.concatenate([self.lengths_of[p] for p in place[hits]])).tolist() if len(hits) else ():
                if length < self.width:
                    continue
                if length > len(words):
                    longer.append(length)
                    continue
                at = hits[np.fromiter((length in self.lengths_of[p] for p in place[hits]), bool, len(hits))]
                mark = np.zeros(len(words) - length + 2, dtype=np.int64)
                np.add.at(mark, np.clip(at - (length - self.width), 0, len(words) - length + 1), 1)
                np.add.at(mark, np.minimum(at, len(words) - length) + 1, -1)
                jobs[length] = np.flatnonzero(np.cumsum(mark[:-1]) > 0)
            weights = gram_weights(sizes, self.width)
        for length, starts in jobs.items():
            if not len(starts):
                continue
            low, count = int(starts[0]), length - self.width + 1
            part = slice(low, int(starts[-1]) + count)
            prints = fingerprints(grams[part], weights[part], starts - low, count)
            for w, item in zip(*self.candidates(length, prints)):
                start = int(starts[w])
                own = slice(start, start + count)
                self._take(found, int(item), start, self.similarity(grams[own], weights[own], int(item)), threshold)
        if longer:
            prints = fingerprints(grams, weights, np.array([0]), len(grams))
            for length in longer:
                for item in self.candidates(length, prints)[1]:
                    self._take(found, int(item), 0, self.similarity(grams, weights, int(item)), threshold)
        for length in [n for n in self.index if n < self.width and n <= len(words)]:  # items of a few words
            windows = np.arange(len(words) - length + 1)
            firsts = np.stack([windows, windows + length], axis=1)
            own = np.concatenate([C.shingle_hashes(words[a:b], np.array([0, length]), self.width)[0] for a, b in firsts])
            for k in np.flatnonzero(np.isin(own, self.known)):
                weight = sizes[k:k + length].sum(keepdims=True)
                for item in self.index[length][0]:
                    self._take(found, int(item), int(k), self.similarity(own[k:k + 1], weight, int(item)), threshold)
        return found

    @staticmethod
    def _take(found: dict, item: int, start: int, similarity: float, threshold: float) -> None:
        if similarity >= threshold:
            old = found.get(item)
            if old is None:
                found[item] = (start, similarity, 1)
            else:
                better = similarity > old[1] or similarity == old[1] and start < old[0]
                found[item] = (start if better else old[0], max(similarity, old[1]), old[2] + 1)


def _search_column(column: pa.Array, block: ItemBlock, threshold: float) -> Iterator[tuple[int, dict]]:
    """(row, matches) for the texts with matches."""
    buf, offs = C.column_bytes(column)
    few = any(n < block.width for n in block.index)
    for low, high, b, o in C.pieces(buf, offs):
        words, sizes, first = _words(b, o)
        grams, at = C.shingle_hashes(words, first, block.width, short=False)
        hit = np.flatnonzero(block.filter[(grams & np.uint64((1 << 20) - 1)).astype(np.int64)])
        if len(hit) and len(block.known):
            place = np.minimum(np.searchsorted(block.known, grams[hit]), len(block.known) - 1)
            hit = hit[block.known[place] == grams[hit]]
        rows = np.unique(np.searchsorted(at, hit, "right") - 1) if not few else np.arange(high - low)
        for k in rows.tolist():
            found = block.search(words[first[k]:first[k + 1]], sizes[first[k]:first[k + 1]], threshold)
            if found:
                yield low + k, found


def item_blocks(benchmark: DataFrame, item_col: str, text_col: str, width: int, radius: int,
                block_items: int = BLOCK_ITEMS) -> Iterator[ItemBlock]:
    """The query set in blocks; the driver holds one block at a time."""
    rows = benchmark.select(F.col(item_col).alias("i"), F.col(text_col).alias("t")).toLocalIterator()
    while part := list(islice(rows, block_items)):
        yield ItemBlock([r["i"] for r in part], [r["t"] for r in part], width, radius)


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 item_col: str = "item_id", item_text_col: str = "text", width: int = 5, threshold: float = 0.8,
                 radius: int = RADIUS, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """One row per document and item found in it: id, item, start_word, similarity, n_windows."""
    spark = docs.sparkSession
    C.prepare(spark)
    src = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    kind = src.schema["id"].dataType.simpleString()
    item_kind = benchmark.schema[item_col].dataType.simpleString()
    schema = f"id {kind}, item {item_kind}, start_word long, similarity double, n_windows long"
    out = None
    for block in item_blocks(benchmark, item_col, item_text_col, width, radius, block_items):
        sent = spark.sparkContext.broadcast(block)  # at most `block_items` items

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [(row, sent.value.ids[item], *hit) for row, found in
                        _search_column(batch.column(1), sent.value, threshold) for item, hit in sorted(found.items())]
                if rows:
                    take, items, start, similarity, n = zip(*rows)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(take)), pa.array(items), pa.array(start, pa.int64()),
                         pa.array(similarity, pa.float64()), pa.array(n, pa.int64())],
                        names=["id", "item", "start_word", "similarity", "n_windows"])

        part = src.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = spark.createDataFrame([], schema)
    return out.withColumnsRenamed({"id": id_col, "item": item_col})


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
                      item_text_col: str = "text", width: int = 5, threshold: float = 0.8, radius: int = RADIUS,
                      block_items: int = BLOCK_ITEMS) -> DataFrame:
    """The documents in which no item is found, all columns as they were."""
    spark = docs.sparkSession
    C.prepare(spark)
    place = docs.columns.index(text_col)
    for block in item_blocks(benchmark, item_col, item_text_col, width, radius, block_items):
        sent = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, dtype=bool)
                keep[[row for row, _ in _search_column(batch.column(place), sent.value, threshold)]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
