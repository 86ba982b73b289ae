"""Quality rules judged by an isolation forest over rule statistics.

Every text gets counts (words, symbols, repeated lines, repeated five-word windows, letter case, marks). Fixed base
rules reject what is too short or too repetitive. For the rest, an isolation forest over ratios of the counts gives an
anomaly score: random splits isolate unusual rows after few steps, so short mean path lengths mean high scores. The
threshold is calibrated on labelled rows: it weighs good rows rejected against bad rows kept.

Bounds: the forest is fitted on at most `FIT_ROWS` rows labelled good, chosen by a seeded hash of the id (trees of
`TREE_ROWS` rows each). The threshold uses the scores of all labelled rows, as counts per score step.

Defined results: null and empty texts have zero counts and fail the base rules; repeated rows are judged each; rows without
a label, or with a null one, take no part in calibration; without labelled rows nothing but the base
rules rejects; other columns are ignored (or kept by `keep_good`).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimspark.llm import common as C

FIT_ROWS = 16384
TREE_ROWS = 256
TREES = 64
#: Splits after which a tree stops; a leaf then stands for the mean path of its rows.
DEEPEST = 24
#: What rejecting one share of the good rows costs, in shares of bad rows kept.
GOOD_COST = 20.0
#: Steps of the score scale on which labelled rows are counted.
SCORE_STEPS = 10_000

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_symbol_words",
          "n_caps_words", "n_mark_words")
FEATURES = ("symbol_words", "caps_words", "mark_words", "dup_lines", "repeats")

SYMBOLS = b"#*$%&|<>"
MARKS = b"!?"


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(chars)] = True
    return out


_IS_SYMBOL, _IS_MARK = _table(SYMBOLS), _table(MARKS)
_IS_UPPER, _IS_LOWER = _table(bytes(range(65, 91))), _table(bytes(range(97, 123)))


def text_counts(buf: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of every text; `n_repeat_words` are words in five-word windows found twice or more in the text."""
    starts, ends, first = C.word_bounds(buf, offs)
    n = len(offs) - 1

    def per_text(flags: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(buf) + 1, dtype=np.int64)
        np.cumsum(flags, out=sums[1:])
        return sums[offs[1:]] - sums[offs[:-1]]

    out = {"n_words": np.diff(first).astype(np.int64)}
    out["word_chars"] = per_text(((buf & 0xC0) != 0x80) & ~C._SPACE[buf])
    out["n_symbols"] = per_text(_IS_SYMBOL[buf])

    def in_words(table: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(buf) + 1, dtype=np.int64)
        np.cumsum(table[buf], out=sums[1:])
        return sums[ends] - sums[starts]

    def words_with(flags: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(starts) + 1, dtype=np.int64)
        np.cumsum(flags, out=sums[1:])
        return sums[first[1:]] - sums[first[:-1]]

    out["n_symbol_words"] = words_with(in_words(_IS_SYMBOL) > 0)
    out["n_caps_words"] = words_with((in_words(_IS_UPPER) > 1) & (in_words(_IS_LOWER) == 0))
    out["n_mark_words"] = words_with(in_words(_IS_MARK) > 0)
    windows, at = C.shingle_hashes(C.word_hashes(buf, starts, ends), first, short=False)
    repeats, dups, lines = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    data = buf.tobytes()
    for k in range(n):
        own = windows[at[k]:at[k + 1]]
        if len(own) > 1:
            order = np.sort(own)
            twice = order[1:][order[1:] == order[:-1]]
            if len(twice):
                hit = np.flatnonzero(np.isin(own, twice))
                cover = np.zeros(len(own) + 5, dtype=np.int64)
                np.add.at(cover, hit, 1)
                np.add.at(cover, hit + 5, -1)
                repeats[k] = int((np.cumsum(cover) > 0).sum())
        with_words = [x for x in data[offs[k]:offs[k + 1]].split(b"\n") if x.strip()]
        lines[k], dups[k] = len(with_words), len(with_words) - len(set(with_words))
    out["n_repeat_words"], out["n_dup_lines"], out["n_lines"] = repeats, dups, lines
    return out


def features(counts: dict[str, np.ndarray]) -> np.ndarray:
    """Shares between 0 and 1 on which rows are isolated."""
    words = np.maximum(counts["n_words"], 1)
    return np.stack([counts["n_symbol_words"] / words, counts["n_caps_words"] / words, counts["n_mark_words"] / words,
                     counts["n_dup_lines"] / np.maximum(counts["n_lines"], 1), counts["n_repeat_words"] / words], axis=1)


def base_failed(counts: dict[str, np.ndarray]) -> np.ndarray:
    return (counts["n_words"] < 10) | (100 * counts["n_repeat_words"] > 20 * counts["n_words"])


@dataclass
class Forest:
    """Trees as arrays: feature (-1: leaf), cut, and the path length that a leaf stands for."""

    feature: np.ndarray
    cut: np.ndarray
    path: np.ndarray
    left: np.ndarray
    right: np.ndarray
    roots: np.ndarray
    typical: float
    threshold: float = np.inf

    def score(self, rows: np.ndarray) -> np.ndarray:
        """2 ** (-mean path / typical path): near 1 for rows isolated at once, under 0.5 for usual ones."""
        total = np.zeros(len(rows))
        every = np.arange(len(rows))
        for root in self.roots:
            at = np.full(len(rows), root)
            while True:
                feature = self.feature[at]
                inner = feature >= 0
                if not inner.any():
                    break
                below = rows[every, np.where(inner, feature, 0)] < self.cut[at]
                at = np.where(inner, np.where(below, self.left[at], self.right[at]), at)
            total += self.path[at]
        return 2.0 ** (-total / (len(self.roots) * self.typical)) if len(self.roots) else np.zeros(len(rows))


def _average_path(n: float) -> float:
    """Mean path length of an unsuccessful search in a binary tree of n rows."""
    return 0.0 if n <= 1 else 1.0 if n <= 2 else 2.0 * (np.log(n - 1) + 0.5772156649015329) - 2.0 * (n - 1) / n


def grow_forest(rows: np.ndarray, trees: int = TREES, tree_rows: int = TREE_ROWS, seed: int = 7) -> Forest:
    """Isolation forest over `rows`, each tree on `tree_rows` of them drawn without repeats.

    Cuts are uniform over the cell [low, high) that earlier cuts left of the unit cube, not over the rows' own range:
    shares have a known range, and a cell that no fitted row reaches is then isolated at once.
    """
    rng = np.random.default_rng(seed)
    feature, cut, path, left, right, roots = [], [], [], [], [], []
    size = min(tree_rows, len(rows))
    width, deepest = rows.shape[1], DEEPEST

    def node() -> int:
        for column, value in ((feature, -1), (cut, 0.0), (path, 0.0), (left, 0), (right, 0)):
            column.append(value)
        return len(feature) - 1

    for _ in range(trees if size else 0):
        root = node()
        roots.append(root)
        todo = [(root, rows[rng.permutation(len(rows))[:size]], np.zeros(width), np.ones(width), 0)]
        while todo:
            at, own, low, high, depth = todo.pop()
            if len(own) <= 1 or depth >= deepest:
                path[at] = depth + _average_path(len(own))
                continue
            f = int(rng.integers(width))
            c = float(rng.uniform(low[f], high[f]))
            below = own[:, f] < c
            feature[at], cut[at], left[at], right[at] = f, c, node(), node()
            upper, lower = high.copy(), low.copy()
            upper[f] = lower[f] = c
            todo += [(left[at], own[below], low, upper, depth + 1), (right[at], own[~below], lower, high, depth + 1)]
    return Forest(np.array(feature, np.int64), np.array(cut), np.array(path), np.array(left, np.int64),
                  np.array(right, np.int64), np.array(roots, np.int64), max(_average_path(size), 1e-9))


def _counts_of(column: pa.Array) -> dict[str, np.ndarray]:
    buf, offs = C.column_bytes(column)
    parts = [text_counts(b, o) for _, _, b, o in C.pieces(buf, offs)]
    return {c: np.concatenate([p[c] for p in parts]) if parts else np.zeros(0, np.int64) for c in COUNTS}


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = _counts_of(batch.column(1))
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(counts[c]) for c in COUNTS]], names=["id", *COUNTS])


def rule_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and the counts of every text, in one pass without a shuffle."""
    C.prepare(docs.sparkSession)
    src = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    kind = src.schema["id"].dataType.simpleString()
    out = src.mapInArrow(_count_batches, f"id {kind}, " + ", ".join(f"{c} long" for c in COUNTS))
    return out.withColumnRenamed("id", id_col)


def _as_counts(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    return {c: batch.column(c).to_numpy(zero_copy_only=False) for c in COUNTS}


def scored(statistics: DataFrame, forest: Forest) -> DataFrame:
    """Statistics with `base_failed`, `score` and `kept`."""
    names = [f for f in statistics.columns if f not in ("base_failed", "score", "kept")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = _as_counts(batch)
            failed, score = base_failed(counts), forest.score(features(counts))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in names], pa.array(failed), pa.array(score),
                 pa.array(~failed & (score < forest.threshold))], names=[*names, "base_failed", "score", "kept"])

    kinds = dict(statistics.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in names)
    return statistics.select(*names).mapInArrow(run, f"{schema}, base_failed boolean, score double, kept boolean")


def best_threshold(good: dict[int, int], bad: dict[int, int], good_cost: float = GOOD_COST) -> float:
    """The score step from which rows are rejected, by least cost; of equal ones the middle.

    Cost: `good_cost` times the share of good rows rejected plus the share of bad rows kept. `good` and `bad` are
    row counts per score step. Without bad rows nothing is rejected.
    """
    if not bad:
        return 2.0
    g, b = (np.array([c.get(k, 0) for k in range(SCORE_STEPS + 1)], float) for c in (good, bad))
    rejected = np.append(np.cumsum(g[::-1])[::-1], 0.0) / max(g.sum(), 1.0)
    kept = np.insert(np.cumsum(b), 0, 0.0) / b.sum()
    cost = good_cost * rejected + kept
    best = np.flatnonzero(cost <= cost.min() + 1e-12)
    return float(best[len(best) // 2]) / SCORE_STEPS


def fit(statistics: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality",
        fit_rows: int = FIT_ROWS, good_cost: float = GOOD_COST, seed: int = 7) -> Forest:
    """Grow the forest on a bounded sample of rows labelled good, and calibrate its threshold on all labelled rows.

    Only rows that pass the base rules count. An id with several labels is good only if all of them are 1.
    """
    one = (labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
           .groupBy(F.col(id_col).alias("labelled_id")).agg(F.min(label_col).alias("label")))
    passing = statistics.where("n_words >= 10 and 100 * n_repeat_words <= 20 * n_words")
    known = C.stored(passing.join(one, passing[id_col] == one["labelled_id"]).drop("labelled_id"), "quality-labelled")
    good = known.where("label = 1").select(
        F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), F.lit(1 << 30)).alias("seeded"), *COUNTS)
    share = min(1.0, 2.0 * fit_rows / max(good.count(), 1))  # about twice as many come near the driver as are kept
    drawn = good.where(F.col("seeded") < share * (1 << 30)).orderBy("seeded", *COUNTS).limit(fit_rows).toPandas()
    forest = grow_forest(features({c: drawn[c].to_numpy() for c in COUNTS}), seed=seed)
    if len(drawn):
        steps = (scored(known, forest).groupBy("label", F.floor(F.col("score") * SCORE_STEPS).alias("step"))
                 .agg(F.count("*").alias("n")).collect())  # at most two rows a step
        good = {r["step"]: r["n"] for r in steps if r["label"] == 1}
        bad = {r["step"]: r["n"] for r in steps if r["label"] == 0}
        forest.threshold = best_threshold(good, bad)
    C.release(known)
    return forest


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Counts, `base_failed`, `score` and `kept` for every document."""
    statistics = C.stored(rule_statistics(docs, id_col, text_col), "quality-statistics")
    return scored(statistics, fit(statistics, labels, id_col, **options))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents that are kept, all columns as they were; texts are never shuffled."""
    statistics = C.stored(rule_statistics(docs, id_col, text_col), "quality-statistics")
    forest = fit(statistics, labels, id_col, **options)
    C.release(statistics)
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = _counts_of(batch.column(place))
            good = ~base_failed(counts) & (forest.score(features(counts)) < forest.threshold)
            yield batch.filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)
