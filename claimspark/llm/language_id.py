"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Texts are lower-cased; every run of non-letters counts as one space. N-grams of one to three characters are hashed into
`BUCKETS` buckets. Document frequencies are counted over all training documents; the `FEATURES` most frequent
buckets form the vocabulary. A text's features are (1 + ln tf) * idf, scaled to length 1, over its whole text.

The classifier is fitted by follow-the-regularised-leader with elastic-net penalties (the l1 part keeps weights at
exactly zero), then a temperature is calibrated on all training documents that the fit has not seen, by least negative log
likelihood: each task sums the log probabilities at every temperature of a grid.

Bound: at most about `TRAIN_ROWS` training documents per language are drawn by a seeded hash of the id, and four fifths of them are
fitted on; the driver holds their non-zero counts. Everything else covers all training documents.

Defined results: null texts and texts without a letter get `und` with score 0; without any training document all do; rows
with a null language, or a null id, are never learned from; repeated rows are predicted each; an empty table gives an
empty result; ties go to the first language in code-point order; other columns are ignored.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimspark.llm import common as C

BUCKET_BITS = 16
BUCKETS = 1 << BUCKET_BITS
FEATURES = 4096
TRAIN_ROWS = 600
UNKNOWN = "und"
_CHUNK = 4096

_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """True at the code point of every letter."""
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1))
    return _LETTER[0]


def gram_buckets(text: str) -> np.ndarray:
    """Buckets of all one- to three-character n-grams of a text; empty without a letter."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[codes]
    if not letter.any():
        return np.zeros(0, np.int64)
    codes = np.where(letter, codes, 32)
    keep = np.ones(len(codes), bool)
    keep[1:] = letter[1:] | letter[:-1]
    codes = np.concatenate([[32], codes[keep], [32]]).astype(np.uint64)
    shift, up = np.uint64(64 - BUCKET_BITS), np.uint64(21)
    two = codes[:-1] << up | codes[1:]
    three = two[:-1] << up | codes[2:]
    return np.concatenate([((g + np.uint64(1)) * C._ODD >> shift).astype(np.int64) for g in (codes, two, three)])


@dataclass
class Model:
    """Vocabulary (bucket -> feature or -1), idf, weights (feature x language) with a bias row, temperature."""

    languages: list[str]
    feature: np.ndarray
    idf: np.ndarray
    weights: np.ndarray
    temperature: float = 1.0

    def counts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Feature counts (text x feature) and whether a text has letters."""
        n = len(self.idf)
        out, some = np.zeros((len(texts), n), dtype=np.float32), np.zeros(len(texts), bool)
        for k, text in enumerate(texts):
            buckets = gram_buckets(text)
            some[k] = len(buckets) > 0
            own = self.feature[buckets]
            out[k] = np.bincount(own[own >= 0], minlength=n)
        return out, some

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        return tf_idf(counts, self.idf)

    def probabilities(self, vectors: np.ndarray) -> np.ndarray:
        return softmax((vectors @ self.weights[:-1] + self.weights[-1]) / self.temperature)


def tf_idf(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    out = np.where(counts > 0, 1.0 + np.log(np.maximum(counts, 1.0)), 0.0) * idf
    norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return out / np.where(norm > 0, norm, 1.0)


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


class SparseRows:
    """TF-IDF vectors of texts kept as their non-zero counts; `rows[i]` gives the vectors of some rows."""

    def __init__(self, rows: list[tuple[bytes, bytes]], idf: np.ndarray):
        """`rows`: (places as int32, counts as float32) of each text."""
        self.rows, self.idf, self.shape = rows, idf, (len(rows), len(idf))

    def __len__(self) -> int:
        return len(self.rows)

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        counts = np.zeros((len(at), len(self.idf)), dtype=np.float32)
        for k, i in enumerate(at):
            place, count = self.rows[i]
            counts[k, np.frombuffer(place, np.int32)] = np.frombuffer(count, np.float32)
        return tf_idf(counts, self.idf)


def fit_ftrl(x: np.ndarray | SparseRows, y: np.ndarray, classes: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.05,
             l2: float = 0.05, epochs: int = 4, batch: int = 16, seed: int = 5) -> np.ndarray:
    """Weights (feature + bias, class) by follow-the-regularised-leader over shuffled mini-batches.

    Per coordinate, z sums the gradients less the drift of the learning rate and n their squares; the weight is
    0 while |z| <= l1, else -(z - sign(z) l1) / ((beta + sqrt(n)) / alpha + l2).
    """
    rng = np.random.default_rng(seed)
    z, n = np.zeros((x.shape[1] + 1, classes)), np.zeros((x.shape[1] + 1, classes))
    target = np.eye(classes)[y]

    def weights() -> np.ndarray:
        shrunk = np.sign(z) * np.maximum(np.abs(z) - l1, 0.0)
        return -shrunk / ((beta + np.sqrt(n)) / alpha + l2)

    w = weights()
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for i in range(0, len(order), batch):
            rows = order[i:i + batch]
            own = x[rows]
            own = np.hstack([own, np.ones((len(own), 1), own.dtype)])
            g = own.T @ (softmax(own @ w) - target[rows])
            drift = (np.sqrt(n + g * g) - np.sqrt(n)) / alpha
            z += g - drift * w
            n += g * g
            w = weights()
    return w


#: The temperatures tried.
GRID = np.geomspace(0.02, 10.0, 200)


def log_likelihoods(logits: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For each temperature of `GRID`, the summed log probabilities of the rows' classes and of all other classes."""
    out = np.zeros((2, len(GRID)))
    for k, t in enumerate(GRID):
        z = logits / t
        z = z - z.max(axis=1, keepdims=True)
        z = np.maximum(z - np.log(np.exp(z).sum(axis=1, keepdims=True)), np.log(1e-300))
        own = float(z[np.arange(len(y)), y].sum())
        out[:, k] = own, float(z.sum()) - own
    return out


def best_temperature(sums: np.ndarray, rows: int, classes: int) -> float:
    """The temperature with the least negative log likelihood, from the sums of all rows.

    Targets are smoothed by one more, wrong, row (1 / (rows + 2) of the weight is spread over the other
    classes), so that rows without any error do not ask for endless confidence.
    """
    if not rows or classes < 2:
        return 1.0
    wrong = 1.0 / (rows + 2)
    loss = -((1.0 - wrong) * sums[0] + wrong / (classes - 1) * sums[1]) / rows
    return float(GRID[int(np.argmin(loss))])


def fit_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The best temperature for rows that are at hand."""
    return best_temperature(log_likelihoods(logits, y), len(y), logits.shape[1])


def held_out(id_col: Column) -> Column:
    """True for ids whose crc32 (of the id as text) leaves 1 when divided by 3."""
    return F.crc32(id_col.cast("string").cast("binary")) % 3 == 1


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """This task's document counts per bucket, in chunks, with the number of documents in each row."""
    df, docs, mark = np.zeros(BUCKETS, np.int64), 0, np.zeros(BUCKETS, bool)
    for batch in batches:
        for value in batch.column(0):
            buckets = gram_buckets(value.as_py())
            if len(buckets):
                mark[buckets] = True
                df += mark
                mark[buckets] = False
                docs += 1
    chunks = range(0, BUCKETS, _CHUNK)
    yield pa.RecordBatch.from_arrays(
        [pa.array([i // _CHUNK for i in chunks], pa.int32()), C.binary([df[i:i + _CHUNK] for i in chunks]),
         pa.array([docs] * len(chunks), pa.int64())], names=["chunk", "df", "docs"])


def _sum_frequencies(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x.as_py(), np.int64) for x in table.column("df"))
    return pa.table({"chunk": table.column("chunk").slice(0, 1), "df": C.binary([total]),
                     "docs": pa.array([sum(table.column("docs").to_pylist())], pa.int64())})


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        features: int = FEATURES, train_rows: int = TRAIN_ROWS, seed: int = 3) -> Model:
    """Learn from the text and language of rows with both and with an id."""
    C.prepare(docs.sparkSession)
    train = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    sizes = {r["lang"]: r["n"] for r in train.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # per language
    languages = sorted(sizes)
    frequencies = (train.select("text").mapInArrow(_frequencies, "chunk int, df binary, docs long")
                   .groupBy("chunk").applyInArrow(_sum_frequencies, "chunk int, df binary, docs long")
                   .orderBy("chunk").collect())  # BUCKETS counts
    if not frequencies or not languages:
        return Model([], np.full(BUCKETS, -1), np.zeros(0), np.zeros((1, 0)))
    df = np.concatenate([np.frombuffer(r["df"], np.int64) for r in frequencies])
    chosen = np.sort(np.lexsort((np.arange(BUCKETS), -df))[:features])
    chosen = chosen[df[chosen] > 0]
    feature = np.full(BUCKETS, -1, dtype=np.int32)
    feature[chosen] = np.arange(len(chosen))
    idf = (np.log((1 + frequencies[0]["docs"]) / (1 + df[chosen])) + 1).astype(np.float32)
    model = Model(languages, feature, idf, np.zeros((len(chosen) + 1, len(languages))))

    share = F.lit(None).cast("double")
    for name, n in sizes.items():
        share = F.when(F.col("lang") == name, F.lit(min(1.0, 2.0 * train_rows / n))).otherwise(share)
    seeded = train.withColumn("seeded", F.xxhash64(F.lit(seed), "id"))
    near = F.pmod(F.col("seeded"), F.lit(1 << 30)) < share * (1 << 30)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("seeded", "id"))
    drawn = seeded.where(near).withColumn("rank", rank).where(F.col("rank") <= train_rows).drop("rank")
    spared = F.pmod(F.shiftrightunsigned("seeded", 40), F.lit(5)) == 4  # a fifth of the drawn rows isn't fitted on

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, _ = model.counts(batch.column("text").to_pylist())
            places = [np.flatnonzero(c) for c in counts]
            yield pa.RecordBatch.from_arrays(
                [batch.column("seeded"), batch.column("lang"), C.binary([p.astype(np.int32) for p in places]),
                 C.binary([c[p] for c, p in zip(counts, places)])], names=["seeded", "lang", "place", "count"])

    rows = drawn.where(~spared).select("seeded", "lang", "text").mapInArrow(
        vectors, "seeded long, lang string, place binary, count binary").toArrow().to_pylist()
    rows.sort(key=lambda r: (r["seeded"], r["lang"], r["place"], r["count"]))
    y = np.array([languages.index(r["lang"]) for r in rows], dtype=np.int64)
    model.weights = fit_ftrl(SparseRows([(r["place"], r["count"]) for r in rows], idf), y, len(languages))

    # the rest: those spared, those not near, and those behind the last one drawn of their language
    last: dict[str, int] = {}
    for r in rows:
        last[r["lang"]] = max(r["seeded"], last.get(r["lang"], r["seeded"]))
    end = F.lit(None).cast("long")
    for name, value in last.items():
        end = F.when(F.col("lang") == name, F.lit(value)).otherwise(end)
    model.temperature = _calibrated(seeded.where(spared | ~near | end.isNull() | (F.col("seeded") > end)), model)
    return model


def _calibrated(rest: DataFrame, model: Model) -> float:
    """The best temperature for all rows (text, lang) of `rest`."""
    sent = rest.sparkSession.sparkContext.broadcast(model)  # FEATURES x languages

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, total, n = sent.value, np.zeros((2, len(GRID))), 0
        number = {name: k for k, name in enumerate(own.languages)}
        for batch in batches:
            texts, langs = batch.column("text").to_pylist(), batch.column("lang").to_pylist()
            for i in range(0, len(texts), 256):
                counts, some = own.counts(texts[i:i + 256])
                y = np.array([number[name] for name in langs[i:i + 256]], dtype=np.int64)
                total += log_likelihoods(own.vectors(counts[some]) @ own.weights[:-1] + own.weights[-1], y[some])
                n += int(some.sum())
        yield pa.RecordBatch.from_arrays([pa.array([k for k in range(2) for _ in GRID], pa.int32()),
                                          pa.array(list(range(len(GRID))) * 2, pa.int32()), pa.array(total.ravel()),
                                          pa.array([n] * total.size, pa.int64())], names=["part", "place", "total", "n"])

    got = rest.select("text", "lang").mapInArrow(sums, "part int, place int, total double, n long").groupBy("part", "place").agg(
        F.sum("total").alias("total"), F.sum("n").alias("n")).orderBy("part", "place").collect()  # 2 x len(GRID)
    sent.destroy()
    if not got:
        return 1.0
    return best_temperature(np.array([r["total"] for r in got]).reshape(2, -1), got[0]["n"], len(model.languages))


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred and score of every row, from its whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES x languages
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = src.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            names, scores = [], []
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for i in range(0, len(texts), 256):
                part = texts[i:i + 256]
                if not own.languages:
                    names += [UNKNOWN] * len(part)
                    scores += [0.0] * len(part)
                    continue
                counts, some = own.counts(part)
                p = own.probabilities(own.vectors(counts))
                best = p.argmax(axis=1)
                names += [own.languages[b] if s else UNKNOWN for b, s in zip(best, some)]
                scores += [float(v) if s else 0.0 for v, s in zip(p.max(axis=1), some)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(names, pa.string()),
                                              pa.array(scores, pa.float64())], names=["id", "lang_pred", "score"])

    return src.mapInArrow(run, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)
