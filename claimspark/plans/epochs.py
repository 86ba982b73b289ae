"""Mini-batch training of the linear classifier with evaluation after each epoch, early stopping and the best epoch's weights.

The training rows are dealt into `batches` parts once, written as one partitioned table and packed part by part, so a step reads
its own part only and an epoch reads every row once; each epoch takes the parts in an order of its own. A step is one pass of
`solver.pass_over`: tasks sum slopes over their rows, Spark sums groups of tasks, and the driver moves the weights (at most
max_features + 1 numbers) by Adam with decoupled weight decay:

    m = 0.9 m + 0.1 g        v = 0.999 v + 0.001 g^2        g: mean slope of the batch's losses
    w = w - rate * (m' / (sqrt(v') + 1e-8) + weight_decay * w)        m', v': m, v without their bias towards zero

The bias isn't decayed. The rate rises in equal steps over the first `warmup_ratio` of all steps and falls in equal steps to zero.
Vocabulary and idf come from the training rows alone. After each epoch the validation rows are scored in one more pass.

Early stopping: an epoch counts as better only if its metric is strictly better than the best so far; after `patience` epochs in
a row without, training ends. The weights returned are those of the best epoch (the first among equals). With `checkpoint_dir`,
each better epoch is saved to `<checkpoint_dir>/epoch-<k>`, readable by `TfidfClassifier.load`, so a lost driver costs the epochs
since; an epoch that is half written never replaces a whole one.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimspark.operators.vectorize import NgramTerms, fold_vocabularies, smooth_idf, term_statistics, vector_stages
from claimspark.plans.models import NO_FOLD, ROW, Params, TfidfClassifier, _spark_model, with_row_key
from claimspark.plans.solver import Column, FeatureTable, feature_table, macro_f1, pass_over
from claimspark.session import materialize, scratch_path

TRAIN, VALID = 0, 1
#: Views of a table: one holds out the validation rows (their confusion), one holds out nothing (losses and slopes).
SCORED, SUMMED = 0, 1
BETAS, EPSILON = (0.9, 0.999), 1e-8


@dataclass(frozen=True)
class Schedule:
    epochs: int = 20
    batches: int = 8               # steps of an epoch
    learning_rate: float = 0.05
    warmup_ratio: float = 0.1      # share of all steps
    weight_decay: float = 0.01
    patience: int = 2              # epochs without a better metric before training ends
    metric: str = "f1"             # "f1": macro F1, higher is better; "loss": mean validation loss, lower is better
    seed: int = 42

    def rate(self, step: int, steps: int) -> float:
        """Learning rate of a step (from 0) out of `steps`."""
        warm = math.ceil(self.warmup_ratio * steps)
        if step < warm:
            return self.learning_rate * (step + 1) / warm
        return self.learning_rate * (steps - step) / max(1, steps - warm)

    def order(self, epoch: int, parts: int) -> np.ndarray:
        """The order in which an epoch takes the parts."""
        return np.random.default_rng([self.seed, epoch]).permutation(parts)


@dataclass(frozen=True)
class Epoch:
    epoch: int
    steps: int                     # steps done so far
    learning_rate: float           # of the epoch's last step
    train_loss: float              # mean over the epoch's rows, each at the weights its batch met
    eval_loss: float
    accuracy: float
    f1: float
    best: bool                     # better than all epochs before


@dataclass
class Training:
    classifier: TfidfClassifier    # with the best epoch's weights
    weights: np.ndarray            # one per term, then the bias
    history: list[Epoch]
    best_epoch: int
    stopped_early: bool
    checkpoints: list[str]

    def history_frame(self, spark: SparkSession) -> DataFrame:
        rows = [(e.epoch, e.steps, e.learning_rate, e.train_loss, e.eval_loss, e.accuracy, e.f1, e.epoch == self.best_epoch)
                for e in self.history]
        return spark.createDataFrame(rows, "epoch int, steps int, learning_rate double, train_loss double, eval_loss double, "
                                           "accuracy double, f1 double, restored boolean")


class _Adam:
    def __init__(self, size: int, decay: float):
        self.w, self.m, self.v, self.t = np.zeros(size), np.zeros(size), np.zeros(size), 0
        self.decay = np.full(size, decay)
        self.decay[-1] = 0.0

    def step(self, g: np.ndarray, rate: float) -> None:
        a, b = BETAS
        self.t += 1
        self.m = a * self.m + (1 - a) * g
        self.v = b * self.v + (1 - b) * g * g
        move = (self.m / (1 - a ** self.t)) / (np.sqrt(self.v / (1 - b ** self.t)) + EPSILON)
        self.w = self.w - rate * (move + self.decay * self.w)


def _dealt(train: DataFrame, valid: DataFrame, p: Params, s: Schedule, text_col: str, label_col: str,
           batch_col: str | None) -> DataFrame:
    """(terms, label, fold, batch) of all rows, kept. Rows are dealt by a key of their own, so copies don't fill one batch."""
    terms = NgramTerms(inputCol=text_col, outputCol="terms", ngramMax=p.ngram_max)

    def rows(df: DataFrame, fold: int, batch) -> DataFrame:
        return terms.transform(df).select("terms", F.col(label_col).cast("double").alias("label"), F.lit(fold).alias("fold"),
                                          batch.cast("int").alias("batch"))

    if batch_col is None:
        keyed = with_row_key(train.select(text_col, label_col))
        own = rows(keyed, TRAIN, F.pmod(F.xxhash64(F.lit(s.seed), ROW), F.lit(s.batches)))
    else:
        own = rows(train.select(text_col, label_col, batch_col), TRAIN, F.col(batch_col))
    return materialize(own.unionAll(rows(valid.select(text_col, label_col), VALID, F.lit(-1))))


def train_epochs(train: DataFrame, valid: DataFrame, params: Params = Params(), schedule: Schedule = Schedule(),
                 text_col: str = "statement_clean", label_col: str = "label_binary", id_col: str = "id",
                 batch_col: str | None = None, checkpoint_dir: str | None = None) -> Training:
    """Train on `train`, evaluate on `valid` after each epoch, and return the best epoch; see the module.

    `batch_col` deals the rows by a column of `train` (0 to batches - 1) in place of a hash. A part without rows takes no step.
    Rows without text have no terms and are scored by the bias. Either table without rows raises ValueError.
    """
    if schedule.metric not in ("f1", "loss"):
        raise ValueError(f"unknown metric {schedule.metric!r}")
    if params.kind not in ("lr", "svm"):
        raise ValueError(f"unknown model kind {params.kind!r}")
    spark = train.sparkSession
    docs = _dealt(train, valid, params, schedule, text_col, label_col, batch_col)
    sizes = {r["batch"]: r["n"] for r in docs.groupBy("batch").agg(F.count(F.lit(1)).alias("n")).collect()}  # one per batch
    n_valid = sizes.pop(-1, 0)
    if not n_valid or not sizes:
        raise ValueError("training and validation need rows")
    n_train, parts = sum(sizes.values()), sorted(sizes)

    stats = term_statistics(docs.where(F.col("fold") == TRAIN), "terms", "fold")
    vocabulary = fold_vocabularies(stats, [None], params.max_features)[0]
    terms = sorted(vocabulary)
    if not terms:
        raise ValueError("empty vocabulary: no text has a term")
    idf = smooth_idf(np.array([vocabulary[t] for t in terms], dtype=np.float64), n_train)
    counted = CountVectorizerModel.from_vocabulary(terms, inputCol="terms", outputCol="counts").transform(docs)
    path = scratch_path(spark, "batches")
    counted.select("counts", "label", "fold", "batch").write.partitionBy("batch").parquet(path)
    written = spark.read.parquet(path)

    def table(batch: int, n: int) -> FeatureTable:
        return feature_table(written.where(F.col("batch") == batch), "counts", "label", "fold", n, np.stack([idf, idf], axis=1),
                             [VALID, NO_FOLD], params.sublinear)

    def classifier(w: np.ndarray) -> TfidfClassifier:
        out = TfidfClassifier(params, id_col, text_col, label_col)
        out.pipeline = PipelineModel([*vector_stages(terms, idf, params.ngram_max, params.sublinear, text_col),
                                      _spark_model(spark, params.kind, w[:-1], w[-1])])
        return out

    scored, summed = Column(SCORED, params.kind, 1.0), Column(SUMMED, params.kind, 1.0)
    steps = schedule.epochs * len(parts)
    adam, history, saved = _Adam(len(terms) + 1, schedule.weight_decay), [], []
    best, best_value, best_epoch, waited = adam.w, -math.inf, 0, 0
    tables: list[FeatureTable] = []
    try:
        for b in parts:
            tables.append(table(b, sizes[b]))
        tables.append(table(-1, n_valid))
        for epoch in range(1, schedule.epochs + 1):
            total = rate = 0.0
            for k in schedule.order(epoch, len(parts)):
                slopes, loss, _ = pass_over(tables[k], [(summed, adam.w)])
                rate = schedule.rate(adam.t, steps)
                adam.step(slopes[0] / sizes[parts[k]], rate)
                total += float(loss[0])
            _, loss, confusion = pass_over(tables[-1], [(scored, adam.w), (summed, adam.w)])
            tn, fp, fn, tp = (int(c) for c in confusion[:, 0])
            f1, eval_loss = macro_f1(confusion[:, 0]), float(loss[1]) / n_valid
            value = f1 if schedule.metric == "f1" else -eval_loss
            better = value > best_value
            history.append(Epoch(epoch, adam.t, rate, total / n_train, eval_loss, (tn + tp) / n_valid, f1, better))
            if better:
                best, best_value, best_epoch, waited = adam.w, value, epoch, 0
                if checkpoint_dir:
                    saved.append(f"{checkpoint_dir.rstrip('/')}/epoch-{epoch}")
                    classifier(best).save(saved[-1])
            else:
                waited += 1
                if waited >= schedule.patience:
                    break
    finally:
        for t in tables:
            t.close()
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return Training(classifier(best), best, history, best_epoch, waited >= schedule.patience, saved)
