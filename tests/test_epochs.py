"""Mini-batch training against the same training over dense numpy vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimspark.operators.metrics import compute_metrics
from claimspark.plans import epochs as E
from claimspark.plans import models as MD
from tests.test_solver import WORDS, dense, macro

N_TRAIN, PARTS = 90, 3


@pytest.fixture(scope="module")
def rows():
    """(id, text, label, batch): 90 for training, 40 for validation; a text without words, copies, and noisy labels."""
    rng = np.random.default_rng(11)
    out = []
    for i in range(N_TRAIN + 40):
        lean = rng.random() < 0.5
        words = [WORDS[int(rng.integers(0, 9)) + (3 if lean else 0)] for _ in range(int(rng.integers(1, 10)))]
        out.append((i, " ".join(words), int(lean if rng.random() < 0.8 else not lean), i % PARTS))
    out[5], out[100] = (5, "", 1, 2), (100, "", 0, 1)
    out[7] = (7, *out[4][1:3], 1)
    return out


@pytest.fixture(scope="module")
def frames(spark, rows):
    whole = spark.createDataFrame(rows, "id int, statement_clean string, label_binary int, part int")
    return whole.where(F.col("id") < N_TRAIN), whole.where(F.col("id") >= N_TRAIN)


def dense_training(rows, p, s):
    """[(weights, train loss, eval loss, accuracy, macro F1)] of every epoch, without early stopping."""
    x, _ = dense(rows, p.ngram_max, p.max_features, range(N_TRAIN))
    a = np.hstack([x, np.ones((len(x), 1))])
    y = np.array([r[2] for r in rows])
    sign, part, train = 2.0 * y - 1, np.array([r[3] for r in rows]), np.arange(len(rows)) < N_TRAIN

    def loss(w, at):
        m = sign[at] * (a[at] @ w)
        return np.logaddexp(0, -m) if p.kind == "lr" else np.maximum(1 - m, 0) ** 2

    def slope(w, at):
        m = sign[at] * (a[at] @ w)
        outer = -1 / (1 + np.exp(m)) if p.kind == "lr" else -2 * np.maximum(1 - m, 0)
        return a[at].T @ (sign[at] * outer) / at.sum()

    w = np.zeros(a.shape[1])
    m, v, t, steps = w.copy(), w.copy(), 0, s.epochs * PARTS
    warm = int(np.ceil(s.warmup_ratio * steps))
    out = []
    for epoch in range(1, s.epochs + 1):
        total = 0.0
        for k in np.random.default_rng([s.seed, epoch]).permutation(PARTS):
            at = train & (part == k)
            total += loss(w, at).sum()
            g = slope(w, at)
            rate = s.learning_rate * ((t + 1) / warm if t < warm else (steps - t) / (steps - warm))
            t += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g ** 2
            kept = w.copy()
            kept[-1] = 0
            w = w - rate * (m / (1 - 0.9 ** t) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8) + s.weight_decay * kept)
        guess = (a[~train] @ w > 0).astype(int)
        out.append((w, total / N_TRAIN, loss(w, ~train).mean(), (guess == y[~train]).mean(), macro(y[~train], guess)))
    return out


@pytest.mark.parametrize("kind, metric", [("lr", "f1"), ("svm", "loss")])
def test_training_equals_the_dense_one_and_restores_its_best_epoch(spark, frames, rows, tmp_path, kind, metric):
    p = MD.Params(kind, 2, 40)
    s = E.Schedule(epochs=12, batches=PARTS, learning_rate=0.3, patience=2, metric=metric, seed=3)
    got = E.train_epochs(*frames, p, s, batch_col="part", checkpoint_dir=str(tmp_path / "ckpt"))
    want = dense_training(rows, p, s)

    value = [e[4] if metric == "f1" else -e[2] for e in want]
    best, waited, end = 0, 0, len(want)
    for i in range(1, len(want)):
        best, waited = (i, 0) if value[i] > value[best] else (best, waited + 1)
        if waited == s.patience:
            end = i + 1
            break
    assert got.stopped_early and len(got.history) == end < s.epochs
    assert got.best_epoch == best + 1 < len(got.history)  # the best epoch isn't the last
    for e, (_, train_loss, eval_loss, accuracy, f1) in zip(got.history, want):
        np.testing.assert_allclose([e.train_loss, e.eval_loss, e.accuracy, e.f1], [train_loss, eval_loss, accuracy, f1], atol=1e-9)
    np.testing.assert_allclose(got.weights, want[best][0], atol=1e-9)
    np.testing.assert_allclose(got.classifier.model.coefficients.toArray(), want[best][0][:-1], atol=1e-9)

    # the restored model scores the validation rows as its epoch did, and so does its checkpoint
    assert got.checkpoints[-1].endswith(f"epoch-{got.best_epoch}")
    for model in (got.classifier, MD.TfidfClassifier.load(spark, got.checkpoints[-1])):
        f1 = compute_metrics(model.predict(frames[1]), "label_binary", "prediction").first()["f1"]
        assert f1 == pytest.approx(got.history[best].f1, abs=1e-12)
    shown = got.history_frame(spark).collect()
    assert [r["epoch"] for r in shown if r["restored"]] == [got.best_epoch] and shown[-1]["steps"] == end * PARTS


def test_rate_rises_and_falls():
    s = E.Schedule(learning_rate=1.0, warmup_ratio=0.2)
    assert [round(s.rate(i, 10), 3) for i in range(10)] == [0.5, 1.0, 1.0, 0.875, 0.75, 0.625, 0.5, 0.375, 0.25, 0.125]
    assert E.Schedule(learning_rate=1.0, warmup_ratio=0.0).rate(0, 4) == 1.0


def test_hashed_parts_and_every_row_once(frames):
    s = E.Schedule(epochs=2, batches=4, patience=5)
    first, second = (E.train_epochs(*frames, MD.Params(max_features=30), s) for _ in range(2))
    assert [e.steps for e in first.history] == [4, 8] and not first.stopped_early
    np.testing.assert_allclose(first.weights, second.weights, atol=1e-12)


def test_what_cannot_be_trained_raises(frames):
    train, valid = frames
    empty = train.limit(0)
    for a, b in ((empty, valid), (train, empty)):
        with pytest.raises(ValueError, match="need rows"):
            E.train_epochs(a, b)
    with pytest.raises(ValueError, match="metric"):
        E.train_epochs(train, valid, schedule=E.Schedule(metric="accuracy"))
    with pytest.raises(ValueError, match="empty vocabulary"):
        E.train_epochs(train.withColumn("statement_clean", F.lit("")), valid)
