"""Scoring: rule scorers, prediction shaping, batch scoring, Python scorer boundary, sequences.

Predictions come out in two forms:
  flat    pred_label, pred_label_id, pred_confidence, prob_fake, prob_real
  nested  prediction struct<label, label_id, confidence, probabilities map<string,double>>
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimspark.functions.numeric import softmax2
from claimspark.functions.text import capitalized_word_ratio, clean_text, word_count
from claimspark.schema import CLASS_NAMES, DEFAULT_MODEL_VERSION
from claimspark.session import ship_package

FLAT_PREDICTION_COLUMNS = ["pred_label", "pred_label_id", "pred_confidence", "prob_fake", "prob_real"]

# Fixed rule-scorer coefficients (logit of REAL; the FAKE logit is 0).
TEXT_RULE = {"bias": 2.5, "capitalized_word_ratio": -10.0, "statement_len": -0.001}
CREDIT_RULE = {"bias": 1.5, "speaker_lie_rate": -8.0}


def text_rule_logit_features(cap_ratio: Column | str = "capitalized_word_ratio",
                             length: Column | str = "statement_len") -> Column:
    """REAL logit from the capital ratio (raw text) and word count (cleaned text)."""
    cap_ratio = F.col(cap_ratio) if isinstance(cap_ratio, str) else cap_ratio
    length = F.col(length) if isinstance(length, str) else length
    return (F.lit(TEXT_RULE["bias"]) + F.lit(TEXT_RULE["capitalized_word_ratio"]) * cap_ratio
            + F.lit(TEXT_RULE["statement_len"]) * length)


def text_rule_logit(raw_text: Column | str) -> Column:
    """REAL logit from the text alone (so stream and batch scoring agree)."""
    raw_text = F.col(raw_text) if isinstance(raw_text, str) else raw_text
    text = F.coalesce(raw_text, F.lit(""))
    return text_rule_logit_features(capitalized_word_ratio(text), word_count(clean_text(text)))


def credit_rule_logit(lie_rate: Column | str = "speaker_lie_rate") -> Column:
    lie_rate = F.col(lie_rate) if isinstance(lie_rate, str) else lie_rate
    return F.lit(CREDIT_RULE["bias"]) + F.lit(CREDIT_RULE["speaker_lie_rate"]) * lie_rate


def shape_probabilities(df: DataFrame, prob_fake: Column, prob_real: Column, nested: bool = False) -> DataFrame:
    """PRJ-15: argmax (ties to FAKE) -> name, confidence, probabilities (4 places)."""
    tmp = df.withColumns({"__p0": prob_fake, "__p1": prob_real})
    label_id = F.when(F.col("__p1") > F.col("__p0"), F.lit(1)).otherwise(F.lit(0))
    names = F.create_map(*[x for k, v in CLASS_NAMES.items() for x in (F.lit(k), F.lit(v))])
    out = tmp.withColumns({
        "pred_label_id": label_id,
        "pred_confidence": F.round(F.greatest("__p0", "__p1"), 4),
        "prob_fake": F.round("__p0", 4),
        "prob_real": F.round("__p1", 4),
    }).withColumn("pred_label", F.element_at(names, F.col("pred_label_id")))
    if nested:
        out = out.withColumn("prediction", F.struct(
            F.col("pred_label").alias("label"),
            F.col("pred_label_id").alias("label_id"),
            F.col("pred_confidence").alias("confidence"),
            F.create_map(F.lit("FAKE"), F.col("prob_fake"), F.lit("REAL"), F.col("prob_real"))
            .alias("probabilities")))
    return out.drop("__p0", "__p1")


def shape_prediction(df: DataFrame, logit_fake: Column, logit_real: Column,
                     nested: bool = False) -> DataFrame:
    """PRJ-15/16: softmax of two logits, then the shared shaping."""
    p0, p1 = softmax2(logit_fake, logit_real)
    return shape_probabilities(df, p0, p1, nested)


def score_with_rule(df: DataFrame, logit_real: Column, nested: bool = False) -> DataFrame:
    return shape_prediction(df, F.lit(0.0), logit_real, nested)


def batch_score(df: DataFrame, text_col: str = "statement", version: str = DEFAULT_MODEL_VERSION,
                nested: bool = False) -> DataFrame:
    """ML-13 with the text rule: missing text scores as "" (kept, not dropped); version attached."""
    filled = df.withColumn(text_col, F.coalesce(F.col(text_col), F.lit("")))
    return (score_with_rule(filled, text_rule_logit(text_col), nested)
            .withColumn("version", F.lit(version)))


# -- ML-12: external scorers through Arrow batches ---------------------------

# Python workers are reused across tasks: a model built once stays in the worker process.
_WORKER_MODELS: dict[str, Callable] = {}


def _worker_model(key: str, make_predict: Callable[[], Callable]) -> Callable:
    if key not in _WORKER_MODELS:
        _WORKER_MODELS[key] = make_predict()
    return _WORKER_MODELS[key]


def score_in_pandas(df: DataFrame, make_predict: Callable[[], Callable[[list[str]], np.ndarray]],
                    text_col: str = "statement", version: str = DEFAULT_MODEL_VERSION) -> DataFrame:
    """Score with a Python model: `make_predict()` builds `predict(texts) -> array[n, 2]` of
    class probabilities once per Python worker process. The worker's cache key is the hash of the
    pickled factory with all it closes over, so two models never share an entry. Batches are Arrow
    record batches; only the text column crosses to Python.
    """
    ship_package(df.sparkSession)
    key = hashlib.sha256(cloudpickle.dumps(make_predict)).hexdigest()

    @F.pandas_udf("prob_fake double, prob_real double")
    def probabilities(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        predict = _worker_model(key, make_predict)
        for texts in batches:
            probs = np.asarray(predict(texts.tolist()), dtype="float64").reshape(-1, 2)
            yield pd.DataFrame({"prob_fake": probs[:, 0], "prob_real": probs[:, 1]})

    filled = df.withColumn(text_col, F.coalesce(F.col(text_col), F.lit("")))
    scored = filled.withColumn("__prob", probabilities(F.col(text_col)))
    out = shape_probabilities(scored, F.col("__prob.prob_fake"), F.col("__prob.prob_real"))
    return out.drop("__prob").withColumn("version", F.lit(version))


def python_text_rule() -> Callable[[list[str]], np.ndarray]:
    """The text rule written for a Python worker (the stand-in for an external model)."""
    import re

    ws = re.compile(r"\s+")
    non_ascii = re.compile(r"[^\x00-\x7F]+")

    def predict(texts: list[str]) -> np.ndarray:
        s = pd.Series(texts, dtype="object").fillna("")
        words = s.str.split()
        n = words.str.len()
        upper = words.map(lambda ws_: sum(1 for w in ws_ if w.isupper() and len(w) > 1))
        ratio = np.where(n == 0, 0.0, upper / n.where(n > 0, 1))
        clean = s.map(lambda t: non_ascii.sub(" ", ws.sub(" ", t.strip())).lower())
        length = clean.str.split().str.len()
        z = (TEXT_RULE["bias"] + TEXT_RULE["capitalized_word_ratio"] * ratio
             + TEXT_RULE["statement_len"] * length.to_numpy(dtype="float64"))
        p_real = 1.0 / (1.0 + np.exp(-z))
        return np.stack([1.0 - p_real, p_real], axis=1)

    return predict
