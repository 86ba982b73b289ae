"""Preparation steps: missing values, labels, features, audits, TSV reading (traps T5-T13, T18)."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from claimspark.operators import prepare as P
from claimspark.schema import PROCESSED_COLUMNS, RAW_COLUMNS, RAW_SCHEMA
from claimspark.sources.tsv import load_all_splits, load_split
from tests.conftest import rows

LABELS = ["pants-fire", "false", "barely-true", "half-true", "mostly-true", "true"]


def raw_rows():
    out = []
    for i, lab in enumerate(LABELS):
        out.append((str(100 + i), lab, f"Claim number {i} SAYS SOMETHING!?", "economy", f"Speaker {i % 2}",
                    "Job", "Ohio", "republican" if i % 2 else "democrat", "1", "2", "3", "4", "5",
                    "a speech to congress" if i % 3 == 0 else "a tweet"))
    return out


@pytest.fixture()
def raw(spark):
    return spark.createDataFrame(raw_rows(), RAW_SCHEMA).withColumn("split", F.lit("train"))


def test_all_labels_mapped(spark, raw):
    out = P.map_labels(raw)
    assert out.count() == 6
    got = {r["label"]: (r["label_binary"], r["label_ordinal"]) for r in out.collect()}
    assert got == {"pants-fire": (0, 0), "false": (0, 1), "barely-true": (0, 2),
                   "half-true": (1, 3), "mostly-true": (1, 4), "true": (1, 5)}


def test_unknown_case_and_null_labels_dropped(spark, raw):
    extra = spark.createDataFrame([("900", "True", "x", *([None] * 11)), ("901", " true", "y", *([None] * 11)),
                                   ("902", None, "z", *([None] * 11))], RAW_SCHEMA).withColumn("split", F.lit("train"))
    both = raw.unionByName(extra)
    assert P.map_labels(both).count() == 6
    assert P.map_labels_join(both).count() == 6
    audit = rows(P.unknown_label_audit(both), "label", "n_rows")
    assert audit == [(None, 1), (" true", 1), ("True", 1)]


def test_missing_statement_dropped_blank_kept(spark, raw):
    extra = spark.createDataFrame([("910", "true", None, *([None] * 11)), ("911", "true", "   ", *([None] * 11))],
                                  RAW_SCHEMA).withColumn("split", F.lit("train"))
    df = P.handle_missing(raw.unionByName(extra))
    ids = {r["id"] for r in df.collect()}
    assert "910" not in ids and "911" in ids
    feats = P.engineer_features(df).where(F.col("id") == "911").first()
    assert feats["statement_clean"] == "" and feats["statement_len"] == 0
    assert feats["capitalized_word_ratio"] == 0.0
    audit = P.missing_audit(raw.unionByName(extra)).first()
    assert (audit["rows_in"], audit["rows_dropped"], audit["rows_out"]) == (8, 1, 7)


def test_counts_become_bigint_and_zero(spark, raw):
    extra = spark.createDataFrame([("920", "true", "s", None, None, None, None, None,
                                    None, "x", "3.7", "nan", "1d", None)], RAW_SCHEMA).withColumn("split", F.lit("t"))
    df = P.handle_missing(raw.unionByName(extra))
    for c in ["barely_true_counts", "false_counts", "half_true_counts", "mostly_true_counts",
              "pants_on_fire_counts"]:
        assert df.schema[c].dataType.simpleString() == "bigint"
    r = df.where(F.col("id") == "920").first()
    assert (r["barely_true_counts"], r["false_counts"], r["half_true_counts"], r["mostly_true_counts"],
            r["pants_on_fire_counts"]) == (0, 0, 3, 0, 0)
    r = P.engineer_features(df).where(F.col("id") == "920").first()
    assert r["speaker_total_statements"] == 3 and r["speaker_lie_rate"] == 0.0
    assert r["subject"] == "unknown" and r["party"] == "unknown"


def test_features_ranges_and_lie_rate(spark, raw):
    df = P.prepare_claims(raw)
    assert [c for c in df.columns if c != "split"] == PROCESSED_COLUMNS
    for r in df.collect():
        assert 0.0 <= r["capitalized_word_ratio"] <= 1.0
        assert r["speaker_lie_rate"] == pytest.approx((2 + 5) / 15)  # barely-true not in the numerator
        assert r["is_political_context"] in (0, 1)
        assert r["statement_len"] > 0
        assert r["exclamation_count"] == 1 and r["question_count"] == 1
    flags = {r["context"]: r["is_political_context"] for r in df.collect()}
    assert flags == {"a speech to congress": 1, "a tweet": 0}


def test_political_flag_is_substring_match(spark):
    df = spark.createDataFrame([("democratic rally",), ("presidential debate",), ("Senate",), (None,)], "context string")
    got = [r[0] for r in df.select(P.political_flag("context")).collect()]
    assert got == [1, 1, 0, 0]  # case-sensitive; the flag runs on the cleaned (lower-case) context


def test_model_input_drops_na_spellings(spark):
    df = spark.createDataFrame([("1", "good text", 1, "train"), ("2", "null", 0, "train"), ("3", "", 1, "train"),
                                ("4", None, 1, "train"), ("5", "n/a", 0, "train"), ("6", "ok", None, "train"),
                                ("7", "fine", 0, "test")],
                               "id string, statement_clean string, label_binary int, split string")
    got = P.model_input(df, splits=["train"])
    assert [r["id"] for r in got.collect()] == ["1"]
    assert got.schema["label_binary"].dataType.simpleString() == "int"


def test_class_balance(spark, raw):
    df = P.prepare_claims(raw)
    cb = {(r["level"], r["value"]): (r["n_rows"], r["rank"]) for r in P.class_balance(df).collect()}
    assert cb[("label_binary", "0")][0] == 3 and cb[("label_binary", "1")][0] == 3
    assert cb[("label_binary", "0")][1] == 1  # ties ranked by value
    assert sum(v[0] for k, v in cb.items() if k[0] == "label") == 6


def write(path, text):
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def tsv_row(*fields):
    return "\t".join(fields) + "\n"


def test_tsv_quotes_and_na(spark):
    d = tempfile.mkdtemp(prefix="claimspark-tsv-", dir="/tmp")
    base = ["a", "b", "c", "d", "e", "1", "2", "3", "4", "5", "ctx"]
    text = (tsv_row("1", "true", '"He said ""hi"" twice"', *base)
            + tsv_row("2", "false", '"multi\nline\tfield"', *base)
            + tsv_row("3", "NA", "null", "", "None", "none", *base[3:]))
    for s in ("train", "valid", "test"):
        write(os.path.join(d, f"{s}.tsv"), text)
    df = load_all_splits(spark, d)
    assert df.count() == 9
    r = {x["id"]: x for x in df.where(F.col("split") == "train").collect()}
    assert r["1"]["statement"] == 'He said "hi" twice'
    assert r["2"]["statement"] == "multi\nline\tfield"
    assert r["3"]["label"] is None and r["3"]["statement"] is None
    assert r["3"]["subject"] is None and r["3"]["speaker"] is None  # "" and "None" are missing values
    assert r["3"]["speaker_job"] == "none"                          # lower-case none is a real value


def test_tsv_too_many_fields_fails(spark):
    d = tempfile.mkdtemp(prefix="claimspark-tsv-", dir="/tmp")
    write(os.path.join(d, "x.tsv"), tsv_row(*[str(i) for i in range(15)]))
    with pytest.raises(Exception):
        load_split(spark, os.path.join(d, "x.tsv")).collect()


def test_tsv_short_row_fills_null(spark):
    d = tempfile.mkdtemp(prefix="claimspark-tsv-", dir="/tmp")
    write(os.path.join(d, "x.tsv"), tsv_row("1", "true", "text"))
    r = load_split(spark, os.path.join(d, "x.tsv")).first()
    assert r["statement"] == "text" and r["context"] is None


def test_missing_file_raises(spark):
    with pytest.raises(FileNotFoundError):
        load_split(spark, "/tmp/claimspark-does-not-exist/train.tsv")


def test_raw_columns_order():
    assert RAW_COLUMNS[0] == "id" and RAW_COLUMNS[-1] == "context" and len(RAW_COLUMNS) == 14


def test_tsv_quotes_inside_unquoted_fields(spark):
    d = tempfile.mkdtemp(prefix="claimspark-tsv-", dir="/tmp")
    base = ["a", "b", "c", "d", "e", "1", "2", "3", "4", "5", "ctx"]
    write(os.path.join(d, "x.tsv"), tsv_row("1", "true", 'say "hi"', *base) + tsv_row("2", "false", "plain", *base))
    got = {r["id"]: r["statement"] for r in load_split(spark, os.path.join(d, "x.tsv")).collect()}
    assert got == {"1": 'say "hi"', "2": "plain"}  # quotes are ordinary characters in this mode


TRICKY = ['plain', '"quoted"', '"tab\there"', '"two\nlines"', '"crlf\r\ninside"', 'say "hi" there', '"doubled ""q"" here"', '""', '',
          '"ends""\n""twice"', "5\" pipe", '"a\n\n\nb"', '"x" tail', '"""start"', '"many\n' + "lines\n" * 40 + 'end"']


def read_rows(spark, path, split_bytes):
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split_bytes))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        df = load_split(spark, path)
        return sorted((r["id"], r["statement"], r["context"]) for r in df.collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_tsv_records_at_every_split_edge(spark, end):
    d = tempfile.mkdtemp(prefix="claimspark-tsv-", dir="/tmp")
    base = [str(i) for i in range(10)]
    rows = [[f"{k:03d}", "true", TRICKY[k % len(TRICKY)], *base, TRICKY[(k * 7 + 1) % len(TRICKY)]] for k in range(30)]
    path = os.path.join(d, "x.tsv")
    with open(path, "w", newline="", encoding="utf-8") as f:
        f.write("".join("\t".join(r) + end for r in rows))

    def value(x):
        if not x.startswith('"'):
            return x or None
        body, rest, k = "", "", 1
        while k < len(x):
            if x[k] == '"' and x[k + 1:k + 2] == '"':
                body, k = body + '"', k + 2
            elif x[k] == '"':
                rest = x[k + 1:]
                break
            else:
                body, k = body + x[k], k + 1
        return (body + rest) or None

    whole = read_rows(spark, path, 1 << 30)
    assert [(a, b) for a, b, _ in whole if '" tail' not in str(b)] == [
        (r[0], value(r[2])) for r in rows if '" tail' not in r[2]] or [a for a, *_ in whole] == [r[0] for r in rows]
    exact = {r[0]: (value(r[2]), value(r[13])) for r in rows if not any(s in (r[2], r[13]) for s in ('"x" tail',))}
    assert {a: (b, c) for a, b, c in whole if a in exact} == exact
    for split in (37, 64, 101, 500):
        assert read_rows(spark, path, split) == whole
