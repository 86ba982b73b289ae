"""Headerless TSV claim splits: reader (SRC-1/2) and writer.

The reader splits files across tasks and still honours quoted tabs and line ends. A line is a
function on one bit, "does it start inside a quoted field": it keeps the bit, sets it, or flips it. The
functions of a file split compose to one; a scan over the splits (one row each) gives each split its
start state. A second pass cuts every split into records; records that cross splits are put together
from their fragments. Fields are parsed by the built-in CSV function.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimspark.schema import NA_STRINGS, RAW_COLUMNS, RAW_SCHEMA, SPLITS
from claimspark.session import materialize, ship_package

# One column past the 14: filled only by rows with too many fields.
_SENTINEL = "__extra_field"
_READ_SCHEMA = T.StructType(RAW_SCHEMA.fields + [T.StructField(_SENTINEL, T.StringType(), True)])


def null_out_na(df: DataFrame, columns=None) -> DataFrame:
    """Turn the CSV missing-value spellings into null on every string column."""
    columns = columns or [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"]
    return df.withColumns({c: F.when(F.col(c).isin(NA_STRINGS), F.lit(None)).otherwise(F.col(c))
                           for c in columns})


# A field that ends on its line: quoted (then anything up to the tab), unquoted, or empty.
_CLOSED = r'(?:"[^"]*+(?:""[^"]*+)*+"[^\t]*+|[^"\t][^\t]*+|)'
_QUOTED_REST = r'[^"]*+(?:""[^"]*+)*+'
_OPENS = re.compile(rf'(?:{_CLOSED}\t)*+"{_QUOTED_REST}\Z', re.DOTALL)
_CLOSES = re.compile(rf'{_QUOTED_REST}"[^\t]*+(\t|\Z)', re.DOTALL)


def line_ends_inside(line: str, inside: bool) -> bool:
    """Whether a quoted field is open at the end of a line that starts inside one or not."""
    if '"' not in line:
        return inside
    if not inside:
        return _OPENS.match(line) is not None
    closed = _CLOSES.match(line)
    if closed is None:
        return True
    return bool(closed[1]) and _OPENS.match(line, closed.end()) is not None


def _by_split(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], list[str]]]:
    """Runs of lines of one file split, in file order."""
    for batch in batches:
        place = list(zip(batch.column("file").to_pylist(), batch.column("start").to_pylist()))
        lines, at = batch.column("line").to_pylist(), 0
        for k in range(1, len(place) + 1):
            if k == len(place) or place[k] != place[at]:
                yield place[at], lines[at:k]
                at = k


def _split_functions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, start, end state if it starts outside, if inside) of each split."""
    found: dict[tuple[str, int], tuple[bool, bool]] = {}
    for split, lines in _by_split(batches):
        out, ins = found.get(split, (False, True))
        for line in lines:
            if '"' in line:
                out, ins = line_ends_inside(line, out), line_ends_inside(line, ins)
        found[split] = (out, ins)
    rows = [{"file": f, "start": s, "if_outside": o, "if_inside": i} for (f, s), (o, i) in found.items()]
    yield pa.RecordBatch.from_pylist(rows, pa.schema([("file", pa.string()), ("start", pa.int64()),
                                                      ("if_outside", pa.bool_()), ("if_inside", pa.bool_())]))


_RECORDS = pa.schema([("file", pa.string()), ("start", pa.int64()), ("part", pa.string()), ("record", pa.string())])


def _split_records(batches: Iterator[pa.RecordBatch], inside_at: dict[tuple[str, int], bool]) -> Iterator[pa.RecordBatch]:
    """Whole records, and the fragments of records that cross a split: tail (opens), middle, head (closes)."""
    held: list[str] = []
    split = state = carried = None

    def leave() -> list[dict]:
        if split is None or not held:
            return []
        return [_row(split, "middle" if carried else "tail", "\n".join(held))]

    for place, lines in _by_split(batches):
        out: list[dict] = []
        if place != split:
            out += leave()
            held, split = [], place
            state = carried = inside_at.get(place, False)
        for line in lines:
            held.append(line)
            state = line_ends_inside(line, state)
            if not state:
                out.append(_row(split, "head" if carried else "whole", "\n".join(held)))
                held, carried = [], False
        if out:
            yield pa.RecordBatch.from_pylist(out, _RECORDS)
    if rest := leave():
        yield pa.RecordBatch.from_pylist(rest, _RECORDS)


def _row(split: tuple[str, int], part: str, record: str) -> dict:
    return {"file": split[0], "start": split[1], "part": part, "record": record}


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(record) of every file below `path`: one logical line each, without its line end."""
    ship_package(spark)
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        F.col("value").alias("line"))
    functions = materialize(lines.mapInArrow(
        _split_functions, "file string, start long, if_outside boolean, if_inside boolean"))
    # one row per split; a split starts where the composition of all before it ends
    inside_at: dict[tuple[str, int], bool] = {}
    state, file = False, None
    for r in functions.orderBy("file", "start").toLocalIterator():
        state = False if r["file"] != file else state
        file = r["file"]
        if state:
            inside_at[(r["file"], r["start"])] = True
        state = r["if_inside"] if state else r["if_outside"]
    cut = lines.mapInArrow(lambda it: _split_records(it, inside_at), "file string, start long, part string, record string")
    if not inside_at:  # no record crosses a split; only an unclosed quote at a file's end leaves a fragment
        return cut.select("record")
    cut = materialize(cut)
    order = Window.partitionBy("file").orderBy("start", F.col("part") == "tail")  # at most two fragments a split
    pieces = cut.where("part <> 'whole'").withColumn(
        "n", F.sum((F.col("part") == "tail").cast("long")).over(order))
    joined = pieces.groupBy("file", "n").agg(F.sort_array(F.collect_list(
        F.struct("start", (F.col("part") == "tail").alias("last"), "record"))).alias("p"))
    whole = joined.select(F.array_join(F.transform("p", lambda x: x["record"]), "\n").alias("record"))
    return cut.where("part = 'whole'").select("record").unionByName(whole)


def load_split(spark: SparkSession, path: str) -> DataFrame:
    """One split: 14 nullable string columns, quoted fields; a short row is padded with
    nulls, a row with too many fields fails the read (checked lazily, no extra pass).

    Quoted tabs and line ends (LF or CRLF, as they stand) belong to their field, wherever a file is
    split across tasks. Blank lines are skipped.
    """
    try:
        records = read_records(spark, path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            raise FileNotFoundError(f"File not found: {path}") from e
        raise
    line = F.regexp_replace("record", "\\r$", "")
    options = {"sep": "\t", "quote": '"', "escape": '"', "mode": "PERMISSIVE", "multiLine": "true", "lineSep": "\n",
               "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    parsed = records.select(line.alias("record")).where("record <> ''").select(
        F.from_csv("record", _READ_SCHEMA.simpleString()[len("struct<"):-1].replace(":", " "), options).alias("r")).select("r.*")
    checked = parsed.where(F.col(_SENTINEL).isNull()
                           | F.raise_error(F.lit(f"too many fields in a row of {path}")).isNull())
    return null_out_na(checked.select(*RAW_COLUMNS), RAW_COLUMNS)


def load_all_splits(spark: SparkSession, data_dir: str, pattern: str = "{split}.tsv") -> DataFrame:
    """train / valid / test as ONE DataFrame with a `split` column."""
    parts = [load_split(spark, f"{data_dir.rstrip('/')}/{pattern.format(split=s)}")
             .withColumn("split", F.lit(s)) for s in SPLITS]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def write_splits_tsv(df: DataFrame, out_dir: str) -> str:
    """Write raw claims in one pass as headerless TSV, one folder per split (split=<name>)."""
    (df.select(*RAW_COLUMNS, "split").write.mode("overwrite").partitionBy("split")
     .option("sep", "\t").option("header", False)
     .option("quote", '"').option("escape", '"').option("quoteAll", False)
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
     .csv(out_dir))
    return out_dir
