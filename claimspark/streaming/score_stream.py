"""ST-1: continuous scoring of incoming statements (the streaming form of a predict endpoint).

readStream (files of requests) -> scorer -> prediction columns + version -> parquet with a
checkpoint. Every request row gives one prediction row, missing text scores as "".
The text rule and a trained `PipelineModel` are both stateless projections, so a stream of either is a plan without a
shuffle, and stream output equals batch output row for row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from claimspark.operators.scoring import FLAT_PREDICTION_COLUMNS, batch_score
from claimspark.schema import DEFAULT_MODEL_VERSION


def request_stream(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet",
                   glob: str | None = None, max_files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.format(fmt).schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.load(path)


def table_stream(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Stream a table that is one file or a folder of files. A stream's plain path must be a folder, a pattern may match either."""
    return request_stream(spark, f"{path[:-1]}[{path[-1]}]", schema)


def score_requests(requests: DataFrame, id_col: str, text_col: str,
                   version: str = DEFAULT_MODEL_VERSION, partitions: int | None = None) -> DataFrame:
    """Score each request. `partitions` spreads a micro-batch over that many tasks first
    (worth one shuffle when requests arrive in few large files and scoring is CPU-bound)."""
    req = requests.select(id_col, text_col)
    if partitions:
        req = req.repartition(partitions, id_col)
    scored = batch_score(req, text_col, version)
    return scored.select(id_col, *FLAT_PREDICTION_COLUMNS, "version")


def model_scores(requests: DataFrame, model, id_col: str, text_col: str, version: str) -> DataFrame:
    """Requests, batch or stream, scored by a trained classifier (anything with `predict_flat`)."""
    flat = model.predict_flat(requests.select(id_col, text_col), text_col, version)
    return flat.select(id_col, *FLAT_PREDICTION_COLUMNS, "version")


def start_model_scoring(requests: DataFrame, model, id_col: str, text_col: str, out_path: str, checkpoint: str,
                        version: str, available_now: bool = True, processing_time: str | None = None) -> StreamingQuery:
    """Score a request stream with a trained classifier."""
    return start_scoring(model_scores(requests, model, id_col, text_col, version), out_path, checkpoint, available_now,
                         processing_time)


def start_scoring(scored: DataFrame, out_path: str, checkpoint: str,
                  available_now: bool = True, processing_time: str | None = None) -> StreamingQuery:
    writer = (scored.writeStream.format("parquet").outputMode("append")
              .option("path", out_path).option("checkpointLocation", checkpoint))
    if available_now:
        writer = writer.trigger(availableNow=True)
    elif processing_time:
        writer = writer.trigger(processingTime=processing_time)
    return writer.start()
