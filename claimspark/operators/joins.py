"""Join helpers: broadcast only behind a size check, shuffle join (AQE skew split) beyond it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimspark.session import materialize

# Bytes a lookup side may have and still be broadcast to every executor.
BROADCAST_BYTES = 64 << 20
ROW_BYTES = 16


def measured_bytes(df: DataFrame) -> int:
    """Size of a frame's values in bytes, by one aggregate: fixed-width columns count 8, text its UTF-8 length."""
    def width(field):
        kind = field.dataType.typeName()
        if kind in ("string", "binary"):
            return F.coalesce(F.octet_length(field.name), F.lit(0)) + 8
        if kind in ("array", "map", "struct"):
            return F.coalesce(F.octet_length(F.to_json(F.struct(F.col(field.name)))), F.lit(0))
        return F.lit(8)

    row = sum((width(f) for f in df.schema.fields), F.lit(ROW_BYTES))
    return int(df.agg(F.coalesce(F.sum(row.cast("long")), F.lit(0))).first()[0])


def join_checked(big: DataFrame, small: DataFrame, on, how: str = "inner",
                 max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Join `big` with a lookup side whose size in bytes is measured first.

    The small side is computed once into the checkpoint folder. At or under `max_bytes` it is broadcast, so
    a hot key on the big side (a third of all rows) never lands in one task. Over the bound the plan is a
    plain shuffle join and AQE's skew handling splits hot partitions of the big side.
    """
    small = materialize(small)
    if measured_bytes(small) <= max_bytes:
        return big.join(F.broadcast(small), on, how)
    return big.join(small, on, how)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition by `keys` when the scanned bytes are too few to give every core a split (few large
    files or row groups), so CPU-heavy per-row work that follows runs on every core. The size is the
    optimizer's estimate from the file listing: no job runs, and inputs that are large enough stay as they are."""
    spark = df.sparkSession
    target = spark.sparkContext.defaultParallelism
    split = int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if size >= target * split:
        return df
    return df.repartition(target, *keys) if keys else df.repartition(target)


#: Scanned bytes, as the optimizer estimates them, of the documents that one task takes apart.
DEAL_BYTES = 1 << 19
#: An estimate beyond this is none (a frame without statistics).
UNKNOWN_BYTES = 1 << 50
ROWS_WITHOUT_ESTIMATE = 4096


def deal(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition by `keys` into so many tasks that each gets about `DEAL_BYTES`, whatever the table's size.

    For rows that are exploded right after: a task's words take a hundred times the bytes that its documents took in the
    scan, and partitions that AQE has merged by their shuffled bytes grow past a task's memory. A given number is not merged.
    """
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    wanted = -(-size // DEAL_BYTES) if size < UNKNOWN_BYTES else -(-df.count() // ROWS_WITHOUT_ESTIMATE)
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(min(least, df.sparkSession.sparkContext.defaultParallelism), wanted), *keys)
