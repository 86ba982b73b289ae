"""Session construction and shared-storage helpers."""

from __future__ import annotations

import atexit
import gc
import os
import shutil
import tempfile
import threading
import uuid
import zipfile

from pyspark.sql import SparkSession


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "claimspark") -> SparkSession:
    """Session for tests and the bench. On a cluster, use the cluster's own session."""
    cpus = os.environ.get("BENCH_CPUS", "8")
    master = master or f"local[{cpus}]"
    parts = shuffle_partitions or int(cpus)
    builder = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.default.parallelism", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("CLAIMSPARK_DRIVER_MEMORY", "16g"))
        .config("spark.sql.sources.partitionOverwriteMode", "dynamic")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the cluster.

    The folder comes from the session (``spark.checkpoint.dir`` or an earlier
    ``setCheckpointDir``). Only a local-mode session without one gets a fresh
    scratch folder, as in tests; a cluster without one is a configuration error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = sc.getConf().get("spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set; point it at a shared folder")
    own = tempfile.mkdtemp(prefix="claimspark-ckpt-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)  # made here, so removed here when the application ends
    sc.setCheckpointDir(own)
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unique folder name under the shared checkpoint folder."""
    root = ensure_checkpoint_dir(spark)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df):
    """Reliable checkpoint into the shared checkpoint folder, computed once.

    `checkpoint()` alone evaluates the plan twice (the eager count, then the file
    write); persisting first lets the write read the cached blocks. The result has a
    short lineage and survives executor loss (unlike localCheckpoint).
    """
    from pyspark import StorageLevel

    ensure_checkpoint_dir(df.sparkSession)
    cached = df.persist(StorageLevel.MEMORY_AND_DISK)
    out = cached.checkpoint(eager=True)
    cached.unpersist()
    return out


def release(df) -> None:
    """Delete the files of a frame made by `materialize`, once nothing reads it any more."""
    spark = df.sparkSession
    kept = df._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
    if kept.isDefined():
        path = spark._jvm.org.apache.hadoop.fs.Path(kept.get())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished jobs now rather than at the driver's next full collection."""
    gc.collect()
    spark._jvm.System.gc()


_SHIPPING = threading.Lock()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that Python tasks can import it. Threads may ask at once."""
    with _SHIPPING:
        if not getattr(spark.sparkContext, "_claimspark_shipped", False):
            _ship(spark)


def _ship(spark: SparkSession) -> None:
    sc = spark.sparkContext
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    folder = tempfile.mkdtemp(prefix="claimspark-zip-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, "claimspark_pkg.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for place, _, names in os.walk(os.path.join(root, "claimspark")):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(place, name)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(path)
    sc._claimspark_shipped = True
