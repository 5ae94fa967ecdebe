"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cores: int | str = 8, app: str = "mediashelf") -> SparkSession:
    """A session for tests and the bench; on a cluster use the cluster's own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.adaptive.enabled", "true")
        # call sites for error messages cost several round trips per column expression
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )


def scratch_root(spark: SparkSession) -> str:
    """The folder shared by all executors; set here only for a local session without one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="mediashelf-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def new_scratch(spark: SparkSession, label: str) -> str:
    """An unused path below the shared folder."""
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def written(frame, label: str, batch_rows: int | None = None, path: str | None = None, keep_shuffles: bool = True):
    """Writes ``frame`` once to the shared folder (or to ``path`` in it) and reads it back, cutting
    its lineage; Python workers get ``batch_rows`` rows at a time, if given, instead of the session's
    number.  Without ``keep_shuffles`` the shuffle files of the write go when it is done, not when
    the driver happens to collect its garbage."""
    spark, path = frame.sparkSession, path or new_scratch(frame.sparkSession, label)
    during = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(batch_rows)} if batch_rows else {}
    if not keep_shuffles:
        during["spark.sql.classic.shuffleDependency.fileCleanup.enabled"] = "true"
    usual = {key: spark.conf.get(key) for key in during}
    for key, value in during.items():
        spark.conf.set(key, value)
    try:
        frame.write.parquet(path)
    finally:
        for key, value in usual.items():
            spark.conf.set(key, value)
    return spark.read.schema(frame.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a table below the shared folder that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
