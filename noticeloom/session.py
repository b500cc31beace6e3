"""Session settings and the shared place for written intermediate tables."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Texts of notices are a hundredth of their size in a file. A table that is small there only must not
    # go whole through the driver: what is broadcast is decided by the size of its rows.
    "spark.sql.sources.fileCompressionFactor": "100",
    # Parsing and matching cost much per byte, so small inputs still use all cores.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
    # Tables written by kind keep a file open per kind instead of sorting.
    "spark.sql.maxConcurrentOutputFileWriters": "8",
    # A join of many rows by two keys is dealt by both, but where an operator has dealt its sides by one.
    "spark.sql.requireAllClusterKeysForCoPartition": "true",
    # Pages are wide: hand them to Python a few at a time.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "256",
    "spark.sql.execution.arrow.maxBytesPerBatch": "16m",
}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def scratch_dir(spark: SparkSession) -> str:
    """Folder that all executors share, a new one for each application.

    ``spark.checkpoint.dir`` of the session, else the folder given to ``setCheckpointDir``.
    A run inside one process (tests) may use a local folder; on a cluster a
    missing setting is an error, as executors would write to their own disks.
    """
    context = spark.sparkContext
    root = (spark.conf.get("spark.checkpoint.dir", None)
            or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir())
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = os.path.join(tempfile.gettempdir(), f"noticeloom-{os.getpid()}")
    return f"{root.rstrip('/')}/noticeloom-{context.applicationId}"


def clear_scratch(spark: SparkSession) -> bool:
    """Remove what this application wrote to the shared folder, once its results are stored."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(scratch_dir(spark))
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.delete(path, True)


def write_out(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder, in folders ``by`` a column, and read it back.

    Cuts the lineage, so a lost executor never repeats the work before it, and
    several readers share one computation, each reading only its columns.
    """
    path = f"{scratch_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
